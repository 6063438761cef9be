"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long in which
bit i is set if rule i fails; a policy is a named, versioned set of rules, so that changing a policy or
asking what a rule alone removes needs no text any more, only the ledger.

Defined results: a null or empty text has zero for every measurement and fails only the rules that state so;
repeated rows are judged independently; other columns of the input are ignored, whatever their names.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.llm.common import let, words_of

#: Positions take this many low bits of a packed window; the rest holds its hash. Longer texts are not packed.
POSITION_BITS = 24


@dataclass(frozen=True)
class Rule:
    """One rule: fails where `fails` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a stored ledger stays readable when rules are added.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "shouting", "n_upper > n_lower"),
    Rule(4, "exclaiming", "10 * n_exclaim > 4 * n_words"),
    Rule(5, "repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    Rule(6, "short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule(7, "long_words", "word_chars > 20 * n_words"),
)
BIT = {r.name: r.bit for r in RULES}

#: Policies by (name, version): the rules that decide.
POLICIES = {
    ("base", 1): ("too_few_words", "repeated_trigrams"),
    ("web", 1): tuple(r.name for r in RULES),
}


def policy_mask(name: str, version: int) -> int:
    return sum(1 << BIT[r] for r in POLICIES[name, version])


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice in the array, first occurrences included.

    Windows are packed as hash-and-position longs and sorted as primitives; neighbours with equal hash bits are
    confirmed by the full 64-bit hashes of their words. Texts whose positions need more bits, and texts in which different windows share
    the packed bits (which could stand between equal ones), are sorted by the full hashes.
    """
    mask = (1 << POSITION_BITS) - 1
    windows = lambda w, f: F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: f(F.xxhash64(x, w[i + 1], w[i + 2]), i))
    at = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    full = lambda w, x: F.xxhash64(w[at(x)], w[at(x) + 1], w[at(x) + 2])
    same_bits = lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)

    def repeated(p, same):
        return F.filter(p, lambda x, i: ((i > 0) & same(x, F.get(p, i - 1))) | ((i < F.size(p) - 1) & same(x, F.get(p, i + 1))))

    def covered(positions):
        return let(
            F.sort_array(positions),
            lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(
                F.lit(3) + F.aggregate(F.sequence(F.lit(1), F.size(s)), F.lit(0), lambda n, i: n + F.when(i < F.size(s), F.least(F.lit(3), F.get(s, i) - F.get(s, i - 1))).otherwise(0))
            ),
        )

    def exact(w):
        pairs = F.sort_array(windows(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: covered(F.transform(repeated(p, lambda a, b: a["h"] == b["h"]), lambda x: x["i"])))

    def packed(w):
        def told(p):
            met = repeated(p, same_bits)
            clash = lambda m: F.size(F.filter(m, lambda x, i: F.when((i > 0) & same_bits(x, F.get(m, i - 1)), full(w, x) != full(w, F.get(m, i - 1))).otherwise(False))) > 0
            return let(met, lambda m: F.when(clash(m), exact(w)).otherwise(covered(F.transform(m, at))))

        return let(F.sort_array(windows(w, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))), told)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) > mask, exact(w)).otherwise(packed(w)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements that the rules use, one row for each input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def measured(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        let(words_of(F.col("text")), measured).alias("m"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaim"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[a-z]")).cast("long").alias("n_lower"),
    )
    return rows.select("doc_id", "m.*", "l.*", "n_symbols", "n_exclaim", "n_upper", "n_lower")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The measurements and failed_bits (long): bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, name: str, version: int) -> DataFrame:
    """Adds kept: whether no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy_mask(name, version))) == 0)


def ablations(rows: DataFrame, name: str, version: int) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that are kept without it.

    One pass over the ledger and one row for each distinct bitmask; the rules are counted over those.
    """
    mask = policy_mask(name, version)
    groups = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in POLICIES[name, version]])
    each = groups.select("bits", "count", F.explode(rules).alias("r")).select("bits", "count", "r.*")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    return each.groupBy("rule").agg(
        n(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        n((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
