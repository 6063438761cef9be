"""Queries opN_<name>: each operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from boscage.llm import jaccard, line_dedup, media, mixing, packing, pii, quality, secrets, substring_dedup, toxicity
from boscage.llm.common import documents

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "op10_quality_rules",
    r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  row_number() OVER () AS k FROM documents),
tri AS (SELECT k, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS t FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS n FROM tri) WHERE n >= 2),
rep AS (SELECT k, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(d) GROUP BY k),
ln AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS n_exclaim,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN rep USING (k) LEFT JOIN dup USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR n_upper > n_lower OR 10 * n_exclaim > 4 * n_words
            OR (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines) OR (n_words > 0 AND word_chars < 2 * n_words) OR word_chars > 20 * n_words) AS kept
FROM f""",
)
def op10_quality_rules(spark, sf_dir):
    rows = quality.apply_policy(quality.ledger(documents(spark, sf_dir)), "web", 1)
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.policy_mask("base", 1))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


@query(
    "op2_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS k FROM documents),
win AS (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
hot AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n >= 2),
pos AS (SELECT k, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
seen AS (SELECT k, p, word, max(i) OVER (PARTITION BY k ORDER BY p ROWS UNBOUNDED PRECEDING) AS last
         FROM pos LEFT JOIN (SELECT k AS hk, i FROM hot) ON hk = k AND i = p),
agg AS (SELECT k, count(*) FILTER (last IS NOT NULL AND p - last < 35)::BIGINT AS n_removed,
               string_agg(word, ' ' ORDER BY p) FILTER (last IS NULL OR p - last >= 35) AS kept_text FROM seen GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM d LEFT JOIN agg USING (k)""",
)
def op2_substring_dedup(spark, sf_dir):
    rows = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "slot")


#: Pseudonyms of these queries are made with a key of their own; users pass theirs.
QUERY_KEY = "boscage query key"


@query("op9_pii")
def op9_pii(spark, sf_dir):
    return pii.pseudonymize(documents(spark, sf_dir), QUERY_KEY)


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_packing")
def op3_packing(spark, sf_dir):
    rows = packing.pack(documents(spark, sf_dir), _tokenizer())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_media_columns")
def op6_media_columns(spark, sf_dir):
    rows = media.features(media.encode_texts(documents(spark, sf_dir)))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "ahash", "dhash").alias("feature"),
    )


@query("op1_secret_scans")
def op1_secret_scans(spark, sf_dir):
    rows = secrets.scan(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % toxicity.FOLDS == toxicity.HELD_OUT_FOLD
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query(
    "op4_ngram_jaccard_join",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT w, min(doc_id) AS copy_of, count(*) AS n_copies FROM d GROUP BY w),
g AS (SELECT DISTINCT copy_of AS k, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT copy_of, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM c WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.k <> b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a),
q AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(class_id, copy_of) AS class_id, copy_of, n_copies::BIGINT AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links
FROM d JOIN c USING (w) LEFT JOIN m ON m.a = copy_of LEFT JOIN q ON q.a = copy_of""",
)
def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(documents(spark, sf_dir))


@query("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    rows = line_dedup.line_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "removed")
