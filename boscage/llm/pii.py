"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and dates that pass validation (Luhn, octet range, calendar, area rules, mod 97) are permuted by a keyed
Feistel network within their own format: digits stay digits, separators stay, check digits are made valid again.
The permutation depends on the key and the format only, so equal values have equal pseudonyms in all documents and
different values of a format have different ones. Local parts of mail addresses are permuted letter by letter class.

Defined results: a null text stays null and has zero counts; an empty text stays empty; what fails validation is
tried again without the groups around it (cards: any groups in a row, the first and longest that passes; IBANs: the length of the country), and else left as it is; repeated rows give equal rows; other columns are ignored unless asked for. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.llm.common import let

ROUNDS = 10
KINDS = ("email", "ip", "iban", "date", "ssn", "phone", "card")

#: What may be personal data; validation decides. The order settles overlaps that start at the same place.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}"
_IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_DATE = r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|[-.]\d)"
_INTL = r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
_CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)"
PATTERN = "|".join((_EMAIL, _IP, _IBAN, _DATE, _SSN, _PHONE, _INTL, _CARD))


def _prf(key: str, tag: Column, r: Column, other: Column) -> Column:
    """64 hex digits that depend on key, format, round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), tag, r.cast("string"), other), 256)


def _number(hexes: Column, at: int = 1, digits: int = 12) -> Column:
    return F.conv(F.substring(hexes, at, digits), 16, 10).cast("long")


def feistel_chars(codes: Column, vary: Column, key: str, tag: str) -> Column:
    """Permutes the code points at the positions of vary, each within its class (digit, lower case, upper case).

    The halves of the network are the first and second half of the positions that vary. codes and vary: arrays.
    """
    # Places of the varying code points; halves alternate so that short runs still mix.
    places = F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: F.get(vary, i))

    def run(pl):
        half = F.floor(F.size(pl) / 2).cast("int")
        values = F.transform(pl, lambda i: F.get(codes, i))

        def shifted(own, k):
            def one(c, i):
                move = F.conv(F.substring(k, F.lit(1) + (i % 16) * 4, F.lit(4)), 16, 10).cast("int")
                low = F.when(c <= 57, F.lit(48)).when(c <= 90, F.lit(65)).otherwise(F.lit(97))
                radix = F.when(c <= 57, F.lit(10)).otherwise(F.lit(26))
                return low + (c - low + move) % radix

            return F.transform(own, one)

        def step(st, r):
            a, b = st["a"], st["b"]
            text = lambda x: F.array_join(x.cast("array<string>"), ",")
            tagged = F.concat(F.lit(tag), F.size(a).cast("string"), F.lit(":"), F.size(b).cast("string"))
            # Fixed characters are part of the format, and the same for a value in any document.
            even = let(_prf(key, tagged, r, text(b)), lambda k: F.struct(shifted(a, k).alias("a"), b.alias("b")))
            odd = let(_prf(key, tagged, r, text(a)), lambda k: F.struct(a.alias("a"), shifted(b, k).alias("b")))
            return F.when(r % 2 == 0, even).otherwise(odd)

        start = F.struct(F.slice(values, 1, half).alias("a"), F.slice(values, half + 1, F.size(pl)).alias("b"))
        done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda st: F.concat(st["a"], st["b"]))
        return let(
            done, lambda new: F.transform(codes, lambda c, i: F.when(F.get(vary, i), F.get(new, (F.array_position(pl, i) - 1).cast("int"))).otherwise(c))
        )

    return F.when(F.exists(vary, lambda v: v), let(places, run)).otherwise(codes)


def feistel_pair(left: Column, right: Column, left_n: int, right_n: int, key: str, tag: str) -> Column:
    """A permutation of pairs below (left_n, right_n): struct(a, b)."""

    def step(st, r):
        a, b = st["a"], st["b"]
        move = lambda other: _number(_prf(key, F.lit(tag), r, other.cast("string")))
        return F.when(r % 2 == 0, F.struct(((a + move(b)) % left_n).alias("a"), b.alias("b"))).otherwise(F.struct(a.alias("a"), ((b + move(a)) % right_n).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), step)


def _codes(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.ascii(c))


def _joined(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.char(c)), "")


def _is_digit(c: Column) -> Column:
    return (c >= 48) & (c <= 57)


def _is_alnum(c: Column) -> Column:
    return _is_digit(c) | ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one being the check digit."""
    d = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(d, lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x))), F.lit(0), lambda a, x: a + x
    )


def mod97(s: Column) -> Column:
    """An alphanumeric string as IBANs read it, modulo 97."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when(_is_digit(c), (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97))


#: Days from 1900-01-01 to 2099-12-31 are 229 x 319.
_DAYS = (229, 319)


def _date(m: Column) -> Column:
    """struct(ok, value) of a date in one of the layouts y-m-d, d-m-y, m-d-y; a middle over 12 is the day."""
    p = F.split(m, "[-/.]")
    iso = F.length(p[0]) == 4
    slash = m.contains("/") & ~iso
    american = slash & (p[0].cast("int") <= 12)
    y = F.when(iso, p[0]).otherwise(p[2]).cast("int")
    mo = F.when(iso, p[1]).when(american, p[0]).otherwise(p[1]).cast("int")
    d = F.when(iso, p[2]).when(american, p[1]).otherwise(p[0]).cast("int")
    day = F.when((y >= 1900) & (y <= 2099) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= 31), F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd"))
    return F.struct(day.alias("day"), iso.alias("iso"), american.alias("american"), p.alias("p"))


def _new_date(m: Column, key: str) -> Column:
    def of(x):
        n = F.date_diff(x["day"], F.lit("1900-01-01").cast("date")).cast("long")
        sep = F.regexp_extract(m, "[-/.]", 0)
        fit = lambda v, part: F.when(F.length(part) == 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))

        def made(st):
            day = F.date_add(F.lit("1900-01-01").cast("date"), (st["a"] * _DAYS[1] + st["b"]).cast("int"))
            y, mo, d, p = F.year(day).cast("string"), F.month(day), F.day(day), x["p"]
            return (
                F.when(x["iso"], F.concat(y, sep, fit(mo, p[1]), sep, fit(d, p[2])))
                .when(x["american"], F.concat(fit(mo, p[0]), sep, fit(d, p[1]), sep, y))
                .otherwise(F.concat(fit(d, p[0]), sep, fit(mo, p[1]), sep, y))
            )

        return F.when(x["day"].isNotNull(), let(feistel_pair(F.floor(n / _DAYS[1]), n % _DAYS[1], *_DAYS, key, "date"), made))

    return let(_date(m), of)


#: Characters of an IBAN by country.
IBAN_LENGTHS = dict(p.split(":") for p in """AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18
FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27
MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30""".split())


def _iban_ok(s: Column) -> Column:
    """Whether an IBAN without blanks has its check digits."""
    return mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1


def _parts(m: Column, start: Column, length: Column) -> Column:
    """struct(before, part, after) of m, the part from start (0 on) of so many characters."""
    return F.struct(F.substring(m, F.lit(1), start).alias("before"), F.substring(m, start + 1, length).alias("part"), F.substring(m, start + length + 1, F.length(m)).alias("after"))


def valid_part(m: Column) -> Column:
    """struct(before, part, after) of a match of PATTERN: the card or IBAN inside a match that fails as a whole, else all of it."""
    whole = F.struct(F.lit("").alias("before"), m.alias("part"), F.lit("").alias("after"))
    digits = lambda s: F.regexp_replace(s, r"\D", "")

    def card(groups):
        start = lambda i: F.aggregate(F.slice(groups, F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g) + 1)
        last = F.size(groups) - 1
        spans = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.reverse(F.sequence(i, last)), lambda j: F.struct(start(i).alias("s"), (start(j + 1) - 1 - start(i)).alias("n")))))
        number = lambda x: digits(F.substring(m, x["s"] + 1, x["n"]))
        fits = F.filter(spans, lambda x: let(number(x), lambda d: F.when(F.length(d).between(13, 19), luhn_sum(d) % 10 == 0).otherwise(False)))
        return let(F.get(fits, 0), lambda x: F.when(x.isNotNull(), _parts(m, x["s"], x["n"])).otherwise(whole))

    def iban(length):
        # Ends of prefixes of so many characters besides blanks, where a blank follows.
        ends = F.filter(F.sequence(F.lit(1), F.length(m) - 1), lambda k: (F.substring(m, k + 1, F.lit(1)) == " ") & (F.length(F.replace(F.substring(m, F.lit(1), k), F.lit(" "), F.lit(""))) == length))
        return let(F.get(ends, 0), lambda k: F.when(k.isNotNull() & _iban_ok(F.replace(F.substring(m, F.lit(1), k), F.lit(" "), F.lit(""))), _parts(m, F.lit(0), k)).otherwise(whole))

    lengths = F.create_map(*[F.lit(x) for k, v in IBAN_LENGTHS.items() for x in (k, int(v))])
    return (
        F.when(m.contains("@"), whole)
        .when(m.rlike("^[A-Z]{2}"), F.when(_iban_ok(F.replace(m, F.lit(" "), F.lit(""))), whole).otherwise(let(F.try_element_at(lengths, F.substring(m, 1, 2)), iban)))
        .when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), F.when(luhn_sum(digits(m)) % 10 == 0, whole).otherwise(let(F.split(m, "[ -]"), card)))
        .otherwise(whole)
    )


def pseudonym_within(m: Column, key: str) -> Column:
    """pseudonym() of the valid part of a match, what is around it kept."""
    return let(valid_part(m), lambda p: let(pseudonym(p["part"], key), lambda x: F.struct(x["kind"].alias("kind"), F.concat(p["before"], x["value"], p["after"]).alias("value"))))


#: Valid areas (001 to 899 but 666), groups and serials.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def new_ssn(groups: Column, key: str) -> Column:
    """The pseudonym of a valid number, given as its three groups: a permutation of exactly the valid ones."""
    area, group, serial = (groups[i].cast("int") for i in range(3))
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def written(st):
        place = F.floor(st["a"] / _GROUPS)
        return F.concat_ws("-", F.lpad((place + F.when(place >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((st["a"] % _GROUPS + 1).cast("string"), 2, "0"), F.lpad((st["b"] + 1).cast("string"), 4, "0"))

    return let(feistel_pair(place * _GROUPS + group - 1, serial - 1, _AREAS * _GROUPS, _SERIALS, key, "ssn"), written)


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value) for one match of PATTERN; kind is null and value the match itself where validation fails."""
    digits = F.regexp_replace(m, r"\D", "")
    n = F.length(digits)
    none = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    def chars(vary, tag):
        return let(_codes(m), lambda c: _joined(feistel_chars(c, vary(c), key, tag)))

    at = F.instr(m, "@")
    email = chars(lambda c: F.transform(c, lambda x, i: (i < at - 1) & _is_alnum(x)), "email")

    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    ip = let(octets, lambda o: let(feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip"), lambda st: F.concat_ws(".", F.floor(st["a"] / 256), st["a"] % 256, F.floor(st["b"] / 256), st["b"] % 256)))

    # Numbers of which some digits are fixed: ranks of digits decide which.
    rank = lambda c, i: F.size(F.filter(F.slice(c, F.lit(1), i + 1), _is_digit))
    prefix = F.length(F.regexp_replace(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0), r"\D", ""))
    national = n - prefix
    # Country code, first digit of area and exchange stay.
    phone = chars(lambda c: F.transform(c, lambda x, i: _is_digit(x) & (rank(c, i) > prefix) & ~((national == 10) & (rank(c, i) - prefix).isin(1, 4))), "phone")
    ssn = let(F.split(m, "-"), lambda g: new_ssn(g, key))

    body = chars(lambda c: F.transform(c, lambda x, i: _is_digit(x) & (rank(c, i) > 1) & (rank(c, i) < n)), "card")
    card = let(body, lambda b: F.concat(F.substring(b, F.lit(1), F.length(b) - 1), let(luhn_sum(F.concat(F.substring(F.regexp_replace(b, r"\D", ""), F.lit(1), n - 1), F.lit("0"))), lambda s: ((10 - s % 10) % 10).cast("string"))))

    plain = F.regexp_replace(m, " ", "")
    turned = lambda s, check: F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 2), check)
    bban = chars(lambda c: F.transform(c, lambda x, i: (i >= 4) & _is_alnum(x)), "iban")
    iban = let(bban, lambda b: F.concat(F.substring(b, 1, 2), let(98 - mod97(turned(F.regexp_replace(b, " ", ""), F.lit("00"))), lambda k: F.lpad(k.cast("string"), 2, "0")), F.substring(b, F.lit(5), F.length(b))))

    is_ip = m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    is_date = m.rlike(r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$")
    is_ssn = m.rlike(r"^\d{3}-\d{2}-\d{4}$")
    return (
        F.when(at > 0, made("email", email))
        .when(is_ip, F.when(F.forall(octets, lambda o: o <= 255), made("ip", ip)).otherwise(none))
        .when(m.rlike("^[A-Z]{2}"), F.when(mod97(turned(plain, F.substring(plain, 3, 2))) == 1, made("iban", iban)).otherwise(none))
        .when(is_date, let(_new_date(m, key), lambda d: F.when(d.isNotNull(), made("date", d)).otherwise(none)))
        .when(is_ssn, F.when(~m.rlike(r"^(000|666|9)|-00-|-0000$"), made("ssn", ssn)).otherwise(none))
        .when(m.startswith("+") | m.rlike(r"^(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"), F.when((n >= 7) & (n <= 15), made("phone", phone)).otherwise(none))
        .when((n >= 13) & (n <= 19), F.when(luhn_sum(digits) % 10 == 0, made("card", card)).otherwise(none))
        .otherwise(none)
    )


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_<kind> for each kind (long), and the columns of keep; a row for each input row."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *(keep or []))
    gaps, found = F.split("text", PATTERN, -1), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))

    def rebuilt(made):
        return F.struct(
            F.array_join(F.concat(F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(made)), made, lambda g, x: F.array(g, x["value"]))), F.slice(gaps, F.size(made) + 1, F.lit(1))), "").alias("text"),
            F.transform(made, lambda x: x["kind"]).alias("kinds"),
        )

    none = F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("kinds"))
    done = F.when(
        F.col("text").rlike("[0-9@]"), let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.transform(f, lambda m: pseudonym_within(m, key)), rebuilt)))
    ).otherwise(none)
    rows = rows.withColumn("done", done)
    count = lambda k: F.size(F.filter("done.kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", "done.text", *[count(k) for k in KINDS], *(keep or []))
