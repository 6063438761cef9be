"""Scalar functions as Column expressions: sizes, ages, text layout. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 49
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
#: Multipliers by suffix (fixed values).
SIZE_SUFFIXES = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}
AGE_SECONDS = {"h": 3600, "d": 86400, "w": 7 * 86400, "m": 30 * 86400, "y": 365 * 86400}


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def fixed(x: Column, digits: int) -> Column:
    """A double below 1024 with so many digits after the point, rounded as C's printf does: from its exact binary value, ties to even."""
    whole = (x * float(1 << _SCALE)).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(4,0)")
    one, half = F.lit(1 << _SCALE).cast("decimal(20,0)"), F.lit(1 << (_SCALE - 1)).cast("decimal(20,0)")

    def rounded(w):
        n = F.floor(w / one).cast("decimal(20,0)")
        # The quotient may have been rounded; the remainder says.
        n = F.when(w - n * one < 0, n - 1).when(w - n * one >= one, n + 1).otherwise(n)
        rest = w - n * one
        up = (rest > half) | ((rest == half) & (n % 2 == 1))
        return (n + F.when(up, 1).otherwise(0)).cast("bigint")

    def text(n):
        if not digits:
            return n.cast("string")
        return F.concat(F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))

    return let(let(whole, rounded), text)


def fmt_bytes(n: Column) -> Column:
    """Decimal units, three significant digits: 999 B, 1.50 KB, 12.3 MB, 100 GB."""
    value = F.abs(n.cast("double"))
    steps = [value]
    for _ in UNITS[1:]:
        steps.append(steps[-1] / 1000)
    out = None
    for v, unit in reversed(list(zip(steps, UNITS))):
        if unit == "B":
            text = F.concat(v.cast("bigint").cast("string"), F.lit(" B"))
        else:
            text = F.concat(F.when(v >= 99.95, fixed(v, 0)).when(v >= 9.995, fixed(v, 1)).otherwise(fixed(v, 2)), F.lit(f" {unit}"))
        out = text if out is None else F.when(v < 999.5, text).otherwise(out)
    return F.concat(F.when(n < 0, "-").otherwise(""), out)


_NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"


def parse_bytes(s: Column) -> Column:
    """500k, 10M, 1.5GB, 2GiB or plain bytes to a long; null where it is none of these."""
    text = F.lower(F.trim(s))
    number = F.regexp_extract(text, f"^({_NUMBER})[^0-9.]*$", 1)
    suffix = F.trim(F.regexp_extract(text, r"^[0-9.]+([^0-9.]*)$", 1))
    factor = F.lit(None).cast("double")
    for k, v in SIZE_SUFFIXES.items():
        factor = F.when(suffix == k, float(v)).otherwise(factor)
    value = F.when(number != "", number).cast("double")
    return let(value * factor, lambda v: F.when(v < 9e18, v.cast("bigint")))


def parse_age(s: Column) -> Column:
    """12h, 30d, 2w, 6m (months of 30 days) or 1y (365 days) to seconds; null where it is none of these."""
    text = F.lower(F.trim(s))
    number = F.regexp_extract(text, f"^([+]?{_NUMBER}(?:e[+-]?[0-9]+)?)[a-z]$", 1)
    factor = F.lit(None).cast("double")
    for k, v in AGE_SECONDS.items():
        factor = F.when(F.right(text, F.lit(1)) == k, float(v)).otherwise(factor)
    return F.when(number != "", number).cast("double") * factor


def fmt_ago(seconds: Column) -> Column:
    """'just now', '3 days ago', '8 months ago'; negative ages are now."""
    s = F.greatest(F.lit(0.0), seconds.cast("double"))

    def plural(unit_seconds: int, unit: str):
        n = (s / unit_seconds).cast("bigint")
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return (
        F.when(s < 3600, "just now").when(s < 86400, plural(3600, "hour")).when(s < 86400 * 60, plural(86400, "day")).when(s < 86400 * 730, plural(86400 * 30, "month")).otherwise(plural(86400 * 365, "year"))
    )


def fmt_count(n: Column) -> Column:
    """Thousands separated by commas."""
    return F.format_number(n, 0)


def fmt_plural(n: Column, noun: str) -> Column:
    return F.concat(fmt_count(n), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def fmt_seconds(s: Column) -> Column:
    """9.9s, 42s, 3m 20s."""
    whole = s.cast("bigint")
    return F.when(s < 10, F.concat(fixed(s, 1), F.lit("s"))).when(s < 90, F.concat(whole.cast("string"), F.lit("s"))).otherwise(
        F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))
    )


def fmt_bar(fraction: Column, width: int) -> Column:
    """A bar of full and light blocks; halves round away from zero."""
    filled = F.greatest(F.lit(0), F.least(F.lit(width), F.round(fraction * width).cast("int")))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def middle_truncated(s: Column, width: int) -> Column:
    """At most width characters, the middle cut out, where width is over 4."""
    if width <= 4:
        return s
    head = (width - 1) // 3
    return F.when(F.char_length(s) > width, F.concat(F.left(s, F.lit(head)), F.lit("…"), F.right(s, F.lit(width - 1 - head)))).otherwise(s)


def left_padded(s: Column, width: int) -> Column:
    """Padded to width on the left, never cut."""
    return F.when(F.char_length(s) >= width, s).otherwise(F.lpad(s, width, " "))


def right_padded(s: Column, width: int) -> Column:
    return F.when(F.char_length(s) >= width, s).otherwise(F.rpad(s, width, " "))
