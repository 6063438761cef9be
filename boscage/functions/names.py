"""What file names say: stems, copies, variants, series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boscage.functions.paths import is_same_or_inside, parts

# Patterns (fixed values): names that say "copy", searched in the stem; and weaker hints, searched in the whole name.
STRONG = (
    r"[ ._-]copy( ?\d+)?$",
    r"^copy of ",
    r" ?\(\d+\)$",
    r"[ ._-]salinan( ?\d+)?$",
    r"^salinan ",
    r"[ ._-]kopie( ?\d+)?$",
)
WEAK = r"(^|[ ._-])(backup|backups|bak|old|orig|archive|archived|tmp|temp)($|[ ._-])"


def extension(name: Column) -> Column:
    """What follows the last dot, if something stands on both sides of it; else empty."""
    return F.regexp_extract(name, r"^.+\.([^.]+)$", 1)


def stem(name: Column) -> Column:
    """The name without an extension of at most 5 characters and no blank."""
    ext = extension(name)
    strip = (ext != "") & (F.char_length(ext) <= 5) & ~ext.contains(" ") & (F.char_length(name) > F.char_length(ext) + 1)
    return F.when(strip, F.left(name, F.char_length(name) - F.char_length(ext) - 1)).otherwise(name)


def _says_copy(base: Column) -> Column:
    return base.rlike("(?i)" + "|".join(f"(?:{p})" for p in STRONG))


def has_copy_pattern(name: Column) -> Column:
    return _says_copy(stem(name))


def copy_score(path: Column, home: str) -> Column:
    """Two for every component that says copy, else one for a weaker hint; one more below Downloads of home."""
    each = F.transform(parts(path), lambda n: F.when(has_copy_pattern(n), 2).when(n.rlike("(?i)" + WEAK), 1).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) + F.when(is_same_or_inside(path, F.lit(home + "/Downloads")), 1).otherwise(0)


def _separator(c: Column) -> Column:
    return c.isin(" ", "-", "_", ".", "(")


def is_variant_name(name: Column, original: Column) -> Column:
    """Whether name reads as a variation of original: 'Report 2', 'Report-old', 'Old Report', 'file.1'."""
    a, b = stem(name), stem(original)
    after = lambda x, y: F.startswith(x, y) & _separator(F.substring(x, F.char_length(y) + 1, F.lit(1)))
    before = F.endswith(a, b) & _separator(F.substring(a, F.char_length(a) - F.char_length(b), F.lit(1))) & (F.char_length(a) > F.char_length(b))
    return (name != original) & (after(name, original) | ((a != b) & (b != "") & (after(a, b) | before)))


def numbered_base(base: Column) -> Column:
    """'Report 2' to 'Report'; null if the stem does not end in a number of one or two digits."""
    found = F.regexp_extract(base, r"^(.+) (\p{N}{1,2})$", 1)
    return F.when(found != "", found)


def in_same_series(a: Column, b: Column) -> Column:
    return F.coalesce(numbered_base(stem(a)) == numbered_base(stem(b)), F.lit(False))
