"""String, hash and configuration functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as trimming understands it.
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Fixed value: characters that a normalized key leaves out.
KEY_DROPS = " -_.!☆・‘’'ー—"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+\\z", "")


def truncate(c: Column, n: int) -> Column:
    """The first n characters and ... if there are more."""
    if n < 0:
        raise ValueError("n must not be negative")
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def truncate_bytes(c: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that cuts no character."""
    cut = F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string"))
    # a cut character decodes to replacement marks; the prefix has one character fewer
    return F.when(F.octet_length(c) <= n, c).when(F.startswith(c, cut), cut).otherwise(F.left(c, F.length(F.regexp_replace(cut, "\\x{FFFD}{1,3}\\z", ""))))


def normalized(c: Column) -> Column:
    return F.lower(trimmed(c))


def normalized_key(c: Column) -> Column:
    return F.translate(normalized(c), KEY_DROPS, "")


def short_hash(c: Column) -> Column:
    """The first half of sha256's hex digits."""
    return F.substring(F.sha2(c, 256), 1, 32)


def log_hash(c: Column) -> Column:
    """short_hash of the text with single spaces; empty for a blank one."""
    flat = F.regexp_replace(trimmed(c), f"{_WS}+", " ")
    return F.when(flat == "", "").otherwise(short_hash(flat))


def rate_key_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def id_prefix(c: Column) -> Column:
    """Lower-case letters, digits and single-character separators as _, trimmed of _; id if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(normalized(c), "[-.]", "_"), "[^a-z0-9_]", "")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+\\z", ""), F.lit("")), F.lit("id"))


def parse_bool(c: Column) -> Column:
    """Fixed spellings of true and false; null for others."""
    low = F.lower(c)
    return F.when(low.isin("1", "true", "yes", "y", "on"), True).when(low.isin("0", "false", "no", "n", "off"), False)


def parse_list(c: Column) -> Column:
    """Items between commas and white space, each once, in order."""
    return F.array_distinct(F.filter(F.split(c, "[,\\n\\r\\t ]+"), lambda x: x != ""))


def parse_map(c: Column) -> Column:
    """key:value or key=value items; null if an item has no key or a key repeats."""
    items = F.filter(F.transform(F.split(c, "[,\\n\\r\\t]+"), lambda x: trimmed(x)), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(trimmed(F.regexp_extract(x, r"^([^:=]*)[:=](?s:(.*))\z", 1)).alias("k"), trimmed(F.regexp_extract(x, r"^([^:=]*)[:=](?s:(.*))\z", 2)).alias("v")))
    good = F.forall(pairs, lambda p: p["k"] != "") & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["k"]))) == F.size(pairs))
    return F.when(good, F.map_from_entries(pairs))
