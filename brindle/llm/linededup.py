"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A unit is a line's words, lower-cased, however many they are.  A unit goes if an earlier one
(by document id and line) is the same, or is one word edit away (a word changed, added or
left out) where both have `least` words or more: in a shorter line one word is too much of
it.  The steps:

1. Each unit is reduced to hashes; equal units are one from here on, at the earliest.
2. Of two units one edit apart, one half is equal, so units that share no half with another
   need no variants; this only saves work.
3. Each other unit emits all its variants within the bound, itself and itself without one
   word, as hashed keys.  A key is the exclusive or of its words' hashes with their places;
   leaving out a word moves those behind it one place down, so that all keys of a unit come
   from one running exclusive or, at a constant cost each.  Equal keys that leave out the
   same place are one change apart; a key of a whole unit equal to one with a word left out,
   one addition apart.
4. Keys are reduced to the earliest unit of each, which is all that later units need; so a
   key of any number of units makes as many rows, never pairs.
5. Each pair of a unit and an earlier one found so is verified by comparing their words
   before and behind the place of the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

LEAST = 4
#: Bytes (by rows and the numbers they hold) up to which a table of ids and hashes is broadcast; beyond, it is shuffled.
SMALL_BYTES = 32 << 20
#: A line is common if one in so many of all lines is it; so there are at most so many common lines.
COMMON = 50_000
_BLOCK = 32


def _spaced(low: Column) -> Column:
    """One space for each run of white space but line ends."""
    odd = F.contains(low, F.lit("  ")) | F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\r")) | F.contains(low, F.lit("\x0b")) | F.contains(low, F.lit("\x0c"))
    return F.when(odd, F.regexp_replace(low, r"[ \t\r\x0B\f]+", " ")).otherwise(low)


def normal(text: Column) -> Column:
    """Lower-cased, with one space for each run of white space but line ends."""
    return _spaced(F.lower(text))


def _units(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, line, x): the words of each line with a space between, empty for a line without; a null text has one row of nulls."""
    # in steps, so that no step's result is computed again for each use
    low = docs.select("doc_id", *more, F.lower("text").alias("_low"))
    lines = low.select("doc_id", *more, _spaced(F.col("_low")).alias("_norm")).select("doc_id", *more, F.posexplode_outer(F.split("_norm", "\n", -1)).alias("line", "_x"))
    return lines.select("doc_id", *more, "line", F.trim("_x").alias("x"))


def _count(x: Column) -> Column:
    """Words of a unit."""
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1


def _first(x: Column, n: Column) -> Column:
    return F.call_function("substring_index", x, F.lit(" "), n.cast("int"))


def _last(x: Column, n: Column) -> Column:
    return F.call_function("substring_index", x, F.lit(" "), -n.cast("int"))


def _place() -> Column:
    """A unit's place among all, as one number."""
    return (F.col("doc_id").cast("decimal(19,0)") * F.lit("10000000000").cast("decimal(11,0)") + F.col("line").cast("decimal(10,0)")).cast("decimal(38,0)")


def _maybe_small(df: DataFrame, numbers: Column) -> DataFrame:
    """df to be broadcast if its rows, of `numbers` numbers each, have at most SMALL_BYTES."""
    held = df.agg(F.sum(16 + 8 * numbers)).first()[0] or 0
    return F.broadcast(df) if held <= SMALL_BYTES else df


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _every(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v))


def _running_xor(values: Column, then) -> Column:
    """then(the exclusive or of the values before each), in blocks so that long arrays stay cheap."""
    grow = lambda a, v: F.concat(a, F.array(F.element_at(a, -1).bitwiseXOR(v)))
    size = F.greatest(F.lit(_BLOCK), F.ceil(F.sqrt(F.size(values))).cast("int"))

    def cut_up(block: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))

    def scanned(blocks: Column) -> Column:
        before = F.aggregate(F.transform(blocks, _every), F.array(F.lit(0).cast("long")), grow)
        inner = lambda starts: F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda x, t: F.slice(F.aggregate(x, F.array(t), grow), F.lit(1), F.size(x)))
        return then(F.flatten(_let(before, inner)))

    return _let(_let(size, cut_up), scanned)


def variant_keys(x: Column) -> Column:
    """Keys of a unit: that of all words, then that without each word in turn."""

    def of_words(w: Column) -> Column:
        down = F.transform(w, lambda v, i: F.xxhash64(v, i - 1))
        return _let(down, lambda d: _let(F.zip_with(d, F.transform(w, lambda v, i: F.xxhash64(v, i)), lambda a, b: a.bitwiseXOR(b)), lambda m: _let(_every(d), lambda behind: joined(d, m, behind))))

    def joined(d: Column, m: Column, behind: Column) -> Column:
        without = lambda before: F.zip_with(before, d, lambda a, b: a.bitwiseXOR(b).bitwiseXOR(behind))
        return F.concat(F.array(_every(m).bitwiseXOR(behind)), _running_xor(m, without))

    return _let(F.split(x, " ", -1), of_words)


def line_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row a document: doc_id, n_units, n_exact, n_near, gone (array of line and its hash, of each unit that goes, in order).

    Units of fewer than `least` words go only if an earlier one is the same.  Null and
    wordless texts have no units.  Rows that repeat an id are one document, whose lines of
    the same number are at one place, so don't make each other go; rows with a null id are
    one document whose units neither go nor make others go.  Other columns are left aside; an
    empty table gives an empty result.
    """
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x, n = F.col("x"), F.col("n")
    half, half1 = F.floor(n / 2), F.floor((n - 1) / 2)
    counted = _units(wanted.where("doc_id IS NOT NULL AND text IS NOT NULL")).where("x <> ''").withColumn("n", _count(x))
    halves = (F.xxhash64(n, F.lit(0), _first(x, half)), F.xxhash64(n, F.lit(1), _last(x, n - half)), F.xxhash64(n - 1, F.lit(0), _first(x, half1)), F.xxhash64(n - 1, F.lit(1), _last(x, n - 1 - half1)))
    hashed = counted.select(F.xxhash64("x").alias("h"), _place().alias("place"), *[F.when(n >= least, c).alias(f"half{k}") for k, c in enumerate(halves)])
    # 1: equal units, at the earliest
    first = cut(hashed.groupBy("h").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("c"), *[F.min(f"half{k}").alias(f"half{k}") for k in range(4)]))
    # 2: units that share a half with another
    keyed = first.where("half0 IS NOT NULL").select("h", "place", F.explode(F.array(*[f"half{k}" for k in range(4)])).alias("half"))
    shared = keyed.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    chosen = cut(keyed.join(shared, "half", "left_semi").groupBy("h").agg(F.min("place").alias("place")))
    ten = F.lit("10000000000").cast("decimal(11,0)")
    per_doc = chosen.groupBy(F.floor(F.col("place") / ten).cast("long").alias("c_id")).agg(F.collect_set("h").alias("hs"))
    texts = wanted.join(_maybe_small(per_doc, F.size("hs")), F.col("doc_id") == F.col("c_id")).select("doc_id", "text", "hs")
    again = _units(texts, "hs").where("x <> ''").withColumn("h", F.xxhash64("x")).where(F.array_contains("hs", F.col("h"))).select("h", "x", _place().alias("place"))
    # 3: variants; a unit is taken at its own place only
    again = again.join(chosen.select(F.col("h").alias("c_h"), F.col("place").alias("c_place")), (F.col("h") == F.col("c_h")) & (F.col("place") == F.col("c_place")), "left_semi")
    again = again.groupBy("h", "place").agg(F.min("x").alias("x"))
    again = cut(again)
    emitted = cut(again.select("h", "place", F.posexplode(variant_keys(F.col("x"))).alias("i", "key")))
    # 4: the earliest of each
    earliest = emitted.groupBy("key", "i").agg(F.min("place").alias("m"), F.count(F.lit(1)).alias("c"))
    whole, part = F.when(F.col("i") == 0, F.col("m")), F.when(F.col("i") > 0, F.struct("m", "i"))
    per_key = earliest.groupBy("key").agg(F.min(whole).alias("whole"), F.min(part).alias("part"), F.sum("c").alias("c"), F.collect_list(F.struct("i", "m")).alias("all")).where("c > 1")
    bounds = cut(per_key.select(F.col("key").alias("b_key"), "whole", "part", F.explode("all").alias("a")).select("b_key", F.col("a.i").alias("b_i"), F.col("a.m").alias("m"), "whole", "part"))
    # earlier units that a unit may be one edit from, and the place of the edit: of the same place left out, or the whole, or for a whole the earliest part
    found = lambda e, at, kind: F.struct(e.alias("e_place"), at.cast("int").alias("at"), F.lit(kind).alias("kind"))
    b_i = F.col("b_i")
    before = F.when(b_i == 0, F.array(found(F.col("part.m"), F.col("part.i"), 1))).otherwise(F.array(found(F.col("m"), b_i, 0), found(F.col("whole"), b_i, -1)))
    bounds = bounds.select("b_key", "b_i", F.filter(before, lambda e: e["e_place"].isNotNull()).alias("before"))
    pairs = emitted.join(_maybe_small(bounds, 6 + 8 * F.size("before")), (F.col("key") == F.col("b_key")) & (F.col("i") == F.col("b_i")))
    pairs = pairs.select("h", "place", F.explode("before").alias("e")).where("e.e_place < place").groupBy("h", F.col("e.e_place").alias("e_place"), F.col("e.kind").alias("kind")).agg(F.min("e.at").alias("at"))
    # 5: verify
    one, two = again.select("h", "x"), again.select(F.col("place").alias("p_place"), F.col("x").alias("e_x"))
    both = pairs.join(one, "h").join(two, F.col("e_place") == F.col("p_place"))
    near = both.where(one_edit(F.col("x"), F.col("e_x"), F.col("at"), F.col("kind"))).select(F.col("h").alias("n_h")).distinct()
    # what goes
    judged = cut(first.join(near, F.col("h") == F.col("n_h"), "left").select(F.col("h").alias("f_h"), F.col("place").alias("f_place"), "c", F.col("n_h").isNotNull().alias("near")))
    # common lines are few, and are looked up apart, so that no task gets all rows of one
    total = judged.agg(F.sum("c")).first()[0] or 0
    common = judged.where(F.col("c") > max(100, total // COMMON)).select(F.col("f_h").alias("o_h"), F.col("f_place").alias("o_place"), F.col("near").alias("o_near"))
    rows = _units(wanted).select("doc_id", "line", F.when(F.col("x") != "", F.xxhash64("x")).alias("h"), F.when(F.col("doc_id").isNotNull(), _place()).alias("place"))
    rows = rows.join(F.broadcast(common), F.col("h") == F.col("o_h"), "left")
    rows = rows.withColumn("r_h", F.when(F.col("o_h").isNull(), F.col("h")))
    rows = rows.join(judged.where(F.col("c") <= max(100, total // COMMON)), F.col("r_h") == F.col("f_h"), "left")
    own_first, own_near = F.coalesce("f_place", "o_place"), F.coalesce("near", "o_near")
    exact = F.coalesce(F.col("place") != own_first, F.lit(False))
    close = F.coalesce(own_near & F.col("place").isNotNull(), F.lit(False)) & ~exact
    gone = F.when(exact | close, F.struct("line", "h"))
    return rows.groupBy("doc_id").agg(F.count("h").alias("n_units"), F.count_if(exact).alias("n_exact"), F.count_if(close).alias("n_near"), F.array_sort(F.collect_set(gone)).alias("gone"))


def one_edit(a: Column, b: Column, at: Column, kind: Column) -> Column:
    """Whether units are equal but for one word: kind 0: the word at `at` changed; 1: b has a word more there; -1: a has."""
    n, m = _count(a), _count(b)
    around = lambda k: (_first(a, at - 1) == _first(b, at - 1)) & (_last(a, k - at) == _last(b, k - at))
    return F.when(kind == 0, (n == m) & around(n)).when(kind == 1, (m == n + 1) & around(m)).otherwise((n == m + 1) & around(n))


def dropped(gone: Column) -> Column:
    """The numbers of the lines that go, comma-joined."""
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(gone, lambda g: g["line"]))).cast("array<string>"))


def drop_lines(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the units of line_drops taken out of their texts, each with its line end.

    A line goes if its number and its words are listed for its id, so rows that repeat an id
    lose only what was found in them; rows of null id, and null texts, stay as they are.
    """
    listed = drops.where(F.size("gone") > 0).select(F.col("doc_id").alias("_drop_id"), F.col("gone").alias("_gone"))
    joined = docs.join(listed, F.col(id_col).cast("long") == F.col("_drop_id"), "left")
    lines, words = F.split(F.col(text_col), "\n", -1), F.split(normal(F.col(text_col)), "\n", -1)
    kept = F.zip_with(F.transform(lines, lambda x, j: F.struct(x.alias("x"), j.alias("line"))), words, lambda l, w: F.when(~F.array_contains("_gone", F.struct(l["line"].alias("line"), F.xxhash64(F.trim(w)).alias("h"))), l["x"]))
    text = F.array_join(F.array_compact(kept), "\n")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(text)).drop("_drop_id", "_gone")
