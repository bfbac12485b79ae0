"""N-gram Jaccard join: which documents' shingle sets are alike, exactly, without comparing all.

1. A document's set holds the hashes of its distinct n-word shingles.  Equal sets are one
   class from here on.
2. Sizes are banded.  Two sets within a band's reach that are alike differ in at most k
   elements, k known from the band.  Splitting all elements by hash into more than k parts
   leaves a part in which they don't differ at all (of large sets, into fewer parts several
   times; see scheme()); so documents that share no part of equal content need not be
   compared.  Shingles known to be common are left out of the parts where enough others are
   left.  Of parts that few sets share, each pair of these is held against hashed bitmaps of
   both sets first, and goes if they can't be alike: in a large table chance links would
   connect most documents.  Other sets that share a part are linked provisionally, and
   connected provisional links give groups.
3. A group is compared in tiles of bounded size.  In a tile, members are in order of size;
   each meets only members whose size can reach the threshold and that aren't in its class
   yet.  A hashed bitmap of each set bounds the overlap from above by bit counts; pairs
   that pass are intersected exactly as sorted arrays.
4. Groups larger than a tile are compared tile by tile, first in their own tiles; then the
   classes that are left, all but the group's largest, meet all other members of the group,
   again in tiles.  When a group is one class nothing is left to compare.

Links between different classes are never dropped: a pair is left out only if bounds prove
it can't reach the threshold, or if its members are in one class already.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .words import SPACED, blocks, grouped, hashed_words, mix

WORDS, SHARE = 4, 0.85
#: Parts that two alike sets of a large band are expected to agree on.
MEET = 40
#: Words of a bitmap, 64 bits each.
MAP = 8
#: Sets that share a part, up to which all pairs of them are held against bitmaps: of parts of one element, and of others.
FEW_ONE, FEW = 16, 2
#: Bits of a signature: its part has one element; it stands for more sets than the one it is with.
ONE, MANY = np.uint64(1), np.uint64(2)
#: Bytes of text of a tile, about.
TILE_BYTES = 8 << 20
#: Most shingles that count as common.
MOST_COMMON = 1_000_000
#: Shingles that are counted at once, at 8 bytes each.
CHUNK = 4 << 20


def shingles(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    if len(h) == 0:
        return h
    size = min(n, len(h))
    g = mix(h[: len(h) - size + 1], size)
    for k in range(1, size):
        g = mix(g ^ h[k : len(h) - size + 1 + k], k)
    g.sort()
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def batch_shingles(column, n: int = WORDS) -> list[np.ndarray]:
    """Shingle sets of all texts of a column."""
    h, begin = hashed_words(column, SPACED)
    return [shingles(h[a:b], n) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def set_hash(s: np.ndarray) -> int:
    """A set's 64-bit hash, signed; 0 for the empty set."""
    if len(s) == 0:
        return 0
    both = int(np.bitwise_xor.reduce(mix(s, 11))) ^ (int(np.sum(mix(s, 12))) * 0x9E3779B97F4A7C15 + len(s))
    return int(mix(np.array([both & (2**64 - 1)], np.uint64)).astype(np.int64)[0])


def least_overlap(a: int, b: int, share: float = SHARE) -> int:
    """Fewest common elements with which sets of a and b elements are alike."""
    num, den = _fraction(share)
    return -(-(a + b) * num // (num + den))


def _fraction(share: float) -> tuple[int, int]:
    return round(share * 10000), 10000


def most_apart(size: int, share: float = SHARE) -> int:
    """Most elements in which a set of up to `size` elements and a larger one, alike, can differ."""
    num, den = _fraction(share)
    return (size + size * den // num) * (den - num) // (den + num)


def band(size: int, share: float = SHARE) -> int:
    """The number of a size's band; a set and a smaller one, alike, are of the same band or of neighbours."""
    ratio = 1.02 / share
    i = int(math.log(size) / math.log(ratio) + 1e-9)
    while ratio ** (i + 1) <= size:
        i += 1
    while ratio**i > size:
        i -= 1
    return i


def _top(i: int, share: float) -> int:
    """The largest size of band i."""
    return math.ceil((1.02 / share) ** (i + 1)) - 1


@dataclass(frozen=True)
class Scheme:
    """How a band's sets are split: `rounds` times into `parts`, of which those of fewer than `least` elements aren't sent unless `spare` or more would be left out."""

    parts: int
    rounds: int
    least: int
    spare: int


@functools.cache
def scheme(i: int, share: float) -> Scheme:
    """The scheme of band i.

    Two alike sets of a small band differ in fewer elements than there are parts, and agree on
    `spare` at least.  In a large band parts are fewer and larger, so that sets that share
    some elements share no part, and elements are split several times: of all parts two alike
    sets are expected to agree on MEET, of the sent ones on three quarters of that or more.
    As elements are spread by their hashes, that none agrees has a chance below exp(-0.75 * MEET),
    less than that of two hashes being equal.
    """
    top, apart = _top(i, share), most_apart(_top(i, share), share)
    spare = 3 + apart // 8
    exact = Scheme(apart + spare, 1, 1, spare)
    sent = top // 3
    mean = top / max(apart, 1) * math.log(sent / MEET) if sent > MEET else 0.0
    if mean < 1.4 * top / exact.parts:
        return exact
    parts = int(top / mean)
    rounds = -(-sent // parts)
    return Scheme(parts, rounds, 2 if mean < 8 else 3, parts * rounds // 4)


def _parts(s: np.ndarray, i: int, share: float, name: int) -> tuple[np.ndarray, bool]:
    """Signatures of the parts of elements s in band i's scheme that are large enough (of all, if too many aren't), and whether few enough are left out."""
    how = scheme(i, share)
    part = np.empty((how.rounds, len(s)), np.int64)
    for k in range(how.rounds):
        at = (mix(s, 100 + i + 10_000 * k) >> np.uint64(11)).astype(np.float64) * (how.parts / 2.0**53)
        part[k] = np.minimum(at.astype(np.int64), how.parts - 1) + k * how.parts
    every = how.parts * how.rounds
    many = np.bincount(part.ravel(), minlength=every)
    # the parts' contents: sums, modulo 2**64, of their elements' hashes
    order = np.argsort(part.ravel(), kind="stable")
    total = np.concatenate(([np.uint64(0)], np.cumsum(np.tile(mix(s, 21), how.rounds)[order], dtype=np.uint64)))
    ends = np.cumsum(many)
    content = total[ends] - total[ends - many]
    full = np.flatnonzero(many >= how.least)
    few = every - len(full) < how.spare
    sent = full if few or not name else np.arange(every)
    sig = mix(content[sent] ^ mix((many[sent].astype(np.uint64) << np.uint64(32)) | sent.astype(np.uint64), 2 * (200 + i) + name), 22)
    return sig & ~(ONE | MANY) | (many[sent] == 1).astype(np.uint64), few


def signatures(s: np.ndarray, common: np.ndarray, share: float = SHARE) -> np.ndarray:
    """Hashes of a set's parts, in the scheme of its own band and in that of the band below if a member of that can reach it.

    The parts are of its elements that aren't in `common`: alike sets differ in no more of
    these than of all, and parts of common elements only would meet many sets that aren't
    alike.  Where too many of these parts are too small to be sent, parts of all elements are
    sent too.
    """
    size = len(s)
    if most_apart(size, share) == 0:
        return np.zeros(0, np.uint64)
    own = band(size, share)
    num, den = _fraction(share)
    schemes = [own]
    if own > 0 and _top(own - 1, share) * den >= size * num:
        schemes.append(own - 1)
    rare = s
    if len(common):
        at = np.searchsorted(common, s)
        at[at == len(common)] = 0
        rare = s[common[at] != s]
    out = []
    for i in schemes:
        sent, few = _parts(rare, i, share, 0)
        out.append(sent)
        if not few:
            out.append(_parts(s, i, share, 1)[0])
    return np.concatenate(out)


def common_shingles(docs: DataFrame, words: int, counted: tuple[int, int] | None = None) -> np.ndarray:
    """Shingles that one document in a thousand has, or eight, or a MOST_COMMON-th of all shingles, whichever is more; sorted, counted over all documents.

    counted: the number of documents with shingles, and of their shingles in all.  Chunks of
    documents leave out shingles that they hold too seldom to matter: of a common one, at
    most half of its documents over all chunks, by their lengths, and a quarter over the last
    chunks of all tasks, in equal parts.  Those that may be common yet are then counted in
    every document.
    """
    rows, total = counted or _counted(docs, words)
    least = max(8, rows // 1000, total // MOST_COMMON)
    if total == 0:
        return np.zeros(0, np.uint64)

    tasks = max(1, total // CHUNK)  # or fewer; smaller chunks leave out less
    few = docs.coalesce(tasks)

    def often(sets, more=0):
        h = np.concatenate(sets)
        h.sort()
        most = len(h) * least // (2 * total) + more
        many = h[most:]
        many = np.unique(many[many == h[: len(many)]])
        n = np.searchsorted(h, many, side="right") - np.searchsorted(h, many)
        return pa.RecordBatch.from_arrays([pa.array(many.view(np.int64)), pa.array(n)], names=["h", "n"])

    def chunks(batches):
        # a full chunk waits for the next: what is left at a task's end, alone, would be too little to leave anything out
        full, held, size = [], [], 0
        for batch in blocks(batches, "text"):
            sets = [s for s in batch_shingles(batch.column(1), words) if len(s)]
            held, size = held + sets, size + sum(map(len, sets))
            if size >= CHUNK:
                if full:
                    yield often(full)
                full, held, size = held, [], 0
        if full or held:
            yield often(full + held, least // (4 * tasks))

    found = few.mapInArrow(chunks, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(4 * F.col("n") >= least).select("h").toArrow()
    maybe = np.sort(found.column("h").to_numpy().astype(np.int64).view(np.uint64))
    if len(maybe) == 0:
        return maybe
    sent = docs.sparkSession.sparkContext.broadcast(maybe)

    def count(batches):
        known = sent.value
        n = np.zeros(len(known), np.int64)
        for batch in blocks(batches, "text"):
            h = np.concatenate(batch_shingles(batch.column(1), words))
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            n += np.bincount(at[known[at] == h], minlength=len(known))
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(known[has].view(np.int64)), pa.array(n[has])], names=["h", "n"])

    exact = docs.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").toArrow()
    sent.unpersist()
    return np.sort(exact.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _counted(docs: DataFrame, words: int) -> tuple[int, int]:
    """The number of documents with shingles, and of their shingles."""

    def run(batches):
        for batch in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in batch_shingles(batch.column(1), words)], pa.int64())], names=["n"])

    got = docs.mapInArrow(run, "n bigint").where("n > 0").agg(F.count("n"), F.sum("n")).first()
    return got[0], got[1] or 0


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(MAP * 64, np.uint8)
    bits[(mix(s, 31) >> np.uint64(40)).astype(np.int64) % (MAP * 64)] = 1
    return np.packbits(bits).view(np.uint64)


def whole_map(s: np.ndarray) -> bytes:
    """A bitmap of two to four bits an element, one word at least."""
    n = 64
    while n < 2 * len(s):
        n *= 2
    bits = np.zeros(n, np.uint8)
    bits[(mix(s, 32) & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(n_a: int, map_a: bytes, n_b: int, map_b: bytes, share: float = SHARE) -> bool:
    """Whether sets of these sizes and whole_map()s can be alike; never False if they are."""
    num, den = _fraction(share)
    if min(n_a, n_b) * den < max(n_a, n_b) * num:
        return False
    a, b = np.frombuffer(map_a, np.uint64), np.frombuffer(map_b, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    both = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return both >= least_overlap(n_a, n_b, share)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


class Classes:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def compare(sets: list[np.ndarray], classes: list, side: list[bool] | None = None, share: float = SHARE) -> Classes:
    """Links among sets; those of the same value in `classes` start as one.  side: compare only pairs of which at least one is True."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    found = Classes(n)
    first: dict = {}
    for k, c in enumerate(classes):
        found.join(first.setdefault(c, k), k)
    root = np.array([found.root(k) for k in range(n)])
    maps = np.stack([bitmap(s) for s in sets]) if n else np.zeros((0, MAP), np.uint64)
    ordered, place = size[order], np.empty(n, np.int64)
    place[order] = np.arange(n)
    num, den = _fraction(share)
    for x in order if side is None else order[np.array(side, bool)[order]]:
        # all that ask meet those before them in order; if only some ask, they meet all
        low = np.searchsorted(ordered, -(-size[x] * num // den))
        high = place[x] if side is None else np.searchsorted(ordered, size[x] * den // num, side="right")
        near = order[low:high]
        near = near[root[near] != root[x]]
        if len(near) == 0:
            continue
        need = -(-(size[near] + size[x]) * num // (num + den))
        both = np.minimum(size[near] - np.bitwise_count(maps[near] & ~maps[x]).sum(axis=1), size[x] - np.bitwise_count(maps[x] & ~maps[near]).sum(axis=1))
        near, need = near[both >= need], need[both >= need]
        while len(near):
            y, least = int(near[-1]), int(need[-1])
            if overlap(sets[x], sets[y]) >= least:
                found.join(int(x), y)
                root[root == max(root[x], root[y])] = min(root[x], root[y])
                apart = root[near] != root[x]
                near, need = near[apart], need[apart]
            else:
                near, need = near[:-1], need[:-1]
    return found


# ---- Spark


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of (a, b) rows: root is the least node of a node's connected component.

    Alternates large and small stars; each round is kept in the shared folder, and the
    result is whole when a round changes nothing.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y").distinct()
    now, before = cut(both), None
    for _ in range(rounds):
        sides = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = sides.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = sides.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        down = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct()
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").union(least.select("x", F.col("m").alias("y")))
        now = cut(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    return now.groupBy("x").agg(F.min("y").alias("root")).select(F.col("x").alias("node"), "root")


def _meet(sig: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (signature, set): those whose signature no other set has, and one of each signature that many have; pairs (set of that one, other set) of the latter; and all pairs of sets that share other signatures.

    In the rows, MANY is set where a row stands for many.
    """
    key = sig & ~MANY
    order, begin = grouped(key)
    count = np.diff(np.append(begin, len(key)))
    alone = order[begin[count == 1]]
    order = order[np.repeat(count > 1, count)]
    order = order[np.lexsort((sig[order], own[order], key[order]))]
    key, mine, many = key[order], own[order], sig[order] & MANY > 0
    # equal sets of several tasks are one here
    first = np.concatenate(([True], (key[1:] != key[:-1]) | (mine[1:] != mine[:-1]))) if len(key) else np.zeros(0, bool)
    many = np.logical_or.reduceat(many, np.flatnonzero(first)) if len(key) else many
    order, key, mine = order[first], key[first], mine[first]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(key)))
    firm = count > np.where(key[begin] & ONE > 0, FEW_ONE, FEW)
    if len(begin):
        firm |= np.logical_or.reduceat(many, begin) & (count > 1)
    rest = np.repeat(firm, count)
    stars = np.stack([np.repeat(mine[begin], count)[rest], mine[rest]], axis=1)
    stars = np.unique(stars[stars[:, 0] != stars[:, 1]], axis=0)
    loose, number = mine[~rest], np.repeat(np.arange(len(begin)), count)[~rest]
    pairs = [np.zeros((0, 2), np.int64)]
    for k in range(1, max(FEW_ONE, FEW)):
        same = number[k:] == number[:-k]
        pairs.append(np.stack([loose[:-k][same], loose[k:][same]], axis=1))
    return np.concatenate((alone, order[~rest])), order[begin[firm]], stars, np.unique(np.concatenate(pairs), axis=0)


def _edges_of(batches):
    """Provisional links of a bucket's rows (signatures with their sets, and pairs linked before): firm ones, for each set one to the least of its connected sets here, and pairs that are yet to be held against bitmaps."""
    sig, own, links, pairs = [], [], [], None
    for batch in batches:
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if a:
                sig.append(np.frombuffer(a, np.uint64))
                own.append(np.frombuffer(b, np.int64))
            else:
                links.append(np.frombuffer(b, np.int64).reshape(-1, 2))
    if sig:
        _, _, stars, pairs = _meet(np.concatenate(sig), np.concatenate(own))
        links.append(stars)
        del sig, own
    if links and sum(map(len, links)):
        nodes, flat = np.unique(np.concatenate(links).ravel(), return_inverse=True)
        found = Classes(len(nodes))
        for a, b in flat.reshape(-1, 2).tolist():
            found.join(a, b)
        root = np.array([found.root(k) for k in range(len(nodes))])
        keep = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]]), pa.array(np.ones(keep.sum(), bool))], names=["a", "b", "firm"])
    if pairs is not None and len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.zeros(len(pairs), bool))], names=["a", "b", "firm"])


def _held(share: float):
    """Pairs of rows (a, b, n_a, map_a, n_b, map_b) whose sets can be alike."""

    def run(batches):
        for batch in batches:
            a, b, *rest = (c.to_pylist() for c in batch.columns)
            keep = pa.array([may_be_alike(*x, share) for x in zip(*rest)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _tiles(share: float, words: int):
    """Links in a tile: rows (group, tile, sid, class, asks, text) in order of group and tile; texts may be null for none."""

    def flush(rows: list[tuple]):
        sets = batch_shingles(pa.array([r[5] for r in rows], pa.string()), words)
        fits = [set_hash(s) == r[2] for s, r in zip(sets, rows)]  # rows of an id may differ in text
        sets, rows = [s for s, ok in zip(sets, fits) if ok], [r for r, ok in zip(rows, fits) if ok]
        side = [r[4] for r in rows]
        found = compare(sets, [r[3] for r in rows], None if all(side) else side, share)
        first: dict = {}
        for k, r in enumerate(rows):
            first.setdefault(found.root(k), r[3])
        pairs = sorted({(r[3], first[found.root(k)]) for k, r in enumerate(rows) if r[3] != first[found.root(k)]})
        if pairs:
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][:2] != row[:2]:
                    yield from flush(held)
                    held = []
                held.append(row)
        if held:
            yield from flush(held)

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: float = SHARE, tile_bytes: int = TILE_BYTES, buckets: int | None = None, with_hash: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included), then text_hash (xxhash64 of the text) and class_hash (of the component) if with_hash, which tell rows of one id apart.

    Two documents link if their sets of distinct `words`-word shingles of lower-cased words
    have an intersection of at least `share` of their union.  A text of fewer words is one
    shingle; null or wordless text has the empty set, links with nothing and is its own
    component.  Repeated rows and equal sets are one class, at the least id; rows with a null
    id keep it null and are left out of comparing.  Other columns are left aside; an empty
    table gives an empty result.
    """
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = buckets or max(24, int(spark.conf.get("spark.sql.shuffle.partitions")), min(size >> 24, 1 << 20))

    def measure(batches):
        for batch in blocks(batches, "text"):
            sets = batch_shingles(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([whole_map(s) for s in sets], pa.binary())], names=["doc_id", "text_hash", "n", "sid", "map"])

    measured = cut(wanted.mapInArrow(measure, "doc_id bigint, text_hash bigint, n bigint, sid bigint, map binary"))
    counted = measured.where("n > 0").agg(F.count("n"), F.sum("n")).first()
    common = spark.sparkContext.broadcast(common_shingles(wanted, words, (counted[0], counted[1] or 0)))

    def sign(batches):
        seen: set[int] = set()  # equal sets of this task send their parts once
        for batch in blocks(batches, "text"):
            sig, own = [], []
            for s in batch_shingles(batch.column(1), words):
                if len(s) and (name := set_hash(s)) not in seen:
                    seen.add(name)
                    sig.append(signatures(s, common.value, share))
                    own.append(np.full(len(sig[-1]), name, np.int64))
            if not sig:
                continue
            sig, own = np.concatenate(sig), np.concatenate(own)
            # of a signature that many sets here have, one stands for all: a bucket gets it once a block, however common it is
            some, one, pairs, _ = _meet(sig, own)
            sig, own = np.concatenate((sig[some], sig[one] | MANY)), own[np.concatenate((some, one))]
            at = (sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = np.flatnonzero(np.diff(edges)).tolist()
            sent = [[x[order[edges[b] : edges[b + 1]]].tobytes() for b in rows] for x in (sig, own)]
            if len(pairs):
                rows.append(int(pairs[0, 0] % buckets))
                sent[0].append(b"")
                sent[1].append(np.ascontiguousarray(pairs).tobytes())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(x, pa.binary()) for x in sent]], names=["bucket", "sig", "own"])

    parts = wanted.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(sign, "bucket int, sig binary, own binary")
    provisional = cut(parts.repartitionById(buckets, "bucket").mapInArrow(_edges_of, "a bigint, b bigint, firm boolean"))
    loose = provisional.where("NOT firm").select("a", "b").distinct()
    asked_for = loose.select(F.col("a").alias("sid")).union(loose.select("b")).distinct()
    maps = measured.where("doc_id IS NOT NULL AND n > 0").join(asked_for, "sid", "left_semi").groupBy("sid").agg(F.min("n").alias("n"), F.min("map").alias("map"))
    for side in "ab":
        loose = loose.join(maps.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("map").alias(f"map_{side}")), side)
    loose = cut(loose.select("a", "b", "n_a", "map_a", "n_b", "map_b").mapInArrow(_held(share), "a bigint, b bigint"))
    provisional = provisional.where("firm").select("a", "b").union(loose)
    # groups and their tiles
    grouped = components(provisional).select(F.col("node").alias("sid"), F.col("root").alias("grp"))
    grouped = grouped.union(grouped.select(F.col("grp").alias("sid"), "grp")).distinct()
    holders = measured.where("doc_id IS NOT NULL AND n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    members = cut(holders.join(grouped, "sid").select("sid", "doc_id", "n", "grp"))
    # 8 bytes of text to a shingle, about
    per_group = members.groupBy("grp").agg(F.sum("n").alias("total")).select("grp", F.ceil(F.col("total") * 8 / tile_bytes).alias("tiles"))
    members = members.join(per_group, "grp").withColumn("tile", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("sid"), F.col("tiles"))).otherwise(F.lit(0)))
    # texts of members: equal docs need one text only
    n_members = members.count()
    narrow = members.select("sid", F.col("doc_id").alias("m_id"), "grp", "tile", "tiles")
    if n_members <= 1_000_000:  # 40 MB at most
        narrow = F.broadcast(narrow)
    chosen = wanted.join(narrow, wanted["doc_id"] == F.col("m_id")).select("grp", "tile", "tiles", "sid", "text")

    def linked(tiles: DataFrame) -> DataFrame:
        rows = tiles.select("grp", "tile", "sid", "class", "asks", "text")
        return rows.repartition("grp", "tile").sortWithinPartitions("grp", "tile", "sid").mapInArrow(_tiles(share, words), "a bigint, b bigint")

    links = cut(linked(chosen.select("*", F.col("sid").alias("class"), F.lit(True).alias("asks"))))
    large = members.where("tiles > 1")
    if not large.isEmpty():
        rooted = components(links)
        classed = large.join(rooted, large["sid"] == rooted["node"], "left").select(large["sid"], "grp", "n", F.coalesce("root", "sid").alias("class"))
        per_class = classed.groupBy("grp", "class").agg(F.sum("n").alias("c"))
        rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("c"), "class"))
        per_class = cut(per_class.withColumn("r", rank))
        open_groups = per_class.where("r > 1").select("grp").distinct()
        minor = classed.join(per_class.where("r > 1").select("grp", "class"), ["grp", "class"], "left_semi").select("sid", "class", "grp", "n")
        # the members outside the largest class, in tiles, meet all members of the group, in tiles
        asked = minor.join(minor.groupBy("grp").agg(F.sum("n").alias("total")), "grp").withColumn("at", F.pmod(F.xxhash64("sid"), F.ceil(F.col("total") * 16 / tile_bytes)))
        slots = asked.select("grp", "at").distinct()
        every = classed.join(open_groups, "grp", "left_semi").join(per_group, "grp").withColumn("to", F.pmod(F.xxhash64("sid"), 2 * F.col("tiles")))
        spots = every.select("grp", "to").distinct()
        tile = F.xxhash64("at", "to").alias("tile")
        asks = asked.join(spots, "grp").select("grp", tile, "sid", "class", F.lit(True).alias("asks"))
        told = every.join(slots, "grp").select("grp", tile, "sid", "class", F.lit(False).alias("asks"))
        pairs = asks.union(told).groupBy("grp", "tile", "sid", "class").agg(F.max("asks").alias("asks"))
        texts = chosen.select(F.col("sid").alias("t_sid"), "text")
        again = pairs.join(texts, pairs["sid"] == F.col("t_sid")).select("grp", "tile", "sid", "class", "asks", "text")
        more = cut(linked(again))
        links = cut(links.union(more))
    roots = components(links)
    known = measured.join(roots, measured["sid"] == roots["node"], "left").select("doc_id", "text_hash", "n", "sid", F.coalesce("root", "sid").alias("root"))
    per_root = known.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "r_root")
    out = known.join(per_root, (known["root"] == per_root["r_root"]) & (known["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), *(["text_hash", F.col("root").alias("class_hash")] if with_hash else []))
