"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by documents and kept in the shared folder: each row is a shard
(some megabytes of whole documents) with its distinct terms, and for each the sorted
positions at which the shard's tokens hold it.  All test items visit every shard, in blocks
of bounded size, without the texts.

Phrases: from the list of its rarest term in the shard, shifted by its offset in the phrase,
a phrase intersects the next rarest, until all terms are through; what is left are the exact
occurrences.

Proximity: an item is near where enough of its distinct terms stand within a span a little
longer than itself, in any order.  If so many may be missing, some of any larger number of
terms must be there; so only places with several of its rarest terms together are looked at.
A shard holds whole documents, so no posting leaves its task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .words import ALNUM, blocks, grouped, hashed_words

WINDOW = 13
#: Bytes of test text in a block: what the driver and each task hold of the test items at a time.
BLOCK_BYTES = 16 << 20
#: Bytes of text of a shard, about.
SHARD_BYTES = 4 << 20
#: An item is near where this share of its distinct terms stands within its words and a quarter more; items of fewer distinct terms than LEAST_TERMS never are.
NEAR_SHARE, LEAST_TERMS = 0.8, 8
#: How many of an item's rarest terms must be together for a place to be looked at.
TOGETHER = 4
_POSITION = np.uint64(36)  # bits of a position in a shard


@dataclass
class Phrases:
    """Distinct phrases and items' terms, as term numbers, and the items each belongs to."""

    terms: np.ndarray  # distinct term hashes, sorted
    words: np.ndarray  # phrases x WINDOW: term numbers, -1 beyond a phrase's end
    size: np.ndarray
    item_begin: np.ndarray  # of each phrase in item_of
    item_of: np.ndarray
    names: list[str]
    own_begin: np.ndarray  # of each item in own: its distinct terms
    own: np.ndarray
    length: np.ndarray  # words of each item


def phrases(column, names: list[str], window: int = WINDOW) -> Phrases:
    """All windows of the items' words; an item of fewer words is one window."""
    h, begin = hashed_words(column, ALNUM)
    terms, numbers = np.unique(h, return_inverse=True)
    size = np.diff(begin)
    # a window at each place of a long item, one of a short item
    many = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
    owner = np.repeat(np.arange(len(size)), many)
    start = np.repeat(begin[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = start[:, None] + np.arange(window)
    words = np.where(at < begin[1:][owner][:, None], np.append(numbers, 0)[np.minimum(at, len(numbers))], -1).astype(np.int64)
    words, of = np.unique(words, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([of.ravel(), owner], axis=1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
    item = np.repeat(np.arange(len(size)), size)
    own = np.unique(np.stack([item, numbers.ravel()], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    return Phrases(terms, words, (words >= 0).sum(axis=1), np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1], names, np.searchsorted(own[:, 0], np.arange(len(size) + 1)), own[:, 1], size)


def postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a shard's tokens in order, where each one's list begins (one more than terms), and the lists of sorted positions end to end."""
    order, begin = grouped(h)
    return h[order[begin]], np.append(begin, len(h)).astype(np.int64), order.astype(np.uint32)


class Shard:
    """The part of a shard's index that a block of test items asks for."""

    def __init__(self, known: np.ndarray, lists: np.ndarray, positions: np.ndarray, begin: np.ndarray, terms: np.ndarray):
        self.begin = begin
        at = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
        there = np.flatnonzero(known[at] == terms) if len(known) else np.zeros(0, np.int64)
        first, many = lists[at[there]], np.diff(lists)[at[there]]
        where = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        #: term number and position in one value, sorted: the lists, one after the other
        self.postings = (np.repeat(there, many).astype(np.uint64) << _POSITION) | positions[where].astype(np.uint64)
        self.lists = np.searchsorted(self.postings, np.arange(len(terms) + 1, dtype=np.uint64) << _POSITION)

    def counts(self) -> np.ndarray:
        return np.diff(self.lists)

    def positions(self, term: int) -> np.ndarray:
        """The sorted positions of a term."""
        return (self.postings[self.lists[term] : self.lists[term + 1]] & np.uint64((1 << int(_POSITION)) - 1)).astype(np.int64)

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, side="right") - 1

    def occurrences(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all exact occurrences of phrases, rarest terms first."""
        none = np.zeros(0, np.int64)
        if len(words) == 0 or len(self.postings) == 0:
            return none, none
        many = np.append(self.counts(), np.iinfo(np.int64).max)[words]  # -1: beyond the end
        live = np.flatnonzero(many.min(axis=1) > 0)
        rank = np.argsort(many[live], axis=1, kind="stable")
        first = rank[:, 0]
        lead = words[live, first]
        times = many[live, first]
        which = np.repeat(np.arange(len(live)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        start = (self.postings[self.lists[lead][which] + nth] & np.uint64((1 << int(_POSITION)) - 1)).astype(np.int64) - first[which]
        ok = start >= 0
        which, start = which[ok], start[ok]
        for step in range(1, words.shape[1]):
            go = size[live][which] > step
            if not go.any():
                break
            offset = rank[which, step]
            key = (np.maximum(words[live][which, offset], 0).astype(np.uint64) << _POSITION) | (start + offset).astype(np.uint64)
            at = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
            ok = ~go | (self.postings[at] == key)
            which, start = which[ok], start[ok]
        ok = self.row_of(start) == self.row_of(start + size[live][which] - 1)  # within one document
        return live[which[ok]], start[ok]

    def near(self, own_begin: np.ndarray, own: np.ndarray, length: np.ndarray, share: float = NEAR_SHARE, least: int = LEAST_TERMS) -> list[tuple[int, int]]:
        """(row, item) where `share` of an item's distinct terms stand within its words and a quarter more; items of fewer than `least` terms never are."""
        distinct = np.diff(own_begin)
        need = np.ceil(share * distinct - 1e-9).astype(np.int64)
        asked = np.flatnonzero((distinct >= max(least, 1)) & (need > 0))
        if len(asked) == 0 or len(self.postings) == 0:
            return []
        together = np.minimum(need, TOGETHER)
        many = self.counts()
        # the rarest terms of each item: as many as may be missing, and those that must be together
        item = np.repeat(np.arange(len(distinct)), distinct)
        order = np.lexsort((own, many[own], item))
        rank = np.arange(len(own)) - np.repeat(own_begin[:-1], distinct)
        lead = order[(rank < np.repeat(distinct - need + together, distinct)) & np.isin(item, asked)[order]]
        times = many[own[lead]]
        which = np.repeat(item[lead], times)
        at = np.repeat(self.lists[own[lead]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        key = np.sort((which.astype(np.uint64) << _POSITION) | (self.postings[at] & np.uint64((1 << int(_POSITION)) - 1)))
        which, place = (key >> _POSITION).astype(np.int64), (key & np.uint64((1 << int(_POSITION)) - 1)).astype(np.int64)
        span = length + length // 4
        last = np.arange(len(key)) + together[which] - 1
        full = np.flatnonzero(last < len(key))
        full = full[(which[last[full]] == which[full]) & (place[last[full]] - place[full] < span[which[full]])]
        found = set()
        for k in full.tolist():
            i, row = int(which[k]), int(self.row_of(place[k : k + 1])[0])
            if (row, i) not in found and self._enough(own[own_begin[i] : own_begin[i + 1]], int(place[last[k]]), int(place[k]), int(span[i]), int(need[i]), row):
                found.add((row, i))
        return sorted(found)

    def _enough(self, terms: np.ndarray, last: int, first: int, span: int, need: int, row: int) -> bool:
        """Whether `need` of the terms stand within a span around first and last in the row."""
        low, high = max(last - span + 1, int(self.begin[row])), min(first + span, int(self.begin[row + 1]))
        ends = np.searchsorted(self.postings, np.stack([(terms.astype(np.uint64) << _POSITION) | np.uint64(low), (terms.astype(np.uint64) << _POSITION) | np.uint64(max(high, low))]))
        if (ends[1] > ends[0]).sum() < need:
            return False
        held = sorted((int(p & np.uint64((1 << int(_POSITION)) - 1)), t) for t, (a, b) in enumerate(zip(*ends.tolist())) for p in self.postings[a:b])
        there, begin, distinct = [0] * len(terms), 0, 0
        for place, t in held:
            distinct += there[t] == 0
            there[t] += 1
            while held[begin][0] <= place - span:
                there[held[begin][1]] -= 1
                distinct -= there[held[begin][1]] == 0
                begin += 1
            if distinct >= need:
                return True
        return False


def _block_of(test: DataFrame, k: int, blocks_n: int, window: int) -> Phrases:
    part = test.where(F.pmod(F.xxhash64("text"), F.lit(blocks_n)) == k) if blocks_n > 1 else test
    got = part.toArrow()
    return phrases(got.column("text"), got.column("item").to_pylist(), window)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The positional index, kept in the shared folder, one row a shard: shard, ids and hashes of its documents' texts, where their words begin, terms, lists, positions.

    Null text has no words.  Repeated rows and null ids are documents each; other columns are
    left aside; an empty table has no shards.
    """
    wanted = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    kind = wanted.schema["id"].dataType.simpleString()

    def run(batches):
        held, size, number = [], 0, 0

        def shard():
            table = pa.Table.from_batches(held).combine_chunks()
            h, begin = hashed_words(table.column("text"), ALNUM)
            known, lists, positions = postings(h)
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (begin.astype(np.int64), known, lists, positions)]
            ids = [pa.ListArray.from_arrays([0, table.num_rows], table.column(c).combine_chunks()) for c in ("id", "text_hash")]
            return pa.RecordBatch.from_arrays([pa.array([table.column("part")[0].as_py() << 24 | number]), *ids, *packed], names=["shard", "ids", "text_hashes", "begin", "terms", "lists", "positions"])

        for batch in blocks(batches, "text", shard_bytes):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= shard_bytes:
                yield shard()
                held, size, number = [], 0, number + 1
        if held:
            yield shard()

    return cut(wanted.mapInArrow(run, f"shard bigint, ids array<{kind}>, text_hashes array<bigint>, begin binary, terms binary, lists binary, positions binary"))


def search(indexed: DataFrame, found: Phrases) -> DataFrame:
    """Of one block of items: (shard, row, hits, items, near) of each document that has some: pairs of start and end word of each exact occurrence, names of the items these belong to, names of items that are near."""
    names = pa.array(found.names, pa.string())
    shared = indexed.sparkSession.sparkContext.broadcast((found.terms, found.words, found.size, found.item_begin, found.item_of, names, found.own_begin, found.own, found.length))

    def run(batches):
        terms, words, size, item_begin, item_of, names, own_begin, own, length = shared.value
        for batch in batches:
            for name, *packed in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                begin, known, lists, positions = (np.frombuffer(x, k) for x, k in zip(packed, (np.int64, np.uint64, np.int64, np.uint32)))
                shard = Shard(known, lists, positions, begin, terms)
                which, start = shard.occurrences(words, size)
                rows = shard.row_of(start)
                order = np.lexsort((start, rows))
                which, start, rows = which[order], start[order], rows[order]
                close: dict[int, list[int]] = {}
                for r, i in shard.near(own_begin, own, length):
                    close.setdefault(r, []).append(i)
                hit = sorted({*np.unique(rows).tolist(), *close})
                hits, items = [], []
                for r in hit:
                    mine = slice(*np.searchsorted(rows, (r, r + 1)))
                    hits.append(np.stack([start[mine] - begin[r], start[mine] - begin[r] + size[which[mine]]], axis=1).ravel().tolist())
                    of = [item_of[item_begin[w] : item_begin[w + 1]] for w in np.unique(which[mine])]
                    items.append(names.take(pa.array(np.unique(np.concatenate(of)))).to_pylist() if of else [])
                near = [names.take(pa.array(close.get(r, []), pa.int64())).to_pylist() for r in hit]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit)), pa.array(hit, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))], names=["shard", "row", "hits", "items", "near"])

    asked = indexed.select("shard", "begin", "terms", "lists", "positions")
    return asked.mapInArrow(run, "shard bigint, row bigint, hits array<bigint>, items array<string>, near array<string>")


def _covered(hits: list[int]) -> int:
    """Words within any of the pairs of start and end."""
    covered, upto = 0, 0
    for a, b in sorted(zip(hits[::2], hits[1::2])):
        covered += max(0, b - max(a, upto))
        upto = max(upto, b)
    return covered


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items, near, text_hash.

    Words are lower-cased runs of letters, digits and all beyond ASCII.  A word is hit if it
    lies in any occurrence of any window of `window` consecutive words of a test item (an
    item of fewer words is one window).  A document is contaminated if it has hits and
    `share` times them reach its words.  near are the items (with or without exact hits) of
    which NEAR_SHARE of the distinct words stand within a span of their length and a quarter.

    Null or wordless texts have no words and no hits, null or wordless items no windows.  An
    item of null id has the empty name; items of the same id count once.  Repeated rows are
    searched each, and text_hash (xxhash64) tells rows of one id apart; other columns are left
    aside.  Empty tables give an empty result or no hits.  Items are read by the driver in
    blocks of about `block_bytes`; any number of blocks gives the same result.
    """
    test = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // block_bytes) + 1
    indexed = index(docs, id_col, text_col, shard_bytes)
    found = None
    for k in range(count):
        part = search(indexed, _block_of(test, k, count, window))
        found = cut(part) if found is None else found.union(cut(part))
    if count > 1:
        every = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  of one document: a list a block
        found = found.groupBy("shard", "row").agg(every("hits"), every("items"), every("near"))

    def finish(batches):
        for batch in batches:
            if batch.num_rows:
                names = [sorted(set(x)) for x in batch.column(3).to_pylist()]
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                near = [sorted(set(x)) for x in batch.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([_covered(x) for x in batch.column(2).to_pylist()], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(digest, pa.string()), pa.array(near, pa.list_(pa.string()))],
                    names=["f_shard", "f_row", "hit", "f_items", "digest", "f_near"],
                )

    done = found.mapInArrow(finish, "f_shard bigint, f_row bigint, hit bigint, f_items array<string>, digest string, f_near array<string>")
    kind = docs.schema[id_col].dataType.simpleString()

    def listed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                begin = np.frombuffer(batch.column(3)[k].as_py(), np.int64)
                n = len(begin) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[k].as_py())), pa.array(np.arange(n)), batch.column(1)[k].values, batch.column(2)[k].values, pa.array(np.diff(begin))], names=["shard", "row", "doc_id", "text_hash", "n_words"])

    every = indexed.select("shard", "ids", "text_hashes", "begin").mapInArrow(listed, f"shard bigint, row bigint, doc_id {kind}, text_hash bigint, n_words bigint")
    out = every.join(done, (F.col("shard") == F.col("f_shard")) & (F.col("row") == F.col("f_row")), "left")
    n_hit, empty = F.coalesce("hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    items, near = F.coalesce("f_items", empty), F.coalesce("f_near", empty)
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), F.size(near).cast("long").alias("n_near"), items.alias("items"), near.alias("near"), "text_hash",
    )
