"""Language-model scoring by a weighted backoff automaton, with the model kept distributed.

Counts of all n-grams up to `order` are smoothed towards the next lower order with a
Dirichlet prior, whose strength grows with a context's count as the number of distinct
words after it does (a * count ** b); the lowest order is smoothed by one.  As an automaton: states are the
seen contexts, a state's arcs its seen continuations, and its failure arc leads to the
context without its first word, at a weight that makes each state's probabilities sum to 1.
A text is scored in one pass from left to right that carries the state.

No task or driver holds the model.  Documents are cut into chunks; a chunk sends each of
its distinct n-grams once to the bucket that owns it, with its count there; a bucket adds
the counts up and answers each chunk with one number for each n-gram asked, in the order
asked.  The answers meet the chunk's compressed texts, which build the part of the automaton
that they can reach and are scored.  All that grows with the corpus moves through two
shuffles.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .words import SPACED, blocks, grouped, hashed_words, mix

#: Words of a chunk, about.
CHUNK = 1_000_000
_START, _END = np.uint64(0x5EED0001), np.uint64(0x5EED0002)
_ROW = "dest int, chunk bigint, bucket int, keys binary, counts binary, types bigint, tokens bigint"


#: Bits of the key of a single word and of a longer n-gram, at every size of input.  Words whose
#: counts are reported have all 64; of 10**12 longer n-grams one in 70,000 shares its key.
WORD_BITS, GRAM_BITS = 64, 56
#: Most buckets of single words: their sums go to all chunks, so there must be no more of them as the input grows.
WORD_BUCKETS = 4096


def bits_of(k: int) -> int:
    """Bits of the key of an n-gram of k words."""
    return WORD_BITS if k == 1 else GRAM_BITS


def squeezed(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys: the steps between them, byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].T.tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes, bits: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : bits // 8] = np.frombuffer(pa.decompress(data[8:], n * bits // 8, codec="zstd", asbytes=True), np.uint8).reshape(bits // 8, n).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each, compressed."""
    most = int(counts.max()) if len(counts) else 0
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s) or s == 8)
    return bytes((size,)) + len(counts).to_bytes(8, "little") + pa.compress(counts.astype(f"<u{size}").tobytes(), codec="zstd", asbytes=True)


def from_narrow(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], n * size, codec="zstd", asbytes=True), f"<u{size}").astype(np.int64)


def stream(column) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: a start mark, its words' hashes, an end mark; and where each text begins (one more than texts)."""
    h, begin = hashed_words(column, SPACED)
    n = len(begin) - 1
    at = begin + 2 * np.arange(n + 1)
    out = np.empty(int(at[-1]), np.uint64)
    out[at[:-1]], out[at[1:] - 1] = _START, _END
    body = np.ones(len(out), bool)
    body[at[:-1]] = body[at[1:] - 1] = False
    out[body] = h
    return out, at


def ngrams(tokens: np.ndarray, at: np.ndarray, order: int):
    """For k = 1..order in turn: the key of the k-gram that ends at each position, and where there is one.  A start mark is a 1-gram."""
    position = np.arange(len(tokens), dtype=np.int32) - np.repeat(at[:-1], np.diff(at)).astype(np.int32)
    g = mix(tokens, 1)
    for k in range(1, order + 1):
        if k > 1:
            g[1:] = mix(g[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ tokens[1:], k)
        yield g >> np.uint64(64 - bits_of(k)), position >= k - 1


def distinct(keys: np.ndarray, there: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of the positions where there is one, those positions in the order of their keys, and where in it each key begins."""
    where = np.flatnonzero(there)
    order, begin = grouped(keys[where] << np.uint64(64 - bits))
    order = where[order]
    return keys[order[begin]], order, begin


def edges_of(buckets: int, bits: int) -> np.ndarray:
    return np.array([min(-(-(b << bits) // buckets), (1 << 64) - 1) for b in range(buckets + 1)], dtype=np.uint64)


class BackoffAutomaton:
    """The part of the automaton that some texts can reach.

    counts[k-1][i] is the corpus count of the k-gram that ends at position i of the stream
    (0 where there is none).  arc[k] and fail[k] are, by position, the log10 weights of the
    arc that reads the word there from a state of k words and of that state's failure arc.
    """

    def __init__(self, counts: list[np.ndarray], tokens: int, types: int, prior: tuple[float, float]):
        self.order = len(counts)
        p = (counts[0] + 1.0) / (tokens + types + 1.0)
        self.counts, self.arc, self.fail = counts, [np.log10(p)], []
        for k in range(1, self.order):
            context = np.zeros(len(p))
            context[1:] = counts[k - 1][:-1]
            strength = prior[0] * np.maximum(context, 1.0) ** prior[1]
            p = (counts[k] + strength * p) / (context + strength)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(strength / (context + strength)))

    def score(self, at: np.ndarray) -> np.ndarray:
        """The log10 probability of each text of the stream that begins at `at`: all texts abreast, one word a step."""
        length = np.diff(at)
        rank = np.argsort(-length, kind="stable")
        start, sizes = at[:-1][rank], length[rank]
        state = np.where(self.counts[0][start] > 0, min(1, self.order - 1), 0) if len(start) else np.zeros(0, int)
        total = np.zeros(len(start))
        active = len(start)
        for t in range(1, int(sizes[0]) if len(sizes) else 0):
            while sizes[active - 1] <= t:
                active -= 1
            i, s, sum_ = start[:active] + t, state[:active], total[:active]
            now = np.zeros(active, s.dtype)
            open_ = np.ones(active, bool)
            for k in range(self.order - 1, -1, -1):
                here = open_ & (s == k)
                has = self.counts[k][i] > 0
                take = here & has if k else here
                sum_ += np.where(take, self.arc[k][i], 0.0)
                now[take] = min(self.order - 1, k + 1)
                if k:
                    fails = here & ~has
                    sum_ += np.where(fails, self.fail[k - 1][i], 0.0)
                    s = np.where(fails, k - 1, s)
                else:
                    now[take & ~has] = 0
                open_ &= ~take
            state[:active] = now
        out = np.empty(len(start))
        out[rank] = total
        return out


def _encoded(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _ROW.split(", ")])


def _chunks(batches):
    """(chunk, table) of about CHUNK words each, whole documents; alike for every reader of the same rows."""
    held, size, number = [], 0, 0
    for batch in blocks(batches, "text", 4 << 20):
        held.append(batch)
        size += batch.column(1).nbytes // 6
        if size >= CHUNK:
            yield held[0].column(3)[0].as_py() << 24 | number, pa.Table.from_batches(held).combine_chunks()
            held, size, number = [], 0, number + 1
    if held:
        yield held[0].column(3)[0].as_py() << 24 | number, pa.Table.from_batches(held).combine_chunks()


def _texts(batches):
    """Chunks as rows of their own, compressed."""
    for chunk, table in _chunks(batches):
        yield _row_batch([(0, chunk, -1, _encoded(table), b"", 0, 0)])


def _places(known: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where each bucket's keys begin among sorted ones (one more than buckets)."""
    return np.append(np.searchsorted(known, edges), len(known))


def _buckets_of(buckets: int, order: int) -> list[tuple[int, np.ndarray]]:
    """For k = 1..order in turn: how many buckets own the k-grams, and the buckets' first keys."""
    out = []
    for k in range(1, order + 1):
        n = min(buckets, WORD_BUCKETS) if k == 1 else buckets
        out.append((n, edges_of(n, bits_of(k))[:-1]))
    return out


def _ask(buckets: int, order: int):
    """For each chunk and bucket the distinct n-grams that the bucket owns, order by order, with their counts in what is learned.

    Buckets of single words get a row of every chunk, for they answer with what all words sum
    to; others only if there is something to ask, so there are no more rows than n-grams.
    """
    split = _buckets_of(buckets, order)

    def run(batches):
        for chunk, table in _chunks(batches):
            tokens, at = stream(table.column("text"))
            starts = at[:-1]
            learn = np.repeat(table.column("learn").to_numpy(zero_copy_only=False), np.diff(at))
            for k, (keys, there) in enumerate(ngrams(tokens, at, order)):
                bits, edges = bits_of(k + 1), split[k][1]
                known, places, begin = distinct(keys, there, bits)
                many = np.add.reduceat(learn[places].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
                cut_at = _places(known, edges)
                # the start mark's key goes along, for it isn't a word
                start_key = int(keys[starts[0]].astype(np.int64)) if k == 0 else 0
                for b in range(len(edges)) if k == 0 else np.flatnonzero(np.diff(cut_at)).tolist():
                    own = slice(cut_at[b], cut_at[b + 1])
                    yield _row_batch([(b, chunk, b * order + k, squeezed(known[own], bits), narrow(many[own]), start_key, 0)])

    return run


def _rows(batches):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _answer(order: int):
    """A bucket's sums, sent to each chunk for the n-grams it asked of."""

    def flush(asked: list[tuple]):
        bits = bits_of(asked[0][2] % order + 1)
        keys = [unsqueezed(r[3], bits) for r in asked]
        flat = np.concatenate(keys)
        flat.sort()
        owned = flat[np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))] if len(flat) else flat
        del flat
        total = np.zeros(len(owned), np.int64)
        for r, k in zip(asked, keys):
            total[np.searchsorted(owned, k)] += from_narrow(r[4])
        types = tokens = 0
        if asked[0][2] % order == 0:  # single words
            word = owned != np.uint64(np.int64(asked[0][5]).astype(np.uint64))
            types, tokens = int((word & (total > 0)).sum()), int(total[word].sum())
        for r, k in zip(asked, keys):
            yield _row_batch([(0, r[1], r[2], b"", narrow(total[np.searchsorted(owned, k)]), types, tokens)])

    def run(batches):
        held: list[tuple] = []
        for row in _rows(batches):
            if held and held[0][2] != row[2]:
                yield from flush(held)
                held = []
            held.append(row)
        if held:
            yield from flush(held)

    return run


def _scored(buckets: int, order: int, prior: tuple[float, float]):
    split = _buckets_of(buckets, order)

    def flush(text: tuple, answers: list[tuple]):
        table = pa.ipc.open_stream(text[3]).read_all().combine_chunks()
        tokens, at = stream(table.column("text"))
        n = len(tokens)
        types, total = sum(r[5] for r in answers), sum(r[6] for r in answers)
        parts = {r[2]: r[4] for r in answers}
        by = []
        for k, (keys, there) in enumerate(ngrams(tokens, at, order)):
            known, places, begin = distinct(keys, there, bits_of(k + 1))
            sizes = np.diff(_places(known, split[k][1]))
            asked = range(len(sizes)) if k == 0 else np.flatnonzero(sizes).tolist()
            counts = [from_narrow(parts.pop(b * order + k, narrow(known[:0]))) for b in asked]
            if [len(c) for c in counts] != sizes[asked].tolist():
                raise RuntimeError(f"chunk {text[1]} didn't get the answers to what its texts ask: the input changed between its two scans")
            spread = np.zeros(n, np.int64)
            spread[places] = np.repeat(np.concatenate([*counts, known[:0].astype(np.int64)]), np.diff(np.append(begin, len(places))))
            by.append(spread)
        del tokens, keys, there, places, begin, known, counts
        machine = BackoffAutomaton(by, total, types, prior)
        scored = np.ones(n, bool)
        scored[at[:-1]] = False
        base = np.add.reduceat(np.where(scored, machine.arc[0], 0.0), at[:-1])
        known_n = np.add.reduceat((scored & (by[0] > 0)).astype(np.int64), at[:-1])
        yield pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks(), pa.array(~table.column("learn").to_numpy(zero_copy_only=False)), pa.array(np.diff(at) - 1), pa.array(known_n), pa.array(np.full(len(at) - 1, total)), pa.array(base), pa.array(machine.score(at))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches):
        text, answers = None, []
        for row in _rows(batches):
            if row[2] < 0:
                if text is not None:
                    yield from flush(text, answers)
                text, answers = row, []
            else:
                answers.append(row)
        if text is not None:
            yield from flush(text, answers)

    return run


def _steady(docs: DataFrame) -> bool:
    """Whether each scan of docs gives the same rows in the same order: a plan of file scans, projections and filters does."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-]*(?:\*\(\d+\) )?(\w+)", line))}
    return nodes <= {"FileScan", "ColumnarToRow", "Project", "Filter"}


def score_documents(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", order: int = 3, prior: tuple[float, float] = (3.0, 0.8), buckets: int | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    learn is the condition (a Column) of rows whose n-grams are counted; all rows are scored.
    Tokens are the lower-cased words, then one end.  base_score sums the log10 of add-one
    unigram probabilities, score those of the automaton.  buckets: None for one to each
    16 MB of input, as many as shuffle partitions at least; each is a task of its own.

    Null text is empty: its only token is the end.  A null learn doesn't learn.  Repeated
    rows are counted and scored each.  With nothing to learn from, all words are unknown.
    Other columns are left aside; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if buckets is None:
        buckets = max(24, int(spark.conf.get("spark.sql.shuffle.partitions")), min(size >> 24, 1 << 20))
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), F.spark_partition_id().cast("long").alias("part"))
    if not _steady(docs):
        wanted = cut(wanted)  # rows may come in another order the second time
    asked = wanted.mapInArrow(_ask(buckets, order), _ROW)
    answered = asked.repartitionById(buckets, "dest").sortWithinPartitions("bucket").mapInArrow(_answer(order), _ROW).union(wanted.mapInArrow(_texts, _ROW))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    return answered.repartition(buckets, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(
        _scored(buckets, order, prior), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
