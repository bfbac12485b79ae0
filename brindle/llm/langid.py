"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its byte n-grams, 2 to 4 long, with a mark at either end, and the
whole word; each is hashed to one of `buckets` embeddings.  A text is the average over its
subwords, on which a linear softmax is trained by stochastic gradient descent in numpy.
Confidence is calibrated by temperature on held-out rows, and texts below a calibrated
threshold are rejected.  Since all is linear up to the softmax, prediction folds embedding
and output into one table of class scores per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import LOWER, SPACED, blocks, hash_spans, mix, spans, text_bytes, unique_inverse

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 13
    width: int = 16
    epochs: int = 12
    rate: float = 12.0
    batch: int = 32
    per_language: int = 400  # bound of the training sample, by language
    held: float = 0.25  # share of the sample that calibrates
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # class scores of each bucket; with more languages than an embedding is wide, its embedding
    out: np.ndarray | None  # what turns an averaged embedding into class scores; None if the table has them
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the subwords of spans, and where each span's begin (one more than spans)."""
    size = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(size)))
    marked = np.zeros(int(at[-1]) + 4, np.uint8)
    within = np.arange(at[-1]) - np.repeat(at[:-1], size)
    inner = (within > 0) & (within < np.repeat(size, size) - 1)
    marked[: at[-1]][inner] = data[(np.repeat(starts, size) + within - 1)[inner]]
    marked[at[:-1]], marked[at[1:] - 1] = 1, 2
    four = np.ndarray((int(at[-1]),), dtype="<u4", buffer=marked, strides=(1,)).astype(np.uint64)
    room = np.repeat(size, size) - within
    ids, owner = [hash_spans(data, starts, ends) % np.uint64(buckets)], [np.arange(len(starts))]
    words = np.repeat(np.arange(len(starts)), size)
    for n in (2, 3, 4):
        ok = room >= n
        ids.append(mix(four[ok] & np.uint64((1 << (8 * n)) - 1), n) % np.uint64(buckets))
        owner.append(words[ok])
    ids, owner = np.concatenate(ids).astype(np.int32), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))


def _unique_words(column, buckets: int):
    """Of a text column: bucket numbers of its distinct words, their begins, each word's number, rows' begins."""
    data, offs = text_bytes(column)
    data = LOWER[data]
    starts, ends = spans(data, offs, SPACED)
    _, first, inverse = unique_inverse(hash_spans(data, starts, ends))
    ids, begin = subwords(data, starts[first], ends[first], buckets)
    return ids, begin, inverse, np.searchsorted(starts, offs)


def features(column, buckets: int) -> list[np.ndarray]:
    """For each text the count of each bucket."""
    ids, begin, inverse, rows = _unique_words(column, buckets)
    out = []
    for a, b in zip(rows[:-1], rows[1:]):
        words, times = np.unique(inverse[a:b], return_counts=True)
        parts = [ids[begin[w] : begin[w + 1]] for w in words]
        weight = np.repeat(times, [len(p) for p in parts]) if parts else np.zeros(0)
        out.append(np.bincount(np.concatenate(parts), weights=weight, minlength=buckets).astype(np.float32) if parts else np.zeros(buckets, np.float32))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(sparse: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], s: Settings) -> Model:
    """sparse: buckets and their counts of each row; y: numbers of languages.  Rows are dense only a batch at a time."""
    rng = np.random.default_rng(s.seed)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), s.buckets), np.float32)
        for k, r in enumerate(rows):
            ids, n = sparse[r]
            x[k, ids] = n / max(n.sum(), 1)
        return x

    size = len(sparse)
    order = rng.permutation(size)
    held = order[: int(size * s.held)] if size >= 20 else order
    learn = order[len(held) :] if size >= 20 else order
    e = rng.uniform(-1, 1, (s.buckets, s.width)).astype(np.float32)
    w = np.zeros((s.width, len(languages)), np.float32)
    b = np.zeros(len(languages), np.float32)
    steps, done = max(1, s.epochs * -(-len(learn) // s.batch)), 0
    for _ in range(s.epochs):
        rng.shuffle(learn)
        for k in range(0, len(learn), s.batch):
            rows = learn[k : k + s.batch]
            rate = s.rate * (1 - done / steps)
            done += 1
            x = dense(rows)
            h = x @ e
            g = _softmax(h @ w + b)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = x.T @ (g @ w.T)
            w -= rate * (h.T @ g)
            b -= 0.1 * rate * g.sum(axis=0)
            e -= rate * back
    raw = np.concatenate([dense(held[k : k + 256]) @ e @ w + b for k in range(0, len(held), 256)]) if len(held) else np.zeros((0, len(languages)))
    heats = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(raw / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(raw / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    least = 1 / len(languages)
    floor = float(np.quantile(right, 0.002)) if len(right) else 1.0
    folded = len(languages) <= s.width
    return Model(languages, (e @ w if folded else e).astype(np.float32), None if folded else w, b, heat, min(max(0.8 * floor, 1.05 * least), 0.5))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, settings: Settings = Settings()) -> Model:
    """A model of rows with text and label.  

    It learns all labels, each from a sample of at most about 1.25 * per_language rows, chosen
    by the hash of `key` (the text if None).  Rows without text or label don't count; equal
    rows are chosen together, and the order of rows makes no difference.
    """
    s = settings
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.xxhash64(key) if key is not None else F.xxhash64(text_col)).alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros((s.buckets, 0), np.float32), None, np.zeros(0, np.float32), 1.0, 1.0)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.25 * s.per_language / r["count"]))])
    chosen = rows.where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, "lang") * (1 << 30)).select("text", "lang")

    def run(batches):
        for batch in blocks(batches, "text", 1 << 20):
            counted = features(batch.column(0), s.buckets)
            sparse = [np.flatnonzero(c) for c in counted]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([i.astype("<i4").tobytes() for i in sparse], pa.binary()), pa.array([c[i].astype("<f4").tobytes() for c, i in zip(counted, sparse)], pa.binary())], names=["lang", "ids", "n"])

    got = chosen.mapInArrow(run, "lang string, ids binary, n binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["ids"], r["n"]))
    sparse = [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["n"], "<f4")) for r in got]
    at = {name: k for k, name in enumerate(languages)}
    return train(sparse, np.array([at[r["lang"]] for r in got], dtype=int), languages, s)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, lang_pred, score, accepted, then the columns named in keep.

    lang_pred is a learned label; score its calibrated probability; accepted whether that
    reaches the model's threshold.  Null text and text without a letter (or a model that
    learned no label) give `und`, score 0 and are rejected.  Texts are read whole.  Repeated
    rows are predicted each; other columns are left aside; an empty table gives an empty result.
    """
    kept = [c for c in keep if c not in (id_col, text_col)]
    texts = ["text"] if text_col in keep else []
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"k_{c}") for c in kept])
    m = model

    def run(batches):
        for batch in blocks(batches, "text", 2 << 20):
            column = batch.column(1)
            ok = np.array([bool(t) and has_letter(t) for t in column.to_pylist()]) & bool(m.languages)
            best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            if ok.any():
                ids, begin, inverse, rows = _unique_words(column, m.table.shape[0])
                many = np.diff(begin)
                of = np.concatenate(([0], np.cumsum(many[inverse], dtype=np.int64)))
                n = np.maximum(of[rows[1:]] - of[rows[:-1]], 1)
                raw = np.empty((batch.num_rows, m.table.shape[1]))
                for k in range(m.table.shape[1]):
                    word = np.add.reduceat(m.table[ids, k].astype(np.float64), begin[:-1]) if len(ids) else np.zeros(0)
                    total = np.concatenate(([0.0], np.cumsum(word[inverse])))
                    raw[:, k] = (total[rows[1:]] - total[rows[:-1]]) / n
                raw = (raw if m.out is None else raw @ m.out) + m.bias
                p = _softmax(raw / m.temperature)
                best, score = p.argmax(axis=1), p.max(axis=1)
            names = [m.languages[b] if good else UNKNOWN for b, good in zip(best, ok)]
            score = np.where(ok, np.minimum(score, 1.0), 0.0)
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ok & (score >= m.threshold), pa.bool_()), *([column] if texts else []), *[batch.column(2 + i) for i in range(len(kept))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "accepted", *texts, *[f"k_{c}" for c in kept]])

    schema = ", ".join([f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}", "lang_pred string", "score double", "accepted boolean", *[f"{c} string" for c in texts], *[f"`k_{c}` {wanted.schema[f'k_{c}'].dataType.simpleString()}" for c in kept]])
    out = wanted.mapInArrow(run, schema)
    return out.select("doc_id", "lang_pred", "score", "accepted", *[F.col("text" if c == text_col else f"k_{c}").alias(c) for c in keep if c != id_col])
