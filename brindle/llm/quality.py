"""Quality classifier: document evidence combined with the posteriors of its host and path.

A logistic classifier over hashed words and a few shape features, trained in numpy on a
bounded labelled sample, gives each document's evidence.  Hosts and paths (groups within a
host) gather the evidence of all their documents by grouped aggregation; empirical Bayes
shrinks a path's mean to its host's and a host's to the global one, the more the fewer
documents it has, with strengths estimated from the spread of the means.  The score moves
the document's log-odds by how far its site's posterior is from the global prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .words import ALNUM, LOWER, blocks, hash_spans, spans, sums, text_bytes

#: Hashed word features; most labelled rows of a class that train, about.
BUCKETS, PER_CLASS = 1 << 18, 3000
_SHAPES = 8


@dataclass
class Model:
    weight: np.ndarray  # of hashed words, then of shapes
    bias: float
    mean: np.ndarray
    spread: np.ndarray
    slope: float
    shift: float


def featured(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its distinct word buckets end to end, where they begin (one more than rows), and its shape."""
    data, offs = text_bytes(column)
    low = LOWER[data]
    starts, ends = spans(low, offs, ALNUM)
    n = len(offs) - 1
    begin = np.searchsorted(starts, offs)
    bucket = (hash_spans(low, starts, ends) >> np.uint64(20)).astype(np.int64) % BUCKETS
    row = np.repeat(np.arange(n), np.diff(begin))
    pairs = np.unique(row * BUCKETS + bucket)
    count = np.diff(begin)
    size = np.maximum(np.diff(offs), 1)
    share = lambda mask: sums(mask, offs) / size
    loud = np.zeros(len(data), bool)
    loud[1:] = (data[1:] == 0x21) & (data[:-1] == 0x21)
    shape = np.stack(
        [
            np.log1p(count), share((data >= 0x41) & (data <= 0x5A)), share(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))), share(loud), share((data >= 0x30) & (data <= 0x39)),
            np.bincount(pairs // BUCKETS, minlength=n) / np.maximum(count, 1), (ends - starts).sum() and sums(ends - starts, begin) / np.maximum(count, 1) / 10, share(data == 0x0A) * 50,
        ], axis=1,
    )
    return pairs % BUCKETS, np.searchsorted(pairs // BUCKETS, np.arange(n + 1)), shape


def train(ids: np.ndarray, begin: np.ndarray, shape: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Logistic regression by Adam on all rows but each fifth, which calibrates."""
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(begin))
    used, ids = np.unique(ids, return_inverse=True)  # only buckets that occur are trained
    words = len(used)
    mean, spread = (shape.mean(axis=0), shape.std(axis=0) + 1e-6) if n else (np.zeros(_SHAPES), np.ones(_SHAPES))
    z = np.clip((shape - mean) / spread, -4, 4)
    own = 1 / np.sqrt(np.maximum(np.diff(begin), 1.0))
    learn = np.arange(n) % 5 != 0 if n >= 50 else np.ones(n, bool)
    rarity = np.bincount(ids, minlength=words) >= 3
    w, v, b = np.zeros(words), np.zeros(_SHAPES), 0.0
    m1, m2 = np.zeros(words + _SHAPES + 1), np.zeros(words + _SHAPES + 1)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) if n else np.ones(0)
    margin = lambda: np.bincount(row, weights=w[ids], minlength=n) * own + z @ v + b
    for t in range(1, steps + 1 if n else 0):
        g = np.where(learn, (1 / (1 + np.exp(-np.clip(margin(), -30, 30))) - y) * balance, 0) / learn.sum()
        grad = np.concatenate((np.bincount(ids, weights=(g * own)[row], minlength=words) * rarity + decay * w, z.T @ g, [g.sum()]))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w, v, b = w - step[:words], v - step[words:-1], b - step[-1]
    slope, shift = 1.0, 0.0
    x, t_ = margin()[~learn], y[~learn]
    for _ in range(300 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        slope -= 0.05 * float(((p - t_) * x).mean())
        shift -= 0.05 * float((p - t_).mean())
    full = np.zeros(BUCKETS)
    full[used] = w
    return Model(np.concatenate((full, v)).astype(np.float32), float(b), mean, spread, max(slope, 0.1), shift)


def fit(docs: DataFrame, labels: DataFrame, good: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> Model:
    """A model of the documents that labels has; good: the condition on labels (a Column) that a document is good.

    It learns from at most about PER_CLASS rows of each class, chosen by the hash of the id, and
    from at most 4 * PER_CLASS documents, the first by the hashes of id and words, if documents
    repeat ids.  A repeated label is good if one of its rows is; null ids and labels don't count.
    Null and empty texts are documents without words.  Nothing to learn from gives a model
    that finds all alike.
    """
    labelled = labels.select(F.col(label_id).alias("l_id"), good.cast("int").alias("good")).where("l_id IS NOT NULL AND good IS NOT NULL")
    labelled = labelled.groupBy("l_id").agg(F.max("good").alias("good"))
    counts = {r["good"]: r["count"] for r in labelled.groupBy("good").count().collect()}
    share = F.when(F.col("good") == 1, min(1.0, PER_CLASS / counts.get(1, 1))).otherwise(min(1.0, PER_CLASS / counts.get(0, 1)))
    chosen = labelled.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 30)) < share * (1 << 30))  # about 2 * PER_CLASS rows: bounded
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("text", "good", F.col("d_id").cast("string").alias("key"))

    def run(batches):
        for batch in blocks(batches, "text"):
            ids, begin, shape = featured(batch.column(0))
            parts = [ids[a:b].astype("<i4").tobytes() for a, b in zip(begin[:-1], begin[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(parts, pa.binary()), pa.array([s.tobytes() for s in shape], pa.binary())], names=["key", "good", "ids", "shape"])

    counted = rows.mapInArrow(run, "key string, good int, ids binary, shape binary")
    # ids that repeat could make more rows than that: the bound holds before anything comes to the driver
    got = counted.orderBy(F.xxhash64("key"), F.xxhash64("ids")).limit(4 * PER_CLASS).toArrow().to_pylist()
    got.sort(key=lambda r: (r["key"], r["ids"], r["shape"], r["good"]))
    ids = [np.frombuffer(r["ids"], "<i4").astype(np.int64) for r in got]
    begin = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
    shape = np.array([np.frombuffer(r["shape"]) for r in got]).reshape(-1, _SHAPES)
    return train(np.concatenate(ids) if ids else np.zeros(0, np.int64), begin, shape, np.array([r["good"] for r in got], float))


def evidence(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """doc_id and evidence, the calibrated probability from the text alone, then the columns of keep (pairs of column and new name)."""
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in keep])
    m = model

    def run(batches):
        for batch in blocks(batches, "text"):
            ids, begin, shape = featured(batch.column(1))
            n = batch.num_rows
            row = np.repeat(np.arange(n), np.diff(begin))
            x = np.bincount(row, weights=m.weight[ids], minlength=n) / np.sqrt(np.maximum(np.diff(begin), 1.0)) + np.clip((shape - m.mean) / m.spread, -4, 4) @ m.weight[BUCKETS:].astype(float) + m.bias
            p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.shift, -30, 30)))
            p[pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) == 0] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), *batch.columns[2:]], names=["doc_id", "evidence", *batch.schema.names[2:]])

    schema = ", ".join(["doc_id " + wanted.schema["doc_id"].dataType.simpleString(), "evidence double", *[f"{n} {wanted.schema[n].dataType.simpleString()}" for _, n in keep]])
    return wanted.mapInArrow(run, schema)


def _strength(mean: float, spread: float) -> float:
    """Pseudo-documents of a beta prior whose means spread so."""
    return min(1e6, max(1.0, mean * (1 - mean) / max(spread, 1e-9) - 1))


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, evidence, host_posterior, path_posterior, score, kept (score >= threshold).

    Where documents have no URL, as here, the defaults stand in: the source for the host and
    the language for the path (a group within the host); from a URL, give its host and the
    first part of its path as columns.  A document's own evidence is left out of its site's means.  Null hosts are one host, null
    paths one path of their host.  Null or empty text has evidence 0, so isn't kept.
    Repeated rows count and are scored each; other columns are left aside; an empty table
    gives an empty result.
    """
    read = cut(evidence(docs, model, id_col, text_col, ((host_col, "host"), (path_col, "path"))))
    paths = cut(read.groupBy("host", "path").agg(F.sum("evidence").alias("p_sum"), F.count(F.lit(1)).alias("p_n"), F.sum(F.col("evidence") * F.col("evidence")).alias("p_sq")))
    hosts = paths.groupBy("host").agg(F.sum("p_sum").alias("h_sum"), F.sum("p_n").alias("h_n"), F.sum("p_sq").alias("h_sq"))
    one = hosts.agg(F.sum("h_sum").alias("s"), F.sum("h_n").alias("n")).first()
    prior = min(max((one["s"] or 0.0) / max(one["n"] or 0, 1), 1e-3), 1 - 1e-3)

    def spread(table: DataFrame, mean: Column, s: str, n: str, q: str) -> float:
        # variance of the groups' means, less what their documents' own spread gives
        m = F.col(s) / F.col(n)
        noise = (F.col(q) / F.col(n) - m * m) / F.col(n)
        got = table.where(F.col(n) > 1).agg(F.avg((m - mean) ** 2 - noise)).first()[0]
        return got or 0.0

    host_prior = _strength(prior, spread(hosts, F.lit(prior), "h_sum", "h_n", "h_sq"))
    within = paths.join(hosts.select(F.col("host").alias("h"), "h_sum", "h_n"), F.col("host").eqNullSafe(F.col("h")))
    path_prior = _strength(prior, spread(within, F.col("h_sum") / F.col("h_n"), "p_sum", "p_n", "p_sq"))
    sites = within.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "p_sum", "p_n", "h_sum", "h_n")
    rows = read.join(sites, read["host"].eqNullSafe(F.col("s_host")) & read["path"].eqNullSafe(F.col("s_path")))
    host = (F.lit(host_prior * prior) + F.col("h_sum") - F.col("evidence")) / (F.lit(host_prior) + F.col("h_n") - 1)
    path = (F.lit(path_prior) * host + F.col("p_sum") - F.col("evidence")) / (F.lit(path_prior) + F.col("p_n") - 1)
    bounded = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda c: F.log(bounded(c) / (1 - bounded(c)))
    score = F.when(F.col("evidence") > 0, 1 / (1 + F.exp(-(odds(F.col("evidence")) + odds(path) - odds(F.lit(prior)))))).otherwise(F.lit(0.0))
    return rows.select("doc_id", "evidence", host.alias("host_posterior"), path.alias("path_posterior"), score.alias("score"), (score >= threshold).alias("kept"))
