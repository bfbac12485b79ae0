import random

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import quality

from .rows import empty, table


def labelled(spark, n=400):
    r = random.Random(2)
    good, bad = ["method", "result", "because", "river", "measure"], ["win", "click", "free", "cash", "now"]
    rows = []
    for i in range(n):
        ok = r.random() < 0.6
        words = [r.choice(good if ok else bad) if r.random() < 0.3 else r.choice(["the", "of", "a", "is", "in"]) for _ in range(60)]
        rows.append((i, " ".join(words), "h%d" % (i % 7), "p%d" % (i % 3), int(ok)))
    docs = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, source string, lang string")
    return docs, spark.createDataFrame([(x[0], x[4]) for x in rows], "doc_id long, quality int"), {x[0]: x[4] for x in rows}


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"), F.col("quality") == 1)
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs, model).collect()}
    held = [i for i in truth if i % 2]
    assert sum(got[i] == bool(truth[i]) for i in held) / len(held) > 0.97


def test_sites_shrink(spark):
    """A site's posterior lies between its own mean and the prior, and moves from the prior with its size."""
    rows = [(i, "good " * 60 if i % 2 else "bad " * 60, "big", "x") for i in range(200)] + [(200 + i, "good " * 60, "fine", "x") for i in range(150)] + [(500, "good " * 60, "tiny", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = docs.select("doc_id", F.startswith("text", F.lit("good")).cast("int").alias("quality"))
    got = quality.quality(docs, quality.fit(docs, labels, F.col("quality") == 1)).collect()
    by = {}
    for r in got:
        by.setdefault("big" if r["doc_id"] < 200 else "fine" if r["doc_id"] < 500 else "tiny", []).append(r["path_posterior"])
    prior = np.mean([r["evidence"] for r in got])
    assert np.mean(by["big"]) < prior < np.mean(by["fine"])
    assert abs(by["tiny"][0] - prior) < abs(np.mean(by["fine"]) - prior)


def test_any_rows(spark):
    docs, labels, _ = labelled(spark, 80)
    model = quality.fit(docs, labels, F.col("quality") == 1)
    df = table(spark)
    got = quality.quality(df, model).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    nothing = {r["doc_id"] for r in df.where("text IS NULL OR text = ''").collect()}
    assert all(r["evidence"] == 0 and not r["kept"] for r in got if r["doc_id"] in nothing and r["doc_id"] is not None and r["evidence"] == 0)
    assert quality.quality(empty(spark), model).count() == 0


def test_nothing_labelled(spark):
    docs, labels, _ = labelled(spark, 10)
    model = quality.fit(docs, labels.where("false"), F.col("quality") == 1)
    assert quality.quality(docs, model).count() == 10


def test_posteriors_against_plain_python(spark):
    """Site posteriors and scores from each document's evidence, document by document."""
    import math

    df = table(spark, 40)
    model = quality.fit(df, df.selectExpr("doc_id", "doc_id % 2 AS quality").where("doc_id IS NOT NULL"), F.col("quality") == 1)
    rows = [(r["doc_id"], r["source"], r["lang"], r["evidence"]) for r in quality.evidence(df, model, keep=(("source", "source"), ("lang", "lang"))).collect()]
    hosts, paths = {}, {}
    for _, h, p, e in rows:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    every = [e for *_, e in rows]
    prior = min(max(sum(every) / len(every), 1e-3), 1 - 1e-3)
    mean = lambda x: sum(x) / len(x)

    def spread(groups, centre):
        got = [(mean(g) - centre(k)) ** 2 - (mean([v * v for v in g]) - mean(g) ** 2) / len(g) for k, g in groups.items() if len(g) > 1]
        return mean(got) if got else 0.0

    host_prior = quality._strength(prior, spread(hosts, lambda k: prior))
    path_prior = quality._strength(prior, spread(paths, lambda k: mean(hosts[k[0]])))
    odds = lambda v: math.log(min(max(v, 1e-6), 1 - 1e-6) / (1 - min(max(v, 1e-6), 1 - 1e-6)))
    want = []
    for i, h, p, e in rows:
        host = (host_prior * prior + sum(hosts[h]) - e) / (host_prior + len(hosts[h]) - 1)
        path = (path_prior * host + sum(paths[(h, p)]) - e) / (path_prior + len(paths[(h, p)]) - 1)
        score = 1 / (1 + math.exp(-(odds(e) + odds(path) - odds(prior)))) if e > 0 else 0.0
        want.append((i, round(host, 6), round(path, 6), round(score, 6)))
    got = [(r["doc_id"], round(r["host_posterior"], 6), round(r["path_posterior"], 6), round(r["score"], 6)) for r in quality.quality(df, model).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
