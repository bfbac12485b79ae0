"""Near copies of the pipeline: five words and 0.8."""

import functools
import random

import corpus_pipeline


def shingles(text, k=5):
    w = text.split(" ")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_copies_between_080_and_085(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.jaccard, "jaccard_components", functools.partial(corpus_pipeline.jaccard.jaccard_components, buckets=4))  # only quicker
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    base = [word() for _ in range(200)]
    texts = [" ".join(base), " ".join(base + [word() for _ in range(44)]), " ".join(base + [word() for _ in range(60)]), " ".join(word() for _ in range(200))]
    alike = [len(shingles(texts[0]) & shingles(t)) / len(shingles(texts[0]) | shingles(t)) for t in texts]
    assert 0.80 < alike[1] < 0.85 and alike[2] < 0.80
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 2, 3]
