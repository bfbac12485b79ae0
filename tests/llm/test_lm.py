import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import lm

from .rows import empty, table, words_of


def brute(rows, learn, order=3, a=3.0, b=0.8):
    """{(id, text): (tokens, known, total, base, score)} from plain counters."""
    counts = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if learn(i):
            s = ["<s>", *words_of(t), "</s>"]
            for k in range(1, order + 1):
                counts[k].update(tuple(s[j : j + k]) for j in range(len(s) - k + 1))
    starts = counts[1].pop(("<s>",), 0)
    total, types = sum(counts[1].values()), len(counts[1])
    counts[1][("<s>",)] = starts
    out = {}
    for i, t in rows:
        s = ["<s>", *words_of(t), "</s>"]
        base = score = known = 0
        for j in range(1, len(s)):
            p = (counts[1][(s[j],)] + 1) / (total + types + 1)
            base += math.log10(p)
            known += counts[1][(s[j],)] > 0
            for k in range(2, min(order, j + 1) + 1):
                c = counts[k - 1][tuple(s[j - k + 1 : j])]
                m = a * max(c, 1) ** b
                p = (counts[k][tuple(s[j - k + 1 : j + 1])] + m * p) / (c + m)
            score += math.log10(p)
        out[(i, t)] = (len(s) - 1, known, total, base, score)
    return out


def test_against_counters(spark):
    df = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    for order, buckets in ((3, 5), (2, 3)):
        got = lm.score_documents(df, F.col("doc_id") % 3 != 0, order=order, buckets=buckets)
        want = brute(rows, lambda i: i is not None and i % 3 != 0, order)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(rows)
        by = {}
        for (i, t), w in want.items():
            by.setdefault(i, []).append(w)
        for i, held, n, known, total, base, score in found:
            assert held == (i is None or i % 3 == 0)
            assert any((n, known, total) == w[:3] and math.isclose(base, w[3], rel_tol=1e-9) and math.isclose(score, w[4], rel_tol=1e-9) for w in by[i])


def test_states_sum_to_one():
    """From any state the arcs and the failure arc give all words, seen or not, probability 1."""
    words = ["a", "b", "c"]
    text = "a b a b c a a b".split()
    uni, bi = Counter(text), Counter(zip(text, text[1:]))
    for context in words:
        total = 0.0
        for w in [*words, "unseen"]:
            machine = lm.BackoffAutomaton([np.array([0, uni[context], uni[w]]), np.array([0, 0, bi[(context, w)]])], len(text), len(uni), (3.0, 0.8))
            total += 10 ** (machine.arc[1][2] if bi[(context, w)] else machine.fail[0][2] + machine.arc[0][2])
        seen_after = sum(bi[(context, w)] for w in words)
        # a context at the text's end has one continuation fewer than its count
        m = 3.0 * uni[context] ** 0.8
        assert math.isclose(total, (seen_after + m) / (uni[context] + m), rel_tol=1e-9)


def test_empty_and_nothing_learned(spark):
    assert lm.score_documents(empty(spark), F.lit(True), buckets=2).count() == 0
    rows = lm.score_documents(table(spark, 5), F.lit(None).cast("boolean"), buckets=2).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)


def test_keys_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**48, 1000).astype(np.uint64))
    assert (lm.unsqueezed(lm.squeezed(keys, 48), 48) == keys).all()
    full = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    assert (lm.unsqueezed(lm.squeezed(full, 64), 64) == full).all()
    for most in (0, 200, 60_000, 10**7, 10**12):
        counts = np.array([0, most, 3])
        assert (lm.from_narrow(lm.narrow(counts)) == counts).all()
