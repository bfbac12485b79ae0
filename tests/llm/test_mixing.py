import hashlib
import math

from pyspark.sql import functions as F

from brindle.llm import mixing

from .rows import WORD, empty, table


def shares(sizes, weights=(1, 2, 3), cap=3.0):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        target = {s: cap * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_targets_and_takes(spark):
    df = table(spark)
    rows = df.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    want = shares(sizes)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"])
        assert (r["first_position"] is None) == (r["taken"] == 0)
        assert all(0 <= p["position"] <= 1 for p in r["passes"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    again = {tuple(r[:7]) for r in mixing.mix_sources(df.repartition(2)).collect()}
    assert again == {tuple(r[:7]) for r in got}


def test_caps_and_zero_sizes(spark):
    rows = [(1, "a " * 10, "a"), (2, "a " * 1000, "b"), (3, None, "c"), (4, "a", "d")]
    got = {r["source"]: r["target"] for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    want = shares({"a": 10, "b": 1000, "c": 0, "d": 1})
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_schedule_is_followed(spark):
    """In a source with a rising density, half of its words come after the time by which half of the integral is reached."""
    rows = [(i, "w " * 50, "a") for i in range(400)]
    knots = (((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),)
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id int, text string, source string"), schedules=knots)
    order = mixing.training_order(mixed).collect()
    positions = [r["position"] for r in order]
    assert positions == sorted(positions) and len(order) == 400
    early = sum(p <= 0.5 for p in positions) / 400
    assert abs(early - 0.375) < 0.01  # (0.5 + 1.0) / 2 * 0.5 of 1


def test_empty(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, None)], "doc_id int, text string, source string")
    assert mixing.mix_sources(nothing).select("size", "target", "taken").collect() == [(0, 0.0, 0)]


def test_order_is_by_digest(spark):
    rows = [(i, "w " * 10, "a") for i in range(20)] + [(99, "w " * 1000, "b")]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    first = mixed.where("source = 'a'").orderBy(F.col("passes")[0]["position"]).select("doc_id").collect()
    assert [r[0] for r in first] == sorted(range(20), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
