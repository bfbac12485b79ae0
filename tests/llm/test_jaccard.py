import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import jaccard as jc

from .rows import empty, table, words_of


def shingles(text, n=4):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    """{id: (set size, component)} by comparing all with all; ids are distinct."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def families(seed=1, n=25):
    """Families of near copies whose similarity lies about the threshold, shared passages, small sets."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(4000)
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([5, 8, 9, 12, 20, 60, 150]))]
        if r.random() < 0.4:
            base[2:2] = passage
        for _ in range(r.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                k = r.randrange(len(copy))
                copy[k : k + 1] = r.choice([[word()], [], [copy[k], word()]])
            out.append(" ".join(copy))
    return out


def test_against_all_pairs(spark):
    """Tiles so small that groups take several, and classes of different tiles must meet."""
    rows = [(i * 7 % 1009, t) for i, t in enumerate(families())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jc.jaccard_components(df, tile_bytes=600, buckets=4).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_any_rows(spark):
    df = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    ids = [i for i, _ in rows]
    once = [r for r in rows if r[0] is not None and ids.count(r[0]) == 1]
    got = {}
    for r in jc.jaccard_components(df, buckets=4).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    want = brute(once)
    grouped = {i for i, (n, c) in want.items() if c != i}
    assert grouped and all((want[i][0]) in {n for n, _ in got[i]} for i in want)
    assert got[None] == {(len(shingles("a row without an id that has words")), None)}
    assert jc.jaccard_components(empty(spark), buckets=4).count() == 0


def test_repeated_ids_keep_each_text(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jc.jaccard_components(df, buckets=4).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(6, 400), st.floats(0, 0.3))
def test_alike_sets_share_a_part(seed, size, changed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    keep = rng.random(len(a)) >= changed * 0.5
    b = np.unique(np.concatenate((a[keep], rng.integers(0, 2**63, int(changed * size * 0.5)).astype(np.uint64))))
    common = np.sort(rng.choice(a, len(a) // 3, replace=False)) if seed % 2 else np.zeros(0, np.uint64)
    both = len(np.intersect1d(a, b))
    if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
        assert len(np.intersect1d(jc.signatures(a, common), jc.signatures(b, common))) > 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_bit_counts_bound_the_overlap(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = (np.unique(rng.choice(pool, rng.integers(1, 250))) for _ in range(2))
    bound = min(len(a) - int(np.bitwise_count(jc.bitmap(a) & ~jc.bitmap(b)).sum()), len(b) - int(np.bitwise_count(jc.bitmap(b) & ~jc.bitmap(a)).sum()))
    assert jc.overlap(a, b) == len(np.intersect1d(a, b)) <= bound


def test_components(spark):
    import random as rnd

    r = rnd.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(20)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in jc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == root(n) for n in list(up))


def test_large_sets_always_meet():
    """Alike sets of large bands share a part, at the threshold too, with common elements left out and without."""
    r = np.random.default_rng(2)
    for share in (0.8, 0.85):
        for n in (300, 420, 700, 1500, 6000):
            for k in range(6):
                base = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
                gone = int(n * (1 - share) / (1 + share))  # as many are replaced
                a, b = np.sort(base[:n]), np.sort(np.concatenate((base[gone:n], base[n : n + gone])))
                if k % 2:  # a subset as small as can be
                    b = a[np.sort(r.choice(n, -(-int(n * share * 10000) // 10000) + 1, replace=False))]
                common = np.sort(base[: n // 2]) if k % 3 == 0 else np.zeros(0, np.uint64)
                assert len(np.intersect1d(a, b)) >= share * len(np.union1d(a, b)) - 1e-9
                assert len(np.intersect1d(jc.signatures(a, common, share), jc.signatures(b, common, share)))


def test_few_common_elements_of_large_sets_do_not_meet():
    r = np.random.default_rng(3)
    shared = r.integers(0, 1 << 63, 600, dtype=np.uint64)
    sets = [np.sort(np.concatenate((shared, r.integers(0, 1 << 63, 5400, dtype=np.uint64)))) for _ in range(12)]
    sent = [jc.signatures(s, np.zeros(0, np.uint64), 0.8) for s in sets]
    assert sum(len(np.intersect1d(a, b)) > 0 for k, a in enumerate(sent) for b in sent[:k]) <= 6


def test_chance_links_do_not_connect_unlike_documents(spark, monkeypatch):
    """Short texts of few words share single shingles by chance: in a large table parts of one shingle would connect most of them."""
    r = random.Random(11)
    word = lambda: "abcdefgh"[r.randrange(8)]
    texts = [" ".join(word() for _ in range(40)) for _ in range(4000)]
    near = {}
    for k in range(0, 400, 10):
        near[len(texts)] = k
        texts.append(texts[k] + " i")
    sizes = []

    def spied(edges, whole=jc.components):
        out = whole(edges)
        sizes.append(max((x["count"] + 1 for x in out.where("node <> root").groupBy("root").count().collect()), default=1))
        return out

    monkeypatch.setattr(jc, "components", spied)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x["component_id"] for x in jc.jaccard_components(df, words=5, share=0.8, buckets=4).collect()}
    assert {i: c for i, c in got.items() if c != i} == near
    assert sizes[0] < 100


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 500), st.floats(0, 0.3))
def test_whole_maps_never_drop_alike_sets(seed, size, changed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    b = np.unique(np.concatenate((a[rng.random(len(a)) >= changed * 0.5], rng.integers(0, 2**63, int(changed * size * 0.5)).astype(np.uint64))))
    c = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    if len(b) and jc.overlap(a, b) >= jc.least_overlap(len(a), len(b)):
        assert jc.may_be_alike(len(a), jc.whole_map(a), len(b), jc.whole_map(b)) and jc.may_be_alike(len(b), jc.whole_map(b), len(a), jc.whole_map(a))
    if size > 50:
        assert not jc.may_be_alike(len(a), jc.whole_map(a), len(c), jc.whole_map(c))


def test_common_shingles_are_counted_over_all_documents(spark):
    """Of 45000 documents, a shingle of 45 is common and one of 44 is not, wherever a sample would have looked."""
    ids = spark.range(45_000).selectExpr("id", "pmod(xxhash64(id), 2) = 0 AS half").collect()
    seen, unseen = [r["id"] for r in ids if r["half"]], [r["id"] for r in ids if not r["half"]]
    texts = {i: f"x{i} y{i}" for i in range(45_000)}
    texts |= {i: "just enough" for i in unseen[:45]} | {i: "one too few" for i in seen[:44]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    want = np.sort(jc.batch_shingles(pa.array(["just enough"]), 4)[0])
    assert np.array_equal(jc.common_shingles(df, 4), want)
    assert len(jc.common_shingles(empty(spark).select("doc_id", "text"), 4)) == 0


def test_ends_of_tasks_send_few_shingles(spark, monkeypatch):
    """What is left after the full chunks of a task isn't sent whole: of shingles that are in one document each, few go on."""
    docs, per_doc, in_common = 4000, 50, 100
    monkeypatch.setattr(jc, "CHUNK", 10_000)
    monkeypatch.setattr(jc, "MOST_COMMON", 2_000)  # common is what 100 documents have
    texts = [" ".join(f"w{i}x{k}" for k in range(per_doc + 3)) for i in range(docs)]
    for i in range(0, docs, docs // in_common):
        texts[i] = texts[i].rsplit(" ", 4)[0] + " a b c d"
    made, frame = [], type(spark.range(1))

    def spied(self, func, schema, *rest, whole=frame.mapInArrow, **named):
        out = whole(self, func, schema, *rest, **named)
        if schema == "h bigint, n bigint":
            made.append(out)
        return out

    monkeypatch.setattr(frame, "mapInArrow", spied)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(19)  # each a little more than a chunk
        want = np.sort(jc.batch_shingles(pa.array(["a b c d"]), 4)[0])
        assert np.array_equal(jc.common_shingles(df, 4), want)
        assert made[0].count() <= 19 * 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
