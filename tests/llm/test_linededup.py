import re
from collections import defaultdict

from brindle.llm import linededup
from pyspark.sql import functions as F

from .rows import empty, table, words_of


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows, least=4):
    """{id: (exact, near, dropped)} by comparing each whole line with all before it."""
    units = sorted((i, j, tuple(w)) for i, t in set(rows) if i is not None for j, x in enumerate((t or "").lower().split("\n")) if (w := words_of(x)))
    seen, out = [], defaultdict(lambda: [0, 0, []])
    for i, j, w in units:
        earlier = [x for x in seen if x[:2] < (i, j)]
        same, close = any(x[2] == w for x in earlier), len(w) >= least and any(len(x[2]) >= least and near(x[2], w) for x in earlier)
        if same or close:
            out[i][0 if same else 1] += 1
            out[i][2].append(j)
        seen.append((i, j, w))
    return out


def check(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, **settings)
    got = linededup.line_drops(df, **settings).withColumn("dropped", linededup.dropped(F.col("gone"))).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    for r in got:
        w = want[r["doc_id"]] if r["doc_id"] is not None else [0, 0, []]
        assert (r["n_exact"], r["n_near"], r["dropped"]) == (w[0], w[1], ",".join(map(str, sorted(w[2]))))


def test_edits(spark):
    line = "the quick brown fox jumps over the lazy dog"
    w = line.split()
    variants = [line, " ".join(w[:4] + w[5:]), " ".join(w[:2] + ["red"] + w[3:]), " ".join(w[:6] + ["very"] + w[6:]), " ".join(w[1:] + w[:1]), " ".join(w[:2] + ["red"] + w[3:7] + ["old"] + w[8:]), line.upper() + "  ", "a b c", "a b c", " ".join(w[:-1]), " ".join(["so", *w])]
    rows = [(i, v + "\nunique line number " + "x" * i) for i, v in enumerate(variants)]
    rows += [(100 + i, f"copyright {2000 + i} by the authors of it") for i in range(30)]  # one word changed in many
    rows += [(50, "\n".join(reversed(variants))), (51, None), (None, line)]
    check(spark, rows)


def test_long_lines(spark):
    """One word put in, left out or changed anywhere in lines of any length."""
    for n in (31, 33, 300, 1500):
        w = [f"w{i % 97}" for i in range(n)]
        rows = [(1, " ".join(w)), (2, " ".join([*w[:5], "put", *w[5:]])), (3, " ".join(w[: n - 3] + w[n - 2 :])), (4, " ".join([*w[: n // 2], "other", *w[n // 2 + 1 :]])), (5, " ".join(w[3:])), (6, " ".join(["x", *w[1:-1], "y"])), (7, " ".join([*w, "end"])), (8, " ".join(w[1:]))]
        check(spark, rows, least=3)


def test_repeated_words(spark):
    check(spark, [(1, "a a a a a"), (2, "a a a a"), (3, "a a a a a a a"), (4, "a a b a a"), (5, "b a b a b"), (6, "a b a b a"), (7, "a b a b"), (8, "b a b a")])


def test_short_and_common_lines(spark):
    """Equal lines of any length go but the first; a common line is looked up apart."""
    rows = [(i, f"Menu\nall rights reserved by us\nown line {i} of document number {i} {'z' * i}\na b") for i in range(400)] + [(1000, "a\nb\nmenu "), (1001, "a c\nall rights reserved by them")]
    check(spark, rows)


def test_words_before_and_behind(spark):
    pairs = [("a b c d", "a x c d", 2, 0, True), ("a b c d", "x b c d", 1, 0, True), ("a b c d", "a b c x", 4, 0, True), ("a b c d", "a x c e", 2, 0, False), ("a b c", "a b x c", 3, 1, True), ("a b c", "a b c x", 4, 1, True), ("x a b c", "a b c", 1, -1, True), ("a b c d", "a b d", 2, -1, False), ("a b c d", "a b c", 2, 0, False)]
    df = spark.createDataFrame(pairs, "a string, b string, at int, kind int, want boolean")
    assert df.where(~linededup.one_edit(F.col("a"), F.col("b"), F.col("at"), F.col("kind")).eqNullSafe(F.col("want"))).count() == 0


def test_any_rows(spark):
    df = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    ids = [i for i, _ in rows]
    unique = [r for r in rows if ids.count(r[0]) == 1]
    check(spark, unique)
    assert linededup.line_drops(empty(spark)).count() == 0


def test_dropping(spark):
    df = spark.createDataFrame([(1, "keep this line here\nshort\nkeep this line here", 5), (2, "Keep this line there\nown words are kept", 6), (3, None, 7)], "doc_id long, text string, dropped int")
    drops = linededup.line_drops(df)
    out = {r["doc_id"]: r["text"] for r in linededup.drop_lines(df.drop("dropped"), drops).collect()}
    assert out == {1: "keep this line here\nshort", 2: "own words are kept", 3: None}


def test_dropping_from_unlike_rows_of_an_id(spark):
    df = spark.createDataFrame([(1, "one line of words"), (2, "one line of words\nx"), (2, "another text here now\ny"), (None, "one line of words")], "doc_id long, text string")
    out = linededup.drop_lines(df, linededup.line_drops(df)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == [(0, "one line of words"), (1, "one line of words"), (2, "another text here now\ny"), (2, "x")]


def test_only_expressions(spark):
    plan = linededup.line_drops(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
