from pyspark.sql import functions as F

from brindle.functions import markdown, redact, text
from brindle.operators import chat, metrics, state


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_redaction(spark):
    clean = lambda s: one(spark, redact.redact(F.col("s")), s=s)
    assert clean("Authorization: Bearer abc.def") .count(redact.MASK) >= 1
    assert clean("x?token=abc&b=1") == f"x?token={redact.MASK}&b=1"
    assert clean("postgres://u:p@h/db") == f"postgres://{redact.MASK}@h/db"
    assert clean('password = "hunter two" ok') == f"password = {redact.MASK} ok"
    assert clean("nothing here") == "nothing here"
    masked = one(spark, F.to_json(redact.mask_map(F.create_map(F.lit("Api-Key"), F.col("s"), F.lit("name"), F.col("s")))), s="bob")
    assert masked == f'{{"Api-Key":"{redact.MASK}","name":"bob"}}'


def test_bytes(spark):
    cut = lambda s, n: one(spark, text.truncate_bytes(F.col("s"), n), s=s)
    for n in range(8):
        assert cut("aé한b", n) == "aé한b".encode()[:n].decode(errors="ignore")


def test_markdown():
    assert markdown.render("# Hi\n\n\n\n**b** and *i* ~~s~~") .startswith("【Hi】\n\n𝗯 and 𝘪 s̶")
    assert markdown.render("- a\n  - [ ] b\n1 > 0") == "• a\n  ✖ b\n1 > 0"
    assert markdown.render("```py\nx*y*\n```") == "┌─── py\n│ x*y*\n└───"
    assert markdown.render("|a|b|\n|-|-|\n|1|2|") == "• a: 1\n  b: 2"
    assert markdown.render(r"\*no\* `a*b*` https://x.y/_z_") == "*no* ⦗a*b*⦘ https://x.y/_z_"
    assert markdown.render(None) is None
    assert markdown.code_ranges("a `b` c") == [(2, 5)]


def test_instruction_order(spark):
    rows = [(1, 0, "user", "hi", False), (1, 1, "system", "late", False), (2, 0, "system", "a", False), (2, 1, "developer", "b", True), (2, 2, "user", "u", False)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string, cache_breakpoint boolean")
    got = {r["conv_id"]: r for r in chat.adapt(df, "single_system").collect()}
    assert got[1]["error"] == "invariant_after_history" and got[1]["messages"] is None
    first = got[2]["messages"][0]
    assert (first["role"], first["cache_breakpoint"]) == ("system", True)
    assert first["content"] == f"{chat.INVARIANTS}\na\n\n{chat.DEVELOPER}\nb"
    assert [m["role"] for m in got[2]["messages"]] == ["system", "user"]


def test_backoff(spark):
    df = spark.range(70).select(state.backoff(F.lit(3).cast("long"), F.lit(10_000).cast("long"), F.col("id").cast("int")).alias("d"))
    assert [r["d"] for r in df.collect()] == [min(3 * 2**i, 10_000) for i in range(70)]


def test_histogram_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (7.0,)], "v double")
    rows = metrics.histograms(df, F.create_map(F.lit("a"), F.lit("b")), F.col("v"), [1.0, 5.0]).collect()
    assert {r["le"]: (r["cumulative"], r["total"]) for r in rows} == {1.0: (1, 3), 5.0: (1, 3), None: (3, 3)}


def test_openers_equal_a_walk(spark):
    import random

    r = random.Random(1)
    rows = [(i, f"k{r.randrange(3)}", r.randrange(400)) for i in range(200)]
    got = {x["seq"]: x["opened_at"] for x in state.openers(spark.createDataFrame(rows, "seq int, key string, ts long"), "key", "ts", "seq", 20).collect()}
    last = {}
    for seq, key, ts in sorted(rows, key=lambda x: (x[2], x[0])):
        if key not in last or ts >= last[key] + 20:
            last[key] = ts
        assert got[seq] == last[key]


def test_guarded_entry_without_llm():
    """Without the llm subpackage the entry module still gives its other queries."""
    import subprocess
    import sys

    code = (
        "import sys, importlib.util as u\nreal = u.find_spec\n"
        "u.find_spec = lambda n, p=None: None if n in ('brindle.llm', 'corpus_pipeline') else real(n, p)\n"
        "import __spark_entry__ as e\nassert 'inbox_heads' in e.queries() and not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries()\nassert not any(m.startswith('brindle.llm') for m in sys.modules)"
    )
    from pathlib import Path

    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
