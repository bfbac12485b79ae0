"""Log records, wire forms, folds, files and the queue operators that answer for each other."""

import json
import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import records, wire
from brindle.operators import metrics, outbox, queue, state, validate
from brindle.sources import files


@pytest.mark.parametrize(
    "value,want",
    [(1.0, "1"), (0.0, "0"), (-2.5, "-2.5"), (100000.0, "100000"), (1000000.0, "1e+06"), (1234567.5, "1.2345675e+06"), (0.0001, "0.0001"), (0.00001, "1e-05"), (1.5e-7, "1.5e-07"), (1e21, "1e+21"), (1.25e100, "1.25e+100"), (123.456, "123.456"), (math.inf, "+Inf"), (-math.inf, "-Inf"), (math.nan, "NaN")],
)
def test_float_text(spark, value, want):
    assert spark.createDataFrame([(value,)], "x double").select(wire.float_text(F.col("x"))).first()[0] == want


def test_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(wire.duration_text(F.lit(n))) for n in (0, 59, 60, 3723, -61)] == ["0s", "59s", "1m0s", "1h2m3s", "-1m1s"]
    assert one(wire.escape_date_lists(F.lit("2024. 5. a\n2024.5. b\n\t1999. 12. c\n    2024. 5. d\n2024. 123. e"))) == "2024\\. 5. a\n2024.5. b\n\t1999\\. 12. c\n    2024. 5. d\n2024. 123. e"
    assert one(wire.limited(F.lit("é" * 3), 6)) == "ééé" and one(wire.limited(F.lit("é" * 3), 5)) is None
    assert one(wire.generation_of(F.lit("a"), F.lit("a:r3"), 3)) == 3 and one(wire.generation_of(F.lit("a"), F.lit("a:r4"), 3)) is None and one(wire.generation_of(F.lit("a"), F.lit("a"), 3)) == 0


@pytest.mark.parametrize("body,kind,want", [("{}", "application/json", None), ("{} x", None, (400, "invalid_json")), ("1, 2", None, (400, "invalid_json")), ("", None, (400, "invalid_request")), (None, "text/html", (400, "invalid_request")), ('"' + "x" * 99 + '"', "", (413, "request_entity_too_large")), ("{", "application/jsonx", (415, "unsupported_media_type"))])
def test_requests(spark, body, kind, want):
    got = spark.createDataFrame([(body, kind)], "b string, k string").select(wire.request_problem(F.col("b"), F.col("k"), 64)).first()[0]
    assert (got and tuple(got)) == want


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0, 5_000_000, None), (2, " ", 1000, None, None), (3, "b", 0, 1999, "x")], "id long, name string, s long, e long, err string")
    got = sorted((r["id"], r["event"], r["level"], r["duration_ms"]) for r in records.operation_events(rows, "name", "s", "e", "err").collect())
    assert got == [(1, "a.started", "INFO", None), (1, "a.succeeded", "INFO", 5000), (2, "operation.started", "INFO", None), (3, "b.failed", "ERROR", 1), (3, "b.started", "INFO", None)]
    records.write_log(rows, str(tmp_path / "log"), "s")
    assert json.loads(next((tmp_path / "log" / "day=1970-01-01").glob("*.json")).read_text().splitlines()[0])["id"] in (1, 2, 3)
    sunk = records.bounded_sink(spark.range(10).withColumn("b", F.lit(1)), "b", "id", 4)
    assert [r["id"] for r in sunk.where("written").orderBy("id").collect()] == [0, 1, 2, 3]


def brute_openers(rows, ttl):
    out, opened = {}, {}
    for key, ts, seq in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if key not in opened or ts >= opened[key] + ttl:
            opened[key] = ts
        out[seq] = opened[key]
    return out


def test_folds_over_many_batches(spark):
    """A key whose rows fill several Arrow batches, a null key, ties, an empty table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if i % 11 == 0 else i % 3 % 2, (i * 37) % 500, i) for i in range(300)]
        df = spark.createDataFrame(rows, "k long, ts long, seq long")
        assert {r["seq"]: r["opened_at"] for r in state.openers(df, "k", "ts", "seq", 40).collect()} == brute_openers(rows, 40)
        deltas = spark.createDataFrame([(i % 2, i, (i * 7) % 9 - 5) for i in range(100)], "k long, seq long, d long")
        want = {}
        for i in range(100):
            value, rejected = want.get(i % 2, (0, 0))
            d = (i * 7) % 9 - 5
            want[i % 2] = (value + d, rejected) if value + d >= 0 else (value, rejected + 1)
        assert {r["k"]: (r["value"], r["rejected"]) for r in state.gauge_fold(deltas, "k", "seq", "d").collect()} == want
        assert state.openers(df.limit(0), "k", "ts", "seq", 40).count() == 0 and state.gauge_fold(deltas.limit(0), "k", "seq", "d").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


OUTBOX = "id long, scope string, message_id string, phase string, ordinal int, payload_hash string"


def test_arrivals_see_each_other(spark):
    stored = spark.createDataFrame([(1, "s", "m", "p", 0, "h0"), (2, "s", "n", "p", 9, "h9")], OUTBOX)
    arrivals = [(1, "m", 2, "h1"), (2, "m", 1, "h2"), (3, "m", 2, "h3"), (4, "m", 2, "h1"), (5, "m", 1, "h2"), (6, "m", 0, "h0"), (7, "m", 3, "h4"), (8, "n", 9, "x"), (9, "n", 8, "x"), (10, "q", 0, "z"), (11, "q", 0, "z")]
    df = spark.createDataFrame([(i, "s", m, "p", o, h) for i, m, o, h in arrivals], OUTBOX.replace("id long", "seq long"))
    known, want = {("m", 0): "h0", ("n", 9): "h9"}, []
    for _, m, o, h in arrivals:
        if (m, o) in known:
            want.append("already_staged" if known[(m, o)] == h else "payload_diverged")
        elif any(a == m and b > o for a, b in known):
            want.append("ordinal_superseded")
        else:
            known[(m, o)] = h
            want.append("staged")
    assert [r["outcome"] for r in outbox.stage_outcomes(stored, df).orderBy("seq").collect()] == want


def test_recovery(spark):
    inbox = spark.createDataFrame([(1, "s", "m1", "processing", 1, "t", 5, "{}", 0, None, None), (2, "s", "m2", "pending", 0, None, None, "{}", 0, None, None)], "id long, scope string, message_id string, status string, attempts int, claim_token string, lease_until long, payload string, available_at long, terminal_at long, terminal_reason string")
    decided = spark.createDataFrame([(1, "m1", "t", 1, 5, "pending", ""), (1, "m1", "t", 1, 5, "completed", "x"), (2, "m2", "", 0, None, "completed", ""), (2, "m2", "", 7, None, "completed", "")], "id long, message_id string, claim_token string, attempts int, lease_until long, status string, reason string")
    after = queue.apply_recovery(inbox, decided, "s", 10).orderBy("id").collect()
    assert [(r["id"], r["status"], r["changed"]) for r in after] == [(1, "completed", True), (2, "completed", True)]
    assert tuple(queue.recovery_claims(inbox, decided, "s").first()) == (4, 2, True)
    assert tuple(queue.recovery_claims(inbox, decided.where("attempts < 7").limit(0), "s").first()) == (0, 0, False)


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("no")
    (tmp_path / "c.json").write_text('"' + "x" * files.MAX_PROFILE + '"')
    loaded = files.profile_files(spark, str(tmp_path / "*.json"))
    got = {r["path"][-6:]: (r["doc"], r["problem"]) for r in loaded.collect()}
    assert got == {"a.json": ('{"x": 1}', None), "b.json": (None, "not_json"), "c.json": (None, "oversize")}
    before = spark.createDataFrame([tuple(r) for r in loaded.select("path", "hash").collect()] + [("gone", "h")], "path string, hash string")
    (tmp_path / "a.json").write_text('{"x": 2}')
    drift = {r["path"][-6:]: (r["match"], r["error"]) for r in files.profile_drift(before, files.profile_files(spark, str(tmp_path / "*.json"))).collect()}
    assert drift == {"a.json": (False, None), "b.json": (True, "not_json"), "c.json": (False, "oversize"), "gone": (False, "missing")}
    (tmp_path / "corpus.jsonl").write_text('{"id": "1", "input": "x", "expected_rules": ["r"]}\nbroken\n')
    assert sorted((r["id"] or "", r["_broken"] or "") for r in files.corpus(spark, str(tmp_path / "corpus.jsonl")).collect()) == [("", "broken"), ("1", "")]


def test_settings_sources(tmp_path):
    (tmp_path / "secret").write_text("s3\n")
    assert files.setting({"A": "x"}, "A") == "x" and files.setting({"A_FILE": str(tmp_path / "secret")}, "A") == "s3" and files.setting({}, "A") is None
    with pytest.raises(ValueError):
        files.setting({"A": "x", "A_FILE": "y"}, "A")
    assert files.dotenv("# c\nexport A=1\nB='two words' \nC=x # note\n\nD=") == {"A": "1", "B": "two words", "C": "x", "D": ""}
    with pytest.raises(ValueError):
        files.dotenv("1A=2")
    (tmp_path / "q.sql").write_text(" SELECT {{x}} \n")
    assert files.compose(files.sql_assets(str(tmp_path))["q"], x="1") == "SELECT 1"
    (tmp_path / "r.sql").write_text(" \n")
    with pytest.raises(ValueError):
        files.sql_assets(str(tmp_path))
    with pytest.raises(ValueError):
        files.compose("{{y}}", x="1")


def test_expositions(spark):
    empty = metrics.webhook_exposition(spark.createDataFrame([], "kind string, s double"), "kind", "s", "x").orderBy("line_no").collect()
    assert empty[2]["line"] == "x_webhook_requests_total 0" and empty[-1]["line"] == "x_webhook_decode_latency_seconds_count 0"
    lines = spark.range(1).select(F.explode(metrics.summary_lines("f", "help", (0.5, 1), (F.lit(2.0), F.lit(1e7)), F.lit(3), F.lit(4.5)))).collect()
    assert [r[0] for r in lines] == ["# HELP f help", "# TYPE f summary", 'f{quantile="0.5"} 2', 'f{quantile="1"} 1e+07', "f_sum 4.5", "f_count 3"]


def test_settings_schema(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": 1}}'), (2, '{"a": null}'), (3, None), (4, '{"a": {"b": null}}')], "id int, doc string")
    got = sorted(map(tuple, validate.settings_problems(rows, "id", "doc", {"a": {"b": "value"}}).collect()))
    assert got == [(2, "settings.a", "keys"), (3, "settings", "keys"), (4, "settings.a.b", "null")]
