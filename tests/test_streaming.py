"""A stream in several batches gives the batch operator's rows."""

from brindle.operators import state
from brindle.streaming import keyed


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, f"k{i % 4}", 10**15 + ((i * 37) % 500 + i * 10) * 10**6) for i in range(120)]
    schema = "seq long, key string, ts long"
    for part in range(3):
        ordered = sorted(rows, key=lambda r: (r[2], r[0]))[part * 40 : part * 40 + 40]
        spark.createDataFrame(ordered, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame(rows, schema)
    for name, made, want in (
        ("set_once", keyed.set_once_stream(stream, "key", "ts", "seq", 90 * 10**6), state.set_once(batch, "key", "ts", "seq", 90 * 10**6).select("key", "seq", "accepted", "expires")),
        ("limited", keyed.limiter_stream(stream, "key", "ts", "seq", 90 * 10**6, 2), state.fixed_window(batch, "key", "ts", "seq", 90 * 10**6, 2).select("key", "seq", "window_start", "n", "allowed")),
    ):
        q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect()))
