"""Where lineage is cut and shared files go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine (tests) a folder of our own where that is unset."""
    jsc = spark.sparkContext._jsc.sc()
    known = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if not known and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = known or "file://" + tempfile.mkdtemp(prefix="brindle-checkpoint-")
        spark.sparkContext.setCheckpointDir(known)
    if not known:
        known = jsc.getCheckpointDir().get()
    return known


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the Arrow batches that Python workers get to `most` bytes, where the session has a larger bound: a batch is held in whole on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("b")) > most:
        spark.conf.set(name, str(most))


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes path by Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
