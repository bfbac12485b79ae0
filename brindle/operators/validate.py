"""Validators that return problem rows: migration manifests, ledgers, worker profiles, registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns and ranges of profiles.
WORKER_ID, PROFILE_ID = r"^[a-z][a-z0-9_-]{0,62}\z", r"^[a-z0-9][a-z0-9._-]{0,127}\z"
MODES = ("bounded", "unbounded", "disabled")


def manifest(lines: DataFrame, number: str = "line_no", line: str = "line") -> DataFrame:
    """Entries (line_no, ordinal, filename, problem) of `NNN file.sql` lines; blank lines and # comments don't count.

    problem: malformed, not_ascending (compared as numbers, against the entry before) or duplicate.
    """
    text = F.trim(F.col(line))
    rows = lines.withColumn("_t", text).where((F.col("_t") != "") & ~F.startswith("_t", F.lit("#")))
    rows = rows.withColumn("ordinal", F.nullif(F.regexp_extract("_t", r"^([0-9]+)[ \t]+\S+\.sql\z", 1), F.lit("")).cast("decimal(38,0)")).withColumn("filename", F.nullif(F.regexp_extract("_t", r"^[0-9]+[ \t]+(\S+\.sql)\z", 1), F.lit("")))
    # a manifest is one small file
    before = F.max("ordinal").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1))
    again = F.row_number().over(Window.partitionBy("filename").orderBy(number)) > 1
    problem = F.when(F.col("filename").isNull(), "malformed").when(before >= F.col("ordinal"), "not_ascending").when(again, "duplicate")
    return rows.select(number, F.col("ordinal").cast("long").alias("ordinal"), "filename", problem.alias("problem"))


def pending(entries: DataFrame, ledger: DataFrame, only: list[str] = ()) -> DataFrame:
    """Manifest files that the ledger lacks, or the named ones of them."""
    left = entries.where("problem IS NULL").join(ledger.select("filename"), "filename", "left_anti")
    return left.where(F.col("filename").isin(*only)) if only else left


def record(ledger: DataFrame, applied: DataFrame) -> DataFrame:
    """The ledger with what was applied; the first record of a file stays."""
    both = ledger.select("filename", "applied_at").unionByName(applied.select("filename", "applied_at"))
    return both.groupBy("filename").agg(F.min("applied_at").alias("applied_at"))


def quote_identifier(c: Column) -> Column:
    """An SQL identifier in double quotes; null if it is no plain name."""
    return F.when(c.rlike(r"^[A-Za-z_][A-Za-z0-9_$]{0,62}\z"), F.concat(F.lit('"'), c, F.lit('"')))


def duration_problem(mode: Column, milliseconds: Column, most: int = 86_400_000) -> Column:
    return F.when(~F.coalesce(mode.isin(*MODES), F.lit(False)), "mode").when((mode == "bounded") & F.coalesce(~milliseconds.between(1, most), F.lit(True)), "range").when((mode != "bounded") & milliseconds.isNotNull(), "unexpected_value")


def exact_members(doc: Column, names: tuple[str, ...]) -> Column:
    """Null if a JSON object has exactly the members; else unknown:..., missing:... or not_object."""
    keys = F.json_object_keys(doc)
    wanted = F.array(*[F.lit(n) for n in names])
    unknown, missing = F.array_sort(F.array_except(keys, wanted)), F.array_sort(F.array_except(wanted, keys))
    return F.when(keys.isNull(), "not_object").when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(unknown, ","))).when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))).when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate")


_WORKER = "struct<executor:struct<enabled:boolean,configured_workers:int,attempt_timeout:struct<mode:string,milliseconds:bigint>>,queue:struct<capacity:struct<mode:string,items:bigint>,max_age:struct<mode:string,milliseconds:bigint>>>"


def profile_problems(profiles: DataFrame, id_col: str, doc: str) -> DataFrame:
    """(id, worker, problem) of worker profiles as JSON text; worker is empty for the document itself."""
    c = F.col(doc)
    rows = profiles.select(F.col(id_col).alias("id"), c.alias("doc")).withColumn("p", F.from_json("doc", f"struct<contract_version:int,service:string,role:string,profile_id:string,workers:map<string,{_WORKER}>>"))
    own = F.array_compact(F.array(
        exact_members(F.col("doc"), ("contract_version", "service", "role", "profile_id", "workers")), F.when(F.coalesce(F.col("p.contract_version") != 1, F.lit(True)), "version"),
        F.when(~F.coalesce(F.col("p.profile_id").rlike(PROFILE_ID), F.lit(False)), "profile_id"), F.when(F.coalesce(F.size("p.workers"), F.lit(0)) == 0, "no_workers"),
    ))
    whole = rows.select("id", F.lit("").alias("worker"), F.explode(own).alias("problem"))
    e = rows.select("id", F.explode("p.workers").alias("worker", "w"))
    each = F.array_compact(F.array(
        F.when(~F.col("worker").rlike(WORKER_ID), "worker_id"), F.when(F.col("w.executor.enabled") & F.coalesce(F.col("w.executor.configured_workers") < 1, F.lit(True)), "workers"),
        F.concat(F.lit("timeout_"), duration_problem(F.col("w.executor.attempt_timeout.mode"), F.col("w.executor.attempt_timeout.milliseconds"))),
        F.concat(F.lit("capacity_"), duration_problem(F.col("w.queue.capacity.mode"), F.col("w.queue.capacity.items"), 1 << 20)),
        F.concat(F.lit("max_age_"), duration_problem(F.col("w.queue.max_age.mode"), F.col("w.queue.max_age.milliseconds"))),
    ))
    return whole.union(e.select("id", "worker", F.explode(each).alias("problem")))


def shape_problems(expected: DataFrame, actual: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, problem) of a full outer comparison: missing, unexpected or the name of a field that differs."""
    a = expected.select(F.col(key).alias("a_key"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = actual.select(F.col(key).alias("b_key"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full")
    differs = [F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]
    found = F.when(F.col("b_key").isNull(), F.array(F.lit("missing"))).when(F.col("a_key").isNull(), F.array(F.lit("unexpected"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select(F.coalesce("a_key", "b_key").alias(key), F.explode(found).alias("problem"))


def registration_problems(df: DataFrame, known: list[str]) -> DataFrame:
    """(worker, problem) of registrations (worker, runtime, backend, scope)."""
    df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("worker")))
    found = F.array_compact(F.array(
        F.when(~F.col("worker").isin(*known), "unknown_worker"), F.when(F.col("_n") > 1, "duplicate"), F.when(~F.col("runtime").isin("go", "python", "jvm"), "runtime"), F.when(~F.col("backend").isin("memory", "postgres", "none"), "backend"),
        F.when(~F.col("scope").isin("process", "service", "shared"), "scope"), F.when((F.col("backend") == "memory") & (F.col("scope") != "process"), "memory_scope"),
    ))
    return df.select("worker", F.explode(found).alias("problem")).distinct()


def sealed_problems(df: DataFrame, known: list[str]) -> DataFrame:
    """(worker, problem) that keep registrations from being sealed: a known worker that is missing, or (worker empty) more than one runtime."""
    wanted = df.sparkSession.createDataFrame([(k,) for k in known], "worker string")
    missing = wanted.join(df.select("worker"), "worker", "left_anti").select("worker", F.lit("missing").alias("problem"))
    mixed = df.agg(F.count_distinct("runtime").alias("n")).where("n > 1").select(F.lit("").alias("worker"), F.lit("mixed_runtimes").alias("problem"))
    return missing.union(mixed)


def settings_problems(df: DataFrame, id_col: str, doc: str, schema: dict) -> DataFrame:
    """(id, path, problem) of settings as JSON text against a schema of nested dicts whose leaves are "value" or "optional".

    An object must have exactly the schema's members (keys); null stands only for an optional
    leaf (null).  What is below an object with other keys isn't looked at.
    """

    def found(raw: Column, want: dict, path: str, ok: Column) -> list[Column]:
        names = F.array(*[F.lit(n) for n in sorted(want)])
        fits = F.coalesce(F.array_sort(F.json_object_keys(raw)) == names, F.lit(False))
        out = [F.when(ok & ~fits, F.struct(F.lit(path).alias("path"), F.lit("keys").alias("problem")))]
        for name in sorted(want):
            value = F.get_json_object(raw, f"$.{name}")
            if isinstance(want[name], dict):
                out += found(value, want[name], f"{path}.{name}", ok & fits)
            elif want[name] != "optional":
                out.append(F.when(ok & fits & value.isNull(), F.struct(F.lit(f"{path}.{name}").alias("path"), F.lit("null").alias("problem"))))
        return out

    every = F.array_compact(F.array(*found(F.col(doc), schema, "settings", F.lit(True))))
    return df.select(F.col(id_col).alias("id"), F.explode(every).alias("p")).select("id", "p.*")
