"""Queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as op8
from . import jaccard as op10
from . import langid as op9
from . import linededup as op5
from . import lm as op1
from . import mixing as op3
from . import pii as op2
from . import quality as op4
from . import rules as op7
from . import tokens as op6
from .storage import small_batches

#: Of the tokenizer byte_bpe_50k.json.
VOCABULARY = 50257


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return op1.score_documents(_read(spark, sf_dir, "documents"), remainder != 2)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op2.find_pii(_read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    # spans and their digest have the kinds of the base patterns; secrets are counted beside them
    secret = F.lit(op2.ALL.index("secret"))
    listed = F.array_sort(F.concat("base", plain(F.filter("more", lambda s: s["k"] != secret))))
    digest = F.sha2(op2.joined(F.col("base")).cast("binary"), 256)
    found = found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(op2.KINDS)], digest.alias("base_sha256"), op2.joined(listed).alias("spans"), "base", "more")
    more = F.size("more").cast("long")
    return found.select(*found.columns[:-2], more.alias("n_added"), F.size(F.filter("more", lambda s: s["k"] == secret)).cast("long").alias("n_secret"), (F.size("base").cast("long") + more).alias("n_found"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op3.mix_sources(_read(spark, sf_dir, "documents"))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position")
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = op4.fit(docs, _read(spark, sf_dir, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0))
    return op4.quality(docs, model)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op5.line_drops(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_units", "n_exact", "n_near", op5.dropped(F.col("gone")).alias("dropped"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.tokenize(_read(spark, sf_dir, "documents"), tokenizer_path(), VOCABULARY)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.quality_rules(_read(spark, sf_dir, "documents"), with_text=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    near = F.sha2(F.concat_ws(",", "near").cast("binary"), 256).alias("near_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", near)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = op9.fit(docs.where(remainder != 1), key=F.col("doc_id"))
    found = op9.predict(docs, model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.jaccard_components(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_score, op2_pii, op3_mix, op4_quality, op5_line_dedup, op6_token_ids, op7_quality_rules, op8_decontaminate, op9_language_id, op10_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.sql()
