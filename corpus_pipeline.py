"""Documents to training tokens: language, near duplicates, benchmark passages, source mix, token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate as decontamination
from brindle.llm import jaccard, langid, mixing, tokens
from brindle.llm.queries import VOCABULARY, tokenizer_path
from brindle.llm.storage import cut, fresh_dir, remove_dir, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids up to which a table of them is broadcast (about 40 MB); beyond, both sides are shuffled.
SMALL = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised with calibrated confidence.

    Null, empty and letterless texts aren't recognised and go; texts are read whole, however
    long.  Repeated rows are judged each, a null id like any other (but isn't learned from).
    A table without a label recognises nothing; an empty one gives an empty result.  Columns
    beyond COLUMNS are left aside.
    """
    small_batches(spark)
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.fit(docs.where(remainder != 1), key=F.col("doc_id"))
    return langid.predict(docs, model, keep=COLUMNS).where("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of least id: five-word shingles that are alike by 0.8 or more.

    Rows are told apart by id and text.  Of rows of a group that share the least id, one
    stays (the least text hash); rows that repeat both id and text are one document, of which
    one stays.  Unlike rows of one id stay each.  Null and wordless texts are alike to nothing
    and stay, and so do rows of null id.  An empty table gives an empty result.
    """
    small_batches(spark)
    found = jaccard.jaccard_components(docs, words=5, share=0.8, with_hash=True).where("doc_id IS NOT NULL AND n_shingles > 0")
    found = cut(found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "component_id", "class_hash"))
    later = found.where("component_id <> f_id").select("f_id", "f_hash")
    # several rows of the least id of their group: all but one of them are copies too
    several = found.where("component_id = f_id").groupBy("f_id", "class_hash").agg(F.count(F.lit(1)).alias("n"), F.min("f_hash").alias("least")).where("n > 1")
    first = found.where("component_id = f_id").join(several, ["f_id", "class_hash"]).select("f_id", "f_hash", "least")
    copies = later.union(first.where("f_hash <> least").select("f_id", "f_hash")).distinct()
    keyed = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text"))
    kept = keyed.join(_small(copies), (F.col("doc_id") == F.col("f_id")) & (F.col("_hash") == F.col("f_hash")), "left_anti")
    repeated = first.where("f_hash = least").groupBy("f_id", "f_hash").count().where("count > 1").select("f_id", "f_hash")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    same = (F.col("doc_id") == F.col("f_id")) & (F.col("_hash") == F.col("f_hash"))
    once = kept.join(_small(repeated), same, "left_semi").dropDuplicates(["doc_id", "_hash"])
    return kept.join(_small(repeated), same, "left_anti").union(once).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str, least: int = decontamination.WINDOW) -> DataFrame:
    """Drops documents that hold a whole window of a benchmark item, however long they are, or a changed copy of an item.

    A document goes if `least` of its words or more (those of one window) are hit, if hits
    make up a twentieth of it, which is for items shorter than a window, or if an item is near.
    Null and wordless texts have no hits and stay; so do all documents if the benchmark is
    empty.  Repeated rows and rows of null id are judged each; an empty table gives an empty
    result.
    """
    small_batches(spark)
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where(F.col("contaminated") | (F.col("n_hit") >= least) | (F.col("n_near") > 0))
    bad = cut(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    keyed = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text"))
    return keyed.join(_small(bad), F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("_hash") == F.col("bad_hash")), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order; a pass counts if it takes half of the document or more.

    Null and wordless texts have no words to take and go.  Null sources are one source, null
    ids one id; rows that share an id are taken as often as the one of them that is taken
    most.  Ties of position go by id.  An empty table gives an empty result.
    """
    passes = F.filter("passes", lambda p: 2 * p["words"] >= F.col("size"))
    mixed = mixing.mix_sources(docs).select(F.col("doc_id").alias("m_id"), F.transform(passes, lambda p: p["position"]).alias("positions"))
    per_id = mixed.groupBy("m_id").agg(F.max("positions").alias("positions")).where(F.size("positions") > 0)
    taken = docs.join(_small(per_id), F.col("doc_id").eqNullSafe(F.col("m_id"))).select(*COLUMNS, F.explode("positions").alias("position"))
    return taken.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all texts as bit-packed token shards and reads back what each document has there: doc_id, start, n_tokens, ids_crc32.

    Null text is empty, and has the end id alone.  Repeated rows, which the mix makes, are
    written each, in order of id and text, null ids first.  An empty table gives an empty result.
    """
    small_batches(spark)
    return tokens.tokenize(docs, tokenizer_path(), VOCABULARY)


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("decontaminate", decontaminate), ("mix_sources", mix), ("token_ids", tokenize)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is kept in the shared folder until the next is done."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = fresh_dir(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        if last:
            remove_dir(spark, last)
        last = path if name != STAGES[-1][0] else None
    return docs
