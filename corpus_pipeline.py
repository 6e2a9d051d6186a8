"""A corpus pipeline out of five operators: quality, near-duplicates, decontamination, personal data, mixing.

Each stage takes all that its predecessor kept and returns the columns of documents; the last adds ``copy``. Rows
are told apart by id and text, so rows that repeat both fare alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import decontaminate, mixing, near_dedup, pii, quality
from sparkwarden.llm.session import delete, durable, shared_dir

#: Rejected rows (some 60 bytes each) up to which they are broadcast.
FEW = 250_000
#: No SQL draws the mix or fits the classifiers; tests compare the stages with plain versions.
ORACLE_SQL = None


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with each row's key, in a column of a name that docs hasn't."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, decontaminate.row_key()), name


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for the rows of rejected (row: a row_key)."""
    rejected = durable(rejected.distinct())
    if rejected.count() <= FEW:
        rejected = F.broadcast(rejected)
    keyed, name = _named(docs)
    return keyed.join(rejected.withColumnRenamed("row", name), name, "left_anti").select(*docs.columns)


def _key(found: DataFrame) -> F.Column:
    """The row_key of rows that have doc_id and version."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "version")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality classifier rejects; null and empty texts are judged by their statistics like others, equal texts alike.

    Other columns, whatever their names, stay as they are; an empty table stays empty.
    """
    scored = quality.score_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 0").select(_key(scored).alias("row")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, of its least id (none is the greatest); rows without shingles, as of null or empty texts, stay all.

    Rows that repeat an id are told apart by their texts. Other columns, whatever their names, stay as they are.
    """
    found = near_dedup.marked_rows(docs.select("doc_id", "text"))
    found = durable(found.select(_key(found).alias("row"), "doc_id", "kept", "tree"))
    kept = found.where("kept and tree is not null")
    again = durable(kept.groupBy("tree").count().where("count > 1").select("tree"))
    several = again.count()
    if several == 0:
        return _without(docs, found.where("not kept").select("row"))
    if several <= FEW:
        again = F.broadcast(again)
    rivals = durable(kept.join(again, "tree"))
    first = rivals.groupBy("tree").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    drawn = rivals.join(first, "tree").select("row", (F.col("row") == F.col("first.row")).alias("stays"))
    marks = durable(found.where("not kept").select("row", F.lit(False).alias("stays")).unionByName(drawn).distinct())
    if marks.count() <= FEW:
        marks = F.broadcast(marks)
    keyed, name = _named(docs)
    stays = name + "stays"
    marked = keyed.join(marks.select(F.col("row").alias(name), F.col("stays").alias(stays)), name, "left")
    one = marked.where(F.col(stays)).dropDuplicates([name])
    return marked.where(F.col(stays).isNull()).select(*docs.columns).unionByName(one.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of the benchmark. Null and empty texts hold none; rows that repeat fare alike; other columns stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated_words(docs.select(decontaminate.row_key().alias("row"), "text"), items)
    return _without(docs, found.where("n_hit > 0").select("row"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data masked, and n_chars of the new text (0 of null). Other columns stay as they are."""
    masked = pii.redact_pii(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; copy (mix_copy, if docs has a copy) counts from 1. Null and empty texts have no words and are never taken.

    Rows alike in id, text and source share the copies that the mix takes of them.
    """
    taken = mixing.mix(docs.select("doc_id", "text", "source")).where("copies > 0").groupBy("doc_id", "version", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("none"))
    key = lambda version: F.struct(part("doc_id"), version, part("source"))
    taken = durable(taken.select(key(F.col("version")).alias("_key"), F.col("copies").alias("_copies"), "rows"))
    keyed, name = _named(docs)
    keyed = keyed.withColumn(name, key(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    if not taken.where("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates([name])
    taken = taken.select(F.col("_key").alias(name), F.col("_copies").alias(name + "copies"))
    if taken.count() <= FEW:
        taken = F.broadcast(taken)
    copy = "mix_copy" if "copy" in docs.columns else "copy"
    numbers = F.sequence(F.lit(1), F.col(name + "copies").cast("int"))
    return keyed.join(taken, name).select(*docs.columns, F.explode(numbers).alias(copy))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's rows are deleted once the next one has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before is not None:
            delete(spark, before)
        before = f"{base}/{name}"
    return docs
