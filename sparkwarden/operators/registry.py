"""The registry of model runs, as a small table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, model_type string, version string, status string, artifact_dir string, created_at timestamp, metrics map<string,double>"


def insert(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs with new ones in staging; a missing version is the run's id."""
    return runs.unionByName(new.withColumn("status", F.lit("staging")).withColumn("version", F.coalesce("version", "run_id")))


def promote(runs: DataFrame, run_id: str) -> DataFrame:
    """The run in production, and what was in production of its type archived. An unknown id raises."""
    found = runs.where(F.col("run_id") == run_id).select("model_type").first()
    if found is None:
        raise KeyError(run_id)
    other = (F.col("model_type") == found[0]) & (F.col("status") == "production")
    return runs.withColumn("status", F.when(F.col("run_id") == run_id, "production").when(other, "archived").otherwise(F.col("status")))


def archive(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.withColumn("status", F.when(F.col("run_id") == run_id, "archived").otherwise(F.col("status")))


def update_metrics(runs: DataFrame, run_id: str, metrics: dict[str, float]) -> DataFrame:
    """The run's metrics with new ones, which win."""
    new = F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv]).cast("map<string,double>")
    old = F.map_filter(F.coalesce("metrics", F.create_map().cast("map<string,double>")), lambda k, v: ~F.map_contains_key(new, k))
    return runs.withColumn("metrics", F.when(F.col("run_id") == run_id, F.map_concat(old, new)).otherwise(F.col("metrics")))


def find(runs: DataFrame, model_type: str | None = None, status: str | None = None, limit: int = 50, run_id: str | None = None, artifact_dir: str | None = None) -> DataFrame:
    """Runs, the newest first; by type, status, id or the folder of their artefacts."""
    for name, value in (("model_type", model_type), ("status", status), ("run_id", run_id), ("artifact_dir", artifact_dir)):
        if value is not None:
            runs = runs.where(F.col(name) == value)
    return runs.orderBy(F.desc("created_at"), "run_id").limit(limit)


def production(runs: DataFrame, model_type: str) -> DataFrame:
    return find(runs, model_type, "production", 1)


def manifest(files: DataFrame) -> DataFrame:
    """(path, size_mb, sha256_prefix) of files read as binaryFile."""
    return files.select("path", F.round(F.col("length") / (1024 * 1024), 3).alias("size_mb"), F.left(F.sha2("content", 256), F.lit(16)).alias("sha256_prefix"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status): ok, missing, extra or changed."""
    e, a = expected.select("path", F.col("sha256_prefix").alias("e")), actual.select("path", F.col("sha256_prefix").alias("a"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") != F.col("e"), "changed").otherwise("ok")
    return e.join(a, "path", "full").select("path", status.alias("status"))


def mismatches(expected: DataFrame, actual: DataFrame, strict: bool = False, shown: int = 20) -> DataFrame:
    """(path, status) of artifacts that are missing or changed, to be looked at before models are loaded. strict: any of them raises, and the first ``shown`` are named."""
    bad = verify(expected, actual).where(F.col("status").isin("missing", "changed"))
    if strict and (first := bad.orderBy("path").take(shown)):
        raise ValueError("artifacts differ from the manifest: " + ", ".join(f"{r.path} ({r.status})" for r in first))
    return bad


def run_id(at: Column, *content: Column) -> Column:
    """yyyyMMdd-HHmmss and eight digits of a hash of what the run is made of: the same run has the same id."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd-HHmmss"), F.lit("-"), F.left(F.sha2(F.concat_ws("|", at.cast("string"), *content), 256), F.lit(8)))


class Store:
    """A registry in a folder: immutable versions, and one file that names the current one.

    ``update`` holds a lock file that only one writer can make, writes a new version and then replaces the name by a rename; readers see
    the old or the new one, never a part. A writer that dies leaves the lock, which ``unlock`` takes away.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._paths(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._paths(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        if not self.fs.exists(self._at("CURRENT")):
            return self.spark.createDataFrame([], SCHEMA)
        version = self.spark.read.text(f"{self.path}/CURRENT").first()[0]
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{version}")

    def update(self, change) -> None:
        """Replaces the runs by change(runs); raises if another writer holds the lock."""
        try:
            self.fs.create(self._at("LOCK"), False).close()
        except Exception as e:
            raise RuntimeError(f"{self.path} is locked") from e
        try:
            version = f"version-{uuid.uuid4().hex}"
            change(self.read()).select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.parquet(f"{self.path}/{version}")
            name = self.fs.create(self._at("NEXT"), True)
            name.write(bytearray(version, "utf-8"))
            name.close()
            old, new = self._at("CURRENT"), self._at("NEXT")
            if not self.fs.rename(new, old):  # stores whose rename doesn't replace
                self.fs.delete(old, False)
                self.fs.rename(new, old)
        finally:
            self.unlock()

    def unlock(self) -> None:
        self.fs.delete(self._at("LOCK"), False)


def promote_artifacts(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copies a run's folder to where production reads it, and gives what ``verify`` says of the copy. The old folder is replaced only by a whole new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    new, old = at(target.rstrip("/") + ".new"), at(target)
    fs = old.getFileSystem(conf)
    fs.delete(new, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(at(source).getFileSystem(conf), at(source), fs, new, False, conf)
    fs.delete(old, True)
    fs.rename(new, old)
    named = lambda path: manifest(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)).withColumn("path", F.substring_index("path", "/", -1))
    return verify(named(source), named(target))
