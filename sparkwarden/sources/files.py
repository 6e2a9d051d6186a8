"""Readers of labelled lines, traces, vocabularies, pairs, tagged sentences, rules and techniques."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.rules import RULE_SCHEMA


def _numbered(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"))


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """(raw, label) of a file whose header is exactly that; a label other than 0 or 1, or an empty line, fails with its row."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if header.columns != ["raw", "label"]:
        raise ValueError(f"header is {header.columns}, not ['raw', 'label']")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("raw string, label string").csv(path)
    # A file of quoted lines isn't split, so rows number from 0 in each; the header is line 1. Raw text stays out of the message.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 2
    bad = F.concat(F.lit("label is not 0 or 1 in row "), row.cast("string"), F.lit(" of "), F.input_file_name())
    label = F.when(F.col("label").isin("0", "1"), F.col("label").try_cast("int")).otherwise(F.raise_error(bad).cast("int"))
    return rows.select("raw", label.alias("label"))


def labelled(spark: SparkSession, path: str, raw: str = "raw", label: str = "label", score: str | None = None) -> DataFrame:
    """(raw, label[, score]) of CSV or JSON lines, by the suffix."""
    rows = spark.read.json(path) if path.rstrip("/").endswith((".jsonl", ".json")) else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = rows.select(F.col(raw).alias("raw"), F.col(label).cast("int").alias("label"), *([F.col(score).cast("double").alias("score")] if score else []))
    return out.where("raw is not null and label is not null")


def label_map(df: DataFrame, message: str = "message", label: str = "label") -> DataFrame:
    """Rows with a message and a label, which becomes 0 for benign and 1 for others."""
    kept = df.where(F.col(message).isNotNull() & (F.col(message) != "") & F.col(label).isNotNull())
    return kept.withColumn(label, F.when(F.lower(label) == "benign", 0).otherwise(1))


def traces(spark: SparkSession, path: str, expected: list[str] | None = None) -> DataFrame:
    """(task_id, event_id, cnt) in long form of a wide CSV: the first column names the task, others are events."""
    rows = spark.read.option("header", True).csv(path)
    task, events = rows.columns[0], rows.columns[1:]
    if expected is not None and events != list(expected):
        raise ValueError("columns of the traces aren't the expected events")
    typed = rows.select(F.col(task).alias("task_id"), *[F.col(f"`{c}`").cast("float").alias(c) for c in events])
    return typed.unpivot(["task_id"], events, "event_id", "cnt")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, template) of a JSON list of [template, id], or an object of template to id, by id."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("p")).select(F.col("p")[1].cast("int").alias("event_id"), F.col("p")[0].alias("template"))
    named = text.select(F.explode(F.from_json("value", "map<string,int>")).alias("template", "event_id")).select("event_id", "template")
    return pairs.unionByName(named).where("event_id is not null").orderBy("event_id")


def events_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if limit is None else rows.limit(limit)


def pair_file(spark: SparkSession, folder: str, left: str = "anchor", right: str = "positive", chars: int = 1500) -> DataFrame:
    """(left, right) of the files in folder whose names hold ``pair`` or ``biencoder``; blank sides drop out."""
    kinds = []
    for name in ("*pair*", "*biencoder*"):
        for suffix, read in ((".csv", lambda p: spark.read.option("header", True).csv(p)), (".jsonl", spark.read.json)):
            try:
                kinds.append(read(f"{folder}/{name}{suffix}").select(left, right))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
    if not kinds:
        raise FileNotFoundError(folder)
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)
    cut = lambda c: F.left(F.btrim(c), F.lit(chars)).alias(c)
    return rows.select(cut(left), cut(right)).where(f"{left} != '' and {right} != ''")


def tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) for datasets.sentences; numbers rise within a file."""
    return _numbered(spark.read.text(path)).select("file", "line_no", "value")


def techniques(spark: SparkSession, path: str) -> DataFrame:
    """(no, technique_id, name, description) of a JSON array."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<struct<id:string,name:string,description:string>>")).alias("no", "t"))
    return rows.select("no", F.col("t.id").alias("technique_id"), "t.name", "t.description")


def sigma_rules(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """A rules table out of parsed rule documents (from YAML, where a parser is at hand); conditions are passed over, no documents give no rules."""
    rows = []
    for no, doc in enumerate(documents):
        name = doc.get("id") or doc.get("title")
        for key, detection in (doc.get("detection") or {}).items():
            if key == "condition":
                continue
            for item in detection if isinstance(detection, list) else [detection]:
                for field, values in item.items() if isinstance(item, dict) else []:
                    field, *modifiers = field.split("|")
                    modifier = None if not modifiers else modifiers[0] if len(modifiers) == 1 else "+".join(modifiers)
                    rows += [(name, no, field, modifier, str(v)) for v in (values if isinstance(values, list) else [values])]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def sigma_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a folder of JSON or YAML files; YAML needs a parser."""
    documents = []
    for name, text in spark.sparkContext.wholeTextFiles(path).collect():  # a folder of rules is small
        if name.endswith(".json"):
            documents.append(json.loads(text))
        else:
            import yaml

            documents += [d for d in yaml.safe_load_all(text) if d]
    return sigma_rules(spark, documents)
