"""Training sets: samples, splits, text windows, pairs and tagged sentences.

Random choices are by a hash of the row's id and a seed, so reruns and other layouts choose the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions import patterns
from sparkwarden.operators.evaluation import with_percentiles
from sparkwarden.operators.ordered import chunks, running

#: Rows of small tables (some 200 bytes each) that go along with each row as one array; more make more arrays.
CHUNK = 20_000


def draw(key: Column, seed: int) -> Column:
    """A fixed pseudo-random text for each key, which any SQL engine can make too."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def sample_per_class(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each label. The ranking is cut to n within partitions first, so a large class is no bottleneck."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(draw(F.col(key), seed), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def balanced_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Half of n from each of labels 0 and 1, or as many as the smaller one has."""
    least = df.where(F.col(label).isin(0, 1)).groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return sample_per_class(df.where(F.col(label).isin(0, 1)), label, key, min(n // 2, least), seed)


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.1, val: float = 0.1, seed: int = 42) -> DataFrame:
    """df with ``split``: exact shares of each label; val is a share of what test leaves. Ranks run along the draw by ranges, so no task holds a label; null labels are one."""
    ranked = running(df.withColumn("_d", draw(F.col(key), seed)), "_d", {"_r": F.lit(1)}, [label], ties=[key])
    counts = df.groupBy(F.col(label).alias("_of")).agg(F.count("*").alias("_n"))
    met = ranked.join(counts, F.col(label).eqNullSafe(F.col("_of")))
    n_test = F.round(F.col("_n") * test)
    n_val = F.round((F.col("_n") - n_test) * val)
    return met.withColumn("split", F.when(F.col("_r") < n_test, "test").when(F.col("_r") < n_test + n_val, "val").otherwise("train")).drop("_d", "_r", "_of", "_n")


def positional_split(df: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """df with ``split``: the first share of rows for training. Ranks run along the order by ranges."""
    whole = df.agg(F.count("*").alias("_n"))
    ranked = running(df, order, {"_r": F.lit(1)}).crossJoin(F.broadcast(whole))  # one row
    return ranked.withColumn("split", F.when(F.col("_r") < F.floor(F.col("_n") * share), "train").otherwise("val")).drop("_r", "_n")


def hash_split(df: DataFrame, key: str, share: float = 0.95, seed: int = 42) -> DataFrame:
    """df with ``split`` by each row's own hash: no shuffle, shares as expected."""
    part = F.conv(F.left(draw(F.col(key), seed), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(part < share, "train").otherwise("val"))


def align(*frames: DataFrame) -> DataFrame:
    """All rows with all columns, numbers that are missing 0."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(0)


def text_windows(bag: DataFrame, vocabulary: DataFrame, max_lines: int = 256, max_repeat: int = 16, sep: str = "\n") -> DataFrame:
    """(task_id, text, n_lines, n_unique_events) of bag (task_id, event_id, cnt) and vocabulary (event_id, template).

    Counts are clipped; beyond max_lines, events stay by (count down, id up), the last one in part; lines
    come in order of ids, each as often as it stays. Running sums decide, so no event is gone through in Python.
    """
    clipped = bag.where("cnt > 0").withColumn("c", F.least("cnt", F.lit(max_repeat)))
    before = Window.partitionBy("task_id").orderBy(F.desc("c"), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = clipped.withColumn("keep", F.greatest(F.lit(0), F.least(F.col("c"), F.lit(max_lines) - F.coalesce(F.sum("c").over(before), F.lit(0)))).cast("int"))
    named = kept.join(vocabulary, "event_id", "left")
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "template", "keep"))), lambda e: F.array_repeat(e["template"], e["keep"])))
    return named.groupBy("task_id").agg(F.array_join(lines, sep).alias("text"), F.sum("keep").alias("n_lines"), F.count("*").alias("n_unique_events"))


def window_stats(windows: DataFrame) -> DataFrame:
    """One row: min, p50, p95, max and mean of lines and of unique events; whole numbers but for means."""
    cols, names = [], {"n_lines": "lines", "n_unique_events": "events"}
    for c, name in names.items():
        cols += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean")]
    out = windows.agg(*cols)
    for c, name in names.items():
        out = with_percentiles(out, windows, c, {f"{name}_p50": 0.5, f"{name}_p95": 0.95})
    return out.withColumns({f"{name}_{p}": F.col(f"{name}_{p}").cast("long") for name in names.values() for p in ("p50", "p95")})


def matches(texts: DataFrame, keywords: DataFrame, techniques: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = patterns.CHUNK) -> DataFrame:
    """(key, technique_id) of techniques with a keyword (keyword, technique_id) in the text, in any case; unknown ids drop out. An automaton over all keywords goes through each text once."""
    known = keywords.join(techniques.select("technique_id").distinct(), "technique_id").select(F.lower("keyword").alias("keyword"), "technique_id").where("keyword is not null")
    rows = texts.select(key, F.lower(text).alias("_t")).withColumn("_ids", F.array().cast("array<string>"))
    for part in patterns.shared(known, patterns.Labels, ["keyword", "technique_id"], chunk):
        rows = rows.withColumn("_ids", F.concat("_ids", patterns.told(part, F.col("_t"), "array<string>")))
    return rows.select(key, F.explode(F.array_distinct("_ids")).alias("technique_id"))


def positive_pairs(texts: DataFrame, found: DataFrame, techniques: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, chars: int = 1500) -> DataFrame:
    """(key, technique_id, anchor, positive, label 1.0, no) in a seeded order."""
    pairs = found.join(texts.select(key, F.left(text, F.lit(chars)).alias("anchor")), key).join(techniques, "technique_id")
    return pairs.select(key, "technique_id", "anchor", F.concat_ws(". ", "name", "description").alias("positive"), F.lit(1.0).alias("label"), draw(F.concat_ws(":", F.col(key), "technique_id"), seed).alias("no"))


def negative_pairs(found: DataFrame, techniques: DataFrame, key: str = "doc_id", ratio: int = 2, seed: int = 42) -> DataFrame:
    """(key, technique_id, label 0.0): ratio unmatched techniques for each match of a text, or all there are.

    Techniques go along with each text, in parts if they are many; the candidates are cut to those wanted in the row.
    """
    own = found.groupBy(key).agg(F.collect_set("technique_id").alias("own")).withColumn("other", F.array().cast("array<struct<d:string,t:string>>"))
    for part in chunks(techniques.select("technique_id").distinct(), [F.col("technique_id").alias("t")], CHUNK):
        all_ids = F.transform("_all", lambda t: t["t"])
        drawn = F.transform(F.array_except(all_ids, "own"), lambda t: F.struct(draw(F.concat_ws(":", F.col(key), t), seed).alias("d"), t.alias("t")))
        own = own.crossJoin(F.broadcast(part.withColumnRenamed("rows", "_all"))).withColumn("other", F.slice(F.array_sort(F.concat("other", drawn)), F.lit(1), F.size("own") * ratio)).drop("_all")  # one row
    return own.select(key, F.explode("other").alias("x")).select(key, F.col("x.t").alias("technique_id"), F.lit(0.0).alias("label"))


def simcse_pairs(texts: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, chars: int = 1500) -> DataFrame:
    """(key, anchor, positive): a text with itself, for contrastive training by dropout; blank and short texts and repeats drop out."""
    cut = F.left(F.btrim(F.col(text)), F.lit(chars))
    rows = texts.select(key, cut.alias("anchor")).where(F.length("anchor") >= least)
    return rows.groupBy("anchor").agg(F.min(key).alias(key)).select(key, "anchor", F.col("anchor").alias("positive"))


def random_vectors(keys: DataFrame, key: str, width: int, share: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, features): 0/1 vectors in which a share of entries is set, drawn by hash, for load tests."""
    part = lambda k: F.conv(F.left(draw(F.concat_ws(":", F.col(key), k), seed), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return keys.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: (part(k) < share).cast("float")).alias("features"))


def retrieval_set(pairs: DataFrame, text: str = "positive") -> DataFrame:
    """pairs with ``corpus_id``: the first pair's number (no) of each text."""
    first = pairs.groupBy(text).agg(F.min("no").alias("corpus_id"))
    return pairs.join(first, text)


def sentences(lines: DataFrame, tags: list[str]) -> DataFrame:
    """(file, sentence, tokens, labels) of tagged lines (file, line_no, value): token and tag by a tab, blank lines between; unknown tags are O. Blank lines are counted along a file by ranges, so none is one task."""
    blank = F.btrim("value") == ""
    rows = running(lines.withColumn("_blank", blank.cast("int")), "line_no", {"sentence": F.col("_blank")}, ["file"]).where(~blank)
    parts = F.split("value", "\t")
    tag = F.try_element_at(parts, F.lit(2))
    rows = rows.select("file", "sentence", "line_no", F.element_at(parts, 1).alias("token"), F.when(tag.isin(*tags), tag).otherwise("O").alias("tag"))
    gathered = F.array_sort(F.collect_list(F.struct("line_no", "token", "tag")))
    return rows.groupBy("file", "sentence").agg(gathered.alias("x")).select("file", "sentence", F.col("x.token").alias("tokens"), F.col("x.tag").alias("labels"))


def subword_labels(words: DataFrame, order: str = "pos", scope: str = "sentence") -> DataFrame:
    """words (sentence, pos, word_id, tag) with ``label``: a word's tag on its first piece, I- on later ones, null on special pieces."""
    before = F.lag("word_id").over(Window.partitionBy(scope).orderBy(order))
    later = F.col("word_id").eqNullSafe(before)
    return words.withColumn("label", F.when(F.col("word_id").isNull(), None).when(~later, F.col("tag")).otherwise(F.regexp_replace("tag", "^B-", "I-")))


def entity_counts(tagged: DataFrame, labels: str = "labels") -> DataFrame:
    """(type, n) of entities that begin, the most frequent first."""
    return tagged.select(F.explode(labels).alias("tag")).where("tag like 'B-%'").groupBy(F.expr("substring(tag, 3)").alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def greedy_spans(spans: Column) -> Column:
    """Of spans (start, end, ...) those that a walk by (start, longest first) keeps without overlap."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    fits = lambda kept, s: (F.size(kept) == 0) | (F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)) <= s["start"])
    return F.aggregate(order, F.filter(order, lambda s: F.lit(False)), lambda kept, s: F.when(fits(kept, s), F.concat(kept, F.array(s))).otherwise(kept))


def replicate(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows (seq, ...) that go round df in its order; and their chunk numbers come by ``floor(seq / size)``."""
    ranked = running(df, order, {"_r": F.lit(1)}).withColumn("_r", F.col("_r").cast("int"))
    size = df.count()
    if not size:
        return ranked.drop("_r").withColumn("seq", F.lit(None).cast("long")).limit(0)
    seq = df.sparkSession.range(n).withColumnRenamed("id", "seq").withColumn("_r", F.pmod("seq", F.lit(size)).cast("int"))
    return seq.join(ranked, "_r").drop("_r")


def scenario_vectors(scenarios: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n tasks for each scenario (name, events array<struct<event,min,max>>, is_anomaly) as (task_id, name, event_id, cnt, is_anomaly), counts drawn by hash."""
    tasks = scenarios.crossJoin(scenarios.sparkSession.range(n).withColumnRenamed("id", "k")).withColumn("e", F.explode("events"))
    task = F.concat_ws("-", "name", "k")
    part = F.conv(F.left(draw(F.concat_ws(":", task, F.col("e.event")), seed), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    count = F.col("e.min") + F.floor(part * (F.col("e.max") - F.col("e.min") + 1))
    return tasks.select(task.alias("task_id"), "name", F.col("e.event").alias("event_id"), count.cast("long").alias("cnt"), "is_anomaly")
