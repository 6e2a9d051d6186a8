"""Queries over labels and monitors: metrics, samples, windows, pairs, alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwarden.operators import datasets, evaluation, metrics, sketches
from sparkwarden.plans.common import EVENTS, Registry, events, table

R = Registry()


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", ((F.coalesce("n_chars", F.lit(0)) % 997) / 997.0).alias("score"))
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), "score")


_LABELLED = "l AS (SELECT doc_id, quality AS label, (coalesce(n_chars, 0) % 997) / 997.0 AS score FROM labels JOIN documents USING (doc_id))"
_RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(fp / greatest(fp + tn, 1), 4) AS fpr, round(fn / greatest(fn + tp, 1), 4) AS fnr, round((tp + fp) / greatest(tp + fp + tn + fn, 1), 4) AS ppr"""
_SWEEP = f"""WITH {_LABELLED}, c AS (SELECT round(0.05 * k, 2) AS threshold FROM range(1, 20) r(k)), m AS (
  SELECT threshold, count(*) FILTER (label = 1 AND CAST(CAST(score AS FLOAT) AS DOUBLE) >= threshold) AS tp, count(*) FILTER (label <> 1 AND CAST(CAST(score AS FLOAT) AS DOUBLE) >= threshold) AS fp,
    count(*) FILTER (label <> 1 AND NOT CAST(CAST(score AS FLOAT) AS DOUBLE) >= threshold) AS tn, count(*) FILTER (label = 1 AND NOT CAST(CAST(score AS FLOAT) AS DOUBLE) >= threshold) AS fn FROM c, l GROUP BY threshold), s AS (
  SELECT threshold, tp, fp, tn, fn, {_RATES} FROM m)"""


@R.add(f"WITH {_LABELLED}, m AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label <> 1 AND score >= 0.5) AS fp, count(*) FILTER (label <> 1 AND score < 0.5) AS tn, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM l) SELECT tp, fp, tn, fn, {_RATES}, round(1000.0 * fp / greatest(fp + tn, 1), 4) AS fp_per_1000 FROM m")
def confusion(spark, sf):
    return evaluation.false_positive_budget(evaluation.confusion(_labelled(spark, sf), "label", "score", 0.5))


@R.add(_SWEEP + " SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, precision, recall, f1, fpr, fnr, ppr FROM s")
def threshold_sweep(spark, sf):
    return evaluation.sweep(_labelled(spark, sf), "label", "score")


@R.add(_SWEEP + """, b AS (SELECT * FROM s ORDER BY f1 DESC, precision DESC, threshold LIMIT 1), g AS (SELECT * FROM s WHERE recall >= 0.7 ORDER BY precision DESC, f1 DESC, threshold LIMIT 1)
SELECT CAST(b.threshold AS DOUBLE) AS best_f1_threshold, b.f1 AS best_f1, CAST(g.threshold AS DOUBLE) AS target_threshold, g.precision AS target_precision FROM b LEFT JOIN g ON true""")
def sweep_summary(spark, sf):
    return evaluation.sweep_summary(evaluation.sweep(_labelled(spark, sf), "label", "score"), 0.7)


@R.add(f"WITH {_LABELLED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM l) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)), 6) AS roc_auc FROM r")
def roc_auc(spark, sf):
    return evaluation.roc_auc(_labelled(spark, sf), "label", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


@R.add("SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def score_distribution(spark, sf):
    out = evaluation.score_distribution(table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")])


@R.add("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = least(CAST(floor(n * 95 / 100) AS BIGINT), n - 1)) AS floor, max(value) FILTER (i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS nearest, (SELECT round(quantile_cont(value, 0.95), 6) FROM events e WHERE e.event_type = o.event_type) AS linear FROM o GROUP BY event_type""")
def percentiles(spark, sf):
    rows = table(spark, sf, "events")
    parts = [evaluation.percentile(rows, "value", 95, kind, ["event_type"]).select("event_type", F.round("value", 6).alias(kind) if kind == "linear" else F.col("value").alias(kind)) for kind in ("floor", "nearest", "linear")]
    return parts[0].join(parts[1], "event_type").join(parts[2], "event_type")


@R.add("SELECT quality, round(count(*) * 1.0 / 1, 6) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * greatest(count(*), 1)), 6) AS weight FROM labels GROUP BY quality")
def class_weights(spark, sf):
    rows = table(spark, sf, "labels")
    counts = rows.groupBy("quality").agg(F.count("*").cast("double").alias("n"))
    return evaluation.class_weights(rows, "quality").join(counts, "quality").select("quality", "n", F.round("weight", 6).alias("weight"))


@R.add("SELECT event_type, max(abs(value)) AS scale FROM events GROUP BY event_type")
def max_abs_scale(spark, sf):
    return evaluation.max_abs(table(spark, sf, "events"), "event_type", "value")


@R.add("SELECT lang AS category, count(*) AS n, round(avg(CASE WHEN n_chars > 1500 THEN 1.0 ELSE 0 END), 6) AS ratio, avg(CASE WHEN n_chars > 1500 THEN 1.0 ELSE 0 END) >= 0.5 AS ok FROM documents GROUP BY lang")
def pass_ratios(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("category"), (F.col("n_chars") > 1500).alias("passed"))
    return evaluation.pass_ratio(rows, "category", "passed").withColumn("ratio", F.round("ratio", 6))


@R.add("""SELECT doc_id, lang AS category, CASE WHEN n_chars > 1500 THEN 'pass' ELSE 'fail' END AS status, avg(CASE WHEN n_chars > 1500 THEN 1.0 ELSE 0 END) OVER (PARTITION BY lang) >= 0.5 AS ok FROM documents""")
def checked_by_category(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"), (F.col("n_chars") > 1500).alias("passed"))
    return evaluation.checked(rows, "category", "passed").select("doc_id", "category", "status", "ok")


@R.add(f"WITH {_LABELLED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM l) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)), 6) AS roc_auc FROM r")
def positive_class_auc(spark, sf):
    rows = _labelled(spark, sf).withColumn("p", F.array(1 - F.col("score"), F.col("score")))
    return evaluation.positive_class_auc(rows, "label", "p").select(F.round("roc_auc", 6).alias("roc_auc"))


_DRAW = "md5(doc_id || ':42')"


@R.add(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN r < round(n * 0.1) THEN 'test' WHEN r < round(n * 0.1) + round((n - round(n * 0.1)) * 0.1) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf):
    return datasets.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@R.add(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) AS r FROM labels) SELECT doc_id, quality FROM r WHERE r <= least(40, (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality)))""")
def balanced_sample(spark, sf):
    return datasets.balanced_sample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 80)


@R.add(f"SELECT doc_id, CASE WHEN CAST('0x' || left({_DRAW}, 8) AS BIGINT) / 4294967296.0 < 0.95 THEN 'train' ELSE 'val' END AS split FROM documents")
def hash_split(spark, sf):
    return datasets.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


_WINDOWS = """WITH b AS (SELECT user_id, event_type, least(count(*), 16) AS c FROM events GROUP BY ALL), r AS (
  SELECT *, coalesce(sum(c) OVER (PARTITION BY user_id ORDER BY c DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b), k AS (
  SELECT *, CAST(greatest(0, least(c, 40 - before)) AS INT) AS keep FROM r), w AS (
  SELECT CAST(user_id AS BIGINT) AS task_id, string_agg(CASE WHEN keep > 0 THEN repeat('<' || event_type || '>|', keep) END, '' ORDER BY event_type) AS text, CAST(sum(keep) AS BIGINT) AS n_lines, count(*) AS n_unique_events FROM k GROUP BY user_id)"""


def _windows(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("task_id"), F.col("event_type").alias("event_id")).agg(F.count("*").alias("cnt"))
    names = rows.select("event_id").distinct().withColumn("template", F.concat(F.lit("<"), "event_id", F.lit(">")))
    return datasets.text_windows(rows, names, max_lines=40, sep="|")


@R.add(_WINDOWS + " SELECT task_id, left(text, length(text) - 1) AS text, n_lines, n_unique_events FROM w")
def text_windows(spark, sf):
    return _windows(spark, sf)


@R.add(_WINDOWS + """ SELECT min(n_lines) AS lines_min, CAST(floor(quantile_cont(n_lines, 0.5)) AS BIGINT) AS lines_p50, CAST(floor(quantile_cont(n_lines, 0.95)) AS BIGINT) AS lines_p95, max(n_lines) AS lines_max, round(avg(n_lines), 6) AS lines_mean,
  min(n_unique_events) AS events_min, CAST(floor(quantile_cont(n_unique_events, 0.5)) AS BIGINT) AS events_p50, CAST(floor(quantile_cont(n_unique_events, 0.95)) AS BIGINT) AS events_p95, max(n_unique_events) AS events_max, round(avg(n_unique_events), 6) AS events_mean FROM w""")
def window_stats(spark, sf):
    out = datasets.window_stats(_windows(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("lines_mean", "events_mean")})


KEYWORDS = [("that", "T1"), ("ing of", "T2"), ("ción", "T3"), ("schaft", "T4"), ("zzz", "T5"), ("with", "T9")]
TECHNIQUES = [(i, f"T{i + 1}", f"Name {i + 1}", f"about {i + 1}") for i in range(6)]
_FOUND = """kw(keyword, technique_id) AS (VALUES ('that', 'T1'), ('ing of', 'T2'), ('ción', 'T3'), ('schaft', 'T4'), ('zzz', 'T5'), ('with', 'T9')),
f AS (SELECT DISTINCT doc_id, technique_id FROM documents JOIN kw ON contains(lower(text), keyword) WHERE technique_id <> 'T9')"""


def _pairs(spark, sf):
    docs = table(spark, sf, "documents")
    tech = spark.createDataFrame(TECHNIQUES, "no int, technique_id string, name string, description string")
    return docs, tech, datasets.matches(docs, spark.createDataFrame(KEYWORDS, "keyword string, technique_id string"), tech)


@R.add(f"WITH {_FOUND} SELECT doc_id, technique_id, sha256(left(text, 1500)) AS anchor, 'Name ' || technique_id[2:] || '. about ' || technique_id[2:] AS positive FROM f JOIN documents USING (doc_id)")
def keyword_pairs(spark, sf):
    docs, tech, found = _pairs(spark, sf)
    return datasets.positive_pairs(docs, found, tech).select("doc_id", "technique_id", F.sha2("anchor", 256).alias("anchor"), "positive")


@R.add(f"""WITH {_FOUND}, t(technique_id) AS (VALUES ('T1'), ('T2'), ('T3'), ('T4'), ('T5'), ('T6')), n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id), c AS (
  SELECT n.doc_id, t.technique_id, n.n, row_number() OVER (PARTITION BY n.doc_id ORDER BY md5(n.doc_id || ':' || t.technique_id || ':42')) AS r FROM n, t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = n.doc_id AND f.technique_id = t.technique_id))
SELECT doc_id, technique_id, 0.0::DOUBLE AS label FROM c WHERE r <= 2 * n""")
def negative_pairs(spark, sf):
    _, tech, found = _pairs(spark, sf)
    return datasets.negative_pairs(found, tech)


@R.add(f"WITH {EVENTS} SELECT event_type AS ai_priority, count(*) AS n FROM e GROUP BY 1")
def priority_counts(spark, sf):
    return metrics.priority_counts(events(spark, sf).withColumn("ai_priority", F.col("event_type")))


@R.add(f"""WITH {EVENTS} SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS high, count(*) FILTER (k % 5 = 0) AS duplicates, count(*) FILTER (k > 90) AS sigma, count(*) FILTER (k % 11 = 0) AS degraded, count(*) FILTER (k % 6 = 1) AS second_tier, round(avg(score), 6) AS avg_score, round(avg(value), 6) AS avg_latency_ms FROM e""")
def running_counters(spark, sf):
    rows = events(spark, sf).select(F.when(F.col("event_type") == "error", "HIGH").otherwise("LOW").alias("ai_priority"), (F.col("k") % 5 == 0).alias("is_duplicate"), (F.col("k") > 90).alias("sigma_matched"), (F.col("k") % 11 == 0).alias("score_degraded"), (F.col("k") % 6 == 1).alias("tier2_used"), F.col("score").alias("ai_threat_score"), F.col("value").alias("scoring_latency_ms"))
    return metrics.running_counters(rows).withColumns({c: F.round(c, 6) for c in ("avg_score", "avg_latency_ms")})


@R.add("""WITH b(le) AS (VALUES (5.0), (10.0), (20.0), (50.0), (100.0), (200.0), (500.0), (1000.0), ('Infinity'::DOUBLE)) SELECT event_type, CAST(le AS DOUBLE) AS le, CAST(count(*) FILTER (value <= le) AS BIGINT) AS cumulative FROM events, b GROUP BY ALL""")
def latency_histogram(spark, sf):
    return metrics.histogram(table(spark, sf, "events"), "value", metrics.LATENCY_BUCKETS, ["event_type"])


@R.add("""WITH b(le) AS (VALUES (5.0), (10.0), (20.0), (50.0), (100.0), (200.0), (500.0), (1000.0)), h AS (SELECT event_type, CAST(le AS DOUBLE) AS le, count(*) FILTER (value <= le) AS c, count(*) AS total FROM events, b GROUP BY ALL),
p AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(c) OVER w, 0) AS before FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(low + (le - low) * (0.95 * total - before) / (c - before), 6) AS value FROM p WHERE c >= 0.95 * total AND before < 0.95 * total""")
def latency_quantile(spark, sf):
    h = metrics.histogram(table(spark, sf, "events"), "value", metrics.LATENCY_BUCKETS, ["event_type"])
    return metrics.histogram_quantile(h, 0.95, ["event_type"]).withColumn("value", F.round("value", 6))


@R.add("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(CAST(30 * j AS INT)) AS s FROM events, range(2) r(j)) SELECT event_type, CAST(epoch(s) AS BIGINT) AS start_s, count(*) / 3600.0 AS per_second FROM w GROUP BY ALL""")
def event_rate(spark, sf):
    out = metrics.rate(table(spark, sf, "events"), "ts", "1 hour", 3600, "30 minutes", ["event_type"])
    return out.select("event_type", F.unix_timestamp("start").alias("start_s"), "per_second")


_SAMPLES = "x AS (SELECT event_type, event_id % 3 AS host, CAST(epoch(ts) AS DOUBLE) AS t, CAST(row_number() OVER (PARTITION BY event_type, event_id % 3 ORDER BY ts, event_id) % 97 * 3 AS DOUBLE) AS v FROM events)"


@R.add(f"""WITH {_SAMPLES}, p AS (SELECT event_type, host, CAST(10800 * (ceil(t / 10800) + j) AS BIGINT) AS "at", t, v FROM x, range(0, 3) r(j)),
w AS (SELECT *, lag(v) OVER (PARTITION BY event_type, host, "at" ORDER BY t) AS was FROM p WHERE "at" >= t AND "at" < t + 21600),
g AS (SELECT event_type, host, "at", count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(v, t) AS v0, arg_max(v, t) - arg_min(v, t) + sum(CASE WHEN v < was THEN was ELSE 0 END) AS up FROM w GROUP BY ALL HAVING count(*) > 1 AND max(t) > min(t)),
m AS (SELECT *, (t1 - t0) / (n - 1) AS pace, t0 - ("at" - 21600) AS a, "at" - t1 AS b FROM g),
f AS (SELECT *, least(CASE WHEN a < 1.1 * pace THEN a ELSE pace / 2 END, CASE WHEN up > 0 THEN (t1 - t0) * v0 / up END) + CASE WHEN b < 1.1 * pace THEN b ELSE pace / 2 END + t1 - t0 AS whole FROM m)
SELECT event_type, host, "at", round(up * whole / (t1 - t0), 4) AS increase, round(up * whole / (t1 - t0) / 21600, 8) AS per_second FROM f""")
def counter_increase(spark, sf):
    """Counters of three hosts for each kind of event, which restart after every 97th; six hours each three."""
    rows = table(spark, sf, "events").withColumn("host", F.col("event_id") % 3)
    order = Window.partitionBy("event_type", "host").orderBy("ts", "event_id")
    samples = rows.withColumn("v", F.row_number().over(order) % 97 * 3)
    out = metrics.increase(samples, ["event_type", "host"], "ts", "v", 21600, 10800)
    return out.withColumns({"increase": F.round("increase", 4), "per_second": F.round("per_second", 8)})


@R.add("""WITH p AS (SELECT event_type, count(DISTINCT user_id || ':' || json_extract_string(props, '$.k')) AS n, count(*) AS c FROM events GROUP BY 1)
SELECT event_type, c AS rows, n AS exact, true AS within FROM p""")
def distinct_sketches(spark, sf):
    """Pairs of user and k that each kind of event has, by sketches of the days; the exact count stands beside it, as this is what is under test."""
    rows = events(spark, sf).withColumn("pair", F.concat_ws(":", "user_id", "k"))
    days = sketches.daily(rows, "ts", ["event_type"], F.col("pair"), F.col("value"))
    told = sketches.estimates(sketches.merged(days, ["event_type"]), [0.5])
    exact = rows.groupBy("event_type").agg(F.count_distinct("pair").alias("exact"))
    return told.join(exact, "event_type").select("event_type", "rows", "exact", (F.abs(F.col("n_distinct") - F.col("exact")) <= F.col("exact") * sketches.distinct_error() + 1).alias("within"))


@R.add("""WITH w AS (SELECT date_trunc('week', ts) AS week, value FROM events) SELECT CAST(week AS DATE) AS week, p.p AS share, count(*) AS rows, true AS within FROM w, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) p(p) GROUP BY ALL""")
def quantile_sketches(spark, sf):
    """Quantiles of each week by sketches of the days; within: the share of rows up to the estimate is the one that was asked for, but for the sketch's error."""
    rows, shares = events(spark, sf), [0.5, 0.95, 0.99]
    week = lambda c: F.to_date(F.date_trunc("week", c)).alias("week")
    days = sketches.daily(rows, "ts", [], F.col("event_id"), F.col("value"))
    told = sketches.estimates(sketches.merged(days, [week(F.col("day"))]), shares)
    asked = told.select("week", "rows", F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("quantiles").alias("q"))).alias("x"))
    met = rows.select(week(F.col("ts")), "value").join(F.broadcast(asked.select("week", "rows", "x.share", "x.q")), "week")  # a few rows a week
    below, up = F.count_if(F.col("value") < F.col("q")) / F.count("*"), F.count_if(F.col("value") <= F.col("q")) / F.count("*")
    e = sketches.rank_error()
    return met.groupBy("week", "share").agg(F.max("rows").alias("rows"), ((below <= F.col("share") + e) & (up >= F.col("share") - e)).alias("within"))


@R.add(f"""WITH {EVENTS} SELECT CAST(ts AS DATE) AS day, round(avg(CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0 END), 6) AS duplicates, round(avg(CASE WHEN value <= 100 THEN 1.0 ELSE 0 END), 6) AS share, avg(CASE WHEN value <= 100 THEN 1.0 ELSE 0 END) < 0.9 AS burning FROM e GROUP BY 1""")
def daily_ratios(spark, sf):
    rows = events(spark, sf).withColumn("day", F.to_date("ts"))
    dup = metrics.ratio(rows, F.col("k") % 5 == 0, ["day"]).select("day", F.round("ratio", 6).alias("duplicates"))
    return dup.join(metrics.error_budget(rows, "value", 100, ["day"], 0.9), "day").withColumn("share", F.round("share", 6))


@R.add("SELECT user_id, arg_max(value, ts) AS value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY user_id")
def latest_with_errors(spark, sf):
    rows = table(spark, sf, "events")
    return metrics.latest(metrics.both(rows, rows.where("event_type = 'error'"), ["user_id"]), ["user_id"], "ts", "value")


@R.add("""WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) > 45 AS active FROM events GROUP BY 1), i AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS island FROM h),
f AS (SELECT *, min(CASE WHEN active THEN ts END) OVER (PARTITION BY island) AS since FROM i) SELECT CAST(epoch(ts) AS BIGINT) AS ts_s, active, coalesce(active AND epoch(ts) - epoch(since) >= 7200, false) AS firing FROM f""")
def alert_holds(spark, sf):
    hours = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.avg("value").alias("v"))
    out = metrics.alerts(hours, "ts", [("slow", "v > 45", 7200)])
    return out.select(F.unix_timestamp("ts").alias("ts_s"), "active", "firing")
