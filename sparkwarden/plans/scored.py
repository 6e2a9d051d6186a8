"""The whole scoring plan over events and embeddings, with stand-ins for models and failures put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.operators import cascade, drift, folds, models, output, rules, scoring
from sparkwarden.plans.common import EVENTS, Registry, events, table
from sparkwarden.streaming import cascade as streams
from sparkwarden.streaming.workspace import drained

R = Registry()
RULES = [("r-admin", 0, "CommandLine", "contains", "user admin from 10.0.0.9"), ("r-pay", 1, "Details", "endswith", "k=77")]


def _rows(spark, sf, rows=None):
    """All events, seven seconds apart, with the embeddings dealt to them by turns; every 31st embedding failed, and message kinds stand for source types."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 31 != 0, F.col("embedding")).alias("embedding"))
    rows = (events(spark, sf) if rows is None else rows).select("event_id", "k", "score", "message", "event_type").crossJoin(F.broadcast(vectors.agg(F.count("*").alias("turns"))))  # one row
    rows = rows.withColumn("vec_id", F.col("event_id") % F.col("turns")).join(vectors, "vec_id")
    kind = F.when(F.col("event_type").isin("view", "signup"), "endpoint").otherwise("syslog")
    return rows.select("event_id", "k", "score", F.timestamp_seconds(F.col("event_id") * 7).alias("at"), F.col("message").alias("raw"), F.col("message").alias("text"), kind.alias("source_type"), "embedding")


def _parts(spark, sf):
    """Models' stand-ins, rules and techniques."""
    techniques = table(spark, sf, "embeddings").where("vec_id < 5").select(F.col("vec_id").cast("int").alias("no"), F.concat(F.lit("T"), "vec_id").alias("technique_id"), F.col("embedding").alias("vector"))
    one = lambda c, s: F.struct(c["no"].alias("no"), c["technique_id"].alias("id"), s.alias("score"))
    m = cascade.Models(
        syslog=lambda d: F.when(d["k"] % 13 != 0, d["score"]), event=lambda d: F.when(d["k"] % 17 != 0, d["score"]), second=lambda d: F.when(d["k"] % 7 != 0, d["k"] / 100.0),
        entities=lambda d: F.when(d["k"] % 19 != 0, models.rule_entities(d["text"])), cross=lambda d: F.transform(F.slice(d["candidates"], 1, 1), lambda c: one(c, d["k"] / 200.0)), band=scoring.Band(0.3, 0.7), split=False,
    )
    return m, spark.createDataFrame(RULES, rules.RULE_SCHEMA), techniques


NOVELTY = {"window": 100, "warmup": 50, "baseline": 50}


def _score(spark, sf):
    m, known, techniques = _parts(spark, sf)
    return cascade.score_events(_rows(spark, sf), "event_id", "at", m, known, techniques, seq="event_id", novelty=NOVELTY)


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_PLAN = f"""WITH {EVENTS}, x AS (
  SELECT e.event_id, k, score, message, event_id * 7 AS s, CASE WHEN event_type IN ('view', 'signup') THEN 'endpoint' ELSE 'syslog' END AS kind, CASE WHEN vec_id % 31 <> 0 THEN v.embedding END AS embedding,
    event_type = 'error' OR (event_type = 'click' AND k < 5) AS attack, CASE WHEN event_type = 'error' THEN '10.0.0.' || (user_id % 250) ELSE '' END AS ip,
    CASE WHEN contains(message, 'user admin from 10.0.0.9') THEN 'r-admin' WHEN ends_with(message, 'k=77') THEN 'r-pay' END AS rule
  FROM e JOIN embeddings v ON v.vec_id = e.event_id % (SELECT count(*) FROM embeddings)),
c1 AS (SELECT *, CASE WHEN kind = 'syslog' THEN k % 13 = 0 ELSE k % 17 = 0 END AS f1 FROM x), c2 AS (SELECT *, CASE WHEN f1 THEN 0.5 ELSE score END AS p1 FROM c1),
c3 AS (SELECT *, kind <> 'syslog' AND p1 BETWEEN 0.3 AND 0.7 AND k % 7 <> 0 AS used FROM c2), c4 AS (SELECT *, CASE WHEN used THEN k / 100.0 ELSE p1 END AS cls FROM c3),
near AS (SELECT a.event_id, max({_DOT}) AS best FROM x a JOIN x b ON b.event_id < a.event_id AND b.s >= a.s - 300 WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL GROUP BY a.event_id),
tech AS (SELECT a.event_id, arg_max(b.vec_id, ({_DOT}, -b.vec_id)) AS t FROM x a, embeddings b WHERE b.vec_id < 5 AND a.embedding IS NOT NULL GROUP BY a.event_id),
d AS (SELECT event_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM x WHERE embedding IS NOT NULL), n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM x WHERE embedding IS NOT NULL),
w AS (SELECT event_id, v, avg(v) OVER (PARTITION BY i ORDER BY event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS m FROM d), far AS (SELECT event_id, sum(v * m) / nullif(sqrt(sum(m * m)), 0) AS c FROM w GROUP BY event_id),
nov AS (SELECT event_id, CASE WHEN n >= 50 THEN least(1.0, (1 - greatest(-1.0, least(1.0, coalesce(c, 0)))) * 2.0) ELSE 0.0 END AS nov FROM far JOIN n USING (event_id)),
t3 AS (SELECT c4.*, coalesce(best, 0) >= 0.95 AS dup, t, coalesce(nov, 0) AS nov FROM c4 LEFT JOIN near USING (event_id) LEFT JOIN tech USING (event_id) LEFT JOIN nov USING (event_id)),
f3 AS (SELECT *, embedding IS NULL OR (NOT dup AND k % 19 = 0) AS failed FROM t3),
z AS (SELECT *, NOT failed AND NOT dup AND ip <> '' AS ent, CASE WHEN NOT failed AND NOT dup THEN k / 200.0 ELSE 0.0 END AS ce FROM f3),
fl AS (SELECT *, CASE WHEN rule IS NOT NULL THEN greatest(0.9, cls) WHEN attack THEN greatest(0.6, cls) ELSE cls END AS c FROM z),
s AS (SELECT *, greatest(0.0, least(1.0, 0.35 * c + 0.25 * CASE WHEN ent THEN 0.2 ELSE 0.0 END + 0.4 * ce + 0.15 * nov)) AS total FROM fl),
p AS (SELECT *, CASE WHEN rule IS NOT NULL OR total >= 0.8 THEN 'HIGH' WHEN total >= 0.5 THEN 'MEDIUM' WHEN total >= 0.2 THEN 'LOW' ELSE 'INFO' END AS label FROM s)"""


_SCORED = _PLAN + """ SELECT event_id, used AS tier2_used, failed OR f1 AS degraded, dup AND NOT failed AS duplicate, coalesce(rule, '') AS rules, CASE WHEN ent THEN ip ELSE '' END AS entities,
  CASE WHEN NOT failed AND NOT dup THEN 'T' || t ELSE '' END AS technique, round(nov, 5) AS novelty, round(total, 5) AS score, label AS priority FROM p"""


def _shown(out):
    return out.select(
        "event_id", "tier2_used", F.col("score_degraded").alias("degraded"), F.col("is_duplicate").alias("duplicate"), F.array_join("sigma_rule_ids", ",").alias("rules"), F.col("ai_entities").alias("entities"),
        F.col("ai_mitre_technique").alias("technique"), F.round("novelty_score", 5).alias("novelty"), F.round("ai_threat_score", 5).alias("score"), F.col("ai_priority").alias("priority"),
    )


@R.add(_SCORED)
def scored_end_to_end(spark, sf):
    return _shown(_score(spark, sf))


@R.add(_SCORED)
def scored_stream(spark, sf):
    """The same plan as a stream over the table, run until it has read all: what lies between events is state."""
    m, known, techniques = _parts(spark, sf)
    path = f"{sf}/events.parquet"
    coming = events(spark, sf, spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))  # a stream reads no single file, but what a pattern finds
    scored = streams.score_stream(_rows(spark, sf, coming), "event_id", "at", m, known, techniques, memory=streams.Memory(novelty=folds.Novelty(**NOVELTY)))
    return drained(_shown(scored), "scored-stream")


_TERM = "list_sum(list_transform(range(1, 11), lambda i: (greatest(list_sum(list_transform({h}, lambda l: l[i])) / 500.0, 1e-10) - greatest(r[i] / 500.0, 1e-10)) * ln(greatest(list_sum(list_transform({h}, lambda l: l[i])) / 500.0, 1e-10) / greatest(r[i] / 500.0, 1e-10))))"
_NEXT = "list_append(lasts[2:], CASE WHEN drift THEN h1 ELSE h2 END)"


@R.add(f"""WITH RECURSIVE {EVENTS}, x AS (
  SELECT n, event_id, a, s, CAST(floor((n - 2) / 100.0) AS INT) AS p, CAST(least(floor(a * 10), 9) AS INT) AS b1, CAST(least(floor(coalesce(s, a) * 10), 9) AS INT) AS b2
  FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, event_id, score AS a, CASE WHEN k % 7 <> 0 THEN k / 100.0 END AS s FROM e)),
c AS (SELECT p, bin, count(*) FILTER (b1 = bin) AS c1, count(*) FILTER (b2 = bin) AS c2, count(*) AS n FROM x, range(10) t(bin) GROUP BY p, bin),
h AS (SELECT p, list(c1 ORDER BY bin) AS h1, list(c2 ORDER BY bin) AS h2 FROM c WHERE n = 100 GROUP BY p),
f AS (SELECT list(m ORDER BY bin) AS r FROM (SELECT bin, count(*) FILTER (b2 = bin) AS m FROM x, range(10) t(bin) WHERE n <= 500 GROUP BY bin)),
z AS (SELECT list(h2 ORDER BY p) AS lasts FROM h WHERE p BETWEEN 0 AND 4),
g(p, lasts, psi, drift, was) AS (
  SELECT 4, lasts, {_TERM.format(h="lasts")}, {_TERM.format(h="lasts")} > 0.05, false FROM z, f
  UNION ALL SELECT g.p + 1, {_NEXT}, {_TERM.format(h=_NEXT)}, {_TERM.format(h=_NEXT)} > 0.05, drift FROM g JOIN h ON h.p = g.p + 1, f)
SELECT event_id, coalesce(o.drift, false) AS drifting, round(CASE WHEN s IS NULL OR coalesce(o.drift, false) THEN a ELSE s END, 6) AS final_score, round(d.psi, 6) AS psi,
  CASE WHEN d.drift AND NOT d.was THEN 'start' WHEN d.was AND NOT d.drift THEN 'end' END AS edge
FROM x LEFT JOIN g o ON o.p = x.p - 1 LEFT JOIN g d ON d.p = x.p AND (x.n - 1) % 100 = 0""")
def tier2_fallback(spark, sf):
    """The second tier goes off when the scores that count drift, and on again when they don't; each check decides the scores of the next."""
    rows = events(spark, sf).withColumn("second", F.when(F.col("k") % 7 != 0, F.col("k") / 100.0))
    out = drift.fallback(rows, "event_id", "score", "second", folds.Drift(window=500, interval=100, limit=0.05))
    return out.select("event_id", "drifting", F.round("final_score", 6).alias("final_score"), F.round("psi", 6).alias("psi"), "edge")


@R.add(_PLAN + """ SELECT label AS priority, failed OR f1 AS degraded, count(*) AS n, count(*) FILTER (used) AS second_tier FROM p GROUP BY ALL""")
def scored_records(spark, sf):
    """Records of the whole plan, counted by what their attributes say."""
    rows = _score(spark, sf).withColumns({"raw_log_ref": F.concat(F.lit("r"), "event_id"), "host": F.lit("h"), "event_ts": F.col("at"), "fields": F.create_map().cast("map<string,string>")})
    line = rows.select(output.leef(rows).alias("leef"), "tier2_used")
    found = line.select(F.regexp_extract("leef", r"ai_priority=(\w+)", 1).alias("priority"), (F.regexp_extract("leef", r"degraded=(\d)", 1) == "1").alias("degraded"), "tier2_used")
    return found.groupBy("priority", "degraded").agg(F.count("*").alias("n"), F.count_if("tier2_used").alias("second_tier"))


@R.add("SELECT count(*) AS events, count(*) AS degraded, 0.0::DOUBLE AS classifier FROM events")
def scored_without_models(spark, sf):
    """No classifier is ready: every event is degraded and none is lost."""
    rows = cascade.first_tier(events(spark, sf).withColumn("source_type", F.lit("syslog")), cascade.Models())
    return rows.agg(F.count("*").alias("events"), F.count_if("score_degraded").alias("degraded"), F.max("classifier_score").alias("classifier"))
