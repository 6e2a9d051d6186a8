"""Queries over scored events: rules, features, scores, similarity, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions.vector import softmax
from sparkwarden.operators import drift, features, models, rules, scoring, similarity
from sparkwarden.operators.normalize import normalize
from sparkwarden.plans.common import EVENTS, LINES, Registry, events, syslog_lines, table
from sparkwarden.streaming.stateful import rate_limit

R = Registry()

RULES = [
    ("r-contains", 0, "CommandLine", "contains", "the "), ("r-starts", 1, "Details", "startswith", "The"), ("r-ends", 2, "Path", "endswith", "."), ("r-word", 3, "QueryName", None, "that"),
    ("r-field", 4, "Unmapped", "contains", "the"), ("r-wild", 5, "ObjectName", "contains", "*ing*of*"), ("r-mod", 6, "Details", "re", "x"), ("r-two", 7, "Details", None, "con"), ("r-two", 7, "Details", "contains", "schaft"),
]
NAMES = ["the.and", "sh+ing tion", "of", "ver den", "with"]
_MATCH = """list_filter([
  CASE WHEN contains(lower({t}), 'the') THEN 'r-contains' END, CASE WHEN starts_with(lower({t}), 'the') THEN 'r-starts' END, CASE WHEN ends_with(lower({t}), '.') THEN 'r-ends' END,
  CASE WHEN list_contains(list_transform(regexp_split_to_array(lower({t}), '\\s+'), lambda w: trim(w, '.,;:!?')), 'that') THEN 'r-word' END,
  CASE WHEN contains(lower({t}), 'ing of') THEN 'r-wild' END,
  CASE WHEN list_contains(list_transform(regexp_split_to_array(lower({t}), '\\s+'), lambda w: trim(w, '.,;:!?')), 'con') OR contains(lower({t}), 'schaft') THEN 'r-two' END], lambda x: x IS NOT NULL)"""


@R.add(f"SELECT conv_id, turn, array_to_string({_MATCH.format(t='text')}, ',') AS rules FROM conversations")
def sigma_rules(spark, sf):
    out = rules.match_rules(table(spark, sf, "conversations"), spark.createDataFrame(RULES, rules.RULE_SCHEMA))
    return out.select("conv_id", "turn", F.array_join("sigma_rule_ids", ",").alias("rules"))


@R.add(f"""WITH {LINES} SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error' OR (event_type = 'click' AND k < 5)) AS attacks FROM lines GROUP BY event_type""")
def attack_signatures(spark, sf):
    return syslog_lines(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(rules.is_attack(F.col("raw"))).alias("attacks"))


@R.add(r"""WITH d AS (SELECT doc_id, coalesce(lower(text), '') AS t, regexp_extract_all(coalesce(lower(text), ''), '[a-z0-9_./:-]+') AS w FROM documents)
SELECT doc_id,
  CAST(contains(t, 'the.and') OR contains(t, 'the.and') AS INT) AS f0,
  CAST(contains(t, 'sh ing tion') OR (CAST(list_contains(w, 'ing') AS INT) + CAST(contains(t, 'tion') AS INT)) / 2 >= 0.5 AS INT) AS f1,
  CAST(contains(t, 'of') AS INT) AS f2, CAST(contains(t, 'ver den') OR (CAST(list_contains(w, 'ver') AS INT) + CAST(list_contains(w, 'den') AS INT)) / 2 >= 0.5 AS INT) AS f3, CAST(contains(t, 'with') AS INT) AS f4 FROM d""")
def feature_vectors(spark, sf):
    v = features.feature_vector(F.col("text"), NAMES)
    docs = table(spark, sf, "documents").select("doc_id", v.alias("v"))
    return docs.select("doc_id", *[F.col("v")[k].cast("int").alias(f"f{k}") for k in range(5)])


@R.add("SELECT CAST(user_id AS BIGINT) AS task_id, event_type AS event_id, count(*) AS cnt FROM events GROUP BY ALL")
def bag_of_events(spark, sf):
    return features.bag_of_events(table(spark, sf, "events"), "user_id", "event_type")


def _scored(spark, sf):
    """Raw lines to scores: parsing, a stand-in classifier, floors, composite and label."""
    rows = normalize(syslog_lines(spark, sf)).withColumn("classifier_score", F.col("score")).withColumn("sigma_matched", F.col("k") == 99)
    rows = rows.withColumn("entity_boost", F.when(F.col("k") % 10 == 0, 0.2).otherwise(0.0)).withColumn("cross_encoder_max", F.when(F.col("k") % 4 == 0, F.col("k") / 100.0).otherwise(0.0)).withColumn("novelty_score", F.col("k") / 200.0)
    return scoring.score(rows.withColumn("dedup_penalty", F.when(F.col("k") % 8 == 0, 0.3).otherwise(0.0)).withColumn("entity_confidence", F.when(F.col("k") % 3 == 0, F.col("k") / 100.0)))


_SCORES = f"""WITH {EVENTS}, s AS (
  SELECT *, event_type = 'error' OR (event_type = 'click' AND k < 5) AS attack, CASE WHEN k % 4 = 0 THEN k / 100.0 ELSE 0.0 END AS ce FROM e), c AS (
  SELECT *, CASE WHEN k = 99 THEN greatest(0.9, score) WHEN attack THEN greatest(0.6, score) ELSE score END AS cls FROM s), t AS (
  SELECT *, greatest(0.0, least(1.0, 0.35 * cls + 0.25 * CASE WHEN k % 10 = 0 THEN 0.2 ELSE 0.0 END + 0.4 * ce + 0.15 * (k / 200.0) - CASE WHEN ce > 0 AND NOT attack AND k % 8 = 0 THEN 0.3 ELSE 0.0 END)) AS total FROM c), p AS (
  SELECT *, CASE WHEN k = 99 OR total >= 0.8 THEN 'HIGH' WHEN total >= 0.5 THEN 'MEDIUM' WHEN total >= 0.2 THEN 'LOW' ELSE 'INFO' END AS label FROM t)"""


@R.add(_SCORES + " SELECT label AS ai_priority, count(*) AS n FROM p GROUP BY label")
def score_priority_counts(spark, sf):
    return _scored(spark, sf).groupBy("ai_priority").agg(F.count("*").alias("n"))


@R.add(
    _SCORES + """ SELECT event_id, round(total, 6) AS score, label AS priority, round(coalesce(list_avg(list_filter([CASE WHEN cls > 0 THEN cls END, CASE WHEN k % 3 = 0 THEN k / 100.0 END, CASE WHEN ce > 0 THEN ce END], lambda x: x IS NOT NULL)), 0), 6) AS confidence FROM p"""
)
def composite_scores(spark, sf):
    return _scored(spark, sf).select("event_id", F.round("ai_threat_score", 6).alias("score"), F.col("ai_priority").alias("priority"), F.round("ai_confidence", 6).alias("confidence"))


@R.add(f"""WITH {EVENTS} SELECT event_id, event_type <> 'view' AND score BETWEEN 0.3 AND 0.6 AND k % 7 <> 0 AS used, round(CASE WHEN event_type <> 'view' AND score BETWEEN 0.3 AND 0.6 AND k % 7 <> 0 THEN k / 100.0 ELSE score END, 6) AS score FROM e""")
def cascade_second_tier(spark, sf):
    rows = events(spark, sf).withColumn("source_type", F.when(F.col("event_type") == "view", "syslog").otherwise("endpoint"))
    rows = scoring.classify(rows, lambda d: d["score"], lambda d: d["score"])
    out = scoring.second_tier(rows, scoring.Band(0.3, 0.6), lambda d: F.when(d["k"] % 7 != 0, d["k"] / 100.0))
    return out.select("event_id", F.col("tier2_used").alias("used"), F.round("classifier_score", 6).alias("score"))


@R.add(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_type = 'error' THEN '10.0.0.' || (user_id % 250) ELSE '' END AS entities, CAST(CASE WHEN event_type = 'error' THEN 0.2 ELSE 0.0 END AS DOUBLE) AS boost FROM e")
def entities(spark, sf):
    kept = scoring.keep_entities(models.rule_entities(F.col("message")), 0.5)
    out = events(spark, sf).withColumn("ents", kept)
    return out.select("event_id", models.entity_string(F.col("ents")).alias("entities"), scoring.entity_boost(F.transform("ents", lambda e: e["type"])).alias("boost"))


@R.add(f"WITH {EVENTS} SELECT event_id, CASE k % 3 WHEN 0 THEN 'b,c,a' WHEN 1 THEN 'a,b,c' ELSE 'c,a,b' END AS ranking FROM e")
def rerank_candidates(spark, sf):
    part = F.col("k") % 3
    one = lambda no, name, s: F.struct(F.lit(no).alias("no"), F.lit(name).alias("id"), s.cast("double").alias("score"))
    found = F.array(one(0, "a", F.when(part == 1, 2).when(part == 2, 1).otherwise(0)), one(1, "b", F.when(part == 0, 2).otherwise(1)), one(2, "c", F.when(part == 0, 1).when(part == 1, 0).otherwise(3)))
    return events(spark, sf).select("event_id", F.array_join(F.transform(scoring.rerank(found), lambda c: c["id"]), ",").alias("ranking"))


@R.add(f"WITH {EVENTS} SELECT event_id, round(exp(k / 100.0) / (exp(k / 100.0) + exp(0) + exp(1)), 6) AS p FROM e")
def softmax_scores(spark, sf):
    return events(spark, sf).select("event_id", F.round(softmax(F.array(F.col("k") / 100.0, F.lit(0.0), F.lit(1.0)))[0], 6).alias("p"))


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@R.add(f"""WITH p AS (SELECT a.vec_id, b.vec_id AS technique_id, {_DOT} AS s FROM embeddings a, embeddings b WHERE b.vec_id < 45), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, technique_id) AS rank FROM p)
SELECT vec_id, CAST(rank AS INT) AS rank, CAST(technique_id AS VARCHAR) AS technique_id, round(s, 6) AS similarity FROM r WHERE rank <= 3""")
def top_techniques(spark, sf):
    rows = table(spark, sf, "embeddings")
    t = rows.where("vec_id < 45").select(F.col("vec_id").alias("no"), F.col("vec_id").cast("string").alias("technique_id"), F.col("embedding").alias("vector"))
    return similarity.top_techniques(rows, t, "vec_id").withColumn("similarity", F.round("similarity", 6))


def _timed(spark, sf):
    """Embeddings as events: seven seconds apart, with a quiet gap after each hundredth."""
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 7 + F.floor(F.col("vec_id") / 100) * 600).alias("ts"))


_TIMED = "t AS (SELECT vec_id, embedding, label, 1700000000 + vec_id * 7 + (vec_id // 100) * 600 AS s FROM embeddings)"


@R.add(f"""WITH {_TIMED}, m AS (SELECT a.vec_id, max({_DOT}) AS s FROM t a JOIN t b ON b.vec_id < a.vec_id AND b.s >= a.s - 300 GROUP BY a.vec_id)
SELECT t.vec_id, round(coalesce(m.s, 0), 6) AS similarity, coalesce(m.s, 0) >= 0.3 AS is_duplicate FROM t LEFT JOIN m USING (vec_id)""")
def dedup_window(spark, sf):
    out = similarity.mark_duplicates(_timed(spark, sf), "vec_id", "ts", least=0.3)
    return out.select("vec_id", F.round("dedup_similarity", 6).alias("similarity"), "is_duplicate")


@R.add(f"""WITH {_TIMED}, m AS (SELECT a.vec_id, max({_DOT}) AS s FROM t a JOIN t b ON a.label = b.label AND b.vec_id < a.vec_id AND b.s >= a.s - 300 GROUP BY a.vec_id)
SELECT t.vec_id, round(coalesce(m.s, 0), 6) AS similarity, coalesce(m.s, 0) >= 0.3 AS is_duplicate FROM t LEFT JOIN m USING (vec_id)""")
def dedup_window_by_scope(spark, sf):
    out = similarity.mark_duplicates(_timed(spark, sf), "vec_id", "ts", least=0.3, scope=["label"], part=16)
    return out.select("vec_id", F.round("dedup_similarity", 6).alias("similarity"), "is_duplicate")


@R.add(f"""WITH {_TIMED}, g AS (SELECT *, coalesce(lag(s) OVER (ORDER BY s), s) - 300 AS since FROM t), m AS (SELECT a.vec_id, max({_DOT}) AS s FROM g a JOIN g b ON b.vec_id < a.vec_id AND b.s >= a.since GROUP BY a.vec_id)
SELECT t.vec_id, round(coalesce(m.s, 0), 6) AS similarity, coalesce(m.s, 0) >= 0.3 AS is_duplicate FROM t LEFT JOIN m USING (vec_id)""")
def dedup_lag_mode(spark, sf):
    out = similarity.mark_duplicates(_timed(spark, sf), "vec_id", "ts", least=0.3, mode="lag")
    return out.select("vec_id", F.round("dedup_similarity", 6).alias("similarity"), "is_duplicate")


@R.add("""WITH d AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings),
w AS (SELECT vec_id, x, avg(x) OVER (PARTITION BY i ORDER BY vec_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS m FROM d),
c AS (SELECT vec_id, sum(x * m) / nullif(sqrt(sum(m * m)), 0) AS s FROM w GROUP BY vec_id)
SELECT c.vec_id, round(CASE WHEN n >= 100 THEN least(1.0, (1 - greatest(-1.0, least(1.0, coalesce(s, 0)))) * 2.0) ELSE 0.0 END, 6) AS novelty_score, CAST(CASE WHEN n >= 100 THEN least(n, 200) ELSE 0 END AS BIGINT) AS baseline_size FROM c JOIN n USING (vec_id)""")
def novelty_rolling(spark, sf):
    return similarity.novelty(table(spark, sf, "embeddings"), "vec_id", window=200, warmup=100, baseline=50).withColumn("novelty_score", F.round("novelty_score", 6))


@R.add("""WITH d AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM d GROUP BY ALL)
SELECT label, CAST(i AS INT) AS component, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""")
def centroids(spark, sf):
    c = similarity.centroid(table(spark, sf, "embeddings"), ["label"]).select("label", F.posexplode("centroid").alias("i", "x"))
    return c.select("label", (F.col("i") + 1).alias("component"), F.round("x", 6).alias("value"))


@R.add("""WITH b AS (SELECT event_id < (SELECT max(event_id) FROM events) / 2 AS early, CAST(least(floor(value / (value + 50) * 10), 9) AS INT) AS bin FROM events), c AS (
  SELECT bin, sum(CASE WHEN early THEN 1.0 ELSE 0 END) AS e, sum(CASE WHEN early THEN 0.0 ELSE 1 END) AS a FROM b GROUP BY bin), s AS (
  SELECT greatest(coalesce(a, 0) / sum(a) OVER (), 1e-10) AS a, greatest(coalesce(e, 0) / sum(e) OVER (), 1e-10) AS e FROM (SELECT bin FROM range(10) r(bin)) LEFT JOIN c USING (bin)) SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM s""")
def psi_drift(spark, sf):
    rows = events(spark, sf).crossJoin(F.broadcast(table(spark, sf, "events").agg((F.max("event_id") / 2).alias("half"))))
    return drift.psi(rows.where("event_id < half"), rows.where("event_id >= half")).select(F.round("psi", 6).alias("psi"))


@R.add("""WITH b AS (SELECT row_number() OVER (ORDER BY event_id) AS "at", CAST(least(floor(value / (value + 50) * 10), 9) AS INT) AS bin FROM events), k AS (SELECT "at" FROM b WHERE "at" >= 501 AND ("at" - 501) % 500 = 0),
spine AS (SELECT "at", bin FROM k, range(10) r(bin)), n AS (SELECT k."at", b.bin, count(*) AS n FROM k JOIN b ON b."at" BETWEEN k."at" - 499 AND k."at" GROUP BY ALL), f AS (SELECT bin, count(*) AS n FROM b WHERE "at" <= 500 GROUP BY bin),
s AS (SELECT spine."at", greatest(coalesce(n.n, 0) / 500.0, 1e-10) AS a, greatest(coalesce(f.n, 0) / 500.0, 1e-10) AS e FROM spine LEFT JOIN n USING ("at", bin) LEFT JOIN f USING (bin)),
p AS (SELECT "at", sum((a - e) * ln(a / e)) AS psi FROM s GROUP BY "at"), g AS (SELECT *, psi > 0.02 AS drift, coalesce(lag(psi > 0.02) OVER (ORDER BY "at"), false) AS was FROM p)
SELECT CAST("at" AS INT) AS "at", round(psi, 6) AS psi, drift, CASE WHEN drift AND NOT was THEN 'start' WHEN was AND NOT drift THEN 'end' END AS edge FROM g""")
def psi_checkpoints(spark, sf):
    return drift.drift_checks(events(spark, sf), "event_id", window=500, interval=500, limit=0.02).withColumn("psi", F.round("psi", 6))


_CALLS = "c AS (SELECT event_id, CAST(user_id % 10 AS VARCHAR) AS client, event_id * 7 AS t FROM events)"


@R.add(f"""WITH RECURSIVE {_CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, event_id) AS n FROM c),
r(client, n, event_id, accepted, kept) AS (
  SELECT client, n, event_id, true, [t] FROM o WHERE n = 1
  UNION ALL SELECT o.client, o.n, o.event_id, len(list_filter(r.kept, lambda x: x >= o.t - 60)) < 1,
    CASE WHEN len(list_filter(r.kept, lambda x: x >= o.t - 60)) < 1 THEN list_append(list_filter(r.kept, lambda x: x >= o.t - 60), o.t) ELSE list_filter(r.kept, lambda x: x >= o.t - 60) END
  FROM r JOIN o ON o.client = r.client AND o.n = r.n + 1)
SELECT client, event_id, accepted FROM r""")
def rate_limit_60s(spark, sf):
    """A call every seven seconds, of ten clients by turns that the table draws; each decision rests on those before."""
    calls = table(spark, sf, "events").select("event_id", (F.col("user_id") % 10).cast("string").alias("client"), F.timestamp_seconds(F.col("event_id") * 7).alias("at"))
    return rate_limit(calls, "client", "at", "event_id", limit=1, seconds=60.0)
