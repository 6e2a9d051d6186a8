"""Queries over training data: tags, spans, splits, pairs, densities, reports of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions.vector import softmax
from sparkwarden.operators import datasets, evaluation, features, models
from sparkwarden.plans.common import EVENTS, Registry, events, table
from sparkwarden.sources import files

R = Registry()
_TAGS = ["O", "B-Malware", "I-Malware", "B-System", "I-System"]


def _tagged(spark, sf):
    """Events of a user as tagged lines; every fifth is the blank line that ends a sentence."""
    tag = F.when(F.col("event_type") == "error", "B-Malware").when(F.col("event_type") == "click", "I-Malware").when(F.col("event_type") == "view", "B-System").when(F.col("event_type") == "signup", "B-Nothing").otherwise("O")
    value = F.when(F.col("event_id") % 5 == 0, F.lit(" ")).otherwise(F.concat("event_type", F.lit("\t"), tag))
    return table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_id").alias("line_no"), value.alias("value"))


_SENTENCES = """l AS (SELECT 'u' || user_id AS file, event_id, event_id % 5 = 0 AS blank, event_type AS token, CASE event_type WHEN 'error' THEN 'B-Malware' WHEN 'click' THEN 'I-Malware' WHEN 'view' THEN 'B-System' ELSE 'O' END AS tag FROM events),
n AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY file ORDER BY event_id) AS sentence FROM l),
s AS (SELECT file, sentence, string_agg(token, ' ' ORDER BY event_id) AS tokens, string_agg(tag, ' ' ORDER BY event_id) AS labels FROM n WHERE NOT blank GROUP BY ALL)"""


@R.add(f"WITH {_SENTENCES} SELECT file, CAST(sentence AS BIGINT) AS sentence, tokens, labels FROM s")
def tagged_sentences(spark, sf):
    out = datasets.sentences(_tagged(spark, sf), _TAGS)
    return out.select("file", "sentence", F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"))


@R.add(f"WITH {_SENTENCES} SELECT tag[3:] AS type, count(*) AS n FROM n WHERE NOT blank AND starts_with(tag, 'B-') GROUP BY 1")
def entity_counts(spark, sf):
    return datasets.entity_counts(datasets.sentences(_tagged(spark, sf), _TAGS))


@R.add("""WITH w AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id // 3 END AS word, CASE WHEN event_type = 'error' THEN 'B-Malware' ELSE 'O' END AS tag FROM events),
l AS (SELECT *, lag(word) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM w)
SELECT user_id, event_id, CASE WHEN word IS NULL THEN NULL WHEN word IS NOT DISTINCT FROM before THEN replace(tag, 'B-', 'I-') ELSE tag END AS label FROM l""")
def subword_labels(spark, sf):
    words = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.floor(F.col("event_id") / 3)).alias("word_id"), F.when(F.col("event_type") == "error", "B-Malware").otherwise("O").alias("tag"))
    return datasets.subword_labels(words, "event_id", "user_id").select("user_id", "event_id", "label")


@R.add(f"WITH {EVENTS} SELECT event_id, CASE WHEN k < 10 THEN '0-' || (k + 1) || ',20-25' WHEN k < 20 THEN '0-' || (k + 1) ELSE '0-' || (k + 1) END AS spans FROM e")
def greedy_spans(spark, sf):
    """Of spans that start together the longest stays; what begins inside a span that stays goes."""
    one = lambda s, e: F.struct(F.lit(s).alias("start"), e.cast("int").alias("end"))
    spans = F.when(F.col("k") < 10, F.array(one(20, F.lit(25)), one(0, F.col("k") + 1), one(0, F.lit(1)))).otherwise(F.array(one(5, F.lit(6)), one(0, F.col("k") + 1), one(0, F.lit(2))))
    kept = datasets.greedy_spans(spans)
    return events(spark, sf).select("event_id", F.array_join(F.transform(kept, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"))


@R.add("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM n")
def positional_split(spark, sf):
    return datasets.positional_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@R.add("WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier) SELECT seq, s_suppkey, seq // 16 AS chunk FROM range(1000) x(seq) JOIN n ON r = seq % n")
def replicated_rows(spark, sf):
    out = datasets.replicate(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 1000)
    return out.select("seq", "s_suppkey", F.floor(F.col("seq") / 16).alias("chunk"))


@R.add("SELECT s_suppkey AS id, s_acctbal AS balance, 0 AS size FROM supplier UNION ALL SELECT p_partkey, 0.0, p_size FROM part")
def aligned_union(spark, sf):
    return datasets.align(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")))


@R.add("""WITH p AS (SELECT doc_id, lang || '-' || source AS positive FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) SELECT doc_id, positive, min(doc_id) OVER (PARTITION BY positive) AS corpus_id FROM p""")
def retrieval_corpus(spark, sf):
    pairs = table(spark, sf, "documents").where("lang is not null and source is not null").select("doc_id", F.concat("lang", F.lit("-"), "source").alias("positive"), F.col("doc_id").alias("no"))
    return datasets.retrieval_set(pairs).select("doc_id", "positive", "corpus_id")


@R.add("""WITH t AS (SELECT doc_id, left(trim(text, ' '), 1500) AS t FROM documents) SELECT min(doc_id) AS doc_id, sha256(t) AS pair FROM t WHERE length(t) >= 20 GROUP BY t""")
def simcse_pairs(spark, sf):
    pairs = datasets.simcse_pairs(table(spark, sf, "documents"))
    return pairs.where("anchor = positive").select("doc_id", F.sha2("anchor", 256).alias("pair"))


@R.add("""SELECT s_suppkey, CAST(i AS INT) AS i FROM supplier, range(20) x(i) WHERE CAST('0x' || left(md5(s_suppkey || ':' || i || ':42'), 8) AS BIGINT) / 4294967296.0 < 0.3""")
def random_vectors(spark, sf):
    v = datasets.random_vectors(table(spark, sf, "supplier"), "s_suppkey", 20, 0.3)
    return v.select("s_suppkey", F.posexplode("features").alias("i", "x")).where("x = 1").select("s_suppkey", "i")


@R.add("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type AS e, min(n) AS lo, max(n) AS hi FROM c GROUP BY 1),
u AS (SELECT event_type || '-days' AS name, CAST(event_type = 'error' AS INT) AS is_anomaly FROM events GROUP BY event_type),
t AS (SELECT name || '-' || k AS task_id, name, e AS event_id, lo, hi, is_anomaly FROM u, range(50) x(k), s)
SELECT task_id, name, event_id, CAST(lo + floor(CAST('0x' || left(md5(task_id || ':' || event_id || ':42'), 8) AS BIGINT) / 4294967296.0 * (hi - lo + 1)) AS BIGINT) AS cnt, is_anomaly FROM t""")
def scenario_counts(spark, sf):
    """Synthetic tasks of a scenario for each kind of event, within the counts that the table's users have of each."""
    rows = table(spark, sf, "events")
    seen = rows.groupBy("user_id", "event_type").count().groupBy("event_type").agg(F.min("count").alias("lo"), F.max("count").alias("hi"))
    kinds = seen.agg(F.collect_list(F.struct(F.col("event_type").alias("event"), F.col("lo").alias("min"), F.col("hi").alias("max"))).alias("events"))  # a few kinds
    names = rows.select("event_type").distinct()
    scenarios = names.crossJoin(F.broadcast(kinds)).select(F.concat("event_type", F.lit("-days")).alias("name"), "events", (F.col("event_type") == "error").cast("int").alias("is_anomaly"))  # one row
    return datasets.scenario_vectors(scenarios, 50)


@R.add(r"""WITH v AS (SELECT doc_id, coalesce(lower(text), '') AS t FROM documents), f AS (SELECT CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'with') AS INT) + CAST(contains(t, 'zzzz') AS INT) AS n FROM v)
SELECT round(sum(n) / (3 * count(*)), 6) AS nonzero_fraction, round(avg(n), 6) AS mean_active FROM f""")
def feature_density(spark, sf):
    docs = table(spark, sf, "documents").select(features.feature_vector(F.col("text"), ["the", "with", "zzzz"]).alias("features"))
    return features.feature_density(docs).select(*[F.round(c, 6).alias(c) for c in ("nonzero_fraction", "mean_active")])


@R.add("SELECT user_id AS task_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def wide_bag(spark, sf):
    bag = features.bag_of_events(table(spark, sf, "events"), "user_id", "event_type")
    return features.wide(bag, ["click", "error"])


@R.add("SELECT quality, count(*) AS n, round(avg((coalesce(n_chars, 0) % 997) / 997.0), 6) AS avg_score FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def scores_by_label(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", ((F.coalesce("n_chars", F.lit(0)) % 997) / 997.0).alias("score"))
    return evaluation.by_label(table(spark, sf, "labels").join(docs, "doc_id"), "quality", "score").withColumn("avg_score", F.round("avg_score", 6))


@R.add("SELECT round(count(*) FILTER (quality = 0) / greatest(count(*) FILTER (quality = 1), 1), 6) AS scale_pos_weight FROM labels")
def positive_weight(spark, sf):
    return evaluation.scale_pos_weight(table(spark, sf, "labels"), "quality").select(F.round("scale_pos_weight", 6).alias("scale_pos_weight"))


@R.add(f"""WITH {EVENTS}, c AS (SELECT event_type AS type, count(*) FILTER (k < 60 AND k >= 20) AS tp, count(*) FILTER (k < 20) AS fp, count(*) FILTER (k >= 60) AS fn FROM e GROUP BY 1)
SELECT type, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""")
def span_metrics(spark, sf):
    return evaluation.span_metrics(events(spark, sf).select(F.col("event_type").alias("type"), (F.col("k") < 60).alias("predicted"), (F.col("k") >= 20).alias("actual")))


@R.add(f"""WITH {EVENTS}, p AS (SELECT k % 3 AS label, CASE WHEN k < 40 THEN 0 WHEN k < 80 THEN 1 ELSE 2 END AS best FROM e), n AS (SELECT label, count(*) FILTER (best = label) AS tp, count(*) AS n FROM p GROUP BY label)
SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg(CASE WHEN best = label THEN 1.0 ELSE 0 END) FROM p), 6) AS accuracy""")
def softmax_accuracy(spark, sf):
    top = F.when(F.col("k") < 40, 0).when(F.col("k") < 80, 1).otherwise(2)
    logits = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.when(i == top, 2.0).otherwise(0.5))
    rows = events(spark, sf).select((F.col("k") % 3).alias("label"), softmax(logits).alias("p"))
    return evaluation.argmax_metrics(rows, "label", "p").select("n", F.round("accuracy", 6).alias("accuracy"))


@R.add(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS label FROM e WHERE event_type <> 'error'")
def label_map(spark, sf):
    rows = events(spark, sf).select("event_id", "message", F.when(F.col("event_type") != "error", F.when(F.col("event_type") == "view", "Attack").otherwise("BENIGN")).alias("label"))
    return files.label_map(rows).select("event_id", "label")


@R.add(f"WITH {EVENTS} SELECT event_id, round(CASE WHEN k % 5 = 0 THEN 0.5 ELSE 1 / (1 + exp(-(-1 + 0.5 * (k % 5) + 2 * (k % 5) / 10))) END, 6) AS score FROM e")
def linear_scores(spark, sf):
    """A logistic model inside Catalyst; rows without features get the neutral score."""
    part = (F.col("k") % 5).cast("double")
    return events(spark, sf).select("event_id", F.round(models.linear_classifier(F.array(part, part / 10), [0.5, 2.0], -1.0, neutral=0.5), 6).alias("score"))


@R.add("WITH b AS (SELECT avg(value) / 100 AS b FROM events) SELECT event_id, round(1 / (1 + exp(b - 2 * value / 100)), 6) AS score, round(1 / (1 + exp(b)), 6) AS of_nothing FROM events, b")
def zero_vector_probe(spark, sf):
    """What a model says of each event, and of one without features; its bias comes from the table."""
    rows = table(spark, sf, "events")
    bias = -rows.agg(F.avg("value") / 100).first()[0]
    model = lambda v: models.linear_classifier(v, [2.0, 1.0], bias)
    probe = models.zero_probe(rows, model, 2).select(F.round("score", 6).alias("of_nothing"))
    told = rows.select("event_id", F.round(model(F.array(F.col("value") / 100, F.lit(0.0))), 6).alias("score"))
    return told.crossJoin(F.broadcast(probe))  # one row


@R.add(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_type = 'error' THEN 'T1:1.00,T2:0.00' WHEN event_type = 'purchase' THEN 'T2:0.50,T1:0.00' ELSE 'T1:0.00,T2:0.00' END AS ranking FROM e WHERE event_type IN ('error', 'purchase', 'view', 'signup')")
def overlap_ranking(spark, sf):
    """The stand-in of a cross-encoder: words of a description that the text holds."""
    known = F.array(F.struct(F.lit(0).alias("no"), F.lit("T1").alias("id"), F.lit("Failed password").alias("description")), F.struct(F.lit(1).alias("no"), F.lit("T2").alias("id"), F.lit("payment refused").alias("description")))
    from sparkwarden.operators.scoring import rerank

    best = rerank(models.token_overlap_scores(F.col("message"), known))
    shown = F.array_join(F.transform(best, lambda c: F.concat(c["id"], F.lit(":"), F.format_string("%.2f", c["score"]))), ",")
    return events(spark, sf).where("event_type in ('error', 'purchase', 'view', 'signup')").select("event_id", shown.alias("ranking"))


@R.add("SELECT event_id, false AS is_duplicate, 0.0::DOUBLE AS novelty_score, '' AS ai_entities FROM events")
def stages_off(spark, sf):
    return models.disabled_stages(table(spark, sf, "events")).select("event_id", "is_duplicate", "novelty_score", "ai_entities")
