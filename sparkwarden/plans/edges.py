"""Queries at the edges: admission, requests, dead letters, archive, spool, registry, monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import refs, text, vector
from sparkwarden.operators import archive, drift, metrics, normalize, output, registry, similarity, vendor
from sparkwarden.plans.common import EVENTS, LINES, Registry, events, syslog_lines, table
from sparkwarden.sources import envelopes, sinks

R = Registry()


@R.add(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '192.0.2.' || (user_id % 9) ELSE 'unknown' END AS host, message AS text, 'generic' AS source_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000000+00:00' AS timestamp FROM (SELECT event_id, user_id, message, date_trunc('second', ts) AS ts FROM e)")
def peer_hosts(spark, sf):
    rows = events(spark, sf).select("event_id", F.col("message").alias("raw"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("came"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("192.0.2."), F.col("user_id") % 9)).otherwise("unknown").alias("peer"))
    return normalize.normalize(rows, peer="peer", ingest_ts="came").select("event_id", "host", "text", "source_type", "timestamp")


@R.add(f"""WITH {LINES} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'syslog' END AS source_type FROM lines""")
def hinted_formats(spark, sf):
    """A hint moves a format's parsers to the front; one that doesn't fit the line changes nothing."""
    web = F.concat(F.lit('10.0.0.1 - u [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 1'))
    rows = syslog_lines(spark, sf).withColumn("raw", F.when(F.col("event_id") % 2 == 0, web).otherwise(F.col("raw"))).withColumn("hint", F.when(F.col("event_id") % 3 == 0, "web").otherwise("nonsense"))
    return normalize.normalize(rows, hint="hint").select("event_id", "source_type")


@R.add(r"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"EventID": ' || k || '}' WHEN 1 THEN 'message={a ' || k || '}' WHEN 2 THEN 'denied ' || k ELSE 'as it is ::: ' || k END AS message FROM e""")
def vendor_messages(spark, sf):
    part, k = F.col("event_id") % 4, F.col("k")
    raw = F.when(part == 0, F.concat(F.lit('winlog ::: {"EventID": '), k, F.lit("}"))).when(part == 1, F.concat(F.lit("fw-Artifact ::: x message={a "), k, F.lit("}"))).when(part == 2, F.concat(F.lit("fw-Artifact ::: denied "), k))
    kind = F.when(part == 0, "winevent").when(part < 3, "firewall").otherwise("syslog")
    return events(spark, sf).select("event_id", vendor.clean_message(raw.otherwise(F.concat(F.lit("as it is ::: "), k)), kind).alias("message"))


@R.add("""SELECT CASE WHEN user_id % 5 = 0 THEN 'empty' WHEN user_id % 5 = 1 THEN 'oversize' WHEN user_id % 5 = 2 THEN 'peer' END AS reason, count(*) AS n, count(*) FILTER (user_id % 5 > 2) AS admitted FROM events GROUP BY 1""")
def drop_reasons(spark, sf):
    part = F.col("user_id") % 5
    rows = table(spark, sf, "events").select("event_id", F.when(part == 0, F.lit(" \t")).when(part == 1, F.repeat(F.lit("é"), 40)).otherwise(F.lit("line")).alias("raw"), F.when(part == 2, "8.8.8.8").otherwise("10.1.2.3").alias("collector_peer"))
    kept = envelopes.admit(rows, networks=["10.0.0.0/8"], most=64).select("event_id", F.lit(1).alias("in"))
    reasons = rows.join(kept, "event_id", "left").withColumn("reason", envelopes.drop_reason(F.col("raw"), F.col("collector_peer"), ["10.0.0.0/8"], most=64))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"), F.count("in").alias("admitted"))


@R.add("""SELECT CASE WHEN user_id % 4 = 0 THEN 'raw is empty' WHEN user_id % 4 = 1 THEN 'raw is too long' WHEN user_id % 4 = 2 THEN 'raw_log_ref is malformed' END AS error, count(*) AS n FROM events GROUP BY 1""")
def request_errors(spark, sf):
    part = F.col("user_id") % 4
    rows = table(spark, sf, "events").select(F.when(part == 0, "").when(part == 1, F.repeat(F.lit("x"), 65_537)).otherwise("line").alias("raw"), F.when(part == 2, "ABC").when(part == 3, F.sha2(F.lit("x"), 256)).alias("ref"))
    return envelopes.request_checks(rows, ref="ref").groupBy("error").agg(F.count("*").alias("n"))


@R.add("""WITH b AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, CASE WHEN n > 60 THEN 'a batch holds 1 to 60 events' END AS error FROM b""")
def batch_requests(spark, sf):
    sizes = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return sizes.withColumn("error", envelopes.batch_error(F.col("n"), most=60))


@R.add("""WITH b AS (SELECT user_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events GROUP BY user_id)
SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS rows, round(avg(n), 6) AS mean_size, max(n) AS max_size, max(span) / 1e6 AS max_span_s FROM b""")
def batch_report(spark, sf):
    return metrics.batch_report(table(spark, sf, "events"), ["user_id"], "ts").withColumn("mean_size", F.round("mean_size", 6))


@R.add(f"""WITH {EVENTS} SELECT event_id, 'timeout ' || k AS error, 'raw-logs' AS original_topic, k % 3 + 1 AS retry_count, CAST(k AS VARCHAR) AS k_text FROM e WHERE k % 2 = 0""")
def dead_letter_envelopes(spark, sf):
    failed = events(spark, sf).where("k % 2 = 0").select("event_id", "k", (F.col("k") % 3).alias("retry_count"))
    out = archive.dead_letters(failed, F.concat(F.lit("timeout "), "k"), "raw-logs", F.lit("t"))
    return out.select(F.get_json_object("original", "$.event_id").cast("long").alias("event_id"), "error", "original_topic", "retry_count", F.get_json_object("original", "$.k").alias("k_text"))


@R.add("""SELECT CASE WHEN user_id % 4 = 0 THEN 'conflict' WHEN user_id % 4 = 1 THEN 'created' ELSE 'failed' END AS outcome, count(*) AS n FROM events GROUP BY 1""")
def bulk_outcomes(spark, sf):
    status = F.when(F.col("user_id") % 4 == 0, 409).when(F.col("user_id") % 4 == 1, 201).when(F.col("user_id") % 4 == 2, 503)
    return archive.bulk_errors(table(spark, sf, "events").select(status.alias("status"))).groupBy("outcome").agg(F.count("*").alias("n"))


@R.add("SELECT event_id, user_id FROM events WHERE event_id = 42")
def archive_get(spark, sf):
    stamp = F.col("ts").cast("timestamp")
    rows = table(spark, sf, "events").select("event_id", "user_id", F.sha2(F.col("event_id").cast("string"), 256).alias("raw_log_ref"), refs.index_day(stamp).alias("ingest_date"))
    ref = "73475cb40a568e8da8a045ced110137e159f890ac4da883b6b17dc651b3a8049"
    return archive.get(rows, ref).select("event_id", "user_id")


@R.add("SELECT DISTINCT strftime(ts, '%Y.%m.%d') AS ingest_date FROM events WHERE ts < TIMESTAMP '2024-01-11'")
def archive_expired_days(spark, sf):
    rows = table(spark, sf, "events").select(refs.index_day(F.col("ts").cast("timestamp")).alias("ingest_date"))
    return archive.expired(rows, "2024-01-21", 10)


@R.add("SELECT DISTINCT strftime(ts, '%Y.%m.%d') AS ingest_date, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'delete' WHEN ts < TIMESTAMP '2024-01-17' THEN 'warm' ELSE 'hot' END AS phase FROM events")
def archive_phases(spark, sf):
    rows = table(spark, sf, "events").select(refs.index_day(F.col("ts").cast("timestamp")).alias("ingest_date"))
    return archive.phases(rows, "2024-01-21", 4, 10)


@R.add("SELECT 's' || s_suppkey AS run_id FROM supplier WHERE s_suppkey = 7")
def registry_by_folder(spark, sf):
    key = F.col("s_suppkey")
    runs = table(spark, sf, "supplier").select(F.concat(F.lit("s"), key).alias("run_id"), F.concat(F.lit("/models/"), key).alias("artifact_dir"), F.timestamp_seconds(key).alias("created_at"))
    return registry.find(runs, artifact_dir="/models/7").select("run_id")


@R.add("""SELECT 'run-' || s_suppkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'v' || s_suppkey ELSE 'run-' || s_suppkey END AS version, CASE WHEN s_suppkey = 9 THEN 'archived' ELSE 'staging' END AS status, CASE WHEN s_suppkey = 4 THEN 0.5 ELSE s_acctbal END AS f1 FROM supplier""")
def registry_runs(spark, sf):
    key = F.col("s_suppkey")
    new = table(spark, sf, "supplier").select(F.concat(F.lit("run-"), key).alias("run_id"), F.lit("t").alias("model_type"), F.when(key % 2 == 0, F.concat(F.lit("v"), key)).alias("version"), F.lit("").alias("status"), F.lit("/m").alias("artifact_dir"), F.lit(None).cast("timestamp").alias("created_at"), F.create_map(F.lit("f1"), F.col("s_acctbal")).alias("metrics"))
    runs = registry.insert(spark.createDataFrame([], registry.SCHEMA), new)
    runs = registry.update_metrics(registry.archive(runs, "run-9"), "run-4", {"f1": 0.5})
    return runs.select("run_id", "version", "status", F.col("metrics")["f1"].alias("f1"))


@R.add("SELECT 's' || s_suppkey AS run_id FROM supplier WHERE s_nationkey % 2 = 0 ORDER BY s_acctbal DESC, run_id LIMIT 5")
def registry_newest(spark, sf):
    runs = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("run_id"), F.concat(F.lit("t"), F.col("s_nationkey") % 2).alias("model_type"), F.lit("staging").alias("status"), F.timestamp_micros((F.col("s_acctbal") * 100).cast("long") * 10_000).alias("created_at"))
    return registry.find(runs, "t0", "staging", 5).select("run_id")


@R.add("""SELECT 'part-' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'extra' WHEN doc_id % 5 = 2 THEN 'changed' ELSE 'ok' END AS status FROM documents""")
def manifest_status(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("part-"), "doc_id").alias("path"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")).withColumn("length", F.length("content"))
    wanted = registry.manifest(docs.where("doc_id % 5 <> 1"))
    found = docs.where("doc_id % 5 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 2, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content")))
    return registry.verify(wanted, registry.manifest(found))


@R.add("SELECT doc_id, round(strlen(coalesce(text, '')) / 1048576.0, 3) AS size_mb, left(sha256(coalesce(text, '')), 16) AS sha256_prefix FROM documents")
def manifest_entries(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    found = registry.manifest(docs.withColumn("length", F.length("content")))
    both = found.join(docs.select("path", refs.content_digest(F.col("content")).alias("again")), "path")
    return both.where("again = sha256_prefix").select(F.col("path").alias("doc_id"), "size_mb", "sha256_prefix")


@R.add("SELECT event_type, user_id % 7 AS shard, count(*) AS value FROM events GROUP BY ALL")
def labelled_counters(spark, sf):
    return metrics.counter(table(spark, sf, "events").withColumn("shard", F.col("user_id") % 7), ["event_type", "shard"])


@R.add(f"""WITH {EVENTS} SELECT event_type, count(*) AS requests, count(*) FILTER (k >= 90) AS errors, round(count(*) FILTER (k >= 90) / count(*), 6) AS error_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM e GROUP BY event_type""")
def endpoint_throughput(spark, sf):
    out = metrics.throughput(events(spark, sf).withColumn("ok", F.col("k") < 90), ["event_type"], "ok", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("error_rate", "p50", "p95", "p99")})


@R.add("WITH c AS (SELECT event_type, avg(value) > 50 AS slow FROM events GROUP BY 1) SELECT NOT coalesce(bool_or(slow), false) AS healthy, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (slow), '') AS failing FROM c")
def component_health(spark, sf):
    """A component is a kind of event, and down if its mean value is above 50."""
    means = table(spark, sf, "events").groupBy(F.col("event_type").alias("component")).agg(F.avg("value").alias("mean"))
    checks = means.select("component", F.when(F.col("mean") > 50, "down").otherwise("ok").alias("status"))
    return metrics.health(checks).select("healthy", F.array_join("failing", ",").alias("failing"))


@R.add(f"""WITH {EVENTS} SELECT count(*) AS total, count(*) FILTER (k >= 80) AS high, count(*) FILTER (k BETWEEN 50 AND 79) AS medium, round(sum(value), 4) AS latency_ms FROM e""")
def response_counts(spark, sf):
    rows = events(spark, sf).select(F.when(F.col("k") >= 80, "HIGH").when(F.col("k") >= 50, "MEDIUM").otherwise("LOW").alias("ai_priority"), F.col("value").alias("scoring_latency_ms"))
    return sinks.response_counts(rows).withColumn("latency_ms", F.round("latency_ms", 4))


@R.add("SELECT event_id, round(value / 7, 4) AS ai_threat_score, round(value, 2) AS scoring_latency_ms FROM events")
def public_scores(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.lit("secret").alias("raw"), (F.col("value") / 7).alias("ai_threat_score"), F.col("value").alias("scoring_latency_ms"), F.lit(False).alias("score_degraded"))
    return sinks.rounded(rows)


@R.add("""SELECT CAST(user_id AS VARCHAR) AS key, '{"host":"' || user_id || '","n":' || event_id || '}' AS value FROM events""")
def broker_records(spark, sf):
    return output.envelope(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("n")))


@R.add(r"""SELECT event_id, CASE event_id % 5 WHEN 3 THEN 1000 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS at_s, CAST(CASE event_id % 5 WHEN 3 THEN 1000 ELSE CAST(floor(epoch(ts)) AS BIGINT) END * 1000 AS VARCHAR) AS at_ms FROM events""")
def event_times(spark, sf):
    part, ts = F.col("event_id") % 5, F.col("ts").cast("timestamp")
    stamp = F.when(part == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(part == 1, F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss +0000")).when(part == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).when(part == 3, F.lit("no time")).otherwise(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    at = normalize.event_time(stamp, F.timestamp_seconds(F.lit(1000)))
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(at).alias("at_s"), refs.epoch_millis(F.date_trunc("second", at)).alias("at_ms"))


@R.add("""SELECT doc_id, sha256('{"host":"h\\u00fc","ingest_ts":1700000000.25,"raw":"' || replace(coalesce(regexp_replace(text, '[^ -~]|["\\\\]', '', 'g'), ''), '"', '') || '\\u20ac\\t\\ud83d\\ude00\\"","source_type":"syslog"}') AS ref FROM documents""")
def ascii_refs(spark, sf):
    """References of texts beyond ASCII, as common JSON libraries write them."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), '[^ -~]|["\\\\]', "")
    ref = refs.raw_log_ref(F.concat(plain, F.lit('€\t😀"')), F.lit("syslog"), F.lit("hü"), F.lit(1700000000.25))
    return table(spark, sf, "documents").select("doc_id", ref.alias("ref"))


@R.add("SELECT event_id, 'h' || user_id || ',x' AS names, 'ok ' || event_id AS decoded, round(1.0 / (1.0 + exp(-value / 50)), 6) AS p, round(value / 2, 6) AS scaled FROM events")
def small_functions(spark, sf):
    """Ordered distinct items, decoding with replacement, the logistic function, scaling."""
    host = F.concat(F.lit("h"), "user_id")
    names = text.ordered_distinct(F.array(host, F.lit("x")), F.array(F.lit("x"), host))
    scaled = vector.scaled(F.array(F.col("value")), F.array(F.lit(2.0)))[0]
    return table(spark, sf, "events").select("event_id", names.alias("names"), text.valid_utf8(F.encode(F.concat(F.lit("ok "), "event_id"), "UTF-8")).alias("decoded"), F.round(vector.sigmoid(F.col("value") / 50), 6).alias("p"), F.round(scaled, 6).alias("scaled"))


_PSI = """b AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, CAST(least(floor(value / (value + 50) * 10), 9) AS INT) AS bin FROM events), k AS (SELECT n AS cp FROM b WHERE n >= 501 AND (n - 501) % 500 = 0),
spine AS (SELECT cp, bin FROM k, range(10) r(bin)), w AS (SELECT k.cp, b.bin, count(*) AS n FROM k JOIN b ON b.n BETWEEN k.cp - 499 AND k.cp GROUP BY ALL), f AS (SELECT bin, count(*) AS n FROM b WHERE n <= 500 GROUP BY bin),
s AS (SELECT spine.cp, greatest(coalesce(w.n, 0) / 500.0, 1e-10) AS a, greatest(coalesce(f.n, 0) / 500.0, 1e-10) AS e FROM spine LEFT JOIN w USING (cp, bin) LEFT JOIN f USING (bin)),
p AS (SELECT cp, sum((a - e) * ln(a / e)) AS psi FROM s GROUP BY cp)"""


@R.add(f"WITH {_PSI} SELECT b.event_id, coalesce((SELECT arg_max(psi, cp) FROM p WHERE p.cp < b.n) > 0.02, false) AS drifting FROM b")
def drift_states(spark, sf):
    checks = drift.drift_checks(events(spark, sf), "event_id", window=500, interval=500, limit=0.02)
    from sparkwarden.operators.ordered import running

    numbered = running(events(spark, sf).select("event_id"), "event_id", {"n": F.lit(1)}).withColumn("n", F.col("n") + 1)
    return drift.drifting_at(numbered, checks, "n", window=500, interval=500).select("event_id", "drifting")


@R.add(f"""WITH {_PSI}, g AS (SELECT *, psi > 0.02 AS d, coalesce(lag(psi > 0.02) OVER (ORDER BY cp), false) AS was FROM p)
SELECT count(*) AS checks, CAST(max(cp) AS INT) AS last_at, round(arg_max(psi, cp), 6) AS last_psi, arg_max(d, cp) AS drifting, count(*) FILTER (d AND NOT was) AS episodes FROM g""")
def drift_snapshot(spark, sf):
    return drift.snapshot(drift.drift_checks(events(spark, sf), "event_id", window=500, interval=500, limit=0.02)).withColumn("last_psi", F.round("last_psi", 6))


@R.add("""WITH b AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, CAST(least(floor(value / (value + 50) * 10), 9) AS INT) AS bin FROM events WHERE event_type <> 'error' OR event_id > 1000),
k AS (SELECT event_type, n AS cp FROM b WHERE n >= 201 AND (n - 201) % 200 = 0), spine AS (SELECT event_type, cp, bin FROM k, range(10) r(bin)),
w AS (SELECT k.event_type, k.cp, b.bin, count(*) AS n FROM k JOIN b ON b.event_type = k.event_type AND b.n BETWEEN k.cp - 199 AND k.cp GROUP BY ALL), f AS (SELECT event_type, bin, count(*) AS n FROM b WHERE n <= 200 GROUP BY ALL),
s AS (SELECT event_type, cp, greatest(coalesce(w.n, 0) / 200.0, 1e-10) AS a, greatest(coalesce(f.n, 0) / 200.0, 1e-10) AS e FROM spine LEFT JOIN w USING (event_type, cp, bin) LEFT JOIN f USING (event_type, bin))
SELECT event_type, CAST(cp AS INT) AS "at", round(sum((a - e) * ln(a / e)), 6) AS psi FROM s GROUP BY event_type, cp""")
def drift_by_stream_after_reset(spark, sf):
    """One monitor for each type of event; the one of errors was reset after event 1000."""
    resets = spark.createDataFrame([("error", 1000)], "event_type string, at long")
    rows = drift.since_reset(events(spark, sf), resets, "event_id", ["event_type"])
    return drift.drift_checks(rows, "event_id", scope=["event_type"], window=200, interval=200).select("event_type", "at", F.round("psi", 6).alias("psi"))


@R.add("""WITH d AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings),
w AS (SELECT vec_id, x, avg(x) OVER (PARTITION BY i ORDER BY vec_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS m FROM d), c AS (SELECT vec_id, sum(x * m) / nullif(sqrt(sum(m * m)), 0) AS s FROM w GROUP BY vec_id),
v AS (SELECT CASE WHEN n >= 100 THEN least(1.0, (1 - greatest(-1.0, least(1.0, coalesce(s, 0)))) * 2.0) END AS v, CASE WHEN n >= 100 THEN least(n, 200) ELSE 0 END AS b FROM c JOIN n USING (vec_id))
SELECT count(*) AS events, count(v) AS scored, round(avg(v), 6) AS mean_score, round(max(v), 6) AS max_score, CAST(max(b) AS BIGINT) AS baseline_size FROM v""")
def novelty_stats(spark, sf):
    scored = similarity.novelty(table(spark, sf, "embeddings"), "vec_id", window=200, warmup=100, baseline=50)
    return similarity.novelty_stats(scored).withColumns({c: F.round(c, 6) for c in ("mean_score", "max_score")})


@R.add("WITH late AS (SELECT * FROM embeddings WHERE vec_id > (SELECT max(vec_id) // 2 FROM embeddings)), " + R.sql["novelty_stats"].removeprefix("WITH ").replace("FROM embeddings", "FROM late"))
def novelty_stats_after_reset(spark, sf):
    """The detector was reset halfway."""
    rows = table(spark, sf, "embeddings")
    resets = rows.agg(F.floor(F.max("vec_id") / 2).alias("at"))
    scored = similarity.novelty_since(rows, resets, "vec_id", window=200, warmup=100, baseline=50)
    return similarity.novelty_stats(scored).withColumns({c: F.round(c, 6) for c in ("mean_score", "max_score")})


@R.add("""SELECT 'part-' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS status FROM documents WHERE doc_id % 5 IN (0, 2)""")
def manifest_mismatches(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("part-"), "doc_id").alias("path"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")).withColumn("length", F.length("content"))
    found = docs.where("doc_id % 5 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 2, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content")))
    return registry.mismatches(registry.manifest(docs.where("doc_id % 5 <> 1")), registry.manifest(found))
