"""Queries over lines: parsing, redaction, references, output, archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions import network, refs
from sparkwarden.operators import archive, output, redact, registry, vendor
from sparkwarden.operators.normalize import cef_extensions, normalize
from sparkwarden.plans.common import EVENTS, LINES, Registry, events, syslog_lines, table
from sparkwarden.sources import envelopes, framing, tables

R = Registry()


@R.add(f"""WITH {LINES}
SELECT event_id, 'syslog' AS source_type, 'host-' || user_id AS host, strftime(ts, '%b %d %H:%M:%S') AS timestamp,
       'Host host-' || user_id || ' Process ' || event_type || '[' || event_id || ']: ' || message AS text, CAST(event_id AS VARCHAR) AS pid FROM lines""")
def parse_rfc3164(spark, sf):
    out = normalize(syslog_lines(spark, sf))
    return out.select("event_id", "source_type", "host", "timestamp", "text", F.col("fields")["pid"].alias("pid"))


@R.add(f"""WITH {EVENTS}
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'h' || user_id AS host, 'Host h' || user_id || ' App ' || event_type || ': ' || message AS text, event_type AS app FROM e""")
def parse_rfc5424(spark, sf):
    raw = F.concat(F.lit("<34>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" h"), "user_id", F.lit(" "), "event_type", F.lit(" "), "event_id", F.lit(" - - "), "message")
    out = normalize(events(spark, sf).withColumn("raw", raw))
    return out.select("event_id", "timestamp", "host", "text", F.col("fields")["app"].alias("app"))


@R.add(f"""WITH {EVENTS}
SELECT event_id, 'firewall' AS source_type, 'fw' || (user_id % 3) AS host,
  'Firewall Wall Action ' || event_type || ' src 10.0.0.' || (user_id % 250) || ':' || k || ' dst 10.1.0.1:443 proto TCP sig ' || event_id || ' name Flow sev 5' AS text,
  'all = good here' AS msg FROM e""")
def parse_cef(spark, sf):
    raw = F.concat(
        F.lit("CEF:0|Acme|Wall|2.1|"), "event_id", F.lit("|Flow|5|src=10.0.0."), F.col("user_id") % 250, F.lit(" spt="), "k",
        F.lit(" destinationAddress=10.1.0.1 dpt=443 act=none act="), "event_type", F.lit(r" proto=TCP msg=all\ \= good here dvchost=fw"), F.col("user_id") % 3,
    )
    out = normalize(events(spark, sf).withColumn("raw", raw))
    return out.select("event_id", "source_type", "host", "text", F.col("fields")["msg"].alias("msg"))


@R.add(f"WITH {EVENTS} SELECT event_id, CAST(k AS VARCHAR) AS a, 'x y' AS b, 3 AS n FROM e")
def cef_extension_map(spark, sf):
    ext = cef_extensions(F.concat(F.lit("a=1 b=x y c= a="), "k"))
    return events(spark, sf).select("event_id", ext["a"].alias("a"), ext["b"].alias("b"), F.size(ext).alias("n"))


@R.add(f"""WITH {EVENTS}
SELECT event_id, 'web' AS source_type, '10.0.0.' || (user_id % 250) AS host, strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') AS timestamp,
  'Web request GET /' || event_type || ' from 10.0.0.' || (user_id % 250) || ' status ' || (200 + k) || ' user-agent ''' || CASE WHEN k % 2 = 0 THEN 'ua ' || k ELSE 'None' END || '''' AS text FROM e""")
def parse_combined(spark, sf):
    tail = F.when(F.col("k") % 2 == 0, F.concat(F.lit(' "-" "ua '), "k", F.lit('"'))).otherwise("")
    raw = F.concat(F.lit("10.0.0."), F.col("user_id") % 250, F.lit(" - u ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "event_type", F.lit(' HTTP/1.1" '), F.col("k") + 200, F.lit(" 17"), tail)
    return normalize(events(spark, sf).withColumn("raw", raw)).select("event_id", "source_type", "host", "timestamp", "text")


@R.add(f"""WITH {EVENTS}
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'winevent' WHEN 1 THEN 'endpoint' WHEN 2 THEN 'cloudtrail' ELSE 'generic' END AS source_type,
  CASE event_id % 4 WHEN 0 THEN 'pc' || user_id WHEN 1 THEN 'pc' || user_id WHEN 2 THEN '10.9.8.7' ELSE 'unknown' END AS host,
  CASE event_id % 4 WHEN 0 THEN 'Windows EventID ' || (4624 + k) || ': ' || event_type || ' on host pc' || user_id || ' by user u' || user_id
    WHEN 1 THEN 'Endpoint ' || event_type || ': Process p' || k || ' spawned by init executed ''run'' as user u on pc' || user_id
    WHEN 2 THEN 'CloudTrail: User u' || user_id || ' performed ' || event_type || ' on s3 resource  from 10.9.8.7 region eu error Denied'
    ELSE '{{"k": ' || k || '}}' END AS text FROM e""")
def parse_json_formats(spark, sf):
    js = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    who, host = F.concat(F.lit("u"), "user_id"), F.concat(F.lit("pc"), "user_id")
    win = js(EventID=F.col("k") + 4624, Computer=host, Message=F.col("event_type"), SubjectUserName=F.lit(""), TargetUserName=who)
    end = js(event_type=F.col("event_type"), hostname=host, ProcessName=F.concat(F.lit("p"), "k"), ParentProcessName=F.lit("init"), command_line=F.lit("run"), UserName=F.lit("u"))
    aws = js(eventSource=F.lit("s3"), eventName=F.col("event_type"), userIdentity=F.struct(who.alias("userName")), sourceIPAddress=F.lit("10.9.8.7"), awsRegion=F.lit("eu"), errorCode=F.lit("Denied"))
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, win).when(kind == 1, end).when(kind == 2, aws).otherwise(F.col("props"))
    return normalize(events(spark, sf).withColumn("raw", raw)).select("event_id", "source_type", "host", "text")


@R.add(f"WITH {EVENTS} SELECT k, count(*) AS n, round(avg(value), 6) AS avg_value FROM e GROUP BY k")
def json_props(spark, sf):
    return events(spark, sf).groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@R.add(r"SELECT doc_id, sha256(regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '<EMAIL>', 'g')) AS digest FROM documents")
def redact_emails(spark, sf):
    policy = redact.Policy(redact_credit_cards=False, redact_secrets=False)
    return table(spark, sf, "documents").select("doc_id", F.sha2(redact.redact(F.col("text"), policy), 256).alias("digest"))


@R.add(
    r"""SELECT doc_id, sha256(regexp_replace(text, '(?i)\b(password|passwd|pwd|token|api[_-]?key|secret|slack)\s*[:=]\s*("[^"]+"|''[^'']+''|[^\s,;]+)', '\1=<REDACTED>', 'g')) AS digest FROM documents"""
)
def redact_secrets(spark, sf):
    policy = redact.Policy(redact_credit_cards=False, redact_emails=False)
    return table(spark, sf, "documents").select("doc_id", F.sha2(redact.redact(F.col("text"), policy), 256).alias("digest"))


_ALL = [(pattern.replace("'", "''"), mask.replace("$1", r"\1")) for pattern, mask in [*C.SECRET_PATTERNS, C.EMAIL_PATTERN]]
_IP4 = C.IP_PATTERNS[0][0]


def _nested(text: str, steps: list) -> str:
    for pattern, mask in steps:
        text = f"regexp_replace({text}, '{pattern}', '{mask}', 'g')"
    return text


def _luhn(d: str) -> str:
    """SQL for the Luhn check of a text of digits."""
    twice = f"2 * CAST({d}[i] AS INT)"
    odd = f"(length({d}) - i) % 2 = 1"
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN {odd} THEN {twice} - CASE WHEN {twice} > 9 THEN 9 ELSE 0 END ELSE CAST({d}[i] AS INT) END)) % 10 = 0"


# Runs of digits with single marks between; 13 to 19 digits that pass the check are a card, and of a longer run each block of digits may be one.
@R.add(rf"""WITH s AS (SELECT doc_id, {_nested("text", _ALL)} AS t FROM documents),
c AS (SELECT doc_id, t, regexp_extract_all(t, '(?:\d[ -]?)+') AS runs, regexp_split_to_array(t, '(?:\d[ -]?)+') AS rest FROM s),
r AS (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM c), d AS (SELECT *, regexp_replace(run, '\D', '', 'g') AS d, regexp_extract_all(run, '\d+') AS blocks FROM r),
m AS (SELECT doc_id, i, CASE WHEN length(d) BETWEEN 13 AND 19 AND {_luhn("d")} THEN '<CREDIT_CARD>'
    WHEN length(d) > 19 THEN array_to_string(list_transform(blocks, lambda b: CASE WHEN length(b) BETWEEN 13 AND 19 AND {_luhn("b").replace("lambda i", "lambda j").replace("[i]", "[j]").replace("- i)", "- j)")} THEN '<CREDIT_CARD>' ELSE b END), ' ') ELSE run END AS run FROM d),
l AS (SELECT doc_id, list(run ORDER BY i) AS runs FROM m GROUP BY doc_id),
j AS (SELECT c.doc_id, CASE WHEN c.t IS NULL THEN NULL WHEN len(coalesce(c.runs, [])) = 0 THEN c.t ELSE array_to_string(list_transform(range(1, len(rest) + 1), lambda i: rest[i] || coalesce(l.runs[i], '')), '') END AS t FROM c LEFT JOIN l USING (doc_id))
SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '{_IP4}', '<IP>', 'g'), '(?i)\b(host|hostname|fqdn)\s*=\s*([^\s,;]+)', '\1=<HOST>', 'g')) AS digest FROM j""".replace("\\\\", "\\"))
def redact_all(spark, sf):
    """All kinds but IPv6 addresses, which the oracle's expressions can't tell from times without looking around; tests hold those."""
    policy = redact.Policy(redact_ip_addresses=True, redact_hostnames=True)
    return table(spark, sf, "documents").select("doc_id", F.sha2(redact.redact(F.col("text"), policy), 256).alias("digest"))


@R.add(f"""WITH {LINES}
SELECT event_id, sha256('{{"host":"host-' || user_id || '","ingest_ts":' || CAST(floor(epoch(ts)) AS BIGINT) || '.0,"raw":"' || raw || '","source_type":"syslog"}}') AS raw_log_ref, strftime(ts, '%Y.%m.%d') AS day FROM lines""")
def raw_log_refs(spark, sf):
    rows = syslog_lines(spark, sf)
    stamp = F.col("ts").cast("timestamp")
    ref = refs.raw_log_ref(F.col("raw"), F.lit("syslog"), F.concat(F.lit("host-"), "user_id"), F.unix_timestamp(stamp).cast("double"))
    return rows.select("event_id", ref.alias("raw_log_ref"), refs.index_day(stamp).alias("day"))


@R.add("""SELECT event_id, sha256('{"offset":' || event_id || ',"partition":' || (user_id % 12) || ',"topic":"raw-logs"}') AS ref FROM events""")
def kafka_refs(spark, sf):
    return table(spark, sf, "events").select("event_id", refs.kafka_ref(F.lit("raw-logs"), F.col("user_id") % 12, F.col("event_id")).alias("ref"))


@R.add("SELECT sha256(coalesce(text, '')) AS ref, min(doc_id) AS first_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def archive_new_refs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("ref"))
    known = docs.where("doc_id % 3 = 0").select("ref")
    firsts = docs.groupBy("ref").agg(F.min("doc_id").alias("first_id"))
    return archive.new_rows(firsts, known, "ref").select("ref", "first_id")


@R.add("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS ref FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY doc_id) AS r FROM d)
SELECT CASE WHEN ref IN (SELECT ref FROM d WHERE doc_id % 3 = 0) OR r > 1 THEN 'conflict' ELSE 'created' END AS outcome, count(*) AS n FROM n GROUP BY 1""")
def archive_bulk_outcome(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("ref"))
    return archive.bulk_outcome(docs, docs.where("doc_id % 3 = 0"), "ref").groupBy("outcome").agg(F.count("*").alias("n"))


@R.add(f"""WITH {EVENTS} SELECT event_id, 'h' || (user_id % 5) AS host FROM e WHERE user_id % 5 = 2 AND ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 600 MINUTE AND TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id LIMIT 100""")
def archive_recent(spark, sf):
    rows = events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ingest_ts"), F.concat(F.lit("h"), F.col("user_id") % 5).alias("host"), F.col("event_id").alias("raw_log_ref"))
    return archive.recent(rows, "2024-01-20 00:00:00", 600, host="h2").select("event_id", "host")


@R.add(f"""WITH {EVENTS}, s AS (SELECT event_id, octet_length(encode(message)) + 1 AS b FROM e), r AS (SELECT event_id, sum(b) OVER (ORDER BY event_id DESC) AS upto FROM s)
SELECT event_id FROM r WHERE upto <= 20000""")
def spool_bound(spark, sf):
    return archive.bound_spool(events(spark, sf).select("event_id", F.col("message").alias("value")), "event_id", 20_000).select("event_id")


@R.add(f"""WITH {EVENTS} SELECT event_id, k % 6 + 1 AS replay_count, CASE WHEN k % 6 = 0 THEN 'none' ELSE '9' END AS inner_count FROM e WHERE k % 6 < 3 AND event_id % 7 <> 0""")
def dead_letter_replay(spark, sf):
    original = F.when(F.col("event_id") % 7 == 0, F.lit('"text"')).when(F.col("k") % 6 == 0, F.to_json(F.struct("event_id"))).otherwise(F.to_json(F.struct("event_id", (F.col("k") % 6).alias("_dlq_replay_count"), F.struct(F.lit(9).alias("_dlq_replay_count")).alias("inner"))))
    letters = events(spark, sf).select(original.alias("original"), F.lit("raw-logs").alias("original_topic"))
    return archive.replay(letters).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.get_json_object("value", "$._dlq_replay_count").cast("int").alias("replay_count"), F.coalesce(F.get_json_object("value", "$.inner._dlq_replay_count"), F.lit("none")).alias("inner_count"))


@R.add(f"""WITH {EVENTS}
SELECT event_id, 'LEEF:2.0|YourCo|AIPreprocessor|1.0|' || event_id || '|' || chr(9) || '|devTime=' || (epoch_us(ts) // 1000) || chr(9) || 'usrName=u ' || user_id || chr(9) || 'ai_threat_score=' || printf('%.4f', k / 128.0)
  || chr(9) || 'ai_priority=' || CASE WHEN k / 128.0 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END || chr(9) || 'ai_ner_confidence=0.0000' || chr(9) || 'ai_dedup_flag=false' || chr(9) || 'ai_sigma_match=false'
  || chr(9) || 'ai_source_type=syslog' || chr(9) || 'ai_scoring_latency_ms=0.0' || chr(9) || 'ai_novelty_score=0.0000' || chr(9) || 'degraded=0' || chr(9) || 'raw_log_ref=r' || event_id AS leef FROM e""")
def leef_records(spark, sf):
    rows = events(spark, sf).select(
        "event_id", F.col("ts").cast("timestamp").alias("event_ts"), F.lit("h").alias("host"), F.lit("syslog").alias("source_type"), F.concat(F.lit("r"), "event_id").alias("raw_log_ref"),
        F.create_map(F.lit("event_id"), F.col("event_id").cast("string"), F.lit("user"), F.concat(F.lit("u|"), "user_id")).alias("fields"), (F.col("k") / 128.0).alias("ai_threat_score"),
    )
    rows = rows.withColumn("ai_priority", F.when(F.col("ai_threat_score") >= 0.5, "MEDIUM").otherwise("LOW"))
    return rows.select("event_id", output.leef(rows).alias("leef"))


@R.add(f"""WITH {EVENTS}, m AS (
  SELECT event_id, '<' || (8 + CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 4 WHEN 'view' THEN 5 ELSE 6 END) || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' sparkwarden - - - ' || message || chr(10) AS msg FROM e)
SELECT event_id, octet_length(encode(msg)) || ' ' || msg AS frame FROM m""")
def syslog_frames(spark, sf):
    level = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "click", "MEDIUM").when(F.col("event_type") == "view", "LOW").otherwise("other")
    return events(spark, sf).select("event_id", output.tcp_frame(output.syslog_message(F.col("message"), level, F.col("ts"))).alias("frame"))


@R.add(f"""WITH {EVENTS} SELECT CASE WHEN k / 128.0 < 0.2 THEN 'INFO' ELSE 'LOW' END AS priority, k / 128.0 >= 0.2 AS forward,
  CASE WHEN k / 128.0 < 0.2 THEN 'score ' || printf('%.3f', k / 128.0) || ' below low threshold' ELSE 'priority=LOW' END AS reason, count(*) AS n FROM e GROUP BY ALL""")
def routing(spark, sf):
    s = F.col("k") / 128.0
    p = F.when(s < 0.2, "INFO").otherwise("LOW")
    return events(spark, sf).select(p.alias("priority"), output.decide(s, p, "suppress_low").alias("d")).groupBy("priority", F.col("d.forward").alias("forward"), F.col("d.reason").alias("reason")).agg(F.count("*").alias("n"))


@R.add("""SELECT CASE WHEN user_id % 6 = 0 THEN 'cloudtrail' WHEN user_id % 6 = 1 THEN NULL WHEN event_type = 'error' AND k <> 5 THEN 'winevent' WHEN user_id % 6 = 2 THEN 'firewall' WHEN event_type = 'view' THEN 'web' ELSE 'syslog' END AS source_type, count(*) AS n FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k FROM events) GROUP BY 1""")
def vendor_source_types(spark, sf):
    part = F.col("user_id") % 6
    pipe = F.when(part == 0, "aws_cloudtrail").when(part == 1, "network_flows").otherwise("x")
    kind = F.when(F.col("event_type") == "error", F.concat(F.lit("462"), F.col("k") % 10)).when(F.col("event_type") == "view", "iis_log").otherwise("other")
    product = F.when(part == 2, "Cisco ASA").otherwise("none")
    known = [str(n) for n in range(4620, 4630) if n != 4625]  # a set with a gap
    return events(spark, sf).select(vendor.infer_source_type(kind, pipe, product, F.lit(None), known).alias("source_type")).groupBy("source_type").agg(F.count("*").alias("n"))


@R.add("SELECT event_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN user_id % 32 < 16 ELSE user_id % 256 BETWEEN 0 AND 63 OR user_id % 256 = 77 END")
def allowed_peers(spark, sf):
    six = F.concat(F.lit("2001:DB8:0:"), F.lower(F.hex(F.col("user_id") % 32)), F.lit("::a"))
    address = F.when(F.col("event_id") % 3 == 0, six).otherwise(F.concat(F.lit("10.0.7."), F.col("user_id") % 256))
    return table(spark, sf, "events").where(network.in_networks(address, ["10.0.7.0/26", "10.0.7.77/32", "2001:db8::/60"])).select("event_id")


@R.add("""SELECT event_id, CASE WHEN user_id % 5 = 4 THEN CASE event_id % 4 WHEN 0 THEN '9.9.9.9' WHEN 1 THEN '2001:db8::7' WHEN 2 THEN '::1' ELSE 'fd00::9' END
  WHEN user_id % 2 = 1 THEN '192.0.2.9' WHEN user_id % 3 = 0 THEN '203.0.113.5' WHEN user_id % 3 = 1 THEN '10.0.0.8' ELSE '10.0.0.1' END AS client FROM events""")
def client_addresses(spark, sf):
    peer = F.when(F.col("user_id") % 2 == 1, "192.0.2.9").otherwise("10.0.0.1")
    hops = F.when(F.col("user_id") % 3 == 0, "198.51.100.7, 203.0.113.5, 10.0.0.2").when(F.col("user_id") % 3 == 1, "10.0.0.8,10.0.0.2").otherwise(F.lit(None))
    part, six = F.col("event_id") % 4, F.col("user_id") % 5 == 4  # ":::" is no address, so the peer speaks for itself
    hops6 = F.when(part == 0, "9.9.9.9").when(part == 1, "2001:db8::7, fd00::2").when(part == 2, "2001:db8::7,:::").otherwise("fd00::9, FD00:0::3,fd00::10.0.0.1")
    clients = network.client_ip(F.when(six, "::1").otherwise(peer), F.when(six, hops6).otherwise(hops), ["10.0.0.0/8", "::1/128", "fd00::/8"])
    return table(spark, sf, "events").select("event_id", clients.alias("client"))


@R.add("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'plain ' || event_id ELSE 'line ' || event_id END AS raw, CASE WHEN event_id % 5 = 0 THEN 'generic' ELSE 'web' END AS source_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'h' END AS host FROM events""")
def broker_values(spark, sf):
    value = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("plain "), "event_id")).otherwise(F.to_json(F.struct(F.concat(F.lit("line "), "event_id").alias("raw"), F.lit("web").alias("source_type"), F.lit("h").alias("host"), F.lit(1.5).alias("ingest_ts"))))
    return envelopes.parse(table(spark, sf, "events").select("event_id", value.alias("value"))).select("event_id", "raw", "source_type", "host")


_MESSAGES = """WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, event_type FROM events) SELECT 'c' || user_id AS conn, n, 'm ' || event_type AS raw FROM o"""


def _chunks(spark, sf):
    text = F.concat(F.lit("m "), "event_type")
    framed = F.when(F.col("event_id") % 2 == 0, output.tcp_frame(text)).otherwise(F.concat(text, F.lit("\n")))
    return table(spark, sf, "events").select(F.concat(F.lit("c"), "user_id").alias("conn"), F.col("event_id").alias("seq"), F.encode(framed, "UTF-8").alias("data"))


@R.add(_MESSAGES)
def tcp_messages(spark, sf):
    return framing.deframe(_chunks(spark, sf))


@R.add(_MESSAGES)
def tcp_messages_in_sql(spark, sf):
    """The same by a table function of SQL, which takes its table by connection and in order."""
    tables.register(spark)
    return spark.sql("SELECT * FROM deframe(TABLE({chunks}))", chunks=_chunks(spark, sf))


@R.add("SELECT 'm' || s_suppkey AS run_id, CASE WHEN s_suppkey = 7 THEN 'production' WHEN s_suppkey % 4 = 3 AND s_suppkey % 5 = 0 THEN 'archived' WHEN s_suppkey % 5 = 0 THEN 'production' ELSE 'staging' END AS status FROM supplier")
def registry_promotion(spark, sf):
    key = F.col("s_suppkey")
    runs = table(spark, sf, "supplier").select(F.concat(F.lit("m"), key).alias("run_id"), F.concat(F.lit("t"), key % 4).alias("model_type"), F.when(key % 5 == 0, "production").otherwise("staging").alias("status"))
    return registry.promote(runs, "m7").select("run_id", "status")
