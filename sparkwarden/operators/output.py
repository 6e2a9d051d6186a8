"""Enriched records, frames and routing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions.text import or_else, sanitise


def leef(df: DataFrame, vendor: str = C.LEEF_VENDOR, product: str = C.LEEF_PRODUCT, version: str = "1.0") -> Column:
    """A LEEF 2.0 line for each scored event of df; attributes in a fixed order, empty ones left out.

    raw_log_ref must be there: a null or empty one fails the query. devTime is the event's time, else when it
    came in (columns event_ts and ingest_ts), never now.
    """

    def column(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    def field(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in names], F.lit(""))

    event_id = or_else(field("event_id"), field("EventID"), field("signature_id"), F.lit("LOG_EVENT"))
    header = F.concat(F.lit("LEEF:2.0|"), *[x for part in (vendor, product, version) for x in (sanitise(F.lit(part)), F.lit("|"))], sanitise(event_id), F.lit("|" + C.ATTRIBUTE_SEPARATOR + "|"))
    moment = F.coalesce(*[F.col(c).cast("timestamp") for c in ("event_ts", "ingest_ts") if c in df.columns], F.lit(None).cast("timestamp"))
    four = lambda c: F.format_string("%.4f", F.bround(c.cast("double"), 4))
    flag = lambda c: F.when(c, "true").otherwise("false")
    ref = F.when(F.assert_true(F.coalesce(F.col("raw_log_ref"), F.lit("")) != "", "raw_log_ref is required").isNull(), sanitise(F.col("raw_log_ref")))
    attributes = {
        "src": sanitise(field("src_ip")), "devTime": F.when(F.col("host") != "unknown", F.unix_millis(moment).cast("string")), "dst": sanitise(field("dst", "dst_ip")), "usrName": sanitise(field("user")),
        "srcPort": sanitise(field("spt", "src_port")), "dstPort": sanitise(field("dpt", "dst_port")), "proto": sanitise(field("proto", "protocol")),
        "ai_threat_score": four(column("ai_threat_score", 0.0)), "ai_priority": column("ai_priority", "INFO"), "ai_mitre_technique": sanitise(column("ai_mitre_technique", "")), "ai_entities": sanitise(column("ai_entities", "")),
        "ai_ner_confidence": four(column("entity_confidence", 0.0)), "ai_dedup_flag": flag(column("is_duplicate", False)), "ai_sigma_match": flag(column("sigma_matched", False)),
        "ai_sigma_rules": sanitise(F.array_join("sigma_rule_ids", ",")) if "sigma_rule_ids" in df.columns else F.lit(""), "ai_source_type": sanitise(F.col("source_type")),
        "ai_scoring_latency_ms": F.format_string("%.1f", column("scoring_latency_ms", 0.0)), "ai_novelty_score": four(column("novelty_score", 0.0)), "degraded": F.when(column("score_degraded", False), "1").otherwise("0"), "raw_log_ref": ref,
    }
    pairs = F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(k + "="), v)) for k, v in attributes.items()])
    return F.concat(header, F.array_join(F.filter(pairs, lambda p: p.isNotNull()), C.ATTRIBUTE_SEPARATOR))


def decide(score: Column, priority: Column, mode: str = "enrich_only") -> Column:
    """struct(forward, reason). enrich_only forwards all; suppress_low drops INFO."""
    if mode not in ("enrich_only", "suppress_low"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "enrich_only":
        return F.struct(F.lit(True).alias("forward"), F.lit("enrich_only mode — all events forwarded").alias("reason"))
    low = priority == "INFO"
    reason = F.when(low, F.concat(F.lit("score "), F.format_string("%.3f", F.bround(score, 3)), F.lit(" below low threshold"))).otherwise(F.concat(F.lit("priority="), priority))
    return F.struct((~low).alias("forward"), reason.alias("reason"))


def syslog_message(message: Column, priority: Column, ts: Column, app: str = "sparkwarden") -> Column:
    severity = F.coalesce(F.create_map(*[F.lit(x) for kv in C.SEVERITIES.items() for x in kv])[priority], F.lit(C.DEFAULT_SEVERITY))
    stamp = F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(F.lit("<"), (severity + 8 * C.SYSLOG_FACILITY).cast("string"), F.lit(">1 "), stamp, F.lit(f" {app} - - - "), message, F.lit("\n"))


def tcp_frame(message: Column) -> Column:
    """With the octet count in front."""
    return F.concat(F.octet_length(message).cast("string"), F.lit(" "), message)


def envelope(df: DataFrame, key: str = "host") -> DataFrame:
    """(key, value): rows as a broker takes them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def send_syslog(df: DataFrame, host: str, port: int, protocol: str = "tcp", tries: int = 3) -> None:
    """Sends column ``message`` of each partition over one connection; a partition is tried again from its failed row on."""
    if protocol not in ("tcp", "udp"):
        raise ValueError(protocol)

    def run(rows):
        import socket
        import time

        kind = socket.SOCK_STREAM if protocol == "tcp" else socket.SOCK_DGRAM
        held = None
        for row in rows:
            data = row.message.encode("utf-8", "replace")
            data = b"%d %s" % (len(data), data) if protocol == "tcp" else data
            for k in range(tries):
                try:
                    if held is None:
                        held = socket.socket(socket.AF_INET, kind)
                        held.connect((host, port))
                    held.sendall(data)
                    break
                except OSError:
                    held = held and held.close()
                    if k == tries - 1:
                        raise
                    time.sleep(2**k)
        if held:
            held.close()

    df.select("message").foreachPartition(run)
