"""Log lines of seven formats to canonical events.

Each parser is a column: a struct (source_type, timestamp, host, text, fields), or null where the line is of
another format. The first that isn't null wins. All stay inside Catalyst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions.text import fields, groups, last_of_each, named, or_else, strip


def _event(kind: str, timestamp: Column, host: Column, text: Column, values: Column, when: Column) -> Column:
    parts = F.struct(F.lit(kind).alias("source_type"), timestamp.alias("timestamp"), host.alias("host"), text.alias("text"), values.cast("map<string,string>").alias("fields"))
    return F.when(when, parts)


def _present(v: Column) -> Column:
    return v.isNotNull() & (v != "")


def rfc5424(raw: Column, g: Column) -> Column:
    d = named(g, C.RFC5424_GROUPS)
    text = F.concat(F.lit("Host "), d["host"], F.lit(" App "), d["app"], F.lit(": "), strip(d["message"]))
    return _event("syslog", d["timestamp"], d["host"], text, fields(d, lambda v: _present(v) & (v != "-")), g.isNotNull())


def rfc3164(raw: Column, g: Column) -> Column:
    d = named(g, C.RFC3164_GROUPS)
    message = strip(or_else(d["message"], d["message_only"]))
    by = F.when(d["process"] != "", F.concat(F.lit(" Process "), d["process"], F.lit("["), d["pid"], F.lit("]"))).otherwise(F.lit(""))
    text = F.concat(F.lit("Host "), d["host"], by, F.lit(": "), message)
    kept = {k: v for k, v in d.items() if k != "message_only"}
    return _event("syslog", F.concat_ws(" ", d["month"], d["day"], d["time"]), d["host"], text, fields(kept, _present), g.isNotNull())


def cef_extensions(s: Column) -> Column:
    """key=value pairs as a map; values may hold escaped spaces and equals signs, later keys win."""
    parts = F.filter(F.split(strip(s), r"(?U)(?<!\\)\s+(?=\w+=)"), lambda p: F.contains(p, F.lit("=")))

    def pair(p: Column) -> Column:
        value = F.substring(p, F.position(F.lit("="), p) + 1, F.length(p))
        plain = F.when(F.contains(value, F.lit("\\")), F.replace(F.replace(value, F.lit("\\="), F.lit("=")), F.lit("\\ "), F.lit(" "))).otherwise(value)
        return F.struct(strip(F.substring_index(p, "=", 1)).alias("k"), strip(plain).alias("v"))

    return last_of_each(F.transform(parts, pair))


def cef(raw: Column, g: Column, ext: Column) -> Column:
    d = named(g, C.CEF_GROUPS)

    def first(*keys: str, default: str = "") -> Column:
        return F.coalesce(*[F.try_element_at(ext, F.lit(k)) for k in keys], F.lit(default))

    text = F.concat(
        F.lit("Firewall "), d["device_product"], F.lit(" Action "), first("act", "deviceAction"), F.lit(" src "), first("src", "sourceAddress", default="unknown"), F.lit(":"), first("spt", "sourcePort"),
        F.lit(" dst "), first("dst", "destinationAddress", default="unknown"), F.lit(":"), first("dpt", "destinationPort"), F.lit(" proto "), first("proto", "protocol"),
        F.lit(" sig "), d["signature_id"], F.lit(" name "), d["name"], F.lit(" sev "), d["severity"],
    )
    header = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in d]), F.array(*d.values())), lambda k, v: ~F.map_contains_key(ext, k))
    return _event("firewall", first("rt", "end"), first("dvchost", "dvc", default="unknown"), text, F.map_concat(header, ext), g.isNotNull())


def combined(raw: Column, g: Column) -> Column:
    d = named(g, C.COMBINED_GROUPS)
    tail = raw.rlike(C.COMBINED_TAIL)
    for k in ("referrer", "ua"):
        d[k] = F.when(tail, d[k])
    text = F.concat(F.lit("Web request "), d["method"], F.lit(" "), d["uri"], F.lit(" from "), d["src_ip"], F.lit(" status "), d["status"], F.lit(" user-agent '"), F.coalesce(d["ua"], F.lit("None")), F.lit("'"))
    return _event("web", d["timestamp"], d["src_ip"], text, fields(d, lambda v: F.lit(True)), g.isNotNull())


class _Json:
    """Values of a JSON object as strings, null where absent."""

    def __init__(self, raw: Column, value: Column, keys: Column):
        self.raw, self.value, self.keys = raw, value, keys

    def __call__(self, *path: str) -> Column:
        return F.try_variant_get(self.value, "$" + "".join(f'["{p}"]' for p in path), "string")

    def get(self, key: str, default: str = "") -> Column:
        """As it is, even empty; a present null is the text None."""
        absent = ~F.coalesce(F.array_contains(self.keys, key), F.lit(False))
        return F.when(absent, F.lit(default)).otherwise(F.coalesce(self(key), F.lit("None")))


def winevent(raw: Column, j: _Json) -> Column:
    event_id = or_else(j("EventID"), j("System", "EventID"), F.coalesce(j("event_id"), F.lit("")))
    host = or_else(j("Computer"), j("System", "Computer"), j.get("hostname", "unknown"))
    message = or_else(j("Message"), j("message"), raw)
    user = or_else(j("SubjectUserName"), j("TargetUserName"), j.get("user"))
    timestamp = or_else(j("TimeCreated"), j("System", "TimeCreated", "@SystemTime"), j.get("@timestamp"))
    text = F.concat(F.lit("Windows EventID "), event_id, F.lit(": "), message, F.lit(" on host "), host, F.lit(" by user "), user)
    return _event("winevent", timestamp, host, strip(text), F.create_map(F.lit("event_id"), event_id, F.lit("host"), host, F.lit("user"), user), j.value.isNotNull() & (event_id != ""))


def endpoint(raw: Column, j: _Json) -> Column:
    host = or_else(j("ComputerName"), j("hostname"), j.get("host", "unknown"))
    process = or_else(j("ProcessName"), j("process_name"), j.get("ImageFileName"))
    parent = or_else(j("ParentProcessName"), j.get("parent_process_name"))
    cmdline = or_else(j("CommandLine"), j.get("command_line"))
    user = or_else(j("UserName"), j.get("user"))
    kind = or_else(j("event_type"), j.get("EventType"))
    timestamp = or_else(j("@timestamp"), j.get("timestamp"))
    text = F.concat(F.lit("Endpoint "), kind, F.lit(": Process "), process, F.lit(" spawned by "), parent, F.lit(" executed '"), cmdline, F.lit("' as user "), user, F.lit(" on "), host)
    values = F.create_map(F.lit("process"), process, F.lit("parent_process"), parent, F.lit("cmdline"), cmdline, F.lit("user"), user, F.lit("event_type"), kind)
    return _event("endpoint", timestamp, host, strip(text), values, F.arrays_overlap(j.keys, F.array(*[F.lit(k) for k in C.ENDPOINT_KEYS])))


def cloudtrail(raw: Column, j: _Json) -> Column:
    user = or_else(j("userIdentity", "userName"), F.coalesce(j("userIdentity", "arn"), F.lit("unknown")))
    name, source, address = j.get("eventName"), j.get("eventSource"), j.get("sourceIPAddress", "unknown")
    resource = F.coalesce(F.try_variant_get(j.value, "$.resources[0].type", "string"), F.lit(""))
    region, error = j.get("awsRegion"), F.coalesce(j("errorCode"), F.lit(""))
    text = F.concat(
        F.lit("CloudTrail: User "), user, F.lit(" performed "), name, F.lit(" on "), source, F.lit(" resource "), resource, F.lit(" from "), address, F.lit(" region "), region,
        F.when(error != "", F.concat(F.lit(" error "), error)).otherwise(F.lit("")),
    )
    values = F.create_map(F.lit("event_name"), name, F.lit("event_source"), source, F.lit("user"), user, F.lit("src_ip"), address, F.lit("region"), region, F.lit("error_code"), error)
    both = F.array_contains(j.keys, "eventSource") & F.array_contains(j.keys, "eventName")
    return _event("cloudtrail", j.get("eventTime"), address, text, values, F.coalesce(both, F.lit(False)))


def _stages(raw: str) -> list[dict[str, Column]]:
    """Columns that several others use, each stage on those before, so that a line meets each pattern once."""
    r = F.col(raw)
    patterns = {"_5424": (C.RFC5424, C.RFC5424_GROUPS), "_3164": (C.RFC3164, C.RFC3164_GROUPS), "_cef": (C.CEF, C.CEF_GROUPS), "_web": (C.COMBINED, C.COMBINED_GROUPS)}
    # A line meets a pattern only if it holds what the pattern can't do without.
    gates = {"_5424": r.startswith("<"), "_3164": F.substring(r, 1, 8).rlike("^(?:<[0-9]|[A-Za-z]{3}\\s)"), "_cef": F.contains(r, F.lit("CEF:")), "_web": F.contains(r, F.lit("[")) & F.contains(r, F.lit('"'))}
    first = {name: F.when(gates[name], groups(r, pattern, len(g))) for name, (pattern, g) in patterns.items()}
    first["_json"] = F.when(r.startswith("{"), F.try_parse_json(r))
    second = {"_ext": cef_extensions(F.col("_cef")[len(C.CEF_GROUPS) - 1]), "_keys": F.json_object_keys(F.when(F.col("_json").isNotNull(), r))}
    j = _Json(r, F.col("_json"), F.col("_keys"))
    third = {
        "_try0": winevent(r, j), "_try1": cloudtrail(r, j), "_try2": endpoint(r, j), "_try3": cef(r, F.col("_cef"), F.col("_ext")),
        "_try4": combined(r, F.col("_web")), "_try5": rfc5424(r, F.col("_5424")), "_try6": rfc3164(r, F.col("_3164")),
    }
    return [first, second, third]


#: The type of each try, in order; a hint moves those of its type to the front.
ORDER = ["winevent", "cloudtrail", "endpoint", "firewall", "web", "syslog", "syslog"]


def explode_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each of the ``Records`` of a wrapped audit file; other rows stay."""
    value = F.try_parse_json(F.col(raw))
    records = F.try_variant_get(value, "$.Records", "array<variant>")
    many = F.transform(records, lambda r: F.to_json(r))
    return df.withColumn(raw, F.explode(F.coalesce(F.when(F.size(many) > 0, many), F.array(F.col(raw)))))


def normalize(df: DataFrame, raw: str = "raw", hint: str | None = None, peer: str | None = None, ingest_ts: str | None = None) -> DataFrame:
    """df with source_type, timestamp, host, text and fields; raw is stripped.

    hint: column of a source type whose parsers go first (an unknown one is none). peer: column that stands in for
    an unknown host. ingest_ts: column that dates lines without a time; nothing is dated by the clock.
    """
    rows, stages = df.withColumn(raw, strip(F.col(raw))), _stages(raw)
    for stage in stages:
        rows = rows.withColumns(stage)
    tried = [(kind, f"_try{k}") for k, kind in enumerate(ORDER)]
    usual = F.coalesce(*[F.col(name) for _, name in tried])
    if hint is not None:
        own = {kind: [F.col(name) for k, name in tried if k == kind] for kind, _ in tried}
        usual = reduce(lambda rest, kind: F.when(F.col(hint) == kind, F.coalesce(*own[kind], usual)).otherwise(rest), own, usual)
    stamp = F.date_format(F.col(ingest_ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'") if ingest_ts else F.lit(None).cast("string")
    generic = F.struct(F.lit("generic").alias("source_type"), stamp.alias("timestamp"), F.lit("unknown").alias("host"), F.col(raw).alias("text"), F.create_map().cast("map<string,string>").alias("fields"))
    out = rows.withColumn("_event", F.coalesce(usual, generic)).drop(*[name for stage in stages for name in stage])
    host = F.col("_event.host") if peer is None else F.when(F.col("_event.host") == "unknown", F.col(peer)).otherwise(F.col("_event.host"))
    return out.withColumns({c: F.col(f"_event.{c}") for c in ("source_type", "timestamp", "text", "fields")} | {"host": host}).drop("_event")


def event_time(timestamp: Column, ingest_ts: Column) -> Column:
    """The time a line names if it can be parsed, else when it came in."""
    text = F.regexp_replace(timestamp, "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(timestamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z")), ingest_ts)
