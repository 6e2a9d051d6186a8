"""Broker values to raw events, and the checks at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.network import in_networks
from sparkwarden.functions.refs import is_ref
from sparkwarden.functions.text import strip

SCHEMA = "raw string, source_type string, host string, ingest_ts double, collector_peer string, collector_protocol string"


def parse(df: DataFrame, value: str = "value") -> DataFrame:
    """df's values as envelopes; what isn't an object is a generic raw line."""
    text = F.col(value).cast("string")
    kind = F.schema_of_variant(F.try_parse_json(text))
    parsed = F.from_json(text, SCHEMA)
    plain = F.struct(*[(text if c.split()[0] == "raw" else F.lit("generic") if c.split()[0] == "source_type" else F.lit(None).cast(c.split()[1])).alias(c.split()[0]) for c in SCHEMA.split(", ")])
    return df.withColumn("_e", F.when(F.coalesce(kind, F.lit("")).startswith("OBJECT"), parsed).otherwise(plain)).select(*[c for c in df.columns if c != value], "_e.*")


def admit(df: DataFrame, raw: str = "raw", peer: str = "collector_peer", networks: list[str] | None = None, most: int = 1 << 20) -> DataFrame:
    """Rows of an allowed peer whose line isn't blank or too long."""
    out = df.where((F.length(strip(F.col(raw))) > 0) & (F.octet_length(raw) <= most))
    return out.where(in_networks(F.col(peer), networks)) if networks else out


def drop_reason(raw: Column, peer: Column, networks: list[str], most: int = 1 << 20) -> Column:
    """Why admit drops a row, null if it doesn't: for the counters of drops."""
    return F.when(F.coalesce(F.length(strip(raw)), F.lit(0)) == 0, "empty").when(F.octet_length(raw) > most, "oversize").when(~in_networks(peer, networks), "peer")


def request_checks(df: DataFrame, raw: str = "raw", ref: str | None = None) -> DataFrame:
    """df with ``error``: null for a request of 1 to 65536 characters with a well-formed reference."""
    n = F.coalesce(F.length(raw), F.lit(0))
    error = F.when(n < 1, "raw is empty").when(n > 65_536, "raw is too long")
    return df.withColumn("error", error.when(F.col(ref).isNotNull() & ~is_ref(F.col(ref)), "raw_log_ref is malformed") if ref else error)


def batch_error(n: Column, most: int = 200) -> Column:
    """Why a batch of n events is turned away; null if it isn't."""
    return F.when(~n.between(1, most), F.lit(f"a batch holds 1 to {most} events"))
