"""Source types and clean messages of vendor feeds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions.text import strip


def infer_source_type(message_type: Column, pipeline: Column, product: Column, vendor: Column, winevent_ids: Iterable[str]) -> Column:
    """The type that a feed's columns tell, null for flows. Rules in order; nulls count as empty.

    winevent_ids: the numbers of audit events, as the deployment knows them (a data file of several hundred).
    """
    kind, pipe, prod, vend = (F.coalesce(c.cast("string"), F.lit("")) for c in (message_type, pipeline, product, vendor))
    audit = kind.isin(*winevent_ids)
    maker = lambda c: F.exists(F.array(*[F.lit(p) for p in C.FIREWALL_PRODUCTS]), lambda p: F.contains(c, p))
    return (
        F.when(pipe == "aws_cloudtrail", "cloudtrail").when(pipe == "network_flows", F.lit(None))
        .when(audit | kind.isin(*C.WINEVENT_TYPES), "winevent")
        .when((kind == "firewall_action") | maker(prod) | maker(vend), "firewall")
        .when(kind.isin(*C.WEB_TYPES), "web").otherwise("syslog")
    )


def clean_message(raw: Column, source_type: Column) -> Column:
    """raw without what feeds put before the line: the JSON of audit events, the nested message of firewalls."""
    audit = strip(F.regexp_replace(raw, r"(?s)^\S+\s+:::\s*", ""))
    at = F.instr(raw, "{")
    audit = F.when(audit.startswith("{"), audit).when(at > 0, F.substring(raw, at, F.length(raw))).otherwise(raw)
    wall = strip(F.regexp_replace(raw, r"(?s)^\S+-Artifact\s+:::\s*", ""))
    nested = F.regexp_extract(wall, r"(?s)(message=\{.+\})", 1)
    return F.when(source_type == "winevent", audit).when(source_type == "firewall", F.when(nested != "", nested).otherwise(wall)).otherwise(raw)
