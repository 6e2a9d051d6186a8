"""References and days of raw events.

A reference is the SHA-256 of a canonical JSON object: sorted keys, no spaces, ASCII only (all else as \\u and four lower-case
digits, of UTF-16), numbers as a fixed-point text of at most six places. So references match those of archives that
were written with common JSON libraries. Made by built-in expressions only; rows keep one reference from archive to output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(s: Column) -> Column:
    """s as a JSON text in ASCII. Texts without anything to escape stay as they are."""
    s = F.coalesce(s, F.lit(""))
    units = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    named = F.create_map(*[F.lit(x) for pair in (("0022", '\\"'), ("005C", "\\\\"), ("0008", "\\b"), ("0009", "\\t"), ("000A", "\\n"), ("000C", "\\f"), ("000D", "\\r")) for x in pair])
    shown = lambda u: F.when(u.between("0020", "007E"), F.chr(F.conv(u, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
    escaped = F.array_join(F.transform(units, lambda u: F.coalesce(F.try_element_at(named, u), shown(u))), "")
    return F.concat(F.lit('"'), F.when(s.rlike(r"^[ !#-\[\]-~]*$"), s).otherwise(escaped), F.lit('"'))


def _number(x: Column) -> Column:
    text = F.regexp_replace(F.round(x.cast("decimal(28,9)"), 6).cast("decimal(28,6)").cast("string"), r"0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def raw_log_ref(raw: Column, source_type: Column, host: Column, ingest_ts: Column) -> Column:
    """64 hex digits, equal for one event that comes in again; ingest_ts in seconds."""
    return F.sha2(F.concat(F.lit('{"host":'), _quoted(host), F.lit(',"ingest_ts":'), _number(ingest_ts), F.lit(',"raw":'), _quoted(raw), F.lit(',"source_type":'), _quoted(source_type), F.lit("}")), 256)


def kafka_ref(topic: Column, partition: Column, offset: Column) -> Column:
    return F.sha2(F.concat(F.lit('{"offset":'), offset.cast("string"), F.lit(',"partition":'), partition.cast("string"), F.lit(',"topic":'), _quoted(topic), F.lit("}")), 256)


def is_ref(ref: Column) -> Column:
    return ref.rlike("^[0-9a-f]{64}$")


def index_day(ts: Column) -> Column:
    """The UTC day that an event is filed under, as yyyy.MM.dd."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy.MM.dd")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts).cast("string")


def content_digest(content: Column, digits: int = 16) -> Column:
    """The first digits of a file's SHA-256."""
    return F.left(F.sha2(content, 256), F.lit(digits))
