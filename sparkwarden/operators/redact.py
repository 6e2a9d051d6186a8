"""Masking of secrets and personal data in raw lines, as an ordered list of replacements."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions.text import let


@dataclass(frozen=True)
class Policy:
    enabled: bool = True
    redact_emails: bool = True
    redact_credit_cards: bool = True
    redact_secrets: bool = True
    redact_ip_addresses: bool = False
    redact_hostnames: bool = False

    @classmethod
    def of(cls, values: dict | None) -> Policy:
        """A policy of a mapping; unknown keys are passed over, texts such as ``yes`` count as true."""
        known = {f.name for f in fields(cls)}
        truth = lambda v: v.strip().lower() in ("1", "true", "yes", "on") if isinstance(v, str) else bool(v)
        return cls(**{k: truth(v) for k, v in (values or {}).items() if k in known})


def _cards(text: Column) -> Column:
    """Digits runs that pass the Luhn check masked: the text is cut at candidates and put together again."""
    found = F.regexp_extract_all(text, F.lit(f"({C.CARD_PATTERN})"), F.lit(1))
    between = F.split(text, C.CARD_PATTERN, -1)

    def masked(c: Column) -> Column:
        digits = F.regexp_replace(c, r"\D", "")
        return F.when(F.call_function("luhn_check", digits), F.lit("<CREDIT_CARD>")).otherwise(c)

    joined = F.array_join(F.transform(F.arrays_zip(between.alias("b"), F.transform(found, masked).alias("c")), lambda z: F.concat(z["b"], F.coalesce(z["c"], F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def redact(text: Column, policy: Policy | None = None) -> Column:
    policy = policy or Policy()
    if not policy.enabled:
        return text
    has = lambda word: lambda t: F.contains(t, F.lit(word))
    steps = []
    if policy.redact_secrets:
        gates = [has("PRIVATE KEY-----"), lambda t: F.contains(F.lower(t), F.lit("bearer")), lambda t: t.rlike(C.SECRET_WORD), lambda t: t.rlike("A[KS]IA"), has("xox")]
        steps += [(gate, pattern, mask) for gate, (pattern, mask) in zip(gates, C.SECRET_PATTERNS, strict=True)]
    if policy.redact_emails:
        steps.append((has("@"), *C.EMAIL_PATTERN))
    if policy.redact_credit_cards:
        steps.append(None)
    if policy.redact_ip_addresses:
        steps += [(lambda t: t.rlike(r"\d\.\d"), *C.IP_PATTERNS[0]), (lambda t: t.rlike(":[0-9a-fA-F]*:"), *C.IP_PATTERNS[1])]
    if policy.redact_hostnames:
        steps.append((lambda t: t.rlike(r"(?i)(?:host|fqdn)[a-z]*\s*="), *C.HOST_PATTERN))
    # A pattern runs only over texts that hold what it can't do without.
    for step in steps:
        if step is None:
            text = let(text, lambda t: F.when(t.rlike(C.CARD_DIGITS), _cards(t)).otherwise(t))
        else:
            gate, pattern, mask = step
            text = let(text, _step(gate, pattern, mask))
    return text


def _step(gate, pattern: str, mask: str):
    return lambda t: F.when(gate(t), F.regexp_replace(t, pattern, mask)).otherwise(t)
