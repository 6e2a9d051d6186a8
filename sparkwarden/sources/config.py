"""Configuration: placeholders of the environment, and options of brokers."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

from sparkwarden.functions.constants import MECHANISMS, PROTOCOLS

_PLACE = re.compile(r"\$\{([^}:]+)(?::([^}]*))?\}")


def substitute(value, env: Mapping[str, str] | None = None):
    """value with ${NAME:default} of its texts filled in, at any depth; an unknown name without a default is empty."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _PLACE.sub(lambda m: env.get(m[1], m[2] or ""), value)
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    return value


def load(path: str, env: Mapping[str, str] | None = None) -> dict:
    """A JSON file, or a YAML one where a parser is at hand, with its placeholders filled in."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return substitute(json.load(f), env)
        import yaml

        return substitute(yaml.safe_load(f), env)


def kafka_options(servers: str, protocol: str = "PLAINTEXT", mechanism: str | None = None, user: str | None = None, password: str | None = None, files: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a Spark source or sink for a broker; what doesn't go together raises."""
    if protocol not in PROTOCOLS:
        raise ValueError(f"protocol must be one of {PROTOCOLS}")
    out = {"kafka.bootstrap.servers": servers, "kafka.security.protocol": protocol}
    if protocol.startswith("SASL"):
        if mechanism not in MECHANISMS or not user or password is None:
            raise ValueError("SASL needs a mechanism, a user and a password")
        module = "plain.PlainLoginModule" if mechanism == "PLAIN" else "scram.ScramLoginModule"
        quote = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
        out |= {"kafka.sasl.mechanism": mechanism, "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.{module} required username="{quote(user)}" password="{quote(password)}";'}
    for name, place in (files or {}).items():
        if not protocol.endswith("SSL"):
            raise ValueError("files of certificates need an SSL protocol")
        out[f"kafka.ssl.{name}.location"] = place
    return out
