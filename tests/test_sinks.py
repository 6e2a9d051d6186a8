import json

import pytest

from sparkwarden.sources import sinks


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("syslog", "a"), ("web", "b"), ("syslog", "c")], "source_type string, raw string")
    sinks.by_type(df, str(tmp_path / "t"))
    assert sorted(r.raw for r in spark.read.json(str(tmp_path / "t" / "source_type=syslog")).collect()) == ["a", "c"]
    sinks.report(spark.createDataFrame([(1, 0.5)], "tp long, f1 double"), str(tmp_path / "r"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()] == [{"tp": 1, "f1": 0.5}]


def test_answers(spark):
    scored = spark.createDataFrame([("HIGH", 0.123456, 1.256, "r", True), ("LOW", 0.2, 2.0, "q", False)], "ai_priority string, ai_threat_score double, scoring_latency_ms double, raw string, score_degraded boolean")
    assert tuple(sinks.response_counts(scored).first()) == (2, 1, 0, pytest.approx(3.256))
    assert sinks.response_counts(scored.limit(0)).first().latency_ms == 0
    first = sinks.rounded(scored).first().asDict()
    assert first == {"ai_priority": "HIGH", "ai_threat_score": 0.1235, "scoring_latency_ms": 1.26}
