import json
import socket
import time

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import archive, datasets, models, output, registry
from sparkwarden.sources import config, envelopes, files, framing
from sparkwarden.sources.sockets import SyslogUdp
from sparkwarden.streaming import pipelines


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_labelled(spark, tmp_path):
    good = put(tmp_path / "a.csv", 'raw,label\n"x, ""y""\nz",1\nq,0\n')
    assert sorted(map(tuple, files.labelled_csv(spark, good).collect())) == [("q", 0), ('x, "y"\nz', 1)]
    with pytest.raises(ValueError):
        files.labelled_csv(spark, put(tmp_path / "b.csv", "raw,label,more\nx,1,2\n"))
    with pytest.raises(Exception, match="label is not 0 or 1"):
        files.labelled_csv(spark, put(tmp_path / "c.csv", "raw,label\nx,2\n")).collect()
    lines = put(tmp_path / "d.jsonl", '{"t": "x", "y": 1, "s": 0.5}\n{"t": null, "y": 0, "s": 0.1}\n')
    assert [tuple(r) for r in files.labelled(spark, lines, "t", "y", "s").collect()] == [("x", 1, 0.5)]
    mapped = files.label_map(spark.createDataFrame([("a", "Benign"), ("b", "evil"), ("", "evil"), ("c", None)], "message string, label string"))
    assert sorted(map(tuple, mapped.collect())) == [("a", 0), ("b", 1)]


def test_traces_vocabulary_techniques(spark, tmp_path):
    wide = put(tmp_path / "t.csv", "task,E1,E2\nx,1,0\ny,2,3\n")
    assert sorted(map(tuple, files.traces(spark, wide, ["E1", "E2"]).collect())) == [("x", "E1", 1.0), ("x", "E2", 0.0), ("y", "E1", 2.0), ("y", "E2", 3.0)]
    with pytest.raises(ValueError):
        files.traces(spark, wide, ["E2", "E1"])
    for text in ('[["b", 2], ["a", 1]]', '{"b": 2, "a": 1}'):
        assert [tuple(r) for r in files.vocabulary(spark, put(tmp_path / "v" / f"{len(text)}.json", text)).collect()] == [(1, "a"), (2, "b")]
    table = put(tmp_path / "m.json", json.dumps([{"id": "T1", "name": "n", "description": "d"}, {"id": "T2", "name": "m", "description": "e"}]))
    assert [r.technique_id for r in files.techniques(spark, table).orderBy("no").collect()] == ["T1", "T2"]


def test_pairs_and_sentences(spark, tmp_path):
    put(tmp_path / "p" / "my_pairs.csv", "anchor,positive\n a ,b\n,c\n")
    put(tmp_path / "p" / "x_biencoder.jsonl", '{"anchor": "d", "positive": "e"}\n')
    assert sorted(map(tuple, files.pair_file(spark, str(tmp_path / "p")).collect())) == [("a", "b"), ("d", "e")]
    tagged = put(tmp_path / "c.txt", "A\tB-X\nb\tI-X\n\nc\tB-Q\nd\n")
    got = datasets.sentences(files.tagged_lines(spark, tagged), ["B-X", "I-X", "O"]).orderBy("sentence").collect()
    assert [(r.tokens, r.labels) for r in got] == [(["A", "b"], ["B-X", "I-X"]), (["c", "d"], ["O", "O"])]
    assert [tuple(r) for r in datasets.entity_counts(datasets.sentences(files.tagged_lines(spark, tagged), ["B-X", "I-X"])).collect()] == [("X", 1)]
    pieces = spark.createDataFrame([(1, 0, None, None), (1, 1, 0, "B-X"), (1, 2, 0, "B-X"), (1, 3, 1, "O"), (1, 4, None, None)], "sentence int, pos int, word_id int, tag string")
    assert [r.label for r in datasets.subword_labels(pieces).orderBy("pos").collect()] == [None, "B-X", "I-X", "O", None]
    spans = spark.sql("SELECT array(named_struct('start', 0, 'end', 3), named_struct('start', 0, 'end', 5), named_struct('start', 4, 'end', 6), named_struct('start', 5, 'end', 7)) AS s")
    assert [tuple(s) for s in spans.select(datasets.greedy_spans(F.col("s")).alias("k")).first().k] == [(0, 5), (5, 7)]


def test_config_and_rules(spark):
    assert config.substitute({"a": ["${X:1}", "${Y}"], "b": 2}, {"X": "9"}) == {"a": ["9", ""], "b": 2}
    opts = config.kafka_options("b:1", "SASL_SSL", "SCRAM-SHA-256", "u", 'p"', {"truststore": "/t"})
    assert "ScramLoginModule" in opts["kafka.sasl.jaas.config"] and r'p\"' in opts["kafka.sasl.jaas.config"] and opts["kafka.ssl.truststore.location"] == "/t"
    for bad in ({"protocol": "X"}, {"protocol": "SASL_SSL"}, {"files": {"keystore": "k"}}):
        with pytest.raises(ValueError):
            config.kafka_options("b:1", **bad)
    docs = [{"id": "r1", "detection": {"sel": {"CommandLine|contains": ["a", "b"]}, "condition": "sel"}}, {"title": "r2", "detection": {"sel": [{"Path|endswith|re": "c"}]}}]
    assert [tuple(r) for r in files.sigma_rules(spark, docs).collect()] == [("r1", 0, "CommandLine", "contains", "a"), ("r1", 0, "CommandLine", "contains", "b"), ("r2", 1, "Path", "endswith+re", "c")]


def test_framing(spark):
    def messages(*chunks, most=100):
        f = framing.Framer(most)
        return [m for c in chunks for m in f.feed(c)] + list(f.end()), f.closed

    assert messages(b"5 hello3 a\nb", b"line\nrest") == ([b"hello", b"a\nb", b"line", b"rest"], False)
    assert messages(b"5 he", b"llo", b"9 cut") == ([b"hello"], False)
    assert messages(b"ok\n", b"x" * 101 + b"\nlost\n") == ([b"ok"], True) and messages(b"999 x") == ([], True)
    df = spark.createDataFrame([("a", 1, b"5 he"), ("b", 1, b"x\xff\n"), ("a", 2, b"llo")], "conn string, seq long, data binary")
    assert sorted(map(tuple, framing.deframe(df).collect())) == [("a", 0, "hello"), ("b", 0, "x�")]


def test_edge_checks(spark):
    rows = spark.createDataFrame([("x", "10.0.0.1"), ("  ", "10.0.0.1"), ("x", "bad"), ("y" * 50, "10.0.0.1"), ("x", "2001:db8::5"), (None, None)], "raw string, collector_peer string")
    assert [r.raw for r in envelopes.admit(rows, networks=["10.0.0.0/8", "2001:db8::/32"], most=20).collect()] == ["x", "x"]
    why = envelopes.drop_reason(F.col("raw"), F.col("collector_peer"), ["10.0.0.0/8"], 20)
    assert [r[0] for r in rows.select(why).collect()] == [None, "empty", "peer", "oversize", "peer", "empty"]
    asked = spark.createDataFrame([("x", "a" * 64), ("", None), ("x", "short")], "raw string, ref string")
    assert [r.error for r in envelopes.request_checks(asked, ref="ref").collect()] == [None, "raw is empty", "raw_log_ref is malformed"]


def test_archive_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "arc")
    rows = spark.createDataFrame([("r1", "a", "2024.01.01"), ("r1", "a", "2024.01.01"), ("r2", "b", "2024.01.02")], "raw_log_ref string, raw string, day string")
    for _ in range(2):
        archive.write(rows, path, F.col("day"))
    held = spark.read.parquet(path)
    assert held.count() == 2 and archive.get(held, "r2", "2024.01.02").count() == 1
    assert [r[0] for r in archive.expired(held, "2024-04-01", 90).collect()] == ["2024.01.01"]
    good, bad = archive.drain_spool(spark, put(tmp_path / "s.ndjson", '{"raw": "x", "ingest_ts": 5.0}\nbroken\n'), "raw STRING, ingest_ts DOUBLE")
    assert [tuple(r) for r in good.collect()] == [("x", 5.0)] and [r.value for r in bad.collect()] == ["broken"]


def test_registry(spark):
    runs = spark.createDataFrame([], registry.SCHEMA)
    new = spark.createDataFrame([(f"r{i}", "t", None, None, f"d{i}", None, {"f1": 0.5}) for i in range(2)], registry.SCHEMA)
    runs = registry.insert(runs, new)
    runs = registry.promote(registry.promote(runs, "r0"), "r1")
    assert {r.run_id: (r.status, r.version) for r in runs.collect()} == {"r0": ("archived", "r0"), "r1": ("production", "r1")}
    assert registry.production(runs, "t").first().run_id == "r1"
    assert registry.update_metrics(runs, "r1", {"f1": 0.9, "auc": 1.0}).where("run_id = 'r1'").first().metrics == {"f1": 0.9, "auc": 1.0}
    with pytest.raises(KeyError):
        registry.promote(runs, "none")
    e = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256_prefix string")
    a = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256_prefix string")
    assert dict(map(tuple, registry.verify(e, a).collect())) == {"a": "ok", "b": "changed", "c": "missing", "d": "extra"}


def test_streaming_pipeline(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    lines = [("Jan 15 11:07:53 h1 sshd[2]: Failed password for invalid user x from 1.2.3.4 pwd=abc", "syslog", "h1", 1_700_000_000.5), ("plain", "generic", "h2", 1_700_000_001.0)]
    spark.createDataFrame(lines, "raw string, source_type string, host string, ingest_ts double").write.parquet(folder)
    stream = lambda: spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    for k in range(2):
        q = pipelines.archive_stream(stream(), str(tmp_path / "arc"), str(tmp_path / "dead"), str(tmp_path / f"ck{k}"), once=True)
        q.awaitTermination()
    held = {r.host: r for r in spark.read.parquet(str(tmp_path / "arc")).collect()}
    assert len(held) == 2 and held["h1"].raw.endswith("pwd=<REDACTED>") and held["h1"].ingest_date == "2023.11.14"
    q = pipelines.scoring_stream(stream(), lambda d: F.lit(0.1), lambda d: out.extend(d.collect()), str(tmp_path / "dead"), str(tmp_path / "ck3"), once=True)
    q.awaitTermination()
    got = {r.host: r for r in out}
    assert got["h1"].classifier_score == 0.6 and got["h1"].ai_priority == "LOW" and got["h2"].ai_priority == "INFO" and got["h1"].raw_log_ref == held["h1"].raw_log_ref

    def fail(batch):
        raise RuntimeError("sink is down")

    pipelines.scoring_stream(stream(), lambda d: F.lit(0.1), fail, str(tmp_path / "dead"), str(tmp_path / "ck4"), once=True).awaitTermination()
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert len(dead) == 2 and dead[0].retry_count == 1 and "sink is down" in dead[0].error


def test_watermarked_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:00", "a") for m in (1, 2, 8)] + [("2024-01-01 01:00:00", "b")]
    spark.createDataFrame(rows, "t string, kind string").withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = pipelines.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", ["kind"], "5 minutes", "10 minutes")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.kind, r.n) for r in spark.sql("SELECT * FROM windows").collect()) == [("a", 1), ("a", 2)]


def test_udp_source(spark, tmp_path):
    probe = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    probe.bind(("127.0.0.1", 0))
    port = probe.getsockname()[1]
    probe.close()
    spark.dataSource.register(SyslogUdp)
    q = spark.readStream.format("syslog_udp").option("host", "127.0.0.1").option("port", port).load().writeStream.format("memory").queryName("udp").option("checkpointLocation", str(tmp_path)).start()
    sender = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for k in range(60):
        sender.sendto(b"msg %d" % k, ("127.0.0.1", port))
        time.sleep(0.25)
        if k % 8 == 7 and spark.sql("SELECT * FROM udp").count():
            break
    q.stop()
    assert spark.sql("SELECT * FROM udp WHERE raw LIKE 'msg %' AND collector_protocol = 'udp'").count() > 0


def test_syslog_sender(spark):
    server = socket.create_server(("127.0.0.1", 0))
    server.settimeout(20)
    df = spark.createDataFrame([("one",), ("zwölf",)], "message string").coalesce(1)
    output.send_syslog(df, "127.0.0.1", server.getsockname()[1])
    conn, _ = server.accept()
    conn.settimeout(5)
    data = b""
    while chunk := conn.recv(100):
        data += chunk
    assert data == b"3 one" + "6 zwölf".encode()


def test_models(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],)], "features array<double>")
    got = [r[0] for r in df.select(models.linear_classifier(F.col("features"), [2.0, 0.0], 0.0, neutral=0.5)).collect()]
    assert got == [pytest.approx(0.880797), 0.5]
    assert models.load_scale('{"scale": [1, 2]}', 2) == [1.0, 2.0]
    for bad in ('{"scale": [0, 1]}', '{"scale": [1]}', '{"scale": [1, NaN]}'):
        with pytest.raises(ValueError):
            models.load_scale(bad, 2)
    assert models.disabled_stages(df).first().is_duplicate is False
