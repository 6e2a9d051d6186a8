"""Operators against plain Python: order sums, rules, addresses, references, models, brokers, the registry's store."""

import hashlib
import ipaddress
import json
import random
import socket
import time

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import network, refs, text
from sparkwarden.operators import archive, cascade, datasets, metrics, models, ordered, redact, registry, rules, similarity
from sparkwarden.sources import brokers, config, framing
from sparkwarden.sources.sockets import SyslogTcp
from sparkwarden.streaming import pipelines


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, "a", "b"]), rng.randrange(9)) for k in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k long, g string, x int")
    got = {(r.k): (r.n, r.s) for r in ordered.running(df, "k", {"n": F.lit(1), "s": F.col("x")}, ["g"]).collect()}
    want, sums = {}, {}
    for k, g, x in sorted(rows):
        n, s = sums.get(g, (0, 0))
        want[k] = (n, s)
        sums[g] = (n + 1, s + x)
    assert got == want
    whole = {r.k: r.n for r in ordered.running(df.withColumn("k", F.timestamp_seconds("k")), "k", {"n": F.lit(1)}).select(F.unix_timestamp("k").alias("k"), "n").collect()}
    assert whole == {k: i for i, (k, _, _) in enumerate(sorted(rows))}
    assert ordered.running(df.limit(0), "k", {"n": F.lit(1)}).collect() == []
    names = ordered.running(df.select(F.col("k").cast("string").alias("k")), "k", {"n": F.lit(1)})
    assert {r.k: r.n for r in names.collect()} == {k: i for i, k in enumerate(sorted(str(r[0]) for r in rows))}


def test_rules_need_no_key_and_have_no_limit(spark):
    table = [("a", 0, "Path", "contains", "one"), ("b", 1, "Path", "endswith", "two"), ("b", 1, "Path", "contains", "ne"), ("c", 2, "Path", None, "three"), ("d", 3, "Nowhere", "contains", "o"), ("e", 4, "Path", "startswith", "ONE")]
    df = spark.createDataFrame([("k", "x one two"), ("k", "nothing"), (None, "one"), (None, None), ("k", "is three, four")], "key string, text string")
    for chunk in (2, 50_000):
        got = sorted(((r.key, r.text, r.sigma_rule_ids, r.sigma_matched) for r in rules.match_rules(df, spark.createDataFrame(table, rules.RULE_SCHEMA), chunk=chunk).collect()), key=str)
        assert got == sorted([("k", "x one two", ["a", "b"], True), ("k", "nothing", [], False), (None, "one", ["a", "b", "e"], True), (None, None, [], False), ("k", "is three, four", ["c"], True)], key=str)
    assert not rules.match_rules(df, spark.createDataFrame([], rules.RULE_SCHEMA)).where("sigma_matched").collect()


def test_techniques_in_chunks(spark):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    events = spark.createDataFrame([(i, vec()) for i in range(20)] + [(99, None)], "id long, embedding array<double>")
    table = spark.createDataFrame([(i, f"T{i}", vec()) for i in range(17)], "no int, technique_id string, vector array<double>")
    one = sorted(map(tuple, similarity.top_techniques(events, table, "id").collect()))
    assert len(one) == 60 and sorted(map(tuple, similarity.top_techniques(events, table, "id", chunk=4).collect())) == one


def test_keywords_in_chunks(spark):
    texts = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, None)], "doc_id long, text string")
    kw = spark.createDataFrame([("alpha", "T1"), ("BETA", "T2"), ("gam", "T2"), ("x", "T9"), ("gamma", "T3")], "keyword string, technique_id string")
    tech = spark.createDataFrame([("T1",), ("T2",), ("T3",)], "technique_id string")
    for chunk in (2, 1000):
        assert sorted(map(tuple, datasets.matches(texts, kw, tech, chunk=chunk).collect())) == [(1, "T1"), (1, "T2"), (2, "T2"), (2, "T3")]


def test_addresses(spark):
    nets = ["10.0.0.0/8", "2001:db8::/33", "::1/128", "fe80::/10"]
    known = [ipaddress.ip_network(n) for n in nets]
    rng = random.Random(4)
    names = ["::", "::1", ":::", "1::2::3", "fe80::1%eth0", "2001:db8::10.0.0.1", "2001:db8:8000::1", "::ffff:10.1.2.3", "10.0.0.256", "10.0.0", "010.0.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "g::", "12345::", "", "x", "::1.2.3", None]
    names += [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(20)] + [str(ipaddress.ip_address(0x20010DB8 << 96 | rng.getrandbits(96))) for _ in range(20)] + [ipaddress.ip_address(rng.getrandbits(128)).exploded.upper() for _ in range(5)]

    def plain(a):
        try:
            x = ipaddress.ip_address(a)
        except ValueError:
            return (False, False)
        return True, any(x.version == n.version and x in n for n in known)

    df = spark.createDataFrame([(a,) for a in names], "a string")
    got = {r.a: (r.ok, r.held) for r in df.select("a", network.is_address(F.col("a")).alias("ok"), network.in_networks(F.col("a"), nets).alias("held")).collect()}
    assert got == {a: plain(a) for a in names}


def test_client_behind_proxies(spark):
    trusted = ["10.0.0.0/8", "::1/128"]
    rows = [("::1", "9.9.9.9", "9.9.9.9"), ("8.8.8.8", "9.9.9.9", "8.8.8.8"), ("::1", "1.2.3.4, 10.0.0.1", "1.2.3.4"), ("::1", "1.2.3.4, bad, 10.0.0.1", "::1"), ("10.0.0.2", "10.0.0.3,::1", "10.0.0.3"), ("10.0.0.2", " , ", "10.0.0.2"), ("10.0.0.2", None, "10.0.0.2"), ("10.0.0.2", ":::, 2001:db8::1", "2001:db8::1")]
    df = spark.createDataFrame(rows, "peer string, hops string, want string")
    assert df.where(~network.client_ip(F.col("peer"), F.col("hops"), trusted).eqNullSafe(F.col("want"))).collect() == []


def test_references_are_those_of_json_libraries(spark):
    rows = [("plain", "syslog", "h", 1700000000.0), ("tab\t\"q\" \\ é € \U0001f600 \x7f \x01\n", "web", "hü", 1.1234567), ("", "", None, 0.5)]
    df = spark.createDataFrame(rows, "raw string, kind string, host string, ts double")
    got = [r[0] for r in df.select(refs.raw_log_ref(F.col("raw"), F.col("kind"), F.col("host"), F.col("ts"))).collect()]
    want = [hashlib.sha256(json.dumps({"raw": a, "source_type": b, "host": c or "", "ingest_ts": round(d, 6)}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for a, b, c, d in rows]
    assert got == want


def test_replay_keeps_what_lies_deeper(spark):
    one = '{"a":{"_dlq_replay_count":7},"b":[1,"x"]}'
    df = spark.createDataFrame([(one, "t"), ('{"_dlq_replay_count":2}', "t"), ('{"_dlq_replay_count":3}', "t"), ('"text"', "t"), ("{broken", "t"), (None, "t")], "original string, original_topic string")
    got = sorted((r.replay_count, json.loads(r.value)) for r in archive.replay(df).collect())
    assert got == [(1, {**json.loads(one), "_dlq_replay_count": 1}), (3, {"_dlq_replay_count": 3})]


def test_stored_letters_are_replayed_once(spark, tmp_path):
    schema = "original string, error string, original_topic string, timestamp string, retry_count int"
    put = lambda n: spark.createDataFrame([(json.dumps({"n": n}), "e", "t", "now", 1)], schema).write.mode("append").parquet(f"{tmp_path}/letters")
    sink = lambda batch: batch.write.mode("append").parquet(f"{tmp_path}/out")
    for n in (1, 2):
        put(n)
        archive.replay_stored(spark, f"{tmp_path}/letters", sink, f"{tmp_path}/checkpoint").awaitTermination(60)
    got = sorted(json.loads(r.value)["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [1, 2]


def test_alerts_with_a_missing_input_raise(spark):
    df = spark.createDataFrame([(0, 1, 0.0)], "ts long, up int, p99 double").withColumn("ts", F.timestamp_seconds("ts"))
    assert metrics.alerts(df, rules=metrics.alert_rules("APIDown", "HighLatencyP99")).count() == 2
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        metrics.alerts(df)
    with pytest.raises(KeyError):
        metrics.alert_rules("HighLatencyP98")


def test_redaction_of_addresses_and_cards(spark):
    policy = redact.Policy(redact_ip_addresses=True, redact_hostnames=True)
    rows = [("from 2001:db8::1 to ::1 at 10:20", "from <IP> to <IP> at 10:20"), ("4111 1111 1111 1111 4111-1111-1111-1111", "<CREDIT_CARD> <CREDIT_CARD>"), ("4111 1111 1111 1112", "4111 1111 1111 1112"), ("hostname = web1, host=x", "hostname=<HOST>, host=<HOST>"), ("Authorization: bearer abc", "Authorization: bearer <REDACTED>"), ("api-key: 'a b' TOKEN=x", "api-key=<REDACTED> TOKEN=<REDACTED>"), (None, None)]
    df = spark.createDataFrame(rows, "raw string, want string").withColumn("got", redact.redact(F.col("raw"), policy))
    assert [(r.got, r.want) for r in df.collect() if r.got != r.want] == []


def test_groups_and_let(spark):
    df = spark.createDataFrame([("a-1",), ("\x02\x01x",), ("nope",), (None,)], "s string")
    assert [r[0] for r in df.select(text.groups(F.col("s"), "^([a-z])-(\\d)$", 2)).collect()] == [["a", "1"], None, None, None]


class Bad(Exception):
    pass


def test_a_failing_row_costs_no_other(spark):
    def load():
        def run(texts):
            if any(t == "bad" for t in texts):
                raise Bad
            return [float(len(t)) for t in texts]

        return run

    df = spark.createDataFrame([("one",), ("bad",), (None,), ("three",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(models.model_column(load, "double", "lengths")("t")).collect()] == [3.0, None, None, 5.0]
    vectors = models.embedder(lambda: lambda texts: [[float(len(t)), 4.0] if t != "bad" else [0.0, 0.0] for t in texts], "unit")
    assert [r[0] for r in df.select(vectors("t")).collect()][:3] == [[0.6, 0.8], None, None]
    pairs = models.pair_scorer(lambda: lambda pairs: [0.0 if a == b else 100.0 for a, b in pairs], "pairs")
    found = df.where("t is not null").select(pairs(F.array(F.struct(F.col("t").alias("text"), F.lit("one").alias("other")), F.struct(F.col("t").alias("text"), F.lit("x").alias("other")))).alias("s"))
    assert [[round(x, 3) for x in r.s] for r in found.collect()] == [[0.5, 1.0], [1.0, 1.0], [1.0, 1.0]]
    tags = models.tagger(lambda: lambda texts: [[("System", t, 0.9)] for t in texts], "tags")
    assert df.select(tags("t").alias("e")).where("e is not null").count() == 3
    assert [r[0] for r in df.select(models.onnx_classifier("/no/such/model.onnx")(F.array(F.lit(1.0)))).collect()] == [0.5] * 4


def test_a_changed_file_loads_anew(tmp_path):
    path = tmp_path / "m"
    path.write_text("1")
    get = lambda: models.loaded(("reload", models.version_of(str(path))), path.read_text)
    assert get() == "1"
    path.write_text("2")
    import os

    os.utime(path, ns=(1, 10**18))
    assert get() == "2" and models.version_of("/no/such") == 0


def test_failed_tiers_are_neutral(spark):
    rows = spark.createDataFrame([(1, "syslog", "m"), (2, "endpoint", "m"), (3, "endpoint", None)], "k long, source_type string, raw string")
    m = cascade.Models(syslog=lambda d: F.lit(None).cast("double"), event=lambda d: F.when(d["k"] == 2, 0.9))
    got = sorted((r.k, r.classifier_score, r.score_degraded) for r in cascade.first_tier(rows, m).collect())
    assert got == [(1, 0.5, True), (2, 0.9, False), (3, 0.5, True)]
    assert {(r.classifier_score, r.score_degraded) for r in cascade.first_tier(rows, cascade.Models()).collect()} == {(0.0, True)}


def test_brokers(spark):
    broker = config.kafka_options("b:9092")
    options = brokers.reader_options(brokers.ARCHIVE, broker)
    assert options["subscribe"] == "raw-logs" and options["startingOffsets"] == "earliest" and options["failOnDataLoss"] == "true" and options["kafka.bootstrap.servers"] == "b:9092"
    with pytest.raises(ValueError):
        brokers.reader_options(brokers.Group("g", ("t",), "middle"), broker)
    ref = "ab" * 32
    came = [("traceparent", bytearray(b"00-" + b"1" * 32 + b"-" + b"2" * 16 + b"-01"))]
    df = spark.createDataFrame([(ref, "h", "raw", came), (ref, "h", "raw", [("traceparent", bytearray(b"junk"))]), (ref, "h", "raw", None)], "raw_log_ref string, host string, raw string, headers array<struct<key:string,value:binary>>")
    got = [(r.topic, json.loads(r.value), bytes(r.headers[0].value).decode()) for r in brokers.scored_records(df, "headers").collect()]
    own = f"00-{ref[:32]}-{ref[32:48]}-01"
    assert [g[2] for g in got] == ["00-" + "1" * 32 + "-" + "2" * 16 + "-01", own, own] and got[0][:2] == ("scored-logs", {"raw_log_ref": ref, "host": "h"})


def test_config_file(tmp_path):
    (tmp_path / "c.json").write_text('{"a": "${MY-NAME:x}", "b": ["${B}"]}')
    assert config.load(str(tmp_path / "c.json"), {"B": "2"}) == {"a": "x", "b": ["2"]}


def test_registry_store(spark, tmp_path):
    store = registry.Store(spark, f"{tmp_path}/registry")
    assert store.read().count() == 0
    new = spark.sql("SELECT 'r' || id AS run_id, 't' AS model_type, CAST(NULL AS STRING) AS version, '' AS status, '/a' AS artifact_dir, CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS MAP<STRING, DOUBLE>) AS metrics FROM range(3)")
    store.update(lambda runs: registry.insert(runs, new))
    store.update(lambda runs: registry.promote(runs, "r1"))
    assert {r.run_id: r.status for r in store.read().collect()} == {"r0": "staging", "r1": "production", "r2": "staging"}
    (tmp_path / "registry" / "LOCK").write_text("")
    with pytest.raises(RuntimeError, match="locked"):
        store.update(lambda runs: runs)
    store.unlock()
    with pytest.raises(KeyError):
        store.update(lambda runs: registry.promote(runs, "none"))
    store.update(lambda runs: registry.archive(runs, "r2"))
    assert store.read().where("status = 'archived'").count() == 1
    stamp = spark.sql("SELECT TIMESTAMP '2024-02-03 04:05:06' AS t").select(registry.run_id(F.col("t"), F.lit("m"))).first()[0]
    assert stamp.startswith("20240203-040506-") and len(stamp) == 24


def test_artifacts_are_promoted_whole(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "model.bin").write_bytes(b"new")
    (tmp_path / "prod").mkdir()
    (tmp_path / "prod" / "old.bin").write_bytes(b"old")
    got = registry.promote_artifacts(spark, f"{tmp_path}/run", f"{tmp_path}/prod")
    assert [tuple(r) for r in got.collect()] == [("model.bin", "ok")] and not (tmp_path / "prod" / "old.bin").exists()


def test_framing_byte_by_byte():
    data = b"5 hello3 a\nbline one\n12345 is no count\n" + b"2 xy" + b"tail"
    whole, one = framing.Framer(), framing.Framer()
    want = list(whole.feed(data)) + list(whole.end())
    got = [m for i in range(len(data)) for m in one.feed(data[i : i + 1])] + list(one.end())
    assert want == got and want[:3] == [b"hello", b"a\nb", b"line one"]
    long = framing.Framer()
    began = time.perf_counter()
    assert sum(1 for _ in long.feed(b"3 abc" * 200_000)) == 200_000 and time.perf_counter() - began < 10
    big = framing.Framer(most=8)
    assert list(big.feed(b"9 123456789")) == [] and big.closed


def test_tcp_source(spark, tmp_path):
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    spark.dataSource.register(SyslogTcp)
    stream = spark.readStream.format("syslog_tcp").options(host="127.0.0.1", port=port, wait=0.2).load()
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").queryName("tcp").start()
    try:
        for k in range(100):
            try:
                conn = socket.create_connection(("127.0.0.1", port), timeout=5)
                break
            except OSError:
                time.sleep(0.2)
        conn.sendall(b"5 hel")
        time.sleep(0.3)
        conn.sendall(b"loline\nlast")
        conn.close()
        seen = []
        for _ in range(100):
            try:
                seen = sorted(r.raw for r in spark.read.schema("raw string").parquet(f"{tmp_path}/out").collect())
            except Exception:  # nothing was written yet
                seen = []
            if len(seen) == 3:
                break
            time.sleep(0.3)
        assert seen == ["hello", "last", "line"]
    finally:
        assert pipelines.stop_all(spark, 5) == ["tcp"] and not query.isActive


def test_spool_on_failure_and_drain(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "raw string, ingest_ts double")
    pipelines.spool(rows, f"{tmp_path}/spool")
    (tmp_path / "spool" / "part-broken.txt").write_text("{broken\n[1]\n")
    good, bad = archive.drain_spool(spark, f"{tmp_path}/spool", "raw string, ingest_ts double")
    assert sorted(map(tuple, good.collect())) == [("a", 1.0), ("b", 2.0)] and sorted(r[0] for r in bad.collect()) == ["[1]", "{broken"]
