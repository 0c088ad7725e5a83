"""Rules over events end to end: both plans, correlation, stream, service, process trees."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from emberlog import queries as Q
from emberlog.functions.fields import JsonEvents
from emberlog.operators import detect, proctree
from emberlog.operators.correlate import correlate, fold_alerts, fold_windows
from emberlog.plans.compiler import compile_rules
from emberlog.plans.ir import EngineConfig
from emberlog.service import Service
from emberlog.sources.rules import load_rules
from emberlog.sources.store import run_migrations
from emberlog.streaming.correlate import correlate_stream, fold

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(lambda v: tuple(map(str, v)) if hasattr(v, "__len__") and not isinstance(v, str) else v).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = _norm(Q.QUERIES[name](spark, SF).toPandas()), _norm(con.execute(Q.ORACLE_SQL[name]).df())
    assert got.equals(want)


def test_cidr_v6_of_ids_beyond_16_bits(spark, tmp_path):
    ids = [None, 0, 1, 2, 3, -3, -1, 65535, 65536, 65538, 99999, 5_999_997, 2**32 - 1, 2**32, 3 * 2**48, 2**63 - 1, 2**63 - 2, -(2**63), 1 - 2**63]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    want = duckdb.sql(Q.ORACLE_SQL["match_cidr_v6"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in Q.QUERIES["match_cidr_v6"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(ids)


def events(spark, *rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "event_id long, event string")


RULES = """
name: fail
detection: {s: {EventID: 4625}, condition: s}
---
name: enc
level: high
detection: {s: {Image|endswith: powershell.exe}, c: {CommandLine|contains: -enc}, f: {User: system}, condition: s and c and not f}
---
name: any
detection: {k: [needle], condition: k}
---
name: nested
detection: {s: {'process.pid': 12}, condition: s}
---
name: re
detection: {s: {CommandLine|re: 'inv[o0]ke'}, condition: not s}
"""
ROWS = [
    {"EventID": "4625", "User": "a"}, {"EventID": 4625}, {"Image": "C:\\PowerShell.EXE", "CommandLine": "x -ENC y"}, {"Image": "powershell.exe", "CommandLine": "-enc", "User": "SYSTEM"},
    {"a": {"b": ["x", {"c": "NEEDLE"}]}}, {"process": {"pid": 12}}, {"process.pid": 12}, {"CommandLine": "invoke"}, {},
]
WANT = [[1, 5], [1, 5], [2, 5], [5], [3, 5], [4, 5], [5], [], [5]]


@pytest.mark.parametrize("limit", [100, 1])
def test_both_plans(spark, limit):
    engine = detect.Engine(compile_rules([RULES]), JsonEvents(), EngineConfig(projection_rules=limit))
    got = [r.matched for r in engine.evaluate(events(spark, *ROWS)).orderBy("event_id").collect()]
    assert got == WANT


def test_empty_ruleset_and_statistics(spark):
    engine = detect.Engine(compile_rules(["---\nx: 1"]), JsonEvents())
    assert engine.evaluate(events(spark, {})).first().matched == []
    s = detect.Engine(compile_rules([RULES]), JsonEvents()).statistics()
    assert s["rules"] == 5 and s["dropped"] == 0


def test_prefilter_loses_nothing(spark):
    rs = compile_rules(["detection: {s: {a: Foo}, c: {b|contains: [bar, baz]}, condition: s and c}"])
    engine = detect.Engine(rs, JsonEvents())
    df = events(spark, {"a": "FOO", "b": "xBAZ"}, {"a": "foo"}, {"b": "bar"})
    assert [r.event_id for r in df.where(detect.prefilter(engine, F.col("event"))).orderBy("event_id").collect()] == [0, 1]
    assert detect.prefilter(detect.Engine(compile_rules([RULES]), JsonEvents()), F.col("event"))._jc.toString() == "true"


def test_fold(spark):
    times = [0, 10, 20, 30, 200, 205, 900]
    assert [a[1] for a in fold(None, 0, 100, 3, [(t, t) for t in times])[2]] == [20]
    df = spark.createDataFrame([(0, "r", "g", 100, 3, t, t) for t in times], "correlation int, rule_name string, group_key string, span_us long, gte int, t long, event_id long")
    assert [r.event_id for r in fold_alerts(df).collect()] == [20]
    assert len(fold(None, 0, 0, 1, [(1, 1), (1, 2)])[2]) == 2 and not fold(None, 0, 0, 2, [(1, 1), (1, 2)])[2]


CORR = RULES + "---\nname: c\ncorrelation: {type: value_count, rules: [fail], group-by: [user], timespan: 1m, condition: {gte: 2}}"


def test_stream_equals_batch(spark, tmp_path):
    rs = compile_rules([CORR])
    rows = [(i, f"2024-01-01 00:{m:02d}:{s:02d}", "u" + str(i % 2), [1]) for i, (m, s) in enumerate([(0, 0), (0, 5), (0, 30), (2, 0), (2, 59), (3, 5), (9, 0)])]
    df = spark.createDataFrame(rows, "event_id long, t string, user string, matched array<int>").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted((r.group_key, r.event_id, r.n) for r in correlate(df, rs, {"user": F.col("user")}).collect())
    stream = correlate_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rs, {"user": F.col("user")})
    q = stream.writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert want and sorted((r.group_key, r.event_id, r.n) for r in spark.table("alerts").collect()) == want


def test_service(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    assert s.health() == {"status": "ok"} and s.replace_rules([RULES]) == 5
    with pytest.raises(ValueError):
        s.replace_rules(["detection: 5"])
    assert s.engine.rule_count() == 5
    out = s.ingest(spark.createDataFrame([(json.dumps({"endpoint_id": "e1", "EventID": 4625, "CommandLine": "invoke", "host": {"name": "h"}}),), ('[{"CommandLine": "invoke"}, 3]',), ("7",)], "payload string"), 1)
    assert out["events"].count() == 2 and out["detections"].count() == 1 and out["event_rules"].count() == 1
    assert [(r.endpoint_id, r.host_name) for r in s.endpoints().collect()] == [("e1", "h")]
    assert s.stats() == {"rules": 5, "endpoints": 1, "events": 2, "detections": 1}
    assert {r.rule_uid: r.detections for r in s.rules().collect()}["rid-1"] == 1
    r = s.evaluate_raw(spark.createDataFrame([("{",), ('{"EventID": 4625}',)], "event string")).collect()
    assert [x.error for x in r] == ["invalid JSON", None] and r[1].matched == [1, 5]


def test_tree_cycle_and_detach(spark):
    rows = [("e", "", "", "1", "2", "a.exe", 1), ("e", "", "", "2", "1", "b.exe", 2), ("e", "", "", "3", "9", "c.exe", 3), ("e", "", "", "4", "3", "d.exe", 4), ("e", "", "", "4", "", "", 5), ("e", "", "", "5", "4", "C:\\Windows\\System32\\x.exe", 6)]
    df = spark.createDataFrame(rows, "endpoint_id string, entity_id string, parent_entity_id string, pid string, ppid string, executable string, seq int").select("*", F.lit("").alias("name"), F.lit("").alias("command_line"), F.timestamp_seconds(F.col("seq")).alias("ts"))
    nodes = proctree.build_nodes(df, F.timestamp_seconds(F.lit(100)))
    pos = {r.key: (r.root, r.depth) for r in proctree.positions(nodes).collect()}
    assert pos == {"pid:1": (None, None), "pid:2": (None, None), "pid:3": ("pid:9", 2), "pid:9": ("pid:9", 1), "pid:4": ("pid:4", 1)}
    assert {r.key: r.executable for r in nodes.collect()}["pid:4"] == "d.exe"
    assert [r.key for r in proctree.chain(nodes, "e", "pid:3").orderBy("step").collect()] == ["pid:9", "pid:3"]
    assert [r.key for r in proctree.snapshot(nodes, "e", "pid:9").collect()] == ["pid:9", "pid:3"]
    with pytest.raises(KeyError):
        proctree.snapshot(nodes, "zz")


def test_report_counts_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("emberlog.service.LISTED", 2, raising=False)
    rows = [("e", "", "", "1", "", "winword.exe", 1)] + [("e", "", "", str(i), "1", "powershell.exe", i) for i in range(2, 1005)]
    df = spark.createDataFrame(rows, "endpoint_id string, entity_id string, parent_entity_id string, pid string, ppid string, executable string, seq int").select("*", F.lit("").alias("name"), F.lit("").alias("command_line"), F.timestamp_seconds(F.col("seq")).alias("ts"))
    s = Service(spark, str(tmp_path))
    nodes = proctree.build_nodes(df, F.timestamp_seconds(F.lit(5000)))
    monkeypatch.setattr(s, "process_nodes", lambda: nodes)
    text = s.analyze("e")
    assert "Suspicious Chains: 1003\n" in text and "(1001 more not listed)" in text and "Anomalies: 1\n" in text and text.count("Office spawning") == 2


def test_rule_directory_and_migrations(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.yml").write_text("detection: {a: {x: 1}, condition: a}")
    (tmp_path / "b.yaml").write_text("detection: {a: {x: null}, condition: a}")
    rs, loaded, skipped = load_rules(str(tmp_path))
    assert (len(rs.rules), loaded, skipped) == (1, 1, 1)
    assert run_migrations(spark, {"2": "SELECT 2;", "1": "-- x\nSELECT 1; SELECT 3"}) == ["SELECT 1", "SELECT 3", "SELECT 2"]


def corpus(n: int) -> str:
    """A generated ruleset in the shapes of real ones: literals on a few crowded fields, filters, patterns, networks, counts."""
    out = []
    for i in range(n):
        kind = i % 7 if i % 7 != 3 or i % 35 == 3 else 0  # patterns are few
        body = {
            0: f"s: {{Image|endswith: '\\tool{i}.exe'}}\n  c: {{CommandLine|contains: [' -x{i} ', '/enc{i}']}}\n  condition: s and c",
            1: f"s: {{CommandLine|contains|all: ['a{i}', 'b{i}']}}\n  condition: s",
            2: f"s: {{EventID: {i}}}\n  f: {{User|startswith: sys{i}}}\n  condition: s and not f",
            3: f"s: {{CommandLine|re: 'run[0-9]{{{{2}}}}x{i}'}}\n  condition: s".replace("{{", "{").replace("}}", "}"),
            4: f"s1: {{Image: p{i}.exe}}\n  s2: {{ParentImage|contains: q{i}}}\n  s3: {{EventID: {i}}}\n  condition: 1 of s* or s3",
            5: f"s: {{DestinationIp|cidr: 10.{i % 256}.0.0/16}}\n  condition: s",
            6: f"s:\n    - {{CommandLine|startswith: go{i}}}\n    - {{Image|contains: 'w{i}w', EventID: [1, 2]}}\n  f: {{CommandLine|contains: ok}}\n  condition: s and not f",
        }[kind]
        out.append(f"title: Rule {i}\nid: {i + 1}\nname: r{i}\nlevel: low\ndetection:\n  {body}\n")
    return "---\n".join(out)


def corpus_events(spark, n: int):
    rows = []
    for i in range(n):
        e = {"Image": [f"C:\\tool{i}.exe", f"p{i}.exe", f"xw{i}wx", "other"][i % 4], "EventID": i % 3 if i % 2 else i, "CommandLine": [f"start -x{i} a{i} b{i}", f"/enc{i} run12x{i}", f"GO{i} ok", f"go{i}", "quiet"][i % 5], "DestinationIp": f"10.{i % 300}.1.1"}
        if i % 6 == 0:
            e |= {"ParentImage": f"Q{i}", "User": f"SYS{i}"}
        rows.append(e)
    return events(spark, *rows)


@pytest.mark.parametrize("mode", ["reference", "spec"])
def test_plans_agree_on_a_generated_corpus(spark, mode):
    rs = compile_rules([corpus(140)])
    df = corpus_events(spark, 150)
    one, two = (detect.Engine(rs, JsonEvents(), EngineConfig(projection_rules=k, mode=mode)) for k in (1000, 1))
    a, b = ({r.event_id: r.matched for r in e.evaluate(df).collect()} for e in (one, two))
    assert a == b and sum(map(len, a.values())) > 100


def test_thousands_of_rules(spark):
    """A corpus of real size compiles and runs; a rule's own events are found."""
    rs = compile_rules([corpus(3500)])
    engine = detect.Engine(rs, JsonEvents())
    assert engine.rule_count() == 3500
    got = {(r.event_id, r.rule_id) for r in engine.matches(corpus_events(spark, 300)).collect()}
    assert {(0, 1), (140, 141)} <= got and len({r for _, r in got}) > 100


def test_repeated_and_null_keys(spark):
    rs = compile_rules(["detection: {s: {a: x}, condition: s}\n---\ndetection: {s: {b: y}, condition: s}"])
    df = spark.createDataFrame([(1, '{"a": "x"}'), (1, '{"b": "y"}'), (None, '{"a": "X", "b": "Y"}'), (None, "{}")], "event_id long, event string")
    for limit in (100, 1):
        engine = detect.Engine(rs, JsonEvents(), EngineConfig(projection_rules=limit))
        assert sorted((r.event_id or 0, r.matched) for r in engine.evaluate(df).collect()) == [(0, []), (0, [1, 2]), (1, [1]), (1, [2])]


def test_counters(spark):
    engine = detect.Engine(compile_rules([RULES]), JsonEvents())
    df, seen = engine.observed(events(spark, *ROWS))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"events": 9, "events_matched": 8, "matches": sum(map(len, WANT)), "primitive_evaluations": 9 * len(engine.ruleset.primitives)}


def test_names_before_titles(spark):
    rs = compile_rules(["name: n1\ntitle: T1\nid: 1\ndetection: {s: {a: x}, condition: s}\n---\ntitle: T2\nid: 2\nlevel: high\ndescription: D\ndetection: {s: {a: x}, condition: s}\n---\nid: 3\ndetection: {s: {a: x}, condition: s}"])
    rules = detect.rule_table(spark, rs)
    found = detect.detections(spark.createDataFrame([(1, i) for i in (1, 2, 3, 9)], "event_id int, rule_id int"), rules)
    assert {r.rule_id: r.rule_name for r in found.collect()} == {1: "n1", 2: "T2", 3: "rule-3", 9: "rule-9"}
    read = {r.rule_id: r for r in detect.enriched(found.withColumn("rule_name", F.when(F.col("rule_id") != 2, F.col("rule_name"))), rules).collect()}
    assert (read[1].rule_title, read[2].rule_title, read[2].rule_level, read[2].rule_description, read[9].rule_title, read[9].rule_uid) == ("n1", "T2", "high", "D", None, None)


def test_windows_go_on_between_calls(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    s.replace_rules([CORR])
    alerts = []
    for k in (1, 2, 3, 4):
        out = s.ingest(spark.createDataFrame([(json.dumps({"EventID": 4625, "user": "u", "endpoint_id": "e"}),)], "payload string"), k)
        alerts.append(out["detections"].where("rule_id = 0").count())
    assert alerts == [0, 1, 0, 1]
    again = s.ingest(spark.createDataFrame([(json.dumps({"EventID": 4625, "user": "u", "endpoint_id": "e"}),)], "payload string"), 4)
    assert again["detections"].where("rule_id = 0").count() == 1


def test_fold_in_batches_and_parts(spark):
    """State in, state out: any cut of the events gives the alerts of a plain loop."""
    import random

    r = random.Random(3)
    rows = [(0, "r", g, 100, 3, t, i) for i, (g, t) in enumerate(sorted(((r.choice("abc"), r.randint(0, 20_000)) for _ in range(600)), key=lambda x: x[1]))]
    schema = "correlation int, rule_name string, group_key string, span_us long, gte int, t long, event_id long"
    want = sorted(a[2] for g in "abc" for a in fold(None, 0, 100, 3, [(x[5], x[6]) for x in rows if x[2] == g])[2])
    assert sorted(x.event_id for x in fold_alerts(spark.createDataFrame(rows, schema)).collect()) == want and len(want) > 20
    got, state = [], {}
    for k in range(0, 600, 150):
        old = spark.createDataFrame([(*key, *v) for key, v in state.items()], "rule_name string, group_key string, start long, n int")
        for x in fold_windows(spark.createDataFrame(rows[k : k + 150], schema), old).collect():
            if x.is_state:
                state[x.rule_name, x.group_key] = (x.start, x.n)
            else:
                got.append(x.event_id)
    assert sorted(got) == want


def test_session_limits_stay(spark):
    rows = [("e", "", "", str(i), str(i // 2) if i > 1 else "", "a.exe", i) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "endpoint_id string, entity_id string, parent_entity_id string, pid string, ppid string, executable string, seq int").select("*", F.lit("").alias("name"), F.lit("").alias("command_line"), F.timestamp_seconds(F.col("seq")).alias("ts"))
    nodes = proctree.build_nodes(df, F.timestamp_seconds(F.lit(100)))
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    assert proctree.descendants(nodes, "e", "pid:1").count() == 18
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit") == before and not [t for t in spark.catalog.listTables() if t.name.startswith(("own_", "start_"))]


def test_stream_ingest(spark, tmp_path):
    from emberlog.sources.store import Store
    from emberlog.streaming.ingest import ingest, read_ndjson

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"endpoint_id": "e1", "EventID": 4625}\n{"CommandLine": "invoke"}\n')
    engine, store = detect.Engine(compile_rules([RULES]), JsonEvents()), Store(spark, str(tmp_path / "store"))
    q = ingest(read_ndjson(spark, str(tmp_path / "in")), lambda: engine, store, str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination(120)
    assert store.read("events").count() == 2
    assert sorted(r.rule_id for r in store.read("detections").collect()) == [1, 5]
    assert [r.endpoint_id for r in store.read("endpoints").collect()] == ["e1"]


def test_stream_of_equal_events_correlates_over_micro_batches(spark, tmp_path):
    from emberlog.sources.store import Store
    from emberlog.streaming.ingest import ingest, read_ndjson

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text('{"user": "u", "EventID": 4625}\n' * 2)
    engine, store = detect.Engine(compile_rules([CORR]), JsonEvents(), EngineConfig(projection_rules=1)), Store(spark, str(tmp_path / "store"))
    q = ingest(read_ndjson(spark, str(tmp_path / "in"), 1), lambda: engine, store, str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination(180)
    assert store.read("events").select("event_id").distinct().count() == 6
    assert store.read("detections").where("rule_id = 0").count() == 3 and store.read("event_rules").where("rule_id = 1").count() == 6


def test_feeds(spark):
    from emberlog.sources import feeds

    one = lambda d: spark.createDataFrame([(json.dumps(d),)], "event string")
    w = feeds.windows_feed(one({"@timestamp": "t", "host": {"name": "h", "ip": "1"}, "winlog": {"event_id": 1, "event_data": {"Image": "x.exe"}}})).first().asDict()
    assert (w["endpoint_id"], w["host_name"], w["event_id"], w["event_data.Image"], w["agent.version"]) == ("h", "h", "1", "x.exe", feeds.WINDOWS_AGENT)
    j = feeds.journal_feed(one({"_MACHINE_ID": "m", "_HOSTNAME": "h", "_EXE": "/bin/x"})).first()
    assert (j.endpoint_id, j.hostname, j.message, j.Image, j.event.service) == ("m", "h", "", "/bin/x", "sshd")
    lines = ["garbage", "type=A msg=audit(1700000000.123:42): pid=1 pid=2 msg='op=x acct=\"u 1\"' tail=3\x1dUID=\"root\" pid=9", "msg=audit(bad): a=1\x1db=2"]
    a, b, c = feeds.audit_parse(spark.createDataFrame(list(enumerate(lines)), "i int, message string")).orderBy("i").collect()
    assert a.timestamp is None and a.seqno is None and a.fields == {}
    assert b.seqno == 42 and b.timestamp.microsecond == 123000 and b.fields == {"type": "A", "UID": "root", "pid": "2", "op": "x", "acct": "u 1", "tail": "3"}
    assert c.seqno is None and c.fields == {"b": "2", "a": "1"}


def test_risk_and_advice(spark):
    d = spark.createDataFrame([("p", "lateral_movement", "critical", 1.0, "2024-01-01 00:00:00"), ("p", "x", "critical", 1.0, "2024-01-01 00:00:00"), ("q", "x", "low", 0.5, "2023-01-01 00:00:00")], "process_key string, rule_name string, severity string, confidence double, t string").withColumn("ts", F.to_timestamp("t"))
    p = spark.createDataFrame([("p", "cmd.exe", ""), ("q", "a", "")], "process_key string, executable string, command_line string")
    now = F.lit("2024-01-01 00:01:00").cast("timestamp")
    scores = proctree.risk_scores(d, p, now)
    got = {r.process_key: r for r in scores.withColumn("advice", proctree.recommendations(F.col("risk"), F.col("threats"))).collect()}
    assert got["p"].score == pytest.approx(2.2) and got["p"].risk == "critical" and len(got["p"].advice) == 5
    assert got["q"].score == pytest.approx(0.5) and got["q"].risk == "low" and got["q"].advice == []
    assert [r.process_key for r in proctree.high_risk(proctree.unexpired(scores, now)).collect()] == ["p"]
    assert proctree.risk_stats(scores).first().total == 2
