"""Routing, channels, flattening, alert rows, CSV and the command line."""

import csv
import glob
import json

from pyspark.sql import functions as F

from ruleforge.operators.options import Options
from ruleforge.operators.route import CATEGORIES, SERVICES, in_channel, relevant, route_of
from ruleforge.rules.reader import parse_config, parse_rule
from ruleforge.scan import find_alerts, main
from ruleforge.sources.alerts import guard_cell, shown_time
from ruleforge.sources.flatten import event_time, trimmed
from ruleforge.sources.records import read_records

EVENT = {"System": {"Provider": {"Name": "P"}, "EventID": {"Value": 7}, "Channel": "Security", "Computer": "host", "EventRecordID": 5, "TimeCreated": {"SystemTime": 1700000000.25}}, "EventData": {"Image": " \u00a0x.exe\t", "Inner": {"Deep": "=cmd"}}}


def rule(source="", detection="s:\n    Image|endswith: .exe\n  condition: s", more=""):
    return parse_rule(f"title: T\nid: id-1\nlevel: high\ntags: [a, b]\nlogsource: {{{source}}}\ndetection:\n  {detection}\n{more}")


def test_tables_of_channels():
    assert len(SERVICES) == 26 and len(CATEGORIES) == 31
    assert SERVICES["security"] == ("Security",) and CATEGORIES["process_creation"] == (SERVICES["sysmon"][0], "Security")


def test_channel_filter(spark):
    df = spark.createDataFrame([("Security",), ("SECURITY",), ("System",), ("",), (None,)], "Channel string")
    hits = lambda source: [r.Channel for r in df.where(in_channel(rule(source), F.col("Channel"))).collect()]
    assert hits("service: security") == ["Security", "SECURITY", "", None] and len(hits("service: unheard")) == 5
    assert hits("category: process_creation, service: system") == ["System", "", None] and "Security" in hits("category: process_creation")


def test_routes(spark):
    config = parse_config("defaultindex: rest\nlogsources:\n  a:\n    category: web\n    rewrite: {service: till}\n    conditions:\n      kind: 1\n  b:\n    service: till\n    index: 'log-?'\n    conditions:\n      user: x\n")
    route = route_of(rule("category: web"), [config])
    assert route.indexes == ["log-?"] and len(route.conditions) == 2 and route_of(rule("category: other"), [config]).indexes == ["rest"]
    df = spark.createDataFrame([("log-1", 1, "x"), ("log-1", 2, "x"), ("log-12", 1, "x"), ("log-/", 1, "x")], "index string, kind int, user string")
    keep = lambda c: [(r["index"], r["kind"]) for r in df.where(relevant(df, rule("category: web"), F.col("index"), Options(configs=c))).collect()]
    either = parse_config("logsourcemerging: or\n")
    assert keep([config]) == [("log-1", 1)] and keep([config, either]) == [("log-1", 1), ("log-1", 2)] and keep([]) == []


def test_cells_times_and_spaces(spark):
    cells = ["=1", "+1", "-1", "@x", "\tx", "\rx", "x=", ""]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(guard_cell(F.col("c"))).collect()] == ["'" + c for c in cells[:6]] + cells[6:]
    times = spark.createDataFrame([(1700000000.25,), (0.0,), (None,)], "TimeCreated double")
    assert [r[0] for r in times.select(shown_time(times)).collect()] == ["2023-11-14T22:13:20.25Z", "1970-01-01T00:00:00Z", ""]
    assert times.select(event_time(times).cast("double")).first()[0] == 1700000000.25
    spaces = spark.createDataFrame([(" a b\u00a0\u2003",), ("\n",)], "c string")
    assert [r[0] for r in spaces.select(trimmed(F.col("c"))).collect()] == ["a b", ""]


def test_records_to_csv(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"Event": EVENT}) + "\n{broken\n" + json.dumps({"Event": EVENT | {"EventData": {"Image": "y.dll", "Inner": {"Deep": "z"}}}}) + "\n")
    events = read_records(spark, str(tmp_path / "in"), schema="Event struct<System:struct<Provider:struct<Name:string>,EventID:struct<Value:int>,Channel:string,Computer:string,EventRecordID:bigint,TimeCreated:struct<SystemTime:double>>,EventData:struct<Image:string,Inner:struct<Deep:string>>>")
    rows = {r.Image: r for r in events.collect() if r.Image}
    assert rows["x.exe"].EventID == 7 and rows["x.exe"].Deep == "=cmd" and rows["x.exe"].source_file.endswith("a.jsonl")
    burst = parse_rule("title: two\nname: two\ncorrelation:\n  type: event_count\n  rules: id-1\n  timespan: 1h\n  condition:\n    gte: 1\n")
    found = {r.rule_title: r for r in find_alerts(events, [rule("service: security"), burst]).collect()}
    assert set(found) == {"T", "two"}
    one = found["T"]
    assert (one.timestamp, one.record_id, one.computer, one.channel, one.event_id, one.rule_id, one.rule_level, one.rule_tags) == ("2023-11-14T22:13:20.25Z", "5", "host", "Security", "7", "id-1", "high", "a;b")
    assert json.loads(one.event_json)["Deep"] == "=cmd"
    assert find_alerts(events, [rule("service: system")]).count() == 0 and find_alerts(events, [rule("service: system")], channel_filter=False).count() == 1

    (tmp_path / "r.yml").write_text("title: T\nid: id-1\nlevel: low\ndetection:\n  s:\n    Deep|startswith: '='\n  condition: s\n---\ntitle: U\nid: id-2\ndetection:\n  s: [host]\n  condition: s\n")
    (tmp_path / "ids").write_text("ID-2\n")
    assert main(["-rules", str(tmp_path / "r.yml"), "-exclude", str(tmp_path / "ids"), "-out", str(tmp_path / "out"), str(tmp_path / "in")]) == 0
    assert "1 alerts" in capsys.readouterr().err
    lines = [r for f in glob.glob(f"{tmp_path}/out/*.csv") for r in csv.DictReader(open(f))]
    assert len(lines) == 1 and lines[0]["rule_title"] == "T" and lines[0]["computer"] == "host"
