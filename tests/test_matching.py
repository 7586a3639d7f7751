"""Truth tables of comparators, modifiers and conditions, with fields as columns, as a map and as JSON."""

import json

import pytest
from pyspark.sql import functions as F

from ruleforge.functions import literals, patterns
from ruleforge.operators.detect import Bundle, evaluate, match_column
from ruleforge.operators.options import Options
from ruleforge.operators.search import CompileError
from ruleforge.rules.reader import parse_config, parse_rule


def rule(detection, title="r"):
    return parse_rule(f"title: {title}\ndetection:\n" + "\n".join("  " + x for x in detection.splitlines()))


def leaf(field, values):
    return rule(f"s:\n  {field}: {json.dumps(values)}\ncondition: s")


#: field|modifiers, rule values, event value, whether it matches
TABLE = [
    ("f", "abc", "ABC", True), ("f", "a*c", "a\nc", True), ("f", "a?c", "ac", False), ("f", "a\\*c", "a*c", True), ("f", "a\\*c", "abc", False), ("f", "a\\\\*", "a\\xyz", True),
    ("f", "abc", "abcd", False), ("f|cased", "abc", "ABC", False), ("f|cased", "a*", "Abc", False), ("f", ["x", "y"], "Y", True), ("f", [], "y", False), ("f|all", [], "y", True),
    ("f", None, None, True), ("f", "null", None, True), ("f", "*", None, False), ("f", "", "", True), ("f|neq", "a", None, True), ("f|neq", "a", "A", False), ("f|neq", None, None, False),
    ("f|contains", "b", "aBc", True), ("f|contains", "", None, False), ("f|contains", "", "x", True), ("f|contains|all", ["a", "c"], "xCxa", True), ("f|contains|all", ["a", "z"], "xCxa", False), ("f|contains", "a*c", "xxabbcxx", True),
    ("f|startswith", "ab", "ABC", True), ("f|endswith", "bc", "ABC", True), ("f|startswith", "b*", "abc", False), ("f|endswith|cased", "bc", "ABC", False),
    ("f|re", "^a.c$", "abc", True), ("f|re", "^a.c$", "ABC", False), ("f|re|i", "^a.c$", "ABC", True), ("f|re", "b$", "b\n", False), ("f|re|m", "^b$", "a\nb", True), ("f|re|s", "a.b", "a\nb", True), ("f|re", "a.b", "a\nb", False),
    ("f|re", "(?P<x>a)", "a", True), ("f|re", "[[:alpha:]]+1", "ab1", True), ("f|re", "(?=a)", "a", False), ("f|re", "a(", "a(", False), ("f|re", "\\bfoo\\b", "a foo b", True), ("f|re", "x", None, False),
    ("f|cidr", "10.0.0.0/8", "10.2.3.4", True), ("f|cidr", "10.0.0.0/8", "11.2.3.4", False), ("f|cidr", "10.0.0.0/8", "host", False), ("f|cidr", "10.0.0.0", "10.0.0.0", False), ("f|cidr", "fd00::/8", "fd00::1", True), ("f|cidr", "fd00::/8", None, False),
    ("f|gt", 5, "6", True), ("f|gt", 5, "5", False), ("f|gte", 5, "5.0", True), ("f|lt", 16, "0xf", True), ("f|lte", "1_000", "999", True), ("f|gt", 5, "six", False), ("f|gt", 5, "", False), ("f|gt", 5, None, False), ("f|neq|gt", 5, None, True), ("f|lt", 0, "-.inf", True), ("f|gt", "x", "9", False),
    ("f|exists", True, "x", True), ("f|exists", True, None, False), ("f|exists", False, None, True), ("f|exists", "nonsense", None, True), ("f|neq|exists", True, None, True),
    ("f|base64", "ping", "cGluZw==", True), ("f|base64offset|contains", "ping", "xxBpbmxx", True), ("f|utf16le|base64offset|contains", "ab", "YQBiA", True), ("f|windash|contains", " -x", "run /x", True), ("f|windash|contains", " -x", "run –x", True),
    ("f|hour", 23, "2024-03-01T23:30:00-05:00", True), ("f|week", 53, "2021-01-03", True), ("f|month|gte", 3, "2024-03-01 10:00:00", True), ("f|day", 1, "March 1", False), ("f|minute|lt", 31, "2024-03-01T23:30:00.5Z", True), ("f|year", 1970, None, False), ("f|neq|year", 1970, "soon", True),
]
MODES = ("typed", "map", "json")


@pytest.fixture(scope="module")
def verdicts(spark):
    """All rows of the table in one pass for each mode."""
    values = sorted({v for *_, v, _ in TABLE if v is not None})
    rows = [(i, v, {"f": v}, json.dumps({"f": v})) for i, v in enumerate(values)] + [(len(values), None, {}, "{}")]
    df = spark.createDataFrame(rows, "id int, f string, m map<string,string>, j string").coalesce(1)
    out = {}
    for mode in MODES:
        options = Options(mode=mode, source={"map": "m", "json": "j"}.get(mode, ""))
        columns = [F.coalesce(match_column(df, leaf(f, v), options), F.lit(False)).alias(f"c{i}") for i, (f, v, *_) in enumerate(TABLE)]
        found = {r["f"]: r for r in df.select("f", *columns).collect()}
        for i, (*_, event, _) in enumerate(TABLE):
            out[mode, i] = found[event][f"c{i}"]
    return out


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("i", range(len(TABLE)), ids=lambda i: f"{TABLE[i][0]}={TABLE[i][1]}~{TABLE[i][2]!r}")
def test_leaf(verdicts, mode, i):
    assert verdicts[mode, i] == TABLE[i][3]


def test_value_modifiers():
    assert literals.base64_offsets(b"ping") == ["cGluZ", "Bpbm", "waW5n"]
    assert literals.base64_offsets(b"ab") == ["YW", "Fi", "hY"]
    assert [len(literals.windash(v)) for v in ("plain", "-a", "/a -b")] == [1, 5, 25]
    assert [len(literals.candidates("x", [m])) for m in ("utf16le", "utf16be", "utf16", "wide", "base64offset")] == [1, 1, 1, 1, 3]
    assert [literals.go_float(x) for x in (1.0, 1e6, 4625.0, 0.5, 1e-5, 123456.5, float("inf"))] == ["1", "1e+06", "4625", "0.5", "1e-05", "123456.5", "+Inf"]
    assert [literals.value_text(x) for x in (None, True, 3, "x")] == ["null", "true", "3", "x"]
    with pytest.raises(literals.BadValue):
        literals.value_text({"a": 1})


def test_placeholders():
    expand = literals.expander_of({"vips": ["a", "b"], "n": 1})
    assert literals.expand_values(["%vips%", "x%vips%y%n%"], expand, True) == ["a", "b", "xay1", "xby1"]
    assert literals.expand_values(["x%vips%", "%", "%%"], expand, False) == ["x%vips%", "%", "%%"]
    with pytest.raises(literals.BadValue):
        literals.expand_values(["%vips%"], None, False)


@pytest.mark.parametrize(("text", "found"), [("a", False), ("a*", True), ("a\\*", False), ("a\\\\*", True), ("?", True), ("\\?", False), ("\\", False), ("a\\b?", True)])
def test_wildcards(text, found):
    assert patterns.has_wildcard(text) == found


@pytest.mark.parametrize("bad", ["a**", "(", ")", "[a", "a{2,1}", "a{1001}", "(?<=a)", "\\1", "\\", "*"])
def test_patterns_that_are_rejected(bad):
    with pytest.raises(patterns.InvalidPattern):
        patterns.re2_to_java(bad)


def test_required_text():
    for pattern, need in (("abc.*defg", "defg"), ("ab+c", "ab"), ("abx?c", "ab"), ("a|b", ""), ("(abc)", ""), ("foo\\.bar", "foo.bar")):
        assert patterns.required_text(pattern) == need


def test_errors_are_told_when_compiled(spark):
    df = spark.createDataFrame([("x",)], "f string")
    for bad in ("f|nope: x", "f|gt|lt: 1", "f|all|contains: x", "f|contains: '%p%'", "f: {a: 1}", "f: 2024-01-01"):
        with pytest.raises(CompileError):
            match_column(df, rule(f"s:\n  {bad}\ncondition: s"))
    bundle = Bundle([rule("s:\n  f|nope: x\ncondition: s", "bad"), rule("s:\n  f: x\ncondition: s", "good")])
    assert [r.rule_id for r in bundle.detect(df).collect()] == ["good"] and list(bundle.skipped_rules) == ["bad"]


def test_conditions_and_results(spark):
    df = spark.createDataFrame([("x", None), ("y", 2)], "a string, b int")
    r = rule("s1:\n  a: x\ns2:\n  b|gt: 1\nother:\n  b: 9\ncondition:\n  - 1 of s* and not other\n  - all of them\n  - all of none*\n  - 1 of missing")
    found = {x.a: x for x in evaluate(df, r).collect()}
    assert found["x"].search_results == {"s1": True, "s2": False, "other": False}
    assert found["x"].condition_results == [True, False, True, False] and found["y"].match
    lazy = evaluate(df, rule("s1:\n  a: x\ns2:\n  b: 1\ncondition: s1"), Options(lazy=True)).collect()
    assert set(lazy[0].search_results) == {"s1"}
    assert evaluate(df, r, Options(lazy=True)).where("match").count() == evaluate(df, r).where("match").count()


def test_bundle_equals_single(spark):
    values = [None, "", "abc", "ABC def", "10", "-3.5", "a*b", "x\ny", "10.0.0.1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, f string")
    tests = [("f", "a*"), ("f|contains", "b"), ("f|re", "^[0-9.]+$"), ("f|gt", 3), ("f|neq", "abc"), ("f|cidr", "10.0.0.0/8"), ("f", None)]
    rules = [rule(f"s:\n  {f}: {json.dumps(v)}\ncondition: {c}", f"{f}={v}/{c}") for f, v in tests for c in ("s", "not s")]
    together = sorted((r.id, r.rule_id) for r in Bundle(rules).detect(df).collect())
    single = sorted((x.id, r.key) for r in rules for x in df.where(F.coalesce(match_column(df, r), F.lit(False))).collect())
    assert together == single and len(together) == len(tests) * len(values)
    assert Bundle(rules).results(df).count() == len(rules) * len(values)


def test_mapped_fields(spark):
    config = parse_config("fieldmappings:\n  F: $.nest.names\n  G: [a, b]\n  H: $.doc.k.v\n  I: []\n  J: $.list[*].n\n")
    df = spark.createDataFrame([((["p", "q"],), "x", None, '{"k": {"v": 7}}', [(1,), (2,)]), (None, None, None, "no json", None)], "nest struct<names:array<string>>, a string, b string, doc string, list array<struct<n:int>>")
    hits = lambda text: [r.doc for r in df.where(F.coalesce(match_column(df, rule(f"s:\n  {text}\ncondition: s"), Options(configs=[config])), F.lit(False))).collect()]
    good, bad = '{"k": {"v": 7}}', "no json"
    assert hits("F: q") == [good] and hits("G: x") == [good] and hits("G: null") == [good, bad] and hits("H|gt: 6") == [good] and hits("H: 7") == [good]
    assert hits("I: null") == [] and hits("J: 2") == [good] and hits("F|exists: false") == [bad]


def test_keywords(spark):
    df = spark.createDataFrame([("An Error", 5, {"k": None}), ("fine", 1000000, {"k": "error x"})], "a string, n int, m map<string,string>")
    hits = lambda words, **o: [r.a for r in df.where(F.coalesce(match_column(df, rule(f"s: {json.dumps(words)}\ncondition: s"), Options(**o)), F.lit(False))).collect()]
    assert hits(["error"]) == ["An Error", "fine"] and hits(["ERR?R"], mode="map", source="m") == ["fine"] and hits(["1000000"]) == ["fine"]
    assert hits(["Error"], case_sensitive=True) == ["An Error"] and hits(["<nil>"], mode="map", source="m") == ["An Error"]


def test_names_that_need_quotes_and_case(spark):
    df = spark.createDataFrame([("x", "y")], ["c-useragent", "c.d"])
    assert df.where(match_column(df, rule("s:\n  c-useragent: X\n  c.d: y\ncondition: s"))).count() == 1
    assert df.where(F.coalesce(match_column(df, rule("s:\n  C-UserAgent: x\ncondition: s")), F.lit(False))).count() == 0


@pytest.mark.parametrize("net", ["2001:db8::/32", "::1/128", "10.0.0.0/8"])
def test_an_address_is_read_once(spark, net):
    df = spark.range(3).select(F.concat_ws(":", F.lit("2001:db8:"), F.col("id").cast("string")).alias("f"))
    found = df.where(match_column(df, leaf("f|cidr", [net])))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Filter", 1)[1].split("\n")[0].count("concat_ws(:") == 1
    assert found.count() == (3 if net == "2001:db8::/32" else 0)


@pytest.mark.parametrize(
    ("text", "net", "inside"),
    [
        ("::1.2.3.4", "::/96", True), ("64:FF9B::192.0.2.33", "64:ff9b::c000:0/112", True), ("1:2:3:4:5:6:1.2.3.4", "1:2::/32", True), ("1:2:3:4:5:6:7:1.2.3.4", "::/0", False), ("1:2:3:4:5:6:7:8:9", "::/0", False), ("1:2:3:4:5:6:7::", "1::/16", True),
        ("1:2:3:4:5:6:7:8::", "::/0", False), ("1::2::3", "::/0", False), ("::ffff:1.2.3.4", "::/0", False), ("::ffff:1.2.3.4", "1.2.3.0/24", True), ("::1\n", "::/0", False), ("12345::", "::/0", False), ("::", "::/8", True), ("", "::/0", False), (":1.2.3.4", "::/0", False), ("01.2.3.4", "0.0.0.0/0", False),
    ],
)
def test_forms_of_addresses(spark, text, net, inside):
    df = spark.createDataFrame([(text,)], "f string")
    assert (df.where(match_column(df, leaf("f|cidr", net))).count() == 1) is inside
