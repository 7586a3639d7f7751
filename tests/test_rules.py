"""Rules, conditions, configurations and durations: reading, text forms, errors."""

import pytest

from ruleforge.rules import condition as c
from ruleforge.rules.marshal import marshal_rule
from ruleforge.rules.reader import RuleError, infer_kind, parse_config, parse_rule, split_documents
from ruleforge.rules.timespan import format_timespan, parse_timeframe, parse_timespan
from ruleforge.sources.rules import exclude_rules, load_exclusions, load_rules

A, B, D = c.Name("a"), c.Name("b"), c.Name("d")
RULE = """
title: Invented rule
id: 11111111-2222-3333-4444-555555555555
status: test
level: high
tags: [t.one, t.two]
date: 2024/01/02
logsource:
  product: shop
  service: tills
  vendor: me
detection:
  first:
    path|contains|all: ['\\\\temp\\\\', x]
    path|endswith: .tmp
    path|endswith: .bak
  second:
    - kind: 1
      on: yes
    - kind|gt: 0x10
  words: [alpha, 'be?a']
  timeframe: 5m
  condition:
    - first and not 1 of sec*
    - words | count(path) by kind, host >= 3
"""


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a", A), ("a and b or d", c.Or((c.And((A, B)), D))), ("a or b and d", c.Or((A, c.And((B, D))))), ("not a and b", c.And((c.Not(A), B))), ("not not a", c.Not(c.Not(A))), ("(a or b) and d", c.And((c.Or((A, B)), D))),
        ("1 of them", c.Quantified(False, "them", "them")), ("ALL OF them", c.Quantified(True, "them", "them")), ("1 of a*", c.Quantified(False, "a*", "pattern")), ("all of a", c.Quantified(True, "a", "name")),
    ],
)
def test_conditions(text, tree):
    parsed = c.parse_condition(text)
    assert parsed.search == tree and c.parse_condition(str(parsed)) == parsed


def test_aggregations():
    assert c.parse_condition("a | count() > 2").aggregation == c.Aggregate("count", "", (), ">", 2)
    assert c.parse_condition("a | max(x) by y, z <= 10").aggregation == c.Aggregate("max", "x", ("y", "z"), "<=", 10)
    assert c.parse_condition("a | near b and not d").aggregation == c.Near(c.And((B, c.Not(D))))
    for text in ("a | count() > 2", "a | near b or d", "1 of a* | sum(x) by y = 3"):
        assert str(c.parse_condition(text)) == text


@pytest.mark.parametrize("bad", ["", "a and", "a b", "(a", "1 of", "1  of a", "a | count()", "a | count() > -1", "a | count() by x-y > 1", "a | median(x) > 1", "a OR b", "any of a"])
def test_bad_conditions(bad):
    with pytest.raises(c.ConditionError):
        c.parse_condition(bad)


def test_rule_is_read_at_node_level():
    r = parse_rule(RULE)
    first = r.detection.searches["first"].matchers[0]
    assert [(f.field, f.modifiers, f.values) for f in first] == [("path", ("contains", "all"), ("\\\\temp\\\\", "x")), ("path", ("endswith",), (".tmp",)), ("path", ("endswith",), (".bak",))]
    assert first[0].line == 14 and first[0].column == 5
    second = r.detection.searches["second"].matchers
    assert second[0][1].values == ("yes",) and second[1][0].values == (16,)
    assert r.detection.searches["words"].keywords == ("alpha", "be?a") and r.detection.timeframe == 300_000_000
    assert len(r.detection.conditions) == 2 and r.extra == {"date": "2024/01/02"} and r.logsource.extra == {"vendor": "me"} and r.key == r.id


def strip(rule):
    """Without positions."""
    from dataclasses import replace

    d = rule.detection
    searches = {k: (s.keywords, tuple(tuple((f.field, f.modifiers, f.values) for f in m) for m in s.matchers)) for k, s in d.searches.items()}
    return replace(rule, detection=None), searches, [str(x) for x in d.conditions], d.timeframe


def test_marshal_round_trip():
    for text in (RULE, "title: c\ncorrelation:\n  type: value_count\n  rules: [a, b]\n  group-by: x\n  timespan: 90m\n  aliases:\n    x:\n      a: y\n  condition:\n    gte: 3\n    lt: 9\n    field: f\n  generate: true\n"):
        r = parse_rule(text)
        assert strip(parse_rule(marshal_rule(r))) == strip(r)


@pytest.mark.parametrize("bad", ["[1, 2]", "a: [", "detection:\n  s: text\n  condition: s", "detection:\n  s: []\n  condition: s", "detection:\n  s: [a, {b: c}]\n  condition: s", "detection:\n  s: {a: b}\n  condition: s and", "correlation:\n  type: event_count\n  rules: a\n  timespan: 1w", "correlation:\n  type: event_count\n  rules: a\n  timespan: 1d\n  condition: {above: 3}"])
def test_bad_rules(bad):
    with pytest.raises(RuleError):
        parse_rule(bad)


def test_configuration():
    config = parse_config("title: c\norder: 3\nfieldMappings:\n  A: $.a\n  B: [x, y]\n  C: {p: q}\nlogsources:\n  one:\n    product: shop\n    index: [i1, 'i2-*']\n    conditions:\n      kind: 7\n    rewrite:\n      service: other\nlogsourcemerging: or\ndefaultindex: rest\n")
    assert config.field_mappings == {"A": ("$.a",), "B": ("x", "y"), "C": ()} and config.default_index == "rest" and config.logsource_merging == "or"
    source = config.logsources[0]
    assert source.index == ("i1", "i2-*") and source.rewrite.service == "other" and source.conditions.matchers[0][0].field == "kind"
    with pytest.raises(RuleError):
        parse_config("logsourcemerging: xor")


def test_kind_of_files():
    kinds = {"title: x\ndetection: {}": "rule", "correlation: {}": "rule", "logsources: {}": "config", "title: logsources": "unknown", "- a": "invalid", "a: [": "invalid"}
    assert {k: infer_kind(k) for k in kinds} == kinds


def test_durations():
    assert [parse_timespan(x) for x in ("1s", "2m", "3h", "7d")] == [10**6, 120 * 10**6, 10800 * 10**6, 604800 * 10**6]
    assert parse_timeframe("1h30m") == 5400 * 10**6 and parse_timeframe("-5m30s") == -330 * 10**6 and parse_timeframe("2000000") == 2000
    assert [format_timespan(parse_timespan(x)) for x in ("90s", "24h", "3m")] == ["90s", "1d", "3m"]
    for bad in ("", "0s", "-1s", "1w", "1.5h", "99999999999999d"):
        with pytest.raises(ValueError):
            parse_timespan(bad)


def test_files(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.yml").write_text("title: two\nid: AA\ndetection:\n  s: [x]\n  condition: s\n--- # next\ntitle: three\nid: BB\ndetection:\n  s: [y]\n  condition: s\n")
    (tmp_path / "sub" / "c.yaml").write_text("title: four\ndetection:\n  s: [z]\n  condition: s\n")
    (tmp_path / "a.yml").write_text("title: broken\ndetection: [\n---\ntitle: nothing\n")
    (tmp_path / "skip.txt").write_text("title: no\n")
    rules = load_rules(tmp_path)
    assert [r.title for r in rules] == ["two", "three", "four"]
    (tmp_path / "ids").write_text("# remark\naa # noisy\n\n")
    assert [r.title for r in exclude_rules(rules, load_exclusions(str(tmp_path / "ids")))] == ["three", "four"]
    with pytest.raises(FileNotFoundError):
        load_exclusions(f"{tmp_path / 'ids'},{tmp_path / 'none'}")
    assert split_documents("a\n---\nb\n--- text\nc") == ["a\n", "\nb\n--- text\nc"]
