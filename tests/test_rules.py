"""Rule text to tree, and tree to truth."""

import pytest

from emberlog.plans import condition
from emberlog.plans.compiler import FieldMapping, RuleError, compile_rules, duration, parse_field, usable
from emberlog.plans.ir import EngineConfig, Primitive, Ruleset, complexity

N = {"a", "b", "c", "sel_x", "sel_y"}


def test_precedence():
    assert condition.parse("a or b and not c", N) == ("or", ("name", "a"), ("and", ("name", "b"), ("not", ("name", "c"))))
    assert condition.parse("(a or b) and c", N) == ("and", ("or", ("name", "a"), ("name", "b")), ("name", "c"))


def test_counts():
    assert condition.parse("1 of them", N) == ("any", None)
    assert condition.parse("all of sel_*", N) == ("every", "sel_*")
    assert condition.parse("3 of sel_*", N) == ("count", 3, "sel_*")


@pytest.mark.parametrize("text", ["", "a and", "nope", "2 of them", "1 of a", "not not a", "(a", "a - b", "1 a", "all of"])
def test_bad(text):
    with pytest.raises(condition.ConditionError):
        condition.parse(text, N)


def test_upper_case_operators_and_trailing_text_end_it():
    assert condition.parse("a AND b", N) == ("name", "a")
    assert condition.parse("a b", N) == ("name", "a")


@pytest.mark.parametrize(
    ("spec", "out"),
    [("f", ("f", "equals", ())), ("f|endswith", ("f", "endswith", ())), ("f|contains|base64|cased", ("f", "contains", ("base64_decode", "case_sensitive"))), ("f|re", ("f", "regex", ())), ("f|wide", ("f", "equals", ("wide_decode",))), ("f|contains|all", ("f", "contains", ("all",)))],
)
def test_fields(spec, out):
    assert parse_field(spec) == out


@pytest.mark.parametrize(("text", "s"), [("30m", 1800), ("1h30m", 5400), ("15", 900), ("", 0), ("1.5h", 5400), ("250ms", 0.25)])
def test_durations(text, s):
    assert duration(text) == pytest.approx(s)


def test_days_are_no_duration():
    with pytest.raises(RuleError):
        duration("1d")


def test_yaml_scalars_and_interning():
    r = compile_rules(["detection:\n  a: {x: on, y: 5, z: true, w: [1, a, null]}\n  b: {y: 5}\n  condition: a or b"])
    assert [(p.field, p.values) for p in r.primitives] == [("x", ("on",)), ("y", ("5",)), ("z", ("true",)), ("w", ("1", "a"))]
    assert r.rules[0].selections == {"a": [0, 1, 2, 3], "b": [1]}


@pytest.mark.parametrize("text", ["detection: {a: {x: null}, condition: a}", "detection: {a: {x: {y: 1}}, condition: a}", "detection: {a: {x: 1}}", "detection: {a: {x: 1}, condition: [a]}", "", "correlation: {rules: [a]}"])
def test_compile_errors(text):
    with pytest.raises(RuleError):
        compile_rules([text])
    assert compile_rules([text], skip_bad=True).dropped


def test_gate_and_ids():
    r = compile_rules(["id: 7\nlogsource: {product: windows, service: x}\ndetection: {a: {x: 1}, condition: not a}"]).rules[0]
    assert r.rule_id == 7 and r.condition == "__logsource_gate and (not a)" and len(r.selections["__logsource_gate"]) == 2
    assert [x.rule_id for x in compile_rules(["detection: {a: {x: 1}, condition: a}"] * 2).rules] == [1, 2]


def test_dropped_rules_are_reported():
    rs = compile_rules(["detection: {a: {x: 1}, condition: b}", "detection: {a: {x: []}, condition: a}", "detection: {a: {x: 1}, condition: a}"])
    good, bad = usable(rs)
    assert len(good) == 1 and len(bad) == 2


def test_mapping_clone_config():
    m = FieldMapping()
    m.add("Image", "process.executable")
    rs = compile_rules(["detection: {a: {Image|endswith: x}, condition: a}"], m)
    assert rs.fields() == ["process.executable"]
    c = rs.clone()
    c.intern(Primitive("n"))
    assert len(rs.primitives) == 1 and isinstance(c, Ruleset)
    assert EngineConfig.production().batch_size == 1000 and EngineConfig.development().with_(batch_size=3).batch_size == 3
    assert [complexity(*x) for x in ((3, 2, 1), (5, 2, 1), (9, 2, 1))] == ["Simple", "Medium", "Complex"]


def test_count_ignores_number_unless_asked():
    rule = compile_rules(["detection: {p1: {x: 1, y: 2}, p2: {z: 3}, condition: 2 of p*}"]).rules[0]
    tree = condition.parse(rule.condition, {"p1", "p2"})
    truth = {0: True, 1: False, 2: False}
    assert condition.fold(tree, rule, truth.get, all, any, lambda x: not x)
    assert not condition.fold(tree, rule, truth.get, all, any, lambda x: not x, lambda n, parts: sum(parts) >= n)
