"""Truth tables of the predicates and transforms."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions import transforms as X
from emberlog.functions.fields import JsonEvents
from emberlog.functions.registry import Registry
from emberlog.plans.ir import Primitive

CASES = [
    (P.equals, "Alice", ["bob", "ALICE"], (), True), (P.equals, "Alice", ["ALICE"], ("case_sensitive",), False), (P.equals, "abc", ["a*"], (), False),
    (P.contains, "PowerShell -enc", ["SHELL"], (), True), (P.contains, "abc", ["a", "z"], ("all",), False), (P.contains, "abc", ["a", "c"], ("all",), True), (P.contains, "abc", [""], (), True),
    (P.startswith, "Hello", ["he"], (), True), (P.startswith, "Hello", ["lo"], (), False), (P.endswith, "a.EXE", [".exe"], (), True),
    (P.regex, "id42", [r"\d+"], (), True), (P.regex, "id", [r"\d+"], (), False), (P.regex, "ab", ["(", "a"], (), False), (P.regex, "ab", ["(?=a)", "a"], (), False), (P.regex, "ab", [r"(?P<n>a)"], (), True),
    (P.range_basic, "5", ["1-5"], (), True), (P.range_basic, "1", ["1-5"], (), True), (P.range_basic, "6", ["1-5", "6-7"], (), True), (P.range_basic, "x", ["1-5"], (), False), (P.range_basic, "5d", ["1-5"], (), False), (P.range_basic, "3", ["-1-5"], (), False),
    (P.range_advanced, "5", ["1..5"], (), True), (P.range_advanced, "5", ["1...5"], (), False), (P.range_advanced, "-3", ["-5-0"], (), True), (P.range_advanced, "7.5", [">7"], (), True), (P.range_advanced, "7", ["<=6.9"], (), False), (P.range_advanced, "9007199254740993", ["9007199254740992"], (), False),
    (P.fuzzy_basic, "hello", ["hello"], (), True), (P.fuzzy_basic, "helo", ["hello"], (), True), (P.fuzzy_basic, "helo", ["hello"], ("threshold:0.9",), False), (P.fuzzy_basic, "helo", ["hello"], ("threshold:x",), False), (P.fuzzy_basic, "", [""], (), True), (P.fuzzy_basic, "", ["a"], (), False),
    (P.fuzzy_advanced, "helo", ["hello"], ("fuzzy:0.9",), False), (P.fuzzy_advanced, "helo", ["hello"], ("threshold:7",), True),
    (P.cidr, "10.1.2.3", ["10.0.0.0/8"], (), True), (P.cidr, " 10.0.0.255 ", ["10.0.0.0/24"], (), True), (P.cidr, "10.0.1.0", ["10.0.0.0/24"], (), False), (P.cidr, "x", ["10.0.0.0/8"], (), False), (P.cidr, "10.1.2.3", ["bad", "10.0.0.0/8"], (), False),
    (P.cidr, "2001:db8::1", ["2001:db8::/32"], (), True), (P.cidr, "fe80::1", ["::/0"], (), True), (P.cidr, "fe80::1", ["10.0.0.0/8"], (), False),
    (P.equals, None, ["a"], (), False), (P.contains, None, [""], (), False), (P.regex, None, ["a"], (), False),
]


def test_predicates(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, v string")
    parts = [F.when(F.col("i") == i, P.two_valued(f(F.col("v"), vs, mods))) for i, (f, _, vs, mods, _) in enumerate(CASES)]
    got = {r.i: r.hit for r in df.select("i", F.coalesce(*parts).alias("hit")).collect()}
    wrong = [(CASES[i][0].__name__, *CASES[i][1:]) for i in got if got[i] != CASES[i][4]]
    assert not wrong


def test_transforms(spark):
    s = "héllo wörld"
    z = gzip.compress(b"packed", mtime=0).decode("latin-1")
    cases = [
        ("md5", s, hashlib.md5(s.encode()).hexdigest()), ("sha1", s, hashlib.sha1(s.encode()).hexdigest()), ("sha256", s, hashlib.sha256(s.encode()).hexdigest()),
        ("base64", base64.b64encode(s.encode()).decode(), s), ("base64", "a", None), ("base64", "!!!!", None), ("base64offset_decode", "x" + base64.b64encode(b"hello!").decode(), "hello!"),
        ("hex_decode", "68 65-6c6c 6f", "hello"), ("hex_decode", "6", None), ("hex_encode", "hi", "6869"), ("url_decode", "a+b%20c", "a b c"), ("url_decode", "a%zz%41", "a%zzA"), ("url_encode", "a b~*/", "a%20b~%2A%2F"),
        ("html_decode", "&lt;a&gt;&amp;", "<a>&"), ("wide_decode", "a\0b\0", "ab"), ("reverse", "abc", "cba"), ("trim", " \ta\n", "a"), ("normalize_whitespace", " a \n b ", "a b"), ("remove_whitespace", "a \tb\r\n", "ab"),
        ("normalize_path", "a\\\\b//c", "a/b/c"), ("basename", "C:\\x\\y.exe", "y.exe"), ("basename", "", "."), ("basename", "/a/b//", "b"), ("dirname", "/a/b", "/a"), ("dirname", "/a", "/"), ("dirname", "a", "."),
        ("json_normalize", "{\n\t a:   1}", "{ a: 1}"), ("csv_extract", '"a",b', "a"), ("to_int", " 42 ", "42"), ("to_int", "4.2", None), ("to_float", " 4.2", "4.2"), ("to_float", "4d", None), ("gzip", z, "packed"), ("gzip", "plain", "plain"), ("utf16_decode", s, s), ("lowercase", "AB", "ab"),
    ]
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "i int, v string")
    for i, (name, _, want) in enumerate(cases):
        assert df.where(F.col("i") == i).select(X.apply_chain(F.col("v"), [name])).first()[0] == want, cases[i]
    with pytest.raises(KeyError):
        X.apply_chain(F.col("v"), ["base64_offset_decode"])


def test_json_fields(spark):
    df = spark.createDataFrame([('{"a":{"b":1.0,"c":[1],"d":null},"e":true,"f":"[x","a.b":"flat","s":"t"}',), ("no json",), (None,)], "event string")
    e = JsonEvents()
    cols = {n: e.field(n) for n in ("a.b", "a.c", "a.d", "e", "f", "a", "zz")}
    rows = df.select(*[c.alias(n.replace(".", "_")) for n, c in cols.items()], e.flat("a.b").alias("flat"), F.array_sort(e.all_values()).alias("all")).collect()
    assert rows[0].asDict() == {"a_b": "1.0", "a_c": None, "a_d": None, "e": "true", "f": "[x", "a": None, "zz": None, "flat": "flat", "all": sorted(["1.0", "1", "true", "[x", "flat", "t"])}
    assert rows[1].all == [] and rows[1].e is None


def test_registry(spark):
    seen = []
    r = Registry().register_match("LENGTH", lambda c, v, m: F.length(c) == int(v[0])).hook("pre", lambda c: seen.append(c.selectivity))
    assert spark.range(1).select(r.matcher("length")(F.lit("abc"), ["3"], ())).first()[0]
    with pytest.raises(KeyError):
        r.matcher("none", strict=True)
    prims = [Primitive("a", "contains", ("x", "y")), Primitive("a", "equals", ("x",)), Primitive("b", "regex", ("x.*",))]
    rep = r.filters(prims)
    assert rep.ordered() == ["x", "y"] and rep.summary()["most_frequent_field"] == "a" and rep.at_most(0.1) == ["x"]
    r.run_hooks("pre", prims[0])
    assert seen == [0.3]
