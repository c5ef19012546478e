"""Imports, rules, layouts and complexity on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import imports as I
from graphloom.operators import layout as L
from graphloom.operators import extractors as X
from graphloom.operators import rules as R


def test_statements(spark):
    rows = [
        ("python", "import a.b\nfrom ..c import d\nx = 1"), ("javascript", "import x from './y';\nexport * from '../z';\nimport 'side';"), ("java", "package p;\nimport static a.B.c;\nimport d.E;"),
        ("go", 'package a\nimport (\n\t"fmt"\n\tq "m/x"\n)\n'), ("rust", "use crate::a::b;\npub use std::fmt;"), ("json", "{}"), ("python", None),
    ]
    got = I.statements(spark.createDataFrame(rows, "language string, text string"))
    assert {(r.language, r.module) for r in got.collect()} == {("python", "a.b"), ("python", "..c"), ("javascript", "./y"), ("javascript", "../z"), ("javascript", "side"), ("java", "a.B.c"), ("java", "d.E"), ("go", "fmt"), ("go", "m/x"), ("rust", "crate::a::b"), ("rust", "std::fmt")}


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c", "a/c"), ("./a//b/", "a/b"), ("../x", None), ("a/../../x", None), ("a/b/c/../../d", "a/d")])
def test_normalised(spark, path, want):
    assert spark.range(1).select(I.normalised(F.lit(path))).first()[0] == want


def test_interpretation(spark):
    files = spark.createDataFrame([("r", p) for p in ("pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/b.py", "web/x.ts", "web/lib/index.js", "web/x.js", "a/B.java", "src/m/n.rs", "cmd/tool/t.go", "top.py")], "repo_id string, path string")
    asked = [
        ("pkg/sub/b.py", "python", "..a", "internal"), ("pkg/sub/b.py", "python", "pkg.sub", "internal"), ("pkg/sub/b.py", "python", "os", "external"), ("pkg/sub/b.py", "python", ".zz", "unresolved"), ("top.py", "python", ".pkg.a", "internal"),
        ("web/x.ts", "typescript", "./lib", "internal"), ("web/lib/index.js", "javascript", "../x", "internal_candidates"), ("web/x.ts", "typescript", "react", "external"), ("a/B.java", "java", "a.B", "internal"), ("a/B.java", "java", "java.util.List", "external"),
        ("src/m/n.rs", "rust", "crate::m::n::f", "internal"), ("src/m/n.rs", "rust", "crate::q", "unresolved"), ("cmd/x.go", "go", "example.com/m/cmd/tool", "internal"), ("cmd/x.go", "go", "fmt", "external"),
    ]
    i = spark.createDataFrame([("r", p, lang, m) for p, lang, m, _ in asked], "repo_id string, path string, language string, module string")
    got = {(r.path, r.module): r.decision for r in I.interpreted(i, files).collect()}
    assert got == {(p, m): d for p, _, m, d in asked}


def test_members_and_visibility(spark):
    sites = spark.createDataFrame([(1, "C", "f"), (2, "C", "g"), (3, "C", "h")], "site int, type string, name string")
    bases = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", "C"), ("C", "X")], "child string, parent string")
    members = spark.createDataFrame([("A", "f", "A.f"), ("B", "f", "B.f"), ("B", "g", "B.g"), ("X", "g", "X.g")], "type string, name string, target string")
    assert {tuple(r) for r in I.inherited_members(sites, bases, members).collect()} == {(1, "B.f", 1), (2, "B.g", 1), (2, "X.g", 1)}
    c = spark.createDataFrame([(1, "a", "a"), (1, "a", "b"), (1, "a", "c")], "site int, path string, target_path string")
    assert {r.target_path for r in I.visible(c, spark.createDataFrame([("a", "b")], "path string, place string")).collect()} == {"a", "b"}
    t = I.alias_targets(spark.createDataFrame([(1, "a", "k")], "site int, path string, name string"), spark.createDataFrame([("a", "k", "real", "b")], "path string, alias string, member string, place string"), spark.createDataFrame([("b", "real", "t9")], "path string, name string, target string"))
    assert [tuple(r) for r in t.collect()] == [(1, "t9")]
    al = I.longest_alias(spark.createDataFrame([("@app/x/y",), ("z",)], "module string"), spark.createDataFrame([("@app/", "src/"), ("@app/x/", "lib/")], "prefix string, target string"))
    assert [tuple(r) for r in al.collect()] == [("@app/x/y", "lib/y")]


def test_aliases_are_broadcast_and_modules_are_not(spark):
    modules = spark.range(2000).select(F.format_string("@app/x/%06d", "id").alias("module"))
    al = I.longest_alias(modules, spark.createDataFrame([("@app/", "src/"), ("@app/x/", "lib/")], "prefix string, target string"))
    assert {tuple(r) for r in al.collect()} == {(f"@app/x/{i:06d}", f"lib/{i:06d}") for i in range(2000)}
    plan = al._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString().splitlines()
    for at in (i for i, line in enumerate(plan) if "BroadcastExchange" in line):
        depth = plan[at].index("BroadcastExchange")
        below = plan[at + 1 : next((j for j in range(at + 1, len(plan)) if len(plan[j]) - len(plan[j].lstrip(" :+-")) <= depth - 3), len(plan))]
        assert not any("Generate" in line or "Range" in line for line in below), below
    every = I.longest_alias(spark.createDataFrame([("@app/x",), ("z",), ("",), (None,)], "module string"), spark.createDataFrame([("@app/", "src/"), ("", "base/")], "prefix string, target string"))
    assert {tuple(r) for r in every.collect()} == {("@app/x", "src/x"), ("z", "base/z"), ("", "base/")}


def test_rules(spark):
    arg = lambda *texts: [(None, t) for t in texts]
    rows = [("a.py", "python", "requests.get", arg("'https://h/users/{id}'")), ("b.py", "python", "requests.get", arg("'https://h/x'")), ("a.py", "python", "p.send", arg("'orders'")), ("a.py", "python", "p.send", arg("'${T}'")), ("a.py", "python", "requests.post", []), (None, None, None, None), ("a.py", "python", "get", arg("'/x'"))]
    calls = spark.createDataFrame(rows, "path string, language string, callee string, args array<struct<keyword:string,text:string>>")
    imps = spark.createDataFrame([("a.py", "requests"), ("a.py", "kafka.producer"), ("a.py", None)], "path string, module string")
    assert [tuple(r) for r in R.client_calls(calls, imps).collect()] == [("a.py", "requests", "GET /users/{}")]
    assert [tuple(r) for r in R.messages(calls, imps).collect()] == [("a.py", "kafka-python producer.send", "kafka", "provides", "orders")]
    typed = spark.createDataFrame([("A.java", "java", "t.send", arg('"x"', "v"), "Other")], "path string, language string, callee string, args array<struct<keyword:string,text:string>>, receiver_type string")
    assert R.messages(typed, spark.createDataFrame([("A.java", "org.springframework.kafka.core.KafkaTemplate")], "path string, module string")).count() == 0
    served = spark.createDataFrame([("m.go", "go", "r.GET", arg('"/a/:id"')), ("m.go", "go", "r.GET", arg("name")), ("m.go", "go", "GET", arg('"/b"'))], calls.schema)
    both = spark.createDataFrame([("m.go", "github.com/gin-gonic/gin"), ("m.go", "github.com/labstack/echo/v4")], "path string, module string")
    assert [tuple(r) for r in R.endpoints(served, both.limit(1)).collect()] == [("m.go", "gin", "GET /a/{}")] and R.endpoints(served, both).count() == 0
    assert R.endpoints(calls.limit(0), imps).count() == 0 and R.client_calls(calls, imps.limit(0)).count() == 0
    s = R.service_kind(spark, spark.createDataFrame([("requests.get",), ("a.b",), ("axum::Router",)], "callee string"))
    assert {tuple(r) for r in s.collect()} == {("requests.get", "http"), ("axum::Router", "route_reg")}
    doc = {"servers": [{"url": "https://h"}], "paths": {"/a/{id}": {"get": {}, "parameters": [], "post": {}}}}
    assert list(X.api_operations(json.dumps(doc))) == [("https://h", "GET", "/a/{id}"), ("https://h", "POST", "/a/{id}")]
    assert list(X.api_operations("{")) == [] and list(X.api_operations(None)) == []


def test_squarified():
    boxes = L.squarified([6, 6, 4, 3, 2, 2, 1])
    assert abs(sum(w * h for *_, w, h in boxes) - 1) < 1e-9
    assert all(abs(w * h - s / 24) < 1e-9 for (*_, w, h), s in zip(boxes, [6, 6, 4, 3, 2, 2, 1]))
    assert all(-1e-9 <= x and x + w <= 1 + 1e-9 and y + h <= 1 + 1e-9 for x, y, w, h in boxes)
    assert L.squarified([]) == [] and L.squarified([0, 0]) == [(0.0, 0.0, 0.0, 0.0)] * 2


@pytest.mark.parametrize("most", [800, 7])
def test_treemap_lays_out_every_item(spark, monkeypatch, most):
    monkeypatch.setitem(L.BUDGETS, "file", most)
    rows = [("big", i, 1 + i % 50) for i in range(most + 150)] + [("small", i, s) for i, s in enumerate((6, 3, None, 0, 1))] + [(None, 1, 2)]
    got = L.treemap(spark.createDataFrame(rows, "c string, i long, s int"), "c", "i", "s").collect()
    boxes = {(r.c, r.i): (r.x, r.y, r.w, r.h) for r in got}
    assert len(got) == len(boxes) == len(rows)
    for c in ("big", "small", None):
        mine = [(boxes[c, i], s or 0) for k, i, s in rows if k == c]
        total = sum(s for _, s in mine)
        assert all(abs(w * h - s / total) < 1e-9 and -1e-9 <= x and x + w <= 1 + 1e-9 and -1e-9 <= y and y + h <= 1 + 1e-9 for (x, y, w, h), s in mine)
        solid = [b for b, s in mine if s]
        for k, (x, y, w, h) in enumerate(solid):
            assert not any(x + w - 1e-9 > x2 and x2 + w2 - 1e-9 > x and y + h - 1e-9 > y2 and y2 + h2 - 1e-9 > y for x2, y2, w2, h2 in solid[:k])


def test_complexity(spark):
    # function f: if { while { if } } ; for
    rows = [("f", "r", None, "body"), ("f", "a", "r", "if"), ("f", "b", "a", "while"), ("f", "c", "b", "if"), ("f", "d", "r", "for")]
    got = L.complexity(spark.createDataFrame(rows, "g string, id string, p string, type string"), ["if", "while", "for"], ["while", "for"]).first()
    assert (got.cyclomatic, got.cognitive, got.loop_depth) == (5, 1 + 2 + 3 + 1, 1)


def test_tour_and_components(spark):
    nodes = spark.createDataFrame([("a", True, False), ("b", False, False), ("t", True, True)], "node string, entry boolean, test boolean")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [(r.position, r.node) for r in L.tour(nodes, edges, steps=2).orderBy("position").collect()] == [(1, "a"), (2, "b")]
    files = spark.createDataFrame([("r", "svc/Dockerfile"), ("r", "svc/main.go"), ("r", "lib/package.json"), ("r", "x.txt")], "repo_id string, path string")
    assert {(r.root, r.evidence) for r in L.components(files).collect()} == {("svc", "dockerfile"), ("lib", "library")}
