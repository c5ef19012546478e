"""Line rules, call rules, YAML, configuration, segments and lookups on small and odd cases."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analytics, code_facts, configuration, extractors, imports, resolution, segments, text
from graphloom.operators.yaml_values import documents

SOURCES = "file_id string, language string, text string, line string, kind int"


def test_definitions_and_calls(spark):
    rows = [
        ("a", "python", "class A(B):\n    async def go(self):\n        return self.x.run(1)\n# def no():\n", "x", 1), ("b", "java", "public class C {\n  public C(int a) {\n    if (a > 0) {\n      new D(a).e();\n    }\n  }\n  List<String> all(int n) throws X {\n", "x", 1),
        ("c", "go", "func (r *T) M(a int) string {\ntype S struct {\nfunc F[K any](a K) {\n", "x", 1), ("d", "rust", "pub async fn f() {}\npub(crate) struct S;\ntrait T {}\n", "x", 1), ("e", "typescript", "export default class X {\r\n  get(a) {\r\nexport function f<T>(a: T) {\r\n", "x", 1),
        ("f", None, "def f():", None, None), ("g", "python", None, None, None), ("h", "cobol", "def f():", None, None), ("i", "python", "", None, None),
    ]
    df = spark.createDataFrame(rows, SOURCES)
    got = {(r.file_id, r.line_no, r.kind, r.name) for r in code_facts.definitions(df, "file_id").collect()}
    assert got == {
        ("a", 1, "Class", "A"), ("a", 2, "Function", "go"), ("b", 1, "Class", "C"), ("b", 2, "Constructor", "C"), ("b", 7, "Method", "all"), ("c", 1, "Method", "M"), ("c", 2, "Struct", "S"), ("c", 3, "Function", "F"),
        ("d", 1, "Function", "f"), ("d", 2, "Struct", "S"), ("d", 3, "Trait", "T"), ("e", 1, "Class", "X"), ("e", 2, "Method", "get"), ("e", 3, "Function", "f"),
    }
    calls = {(r.file_id, r.line_no, r.callee) for r in code_facts.calls(df, "file_id").collect()}
    assert {("a", 3, "self.x.run"), ("b", 4, "D"), ("b", 4, "e")} <= calls and not any(c == "if" for _, _, c in calls)
    assert code_facts.definitions(df.limit(0), "file_id").count() == 0


@pytest.mark.parametrize(
    ("said", "value"),
    [
        ("a: 1\nb:\n  - x: 1\n    y: 'z'\n  - [1, {k: v}]\n", [{"a": 1, "b": [{"x": 1, "y": "z"}, [1, {"k": "v"}]]}]), ("- a\n-\n  b: 2\n- - 1\n  - 2\n", [["a", {"b": 2}, [1, 2]]]), ("t: |\n  one\n    two\n\nu: >-\n  a\n  b\n", [{"t": "one\n  two\n", "u": "a b"}]),
        ("# only\n", []), ("", []), (None, []), ("a: 1\n---\nb: true # c\n...\n", [{"a": 1}, {"b": True}]), ("a:\n- 1\n- 2\nb: ~\n", [{"a": [1, 2], "b": None}]), ('"k#": "a # b"\r\n', [{"k#": "a # b"}]), ("a: b\n  c\n", [{"a": "b c"}]), ("f: [1,\n  2]\n", [{"f": [1, 2]}]), ("u: http://h/x#y\n", [{"u": "http://h/x#y"}]),
    ],
)
def test_yaml(said, value):
    assert list(documents(said)) == value


@pytest.mark.parametrize("said", ["a: [1, 2", "a: 'open", "a: 1\n   b: 2\n", "\ta: 1\n", "a: *x\n", "a: &b 1\n", "- a\nb: 1\n", "a: {b: 1\n", "a: b: c\n  d: e\n"])
def test_yaml_refused(said):
    with pytest.raises(ValueError):
        list(documents(said))


def test_flattened_values_never_fail():
    for language in ("yaml", "json", "toml", "xml", "properties", "other", None):
        for said in (None, "", "\x00", "a: [", "{", "<a", "[" * 5000, "﻿a = 1"):
            list(extractors.config_values(language, said))
    assert list(extractors.config_values("xml", "<a b='1'><c>t</c></a>")) == [("a@b", "1"), ("a.c", "t")]
    for f in (extractors.api_operations, extractors.channel_operations, extractors.architecture, extractors.listeners, extractors.compiler_aliases):
        for said in (None, "", "{", "[]", "a: b", "paths: 1", "\x00"):
            list(f(said))


def test_configuration_is_strict():
    assert configuration.load("[server]\nport = 1\n")["server"]["port"] == 1 and configuration.load(None) == {}
    for said in ("[x]", "[server]\nprt = 1", "[server]\nport = true", "x = 1", "[rules]\nforbid = [{from_role = 'a'}]", "[rules]\nforbid = ['a']", "["):
        with pytest.raises(ValueError):
            configuration.load(said)


def test_segments_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    path = f"file://{tmp_path}/seg"
    checksum = segments.write_segment(df, path, ["id"]).first()["checksum"]
    meta = spark.createDataFrame([(k, "v") for k in segments.META_KEYS], "key string, value string")
    assert segments.open_segment(spark, path, "id int, s string", ["id"], checksum, meta).count() == 2
    for broken in ((path, checksum, meta.limit(3)), (path, "0" * 64, meta)):
        with pytest.raises(ValueError):
            segments.open_segment(spark, broken[0], "id int, s string", ["id"], *broken[1:])
    df.union(df).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="duplicate"):
        segments.open_segment(spark, path, "id int, s string", ["id"], checksum, meta)


def test_receivers_and_suppression(spark):
    rows = [("python", "self", "current"), ("python", "super()", "super"), ("go", "self", "other"), ("rust", "Self", "current"), ("java", None, "current"), ("python", "", "bare"), ("php", "$this", "current"), ("csharp", "base", "super"), (None, None, "bare"), (None, "this", "other")]
    df = spark.createDataFrame(rows, "language string, receiver string, want string")
    assert df.filter(resolution.receiver_role(F.col("language"), F.col("receiver")) != F.col("want")).count() == 0


def test_base_types_by_tier(spark):
    types = spark.createDataFrame([("t1", "r", "m", "m.A", "A"), ("t2", "r", "n", "n.A", "A"), ("t3", "r", "n", "n.B", "B"), ("t4", "q", "m", "m.A", "A")], "type string, repo string, module string, qualified_name string, name string")
    bases = spark.createDataFrame([("x", "r", "m", "f", "A"), ("y", "r", "o", "f", "A"), ("z", "r", "o", "g", "A"), ("u", "r", "o", "g", "n.A"), ("v", "r", "o", "g", "B"), ("w", "r", "o", "g", None), ("k", "r", "o", "g", "No")], "child string, repo string, module string, file string, base string")
    seen = spark.createDataFrame([("f", "A", "t2")], "file string, name string, type string")
    got = {r.child: (r.tier, r.target) for r in imports.base_types(bases, types, seen).collect()}
    assert got == {"x": ("module", "t1"), "y": ("import", "t2"), "z": ("repository", None), "u": ("qualified", "t2"), "v": ("repository", "t3")}


def test_fuzzy_names_against_all(spark):
    names = ["loadConfig", "loadConfigs", "readRow", "red", "saveAll", "ab", "x"]
    asked = ["loadConfi", "readRows", "saveal", "sa", None, "loadConfig", "zzz", "rod"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for i, a in enumerate(asked):
        near = sorted((edits(a, n), n) for n in names if a and len(a) > 2 and len(n) > 2 and 1 <= edits(a, n) <= 2)
        if near and sum(d == near[0][0] for d, _ in near) == 1:
            want[i] = (near[0][1], near[0][0])
    sites = spark.createDataFrame(list(enumerate(asked)), "site int, name string")
    got = {r.site: (r.target, r.distance) for r in resolution.fuzzy_fallback(sites, spark.createDataFrame([(n,) for n in names], "name string"), "site", "name").collect()}
    assert got == want and want


def test_fuzzy_fallback_broadcasts_no_names(spark):
    names = lambda n: spark.range(n).select(F.col("id").alias("site"), F.format_string("Name#%012d", "id").alias("name"))
    found = resolution.fuzzy_fallback(names(2000), names(50), "site", "name")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in plan and not sent, sent
    near = resolution.fuzzy_fallback(spark.createDataFrame([(1, "abcdefgh"), (2, "abcd"), (3, "abcdef"), (4, "xbcdey"), (5, "")], "site int, name string"), spark.createDataFrame([("abcdef",), ("",)], "name string"), "site", "name")
    assert {tuple(r) for r in near.collect()} == {(1, "abcdef", 2), (2, "abcdef", 2), (4, "abcdef", 2)}


def test_reachable_modules(spark):
    c = spark.createDataFrame([(1, "f", "a.b"), (2, "f", "a.bc"), (3, "f", "a"), (4, "g", "a.b"), (5, "f", None)], "site int, file string, module string")
    i = spark.createDataFrame([("f", "a.b.c"), ("f", "x")], "file string, module string")
    assert {r.site: r.reachable for r in resolution.reachable(c, i).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_pages_and_stale_cursors(spark):
    df = spark.range(5).toDF("n")
    rows, total, after = analytics.paged(df, [F.col("n")], 2, "v", "q")
    assert [r.n for r in rows.collect()] == [0, 1] and total.first().has_more
    rows, total, after = analytics.paged(df, [F.col("n")], 4, "v", "q", cursor=after)
    assert [r.n for r in rows.collect()] == [2, 3, 4] and not total.first().has_more
    with pytest.raises(ValueError, match="stale"):
        analytics.paged(df, [F.col("n")], 2, "v", "other", cursor=after)


def test_percentile_ranks(spark):
    rows = [(i, (i * 7 % 400) / 3 if i % 9 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, x double")
    key = lambda v: (v is not None, v or 0)
    want = {i: sum(key(y) < key(x) for _, y in rows) / 899 for i, x in rows}
    got = {r.id: r.p for r in analytics.percent_rank(df, "x", "p").collect()}
    assert len(got) == 900 and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert analytics.percent_rank(df.limit(0), "x", "p").count() == 0 and analytics.percent_rank(df.limit(1), "x", "p").first().p == 0


def test_languages(spark):
    f = spark.createDataFrame([("r", "a/x.h", None), ("r", "a/x.cpp", None), ("r", "b/x.h", None), ("r", "run", "#!/usr/bin/env python3"), ("q", "BUILD.py", None), ("r", "odd", "")], "repo_id string, path string, first_line string")
    o = spark.createDataFrame([("q", r"^BUILD", "starlark")], "repo_id string, pattern string, language string")
    assert {r.path: r.language for r in text.languages(f, o).collect()} == {"a/x.h": "cpp", "a/x.cpp": "cpp", "b/x.h": "c", "run": "python", "BUILD.py": "starlark", "odd": None}


def test_scope_chunks():
    body = "procedure Q is\n" + "  a;\n" * 900 + "end Q;\n"
    said = "with A;\n" + body + "\n\nx\n"
    spans = extractors.scope_spans(said, [(2, 903, "Q"), (None, 4, "n"), (5, 5, "one line")])
    assert spans[0] == (0, 8, "") and spans[1][2] == "-- [Q]\n" and all(h == "-- [Q cont.]\n" for _, _, h in spans[2:-1]) and said[spans[-1][0]:spans[-1][1]] == "\n\nx\n"
    assert spans[1][0] == 8 and spans[-2][1] == 8 + len(body) and len(spans) > 5
    assert extractors.scope_spans(None, []) == [] and extractors.scope_spans("", [(1, 2, "x")]) == [(0, 0, "-- [x]\n")]


def test_documents_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/doc.json"
    for said in ("one", "two é\n", ""):
        segments.replace_document(spark, path, said)
        assert (tmp_path / "doc.json").read_text(encoding="utf-8") == said
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["doc.json"]
