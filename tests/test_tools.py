"""Storage, extraction, search, vectors, readers, streaming and the facade."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.api import Estate
from graphloom.operators import analytics as A
from graphloom.operators import extractors as X
from graphloom.operators import intervals, search, segments, vectors
from graphloom.operators import text as T
from graphloom.sources import readers
from graphloom.streaming import jobs


def test_segment_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "id int, s string, x double")
    path = f"file://{tmp_path}/seg"
    one = segments.write_segment(df, path, ["id"]).first()
    assert one.rows == 2 and one == segments.content_hash(df.repartition(3)).first()
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        segments.write_segment(df, path, ["id"])
    with pytest.raises(ValueError, match="duplicate"):
        segments.write_segment(df.union(df), path + "2", ["id"])
    meta = spark.createDataFrame([(k, "v") for k in segments.META_KEYS[1:]] + [("odd", "v"), (segments.META_KEYS[1], "v")], "key string, value string")
    assert {(r.defect, r.key) for r in segments.meta_defects(meta).collect()} == {("missing", segments.META_KEYS[0]), ("unknown", "odd"), ("repeated", segments.META_KEYS[1])}


def test_manifest_retention_cache(spark):
    prev = spark.createDataFrame([("a", 1), ("b", 1)], "repo_id string, segment int")
    new = spark.createDataFrame([("b", 2)], "repo_id string, segment int")
    assert sorted(map(tuple, segments.publish_manifest(prev, new).collect())) == [("a", 1), ("b", 2)]
    now = dt.datetime(2024, 3, 1)
    v = spark.createDataFrame([(i, now - dt.timedelta(days=60 - i)) for i in range(60)], "version int, created_at timestamp")
    kept = {r.version for r in segments.retained(v, F.lit(now)).collect()}
    assert kept == set(range(30, 60))
    hits, misses = segments.cached(prev, new.select("repo_id", F.lit("x").alias("facts")), ["repo_id"])
    assert [r.repo_id for r in hits.collect()] == ["b"] and [r.repo_id for r in misses.collect()] == ["a"]
    up = segments.upsert(prev, new, ["repo_id"], update=False)
    assert sorted(map(tuple, up.collect())) == [("a", 1), ("b", 1)]


def test_chunks():
    assert X.chunk_spans(None) == [] and X.chunk_spans("") == [(0, 0)] and X.chunk_spans("x" * 800) == [(0, 800)]
    text = "".join(f"line {i}\n" for i in range(400))
    spans = X.chunk_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, _) in zip(spans, spans[1:]):
        assert a < c <= b and text[b - 1] == "\n"
    assert X.chunk_spans("x" * 2000) == [(0, 800), (600, 1400), (1200, 2000), (1800, 2000)]


def test_mask_keeps_length_and_is_idempotent():
    text = "url = postgres://u:s3cret@h/db\r\nauth: Bearer abcdefgh12345678\npassword = \"hunter22\"\n-----BEGIN PRIVATE KEY-----\nAAAA\nBBBB\n-----END PRIVATE KEY-----\n"
    out, n = X.mask(text)
    assert len(out) == len(text) and out.count("\n") == text.count("\n") and n >= 4
    for secret in ("s3cret", "abcdefgh12345678", "hunter22", "AAAA"):
        assert secret not in out
    assert "postgres://u:" in out and X.mask(out)[0] == out
    assert X.mask(None) == (None, 0) and X.mask("") == ("", 0)


def test_extractors():
    assert list(X.routes('@app.get("/a/{id}")\n// app.post("/no")\napp.post("/b", f)\n@GetMapping("/c")\nmux.HandleFunc("GET /d", h)\n#[put("/e")]')) == [
        (1, "GET", "/a/{id}"), (3, "POST", "/b"), (4, "GET", "/c"), (5, "GET", "/d"), (6, "PUT", "/e")]
    assert list(X.tables_defined('CREATE TABLE IF NOT EXISTS "Shop".Users (id INT PRIMARY KEY, price DECIMAL(10, 2), PRIMARY KEY (id)); CREATE TEMP TABLE t (x INT);')) == [("shop.users", "id", "int"), ("shop.users", "price", "decimal(10,")]
    assert set(X.tables_accessed("WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN public.b ON 1=1; DELETE FROM d; INSERT INTO e SELECT 'from f'; UPDATE g SET x = 1")) == {("a", "read"), ("b", "read"), ("d", "write"), ("e", "write"), ("g", "write")}
    assert list(X.proto_symbols("package a.b; message M {} service S { rpc Get (stream M) returns (M); }")) == [("message", "a.b.M", None, None), ("service", "a.b.S", None, None), ("rpc", "a.b.S/Get", "M", "M")]
    assert list(X.headings("# A\n```\n# no\n```\n## B ##")) == [(1, 1, "A"), (5, 2, "B")]
    assert dict(X.config_values("json", '{"a": {"b": [1, true, null]}}')) == {"a.b[0]": "1", "a.b[1]": "true", "a.b[2]": ""}
    assert dict(X.config_values("properties", "# c\na.b = 1\nc: x \\\n  y")) == {"a.b": "1", "c": "x y"}
    assert list(X.config_values("json", "{")) == [] and list(X.config_values("toml", None)) == []
    assert list(X.env_keys('x = os.environ["A"]\nprocess.env.B || c')) == [(1, "A"), (2, "B")]
    assert list(X.manifest("x/package.json", json.dumps({"name": "@s/n", "version": "1", "dependencies": {"l": "^2"}}))) == [("npm", "@s", "n", "1", True), ("npm", "", "l", "^2", False)]
    assert list(X.manifest("go.mod", "module m/x\nrequire a.b/c v1.2.0\n")) == [("go", "", "m/x", None, True), ("go", "", "a.b/c", "v1.2.0", False)]
    assert list(X.manifest("package.json", "nope")) == [] and list(X.manifest(None, None)) == []
    assert X.normalised_parameters(["List<Map<String, Integer>>", "list[int]", None, "int[]"]) == "List,list,?,int[]"
    assert X.parse_annotation('@Route("/a", method = "GET", n = 3)') == ("Route", {"0": "/a", "method": "GET", "n": "3"})


def test_bm25_and_grep_on_odd_texts(spark):
    df = spark.createDataFrame([(1, "Alpha beta beta"), (2, ""), (3, None), (4, "gamma\nALPHA x\ny\nz")], "id int, t string")
    got = {r.id: r.score for r in search.bm25(df, "id", "t", ["alpha", "Beta"]).collect()}
    assert set(got) == {1, 4} and got[1] > got[4]
    assert [(r.id, r.line_no) for r in T.grep(df, "id", "t", "alpha").orderBy("id").collect()] == [(1, 1), (4, 2)]
    assert sorted((r.id, r.line_no) for r in T.grep_context(df, "id", "t", "alpha", 1).collect()) == [(1, 1), (4, 1), (4, 2), (4, 3)]
    assert search.bm25(df.limit(0), "id", "t", ["a"]).count() == 0


def test_similar_classes_against_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(60)] for _ in range(6)]
    texts = []
    for i in range(40):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = "zz"
        texts.append((i, " ".join(w)))
    texts += [(100, None), (101, ""), (102, "one two"), (103, texts[0][1]), (103, texts[0][1])]
    members, links = search.similar_classes(spark.createDataFrame(texts, "id int, t string"), "id", "t", threshold=0.8)
    sets = {i: {" ".join(t.split()[k:k + 5]) for k in range(len((t or "").split()) - 4)} for i, t in texts}
    rep = {}
    for i, t in texts:
        rep[t or ""] = min(rep.get(t or "", i), i)
    assert {(r.id, r.class_id) for r in members.collect()} == {(i, rep[t or ""]) for i, t in texts}
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in links.collect()} == want


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    q = df.filter("id % 20 = 0")
    for block in (4096, 4):
        got = vectors.top_k_exact(df, "id", "v", q, 3, block=block).collect()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i in range(0, 300, 20):
            s = u @ u[i]
            s[i] = -9
            assert {r.neighbour for r in got if r.query == i} == set(np.argsort(-s)[:3].tolist())
    exact = vectors.top_k_exact(df, "id", "v", q, 3)
    found = vectors.top_k_cells(df, "id", "v", q, 3, centres=vectors.fit_cells(df, "v", 8), probes=6)
    assert vectors.recall(found, exact).first().recall >= 0.9


def test_intervals(spark):
    import random

    rng = random.Random(9)
    a = [(i, s := rng.randrange(200), s + rng.randrange(0, 60)) for i in range(50)]
    df = spark.createDataFrame(a, "i int, s int, e int").withColumn("k", F.lit(1))
    other = df.withColumnsRenamed({"i": "j", "s": "s2", "e": "e2"})
    got = sorted((r.i, r.j) for r in intervals.overlap_join(df, other, ["k"], ("s", "e"), ("s2", "e2"), 7).collect())
    assert got == sorted((i, j) for i, s, e in a for j, s2, e2 in a if s < e and s2 < e2 and s < e2 and s2 < e)


def test_percent_rank_and_pages(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, 9)], "id int, v int")
    assert {r.id: round(r.p, 6) for r in A.percent_rank(df, "v", "p").collect()} == {1: 0.0, 2: 0.0, 3: round(2 / 3, 6), 4: 1.0}
    rows, meta = A.page(df, [F.col("id")], 2, 1)
    assert [r.id for r in rows.collect()] == [2, 3] and tuple(meta.first()) == (4, True)


def test_readers(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("x = 1\n")
    (root / "src" / "__init__.py").write_text("")
    (root / ".env").write_text("A=1")
    (root / "b.bin.go").write_bytes(b"\x00\x01")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("1")
    got = {r.path: (r.outcome, r.content) for r in readers.directory(spark, str(root)).collect()}
    assert got == {"src/a.py": ("candidate", "x = 1\n"), ".env": ("redacted", None), "b.bin.go": ("binary", None), "src/__init__.py": ("candidate", "")}
    log = spark.createDataFrame([("c1\tann\t100\n1\t2\ta.py\n-\t-\tb.bin",), ("c2\tbob\t200",)], "value string")
    assert [(r.commit, r.path, r.added) for r in readers.numstat(log).orderBy("path").collect()] == [("c1", "a.py", 1), ("c1", "b.bin", None)]
    doc = tmp_path / "g.json"
    doc.write_text(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}], "layers": [{"id": "l1", "nodeIds": ["a"]}, {"id": "l2", "nodeIds": ["a", "b"]}]}))
    nodes, edges, layers = readers.graph_document(spark, str(doc))
    assert nodes.count() == 2 and edges.count() == 1 and {(r.node_id, r.layer_id) for r in layers.collect()} == {("a", "l1"), ("b", "l2")}
    span = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "x"}}]}, "scopeSpans": [{"spans": [{"traceId": "t", "startTimeUnixNano": "1000000", "attributes": [{"key": "peer.service", "value": {"stringValue": "y"}}]}, {"traceId": "u", "startTimeUnixNano": "1", "attributes": []}]}]}]}
    assert [(r.service, r.peer) for r in readers.spans(spark.createDataFrame([(json.dumps(span),)], "value string")).collect()] == [("x", "y")]


def test_streams_equal_their_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i % 3000), i % 5, "error" if i % 3 == 0 else "view") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    df.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    stream = lambda: jobs.stream_of(spark, str(tmp_path), "events")
    feed = jobs.Feed(spark, str(tmp_path), "events")
    daily = {r.day: r.calls for r in jobs.run_available(jobs.daily_usage(feed.rows), "t", feed).collect()}
    assert daily == {r.d: r.n for r in df.groupBy(F.to_date("ts").cast("string").alias("d")).agg(F.count("*").alias("n")).collect()}
    feed = []
    paths = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], "path string, digest string, seen_at int")
    paths.coalesce(1).write.parquet(f"{tmp_path}/feed.parquet")
    jobs.change_feed(spark.readStream.schema(paths.schema).parquet(f"{tmp_path}/feed.parquet"), lambda b, n: feed.extend(map(tuple, b.collect())), f"{tmp_path}/cp")
    assert sorted(feed) == [("a", "2"), ("b", "1")]


def test_facade(spark):
    nodes = spark.createDataFrame([("r", "n1", "Function", "load_config", "a.load_config", "Reads it", None, "f", 1, 2), ("r", "n2", "Function", "main", "a.main", None, "n1", "f", 3, 4), ("z", "n3", "Function", "x", "x", None, None, "g", 1, 1)], "repo_id string, node_id string, kind string, name string, qualified_name string, doc string, parent_id string, file_id string, start_line int, end_line int")
    edges = spark.createDataFrame([("r", "n2", "n1", "CALLS", "exact"), ("r", "n1", "n2", "CALLS", "candidate"), ("z", "n3", "n1", "CALLS", "exact")], "repo_id string, src string, dst string, kind string, band string")
    files = spark.createDataFrame([("r", "f", "b", "a.py", "python", "parsed"), ("z", "g", "c", "x.py", "python", "failed")], "repo_id string, file_id string, blob_sha string, path string, language string, status string")
    texts = spark.createDataFrame([("f", "b", "l1\nl2\nl3\nl4\nl5")], "file_id string, blob_sha string, text string")
    e = Estate(nodes, edges, files, texts, candidates=spark.createDataFrame([("r", "n1")], "repo_id string, src string"), permitted=["r"])
    assert [r.node for r in e.callers("n1").collect()] == ["n2"] and e.callees("n1").count() == 0
    assert e.callees("n1", bands=["candidate"]).count() == 1
    assert e.search("config").first().node_id == "n1"
    assert [r.node_id for r in e.symbol("n2").collect()] == ["n2", "n1"]
    assert e.snippet("n2", 1).first().code == "l2\nl3\nl4\nl5"
    assert e.references("x").first().provider == "provider_unavailable"
    assert e.definition("main").first().provider == "name_search"
    assert {(r.measure, r.n) for r in e.blast_radius(["n1"]).collect()} == {("symbols", 2), ("level:file", 1), ("band:exact", 1), ("unresolved_touched", 1)}
    assert e.diff_impact(spark.createDataFrame([("f", 2, 2)], "file_id string, start int, end int")).count() == 2
    assert e.manifest().count() == 1 and e.coverage().first().parsed == 1
    assert e.lines("f", 1, 2).count() == 1
    both = texts.union(spark.createDataFrame([("g", "c", "secret")], texts.schema))
    across = edges.union(spark.createDataFrame([("r", "n1", "n3", "CALLS", "exact")], edges.schema))
    denied = Estate(nodes, across, files, both, candidates=spark.createDataFrame([("r", "n1", "n3")], "repo_id string, src string, dst string"), permitted=["r"])
    assert denied.lines("g", 1, 2).count() == 0 and denied.lines("f", 1, 2).count() == 1
    assert denied.callees("n1").count() == 0 and denied.open_candidates("n1").count() == 0
    assert [tuple(r) for r in e.feedback(spark.createDataFrame([("n2", "n1", "correct")], "edge_src string, edge_dst string, verdict string")).collect()] == [("exact", "correct", 1)]
    assert e.trace("n2", "n1").first().path == ["n2", "n1"]
