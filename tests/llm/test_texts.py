"""Leaks, shared spans, mixing, provenance and pairs against brute force and on odd rows."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import leaks as L
from graphloom.llm import mixing as M
from graphloom.llm import pairs as P
from graphloom.llm import provenance as V
from graphloom.llm import queries as Q
from graphloom.llm import spans as X

# ---- leaks


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_fm_index(values):
    seq = np.array(values, dtype=np.int32)
    assert list(L.suffix_order(seq)) == sorted(range(len(seq)), key=lambda i: tuple(seq[i:]))
    index = L.FMIndex(seq, 4)
    phrases = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    found, lo, hi = index.search(phrases)
    got = {int(f): sorted(index.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, lo, hi)}
    want = defaultdict(list)
    for i in range(len(values) - 2):
        want[values[i] * 16 + values[i + 1] * 4 + values[i + 2]].append(i)
    assert got == dict(want)


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(3))
    items = [(i, "s", " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(30)] + [(90, "s", None), (91, "s", "")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(40))]
        if i % 3 == 0:
            w[5:5] = (items[rng.randrange(30)][2] or "").upper().split()
        docs.append((i, ", ".join(w), "x", 1))
    docs += [(0, docs[0][1], "x", 1), (200, None, None, 1), (201, "", "x", 1), (None, docs[0][1], "x", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, first_word int").select("doc_id", "text")
    h = spark.createDataFrame(items, "item_id long, suite string, text string")
    want = set()
    for i, _, t in items:
        a = L.words_of(t)
        for j, x, *_ in docs:
            b = L.words_of(x)
            if j is not None and any(a[k:k + 4] == b[m:m + 4] for k in range(len(a) - 3) for m in range(len(b) - 3)):
                want.add((i, j))
    for shard_words, block in ((1_000_000, 8_000_000), (100, 8_000_000), (100, 40)):
        found = L.leaks(d, h, length=4, shard_words=shard_words, block_chars=block)
        assert {(r.item_id, r.doc_id) for r in found.collect()} == want
    assert L.leaks(d.limit(0), h, length=4).count() == 0 and L.leaks(d, h.limit(0), length=4).count() == 0
    spans = L.removal_spans(L.leaks(d, h, length=4)).collect()
    by_doc = defaultdict(list)
    for r in spans:
        by_doc[r.doc_id].append((r.first_word, r.last_word))
    assert set(by_doc) == {j for _, j in want}
    for v in by_doc.values():
        v.sort()
        assert all(b < c - 1 for (_, b), (c, _) in zip(v, v[1:]))


def test_words_are_ascii_runs():
    assert L.words_of("Ab-c1 éK\u212a&amp;") == ["ab", "c1", "k", "amp"]


# ---- shared spans


def brute_pairs(texts, n):
    at = defaultdict(set)
    for i, t in texts:
        for k in range(len(t or "") - n + 1):
            at[t[k:k + n]].add(i)
    return {(a, b) for v in at.values() for a in v for b in v if a < b}


def brute_share(texts, n):
    at = defaultdict(set)
    for i, t in texts:
        for k in range(len(t or "") - n + 1):
            at[t[k:k + n]].add(i)
    out = {}
    for i, t in texts:
        cover = set()
        for k in range(len(t or "") - n + 1):
            if len(at[t[k:k + n]]) > 1:
                cover |= set(range(k, k + n))
        out[i] = len(cover)
    return out


def brute_stretches(texts, n):
    at = defaultdict(set)
    for i, t in texts:
        for k in range(len(t or "") - n + 1):
            at[t[k:k + n]].add(i)
    out = set()
    for i, t in texts:
        lo = hi = None
        for k in range(len(t or "") - n + 1):
            if len(at[t[k:k + n]]) > 1:
                if hi is None or k > hi:
                    out |= {(i, lo, hi - lo)} if hi else set()
                    lo = k
                hi = k + n
        out |= {(i, lo, hi - lo)} if hi else set()
    return out


@pytest.mark.parametrize("group_rows", [4000, 10, 1])
def test_spans_against_brute_force(spark, group_rows):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abé😀 \n") for _ in range(60)) for _ in range(4)] + ["-" * 70]
    texts = []
    for i in range(40):
        t = "".join(rng.choice("abcd") for _ in range(rng.randrange(60)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(25)
            t += p[a:a + rng.randrange(20, 60)] + rng.choice("xyz")
        texts.append((i, t))
    texts += [(i, "".join(rng.choice("abcd") for _ in range(rng.randrange(20))) + pool[0][:34] + rng.choice("xyz")) for i in range(70, 90)]
    texts += [(50, texts[3][1]), (51, texts[3][1]), (60, None), (61, ""), (62, "short")]
    df = spark.createDataFrame([*texts, texts[0]], "doc_id long, text string")
    kw = dict(length=30, gram=12, group_rows=group_rows)
    got = X.sharing_pairs(df, **kw).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_pairs(texts, 30)
    assert {r.doc_id: r.shared_chars for r in X.shared_parts(df, **kw).collect()} == brute_share(texts, 30)
    assert {tuple(r) for r in X.shared_stretches(df, **kw).collect()} == brute_stretches(texts, 30)


def test_spans_on_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert X.sharing_pairs(df).count() == 0 and X.shared_parts(df).count() == 0 and X.shared_stretches(df).count() == 0


def test_anchors_cover_every_stretch():
    rng = np.random.default_rng(1)
    codes = rng.integers(97, 99, 3000).astype(np.uint32)
    at, _ = X.anchors(codes, np.zeros(3000, dtype=np.int32), 50, 20, X._powers(4000))
    at = set(at.tolist())
    assert all(any(p in at for p in range(i, i + 31)) for i in range(3000 - 49))
    twice = np.concatenate((codes[100:260], codes[100:260]))
    own = np.repeat([0, 1], 160).astype(np.int32)
    again, h = X.anchors(twice, own, 50, 20, X._powers(4000))
    assert sorted(p for p in again.tolist() if p < 160) == sorted(p - 160 for p in again.tolist() if p >= 160)


# ---- mixing


def test_mixture(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma"]
    docs = [(i, rng.choice([" A ", "a", "B", "c", None, "other"]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), 1) for i in range(400)]
    docs += [docs[0], (900, "a", None, 1), (901, "a", "", 1), (None, "a", "x", 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens int")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, None), ("C", 0.2, 2), ("void", 0.4, 1), ("zero", 0.0, 1), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    chosen = M.mixture(d, t, budget=M.UNTIL_DRY).collect()
    tok = M.tokenizer(M.TOKENIZER)
    sized = {}
    for i, s, x, _ in docs:
        s = (s or "").strip().lower()
        if i is not None and x and s in "abc" and s:
            sized[i] = (s, len(tok.encode_ordinary(x)))
    sums = defaultdict(int)
    for s, n in sized.values():
        sums[s] += n
    weight, repeats = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 3, "b": 1, "c": 2}
    budget = int(min(sums[s] * repeats[s] / weight[s] for s in weight) * sum(weight.values()))
    total = sum(r.tokens for r in chosen)
    assert budget - 60 <= total <= budget
    for r in chosen:
        assert sized[r.doc_id] == (r.source, r.tokens) and r.copy < repeats[r.source]
    assert len({(r.doc_id, r.copy) for r in chosen}) == len(chosen)
    got = {r.source: r for r in M.shares(spark.createDataFrame(chosen), t).collect()}
    for s, w in weight.items():
        assert abs(got[s].share - w) < 0.03
    assert got["void"].records == 0 and got["zero"].target_share == 0
    # The queue by the plain definition: cumulative tokens over weight, sorted.
    order = sorted(chosen, key=lambda r: r.total)
    assert all(a.finish <= b.finish for a, b in zip(order, order[1:])) and order[-1].total == total
    run = defaultdict(int)
    for r in order:
        run[r.source] += r.tokens
        assert abs(r.finish - run[r.source] / weight[r.source]) < 1e-6
    assert M.mixture(d.limit(0), t).count() == 0 and M.mixture(d, t.limit(0)).count() == 0
    again = M.mixture(d.repartition(7), t, budget=M.UNTIL_DRY).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in chosen}
    everything = M.mixture(d, t, budget=10**9)
    assert everything.agg({"tokens": "sum"}).first()[0] == sum(sums[s] * repeats[s] for s in sums)
    # Every budget takes the longest beginning of the one queue that fits.
    queue = sorted(everything.collect(), key=lambda r: r.total)
    for budget in (0, 1, 57, 900, 1500, sum(sums.values())):
        want = {(r.doc_id, r.copy) for r in queue if r.total <= budget}
        assert {(r.doc_id, r.copy) for r in M.mixture(d, t, budget=budget).collect()} == want
    assert {(r.doc_id, r.copy) for r in M.mixture(d, t).collect()} == want


def test_running_totals_of_many_buckets(spark):
    rows = [(i % 3, i * 7 % 5000, i, i % 11) for i in range(9000)]
    df = spark.createDataFrame(rows, "g int, bucket long, id int, n int")
    run, want = defaultdict(int), {}
    for g, bucket, i, n in sorted(rows):
        run[g] += n
        want[i] = run[g]
    assert {r.id: r.total for r in M.running_totals(df, ["g"], "bucket", ["id"], "n", "total").collect()} == want


def test_registered_mixture_is_not_cut_at_the_driest_source(spark, tmp_path):
    docs = [(i, "big" if i < 300 else "mid" if i < 399 else "tiny", "some words here") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 1), ("tiny", 0.2, 2)], "source string, weight double, max_repeats int").write.parquet(str(tmp_path / "mix_target.parquet"))
    chosen = Q.p9_mixture(spark, str(tmp_path)).collect()
    each = chosen[0].tokens
    assert len(chosen) == 400 and sum(r.tokens for r in chosen) == 400 * each
    assert sorted(r.copy for r in chosen if r.source == "tiny") == [0, 1]
    got = {r.source: (r.records, r.most_copies, r.share, r.target_share, r.short_share) for r in Q.p9_shares(spark, str(tmp_path)).collect()}
    assert got == {"big": (299, 1, 0.7475, 0.5, 0.0), "mid": (99, 1, 0.2475, 0.3, 0.0525), "tiny": (2, 2, 0.005, 0.2, 0.195)}


# ---- provenance

CODE = "\n".join(f"def handle_{i}(value):\n    total_{i} = compute_{i}(value, {i})\n    return total_{i}" for i in range(12)) + "\n"


@pytest.mark.parametrize(
    ("path", "language", "text", "reason"),
    [
        ("a.py", "python", CODE, None), ("a.py", "python", "# Copyright 2024 us. All rights reserved.\n" + CODE, None), ("a.py", "python", "# Code generated by x. DO NOT EDIT.\n" + CODE, "generated"),
        ("a.py", "python", 'import x\nBANNER = "Code generated by x. DO NOT EDIT."\n' + CODE, None), ("a_pb2.py", "python", CODE, "generated"), ("src/generated/a.py", "python", CODE, "generated"), ("generated_keys/a.py", "python", CODE, None),
        ("third_party/lib/a.py", "python", CODE, "vendored"), ("external_calls/a.py", "python", CODE, None), ("a.py", "python", "# somelib 1.2.3, a library\n# Copyright 2015 the somelib authors\n" + CODE, "vendored"),
        ("a.js", "javascript", "var a=1;function b(c){return c+1};" * 40, "minified"), ("a.js", "javascript", 'const long = "' + "words and more " * 60 + '";\n' + "function go(x) {\n  return x;\n}\n" * 40, None),
        ("a.go", "go", "package a\n\nvar D = []byte{\n" + "\t0x1f, 0x2b, 0x3c, 0x4d,\n" * 60 + "}\n", "data"), ("a.json", "json", '{"a": [1, 2, 3]}' * 50, None), ("a.py", None, "", None), (None, "python", None, None),
    ],
)
def test_own_reasons(path, language, text, reason):
    assert V.own_reason(path, language, text) == reason


def test_vendored_copies(spark):
    lib = "\n".join(f"export function thing{i}(a) {{ return wrap{i * 7}(a, {i}); }}" for i in range(20))
    edited = lib.replace("thing3", "renamed3") + "\n// local change to the file here\nlet added = computeAll(1, 2);\n"
    own = "\n".join(f"const mine{i} = build{i}(config, {i * 3});" for i in range(20))
    shared = "\n".join(f"const both{i} = create{i}(options, {i * 5});" for i in range(20))
    common = "\nif (value === null) { return null; }\n"
    rows = [("r1", "a", "1", "src/a.js", "javascript", lib.replace("\n", "\r\n"), "x"), ("r1", "b", "1", "src/b.js", "javascript", edited, "x"), ("r2", "c", "1", "src/c.js", "javascript", own + common, "x"), ("r2", "d", "1", "src/d.js", "javascript", own + common, "x")]
    rows += [("r3", "e", "1", "lib/e.js", "javascript", shared, "x"), ("r4", "f", "1", "app/f.js", "javascript", shared + common, "x"), ("r4", "g", "1", "app/g.js", "javascript", None, "x"), ("r4", "h", "1", None, None, "", "x"), ("r1", "a", "1", "src/a.js", "javascript", lib, "x")]
    for i in range(12):
        rows.append((f"q{i}", f"z{i}", "1", "src/z.js", "javascript", "\n".join(f"const z{i}_{k} = own{i}_{k}(x);" for k in range(8)) + common, "x"))
    s = spark.createDataFrame(rows, "repo_id string, file_id string, blob_sha string, path string, language string, text string, reason string")
    u = spark.createDataFrame([("p", "1", "thing.js", "javascript", "k", lib), ("p", "1", "n.js", None, None, None)], "pkg_name string, pkg_version string, file_name string, language string, blob_sha string, text string")
    got = {(r.repo_id, r.file_id): r.reason for r in V.judged(s, u).collect()}
    assert got == {("r1", "a"): "vendored", ("r1", "b"): "vendored", ("r3", "e"): "vendored", ("r4", "f"): "vendored"}
    assert V.judged(s.limit(0), u).count() == 0
    assert {(r.repo_id, r.file_id) for r in V.judged(s, u.limit(0)).collect()} == {("r3", "e"), ("r4", "f")}


def test_copies_whose_lines_also_stand_elsewhere(spark):
    lib = [f"export function thing{i}(a) {{ return wrap{i * 7}(a, {i}); }}" for i in range(20)]
    parts = [lib[k::3] + [f"const own{k}_{i} = made{k}(config, {i * 3});" for i in range(30)] for k in range(3)]
    rows = [(r, f, "1", "src/x.js", "javascript", "\n".join(t)) for r, f, t in [("a", "p0", parts[0]), ("a", "p1", parts[1]), ("a", "p2", parts[2]), ("a", "q", lib), ("b", "copy", lib + ["let changed = here(1, 2);"])]]
    rows += [(f"z{i}", f"z{i}", "1", "src/z.js", "javascript", "\n".join(f"const z{i}_{k} = own{i}_{k}(x);" for k in range(8))) for i in range(9)]
    s = spark.createDataFrame(rows, "repo_id string, file_id string, blob_sha string, path string, language string, text string")
    u = spark.createDataFrame([], "pkg_name string, file_name string, text string")
    assert {r.file_id: round(r.containment, 3) for r in V.judged(s, u).collect()} == {"q": 1.0, "copy": round(20 / 21, 3)}


LICENCE = "".join(f"# Paragraph {i} of a long licence that a tool or a package puts before all else, word after word.\n" for i in range(90))


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (LICENCE + "# Code generated by x. DO NOT EDIT.\n" + CODE, "generated"), ("/*\n" + "a line\n" * 70 + "*/\n// somelib 1.2.3\n// Copyright 2015 the somelib authors\n" + CODE, "vendored"),
        (LICENCE + CODE + "# Code generated by x. DO NOT EDIT.\n", None), (LICENCE + CODE, None),
    ],
)
def test_own_reasons_behind_a_long_licence(text, reason):
    assert V.own_reason("a.py", "python", text) == reason


def test_copies_held_by_many_repositories(spark):
    lib = "\n".join(f"export function thing{i}(a) {{ return wrap{i * 7}(a, {i}); }}" for i in range(20))
    loose = "\n".join(f"const both{i} = create{i}(options, {i * 5});" for i in range(20))
    tiny = "module.exports = require('./thing/index.js');\n"
    licence = "\n".join(f"// licence paragraph {i} of the common licence" for i in range(30)) + "\n"
    idioms = "if (value === null) {\nreturn undefined;\n} catch (error) {\nthrow new Error(message);\nconsole.log(message);\n"
    rows = []
    for i in range(12):
        own = "\n".join(f"const mine{i}_{k} = build{i}(config, {k});" for k in range(6)) + "\n"
        for name, text in (("lib", lib), ("loose", loose), ("tiny", tiny), ("own", licence + idioms + own)):
            rows += [(f"r{i}", f"{name}{i}", "1", f"src/{name}.js", "javascript", text)] * (2 if i == 3 else 1)
    s = spark.createDataFrame(rows, "repo_id string, file_id string, blob_sha string, path string, language string, text string")
    u = spark.createDataFrame([("p", "thing.js", licence + lib), ("p", "index.js", tiny.replace("\n", "\r\n"))] + [(f"q{i}", "x.js", licence + x) for i, x in enumerate(idioms.split("\n"))], "pkg_name string, file_name string, text string")
    got = V.judged(s, u).collect()
    assert {r.file_id for r in got} == {f"{name}{i}" for name in ("lib", "loose", "tiny") for i in range(12)} and all(r.containment == 1 for r in got)


def test_partners_that_no_line_names_first(spark):
    own = lambda f: [f"const own_{f}_{i} = made(config, {i * 3});" for i in range(30)]
    rare = [f"export function thing{i}(a) {{ return wrap{i * 7}(a, {i}); }}" for i in range(20)]
    common = [f"const both{i} = create{i}(options, {i * 5});" for i in range(20)]
    files = {("a", "q"): rare, ("b", "copy"): [*rare, "let changed = here(1, 2);"]}
    files |= {("a", f"p{k}{j}"): rare[k::7] + own(f"p{k}{j}") for k in range(7) for j in range(5)}
    for i in range(8):
        files |= {(f"r{i}", f"c{i}"): [*common, f"let changed{i} = here(1, 2);"]}
        files |= {(f"r{i}", f"p{i}{k}{j}"): common[k::7] + own(f"p{i}{k}{j}") for k in range(7) for j in range(5)}
    s = spark.createDataFrame([(r, f, "1", "src/x.js", "javascript", "\n".join(t)) for (r, f), t in files.items()], "repo_id string, file_id string, blob_sha string, path string, language string, text string")
    u = spark.createDataFrame([], "pkg_name string, file_name string, text string")
    want = {"q": 1.0, "copy": round(20 / 21, 3)} | {f"c{i}": round(20 / 21, 3) for i in range(8)}
    assert {r.file_id: round(r.containment, 3) for r in V.judged(s, u).collect()} == want
    assert {r.file_id for r in V.judged(s, u, only_verdicts=True).collect()} == set(want)


def _judged_by_all_pairs(sources, upstream):
    """{file_id: (reason, containment, origin)}, every file beside every other."""
    sets = {f: (r, *V.headed_lines(text), V.own_reason(path, language, text), V.text_hash(text)) for r, f, _, path, language, text in sources}
    catalogue = [(set(V.line_hashes(text)), V.text_hash(text)) for *_, text in upstream]
    repositories = defaultdict(set)
    for r, lines, *_ in sets.values():
        for h in lines:
            repositories[h].add(r)
    out = {}
    for f, (r, lines, head, reason, whole) in sets.items():
        rare, body = {h for h in lines if len(repositories[h]) <= V.RARE_REPOSITORIES}, set(lines[head:])
        share = lambda n: n / len(rare) if len(rare) >= V.MIN_RARE_LINES else 0.0
        own = lambda n: n / len(body) if n >= V.MIN_RARE_LINES and n > V.CONTAINED * len(body) else 0.0
        others = [set(x[1]) for x in sets.values() if x[0] != r]
        a = max(share(sum(any(h in c for c, _ in catalogue) for h in rare)), own(max(len(body & c) for c, _ in catalogue)), float(whole in [w for _, w in catalogue if w is not None]))
        b = max(share(max(len(rare & x) for x in others)), own(max(len(body & x) for x in others)))
        reason = "vendored" if max(a, b) >= V.CONTAINED else reason
        if reason:
            out[f] = reason, round(max(a, b), 9), "catalogue" if a >= b else "repository"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    heads, texts = [f"# leading comment number {i}" for i in range(6)], [[f"value_{k}_{i} = compute_{k}({i})" for i in range(14)] for k in range(12)]
    pool = [x for t in texts for x in t]
    sources = [("r0", "none", "1", None, None, None)]
    for i in range(240):
        t = rng.choice(texts)
        lines = rng.sample(t, rng.randrange(3, 15)) + rng.sample(pool, rng.randrange(6)) + [f"only_{i}_{k} = here({k})" for k in range(rng.choice((0, 0, 2, 9)))]
        text = "\n".join(rng.sample(heads, rng.randrange(3)) + lines)
        for j in range(rng.choice((1, 1, 1, 2, 3))):
            repo = rng.randrange(9) if t not in texts[:7] else rng.randrange(3)
            sources.append((f"r{repo}", f"f{i}_{j}", "1", rng.choice(("a.py", "a.py", "a_pb2.py", "vendor/a.py")), "python", rng.choice(("", "", "\x0c")) + text))
    upstream = [("p", f"n{k}", "\n".join(rng.sample(texts[k], 9))) for k in (0, 5, 11)] + [("p", "whole", sources[9][-1])]
    s = spark.createDataFrame(sources, "repo_id string, file_id string, blob_sha string, path string, language string, text string")
    u = spark.createDataFrame(upstream, "pkg_name string, file_name string, text string")
    want = _judged_by_all_pairs(sources, upstream)
    assert {r.file_id: (r.reason, round(r.containment, 9), r.origin) for r in V.judged(s, u, block_lines=200 * seed**9).collect()} == want
    assert {r.file_id for r in V.judged(s, u, only_verdicts=True).collect()} == set(want)


@pytest.mark.parametrize("work", [1, 50, 2_000_000])
@pytest.mark.parametrize("common", [6, 60])
def test_questions_against_brute_force(monkeypatch, work, common):
    monkeypatch.setattr(V, "PART_WORK", work)
    rng = random.Random(common)
    lines = lambda: rng.sample(range(common), rng.randrange(1, 6)) + rng.sample(range(100, 160), rng.randrange(8))
    asked = {i: (rng.randrange(3), lines()) for i in range(40)}
    least = {i: rng.randrange(1, len(x) + 1) for i, (_, x) in asked.items()}
    rows = [(i, True, r, len(x), least[i], h, h) for i, (r, x) in asked.items() for h in x]
    table = pa.table({c: [row[k] for row in rows] for k, c in enumerate(("text", "by_rare", "r", "most", "least", "n", "h"))})
    files = [(rng.randrange(3), lines() if i % 9 else []) for i in range(90)]
    questions = V.Questions(table)
    best = np.zeros(len(questions.start), np.int64)
    for part in (files[:50], files[50:], []):
        questions.count(best, np.array([r for r, _ in part], np.int64), np.array([len(x) for _, x in part], np.int64), np.array([h for _, x in part for h in x], np.int64))
    most = {i: max((len({*x} & {*y}) for q, y in files if q != r), default=0) for i, (r, x) in asked.items()}
    got = dict(zip(questions.text.tolist(), best.tolist()))
    assert all(got[i] == most[i] if most[i] >= least[i] else got[i] < least[i] for i in asked)


# ---- pairs


@pytest.mark.parametrize(
    ("doc", "name", "says"),
    [
        ("Reads the file and returns its lines.", "load", True), ("TODO", "f", False), ("TODO: document this", "f", False), ("/** Gets the name. */", "getName", False), ("The load config function.", "load_config", False),
        ("@param x\n@return", "f", False), ("@param x the depth of the tree", "f", True), (":param x:\n:returns:", "f", False), ("Args:\n    x:\nReturns:", "f", False), ("=====", "f", False), ("", "f", False), (None, "f", False), ("n/a", "f", False),
        ('"""Renews the signal."""', "renew_signal", False), ("// loadConfig()", "loadConfig", False), ("<p>Retries twice before failing.</p>", "f", True), ("TODO Retries twice before failing.", "f", True), ("{@inheritDoc}", "f", False), ("Sortiert die Zeilen.", "f", True),
    ],
)
def test_describes(doc, name, says):
    assert P.describes(doc, P.name_words(name)) is says


def test_comments_of_definitions():
    go = "package a\n\n// Load reads it.\n// Twice.\nfunc Load() {\n}\n\n// stray\n\nfunc Other() {\n}\n".split("\n")
    assert P.comment_of(go, 5, "go") == "// Load reads it.\n// Twice." and P.comment_of(go, 10, "go") is None
    java = "class A {\n  /**\n   * Adds.\n   */\n  @Override\n  int add() {\n".split("\n")
    assert "Adds." in P.comment_of(java, 6, "java")
    py = 'def f(a,\n      b=":"):\n\n    # note\n    """Adds a."""\n    return 1\n\ndef g(): pass\n'.split("\n")
    assert P.comment_of(py, 1, "python") == "Adds a." and P.comment_of(py, 8, "python") is None
    assert P.comment_of([], 1, "go") is None and P.comment_of(go, 99, "go") is None


@pytest.mark.parametrize(
    ("language", "signature", "kind"),
    [
        ("java", "(final String name, List<Map<String, Foo>> rows) throws X", "(String,List)"), ("java", "(String other, List<foo> r)", "(String,List)"), ("java", "(int[] a, foo b)", "(int[],foo)"), ("java", "()", "()"),
        ("python", "(self, a: int = 3, b=None, *args) -> dict[str, int]", "(int,_,_)"), ("typescript", "(a: string[], f: (x: number) => void): string", "(string[],=>void)"), ("go", "(a int, b []string) (int, error)", "(int,[]string)"),
        ("rust", "(&mut self, a: &str) -> Option<u32>", "(&str)"), ("c", "(const char *path, int)", "(char*,int)"), ("cpp", "int load(const char *p, int n)", "(char*,int)"), ("javascript", "(a, b = 1)", "(_,_)"), (None, "(a)", "(_)"), ("java", None, None),
    ],
)
def test_normalised_signatures(spark, language, signature, kind):
    df = spark.createDataFrame([(signature, language)], "s string, l string")
    assert df.select(P.normalised_signature(F.col("s"), F.col("l"))).first()[0] == kind


def test_pairs_of_overloads_against_brute_force(spark):
    rng = random.Random(4)
    t = dt.datetime(2024, 1, 1)
    kinds = ["String", "int", "List<Foo>", "foo", "Foo"]
    rows = []
    for i in range(60):
        types = [rng.choice(kinds) for _ in range(rng.randrange(3))]
        sig = "(" + ", ".join(f"{k} {rng.choice('abc')}{j}" for j, k in enumerate(types)) + ")"
        rows.append((f"n{i:02}", rng.choice(["p.load", "p.save"]), sig, rng.choice([None, None, "Reads the ledger twice.", "TODO"]), [k.split("<")[0] for k in types]))
    nodes = [("r", 1, i, "Method", q.split(".")[1], q, f"f{i}", None, 5, 6, s, d, t) for i, q, s, d, _ in rows]
    n = spark.createDataFrame(nodes, "repo_id string, snapshot_no int, node_id string, kind string, name string, qualified_name string, file_id string, parent_id string, start_line int, end_line int, signature string, doc string, ingested_at timestamp")
    f = spark.createDataFrame([("r", 1, f"f{r[0]}", "b", "java", t) for r in rows], "repo_id string, snapshot_no int, file_id string, blob_sha string, language string, ingested_at timestamp")
    src = spark.createDataFrame([(f"f{r[0]}", "b", "\n" * 8) for r in rows], "file_id string, blob_sha string, text string")
    told = {(q, tuple(k)) for _, q, _, d, k in rows if d and d != "TODO"}
    want = {(i, "doc") for i, _, _, d, _ in rows if d and d != "TODO"} | {(i, "declaration") for i, q, _, d, k in rows if d is None and (q, tuple(k)) in told}
    got = P.pairs(n, f, spark.createDataFrame([("r", 1)], "repo_id string, snapshot_no int"), src).collect()
    assert {(r.node_id, r.origin) for r in got} == want and any(o == "declaration" for _, o in want)


def test_docstring_behind_long_decorators():
    lines = ("@deco(\n" + "".join(f"    option_{i}={i},\n" for i in range(60)) + ")\ndef f():\n    \"\"\"Counts the rows.\"\"\"\n\ndef g():\n    \"\"\"Other.\"\"\"\n").split("\n")
    assert P.comment_of(lines, 1, "python", 64) == "Counts the rows." and P.comment_of(lines, 1, "python", 50) is None


def test_pairs_table(spark):
    t = dt.datetime(2024, 1, 1)
    n = "repo_id string, snapshot_no int, node_id string, kind string, name string, qualified_name string, file_id string, parent_id string, start_line int, end_line int, signature string, doc string, ingested_at timestamp, text string"
    base = lambda i, name, line, doc=None, file="f", kind="Function", sig="(a)", no=2, at=t: ("r", no, i, kind, name, f"m.{name}", file, None, line, line and line + 1, sig, doc, at, "clash")
    nodes = [base("1", "load", 3), base("1", "load", 3), base("2", "save", 6, "Writes all rows."), base("3", "get_x", 9, "Gets x."), base("4", "gone", 1, "Old text kept.", no=1), base("5", "late", 6, "wrong"), base("5", "late", 6, None, at=t + dt.timedelta(days=1)), base("6", "A", 1, "A class of rows.", kind="Class"), base("7", "nofile", 1, "Writes all.", file="zz"), base("8", "null", None, None)]
    nodes += [base("9", "decl", 1, "Declared elsewhere, with care.", file="f", sig="(a: int)"), base("10", "decl", 9, None, file="g", sig="( b : int )"), base("11", "decl", 9, None, file="g", sig="(a: str)")]
    nodes[-2] = nodes[-2][:5] + ("m.decl",) + nodes[-2][6:]
    src = "\n\ndef load(a):\n    '''Loads rows from disk.'''\n\ndef save(a):\n    pass\n\ndef get_x(a):\n    pass\n"
    files = [("r", 2, "f", "b", "python", t), ("r", 2, "f", "b", "python", t), ("r", 2, "g", "b", "python", t)]
    sources = [("f", "b", src), ("f", "b", src), ("g", "b", src), ("f", "other", "x"), ("zz", None, None)]
    args = [spark.createDataFrame(nodes, n), spark.createDataFrame(files, "repo_id string, snapshot_no int, file_id string, blob_sha string, language string, ingested_at timestamp"), spark.createDataFrame([("r", 1), ("r", 2), ("r", 2)], "repo_id string, snapshot_no int"), spark.createDataFrame(sources, "file_id string, blob_sha string, text string")]
    got = {r.node_id: (r.origin, r.description) for r in P.pairs(*args).collect()}
    assert got["1"] == ("comment", "Loads rows from disk.") and got["2"] == ("doc", "Writes all rows.") and got["9"][0] == "doc"
    assert got["10"] == ("declaration", "Declared elsewhere, with care.")
    assert set(got) == {"1", "2", "9", "10"}
    assert P.pairs(args[0].limit(0), *args[1:]).count() == 0
