"""Traversal and structure on toy and random graphs."""

import inspect
import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import resolution as R
from graphloom.operators import structure as S


def edges(spark, pairs, weight=1):
    return spark.createDataFrame([(a, b, weight, "exact") for a, b in pairs], "src long, dst long, weight long, band string")


def closure(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    return reach


def test_components_both_ways(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(45)}
    r = closure(pairs)
    want = {n: max(m for m in r[n] if n in r[m]) for n in r}
    for bound in (0, 10**6):
        got = {x.node: x.component for x in G.strong_components(edges(spark, pairs), local_edges=bound).collect()}
        assert got == want
    rec = {x.node for x in G.recursive_nodes(edges(spark, pairs), G.strong_components(edges(spark, pairs))).collect()}
    assert rec == {n for n in r if any(n in r[b] for a, b in pairs if a == n)}


def test_components_are_never_left_unfinished(spark):
    # A chain of two-node cycles whose labels fall along the edges settles one cycle a round.
    pairs = [p for k in range(3, 0, -1) for p in ((10 * k, 10 * k + 1), (10 * k + 1, 10 * k), (10 * k, 10 * k - 10))][:-1]
    with pytest.raises(RuntimeError, match="2 rounds"):
        G.strong_components(edges(spark, pairs), most_rounds=2, local_edges=0)
    assert inspect.signature(G.strong_components).parameters["most_rounds"].default is None
    got = {x.node: x.component for x in G.strong_components(edges(spark, pairs), local_edges=0).collect()}
    assert got == {n: n // 10 * 10 + 1 for p in pairs for n in p}


def test_feedback_edges_leave_no_cycle(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(15), rng.randrange(15)) for _ in range(40)}
    e = edges(spark, pairs)
    cut = {(x.src, x.dst) for x in G.feedback_edges(e, G.strong_components(e)).collect()}
    rest = pairs - cut
    r = closure(rest) if rest else {}
    assert all(not (a != b and a in r[b]) and a != b for a, b in rest)


def test_feedback_edges_are_not_far_from_the_fewest(spark):
    rng = random.Random(9)
    for _ in range(3):
        pairs = sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(14)})
        e = edges(spark, pairs)
        cut = {(x.src, x.dst) for x in G.feedback_edges(e, G.strong_components(e)).collect()}
        loops = {p for p in pairs if p[0] == p[1]}
        inside = [p for p in pairs if p not in loops]
        fewest = min(sum(order.index(a) > order.index(b) for a, b in inside) for order in itertools.permutations(range(6)))
        assert loops <= cut and len(cut - loops) <= max(fewest, min(2 * fewest, len(inside) // 2))


def modularity(pairs, label):
    m = len(pairs)
    degree = {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(label[a] == label[b] for a, b in pairs) / m
    return inside - sum((sum(d for n, d in degree.items() if label[n] == c) / (2 * m)) ** 2 for c in set(label.values()))


def test_communities_find_what_is_planted(spark):
    rng = random.Random(8)
    group = {n: n // 8 for n in range(32)}
    pairs = sorted({(a, b) for a in range(32) for b in range(a + 1, 32) if rng.random() < (0.8 if group[a] == group[b] else 0.04)})
    got = {x.node: x.community for x in G.communities(edges(spark, pairs)).collect()}
    assert set(got) == {n for p in pairs for n in p} and all(got[c] == c and c == min(n for n in got if got[n] == c) for c in got.values())
    assert modularity(pairs, got) >= modularity(pairs, group) - 1e-9
    assert G.communities(edges(spark, [])).count() == 0


def test_transitive_maximum(spark):
    # a<->b, b->c, d->d, e->a with depths 1,0,3,2,0
    e = edges(spark, [(1, 2), (2, 1), (2, 3), (4, 4), (5, 1)])
    v = spark.createDataFrame([(1, 1), (2, 0), (3, 3), (4, 2), (5, 0)], "node long, value int")
    assert {x.node: x.value for x in G.reachable_max(e, v).collect()} == {1: 3, 2: 3, 3: 3, 4: 2, 5: 3}
    v = spark.createDataFrame([(1, None), (2, 5)], "node long, value int")
    assert {x.node: x.value for x in G.reachable_max(edges(spark, [(1, 2)]), v).collect()} == {1: 5, 2: 5}


def test_reach_and_traces(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 3), (3, 4)])
    seeds = spark.createDataFrame([(1,)], "s long")
    assert {(x.node, x.distance) for x in G.reach(e, seeds, 5).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert [x.path for x in G.traces(e, 1, 4).collect()] == [[1, 3, 4], [1, 2, 3, 4]]
    assert {(x.caller, x.callee, x.depth) for x in G.call_chain(e, spark.createDataFrame([(4,)], "s long"), 2).collect()} == {(3, 4, 1), (2, 3, 2), (1, 3, 2)}
    empty = edges(spark, [])
    assert G.reach(empty, seeds, 3).count() == 1 and G.strong_components(empty).count() == 0


def test_communities_find_two_cliques(spark):
    pairs = [*itertools.combinations(range(5), 2), *itertools.combinations(range(10, 15), 2), (0, 10)]
    got = {x.node: x.community for x in G.communities(edges(spark, pairs)).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[1] != got[11]


def test_lift(spark):
    visible = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "node long, shown string")
    e = spark.createDataFrame([(1, 3, 2, "exact"), (2, 3, 3, "scoped"), (1, 2, 1, "typed"), (1, 9, 1, "typed")], "src long, dst long, weight long, band string")
    assert [tuple(x) for x in G.lift_edges(e, visible).collect()] == [("a", "b", 5, "scoped", 0.5)]


def narrow_plain(candidates, stages):
    cur = set(candidates)
    for e, band in stages:
        hit = {c for c in cur if candidates[c].get(e)}
        if hit:
            cur = hit
        if len(hit) == 1:
            return band, hit.pop(), None
    return None, None, sorted(cur)


def test_narrowing_against_the_plain_fold(spark):
    rng = random.Random(6)
    stages = [("e1", "import-guided"), ("e2", "exact"), ("e3", "scoped")]
    rows, want = [], {}
    for site in range(60):
        c = {k: {e: rng.random() < 0.4 for e, _ in stages} for k in range(rng.randrange(1, 6))}
        rows += [(site, k, *v.values()) for k, v in c.items()]
        want[site] = narrow_plain(c, stages)
    df = spark.createDataFrame(rows, "site int, c int, e1 boolean, e2 boolean, e3 boolean")
    for parts in (1, 5):
        got = {r.site: (r.stage, r.target, r.candidates) for r in R.narrow(df.repartition(parts), "site", "c", stages).collect()}
        assert got == want


def test_callee_parts(spark):
    df = spark.createDataFrame([("a.b.c",), ("a->b",), ("A::B::c",), ("c",), ("a\\b",)], "t string")
    r, n = R.split_callee(F.col("t"))
    assert [tuple(x) for x in df.select(r, n).collect()] == [("a.b", "c"), ("a", "b"), ("A::B", "c"), (None, "c"), ("a", "b")]


def test_containers_open_overfull_folders(spark):
    paths = [("r", f"src/app/{d}/f{i}.py") for d, n in (("a", 3), ("b", 3)) for i in range(n)] + [("r", "doc/x.md")]
    got = {(x.container, x.members) for x in S.containers(spark.createDataFrame(paths, "g string, p string"), ["g"], "p").collect()}
    assert got == {("src/app/a", 3), ("src/app/b", 3), ("doc", 1)}


def test_precise_merge(spark):
    sites = spark.createDataFrame([("s1", "f", 0, 10, "typed", "x"), ("s2", "f", 20, 30, "typed", "x"), ("s3", "f", 40, 50, None, None), ("s4", "f", 60, 70, "typed", "x"), ("s5", "f", 80, 90, "typed", "x")], "site string, file string, start int, end int, band string, target string")
    occ = spark.createDataFrame([("f", 5, 8, "x"), ("f", 22, 23, "y"), ("f", 41, 42, "z"), ("f", 61, 62, "x"), ("f", 63, 64, "y"), ("f", 90, 95, "x")], "file string, start int, end int, target string")
    assert {(r.site, r.outcome, r.target) for r in S.precise_merge(sites, occ).collect()} == {("s1", "upgrade", "x"), ("s2", "contradict", "y"), ("s3", "insert", "z"), ("s4", "conflict", "x"), ("s5", "kept", "x")}


@pytest.mark.parametrize("local_edges", [G.LOCAL_EDGES, 0])
def test_levels_of_deep_and_tangled_hierarchies(spark, local_edges):
    def want(rows):
        up, out = {}, set()
        for c, p in rows:
            up.setdefault(c, set()).add(p)
        for c in up:
            at, seen, level = {c}, {c}, 0
            while at:
                level += 1
                at = {p for x in at for p in up.get(x, ()) if x is not None} - seen
                seen |= at
                out |= {(c, p, level) for p in at}
        return out

    rng = random.Random(5)
    for rows in ([(i, i - 1) for i in range(1, 90)] + [(i, i // 2) for i in range(2, 90)], [(rng.randrange(40), rng.randrange(40)) for _ in range(70)], [(1, 1), (1, 2), (2, 1), (3, None)], []):
        df = spark.createDataFrame(rows, "child int, parent bigint")
        got = G.hierarchy_levels(df, local_edges=local_edges)
        assert got.dtypes == [("node", "int"), ("ancestor", "bigint"), ("level", "int")]
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want(rows)
    text = G.hierarchy_levels(spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "child string, parent string"), local_edges=local_edges)
    assert {tuple(r) for r in text.collect()} == {("c", "b", 1), ("c", "a", 1), ("b", "a", 1)}


def test_levels_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(G, "materialise", lambda df, tag, real=G.materialise: written.append(tag) or real(df, tag))
    chain = spark.range(1, 120).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    for local_edges in (G.LOCAL_EDGES, 0):
        written.clear()
        assert G.hierarchy_levels(chain, local_edges=local_edges).agg(F.count("*"), F.max("level")).first() == (119 * 120 // 2, 119) and len(written) < 12


@pytest.mark.parametrize("local_edges", [G.LOCAL_EDGES, 0])
def test_nearest_visible_lists_no_ancestors(spark, monkeypatch, local_edges):
    def want(rows, shown, nodes):
        up, out = {}, set()
        for c, p in rows:
            up.setdefault(c, set()).add(p)
        for n in {*nodes, *up}:
            at, seen = {n}, {n}
            while at and not at & shown:
                at = {p for x in at for p in up.get(x, ()) if p is not None} - seen
                seen |= at
            out |= {(n, min(at & shown))} if at else set()
        return out

    monkeypatch.setattr(G, "hierarchy_levels", None)
    rng = random.Random(6)
    for rows, shown, nodes in (
        ([(i, i - 1 - i % 7) for i in range(9, 90)] + [(i, i // 2) for i in range(9, 90)], {x for x in range(90) if x % 6 == 0}, set(range(90))),
        ([(rng.randrange(40), rng.randrange(40)) for _ in range(60)], {3, 7, 20}, {1, 2, 3, 99}),
        ([(1, 1), (1, 2), (2, 1), (3, None), (4, 5)], {5, 3}, {3, 6}),
        ([], {1}, {1, 2}),
    ):
        ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "node bigint")
        got = G.nearest_visible(spark.createDataFrame(rows, "child bigint, parent bigint"), ids(shown), ids(nodes), local_edges)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want(rows, shown, nodes)
