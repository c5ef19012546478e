"""Hierarchies against a plain walk, deep chains and cycles included."""

import random

from graphloom.operators import hierarchy as H


def walk(parents):
    """{node: (root, depth)} by following pointers; cycles give (smallest id on it, -1)."""
    out = {}
    for n in parents:
        path, at = [n], n
        while parents.get(at) in parents and parents[at] not in path:
            at = parents[at]
            path.append(at)
        nxt = parents.get(at)
        if nxt in path:
            out[n] = (min(path[path.index(nxt):]), -1)
        else:
            out[n] = (at, len(path) - 1)
    return out


def frame(spark, parents, group="g"):
    return spark.createDataFrame([(group, n, p, n.upper(), "x") for n, p in parents.items()], "grp string, id string, p string, name string, low string")


def check(spark, parents):
    t = H.forest(frame(spark, parents), group="grp", node="id", parent="p", name="name")
    want = walk(parents)
    for out in (H.roots_and_depths(t), H.nested_sets(t)):
        assert {r.id: (r.root, r.depth) for r in out.collect()} == want
    ranges = H.nested_sets(t)
    got = {(r.id, r.descendant) for r in H.descendants_of(ranges, ranges).collect()}
    above = set()
    for n in parents:
        at = n
        if want[n][1] < 0:
            continue
        while parents.get(at) in parents:
            at = parents[at]
            above.add((at, n))
    assert got == above
    for r in ranges.collect():
        if r.depth >= 0:
            assert r.descendants == sum(1 for a, _ in above if a == r.id)
            assert r.path.count("/") == r.depth and r.path.endswith(r.id.upper())


def test_small_forest_with_cycles(spark):
    check(spark, {"a": None, "b": "a", "c": "a", "d": "b", "e": "missing", "f": "g", "g": "h", "h": "f", "i": "f", "j": "i", "s": "s", "t": "s"})


def test_random_and_deep(spark):
    rng = random.Random(1)
    parents = {f"n{i:03}": (f"n{rng.randrange(i):03}" if i and rng.random() > 0.1 else None) for i in range(120)}
    parents |= {f"x{i:03}": (f"x{i - 1:03}" if i else None) for i in range(70)}
    check(spark, parents)


def test_hot_parents_and_cut_families(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT_ROWS", 4)
    monkeypatch.setattr(H, "_BUCKET_ROWS", 3)
    parents = {f"c{i:02}": ("r", "c00", None)[i % 3] for i in range(1, 40)} | {"r": None, "c00": "r", "loop": "c99", "c99": "loop"} | {f"l{i}": "loop" for i in range(9)}
    check(spark, parents)


def test_edges(spark):
    schema = "grp string, id string, p string"
    run = lambda rows: sorted(tuple(r) for r in H.nested_sets(H.forest(spark.createDataFrame(rows, schema), group="grp", node="id", parent="p")).select("g", "id", "root", "depth").collect())
    assert run([]) == []
    assert run([("g", None, "a"), ("g", "a", None), ("g", "a", None)]) == [("g", "a", "a", 0)]
    assert run([("g", "b", "a"), ("h", "a", None)]) == [("g", "b", "b", 0), ("h", "a", "a", 0)]
    assert run([("g", "a", "a")]) == [("g", "a", "a", -1)]
