"""Snapshot changes and copy differences on dirty rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from graphloom.operators import copy_diff, snapshot_diff

T = [dt.datetime(2024, 1, d) for d in range(1, 9)]
SNAP = "repo string, no int"
ROWS = "repo string, no int, id string, body string, props string, at timestamp, change string, h string"


def changes(spark, rows, snapshots):
    t = spark.createDataFrame(rows, ROWS)
    s = spark.createDataFrame(snapshots, SNAP)
    out = snapshot_diff.snapshot_changes(t, s, group="repo", number="no", record="id", version="at", json_columns=("props",))
    return sorted(out.select("g", "n", "id", "change").collect(), key=str)


def test_changes(spark):
    rows = [
        ("r", 1, "a", "x", '{"p": 1, "q": [2]}', T[0], "k", "z"), ("r", 3, "a", "x", '{"q":[2],\n"p":1}', T[1], "k", "z"),  # JSON layout only
        ("r", 1, "b", "x", None, T[0], "k", None), ("r", 3, "b", None, None, T[1], "k", None),  # null is a value
        ("r", 1, "c", "x", "{}", T[0], "k", None),  # removed
        ("r", 3, "d", "x", "not json", T[1], "k", None), ("r", 3, "d", "x", "not json", T[1], "k", None),  # added, delivered twice
        ("r", 1, "e", "old", "{}", T[0], "k", None), ("r", 1, "e", "new", "{}", T[5], "k", None), ("r", 3, "e", "new", "{}", T[1], "k", None),  # corrected later
        ("r", 1, "f", "x", "{}", T[0], "k", None), ("r", 3, "f", "x", "{}", T[1], None, "k"),  # nulls that change places, in clashing columns
        ("s", 5, "a", "x", "{}", T[0], "k", None),  # first snapshot only
        ("r", 3, None, "x", "{}", T[0], "k", None),
    ]
    got = changes(spark, rows, [("r", 1), ("r", 3), ("r", 3), ("s", 5), (None, 1)])
    assert [tuple(r) for r in got] == [("r", 3, "b", "changed"), ("r", 3, "c", "removed"), ("r", 3, "d", "added"), ("r", 3, "f", "changed"), ("r", 3, None, "added")]


def test_no_rows(spark):
    assert changes(spark, [], [("r", 1), ("r", 2)]) == []
    assert changes(spark, [("r", 1, "a", "x", None, T[0], None, None)], []) == []


KEYS = ["corpus", "category", "file", "start_byte", "end_byte"]
COPY = "corpus string, project string, category string, file string, start_byte long, end_byte long, start_line int, caller string, callee string, strategy string, confidence double, reason string, label string, qn string, def_file string, signature string, emitted_at timestamp, f0 string, leaf string"


def copy_row(project, key, at=T[0], **kw):
    base = dict(corpus="c", project=project, category="typed", file="f", start_byte=key, end_byte=key, start_line=1, caller=f"{project}.a", callee=f"{project}.b", strategy="s", confidence=0.9, reason=None, label=None, qn=None, def_file=None, signature=None, emitted_at=at, f0="x", leaf="y")
    return tuple((base | kw).values())


def test_copies(spark):
    left = [copy_row("l", 1), copy_row("l", 2, reason=""), copy_row("l", 3), copy_row("l", 4, confidence=0.9 + 1e-13), copy_row("l", 5, strategy="old"), copy_row("l", 5, T[3], strategy="s"), copy_row("l", 6, callee="z", qn="l.q"), copy_row("l", None), copy_row("l", 8), copy_row("l", 8)]
    right = [copy_row("r", 1), copy_row("r", 2), copy_row("r", 4), copy_row("r", 5), copy_row("r", 6, qn="r.q2"), copy_row("r", 7), copy_row("r", None), copy_row("r", 8)]
    got = copy_diff.engine_differences(spark.createDataFrame(left, COPY), spark.createDataFrame(right, COPY)).collect()
    assert sorted((r.start_byte, r.difference) for r in got) == [(3, "missing_in_reference"), (6, "callee"), (6, "qn"), (7, "missing_in_vendored")]


def test_copies_empty(spark):
    empty = spark.createDataFrame([], COPY)
    assert copy_diff.engine_differences(empty, empty).count() == 0
    assert copy_diff.engine_differences(spark.createDataFrame([copy_row("l", 1)], COPY), empty).first().difference == "missing_in_reference"


def test_copies_against_brute_force(spark):
    rng = random.Random(3)
    a = {i: rng.randrange(5) for i in rng.sample(range(3000), 2000)}
    b = dict(a)
    for i in rng.sample(sorted(b), 40):
        b[i] = 9
    for i in rng.sample(sorted(b), 30):
        del b[i]
    for i in range(4000, 4020):
        b[i] = 1
    frame = lambda d: spark.createDataFrame([(i, v, 0) for i, v in d.items()], "k long, v int, at int")
    for leaf_rows in (4, 64):
        got = copy_diff.copy_differences(frame(a), frame(b), keys=["k"], left_fields={"v": F.col("v")}, right_fields={"v": F.col("v")}, version="at", names=("a", "b"), leaf_rows=leaf_rows)
        want = {(k, "missing_in_b") for k in a.keys() - b.keys()} | {(k, "missing_in_a") for k in b.keys() - a.keys()} | {(k, "v") for k in a.keys() & b.keys() if a[k] != b[k]}
        assert {(r.k, r.difference) for r in got.collect()} == want
