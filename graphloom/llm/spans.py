"""Long exact spans shared between documents, by prefix-partitioned suffix trees.

Suffixes are taken at content-chosen anchors: in every stretch of the wanted
length the gram of least hash is an anchor, so two documents that share such a
stretch share an anchor at the same place inside it and no shared stretch is
lost.  A stretch begins ``l`` characters before its anchor, 0 <= l <= length -
gram.  Suffixes are partitioned by their first gram, which lies in the
stretches of all ``l``; a partition beyond ``group_rows`` is halved by ``l``,
each half keyed by the longer prefix that its stretches have in common, until
it fits or is one node for all stretches of its half.

Inside a partition the suffixes are sorted, forwards from the anchor and
backwards before it, with the longest common prefixes of neighbours: runs of
neighbours with a common prefix of at least ``d`` are the suffix tree's nodes
of that depth.  Suffixes in one node of depth ``length - l`` forwards and of
depth ``l`` backwards share a stretch.  The partitions' bounds decide only
where a node is found, never what is found.

Texts that are copies of one another are represented by the copy of least
doc_id and joined back at the end.

Defined results: rows without a doc_id are left out; positions count code points from 0; null texts and texts
shorter than the length share nothing; repeats inside one document do not
count; a document delivered twice counts once; equal texts share all of their
length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.shared import materialise

LENGTH = 200
GRAM = 80
PIECE = 1 << 19
GROUP_ROWS = 4000
CHUNK_ROWS = 12_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in two block-wise passes."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(codes: np.ndarray, owner: np.ndarray, length: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the anchors of all stretches that lie in one owner."""
    n = len(codes)
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = powers
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:], dtype=np.uint64)
    h = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1]) | np.uint64(1)
    width = length - gram + 1
    least = sliding_min(h, width)
    least[owner[: n - length + 1] != owner[length - 1 :]] = 0
    # The greatest of the minima of the stretches around a gram: equal to its hash iff it is one of them.
    around = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    top = ~sliding_min(~around, width)
    at = np.flatnonzero(h == top)
    return at, h[at]


def suffix_anchors(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, doc_id, at): sampled suffixes of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(2 * PIECE + 2)

        def flush(parts):
            codes = np.concatenate([np.frombuffer(raw, dtype=np.uint32) for _, _, raw in parts])
            sizes = np.array([len(raw) // 4 for _, _, raw in parts])
            owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
            at, h = anchors(codes, owner, length, gram, powers)
            own = owner[at]
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            doc = np.array([p[0] for p in parts], dtype=np.int64)[own]
            place = at - begin[own] + np.array([p[1] for p in parts], dtype=np.int64)[own]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32))], names=["h", "doc_id", "at"])

        parts, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or text is None or len(text) < length:
                    continue
                for start in range(0, max(1, len(text) - length + 1), PIECE):
                    raw = text[start : start + PIECE + length - 1].encode("utf-32-le", "surrogatepass")
                    parts.append((doc, start, raw))
                    held += len(raw) // 4
                    if held >= PIECE:
                        yield flush(parts)
                        parts, held = [], 0
        if parts:
            yield flush(parts)

    return documents.select("doc_id", "text").mapInArrow(run, "h bigint, doc_id bigint, at int")


def _neighbours(texts: list[str], group: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of the texts within their groups, common prefixes with the one before (-1 across groups), and the texts' codes in that order."""
    order = np.array(sorted(range(len(texts)), key=lambda i: (group[i], texts[i])), dtype=np.int64)
    raw = [texts[i].encode("utf-32-le", "surrogatepass") for i in order]
    sizes = np.array([len(r) // 4 for r in raw])
    grid = np.zeros((len(raw), width), dtype=np.uint32)
    row = np.repeat(np.arange(len(raw)), sizes)
    grid[row, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(b"".join(raw), dtype=np.uint32) + np.uint32(1)
    same = (grid[1:] == grid[:-1]) & (grid[1:] > 0)
    common = np.where(same.all(axis=1), width, same.argmin(axis=1)) if width else np.zeros(len(raw) - 1, dtype=np.int64)
    groups = np.array(group)[order]
    return order, np.concatenate(([-1], np.where(groups[1:] == groups[:-1], common, -1))), grid


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the number of its tree node of that depth."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _shared_nodes(table: pa.Table, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(l, rows, ends, before): by the stretch that begins l before the anchor, the rows of nodes of two rows or more.

    Rows come node by node and within a node by the code ``before`` the stretch
    (negative and unlike any other where none is known); ``ends`` has the end of each row's node.
    """
    back = length - gram
    column = lambda c: table.column(c).to_numpy().astype(np.int64)
    left, lo, hi = column("left"), column("lo"), column("hi")
    group = np.unique(np.stack([column("k0"), column("k1"), lo]), axis=1, return_inverse=True)[1].ravel().tolist()
    around = table.column("around").to_pylist()
    after = [t[n:] for t, n in zip(around, left.tolist())]
    size = np.array([len(t) for t in after])
    forward, ahead, _ = _neighbours(after, group, length)
    backward, behind, codes = _neighbours([t[:n][::-1] for t, n in zip(around, left.tolist())], group, back)
    place = np.empty(len(backward), dtype=np.int64)
    place[backward] = np.arange(len(backward))
    for off in range(int(lo.min()), int(hi.max()) + 1):
        rows = np.flatnonzero((lo <= off) & (off <= hi) & (left >= off) & (size >= length - off))
        if len(rows) < 2:
            continue
        node = _nodes(forward, ahead, length - off)[rows] * np.int64(len(left) + 1) + _nodes(backward, behind, off)[rows]
        before = np.where(left[rows] > off, codes[place[rows], min(off, back - 1)].astype(np.int64), -1 - rows) if off < back else -1 - rows
        by = np.lexsort((before, node))
        rows, node, before = rows[by], node[by], before[by]
        last = np.flatnonzero(np.append(node[1:] != node[:-1], True)) + 1
        ends = last[np.searchsorted(last, np.arange(len(rows)), side="right")]
        begins = np.concatenate(([0], last[:-1]))[np.searchsorted(last, np.arange(len(rows)), side="right")]
        keep = np.flatnonzero(ends - begins > 1)
        if len(keep):
            gone = np.cumsum(ends - begins == 1)
            yield off, rows[keep], (ends - gone[ends - 1])[keep], before[keep]


def _pairs_of(table: pa.Table, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Pairs of documents that share a stretch, given where it cannot be longer to the left."""
    doc = table.column("doc_id").to_numpy()
    for off, rows, ends, before in _shared_nodes(table, length, gram):
        subs = np.flatnonzero(np.append((ends[1:] != ends[:-1]) | (before[1:] != before[:-1]), True)) + 1
        sub_end = subs[np.searchsorted(subs, np.arange(len(rows)), side="right")]
        many = ends - sub_end
        for lo, hi in _slices(many, 200_000):
            n = many[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + sub_end[a]
            one, two = doc[rows[a]], doc[rows[b]]
            found = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)])[:, one != two], axis=1)
            if found.size:
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["doc_id_a", "doc_id_b"])


def _covers_of(table: pa.Table, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """For each suffix that shares stretches with other documents, the interval these cover; all of them hold its gram."""
    doc, at = table.column("doc_id").to_numpy(), table.column("at").to_numpy().astype(np.int64)
    first, last = np.full(len(doc), -1), np.full(len(doc), length)
    for off, rows, ends, _ in _shared_nodes(table, length, gram):
        starts = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
        shared = np.minimum.reduceat(doc[rows], starts) != np.maximum.reduceat(doc[rows], starts)
        rows = rows[np.repeat(shared, np.diff(np.append(starts, len(rows))))]
        first[rows], last[rows] = np.maximum(first[rows], off), np.minimum(last[rows], off)
    met = np.flatnonzero(first >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(doc[met]), pa.array((at - first)[met].astype(np.int32)), pa.array((at + length - last)[met].astype(np.int32))], names=["doc_id", "lo", "hi"])


def _slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` pairs each."""
    total = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _in_partitions(rows: DataFrame, found: Callable[[pa.Table, int, int], Iterator[pa.RecordBatch]], schema: str, length: int, gram: int) -> DataFrame:
    """``found`` over whole partitions, several at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("k0", "k1", "lo")])
                other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
                if len(other):  # the last partition may go on
                    cut = int(other[-1]) + 1
                    yield from found(table.slice(0, cut), length, gram)
                    held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from found(pa.Table.from_batches(held), length, gram)

    return rows.select("k0", "k1", "lo", "hi", "doc_id", "at", "left", "around").repartition("k0", "k1", "lo").sortWithinPartitions("k0", "k1", "lo").mapInArrow(run, schema)


def partitions(rows: DataFrame, *, length: int, gram: int, group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The suffixes in partitions of at most ``group_rows``, and those of larger partitions that are one node for every stretch of their band."""
    back = length - gram
    small, large = [rows.filter(F.col("n") <= group_rows)], rows.filter(F.col("n") > group_rows)
    whole = []
    while large.limit(1).count():
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
        cut = large.withColumn("half", F.explode(halves)).withColumn("lo", F.col("half.lo")).withColumn("hi", F.col("half.hi")).drop("half", "n")
        # Of the stretches that begin lo to hi before the anchor all hold what lies between the last's begin and the first's end.
        cut = cut.filter((F.col("left") >= F.col("lo")) & (F.length("around") - F.col("left") >= length - F.col("hi")))
        prefix = F.expr(f"substring(around, left - lo + 1, lo + {length} - hi)")
        # All that any of them holds: where it is the same in a whole partition, the partition is one node for each of the band's stretches.
        wide = F.when((F.col("left") >= F.col("hi")) & (F.length("around") - F.col("left") >= length - F.col("lo")), F.md5(F.expr(f"substring(around, left - hi + 1, hi + {length} - lo)")))
        cut = materialise(cut.withColumn("wide", wide).withColumn("prefix", prefix).withColumn("k0", F.xxhash64("prefix")).withColumn("k1", F.xxhash64(F.lit(1), "prefix")).drop("prefix"), "halves")
        sizes = cut.groupBy("k0", "k1", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.count("wide").alias("c"), F.min("wide").alias("w0"), F.max("wide").alias("w1"))
        sizes = sizes.filter("d0 < d1").select("k0", "k1", "lo", "n", F.expr("n = c and w0 = w1").alias("one"))
        cut = materialise(cut.drop("wide").join(sizes, ["k0", "k1", "lo"]), "halved")
        done = F.col("one") | (F.col("lo") == F.col("hi"))
        small.append(cut.filter(F.col("n") <= group_rows).drop("one"))
        before = F.when(F.col("left") > F.col("hi"), F.expr("substring(around, left - hi, 1)"))
        whole.append(cut.filter((F.col("n") > group_rows) & done).select("k0", "k1", "lo", "hi", "n", "doc_id", "at", before.alias("before")))
        large = cut.filter((F.col("n") > group_rows) & ~done).drop("one")
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, whole) if whole else None


BLOCK_ROWS = 2_000


def _whole_pairs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """All pairs of each large node, which are its result, block by block of its members, so that no task meets a node."""
    side = rows.select("k0", "k1", "lo", "hi", "n", "doc_id", "before").withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    side = side.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    a = side.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)))
    b = side.withColumn("other", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("part"))))
    met = a.alias("a").join(b.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("k0", "k1", "lo", "part", "other")])
    further = F.col("a.before").eqNullSafe(F.col("b.before")) & F.col("a.before").isNotNull() & (F.col("a.hi") < length - gram)
    met = met.filter((F.col("a.doc_id") != F.col("b.doc_id")) & ~further)
    return met.select(F.least("a.doc_id", "b.doc_id").alias("doc_id_a"), F.greatest("a.doc_id", "b.doc_id").alias("doc_id_b"))


def copies(documents: DataFrame, length: int) -> DataFrame:
    """(rep, doc_id): members of each group of equal texts, the representative among them."""
    sums = documents.filter(F.length("text") >= length).select("doc_id", F.md5("text").alias("m"), F.length("text").alias("n")).filter("doc_id is not null").distinct()
    reps = sums.groupBy("m", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).filter("rep < most")
    return sums.join(reps, ["m", "n"]).select("rep", "doc_id", F.col("n").alias("chars"))


def _suffixes(documents: DataFrame, members: DataFrame, *, length: int, gram: int) -> DataFrame:
    """(k0, k1, lo, hi, n, doc_id, at, left, around): suffixes whose gram two texts hold, among representatives of equal texts."""
    docs = documents.select("doc_id", "text").filter("doc_id is not null").join(members.filter("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    places = materialise(suffix_anchors(docs, length, gram).distinct(), "anchors")
    groups = places.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).filter("d0 < d1").select("h", "n")
    met = places.join(groups, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "at", "n")).alias("places"))
    back = length - gram
    around = documents.select("doc_id", "text").join(met, "doc_id").select("doc_id", "text", F.explode("places").alias("p")).select(
        F.col("p.h").alias("k0"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).alias("lo"), F.lit(back).alias("hi"), "p.n", "doc_id", "p.at", F.least(F.lit(back), F.col("p.at")).alias("left"),
        F.expr(f"substring(text, p.at - least({back}, p.at) + 1, least({back}, p.at) + {length})").alias("around"),
    )
    return materialise(around, "around")


def sharing_pairs(documents: DataFrame, *, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of documents with a common stretch, copies included."""
    members = materialise(copies(documents, length), "copies")
    small, whole = partitions(_suffixes(documents, members, length=length, gram=gram), length=length, gram=gram, group_rows=group_rows)
    pairs = _in_partitions(small, _pairs_of, "doc_id_a bigint, doc_id_b bigint", length, gram)
    if whole is not None:
        pairs = pairs.unionByName(_whole_pairs(whole, length, gram))
    pairs = materialise(pairs.distinct(), "pairs")
    for side in ("doc_id_a", "doc_id_b"):
        same = members.select(F.col("rep").alias(side), F.col("doc_id").alias("member"))
        pairs = pairs.join(same, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    other = members.select("rep", F.col("doc_id").alias("other"))
    within = members.join(other, "rep").filter("doc_id < other").select(F.col("doc_id").alias("doc_id_a"), F.col("other").alias("doc_id_b"))
    return pairs.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b")).unionByName(within)


def shared_stretches(documents: DataFrame, *, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, start, chars): the parts of each document that stretches of ``length`` found in others cover, touching ones as one; no pair is made."""
    members = materialise(copies(documents, length), "copies")
    small, whole = partitions(_suffixes(documents, members, length=length, gram=gram), length=length, gram=gram, group_rows=group_rows)
    covers = _in_partitions(small, _covers_of, "doc_id bigint, lo int, hi int", length, gram)
    if whole is not None:
        covers = covers.unionByName(whole.select("doc_id", (F.col("at") - F.col("hi")).alias("lo"), (F.col("at") + length - F.col("lo")).alias("hi")))
    # What a representative shares, its copies share at the same places; copies share all.
    covers = covers.join(members.select("doc_id"), "doc_id", "left_anti").unionByName(members.select("doc_id", F.lit(0).alias("lo"), F.col("chars").alias("hi"))).distinct()
    before = Window.partitionBy("doc_id").orderBy("lo", "hi")
    reach = F.max("hi").over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs = covers.withColumn("begins", (reach.isNull() | (F.col("lo") > reach)).cast("int")).withColumn("run", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo")).alias("chars")).drop("run")


def shared_parts(documents: DataFrame, *, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, chars, shared_chars, share): how much of each document stands in others."""
    covered = shared_stretches(documents, length=length, gram=gram, group_rows=group_rows).groupBy("doc_id").agg(F.sum("chars").alias("covered"))
    docs = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).filter("doc_id is not null").groupBy("doc_id").agg(F.max("chars").alias("chars"))
    shared = F.coalesce("covered", F.lit(0)).cast("bigint")
    return docs.join(covered, "doc_id", "left").select("doc_id", F.col("chars").cast("bigint").alias("chars"), shared.alias("shared_chars"), F.round(F.coalesce(F.try_divide(shared, F.col("chars")), F.lit(0.0)), 6).alias("share"))
