"""Parent-child rows to full hierarchies.

Rows are numbered once, so that all later shuffles carry 64-bit numbers and no
ids, and only parents take part in the loops; leaves meet their parent's result
in one join at the end.  Every quantity of a parent is computed by pointer
doubling, so a forest of depth ``d`` takes ``log2(d) + 1`` rounds of equi-joins:

* upward, subtree sizes: after round k a node knows its descendants nearer than
  2^k, and adds what the nodes exactly 2^k below it know;
* among siblings, an exclusive prefix sum of the sizes gives each child its
  offset inside the parent's preorder range (families beyond ``_BUCKET_ROWS``
  by three levels, so that a parent of any number of children never lands in
  one task);
* downward, the offsets are summed along the ancestor chain, which gives
  nested-set ranges, depth, root and path.

A row whose pointer has left the forest is finished and leaves the loop; what
it still receives is added up from a log.  Parents of more than ``HOT_ROWS``
children are salted where children meet them.

Nodes whose pointer never leaves the forest lie on a cycle or below one; among
these the doubled pointers converge to the cycle's own nodes.

Defined results: a null parent, or one that is no node of the group, makes a
root; a node that is its own parent is a cycle of one; null ids are dropped
(they can be neither named nor pointed at), as are rows of a null group; repeated rows of one id count once,
the smallest parent being taken; empty tables give no rows; null names read as
empty path parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.rows import col
from graphloom.plans.shared import materialise, release

_BUCKET_ROWS = 200_000
# Children beyond which a parent is met in several tasks; no more than one parent in so many rows has that many.
HOT_ROWS = 1_000_000


def forest(df: DataFrame, *, group: str, node: str, parent: str, name: str | None = None, once: bool = False) -> DataFrame:
    """(g, id, p, name): one row per node with the parent it names; ``once``: ids are known to be unique in their group."""
    rows = df.select(col(group).alias("g"), col(node).alias("id"), col(parent).alias("p"), (col(name) if name else F.lit(None).cast("string")).alias("name"))
    rows = rows.filter("id is not null and g is not null")
    return rows if once else rows.groupBy("g", "id").agg(F.min("p").alias("p"), F.min("name").alias("name"))


def _salted(children: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``children`` with a salt, above 0 only below the parents of ``hot`` (keys, salts)."""
    out = children.join(F.broadcast(hot), keys, "left")
    return out.withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("n"), F.col("salts"))).cast("int")).drop("salts")


def _salts(parents: DataFrame) -> DataFrame:
    return parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.floor(F.col("k") / HOT_ROWS).cast("int"))))


def _hot(parents: DataFrame, keys: list[str]) -> DataFrame:
    return parents.filter(F.col("k") >= HOT_ROWS).select(*keys, (F.floor(F.col("k") / HOT_ROWS) + 1).alias("salts"))


def numbered(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``forest``'s rows (g, id, p, name, kids, n) and its links (n, h, p, kids, g).

    In links, p is the parent's number, null for roots, which alone keep their
    group; h is the hashed id; kids is null for leaves.
    """
    base = materialise(tree, "forest")
    asked = base.filter("p is not null").groupBy(F.col("g").alias("k_g"), F.col("p").alias("k_p")).agg(F.count("*").alias("kids"))
    rows = base.join(asked, (F.col("g") == F.col("k_g")) & (F.col("id") == F.col("k_p")), "left").drop("k_g", "k_p")
    rows = materialise(rows.withColumn("n", F.monotonically_increasing_id()), "numbered")
    release(base)
    parents = rows.filter("kids is not null").select("g", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("kids").alias("k"))
    link = ["n", F.xxhash64("id").alias("h"), "kids"]
    children = _salted(rows.filter("p is not null").select("g", "p", *link), _hot(parents, ["g", "p"]), ["g", "p"])
    found = children.join(_salts(parents), ["g", "p", "salt"], "left")
    roots = rows.filter("p is null").select(*link, F.lit(None).cast("bigint").alias("p"), "g")
    links = found.select("n", "h", "kids", F.col("pn").alias("p"), F.when(F.col("pn").isNull(), F.col("g")).alias("g")).unionByName(roots)
    return rows, materialise(links, "links")


def _doubling(state: DataFrame, sums: list[str], along: dict[str, Column], tag: str) -> tuple[DataFrame, DataFrame | None]:
    """Rounds of pointer doubling until no pointer is left or only cycles remain.

    ``state`` has n, p; ``sums`` are added from descendants; ``along`` says how
    a column of the node and of its pointer's target (as b_<c>) combine.
    Returns the finished rows and, if cycles remain, the rows that never finish.
    """
    state = materialise(state, tag)
    done = [state.filter("p is null")]
    live = state.filter("p is not null")
    sent = []
    active = live.count()
    while active:
        ahead = (reduce(DataFrame.unionByName, [*done, live]) if along else live).select(F.col("n").alias("b_n"), F.col("p").alias("b_p"), *(F.col(c).alias("b_" + c) for c in along))
        after = live.join(ahead, F.col("p") == F.col("b_n"), "left")
        after = after.select("n", F.col("b_p").alias("p"), *(x.alias(c) for c, x in along.items()), *(c for c in state.columns if c not in ("n", "p", *along)))
        if sums:
            up = live.groupBy(F.col("p").alias("n")).agg(*(F.sum(c).alias("u_" + c) for c in sums))
            sent.append(up)
            after = after.join(up, "n", "left").select(*(c for c in state.columns if c not in sums), *((F.col(c) + F.coalesce("u_" + c, F.lit(0))).alias(c) for c in sums))
        after = materialise(after.select(*state.columns), tag)
        done.append(after.filter("p is null"))
        live = after.filter("p is not null")
        left = live.count()
        if left == active:
            break
        active = left
    finished = reduce(DataFrame.unionByName, done)
    if sums and sent:
        # A row that finished in round k has had what came up to round k; the rest is in the log.
        first = reduce(DataFrame.unionByName, [d.select("n", F.lit(k).alias("k")) for k, d in enumerate(done)])
        late = reduce(DataFrame.unionByName, [u.withColumn("k", F.lit(k)) for k, u in enumerate(sent)])
        late = late.join(first.withColumnRenamed("k", "own"), "n").filter("k >= own").groupBy("n").agg(*(F.sum("u_" + c).alias("u_" + c) for c in sums))
        finished = finished.join(late, "n", "left").select(*(c for c in state.columns if c not in sums), *((F.col(c) + F.coalesce("u_" + c, F.lit(0))).alias(c) for c in sums))
    return finished, live if active else None


def cycle_roots(nodes: DataFrame) -> DataFrame:
    """(n, root): for the parents on or below cycles (n, p, id), the smallest id on the cycle."""
    state = materialise(nodes.select("n", "p", F.col("id").alias("m")), "cycles")
    image = state.select("p").distinct().count()
    while True:
        ahead = state.select(F.col("n").alias("b_n"), F.col("p").alias("b_p"), F.col("m").alias("b_m"))
        after = state.join(ahead, F.col("p") == F.col("b_n"))
        after = materialise(after.select("n", F.col("b_p").alias("p"), F.least("m", "b_m").alias("m"), (F.col("b_m") < F.col("m")).alias("moved")), "cycles")
        on_cycle = after.select(F.col("p").alias("n")).distinct()
        now, moved = on_cycle.count(), after.filter("moved").join(on_cycle, "n", "left_semi").limit(1).count()
        release(state)
        state = after.drop("moved")
        state._graphloom_path = after._graphloom_path
        if now == image and not moved:
            break
        image = now
    ahead = state.select(F.col("n").alias("b_n"), F.col("m").alias("root"))
    return state.join(ahead, F.col("p") == F.col("b_n")).select("n", "root")


def sibling_offsets(sized: DataFrame, big: DataFrame) -> DataFrame:
    """(..., offset): exclusive prefix sums of ``size`` among rows of one parent p, or of one group g where p is null, by (h, n).

    ``big`` (g, p, parts) names the families of more than ``_BUCKET_ROWS`` and the
    parts to cut them into, by their hashes; the parts' totals are summed first,
    in blocks, then each part on its own.  Of both there is no more than one in
    ``_BUCKET_ROWS`` rows.
    """
    key = lambda a, b: F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g")) & F.col(f"{a}.p").eqNullSafe(F.col(f"{b}.p"))
    ahead = lambda c, keys, by: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sized.alias("a").join(F.broadcast(big).alias("b"), key("a", "b"), "left")
    place = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("parts"))
    cut = cut.select("a.*", F.coalesce(place, F.lit(0)).cast("bigint").alias("bucket"), F.col("parts").isNotNull().alias("cut"))
    totals = cut.filter("cut").groupBy("g", "p", "bucket").agg(F.sum("size").alias("t")).withColumn("block", F.floor(F.col("bucket") / 1024))
    blocks = totals.groupBy("g", "p", "block").agg(F.sum("t").alias("t")).withColumn("before", ahead("t", ["g", "p"], ["block"]))
    totals = totals.withColumn("inside", ahead("t", ["g", "p", "block"], ["bucket"])).alias("a").join(blocks.alias("b"), key("a", "b") & (F.col("a.block") == F.col("b.block")))
    totals = totals.select("a.g", "a.p", "a.bucket", (F.col("a.inside") + F.col("b.before")).alias("before"))
    inside = cut.withColumn("inside", ahead("size", ["g", "p", "bucket"], ["h", "n"]))
    placed = inside.alias("a").join(F.broadcast(totals).alias("b"), key("a", "b") & (F.col("a.bucket") == F.col("b.bucket")), "left")
    return placed.select(*(F.col(f"a.{c}") for c in sized.columns), (F.col("a.inside") + F.coalesce("b.before", F.lit(0))).alias("offset"))


def _beside(leaves: DataFrame, results: DataFrame, links: DataFrame) -> DataFrame:
    """``leaves`` beside the result (as r_<c>) of their parent p."""
    there = _salts(results.withColumnRenamed("kids", "k")).select(F.col("n").alias("p"), "salt", *(F.col(c).alias("r_" + c) for c in results.columns if c not in ("n", "kids")))
    hot = _hot(links.filter("kids is not null").select(F.col("n").alias("p"), F.col("kids").alias("k")), ["p"])
    return _salted(leaves, hot, ["p"]).join(there, ["p", "salt"]).drop("salt")


def nested_sets(tree: DataFrame, separator: str = "/", *, paths: bool = True) -> DataFrame:
    """(g, id, root, depth, path, low, high, descendants) of a ``forest``; ``path`` is null if not asked for.

    The descendants of a node are the nodes of its group with ``low`` in
    (low, high].  Ranges start at 0 in each group.  Nodes on or below cycles
    have depth -1, null ranges and null path.
    """
    none = F.lit(None).cast("string")
    rows, links = numbered(tree)
    inner = links.filter("kids is not null")
    own = inner.filter("p is not null").groupBy(F.col("p").alias("n")).agg(F.count("*").alias("inner"))
    start = inner.join(own, "n", "left").select("n", "p", (1 + F.col("kids") - F.coalesce("inner", F.lit(0))).alias("size"))
    sized, cyclic = _doubling(start, ["size"], {}, "sizes")
    whole = inner.join(sized.select("n", "size"), "n").unionByName(links.filter("kids is null").withColumn("size", F.lit(1).cast("bigint")))
    family = lambda g, p: (g.alias("g"), p.alias("p"), (F.col("kids") / _BUCKET_ROWS).alias("parts"))
    big = inner.filter(F.col("kids") > _BUCKET_ROWS).select(*family(none, F.col("n")))
    many = links.filter("p is null").groupBy("g").agg(F.count("*").alias("kids")).filter(F.col("kids") > _BUCKET_ROWS)
    placed = sibling_offsets(whole, big.unionByName(many.select(*family(F.col("g"), F.lit(None).cast("bigint")))))
    placed = materialise(placed.withColumn("low", F.col("offset") + F.when(F.col("p").isNull(), 0).otherwise(1)), "placed")
    state = placed.filter("kids is not null").select("n", "p", "size", "kids", F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), "low")
    named = rows.filter("kids is not null").select("n", F.when(F.lit(paths), F.coalesce("name", F.lit(""))).alias("path"), F.col("id").alias("root"))
    state = state.join(named, "n")
    along = {"root": F.col("b_root"), "depth": F.col("depth") + F.col("b_depth"), "low": F.col("low") + F.col("b_low"), "path": F.concat("b_path", F.lit(separator), "path")}
    ranges, _ = _doubling(state, [], along, "ranges")
    leaves = placed.filter("kids is null")
    met = _beside(leaves.filter("p is not null").select("n", "p", "low"), ranges.select("n", "kids", "root", "depth", "low", "path"), links)
    of = lambda root, depth, low, size, path, above: (F.col("n"), root.alias("root"), depth.cast("int").alias("depth"), low.alias("low"), size.cast("bigint").alias("size"), path.alias("path"), above.alias("above"))
    every = ranges.select(*of(F.col("root"), F.col("depth"), F.col("low"), F.col("size"), F.col("path"), none))
    every = every.unionByName(met.select(*of(F.col("r_root"), F.col("r_depth") + 1, F.col("r_low") + F.col("low"), F.lit(1), none, F.col("r_path"))))
    every = every.unionByName(leaves.filter("p is null").select(*of(none, F.lit(0), F.col("low"), F.lit(1), none, none)))
    path = F.coalesce("path", F.concat("above", F.lit(separator), F.coalesce("name", F.lit(""))), F.coalesce("name", F.lit(""))) if paths else none
    out = rows.select("g", "id", "n", *(["name"] if paths else [])).join(every, "n").select(
        "g", "id", F.coalesce("root", "id").alias("root"), "depth", path.alias("path"), "low", (F.col("low") + F.col("size") - 1).alias("high"), (F.col("size") - 1).alias("descendants"),
    )
    if cyclic is None:
        return out
    ids = rows.filter("kids is not null").select("n", "id")
    loops = materialise(cycle_roots(inner.join(cyclic.select("n"), "n", "left_semi").join(ids, "n").select("n", "p", "id")), "loops")
    kids = loops.join(links.select("n", "kids"), "n")
    met = _beside(links.filter("kids is null and p is not null").select("n", "p"), kids, links)
    loose = rows.select("g", "id", "n").join(loops.unionByName(met.select("n", F.col("r_root").alias("root"))), "n")
    lost = lambda kind, *names: (F.lit(None).cast(kind).alias(c) for c in names)
    return out.unionByName(loose.select("g", "id", "root", F.lit(-1).alias("depth"), *lost("string", "path"), *lost("bigint", "low", "high", "descendants")))


def roots_and_depths(tree: DataFrame) -> DataFrame:
    """(g, id, root, depth) of a ``forest``; nodes on or below cycles have depth -1."""
    return nested_sets(tree, paths=False).select("g", "id", "root", "depth")


def descendants_of(ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """(g, id, descendant) for the nodes (g, id) asked for, read off the nested-set ranges.

    A range is cut into aligned power-of-two blocks; each node meets the blocks
    that hold its position by equality, so no range is ever compared with all nodes.
    """
    r = ranges.filter("low is not null").join(asked.select("g", "id").distinct(), ["g", "id"], "left_semi").filter("high > low")
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("high") - F.col("low") + 1))).cast("bigint")
    cut = r.withColumn("width", width).withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / F.col("width")), F.floor(F.col("high") / F.col("width")))))
    widths = cut.groupBy("g").agg(F.collect_set("width").alias("widths"))
    points = ranges.filter("low is not null").select("g", F.col("id").alias("descendant"), F.col("low").alias("at")).join(widths, "g").withColumn("width", F.explode("widths"))
    points = points.withColumn("block", F.floor(F.col("at") / F.col("width")))
    return cut.join(points, ["g", "width", "block"]).filter("at > low and at <= high").select("g", "id", "descendant")


def latest_nodes(nodes: DataFrame, snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """Valid node rows of each repository's latest snapshot."""
    from graphloom.functions.rows import valid_rows

    last = snapshots.groupBy("repo_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    there = nodes.join(last, ["repo_id", "snapshot_no"], "left_semi")
    keep = [c for c in nodes.columns if c in {"repo_id", "snapshot_no", "node_id", "ingested_at", *columns}]
    return valid_rows(there.select(*keep), ["repo_id", "snapshot_no", "node_id"], "ingested_at")
