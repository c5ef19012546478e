"""Traversal and structure of edge tables (src, dst[, weight, band]).

Every operator works on DataFrames; loops keep their state in written tables,
so plans stay short and lost executors cost one round.  Rounds are bounded by
the depth asked for or by the longest path, and frontiers hold only nodes
reached for the first time.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vocab import band_of_rank, band_rank
from graphloom.plans.shared import materialise, release


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None, *, reverse: bool = False) -> DataFrame:
    """(seed, node, distance): nodes within ``depth`` steps of each seed, or at any distance, nearest distance, the seed itself at 0."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    steps = materialise(edges.select(F.col(near).alias("at"), F.col(far).alias("next")).distinct(), "steps")
    seen = materialise(seeds.select(F.col(seeds.columns[0]).alias("seed"), F.col(seeds.columns[0]).alias("node")).filter("seed is not null").distinct().withColumn("distance", F.lit(0)), "seen")
    frontier = seen
    for d in count(1) if depth is None else range(1, depth + 1):
        new = frontier.join(steps, frontier.node == steps["at"]).select("seed", F.col("next").alias("node")).distinct()
        new = materialise(new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(d)), "frontier")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        frontier = new
    return seen


LOCAL_EDGES = 500_000


def _walked(steps: DataFrame) -> DataFrame:
    """(seed, node, distance) of all pairs of a graph known to be small: each task holds its edges and walks from some of its nodes.

    Walks from a block of nodes go on together, one step at a time.
    """
    import numpy as np
    import pyarrow as pa

    spark, kind = steps.sparkSession, steps.schema["src"].dataType.simpleString()
    held = steps.toArrow()
    coded = pa.concat_arrays([*held["src"].chunks, *held["dst"].chunks] or [pa.array([], held.schema.types[0])]).dictionary_encode(null_encoding="encode")
    names, codes = coded.dictionary, coded.indices.to_numpy().astype("int64")
    src, dst, n = codes[: len(held)], codes[len(held) :], len(names)
    ends, start = dst[np.argsort(src, kind="stable")], np.append(0, np.cumsum(np.bincount(src, minlength=n)))
    seeds = np.unique(src)
    block = max(1, min(1024, 16_000_000 // max(1, n)))

    def walk(row_seed):
        def said():
            row, node, distance = (np.concatenate(c) for c in zip(*pile))
            return pa.RecordBatch.from_arrays([names.take(pa.array(row_seed[row])), names.take(pa.array(node)), pa.array(distance)], ["seed", "node", "distance"])

        seen = np.zeros(len(row_seed) * n, bool)
        row, node, pile, held_rows, d = np.arange(len(row_seed)), row_seed, [], 0, 0
        seen[row * n + node] = True
        while len(node):
            d += 1
            many = start[node + 1] - start[node]
            at = np.repeat(start[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            met = np.repeat(row * n, many) + ends[at]
            met = np.unique(met[~seen[met]])
            seen[met] = True
            row, node = np.divmod(met, n)
            pile.append((row, node, np.full(len(met), d, "int32")))
            held_rows += len(met)
            if held_rows > 500_000:
                yield said()
                pile, held_rows = [], 0
        if held_rows:
            yield said()

    def run(batches):
        for batch in batches:
            mine = seeds[batch.column(0).to_numpy()]
            for i in range(0, len(mine), block):
                yield from walk(mine[i : i + block])

    parts = max(1, min(len(seeds), max(2 * spark.sparkContext.defaultParallelism, len(seeds) // 500)))
    return spark.range(0, len(seeds), 1, parts).mapInArrow(run, f"seed {kind}, node {kind}, distance int")


def _doubled(steps: DataFrame) -> DataFrame:
    """(seed, node, distance) of all pairs, in log2 of the greatest distance rounds: who is 2^k away is joined with all that is up to 2^k further."""
    pairs = materialise(steps.filter("not src <=> dst").select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.lit(1).alias("distance")), "pairs")
    far = 1
    while not (edge := pairs.filter(F.col("distance") == far).select("seed", F.col("node").alias("via"))).isEmpty():
        ahead = pairs.select(F.col("seed").alias("via"), "node", (F.col("distance") + far).alias("distance"))
        more = edge.join(ahead, "via").filter("not seed <=> node").select("seed", "node", "distance")
        longer = materialise(pairs.unionByName(more).groupBy("seed", "node").agg(F.min("distance").alias("distance")), "pairs")
        release(pairs)
        pairs, far = longer, 2 * far
    return pairs


def hierarchy_levels(parents: DataFrame, depth: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, ancestor, level) over (child, parent) rows with any number of parents, nearest level first, cycle-safe.

    Without a depth, the rows go to every task if they are *counted* to be at
    most ``local_edges``; beyond that distances are doubled.
    """
    level = lambda df: df.select(F.col("seed").cast(parents.schema["child"].dataType).alias("node"), F.col("node").alias("ancestor"), F.col("distance").alias("level"))
    e = parents.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    if depth is not None:
        return level(reach(e, parents.select("child"), depth).filter("distance > 0"))
    kind = e.select("src").union(e.select("dst")).schema["src"].dataType
    steps = materialise(e.filter("src is not null").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).distinct(), "steps")
    return level(_walked(steps) if steps.count() <= local_edges else _doubled(steps))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within 1 to 3 undirected hops (other values are clamped)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(both, seeds, max(1, min(3, hops)))


def call_chain(edges: DataFrame, seeds: DataFrame, depth: int, *, callers: bool = True) -> DataFrame:
    """(caller, callee, depth): the edges of simple paths from the seeds, one row per edge and depth.

    Paths over the same nodes that end in the same node go on alike, so one of them is kept.
    """
    depth = max(1, min(10, depth))
    near, far = ("dst", "src") if callers else ("src", "dst")
    e = materialise(edges.select("src", "dst").distinct(), "steps")
    paths = seeds.select(F.col(seeds.columns[0]).alias("at")).distinct().withColumn("path", F.array("at"))
    out = None
    for d in range(1, depth + 1):
        step = paths.join(e, paths["at"] == e[near]).filter(~F.array_contains("path", F.col(far)))
        step = materialise(step.select("src", "dst", F.lit(d).alias("depth"), F.col(far).alias("at"), F.array_append("path", F.col(far)).alias("path")), "chain")
        rows = step.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "depth")
        out = rows if out is None else out.unionByName(rows)
        paths = step.select("at", F.array_sort("path").alias("path")).distinct()
    return out.distinct()


def traces(edges: DataFrame, src: object, dst: object, *, depth: int = 8, most: int = 5) -> DataFrame:
    """(length, path): up to ``most`` shortest simple paths; only nodes that can still arrive are walked."""
    e = materialise(edges.select("src", "dst").distinct(), "steps")
    spark = edges.sparkSession
    target = spark.createDataFrame([(dst,)], ["seed"])
    left = materialise(reach(e, target, depth, reverse=True).select(F.col("node").alias("dst"), F.col("distance").alias("left")), "left")
    paths = spark.createDataFrame([(src,)], ["at"]).withColumn("path", F.array("at"))
    found = None
    for d in range(1, depth + 1):
        step = paths.join(e, paths["at"] == e["src"]).join(left, "dst").filter((F.col("left") <= depth - d) & ~F.array_contains("path", F.col("dst")))
        step = materialise(step.select(F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path")), "trace")
        done = step.filter(F.col("at") == F.lit(dst)).select(F.lit(d).alias("length"), "path")
        found = done if found is None else found.unionByName(done)
        if found.count() >= most:  # later ones are longer
            break
        paths = step.filter(F.col("at") != F.lit(dst))
    return found.orderBy("length", "path").limit(most)


def lift_edges(edges: DataFrame, visible: DataFrame, *, kind: str | None = None) -> DataFrame:
    """(src, dst[, kind], n, weight, worst_band): edges between the nearest visible ancestors of their ends.

    ``visible`` has (node, shown).  Ends without a visible ancestor and edges inside one are dropped.
    """
    a, b = visible.select(F.col("node").alias("src"), F.col("shown").alias("s")), visible.select(F.col("node").alias("dst"), F.col("shown").alias("d"))
    lifted = edges.join(a, "src").join(b, "dst").filter("s <> d")
    keys = [F.col("s").alias("src"), F.col("d").alias("dst"), *([F.col(kind)] if kind else [])]
    n = F.sum("weight") if "weight" in edges.columns else F.count("*")
    aggs = [n.cast("bigint").alias("n")]
    if "band" in edges.columns:
        aggs.append(band_of_rank(F.min(band_rank(F.col("band")))).alias("worst_band"))
    return lifted.groupBy(*keys).agg(*aggs).withColumn("weight", F.least(F.lit(1.0), F.col("n") / 10))


def nearest_visible(parents: DataFrame, shown: DataFrame, nodes: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, shown): each node's nearest ancestor, itself included, among ``shown``; the least of several as near.

    ``parents`` are (child, parent) rows with any number of parents, cycles too.
    What is shown spreads downward, and a node that has its nearest takes no
    other, so no list of all ancestors is made.  Rows go to one task if they are
    *counted* to be at most ``local_edges``; beyond that, each round settles the
    nodes one level further down.
    """
    own = shown.select("node").filter("node is not null").distinct()
    steps = parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")).filter("src is not null and dst is not null").distinct()
    live = materialise(steps.withColumn("step", F.lit(True)).union(own.select("node", "node", F.lit(False))), "shown")
    if live.count() <= local_edges:
        found = _local_spread(live)
    else:
        found = frontier = materialise(live.filter("not step").select(F.col("src").alias("node"), F.col("dst").alias("shown")), "shown")
        steps = live.filter("step").select(F.col("src").alias("child"), F.col("dst").alias("node"))
        while True:
            new = frontier.join(steps, "node").groupBy(F.col("child").alias("node")).agg(F.min("shown").alias("shown"))
            new = materialise(new.join(found.select("node"), "node", "left_anti"), "shown")
            if new.isEmpty():
                break
            found, frontier = found.unionByName(new), new
    return found.join(nodes.select("node").union(parents.select("child")).distinct(), "node", "left_semi")


def _local_spread(live: DataFrame) -> DataFrame:
    """(node, shown) over rows (src, dst, step) known to be few: steps to a parent, or else what is shown; in one task."""
    kind = live.schema["src"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        below: dict = {}
        best: dict = {}
        for f in batches:
            for a, b, step in zip(f["src"].tolist(), f["dst"].tolist(), f["step"].tolist()):
                if step:
                    below.setdefault(b, []).append(a)
                else:
                    best[a] = a
        level = dict(best)
        while level:
            new: dict = {}
            for node, least in level.items():
                for child in below.get(node, ()):
                    if child not in best and (child not in new or least < new[child]):
                        new[child] = least
            best.update(new)
            level = new
        yield pd.DataFrame({"node": list(best), "shown": list(best.values())})

    return live.coalesce(1).mapInPandas(run, f"node {kind}, shown {kind}")


def _local_components(live: DataFrame) -> DataFrame:
    """Components of a graph known to be small, by one depth-first pass in one task."""
    kind = live.schema["src"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        frames = [b for b in batches if len(b)]
        ahead: dict = {}
        for f in frames:
            for a, b in zip(f["src"], f["dst"]):
                ahead.setdefault(a, []).append(b)
                ahead.setdefault(b, [])
        index: dict = {}
        low: dict = {}
        stack, held, out = [], set(), []
        for start in ahead:
            if start in index:
                continue
            work = [(start, iter(ahead[start]))]
            index[start] = low[start] = len(index)
            stack.append(start)
            held.add(start)
            while work:
                node, todo = work[-1]
                for nxt in todo:
                    if nxt not in index:
                        index[nxt] = low[nxt] = len(index)
                        stack.append(nxt)
                        held.add(nxt)
                        work.append((nxt, iter(ahead[nxt])))
                        break
                    if nxt in held:
                        low[node] = min(low[node], index[nxt])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == index[node]:
                        members = []
                        while True:
                            x = stack.pop()
                            held.discard(x)
                            members.append(x)
                            if x == node:
                                break
                        out += [(x, max(members)) for x in members]
        yield pd.DataFrame(out, columns=["node", "component"])

    return live.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): component is the greatest node that reaches the others and back.

    Nodes without edges in or out of the rest leave first.  What is left goes to
    one task if it is counted to be small (``local_edges``); beyond that greatest
    labels spread forward, and inside one colour what reaches the label's own
    node backward is its component.  Each round settles at least the component
    of the greatest label, so rounds end; more than ``most_rounds``, where it is
    given, raise an error.
    """
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    every = e.select(F.col("src").alias("node")).union(e.select("dst"))
    if nodes is not None:
        every = every.union(nodes.select(nodes.columns[0]))
    every = materialise(every.distinct(), "scc-nodes")
    live = materialise(e.filter("src <> dst"), "scc-edges")
    out, rounds = None, 0
    while True:
        while True:  # trim
            trimmed = live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            trimmed = materialise(trimmed.join(trimmed.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "scc-edges")
            before, after = live.count(), trimmed.count()
            release(live)
            live = trimmed
            if before == after:
                break
        if not after:
            break
        if after <= local_edges:
            found = _local_components(live)
            out = found if out is None else out.unionByName(found)
            break
        if rounds == most_rounds:
            raise RuntimeError(f"{after} edges are left after {rounds} rounds of colours")
        rounds += 1
        color = materialise(live.select(F.col("src").alias("node")).union(live.select("dst")).distinct().withColumn("color", F.col("node")), "scc-color")
        changed = color
        while True:
            offers = changed.join(live, changed.node == live.src).groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("offer"))
            step = color.join(offers, "node", "left").select("node", F.greatest("color", F.coalesce("offer", "color")).alias("color"), (F.col("offer") > F.col("color")).alias("moved"))
            step = materialise(step, "scc-color")
            release(color)
            color = step.select("node", "color")
            color._graphloom_path = step._graphloom_path
            changed = step.filter("moved").select("node", "color")
            if changed.isEmpty():
                break
        tagged = live.join(color.select(F.col("node").alias("src"), "color"), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("color2")), "dst").filter("color = color2")
        tagged = materialise(tagged.select("src", "dst", "color"), "scc-tagged")
        part = color.filter("node = color").select("node", F.col("color").alias("component"))
        found = materialise(part, "scc-found")
        frontier = found
        while True:
            new = frontier.join(tagged, (frontier.node == tagged.dst) & (frontier.component == tagged.color)).select(F.col("src").alias("node"), "component").distinct()
            new = materialise(new.join(found.select("node"), "node", "left_anti"), "scc-found")
            if new.isEmpty():
                break
            found, frontier = found.unionByName(new), new
        out = found if out is None else out.unionByName(found)
        rest = live.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        live = materialise(rest, "scc-edges")
    if out is None:
        return every.select("node", F.col("node").alias("component"))
    return every.join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def recursive_nodes(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(node): members of a component of several nodes, or nodes that call themselves."""
    several = components.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return components.join(several, "component", "left_semi").select("node").union(edges.filter("src = dst").select("src")).distinct()


def reachable_max(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): the greatest value reachable along edges, the node's own included; cycles need no condensing, since maxima only grow."""
    e = materialise(edges.select("src", "dst").distinct(), "steps")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).union(values.select("node")).distinct()
    state = materialise(nodes.join(values.select("node", "value"), "node", "left"), "max")
    moved = state.filter("value is not null")
    while not moved.isEmpty():
        offers = moved.join(e, moved.node == e.dst).groupBy(F.col("src").alias("node")).agg(F.max("value").alias("offer"))
        step = materialise(state.join(offers, "node", "left").select("node", F.greatest("value", "offer").alias("value"), F.coalesce((F.col("value").isNull() & F.col("offer").isNotNull()) | (F.col("offer") > F.col("value")), F.lit(False)).alias("moved")), "max")
        release(state)
        state = step.select("node", "value")
        state._graphloom_path = step._graphloom_path
        moved = step.filter("moved").select("node", "value")
    return state.filter("value is not null")


def feedback_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, src, dst): edges whose removal leaves no cycle, by a greedy order of each component (net outgoing weight, then node).

    Of the edges against that order and those along it, the lighter are cut, so never more than half of a component's weight; self-loops are always cut.
    """
    m = components.select("node", "component")
    inside = edges.join(m.select(F.col("node").alias("src"), "component"), "src").join(m.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").filter("component = c2").select("component", "src", "dst", "weight")
    net = inside.select("component", F.col("src").alias("node"), F.col("weight").alias("w")).union(inside.select("component", "dst", -F.col("weight"))).groupBy("component", "node").agg(F.sum("w").alias("net"))
    a = net.select(F.col("node").alias("src"), F.col("net").alias("sn"))
    b = net.select(F.col("node").alias("dst"), F.col("net").alias("dn"))
    placed = inside.join(a, "src").join(b, "dst")
    placed = placed.withColumn("against", F.expr("sn < dn or (sn = dn and src >= dst)")).withColumn("loop", F.col("src") == F.col("dst"))
    light = placed.filter("not loop").groupBy("component").agg(F.sum(F.when(F.col("against"), F.col("weight")).otherwise(-F.col("weight"))).alias("excess"))
    cut = placed.join(light, "component", "left")
    return cut.filter("loop or against = (coalesce(excess, 0) <= 0)").select("component", "src", "dst")


def communities(edges: DataFrame, patience: int = 2) -> DataFrame:
    """(node, community): Louvain communities of an undirected weighted graph, named by their least node.

    In each round every node sees the gain of modularity that each neighbour's
    community offers, and half of the nodes, chosen by hash, take the best one
    (the least label wins ties), so that neighbours do not swap for ever.  A
    level ends when modularity has not grown for ``patience`` rounds, its best
    state being kept; communities then become the nodes of the next level, until
    none join.  Rounds are joins on edges; nothing is collected.
    """
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).filter("src is not null and dst is not null and weight > 0")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    graph = materialise(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "louvain")
    whole = graph.agg(F.sum("weight")).first()[0] or 1.0
    member = materialise(graph.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "louvain")
    while True:
        degree = materialise(graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "louvain")
        state = degree.select("node", "k", F.col("node").alias("c"))
        best, best_q, stale = state, None, 0
        for r in count():
            totals = state.groupBy("c").agg(F.sum("k").alias("tot"))
            heard = graph.join(state.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum(F.when(F.col("src") != F.col("dst"), F.col("weight")).otherwise(0.0)).alias("w"), F.sum("weight").alias("all"))
            heard = heard.unionByName(state.select("node", "c", F.lit(0.0).alias("w"), F.lit(0.0).alias("all"))).groupBy("node", "c").agg(F.sum("w").alias("w"), F.sum("all").alias("all"))
            scored = heard.join(totals, "c").join(state.withColumnRenamed("c", "own"), "node").withColumn("at_home", F.col("c") == F.col("own"))
            scored = scored.withColumn("gain", F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("at_home"), F.col("k")).otherwise(0.0)) / whole)
            home = lambda c: F.max(F.when(F.col("at_home"), F.col(c)))
            wish = scored.groupBy("node").agg(
                F.first("k").alias("k"), F.first("own").alias("c"), F.min_by("c", F.struct((-F.round("gain", 12)).alias("g"), F.col("c").alias("c"))).alias("to"),
                (F.max("gain") > home("gain") + 1e-9).alias("gains"), home("all").alias("inside"), home("tot").alias("tot"),
            )
            turn = F.pmod(F.xxhash64(F.col("node"), F.lit(r // 2)), F.lit(2)) == r % 2
            moved = materialise(wish.withColumn("next", F.when(turn & F.col("gains"), F.col("to")).otherwise(F.col("c"))), "louvain")
            told = moved.agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("tot")).alias("squares"), F.count_if("gains").alias("wishes")).first()
            q = (told["inside"] or 0.0) / whole - (told["squares"] or 0.0) / whole**2
            stale = 0 if best_q is None or q > best_q + 1e-9 else stale + 1
            if not stale:
                best, best_q = moved.select("node", "k", "c"), q
            if stale >= patience or not told["wishes"]:
                break
            state = moved.select("node", "k", F.col("next").alias("c"))
        named = best.groupBy("c").agg(F.min("node").alias("name"), F.count("*").alias("n"))
        joined = named.filter("n > 1").limit(1).count()
        if not joined:
            return member.groupBy("community").agg(F.min("node").alias("least")).join(member, "community").select("node", F.col("least").alias("community"))
        step = materialise(best.join(named, "c").select("node", "name"), "louvain")
        member = materialise(member.join(step.withColumnRenamed("node", "community"), "community").select("node", F.col("name").alias("community")), "louvain")
        a, b = step.select(F.col("node").alias("src"), F.col("name").alias("a")), step.select(F.col("node").alias("dst"), F.col("name").alias("b"))
        graph = materialise(graph.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "louvain")


def blast_radius(edges: DataFrame, changed: DataFrame, depth: int, containment: DataFrame, candidates: DataFrame) -> DataFrame:
    """(level, touched, band, edges, unresolved_touched): what a change reaches against the edges, then upward, with counts per band.

    ``edges`` carry a band; ``containment`` has (node, level, owner); ``candidates`` has (owner).
    """
    edges = materialise(edges.select("src", "dst", "band"), "edges")
    touched = materialise(reach(edges, changed, depth, reverse=True).groupBy("node").agg(F.min("distance").alias("distance")), "touched")
    by_band = edges.join(touched.select(F.col("node").alias("dst")), "dst", "left_semi").join(touched.select(F.col("node").alias("src")), "src", "left_semi").groupBy("band").agg(F.count("*").alias("edges"))
    owners = containment.join(touched.select("node"), "node", "left_semi").groupBy("level").agg(F.count_distinct("owner").alias("touched"))
    unresolved = candidates.join(containment.join(touched.select("node"), "node", "left_semi").select("owner").distinct(), "owner", "left_semi").agg(F.count("*").alias("n"))
    rows = owners.select(F.concat(F.lit("level:"), "level").alias("measure"), F.col("touched").cast("bigint").alias("n"))
    rows = rows.unionByName(by_band.select(F.concat(F.lit("band:"), "band").alias("measure"), F.col("edges").alias("n")))
    rows = rows.unionByName(touched.select(F.lit("symbols").alias("measure")).groupBy("measure").agg(F.count("*").alias("n")))
    return rows.unionByName(unresolved.select(F.lit("unresolved_touched").alias("measure"), "n"))


def degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): summed weights, zero included; a self-call counts both ways."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("fan_in"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return nodes.select("node").join(into, "node", "left").join(out, "node", "left").select("node", zero("fan_in"), zero("fan_out"))


def importance(fan_in: Column, public: Column, test: Column) -> Column:
    """sqrt(fan_in) x 1.0 or 0.6 (not public or unknown) x 0.3 for tests."""
    return F.sqrt(fan_in) * F.when(public, 1.0).otherwise(0.6) * F.when(test, 0.3).otherwise(1.0)


def path_prefixes(paths: DataFrame, group: str, path: str) -> DataFrame:
    """(g, folder, parent, depth): every folder implied by the paths, '' being the root."""
    parts = F.split(F.col(path), "/")
    each = paths.select(F.col(group).alias("g"), parts.alias("parts")).filter("size(parts) > 1")
    each = each.select("g", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.slice("parts", 1, k))).alias("f"))
    return each.select("g", F.array_join("f", "/").alias("folder"), F.array_join(F.slice("f", 1, F.size("f") - 1), "/").alias("parent"), F.size("f").alias("depth")).distinct()


def first_by(df: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")
