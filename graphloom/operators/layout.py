"""Views for people: treemaps, levels of detail, tours, complexity of syntax trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import _doubling, forest, numbered
from graphloom.plans.shared import materialise

# Most rows of a view, by level of detail.
BUDGETS = {"overview": 60, "layer": 300, "module": 500, "file": 800}


def squarified(sizes: list[float], x: float = 0.0, y: float = 0.0, w: float = 1.0, h: float = 1.0) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) for sizes in descending order, as square as the greedy row rule makes them."""
    total = sum(sizes)
    if not sizes or total <= 0:
        return [(x, y, 0.0, 0.0) for _ in sizes]
    areas = [s * w * h / total for s in sizes]
    out, i = [], 0
    while i < len(areas):
        side = min(w, h)
        row = [areas[i]]
        worst = lambda r: max(max(side * side * a / sum(r) ** 2, sum(r) ** 2 / (side * side * a)) for a in r if a > 0) if sum(r) > 0 else 0.0
        j = i + 1
        while j < len(areas) and areas[j] > 0 and worst([*row, areas[j]]) <= worst(row):
            row.append(areas[j])
            j += 1
        thick = sum(row) / side if side else 0.0
        at = 0.0
        for a in row:
            long = a / thick if thick else 0.0
            out.append((x, y + at, thick, long) if w >= h else (x + at, y, long, thick))
            at += long
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        i = j
    return out


def treemap(items: DataFrame, container: str, item: str, size: str) -> DataFrame:
    """(container, item, x, y, w, h): all of each container's members, laid out in the unit square with areas in proportion to their sizes.

    One task lays out at most a view's budget of boxes: a container with more
    is cut by rank into blocks of that many members, the blocks into blocks of
    blocks, and each block is laid out inside the tile its total size has got.
    Null sizes count as 0.
    """
    kinds, most = dict(items.dtypes), BUDGETS["file"]
    w = Window.partitionBy(container).orderBy(F.col("__size").desc(), item)
    sized = items.select(container, item, F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("__size"))
    ranked = materialise(sized.withColumn("__r", F.row_number().over(w).cast("bigint") - 1), "treemap")
    last = ranked.agg(F.max("__r")).first()[0] or 0
    group = [container, "__up"]

    def laid(members: DataFrame, tiles: DataFrame | None, member: str, kind: str) -> DataFrame:
        def lay(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["__size", member], ascending=[False, True])
            boxes = squarified(pdf["__size"].tolist(), *pdf[["__x", "__y", "__w", "__h"]].iloc[0])
            return pd.DataFrame({container: pdf[container], member: pdf[member], **{c: [b[k] for b in boxes] for k, c in enumerate("xywh")}})

        if tiles is None:
            members = members.withColumns({"__x": F.lit(0.0), "__y": F.lit(0.0), "__w": F.lit(1.0), "__h": F.lit(1.0)})
        else:
            tiles = tiles.select(F.col(container).alias("__c"), F.col("__block").alias("__b"), *(F.col(c).alias(f"__{c}") for c in "xywh"))
            members = members.join(tiles, F.col(container).eqNullSafe(F.col("__c")) & (F.col("__up") == F.col("__b"))).drop("__c", "__b")
        return members.groupBy(*group).applyInPandas(lay, f"{container} {kinds[container]}, {member} {kind}, x double, y double, w double, h double")

    step, steps = most, []
    while step <= last:
        steps.append(step)
        step *= most
    tiles = None
    for step in reversed(steps):
        blocks = ranked.groupBy(container, F.expr(f"__r div {step}").alias("__block")).agg(F.sum("__size").alias("__size"))
        tiles = laid(blocks.withColumn("__up", F.expr(f"__block div {most}")), tiles, "__block", "bigint")
    return laid(ranked.withColumn("__up", F.expr(f"__r div {most}")), tiles, item, kinds[item])


def level_of_detail(rows: DataFrame, level: str, order: list) -> tuple[DataFrame, DataFrame]:
    """The first rows of a view within its budget, and (total_available, truncated)."""
    budget = BUDGETS[level]
    return rows.orderBy(*order).limit(budget), rows.agg(F.count("*").alias("total_available")).withColumn("truncated", F.col("total_available") > budget)


def tour(nodes: DataFrame, edges: DataFrame, *, steps: int = 7) -> DataFrame:
    """(position, node, why): entry points first, tests last, then by degree; empty when there is nothing to show.

    nodes (node, entry, test).
    """
    degree = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    ranked = nodes.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = ranked.orderBy(F.col("test"), F.col("entry").desc(), F.col("degree").desc(), "node").limit(steps)
    w = Window.orderBy(F.col("test"), F.col("entry").desc(), F.col("degree").desc(), "node")
    return top.select(F.row_number().over(w).alias("position"), "node", F.when(F.col("entry"), "entry point").otherwise("central").alias("why"))


def components(files: DataFrame) -> DataFrame:
    """(repo_id, root, evidence): deployable parts by the first evidence a folder has: explicit file, Dockerfile, entry point, library manifest."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    rank = F.when(name == "component.yaml", 0).when(F.lower(name) == "dockerfile", 1).when(name.rlike(r"^(main\.(go|rs|py)|__main__\.py|index\.[jt]s)$"), 2).when(name.isin("package.json", "Cargo.toml", "go.mod", "pom.xml", "pyproject.toml"), 3)
    f = files.select("repo_id", F.regexp_replace("path", r"(^|/)[^/]*$", "").alias("root"), rank.alias("rank")).filter("rank is not null")
    g = f.groupBy("repo_id", "root").agg(F.min("rank").alias("rank"))
    return g.select("repo_id", "root", F.element_at(F.array(*map(F.lit, ("explicit", "dockerfile", "entry", "library"))), F.col("rank") + 1).alias("evidence"))


def complexity(ast: DataFrame, branching: list[str], loops: list[str]) -> DataFrame:
    """(g, cyclomatic, cognitive, loop_depth) of functions over syntax-tree rows (g, id, p, type).

    Cyclomatic is 1 + branching nodes; cognitive adds one plus the branching
    nodes around each; loop depth is the deepest nesting of loops.
    """
    kind = lambda names, c: F.col("name").isin(*names).cast("long").alias(c)
    rows, links = numbered(forest(ast, group="g", node="id", parent="p", name="type"))
    n = rows.select("g", "n", kind(branching, "b"), kind(loops, "l"))
    state = links.select("n", "p").join(n, "n").select("n", "p", F.col("b").alias("around"), F.col("l").alias("depth"))
    placed, _ = _doubling(state, [], {"around": F.col("around") + F.col("b_around"), "depth": F.col("depth") + F.col("b_depth")}, "complexity")
    both = materialise(n.select("g", "n", "b").join(placed.select("n", "around", "depth"), "n"), "complexity")
    return both.groupBy("g").agg((1 + F.sum("b")).alias("cyclomatic"), F.sum(F.col("b") * F.col("around")).alias("cognitive"), F.max("depth").cast("int").alias("loop_depth"))
