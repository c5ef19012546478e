"""Derived structure: containment, tests, roles, entry points, containers, flows, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import identity
from graphloom.functions.vocab import is_drawn, path_role
from graphloom.plans.shared import materialise

# File names that mark tests, by language.
TEST_FILES = {
    "python": r"(^|/)(test_[^/]*|[^/]*_test)\.py$|(^|/)conftest\.py$", "go": r"_test\.go$", "java": r"(^|/)src/test/|(Test|Tests|IT)\.java$",
    "javascript": r"\.(test|spec)\.[cm]?jsx?$|(^|/)__tests__/", "typescript": r"\.(test|spec)\.[cm]?tsx?$|(^|/)__tests__/", "rust": r"(^|/)tests/[^/]*\.rs$",
}


def is_test_path(language: Column, path: Column) -> Column:
    out = path.rlike(r"(^|/)tests?/")
    for lang, pattern in TEST_FILES.items():
        out = F.when(language == lang, path.rlike(pattern) | path.rlike(r"(^|/)tests?/")).otherwise(out)
    return F.coalesce(out, F.lit(False))


def entry_point(kind: Column, name: Column, path: Column) -> Column:
    main = kind.isin("Function", "Method") & name.isin("main", "Main", "__main__")
    return F.coalesce(main | path.rlike(r"(^|/)(__main__\.py|main\.(go|rs|py)|index\.[jt]s)$") & (kind == "File"), F.lit(False))


def layer_role(configured: Column, framework: Column, path: Column, test: Column) -> Column:
    """Configuration decides, then a framework's rule, the path, being a test; a configured 'unknown' is a decision."""
    return F.coalesce(configured, framework, path_role(path), F.when(test, "test"), F.lit("unknown"))


def agreed_role(members: DataFrame, group: list[str], role: str) -> DataFrame:
    """One role per group of files: theirs if they agree, else unknown."""
    g = members.groupBy(*group).agg(F.count_distinct(role).alias("n"), F.min(role).alias("r"))
    return g.select(*group, F.when(F.col("n") == 1, F.col("r")).otherwise("unknown").alias("role"))


def containment(files: DataFrame) -> DataFrame:
    """(repo_id, child, parent, kind) from repository over implied folders to files, each with one parent; '' is the repository."""
    parts = F.split("path", "/")
    f = files.select("repo_id", "path", parts.alias("parts"))
    as_file = f.select("repo_id", F.col("path").alias("child"), F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("parent"), F.lit("File").alias("kind"))
    deep = f.filter("size(parts) > 1").select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.slice("parts", 1, k))).alias("p"))
    folders = deep.select("repo_id", F.array_join("p", "/").alias("child"), F.array_join(F.slice("p", 1, F.size("p") - 1), "/").alias("parent"), F.lit("Folder").alias("kind")).distinct()
    return as_file.distinct().unionByName(folders)


def common_folder(files: DataFrame, group: list[str], path: str) -> DataFrame:
    """The deepest folder that holds all files of a group: the common prefix of the least and the greatest path."""
    g = files.groupBy(*group).agg(F.min(path).alias("a"), F.max(path).alias("b"), F.count("*").alias("files"))
    fold = lambda c: F.slice(F.split(c, "/"), 1, F.size(F.split(c, "/")) - 1)
    g = g.select(*group, "files", fold("a").alias("x"), fold("b").alias("y"))
    n = F.least(F.size("x"), F.size("y"))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & (F.try_element_at("x", (i + 1).cast("int")) != F.try_element_at("y", (i + 1).cast("int"))))
    return g.withColumn("k", F.when(F.size(differ) > 0, F.array_min(differ)).otherwise(n)).select(*group, "files", F.array_join(F.slice("x", 1, F.col("k").cast("int")), "/").alias("folder"))


def materialised(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, candidates) of resolved sites: a drawn band with a target is an edge, all else a candidate row with its reason."""
    drawn = is_drawn(F.col("band")) & F.col("target").isNotNull()
    edges = resolved.filter(drawn).select("site", "src", F.col("target").alias("dst"), "band")
    return edges, resolved.filter(~drawn).select("site", "src", "band", F.when(F.col("band") == "candidate", "several candidates").when(F.col("band") == "blocked", "name too common").when(F.col("band") == "external", "outside the repository").otherwise("nothing found").alias("reason"))


def routes(endpoints: DataFrame, handlers: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """(route nodes, edges): endpoints (path, framework, key) as nodes of kind Route, and DEFINES_ROUTE edges from handlers (path, key, node_id)."""
    node = identity.node_id(F.lit(repo), F.lit("Route"), F.col("path"), F.col("key"))
    nodes = endpoints.select("path", "framework", "key").distinct().withColumn("node_id", node)
    edges = nodes.join(handlers.select("path", "key", F.col("node_id").alias("src")), ["path", "key"]).select("src", F.col("node_id").alias("dst"), F.lit("DEFINES_ROUTE").alias("kind")).distinct()
    return nodes, edges


def merged_candidates(candidates: DataFrame, merged: DataFrame) -> DataFrame:
    """The candidates (site, ...) that stay after a precise merge: a site that came out with a target has none."""
    settled = merged.filter(F.col("outcome").isin("insert", "upgrade", "contradict")).select("site")
    return candidates.join(settled, "site", "left_anti")


def mapped_documents(documents: DataFrame, files: DataFrame, least: float = 0.5) -> DataFrame:
    """(documents, mapped, accepted): how many of a provider's documents are files; under half of them the merge is refused."""
    d = documents.select("path").distinct().join(files.select("path").distinct().withColumn("there", F.lit(1)), "path", "left")
    return d.agg(F.count("*").alias("documents"), F.count("there").alias("mapped")).withColumn("accepted", F.col("mapped") >= least * F.col("documents"))


def test_edges(calls: DataFrame, tests: DataFrame) -> DataFrame:
    """A drawn call from a test also tests its target; the call itself stays."""
    return calls.filter(is_drawn(F.col("band"))).join(tests.select(F.col("node").alias("src")), "src", "left_semi").withColumn("kind", F.lit("TESTS"))


def containers(paths: DataFrame, group: list[str], path: str, *, share: float = 0.7, deepest: int = 10) -> DataFrame:
    """(group, container, members): folders below the common prefix; one that holds more than ``share`` of the members is opened a level."""
    parts = F.split(F.col(path), "/")
    state = paths.select(*group, parts.alias("p"), F.lit(1).alias("depth"))
    for _ in range(deepest):
        state = state.withColumn("c", F.array_join(F.slice("p", 1, F.least("depth", F.size("p") - 1)), "/"))
        total = state.groupBy(*group).agg(F.count("*").alias("total"))
        heavy = state.groupBy(*group, "c").agg(F.count("*").alias("n"), F.max(F.size("p") - 1 - F.col("depth")).alias("room")).join(total, group).filter((F.col("n") > share * F.col("total")) & (F.col("room") > 0)).select(*group, "c")
        if heavy.isEmpty():
            break
        opened = heavy.withColumn("open", F.lit(1))
        state = materialise(state.join(opened, [*group, "c"], "left").select(*group, "p", (F.col("depth") + F.coalesce("open", F.lit(0))).alias("depth")), "containers")
    return state.withColumn("container", F.array_join(F.slice("p", 1, F.least("depth", F.size("p") - 1)), "/")).groupBy(*group, "container").agg(F.count("*").alias("members"))


def flow_steps(edges: DataFrame, roots: DataFrame, *, depth: int = 4, most: int = 12) -> DataFrame:
    """(root, node, distance, position, weight): a bounded walk from each root, weighted i / (n + 1) by rank."""
    from graphloom.operators.graph import reach

    w = Window.partitionBy("root").orderBy("distance", "node")
    steps = reach(edges, roots, depth).withColumnRenamed("seed", "root").withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)
    return steps.withColumn("weight", F.col("position") / (F.count(F.lit(1)).over(Window.partitionBy("root")) + 1))


def precise_merge(sites: DataFrame, occurrences: DataFrame, bin_width: int = 256) -> DataFrame:
    """(site, outcome, target): compiler occurrences laid over call sites by byte ranges of one file.

    One target for one site confirms, upgrades or contradicts what was resolved;
    several targets conflict; a site nothing overlaps stays as it is.
    """
    from graphloom.operators.intervals import overlap_join

    hits = overlap_join(sites.select("site", "file", "start", "end", "band", F.col("target").alias("was")), occurrences.select("file", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("target").alias("now")), ["file"], ("start", "end"), ("s2", "e2"), bin_width)
    g = hits.groupBy("site").agg(F.count_distinct("now").alias("n"), F.min("now").alias("now"), F.max("was").alias("was"), F.max("band").alias("band"))
    outcome = F.when(F.col("n") > 1, "conflict").when(F.col("was").isNull(), "insert").when(F.col("was") == F.col("now"), "upgrade").otherwise("contradict")
    found = g.select("site", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("now")).alias("target"))
    return sites.select("site", F.col("target").alias("t")).join(found, "site", "left").select("site", F.coalesce("outcome", F.lit("kept")).alias("outcome"), F.coalesce("target", "t").alias("target"))


def diff_impact(definitions: DataFrame, hunks: DataFrame, bin_width: int = 64) -> DataFrame:
    """(node): definitions whose lines meet a changed range of their file."""
    from graphloom.operators.intervals import overlap_join

    d = definitions.select("node", "file", "start", (F.col("end") + 1).alias("end"))
    h = hunks.select("file", F.col("start").alias("s2"), (F.col("end") + 1).alias("e2"))
    return overlap_join(d, h, ["file"], ("start", "end"), ("s2", "e2"), bin_width).select("node").distinct()


def topology(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """(src, dst, finding): links seen at run time against links known from the sources."""
    both = declared.select("src", "dst").distinct().withColumn("d", F.lit(1)).join(observed.select("src", "dst").distinct().withColumn("o", F.lit(1)), ["src", "dst"], "full_outer")
    return both.select("src", "dst", F.when(F.col("d").isNull(), "topology.observed_not_declared").when(F.col("o").isNull(), "topology.declared_not_observed").otherwise("observed").alias("finding"))


def layer_stats(nodes: DataFrame, layer: str, complexity: str) -> DataFrame:
    """Members and overall complexity per layer: complex or moderate above 30 per cent."""
    g = nodes.groupBy(layer).agg(F.count("*").alias("members"), F.count_if(F.col(complexity) == "complex").alias("c"), F.count_if(F.col(complexity) == "moderate").alias("m"))
    return g.select(layer, "members", F.when(F.col("c") > F.col("members") * 0.3, "complex").when(F.col("m") > F.col("members") * 0.3, "moderate").otherwise("simple").alias("complexity"))


def tiles(nodes: DataFrame, container: list[str], order: str, columns: list[str]) -> DataFrame:
    """(container, nodes, one array per column): the nodes of each container as columns in one order; a container is a view's bounded unit."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    grouped = nodes.groupBy(*container).agg(F.count("*").alias("nodes"), rows.alias("rows"))
    return grouped.select(*container, "nodes", *(F.col(f"rows.{c}").alias(c) for c in columns))
