"""Resolving references to definitions, never guessing.

Evidence is columnar: per (site, candidate) one boolean per stage.  A stage
keeps the candidates it supports, if it supports any of those left; the first
stage that leaves exactly one decides.  That fold needs only counts per site,
so it is a few windows over one shuffle by site; names with very many
definitions are settled before the join, not capped in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vocab import STRATEGY_SCORES


def narrow(candidates: DataFrame, site: str, candidate: str, stages: Sequence[tuple[str, str]]) -> DataFrame:
    """(site, stage, target, candidates): the deciding stage and target, or null target and the sorted candidates left.

    ``stages`` are (evidence column, band).  A lone candidate is not drawn
    without a stage that supports it.
    """
    w = Window.partitionBy(site)
    state = candidates.withColumn("__in", F.lit(True))
    decided = F.lit(None).cast("string")
    for i, (evidence, band) in enumerate(stages):
        hit = F.col("__in") & F.coalesce(F.col(evidence), F.lit(False))
        state = state.withColumn(f"__n{i}", F.sum(hit.cast("int")).over(w))
        state = state.withColumn(f"__s{i}", hit)
        state = state.withColumn("__in", F.when(F.col(f"__n{i}") > 0, hit).otherwise(F.col("__in")))
    for i in reversed(range(len(stages))):
        decided = F.when(F.col(f"__n{i}") == 1, F.lit(stages[i][1])).otherwise(decided)
    state = state.withColumn("stage", decided)
    first = F.lit(False)
    taken = F.lit(False)
    for i in range(len(stages)):
        one = F.col(f"__n{i}") == 1
        first = first | (~taken & one & F.col(f"__s{i}"))
        taken = taken | one
    state = state.withColumn("__target", first)
    return state.groupBy(site).agg(
        F.max("stage").alias("stage"), F.max(F.when(F.col("__target"), F.col(candidate))).alias("target"),
        F.when(F.max("stage").isNull(), F.array_sort(F.collect_set(F.when(F.col("__in"), F.col(candidate))))).alias("candidates"),
    )


def split_callee(text: Column) -> tuple[Column, Column]:
    """Receiver and name at the last of . -> :: and backslash."""
    receiver = F.regexp_extract(text, r"^(.*)(?:->|::|\.|\\)[^.:>\\]*$", 1)
    name = F.regexp_extract(text, r"(?:^|->|::|\.|\\)([^.:>\\]*)$", 1)
    return F.when(receiver == "", F.lit(None)).otherwise(receiver), name


# How languages write the current object and its parent, and where a bare name is a member first.
CURRENT = {
    "python": "self cls", "rust": "self Self", "swift": "self", "ruby": "self", "objc": "self", "php": "$this self static", "perl": "$self",
    "java": "this", "kotlin": "this", "scala": "this", "groovy": "this", "csharp": "this", "cpp": "this", "typescript": "this", "javascript": "this",
}
PARENT = {
    "python": "super()", "csharp": "base", "php": "parent", "java": "super", "kotlin": "super", "scala": "super", "groovy": "super", "swift": "super", "ruby": "super", "objc": "super",
    "typescript": "super", "javascript": "super",
}
IMPLICIT = ("java", "kotlin", "csharp", "cpp", "scala", "groovy", "swift", "ruby")


def receiver_role(language: Column, receiver: Column) -> Column:
    """bare, current, super or other, as the language writes it."""
    written = lambda table: F.concat_ws(" ", language, receiver).isin(*(f"{k} {w}" for k, v in table.items() for w in v.split()))
    none = receiver.isNull() | (receiver == "")
    return F.when(none & language.isin(*IMPLICIT), "current").when(none, "bare").when(written(CURRENT), "current").when(written(PARENT), "super").otherwise("other")


def reachable(candidates: DataFrame, imports: DataFrame) -> DataFrame:
    """Candidates (site, file, module, ...) with whether some import of the site's file holds the module's name or lies in it.

    One name holds another at a part's boundary, so the test is an equality of
    prefixes: no import is compared with all modules.
    """
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda k: F.array_join(F.slice(F.split(c, r"\."), 1, k), "."))
    inside = candidates.select("file", "module").distinct().withColumn("part", F.explode(prefixes(F.col("module")))).join(imports.select("file", F.col("module").alias("part")).distinct(), ["file", "part"]).select("file", "module")
    holding = imports.select("file", F.explode(prefixes(F.col("module"))).alias("module")).distinct()
    met = inside.unionByName(candidates.select("file", "module").join(holding, ["file", "module"])).distinct().withColumn("reachable", F.lit(True))
    return candidates.join(met, ["file", "module"], "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


def fuzzy_fallback(sites: DataFrame, definitions: DataFrame, site: str, name: str, *, most: int = 2) -> DataFrame:
    """(site, target, distance): the one definition nearest in spelling to a name nothing else resolved, at most ``most`` edits away; ties resolve nothing.

    Of two names at most k edits apart, k characters can be left out of the
    longer, and of the shorter so many fewer as it is shorter, that the same is
    left; so names meet by equality of what is left, and common beginnings bring
    no names together.  A name is cut only for the lengths there are on the
    other side.  What is left is many times the tables read, which Spark's size
    estimates don't show, so no join of it is a broadcast.
    """

    def less(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n))))

    def left(names: DataFrame, others: DataFrame) -> DataFrame:
        lengths = others.agg(F.collect_set(F.length(others.columns[0])).alias("lengths"))  # no more than the longest name has characters
        n, level = names.columns[0], F.array(names[names.columns[0]])
        rests = []
        for k in range(most + 1):
            longer = F.length(n) + (most - k)
            needed = F.exists("lengths", lambda m: m.between(longer - most, longer)) if k == most else F.array_contains("lengths", longer)
            rests.append(F.when(needed, level).otherwise(F.array().cast("array<string>")))
            level = F.array_distinct(F.flatten(F.transform(level, less)))
        return names.crossJoin(F.broadcast(lengths)).select(n, F.explode(F.transform(F.concat(*rests), lambda x: F.xxhash64(x))).alias("rest"))

    known = definitions.select(F.col(name).alias("target")).filter(F.length("target") > most).distinct()
    asked = sites.select(site, F.col(name).alias("asked")).filter(F.length("asked") > most).distinct()
    names = asked.select("asked").distinct()
    met = left(names, known).join(left(known, names).hint("merge"), "rest").select("asked", "target").distinct()
    met = met.withColumn("distance", F.levenshtein("asked", "target")).filter(F.col("distance").between(1, most))
    at = lambda c, d: F.when(F.col("distance") == d, F.col(c))
    ns, targets = (F.array(*(f(at("target", d)) for d in range(1, most + 1))) for f in (F.count, F.min))
    best = met.groupBy("asked").agg(F.min("distance").alias("distance"), ns.alias("ns"), targets.alias("targets")).filter("element_at(ns, distance) = 1")
    return asked.join(best.hint("merge"), "asked").select(site, F.element_at("targets", F.col("distance")).alias("target"), "distance")


def provenance(own: Column, internal_import: Column, bindings: Column, external_bindings: Column) -> Column:
    """Where a name comes from: own top level, an internal import, only external bindings, or unknown."""
    return F.when(own, "own").when(internal_import, "internal").when((bindings > 0) & (bindings == external_bindings), "external").otherwise("unknown")


def import_decision(places: Column) -> Column:
    """0 places: unresolved; 1: internal; several: candidates."""
    return F.when(places == 0, "unresolved").when(places == 1, "internal").otherwise("internal_candidates")


def settlement(flags: dict[str, Column], stage: Column) -> Column:
    """Band of a site by precedence: blocked, external engine answer, typed, local, external import, narrowing stage, candidate, unresolved."""
    return (
        F.when(flags["blocked"], "blocked").when(flags["engine_external"], "external").when(flags["typed"], "typed").when(flags["local"], "blocked")
        .when(flags["external_import"], "external").when(stage.isNotNull(), stage).when(flags["has_candidates"], "candidate").otherwise("unresolved")
    )


def prioritised(joins: Sequence[DataFrame], site: str, target: str) -> DataFrame:
    """(site, priority, target, n): the first lookup that finds anything decides; several targets leave the target null."""
    out = None
    for i, df in enumerate(joins):
        part = df.select(site, F.col(target).alias("target")).distinct().withColumn("priority", F.lit(i))
        out = part if out is None else out.unionByName(part)
    best = out.withColumn("best", F.min("priority").over(Window.partitionBy(site))).filter("priority = best")
    return best.groupBy(site, "priority").agg(F.count("*").alias("n"), F.max("target").alias("target")).withColumn("target", F.when(F.col("n") == 1, F.col("target")))


def penalised(score: Column, candidates: Column) -> Column:
    """Confidence falls as 3/n beyond three candidates."""
    return F.when(candidates <= 3, score).otherwise(score * F.least(F.lit(1.0), F.lit(3.0) / candidates))


def scored(matches: DataFrame, site: str) -> DataFrame:
    """Of (site, strategy, target, candidates, reachable) rows the best answer per site, by the strategies' order; unreachable unique names count half."""
    score = F.lit(None).cast("double")
    order = F.lit(len(STRATEGY_SCORES))
    for i, (name, base) in enumerate(STRATEGY_SCORES.items()):
        score = F.when(F.col("strategy") == name, base).otherwise(score)
        order = F.when(F.col("strategy") == name, i).otherwise(order)
    s = penalised(score, F.col("candidates")) * F.when((F.col("strategy") == "unique_name") & ~F.col("reachable"), 0.5).otherwise(1.0)
    ranked = matches.withColumn("score", s).withColumn("__o", order)
    w = Window.partitionBy(site).orderBy("__o", F.col("score").desc(), "target")
    return ranked.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__o")


def common_prefix(a: Column, b: Column, separator: str = r"\.") -> Column:
    """Number of leading parts two dotted names share."""
    x, y = F.split(a, separator), F.split(b, separator)
    n = F.least(F.size(x), F.size(y))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(x, i) != F.element_at(y, i))
    return F.when(F.size(differ) > 0, F.array_min(differ) - 1).otherwise(n)


def nearest_by_import(candidates: DataFrame, site: Sequence[str], module: str, qualified: str, *tie: str) -> DataFrame:
    """The candidate sharing most leading parts with the caller's module; tests rank last; ties go to the least nested, then the smallest name, then ``tie``."""
    test = F.col(qualified).rlike(r"(?i)(^|[._])tests?([._]|$)")
    score = common_prefix(F.col(module), F.col(qualified)) - F.when(test, 1000).otherwise(0)
    w = Window.partitionBy(*site).orderBy(score.desc(), F.size(F.split(qualified, r"\.")), qualified, *tie)
    return candidates.withColumn("score", score).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def suffixes(definitions: DataFrame, qualified: str) -> DataFrame:
    """(suffix, qualified): every tail of a dotted name at a part's boundary, for suffix lookups by equality."""
    parts = F.split(F.col(qualified), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return definitions.select(F.explode(tails).alias("suffix"), F.col(qualified).alias("qualified"))


def suppressed(stages: dict[str, Column], unresolved_member: Column, unconfirmed: Column) -> Column:
    """Band of a site by the first stage that holds; a member of an unresolved receiver has only its imports' evidence, an unconfirmed site none."""
    band = F.lit("unresolved")
    for name, holds in reversed(stages.items()):
        band = F.when(holds & (F.lit(name == "import-guided") | ~unresolved_member), name).otherwise(band)
    return F.when(unconfirmed, "unconfirmed").otherwise(band)
