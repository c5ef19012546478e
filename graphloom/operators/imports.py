"""Imports, modules, inheritance: which files and members a name can mean.

Every rule becomes keys that meet files by equality: an import is exploded into
the few paths it could stand for, and how many of them exist decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.resolution import import_decision, prioritised
from graphloom.plans.shared import materialise

# What a bare specifier may stand for.
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")
PYTHON_ENDINGS = (".py", ".pyi", "/__init__.py")
RUST_ENDINGS = (".rs", "/mod.rs")

# Import statements by language; group 1 is the module text.
STATEMENTS = {
    "python": r"(?m)^\s*(?:from\s+(\.*[\w.]*)\s+import\b|import\s+([\w.]+))",
    "javascript": r"(?m)^\s*(?:import|export)\b[^'\"\n;]*?(?:from\s*)?['\"]([^'\"\n]+)['\"]",
    "typescript": r"(?m)^\s*(?:import|export)\b[^'\"\n;]*?(?:from\s*)?['\"]([^'\"\n]+)['\"]",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "go": r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w.\-/]+)\"\s*$",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)",
    "kotlin": r"(?m)^\s*import\s+([\w.]+)",
    "csharp": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;",
    "php": r"(?m)^\s*use\s+(?:function\s+|const\s+)?\\?([\w\\]+)",
    "c": r"(?m)^\s*#\s*include\s*[\"<]([^\">]+)[\">]",
    "cpp": r"(?m)^\s*#\s*include\s*[\"<]([^\">]+)[\">]",
}


def statements(sources: DataFrame) -> DataFrame:
    """(sources' columns without the text, module) of every import statement."""
    keep = [c for c in sources.columns if c != "text"]
    found = F.array().cast("array<string>")
    for language, pattern in STATEMENTS.items():
        groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in ((1, 2) if language == "python" else (1,))]
        found = F.when(F.col("language") == language, F.array_distinct(F.flatten(F.array(*groups)))).otherwise(found)
    return sources.select(*keep, F.explode(F.array_remove(found, "")).alias("module"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def normalised(path: Column) -> Column:
    """A path without . and .. segments; null if it climbs out."""
    p = F.regexp_replace(F.concat(path, F.lit("/")), r"/(?:\./)+|//+", "/")
    p = F.regexp_replace(p, r"^(?:\./)+|^/", "")
    for _ in range(12):
        p = F.regexp_replace(p, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    p = F.regexp_replace(p, r"/+$", "")
    return F.when(~p.rlike(r"^\.\.(/|$)"), p)


def candidate_paths(language: Column, path: Column, module: Column) -> Column:
    """Paths an import may stand for, by the language's rule."""
    here = _folder(path)
    join = lambda a, b: F.when(a == "", b).otherwise(F.concat_ws("/", a, b))
    script = normalised(join(here, module))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    name = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    up = F.concat(here, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0)).cast("int")))
    relative = normalised(F.concat(F.when(here == "", F.lit(".")).otherwise(up), F.lit("/"), name))
    python = F.when(dots > 0, F.array(relative)).otherwise(F.array(name, F.concat(F.lit("src/"), name)))
    rust = F.regexp_replace(F.regexp_replace(module, r"^crate::", "src/"), "::", "/")
    with_endings = lambda bases, ends: F.flatten(F.transform(bases, lambda b: F.array(*(F.concat(b, F.lit(e)) for e in ends))))
    return (
        F.when(language == "python", with_endings(python, PYTHON_ENDINGS))
        .when(language.isin("javascript", "typescript") & module.startswith("."), with_endings(F.array(script), SCRIPT_ENDINGS))
        .when(language == "java", F.array(F.concat(F.regexp_replace(module, r"\.", "/"), F.lit(".java"))))
        .when(language == "kotlin", with_endings(F.array(F.regexp_replace(module, r"\.", "/")), (".kt", ".java")))
        .when(language == "csharp", F.array(F.concat(F.regexp_replace(module, r"\.", "/"), F.lit(".cs"))))
        .when(language == "php", F.flatten(F.transform(F.array(F.regexp_replace(module, r"\\", "/")), lambda b: F.array(F.concat(b, F.lit(".php")), F.concat(F.lit("src/"), F.regexp_replace(b, "^[^/]*/", ""), F.lit(".php"))))))
        .when(language.isin("c", "cpp"), F.array_distinct(F.array(script, module, F.concat(F.lit("include/"), module), F.concat(F.lit("src/"), module))))
        .when((language == "rust") & module.startswith("crate::"), with_endings(F.array(rust, F.regexp_replace(rust, "/[^/]*$", "")), RUST_ENDINGS))
        .otherwise(F.array().cast("array<string>"))
    )


def interpreted(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, language, module, decision, places): internal, several candidates, unresolved inside, or external.

    ``imports`` has (repo_id, path, language, module), ``files`` (repo_id, path).
    A Go import is internal if it ends with a folder of the repository.
    """
    i = imports.select("repo_id", "path", "language", "module").distinct()
    exploded = i.withColumn("place", F.explode(candidate_paths(F.col("language"), F.col("path"), F.col("module"))))
    by_path = exploded.join(files.select("repo_id", F.col("path").alias("place")).distinct(), ["repo_id", "place"])
    folders = files.filter(F.col("path").endswith(".go")).select("repo_id", _folder(F.col("path")).alias("place")).filter("place <> ''").distinct()
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("module", "/"))), lambda k: F.array_join(F.slice(F.split("module", "/"), k, F.size(F.split("module", "/"))), "/"))
    by_folder = i.filter("language = 'go'").withColumn("place", F.explode(tails)).join(folders, ["repo_id", "place"])
    hits = by_path.select("repo_id", "path", "module", "place").unionByName(by_folder.select("repo_id", "path", "module", "place"))
    n = hits.groupBy("repo_id", "path", "module").agg(F.count_distinct("place").alias("n"), F.array_sort(F.collect_set("place")).alias("places"))
    inside = F.col("module").startswith(".") | F.col("module").startswith("crate::")
    out = i.join(n, ["repo_id", "path", "module"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("repo_id", "path", "language", "module", F.when((F.col("n") == 0) & ~inside, "external").otherwise(import_decision(F.col("n"))).alias("decision"), "places")


def modules(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo_id, path, module): Java and Go packages as declared, else the folder."""
    t = files.join(texts.select("file_id", "blob_sha", "text").dropDuplicates(["file_id", "blob_sha"]), ["file_id", "blob_sha"], "left")
    declared = F.when(F.col("language").isin("java", "go"), F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)", 1))
    package = F.when((F.col("language") == "python") & F.col("path").endswith("/__init__.py"), _folder(F.col("path")))
    return t.select("repo_id", "path", F.concat_ws(":", "language", F.coalesce(F.when(declared != "", declared), package, _folder(F.col("path")))).alias("module"))


def alias_targets(calls: DataFrame, bindings: DataFrame, definitions: DataFrame) -> DataFrame:
    """(site, target): a bare call by a name the file imports, to that member of the imported file.

    calls (site, path, name); bindings (path, alias, member, place); definitions (path, name, target).
    """
    bound = calls.join(bindings.withColumnRenamed("alias", "name"), ["path", "name"])
    return bound.join(definitions.select(F.col("path").alias("place"), F.col("name").alias("member"), "target"), ["place", "member"]).select("site", "target")


def visible(candidates: DataFrame, places: DataFrame) -> DataFrame:
    """Candidates (site, path, target_path, ...) whose file is the site's own or one its file imports; two equi-joins, no disjunction."""
    own = candidates.filter("path = target_path")
    seen = places.select("path", F.col("place").alias("target_path")).distinct()
    return own.unionByName(candidates.filter("path <> target_path").join(seen, ["path", "target_path"], "left_semi"))


def base_types(bases: DataFrame, types: DataFrame, imported: DataFrame) -> DataFrame:
    """(child, base, tier, target): the type a base's name means; the first lookup that finds any decides, and several leave the target null.

    bases (child, repo, module, file, base); types (type, repo, module, qualified_name, name);
    imported (file, name, type).  Lookups: the exact qualified name in the
    repository, the name in the same module, an import of the file, a name of
    the whole repository.
    """
    b, t = bases.select("child", "repo", "module", "file", "base").distinct(), types.select("type", "repo", "module", "qualified_name", "name")
    exact = b.join(t.select("repo", F.col("qualified_name").alias("base"), "type"), ["repo", "base"])
    module = b.join(t.select("repo", "module", F.col("name").alias("base"), "type"), ["repo", "module", "base"])
    seen = b.join(imported.select("file", F.col("name").alias("base"), "type"), ["file", "base"])
    unique = b.join(t.select("repo", F.col("name").alias("base"), "type"), ["repo", "base"])
    key = F.struct("child", "base")
    found = prioritised([df.select(key.alias("site"), "type") for df in (exact, module, seen, unique)], "site", "type")
    tier = F.element_at(F.array(*map(F.lit, ("qualified", "module", "import", "repository"))), F.col("priority") + 1)
    return found.select("site.child", "site.base", tier.alias("tier"), "target")


def inherited_members(sites: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """(site, target, level): the member of the nearest ancestor type that has the name; two at one level are both given.

    sites (site, type, name); bases (child, parent); members (type, name, target).
    """
    own = materialise(members.select(F.col("type").alias("at"), "name", "target").distinct(), "members")
    step = materialise(bases.select(F.col("child").alias("at"), F.col("parent").alias("next")).distinct(), "bases")
    level = materialise(sites.select("site", F.col("type").alias("at"), "name").distinct(), "level")
    seen, out = level, None
    for k in count():
        hit = materialise(level.join(own, ["at", "name"]).select("site", "target", F.lit(k).alias("level")).distinct(), "inherited")
        out = hit if out is None else out.unionByName(hit)
        # A site that is settled climbs no further, nor does one that was at a type before.
        up = level.join(hit.select("site"), "site", "left_anti").join(step, "at").select("site", F.col("next").alias("at"), "name").distinct()
        level = materialise(up.join(seen.select("site", "at"), ["site", "at"], "left_anti"), "level")
        if level.isEmpty():
            return out
        seen = seen.unionByName(level)


def longest_alias(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(module, target): the most specific alias prefix of each module replaced by its target. Aliases are a config file's few rows.

    They are what is broadcast: a module is cut at each length of an alias, so
    modules are many rows more than Spark's size estimates show.
    """
    lengths = aliases.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    tried = imports.select("module").distinct().crossJoin(F.broadcast(lengths)).select("module", F.explode(F.filter("lengths", lambda n: n <= F.length("module"))).alias("n"))
    hit = tried.withColumn("prefix", F.substring("module", F.lit(1), F.col("n"))).join(F.broadcast(aliases), "prefix")
    best = hit.groupBy("module").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("b"))
    return best.select("module", F.concat(F.col("b.target"), F.substring(F.col("module"), F.length("b.prefix") + 1, F.length("module"))).alias("target"))


def scoped_resolution(candidates: DataFrame, site: str, candidate: str, stages: Sequence[tuple[str, str]], blocked: str) -> DataFrame:
    """First-generation resolution: scopes narrow in order; a blocked name with several definitions is never resolved."""
    from graphloom.operators.resolution import narrow

    n = candidates.groupBy(site).agg(F.count_distinct(candidate).alias("n"), F.max(F.col(blocked).cast("int")).alias("b"), F.min(candidate).alias("only"))
    out = narrow(candidates, site, candidate, stages).join(n, site)
    stop = (F.col("b") == 1) & (F.col("n") > 1)
    stage = F.when(F.col("n") == 1, "exact").when(stop, "blocked").otherwise(F.coalesce("stage", F.lit("ambiguous")))
    return out.select(site, stage.alias("stage"), F.when(F.col("n") == 1, F.col("only")).when(~stop, F.col("target")).alias("target"))
