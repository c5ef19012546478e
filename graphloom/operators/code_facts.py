"""Definitions, calls and base types read off source lines by rules, as Column expressions.

A rule is a language, a kind and a pattern whose group 1 is the name, so the
same table gives the plan and its SQL.  Every line is met once by all rules of
its language inside one expression; nothing leaves the JVM.  The rules read
what a line declares by itself; facts of a full syntax tree come as input
tables, and ``recalled`` says how much of such a table the rules see.

Defined results: null texts, null languages and languages without rules give
no rows; lines count from 1 and end at a line feed; comment lines give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|default|export|async) +)*"

# (language, kind, pattern)
DEFINITIONS = [
    ("python", "Class", rf"^\s*class +{_NAME}"),
    ("python", "Function", rf"^\s*(?:async +)?def +{_NAME} *\("),
    *((lang, kind, pattern) for lang in ("javascript", "typescript") for kind, pattern in (
        ("Class", rf"^\s*{_MODS}class +{_NAME}"), ("Function", rf"^\s*{_MODS}function *\*? *{_NAME} *[(<]"), ("Method", rf"^\s+{_MODS}(?:get +|set +|\*)?{_NAME} *(?:<[^<>]*>)?\([^()]*\)[^()=]*\{{\s*$"),
    )),
    ("typescript", "Interface", rf"^\s*{_MODS}interface +{_NAME}"),
    ("java", "Class", rf"^\s*{_MODS}(?:class|record) +{_NAME}"),
    ("java", "Interface", rf"^\s*{_MODS}interface +{_NAME}"),
    ("java", "Enum", rf"^\s*{_MODS}enum +{_NAME}"),
    ("java", "Method", rf"^\s+{_MODS}(?:<[^<>]*> +)?[A-Za-z_][A-Za-z0-9_.<>, \[\]]* +([a-z_$][A-Za-z0-9_$]*) *\([^()]*\)[^()=]*\{{\s*$"),
    ("java", "Constructor", rf"^\s+(?:(?:public|private|protected) +)?([A-Z][A-Za-z0-9_]*) *\([^()]*\)[^()=]*\{{\s*$"),
    ("go", "Function", rf"^func +{_NAME} *[(\[]"),
    ("go", "Method", rf"^func +\([^()]*\) +{_NAME} *\("),
    ("go", "Struct", rf"^type +{_NAME} +struct"),
    ("go", "Interface", rf"^type +{_NAME} +interface"),
    ("rust", "Function", rf"^\s*(?:pub(?:\([a-z]+\))? +)?(?:(?:async|unsafe|const) +)*fn +{_NAME}"),
    ("rust", "Struct", rf"^\s*(?:pub(?:\([a-z]+\))? +)?struct +{_NAME}"),
    ("rust", "Enum", rf"^\s*(?:pub(?:\([a-z]+\))? +)?enum +{_NAME}"),
    ("rust", "Trait", rf"^\s*(?:pub(?:\([a-z]+\))? +)?trait +{_NAME}"),
    *((lang, kind, pattern) for lang in ("c", "cpp") for kind, pattern in (
        ("Struct", rf"^\s*(?:typedef +)?struct +{_NAME} *\{{"), ("Enum", rf"^\s*(?:typedef +)?enum +(?:class +)?{_NAME} *\{{"), ("Macro", rf"^\s*# *define +{_NAME}"),
        ("Function", r"^[A-Za-z_][A-Za-z0-9_:<>, ]*[ *&]+((?:[A-Za-z_][A-Za-z0-9_]*::)*~?[A-Za-z_][A-Za-z0-9_]*) *\([^;{}]*\) *(?:const *)?\{?\s*$"),
    )),
    ("cpp", "Class", rf"^\s*(?:template *<[^<>]*> *)?class +{_NAME} *(?::[^:].*)?\{{?\s*$"),
    ("csharp", "Class", rf"^\s*(?:(?:public|internal|private|protected|static|sealed|abstract|partial) +)*(?:class|record) +{_NAME}"),
    ("csharp", "Interface", rf"^\s*(?:(?:public|internal|private|protected|partial) +)*interface +{_NAME}"),
    ("csharp", "Method", r"^\s+(?:(?:public|internal|private|protected|static|virtual|override|abstract|async|sealed) +)+[A-Za-z_][A-Za-z0-9_.<>, \[\]?]* +([A-Za-z_][A-Za-z0-9_]*) *(?:<[^<>]*>)? *\([^()]*\)"),
    ("kotlin", "Class", rf"^\s*(?:(?:public|private|internal|data|sealed|abstract|open|inner|enum) +)*(?:class|object) +{_NAME}"),
    ("kotlin", "Interface", rf"^\s*(?:(?:public|private|internal|sealed|fun) +)*interface +{_NAME}"),
    ("kotlin", "Function", rf"^\s*(?:(?:public|private|internal|protected|override|suspend|inline|operator|open) +)*fun +(?:<[^<>]*> +)?(?:[A-Za-z_][A-Za-z0-9_]*\.)?{_NAME} *\("),
    ("swift", "Class", rf"^\s*(?:(?:public|open|internal|private|final) +)*(?:class|actor) +{_NAME} *[:{{<]"),
    ("swift", "Struct", rf"^\s*(?:(?:public|internal|private) +)*struct +{_NAME}"),
    ("swift", "Function", rf"^\s*(?:(?:public|open|internal|private|static|override|mutating) +)*func +{_NAME} *[(<]"),
    ("scala", "Class", rf"^\s*(?:(?:private|protected|abstract|final|sealed|case|implicit) +)*(?:class|object) +{_NAME}"),
    ("scala", "Trait", rf"^\s*(?:(?:private|protected|sealed) +)*trait +{_NAME}"),
    ("scala", "Method", rf"^\s*(?:(?:private|protected|override|final|implicit) +)*def +{_NAME}"),
    ("ruby", "Class", r"^\s*class +([A-Z][A-Za-z0-9_:]*)"),
    ("ruby", "Module", r"^\s*module +([A-Z][A-Za-z0-9_:]*)"),
    ("ruby", "Method", r"^\s*def +(?:self\.)?([A-Za-z_][A-Za-z0-9_]*[?!=]?)"),
    ("php", "Class", rf"^\s*(?:(?:abstract|final|readonly) +)*class +{_NAME}"),
    ("php", "Interface", rf"^\s*interface +{_NAME}"),
    ("php", "Trait", rf"^\s*trait +{_NAME}"),
    ("php", "Function", rf"^\s*(?:(?:public|private|protected|static|abstract|final) +)*function +&?{_NAME} *\("),
    ("perl", "Module", r"^\s*package +([A-Za-z_][A-Za-z0-9_:]*)"),
    ("perl", "Function", rf"^\s*sub +{_NAME}"),
    ("ada", "Module", r"^\s*(?i:package) +(?:(?i:body) +)?([A-Za-z][A-Za-z0-9_.]*) +(?i:is|with|renames)"),
    ("ada", "Function", r"^\s*(?:(?i:overriding|not overriding) +)?(?i:procedure|function) +([A-Za-z][A-Za-z0-9_]*)"),
    ("ada", "Struct", r"^\s*(?i:type) +([A-Za-z][A-Za-z0-9_]*) +(?i:is) +(?:(?i:tagged|limited|abstract) +)*(?i:record|new)"),
    ("bash", "Function", r"^\s*(?:function +)?([A-Za-z_][A-Za-z0-9_-]*) *\( *\)"),
    ("lua", "Function", r"^\s*(?:local +)?function +([A-Za-z_][A-Za-z0-9_.:]*) *\("),
]
# Words that stand before a bracket without being called or declared.
NO_NAMES = ("if", "for", "while", "switch", "catch", "return", "new", "match", "else", "do", "in", "not", "and", "or", "await", "async", "func", "function", "fn", "def", "class", "elif", "with", "super", "typeof", "throw", "constructor")
COMMENT = r"^\s*(?://|#|/\*|\*|--)"
# Languages whose lines with a hash are no comments.
PREPROCESSED = ("c", "cpp")
CALL = r"([A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|::|->)[A-Za-z_$][A-Za-z0-9_$]*)*) *\("


def lines(sources: DataFrame, *columns: str) -> DataFrame:
    """(columns, language, line_no, line) of texts, comment lines left out."""
    rows = sources.filter("text is not null and language is not null").select(*columns, "language", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    comment = F.col("line").rlike(COMMENT) & ~(F.col("language").isin(*PREPROCESSED) & F.col("line").rlike(r"^\s*#"))
    return rows.filter(~comment).select(*columns, "language", (F.col("at") + 1).alias("line_no"), "line")


def definitions(sources: DataFrame, *columns: str) -> DataFrame:
    """(columns, language, line_no, kind, name): what each line declares."""
    found: list[Column] = []
    for language, kind, pattern in DEFINITIONS:
        name = F.regexp_extract("line", pattern, 1)
        found.append(F.when((F.col("language") == language) & (name != "") & ~name.isin(*NO_NAMES), F.struct(F.lit(kind).alias("kind"), name.alias("name"))))
    rows = lines(sources, *columns).withColumn("d", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows.select(*columns, "language", "line_no", "d.kind", "d.name")


def calls(sources: DataFrame, *columns: str) -> DataFrame:
    """(columns, language, line_no, callee): names before an opening bracket, as written, on lines that declare nothing."""
    known = sorted({language for language, *_ in DEFINITIONS})
    rows = lines(sources, *columns).filter(F.col("language").isin(*known))
    rows = rows.filter(~F.col("line").rlike(r"^\s*(?:(?:export|pub|async|public|private|protected|static|final) +)*(?:def|class|func|function|fn) "))
    rows = rows.withColumn("callee", F.explode(F.regexp_extract_all("line", F.lit(CALL), F.lit(1))))
    return rows.filter(~F.col("callee").isin(*NO_NAMES)).select(*columns, "language", "line_no", "callee")


def recalled(found: DataFrame, facts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, facts, seen): how many rows of a fact table the rules see too."""
    hit = facts.join(found.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return hit.groupBy(*by).agg(F.count("*").alias("facts"), F.count("hit").alias("seen"))


def receiver_types(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """(site, caller, name, type): the declared type of each call's receiver among the caller's parameters.

    calls (site, caller, receiver, name); parameters (caller, parameter, type).
    A receiver that is no parameter, or one of several types, has type null.
    """
    types = parameters.groupBy("caller", F.col("parameter").alias("receiver")).agg(F.min("type").alias("type"), F.max("type").alias("most"))
    types = types.withColumn("type", F.when(F.col("type") == F.col("most"), F.col("type"))).drop("most")
    return calls.join(types, ["caller", "receiver"], "left").select("site", "caller", "name", "type")


def argument(args: Column, *, keyword: str | None = None, position: int | None = None) -> Column:
    """The text of a keyword argument, else of a positional one, of an array of (keyword, text) structs; null if neither is there."""
    named = F.try_element_at(F.filter(args, lambda a: a["keyword"] == keyword), F.lit(1))["text"] if keyword else F.lit(None)
    plain = F.try_element_at(F.filter(args, lambda a: a["keyword"].isNull()), F.lit(position + 1))["text"] if position is not None else F.lit(None)
    return F.coalesce(named, plain).cast("string")


def literal(text: Column) -> Column:
    """What stands between the quotes of a string literal; null for anything else."""
    return F.nullif(F.regexp_extract(text, r"^\s*[\"'`]([^\"'`]*)[\"'`]\s*$", 1), F.lit(""))


def constructed(text: Column, types: list[str]) -> Column:
    """The first argument of a construction of one of the types, if it is a literal."""
    return literal(F.regexp_extract(text, r"^\s*(?:new +)?(?:" + "|".join(types) + r")(?:<[^<>]*>)? *\( *([^,()]*)", 1))


def listed(text: Column) -> Column:
    """The literals of a list, set or single literal, in order."""
    return F.regexp_extract_all(text, F.lit(r"[\"'`]([^\"'`]+)[\"'`]"), F.lit(1))


def object_key(text: Column, key: str) -> Column:
    """The literal under a key of an object literal."""
    return F.nullif(F.regexp_extract(text, rf"[{{,] *[\"']?{key}[\"']? *: *[\"'`]([^\"'`]*)[\"'`]", 1), F.lit(""))


# The status and reason of each outcome of a file's extraction.
OUTCOMES = {
    "extracted:parsed": ("parsed", None), "extracted:partial": ("partial", None), "extracted:failed": ("failed", "parse"), "engine_failed": ("failed", "engine_error"), "engine_crashed": ("failed", "engine_crash"),
    "skipped_memory": ("skipped", "memory"), "skipped_size": ("skipped", "size"), "unknown_language": ("skipped", "unknown_language"), "binary": ("binary", None), "redacted": ("redacted", None),
}
# The definition kinds that are node kinds of the same name.
NODE_KINDS = ("Class", "Interface", "Enum", "Struct", "Trait", "TypeAlias", "Function", "Method", "Constructor", "Field", "Variable", "Macro", "Module")


def file_status(outcome: Column) -> tuple[Column, Column]:
    """(status, reason) of an outcome; null for an unknown one."""
    status = reason = F.lit(None).cast("string")
    for name, (s, r) in OUTCOMES.items():
        status, reason = F.when(outcome == name, s).otherwise(status), F.when(outcome == name, F.lit(r)).otherwise(reason)
    return status, reason


def node_kind(kind: Column) -> Column:
    return F.when(kind.isin(*NODE_KINDS), kind)


def visibility(language: Column, name: Column) -> Column:
    """Public or not, for the two languages whose names say so; null elsewhere."""
    go = F.when(name.rlike(r"^[A-Z]"), "public").otherwise("internal")
    python = F.when(name.rlike(r"^__.*__$"), "public").when(name.startswith("_"), "private").otherwise("public")
    return F.when(language == "go", go).when(language == "python", python)
