"""Paths, lines and small text operators that need no Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.rows import col

# Languages by extension.
EXTENSIONS = {
    "py": "python", "pyi": "python", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "mts": "typescript", "go": "go", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "kt": "kotlin", "php": "php", "rb": "ruby",
    "swift": "swift", "scala": "scala", "sh": "bash", "bash": "bash", "sql": "sql", "proto": "protobuf", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "xml": "xml", "md": "markdown", "properties": "properties", "html": "html", "css": "css",
}
# Fixed value: paths that are withheld whatever they hold.
SECRET_PATHS = r"(?i)(^|/)(\.env(\..*)?|[^/]*\.(pem|key|p12|pfx|jks|keystore)|id_(rsa|dsa|ecdsa|ed25519)|\.netrc|\.npmrc|\.pypirc)$"


def unportable(path: Column) -> Column:
    """Backslashes and drive letters have no portable form."""
    return (F.instr(path, "\\") > 0) | path.rlike("^[A-Za-z]:")


def classified(files: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    outcome = F.when(F.col("path").rlike(SECRET_PATHS), "redacted").when(F.col("size_bytes") > most_bytes, "skipped").when(F.coalesce("language", F.lit("")) == "", "skipped").otherwise("candidate")
    return files.withColumn("outcome", outcome)


def detected_language(paths: DataFrame) -> DataFrame:
    """Well-known file names first, then the extension."""
    name = F.lower(F.regexp_extract("path", r"[^/]*$", 0))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return paths.withColumn("detected", F.when(name == "dockerfile", "dockerfile").when(name == "makefile", "make").otherwise(F.try_element_at(known, ext)))


def shebang_language(content: Column) -> Column:
    interpreter = F.regexp_extract(content, r"^#!\s*(?:\S*/env\s+(?:-S\s+)?)?(?:\S*/)?([a-z]+)[\d.]*", 1)
    return F.when(interpreter == "python", "python").when(interpreter.isin("sh", "bash", "zsh", "dash"), "bash").when(interpreter == "node", "javascript").when(interpreter == "ruby", "ruby").when(interpreter == "php", "php")


def line_count(text: Column) -> Column:
    """Lines end at a line feed; a last line without one counts, an empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0)).cast("bigint")


def glob_match(name: Column, pattern: str) -> Column:
    """Case-insensitive fnmatch."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return name.rlike(f"(?is)^{body}$")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(col(key).alias(key), F.posexplode(F.split(col(text), "\n")).alias("pos", "line")).select(col(key), (F.col("pos") + 1).alias("line_no"), "line")


def grep(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Matching lines of every text; case is ignored, totals are exact."""
    return lines(df, key, text).filter(F.col("line").rlike(f"(?i){pattern}"))


def grep_context(df: DataFrame, key: str, text: str, pattern: str, around: int) -> DataFrame:
    """Matching lines with up to 30 lines on both sides, each line once; texts stay whole, so no self-join is made."""
    around = max(0, min(30, around))

    def near(ps: Column) -> Column:
        hits = F.filter(F.transform(ps, lambda line, i: F.when(line.rlike(f"(?i){pattern}"), i)), lambda i: i.isNotNull())
        rows = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(F.lit(0), i - around), F.least(F.size(ps) - 1, i + around)))))
        return F.transform(rows, lambda i: F.struct((i + 1).alias("line_no"), F.element_at(ps, i + 1).alias("line")))

    # The lines are bound to a lambda's variable, so a text is split once and not once per line.
    found = df.filter(col(text).rlike(f"(?i){pattern}")).select(col(key).alias(key), F.explode(F.element_at(F.transform(F.array(F.split(col(text), "\n")), near), 1)).alias("x"))
    return found.select(col(key), "x.line_no", "x.line").distinct()


def excerpt(text: Column, first: int, last: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def languages(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """(files' columns, language) of files (repo_id, path, first_line): a repository's override, else a header's rule, else the extension, else the first line.

    overrides (repo_id, pattern, language) are a configuration's few rows; a
    header belongs to C++ if a source of its name does, else to C.
    """
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    cpp = files.filter(F.col("path").rlike(r"(?i)\.(?:cpp|cc|cxx)$")).select("repo_id", stem.alias("stem")).distinct().withColumn("paired", F.lit(True))
    known = detected_language(files).withColumn("stem", stem).join(cpp, ["repo_id", "stem"], "left")
    said = known.select("repo_id", "path").distinct().join(F.broadcast(overrides.withColumnRenamed("language", "wanted")), "repo_id").filter(F.expr("path RLIKE pattern"))
    known = known.join(said.groupBy("repo_id", "path").agg(F.min("wanted").alias("wanted")), ["repo_id", "path"], "left")
    header = F.when(F.col("path").rlike(r"(?i)\.h$"), F.when(F.col("paired"), "cpp").otherwise("c"))
    language = F.coalesce("wanted", header, "detected", shebang_language(F.coalesce("first_line", F.lit(""))))
    return known.select(*files.columns, language.alias("language"))
