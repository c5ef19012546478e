"""Source files that do not parse.

Every file version is lexed and its whole token stream run through table-driven
parsers built from bundled grammars; the first token no reading accepts is the
file's error.  Tables are built once, on the driver, and broadcast (a few
hundred kilobytes, whatever the data).  No other parser has a say, so a verdict
does not depend on the Python an executor runs.

Defined results: null texts have no status; an empty text is valid where the
grammar has empty files; one leading byte order mark is ignored, a second is
an error; languages without a grammar have status null; deep nesting is bounded
by memory only, since stacks are linked lists.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import map_rows
from graphloom.llm.grammar import Parser, tables
from graphloom.llm.grammars import GRAMMARS
from graphloom.llm.lexers import ENDS, ERROR, LEXERS, NEWLINES

LANGUAGES = tuple(GRAMMARS)


@lru_cache(maxsize=1)
def built_tables() -> dict[str, dict]:
    return {language: tables(text) for language, text in GRAMMARS.items()}


_PARSERS: dict[str, Parser] = {}


def parser(language: str, built: dict[str, dict] | None = None) -> Parser:
    if language not in _PARSERS:
        _PARSERS[language] = Parser((built or built_tables())[language], NEWLINES.get(language, ""), ENDS.get(language, frozenset()))
    return _PARSERS[language]


# What makes a file of the expression in a hole, each way shown to the parser: two kinds of bracket, so that no bracket of a hole can close one outside.
_AROUND = {"python": [("(", ")"), ("[", "]")], "javascript": [("(", ")"), ("x[", "]")], "typescript": [("(", ")"), ("x[", "]")]}
# Templates of types have types in their holes.
_AROUND_TYPE = {"typescript": [("type T = (", ")"), ("type T = [", "]")]}


def _hole_error(text: str, language: str, built: dict[str, dict] | None) -> tuple[int, str] | None:
    """The first error inside an interpolation, whose expressions the same parser reads."""
    holes = getattr(LEXERS[language], "holes", None)
    for at, hole in holes(text) if holes else ():
        found = _first_of(hole, _AROUND[language], language, built)
        if found and not (language in _AROUND_TYPE and _first_of(hole, _AROUND_TYPE[language], language, built) is None):
            return text.count("\n", 0, at) + found[0], found[1]
    return None


def _first_of(hole: str, around: list[tuple[str, str]], language: str, built: dict[str, dict] | None) -> tuple[int, str] | None:
    return next((e for a, b in around if (e := first_error(f"{a}{hole}\n{b}\n", language, built))), None)


def first_error(text: str, language: str, built: dict[str, dict] | None = None) -> tuple[int, str] | None:
    """(line, what stands there) of the first unrecoverable error, or null if the text is accepted."""
    if text.startswith("﻿"):
        text = text[1:]
    kinds, offset = LEXERS[language](text)
    at = parser(language, built).first_error(kinds)
    if at < 0 and (inner := _hole_error(text, language, built)):
        return inner
    if at < 0:
        return None
    if at >= len(kinds):
        return text.count("\n") + 1, "end of file"
    place = offset(at)
    return text.count("\n", 0, place) + 1, "no token" if kinds[at] == ERROR else f"unexpected {kinds[at]}"


def parsed(sources: DataFrame) -> DataFrame:
    """(repo_id, file_id, blob_sha, language, valid, error_line, reason), one row per file version.

    ``language`` is the table's own, in lower case; ``valid`` is null where no grammar is bundled.
    """
    shared = sources.sparkSession.sparkContext.broadcast(built_tables())

    def emit(repo_id, file_id, blob_sha, language, text) -> Iterable[tuple]:
        known = (language or "").lower()
        if text is None or known not in GRAMMARS:
            yield repo_id, file_id, blob_sha, language, None, None, None
            return
        found = first_error(text, known, shared.value)
        yield (repo_id, file_id, blob_sha, language, found is None, *(found or (None, None)))

    schema = "repo_id string, file_id string, blob_sha string, language string, valid boolean, error_line int, reason string"
    out = map_rows(sources, ["repo_id", "file_id", "blob_sha", "language", "text"], emit, schema)
    return out.groupBy("file_id", "blob_sha").agg(
        F.min("repo_id").alias("repo_id"), F.min("language").alias("language"), F.min("valid").alias("valid"),
        F.min("error_line").alias("error_line"), F.min("reason").alias("reason"),
    ).select("repo_id", "file_id", "blob_sha", "language", "valid", "error_line", "reason")


def rates(versions: DataFrame) -> DataFrame:
    """(repo_id, language, files, invalid, rate) over the versions that have a grammar."""
    known = versions.filter("valid is not null").groupBy("repo_id", "language")
    out = known.agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return out.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


def against_status(versions: DataFrame, files: DataFrame) -> DataFrame:
    """(language, status, valid, versions): the recorded status beside the parser's finding."""
    recorded = files.filter("blob_sha is not null").groupBy("file_id", "blob_sha").agg(F.max_by("status", F.struct("ingested_at", "status")).alias("status"))
    return versions.filter("valid is not null").join(recorded, ["file_id", "blob_sha"], "left").groupBy("language", "status", "valid").agg(F.count("*").alias("versions"))
