"""Callables paired with the documentation that describes them.

Callables of each repository's latest snapshot form a symbol table keyed by
qualified name and normalised signature.  Each takes its documentation from
its own row, else from the comment that belongs to the definition in the
file's text, else (as origin ``declaration``) from a documented declaration of
the same symbol in another file; overloads are told apart by the signature.
Documentation that says nothing is dropped last: comment marks, rules, tags
without text, placeholders, generic labels, the words of the callable's name.

Texts are read once per file version: the callables of a file, bounded by the
file, travel to its text.

Defined results: null or empty documentation counts as missing; rows without a
repository or node id have no pair; callables
without a text, or with lines outside it, have no pair; files, nodes and texts
delivered twice give one pair; null signatures match only null signatures.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.rows import valid_rows
from graphloom.llm.batches import map_rows
from graphloom.operators.hierarchy import latest_nodes

KINDS = ("Function", "Method", "Constructor")

# Words that, alone or together, describe nothing.
_GENERIC = frozenset(
    "a add an and any as at auto autogenerated be been by class comment constructor ctor default deprecated describe description doc docs docstring document documentation "
    "documented does do empty fill fix fixme for func function generated getter getters helper helpers here impl implementation in inheritdoc inherited initializer insert "
    "internal is it it's its later me method missing my na n needed needs no none not nothing of on or our pending placeholder private procedure provided public see "
    "setter setters some something stub stubs tba tbc tbd test text that the this to todo undocumented used util utility wip write xxx your".split()
)
_TAG = re.compile(
    r"^(?:[@\\:](?:param|arg|argument|parameter|tparam|typeparam|throws?|exception|raises?|property|prop|template|keyword|key)\b:?\s*(?:\{[^}]*\}\s*)?(?:\[?[\w.$*]+(?:=[^\]]*)?\]?)?\s*[:\-]*"
    r"|[@\\:](?:return|returns|rtype|type|yields?|since|author|version|see|deprecated|override|inheritdoc|todo|example|link|public|private|internal|async|static|hidden|ignore|readonly|memberof|class|constructor|function|method|name|module|api)\b:?\s*(?:\{[^}]*\})?)",
    re.I,
)
_SECTION = re.compile(r"^(?:args|arguments|parameters?|params|returns?|raises|yields|throws|attributes|notes?|examples?|see also|keyword arguments|errors|panics|safety)\s*:?$", re.I)
_ITEM = re.compile(r"^[-*]?\s*[`*]{0,2}[A-Za-z_$][\w$]*[`*]{0,2}\s*(?:\([^)]*\))?\s*:\s*$|^[A-Za-z_]\w*\s+:\s+[\w.\[\], ]+$")
_RULE = re.compile(r"^[^\w]*$")
_WORDS = re.compile(r"[^\W_]+(?:'[a-z]+)?")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def cleaned(doc: str) -> str:
    """Documentation without comment marks, string quotes, HTML tags and rules."""
    t = doc.replace("\r\n", "\n").strip()
    t = re.sub(r"^[rRuUbB]?(\"\"\"|''')", "", t)
    t = re.sub(r"(\"\"\"|''')$", "", t)
    out = []
    for line in t.split("\n"):
        x = re.sub(r"^\s*(?:/\*+!?|///?!?|//+|#+!?|\*+(?!/)|--+|<!--|;+)?\s?", "", line)
        x = re.sub(r"\s*(?:\*+/|-->)\s*$", "", x)
        x = re.sub(r"</?[A-Za-z][^<>]*>", " ", x).rstrip()
        out.append("" if _RULE.match(x) else x)
    return "\n".join(out).strip()


def _stem(w: str) -> str:
    for end in ("ing", "ies", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)] + ("y" if end == "ies" else "")
            break
    w = w[:-1] if len(w) > 3 and w[-1] == w[-2] else w
    return w[:-1] if len(w) > 3 and w[-1] in "ey" else w


def name_words(name: str | None) -> set[str]:
    return {_stem(p.lower()) for p in _PARTS.findall(name or "")}


def describes(doc: str | None, own: set[str]) -> bool:
    """Whether some word of the documentation says more than marks, labels and the name itself."""
    if not doc:
        return False
    for line in cleaned(doc).split("\n"):
        x = line.strip()
        if not x or _SECTION.match(x) or _ITEM.match(x):
            continue
        x = re.sub(r"\{@\w+\s*([^}]*)\}", r"\1", x)
        x = _TAG.sub("", x)
        for w in _WORDS.findall(x):
            for p in _PARTS.findall(w) if w.isascii() else [w]:
                low = p.lower()
                if low not in _GENERIC and _stem(low) not in own and _stem(low) not in _GENERIC and not low.isdigit():
                    return True
    return False


_HASH = {"python", "bash", "ruby", "yaml", "toml", "properties"}
_BETWEEN = re.compile(r"^\s*(?:@[\w.]+(?:\(.*\))?|#!?\[.*\])\s*$")


def _docstring(lines: list[str], at: int, end: int | None) -> str | None:
    """The string that is the first statement of the Python definition that begins in lines ``at`` to ``end``."""
    i, end = at, len(lines) if end is None or end <= at else min(end, len(lines))
    while i < end and not re.match(r"\s*(?:async\s+)?(?:def|class)\b", lines[i]):
        i += 1
    if i >= end:
        return None
    depth = 0
    while i < len(lines):
        code = re.sub(r"\"[^\"]*\"|'[^']*'", "", lines[i]).split("#")[0]
        depth += sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
        if depth <= 0 and code.rstrip().endswith(":"):
            break
        if depth <= 0 and (m := re.search(r":\s*([rRuU]?(?:\"\"\"|'''|\"|').*)$", lines[i])):
            return m[1]
        i += 1
    i += 1
    while i < len(lines) and (not lines[i].strip() or lines[i].lstrip().startswith("#")):
        i += 1
    if i >= len(lines):
        return None
    m = re.match(r"\s*[rRuU]?(\"\"\"|'''|\"|')", lines[i])
    if not m:
        return None
    rest = "\n".join(lines[i:])
    start = m.end()
    end = rest.find(m[1], start)
    return rest[start:end] if end >= 0 else None


def comment_of(lines: list[str], start: int, language: str | None, end: int | None = None) -> str | None:
    """The comment that belongs to the definition of lines ``start`` to ``end`` (from 1)."""
    at = start - 1
    if not 0 <= at < len(lines):
        return None
    if language == "python":
        own = _docstring(lines, at, end)
        if own is not None:
            return own
    i = at - 1
    while i >= 0 and _BETWEEN.match(lines[i]):
        i -= 1
    if i < 0:
        return None
    last = lines[i].strip()
    mark = "#" if language in _HASH else "//"
    if language not in _HASH and last.endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        if j < 0 or not lines[j].lstrip().startswith("/*"):
            return None
        return "\n".join(lines[j : i + 1])
    j = i
    while j >= 0 and lines[j].lstrip().startswith(mark) and not lines[j].startswith("#!"):
        j -= 1
    return "\n".join(lines[j + 1 : i + 1]) if j < i else None


# How languages write a parameter.
_NAME_COLON_TYPE = ("python", "typescript", "rust", "kotlin", "scala", "swift")
_NAME_TYPE = ("go",)
_TYPE_NAME = ("java", "c", "cpp", "csharp", "php")


def normalised_signature(c: Column, language: Column) -> Column:
    """Parameter types in order, in brackets, without names, defaults, receivers, modifiers, generics' insides, blanks and the return type.

    A parameter without a type counts as ``_``; types keep their case.
    """
    s = F.regexp_replace(c, r"^[^(]*\(", "")
    for _ in range(3):
        s = F.regexp_replace(s, r"<[^<>]*>", "")
    s = F.regexp_replace(s, r"\[[^\[\]]+\]", "[]")
    for _ in range(2):
        s = F.regexp_replace(s, r"\([^()]*\)(?=.*\))", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\).*$", ""), r"\s*=(?!>)[^,]*", "")
    known = F.lower(language)

    def kind(p: Column) -> Column:
        p = F.trim(p)
        after = F.when(F.contains(p, F.lit(":")), F.regexp_replace(p, r"^[^:]*:\s*", "")).otherwise("_")
        bare = F.trim(F.regexp_replace(p, r"@\w+\s*|\b(?:final|const|volatile|register)\s+", ""))
        before = F.when(F.rlike(bare, F.lit(r"^.*[\s*&\]].*\w$")), F.regexp_replace(bare, r"\w+$", "")).otherwise(bare)
        return F.when(known.isin(*_NAME_COLON_TYPE), after).when(known.isin(*_NAME_TYPE), F.regexp_replace(p, r"^\w+\s+", "")).when(known.isin(*_TYPE_NAME), before).otherwise("_")

    own = F.filter(F.split(s, ","), lambda p: ~F.rlike(F.trim(p), F.lit(r"^(?:&?\s*(?:'\w+\s+)?(?:mut\s+)?self|cls|this)?$")))
    return F.concat(F.lit("("), F.regexp_replace(F.array_join(F.transform(own, kind), ","), r"\s+", ""), F.lit(")"))


def callables(nodes: DataFrame, files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The symbol table: callables of latest snapshots with their file's version and language."""
    c = latest_nodes(nodes, snapshots, ["kind", "name", "qualified_name", "file_id", "start_line", "end_line", "signature", "doc"])
    c = c.filter(F.col("kind").isin(*KINDS)).drop("snapshot_no", "ingested_at")
    last = snapshots.groupBy("repo_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    f = files.select("repo_id", "snapshot_no", "file_id", "blob_sha", "language", "ingested_at").join(last, ["repo_id", "snapshot_no"], "left_semi")
    f = valid_rows(f, ["repo_id", "snapshot_no", "file_id"], "ingested_at").select("repo_id", "file_id", "blob_sha", "language")
    return c.join(f, ["repo_id", "file_id"])


def _own_words(kind: str | None, name: str | None, qualified: str | None) -> set[str]:
    words = name_words(name)
    if kind == "Constructor" or name in ("new", "__init__", "constructor"):
        words |= {"new", "init", "construct", "creat", "initialis", "initializ"}
        for part in (qualified or "").split(".")[-2:]:
            words |= name_words(part)
    return words


def documented(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_id, node_id, ..., origin, doc, says, code) for every callable whose file has a text."""
    per_file = symbols.groupBy("file_id", "blob_sha").agg(F.collect_list(F.struct("repo_id", "node_id", "kind", "name", "qualified_name", "signature", "start_line", "end_line", "doc", "language")).alias("callables"))
    texts = sources.select("file_id", "blob_sha", "text").filter("text is not null").join(per_file, ["file_id", "blob_sha"])

    def emit(file_id, text, found: Iterable[dict]):
        lines = text.lstrip("﻿").replace("\r\n", "\n").split("\n")
        for c in found:
            doc, origin = c["doc"], "doc"
            if not doc:
                doc, origin = (comment_of(lines, c["start_line"], c["language"], c["end_line"]) if c["start_line"] else None), "comment"
            says = describes(doc, _own_words(c["kind"], c["name"], c["qualified_name"]))
            code = "\n".join(lines[c["start_line"] - 1 : c["end_line"]]) if c["start_line"] and c["end_line"] else None
            yield c["repo_id"], c["node_id"], file_id, c["language"], c["kind"], c["name"], c["qualified_name"], c["signature"], origin if doc else None, cleaned(doc) if doc else None, says, code

    schema = "repo_id string, node_id string, file_id string, language string, kind string, name string, qualified_name string, signature string, origin string, doc string, says boolean, code string"
    out = map_rows(texts, ["file_id", "text", "callables"], emit, schema)
    return out.dropDuplicates(["repo_id", "node_id"])


def pairs(nodes: DataFrame, files: DataFrame, snapshots: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_id, node_id, qualified_name, signature, kind, origin, description, code)."""
    rows = documented(callables(nodes, files, snapshots), sources).withColumn("overload", normalised_signature(F.col("signature"), F.col("language")))
    # The documented declaration of each symbol, whatever file it stands in; the least node_id if there are several.
    # A symbol without a name is alone, so that nameless rows never meet in one task.
    symbol = F.coalesce("qualified_name", F.concat(F.lit("#"), "node_id"))
    key = Window.partitionBy("repo_id", symbol, "overload")
    declared = F.min(F.when(F.col("says"), F.struct("node_id", "doc"))).over(key)
    rows = rows.withColumn("declared", declared)
    description = F.when(F.col("says"), F.col("doc")).when(F.col("doc").isNull(), F.col("declared.doc"))
    rows = rows.withColumn("description", description).filter("description is not null and qualified_name is not null or says")
    return rows.select("repo_id", "node_id", "qualified_name", "signature", "kind", F.when(F.col("says"), F.col("origin")).otherwise("declaration").alias("origin"), "description", "code")
