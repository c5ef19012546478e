"""Line-level extractors over source and configuration texts, as Arrow-batched table functions.

Each yields rows for one text and never fails on odd input: what does not look
like the construct gives no row.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from graphloom.operators import yaml_values

CHUNK, OVERLAP = 800, 200
# Fixed value: the longest scope, header included, that stays one chunk.
SCOPE_CHUNK = 3000


def table_function(df: DataFrame, columns: list[str], emit: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                out.extend(emit(*row))
            parts = list(zip(*out)) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(p), type=f.type) for p, f in zip(parts, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def chunk_spans(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Overlapping spans; a span ends at its last line end if that lies past its middle."""
    if text is None:
        return []
    n, start, out = len(text), 0, []
    if n <= size:
        return [(0, n)]
    while start < n:
        end = min(n, start + size)
        if start + size < n:
            at = text.rfind("\n", start, end)
            if at - start > size // 2:
                end = at + 1
        out.append((start, end))
        start = start + size - overlap if end == n else end - overlap
    return out


def scope_spans(text: str | None, scopes: list[tuple[int, int, str]], most: int = SCOPE_CHUNK) -> list[tuple[int, int, str]]:
    """(start, end, header) of chunks that keep to scopes (first line, last line, name).

    A scope is one chunk under its name, or several if it is longer than ``most``
    with its header; what lies between scopes is cut like any text, blanks
    between them not at all.  A scope within an earlier one gives its own chunk.
    """
    if text is None:
        return []
    known = sorted((a, b, name) for a, b, name in scopes if a is not None and b is not None and b > a >= 1)
    if not known:
        return [(a, b, "") for a, b in chunk_spans(text)]
    begins = [0]
    while (at := text.find("\n", begins[-1])) >= 0:
        begins.append(at + 1)
    place = lambda line: begins[line - 1] if line <= len(begins) else len(text)
    out: list[tuple[int, int, str]] = []

    def between(a: int, b: int) -> None:
        if text[a:b].strip():
            out.extend((a + x, a + y, "") for x, y in chunk_spans(text[a:b]))

    done = 0
    for first, last, name in known:
        between(place(done + 1), place(first)) if first > done + 1 else None
        start, end, header = place(first), place(last + 1), f"-- [{name}]\n"
        if len(header) + end - start <= most:
            out.append((start, end, header))
        else:
            out.extend((start + x, start + y, header if not i else f"-- [{name} cont.]\n") for i, (x, y) in enumerate(chunk_spans(text[start:end])))
        done = max(done, last)
    between(place(done + 1), len(text))
    return out


def chunks(df: DataFrame, key: str, text: str, *, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, start_char, end_char, start_line, end_line, chunk)."""

    def emit(k, t):
        for i, (a, b) in enumerate(chunk_spans(t, size, overlap)):
            yield k, i, a, b, t.count("\n", 0, a) + 1, t.count("\n", 0, b) + 1, t[a:b]

    kind = df.schema[key].dataType.simpleString()
    return table_function(df, [key, text], emit, f"{key} {kind}, chunk_index int, start_char int, end_char int, start_line int, end_line int, chunk string")


_URI = re.compile(r"(?:(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.\-]*|Bearer[ \t]+\S+?)://[^\s/:@\"']*:([^\s/@\"']+)@")
_BEARER = re.compile(r"\bBearer[ \t]+([A-Za-z0-9._~+/=\-]{8,})")
_KEYED = re.compile(r"(?i)(?<![A-Za-z0-9])(?:password|passwd|secret|token|api[_-]?key|private[_-]?key)[\"']?[ \t]*[:=][ \t]*[\"']?([^\s\"',;]{4,})")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(.*?)-----END [A-Z ]*PRIVATE KEY-----", re.S)


def mask(text: str | None) -> tuple[str | None, int]:
    """Credential bytes overwritten by X at equal length; detectors read the original and their ranges are merged once."""
    if not text:
        return text, 0
    spans = sorted(m.span(1) for p in (_URI, _BEARER, _KEYED, _PEM) for m in p.finditer(text) if m.end(1) > m.start(1))
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    parts, at = [], 0
    for a, b in merged:
        parts += [text[at:a], re.sub(r"[^\r\n]", "X", text[a:b])]
        at = b
    return "".join([*parts, text[at:]]), len(merged)


def masked(df: DataFrame, key: str, text: str) -> DataFrame:
    def emit(k, t):
        m, n = mask(t)
        yield k, m, n

    kind = df.schema[key].dataType.simpleString()
    return table_function(df, [key, text], emit, f"{key} {kind}, masked string, ranges int")


_ROUTES = [
    re.compile(r"@(?:app|router|api|bp|blueprint)\.(?P<method>get|post|put|delete|patch|route)\(\s*[\"'](?P<path>[^\"']+)"),
    re.compile(r"\b(?:app|router|server)\.(?P<method>get|post|put|delete|patch)\(\s*[\"'`](?P<path>/[^\"'`]*)"),
    re.compile(r"@(?P<method>Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?\{?\"(?P<path>[^\"]+)"),
    re.compile(r"\.HandleFunc\(\s*\"(?:(?P<method>[A-Z]+) )?(?P<path>/[^\"]*)"),
    re.compile(r"#\[(?P<method>get|post|put|delete|patch)\(\s*\"(?P<path>[^\"]+)"),
]


def routes(text: str | None) -> Iterator[tuple[int, str, str]]:
    """(line, METHOD, path) of route registrations outside comment lines."""
    for i, line in enumerate((text or "").split("\n"), 1):
        if line.lstrip().startswith(("//", "#!", "*", "/*")) or line.lstrip().startswith("# "):
            continue
        for p in _ROUTES:
            if m := p.search(line):
                method = (m["method"] or "ANY").upper()
                yield i, "ANY" if method in ("ROUTE", "REQUEST") else method, m["path"]
                break


_DDL = re.compile(r"(?is)\bcreate\s+(?!temp)(?:or\s+replace\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\((.*?)\)\s*(?:;|$)")
_ACCESS = re.compile(r"(?i)\b(?:(insert\s+into|update|delete\s+from|merge\s+into)|(from|join))\s+([A-Za-z_\"`\[][\w.\"`\]]*)")
_CTE = re.compile(r"(?i)(?:\bwith|,)\s+([A-Za-z_]\w*)\s*(?:\([^)]*\))?\s+as\s*\(")


def tables_defined(text: str | None) -> Iterator[tuple[str, str, str]]:
    """(table, column, type) of CREATE TABLE statements; temporary tables are left out."""
    for m in _DDL.finditer(re.sub(r"--[^\n]*", "", text or "")):
        name = re.sub(r"[\"`\[\]]", "", m[1]).lower()
        depth, part, parts = 0, "", []
        for c in m[2]:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(part)
                part = ""
            else:
                part += c
        for p in [*parts, part]:
            words = p.split()
            if len(words) >= 2 and words[0].upper() not in ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY", "INDEX"):
                yield name, re.sub(r"[\"`\[\]]", "", words[0]).lower(), words[1].lower()


_PRISMA = re.compile(r"(?m)^\s*model\s+(\w+)\s*\{([^}]*)\}")
_ORM = re.compile(r"@(?:Table|Entity)\s*\(\s*(?:name\s*=\s*)?[\"']([\w.]+)[\"']|(?:__tablename__|db_table)\s*=\s*[\"']([\w.]+)[\"']")


def tables_declared(path: str | None, text: str | None) -> Iterator[tuple[str, str]]:
    """(table, source) that schemas, migrations and mapped classes declare."""
    body, name = text or "", (path or "").rsplit("/", 1)[-1]
    if name.endswith(".prisma"):
        for model, inside in _PRISMA.findall(body):
            mapped = re.search(r"@@map\(\s*\"([^\"]+)\"", inside)
            yield (mapped[1] if mapped else model).lower(), "prisma"
    elif name.endswith((".xml", ".yaml", ".yml")):
        for t in re.findall(r"<createTable\b[^>]*\btableName=\"([^\"]+)\"|createTable:(?:\s*\n\s+(?!tableName)\w+:.*)*\s*\n\s+tableName:\s*[\"']?([\w.]+)", body):
            yield (t[0] or t[1]).lower(), "liquibase"
    elif name.endswith(".sql"):
        for table in dict.fromkeys(t for t, _, _ in tables_defined(body)):
            yield table, "ddl"
    else:
        for a, b in _ORM.findall(body):
            yield (a or b).lower(), "orm"


def api_operations(text: str | None) -> Iterator[tuple[str | None, str, str]]:
    """(server, METHOD, path) of an OpenAPI 3 or Swagger 2 document, in JSON or YAML."""
    from graphloom.operators.rules import document_operations

    try:
        body = (text or "").lstrip("\ufeff")
        for d in [json.loads(body)] if body.lstrip()[:1] == "{" else list(yaml_values.documents(body)):
            yield from document_operations(d)
    except (ValueError, AttributeError, TypeError, RecursionError):
        return


def channel_operations(text: str | None) -> Iterator[tuple[str, str]]:
    """(channel, provides or consumes) of an AsyncAPI 2 or 3 document; what others publish the application reads."""
    try:
        body = (text or "").lstrip("\ufeff")
        for d in [json.loads(body)] if body.lstrip()[:1] == "{" else list(yaml_values.documents(body)):
            if str(d.get("asyncapi", "")).startswith("2"):
                for channel, item in (d.get("channels") or {}).items():
                    for said, way in (("subscribe", "provides"), ("publish", "consumes")):
                        if said in (item or {}):
                            yield channel, way
            elif str(d.get("asyncapi", "")).startswith("3"):
                addresses = {name: (c or {}).get("address") or name for name, c in (d.get("channels") or {}).items()}
                for op in (d.get("operations") or {}).values():
                    name = str((op.get("channel") or {}).get("$ref", "")).rsplit("/", 1)[-1]
                    if name in addresses and op.get("action") in ("send", "receive"):
                        yield addresses[name], "provides" if op["action"] == "send" else "consumes"
    except (ValueError, AttributeError, TypeError, RecursionError):
        return


_LISTENERS = re.compile(r"@(KafkaListener|RabbitListener|JmsListener|SqsListener)\s*\(\s*(?:[^()]*?\b(?:topics|queues|destination|value)\s*=\s*)?\{?([^)}]*)")


def listeners(text: str | None) -> Iterator[tuple[str, str]]:
    """(transport, channel) that listener annotations read; only literals count."""
    kinds = {"KafkaListener": "kafka", "RabbitListener": "rabbitmq", "JmsListener": "jms", "SqsListener": "sqs"}
    for kind, inside in _LISTENERS.findall(text or ""):
        for channel in re.findall(r"\"([^\"$#{]+)\"", inside.split(", groupId")[0]):
            yield kinds[kind], channel


def architecture(text: str | None) -> Iterator[tuple[str, str, str | None]]:
    """(relation, subject, object) of an architecture or catalogue file: systems, contexts, members and what is upstream of what."""
    try:
        for d in yaml_values.documents(text):
            if d.get("kind") and isinstance(d.get("metadata"), dict):
                name, spec = d["metadata"].get("name"), d.get("spec") or {}
                yield d["kind"].lower(), name, spec.get("system") or spec.get("domain")
                for other in spec.get("dependsOn") or []:
                    yield "upstream_of", other.rsplit(":", 1)[-1].rsplit("/", 1)[-1], name
            for context, body in (d.get("contexts") or {}).items():
                yield "context", context, (body or {}).get("system")
                for member in (body or {}).get("members") or []:
                    yield "member", member, context
                for other in (body or {}).get("upstream_of") or []:
                    yield "upstream_of", context, other
    except (ValueError, AttributeError, TypeError):
        return


def tables_accessed(sql: str | None) -> Iterator[tuple[str, str]]:
    """(table, read or write), common table expressions left out; DELETE FROM writes."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", sql or "", flags=re.S)
    own = {n.lower() for n in _CTE.findall(text)}
    seen = set()
    at = 0
    while m := _ACCESS.search(text, at):
        at = m.end()
        name = re.sub(r"[\"`\[\]]", "", m[3]).lower().removeprefix("public.")
        row = (name, "write" if m[1] else "read")
        if name not in own and name not in ("select", "set", "lateral", "unnest") and row not in seen:
            seen.add(row)
            yield row


_PROTO = re.compile(r"\b(package|service|message|enum)\s+([\w.]+)|\brpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)")


def proto_symbols(text: str | None) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(kind, qualified name, request, response) of a protobuf file."""
    package = service = ""
    for m in _PROTO.finditer(re.sub(r"//[^\n]*|/\*.*?\*/", "", text or "", flags=re.S)):
        if m[1] == "package":
            package = m[2] + "."
        elif m[1]:
            if m[1] == "service":
                service = m[2]
            yield m[1], package + m[2], None, None
        else:
            yield "rpc", f"{package}{service}/{m[3]}", m[4], m[5]


def headings(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(line, level, title) of Markdown headings outside fenced code."""
    fenced = False
    for i, line in enumerate((text or "").split("\n"), 1):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)):
            yield i, len(m[1]), m[2]


def flatten(value, prefix: str = "", depth: int = 64) -> Iterator[tuple[str, str]]:
    """(dotted key, value) of a nested document, no deeper than ``depth``."""
    if depth <= 0:
        return
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flatten(v, f"{prefix}.{k}" if prefix else str(k), depth - 1)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flatten(v, f"{prefix}[{i}]", depth - 1)
    else:
        yield prefix, "true" if value is True else "false" if value is False else "" if value is None else str(value)


def config_values(language: str | None, text: str | None) -> Iterator[tuple[str, str]]:
    """(key, value) of a JSON, TOML, YAML, XML or properties file; nothing for one that does not parse."""
    try:
        if language == "json":
            yield from flatten(json.loads((text or "").lstrip("﻿")))
        elif language == "toml":
            yield from flatten(tomllib.loads((text or "").lstrip("﻿")))
        elif language == "yaml":
            for d in yaml_values.documents(text):
                yield from flatten(d)
        elif language == "xml":
            yield from _xml_values(ET.fromstring((text or "").lstrip("\ufeff")))
        elif language == "properties":
            for line in re.sub(r"\\\r?\n\s*", "", text or "").split("\n"):
                if (m := re.match(r"\s*([^#!\s=:][^=:\s]*)\s*[=:]\s*(.*?)\s*$", line)) is not None:
                    yield m[1], m[2]
    except (ValueError, RecursionError, ET.ParseError):
        return


def _xml_values(element: ET.Element, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, text or attribute) of an element and those in it."""
    name = f"{prefix}.{element.tag}" if prefix else str(element.tag)
    for k, v in element.attrib.items():
        yield f"{name}@{k}", v
    if (element.text or "").strip():
        yield name, element.text.strip()
    for child in element:
        yield from _xml_values(child, name)


def jsonc(text: str | None):
    """JSON with comments and trailing commas, as compiler configurations are written."""
    strings = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|//[^\n]*|/\*.*?\*/", re.S)
    bare = strings.sub(lambda m: m[0] if m[0][0] == '"' else " ", (text or "").lstrip("\ufeff"))
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))


def compiler_aliases(text: str | None) -> Iterator[tuple[str | None, str, str]]:
    """(extended configuration, alias prefix, target) of a tsconfig; the base URL is put before targets."""
    try:
        d = jsonc(text)
        o = d.get("compilerOptions") or {}
        base = str(o.get("baseUrl") or ".").rstrip("/")
        for alias, targets in (o.get("paths") or {}).items():
            for t in targets[:1]:
                yield d.get("extends"), alias.rstrip("*"), f"{base}/{t.rstrip('*')}".removeprefix("./")
    except (ValueError, AttributeError, TypeError):
        return


def env_redacted(text: str | None) -> str | None:
    """Every value of a dotenv file replaced by a mark; keys, comments and blank values stay."""
    return None if text is None else re.sub(r"(?m)^(\s*(?:export\s+)?[A-Za-z_]\w*\s*=)[ \t]*\S.*$", r"\1<redacted>", text)


def env_keys(text: str | None) -> Iterator[tuple[int, str]]:
    """(line, variable) read from the environment."""
    p = re.compile(r"(?:os\.environ(?:\.get\(|\[)|os\.getenv\(|getenv\(|System\.getenv\(|env::var\(|process\.env\.|os\.Getenv\(|env_or!?\(|envOr\()\s*[\"']?([A-Za-z_]\w*)")
    for i, line in enumerate((text or "").split("\n"), 1):
        for name in p.findall(line):
            yield i, name


def manifest(path: str | None, text: str | None) -> Iterator[tuple[str, str, str, str | None, bool]]:
    """(ecosystem, group, name, version, provided) of package manifests; ranges are kept as written."""
    name = (path or "").rsplit("/", 1)[-1]
    body = text or ""
    try:
        if name == "package.json":
            d = json.loads(body)
            own = d.get("name")
            split = lambda n: (n.split("/", 1)[0], n.split("/", 1)[1]) if n.startswith("@") and "/" in n else ("", n)
            if own:
                yield "npm", *split(own), d.get("version"), True
            for section in ("dependencies", "devDependencies", "peerDependencies"):
                for n, v in (d.get(section) or {}).items():
                    yield "npm", *split(n), v, False
        elif name in ("Cargo.toml", "pyproject.toml"):
            d = tomllib.loads(body)
            eco = "cargo" if name == "Cargo.toml" else "pypi"
            p = d.get("package") or d.get("project") or {}
            if p.get("name"):
                yield eco, "", p["name"], p.get("version") if isinstance(p.get("version"), str) else None, True
            deps = d.get("dependencies") or p.get("dependencies") or {}
            if isinstance(deps, dict):
                for n, v in deps.items():
                    yield eco, "", n, v if isinstance(v, str) else (v or {}).get("version"), False
            else:
                for item in deps:
                    if m := re.match(r"([\w.\-]+)\s*(.*)", item):
                        yield eco, "", m[1].lower(), m[2] or None, False
        elif name == "go.mod":
            if m := re.search(r"(?m)^module\s+(\S+)", body):
                yield "go", "", m[1], None, True
            for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/\S+)\s+(v\S+)", body):
                yield "go", "", m[1], m[2], False
        elif name in ("build.gradle", "build.gradle.kts"):
            for g, n, v in re.findall(r"(?m)^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt)\s*\(?\s*[\"']([^:\"']+):([^:\"']+)(?::([^\"']+))?[\"']", body):
                yield "maven", g, n, v or None, False
        elif name.endswith((".csproj", ".fsproj", ".vbproj")):
            if m := re.search(r"<PackageId>([^<]+)</PackageId>", body):
                yield "nuget", "", m[1], (re.search(r"<Version>([^<]+)</Version>", body) or [None, None])[1], True
            for n, v in re.findall(r"<PackageReference\s+Include=\"([^\"]+)\"(?:\s+Version=\"([^\"]+)\")?", body):
                yield "nuget", "", n, v or None, False
        elif name == "setup.cfg":
            if m := re.search(r"(?m)^name\s*=\s*(\S+)", body):
                yield "pypi", "", m[1].lower(), (re.search(r"(?m)^version\s*=\s*(\S+)", body) or [None, None])[1], True
            if m := re.search(r"(?m)^install_requires\s*=\s*\n((?:[ \t]+\S.*\n?)+)", body):
                for n, v in re.findall(r"(?m)^\s+([\w.\-]+)\s*(.*)$", m[1]):
                    yield "pypi", "", n.lower(), v or None, False
        elif name == "requirements.txt":
            for n, v in re.findall(r"(?m)^\s*([A-Za-z][\w.\-]*)\s*((?:[=<>!~]=?[^;#\s]*)?)", body):
                yield "pypi", "", n.lower(), v or None, False
        elif name == "alire.toml":
            d = tomllib.loads(body)
            if d.get("name"):
                yield "alire", "", d["name"], d.get("version"), True
            for part in d.get("depends-on") or []:
                for n, v in part.items():
                    yield "alire", "", n, v if isinstance(v, str) else None, False
        elif name.endswith(".gpr"):
            for n in re.findall(r"(?im)^\s*with\s+\"([^\"]+?)(?:\.gpr)?\"\s*;", body):
                yield "gpr", "", n.lower(), None, False
            if m := re.search(r"(?im)^\s*(?:library\s+|abstract\s+)?project\s+(\w+)\s+is", body):
                yield "gpr", "", m[1].lower(), None, True
        elif name == "pom.xml":
            pick = lambda t, s: (m[1].strip() if (m := re.search(rf"<{t}>([^<$]+)</{t}>", s)) else None)
            bare = re.sub(r"(?s)<(?:parent|dependencies|build|dependencyManagement)>.*?</(?:parent|dependencies|build|dependencyManagement)>", "", body)
            if pick("artifactId", bare):
                yield "maven", pick("groupId", bare) or "", pick("artifactId", bare), pick("version", bare), True
            for dep in re.findall(r"(?s)<dependency>(.*?)</dependency>", body):
                if pick("artifactId", dep):
                    yield "maven", pick("groupId", dep) or "", pick("artifactId", dep), pick("version", dep), False
    except (ValueError, TypeError, AttributeError):
        return


def normalised_parameters(types: list[str] | None) -> str:
    """Parameter types without blanks, generic arguments erased, unknown as ?; joined by commas."""
    out = []
    for t in types or []:
        t = re.sub(r"\s+", "", t or "?")
        while (u := re.sub(r"<[^<>]*>|(?<=\w)\[[^\[\]]+\]", "", t)) != t:
            t = u
        out.append(t or "?")
    return ",".join(out)


def parse_annotation(text: str | None) -> tuple[str, dict[str, str]] | None:
    """Name and literal arguments of an annotation or decorator; only literals count."""
    m = re.match(r"\s*[@\[]?\s*([\w.]+)\s*(?:\((.*)\))?\s*\]?\s*$", text or "", re.S)
    if not m:
        return None
    args: dict[str, str] = {}
    for i, part in enumerate(re.findall(r"(?:(\w+)\s*[=:]\s*)?(\"[^\"]*\"|'[^']*'|\b\d+\b|\btrue\b|\bfalse\b)", m[2] or "")):
        args[part[0] or str(i)] = part[1].strip("\"'")
    return m[1], args
