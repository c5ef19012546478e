"""Texts read by extractors: schemas, API documents, manifests, configuration, listings.

Each query writes one text per part from a few cases, the part's key standing
where a case has ``§``; the cases say what must come out, and the SQL is made of
that.  Queries over the driver's own texts stand at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import code_facts, configuration, imports, structure, text
from graphloom.operators import extractors as X
from graphloom.plans import facts
from graphloom.plans.facts import ctes, table
from graphloom.plans.registry import ORACLE, QUERIES, query
from graphloom.plans.shared import shared_dir
from graphloom.sources import readers
from graphloom.streaming import jobs

Case = tuple[str, str, list[tuple]]


def written(spark: SparkSession, d: str, cases: Sequence[Case]) -> DataFrame:
    """(k, path, text): the text of each part's case."""
    at = (F.col("p_partkey") % len(cases) + 1).cast("int")
    fill = lambda i: F.replace(F.element_at(F.array(*(F.lit(c[i]) for c in cases)), at), F.lit("§"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), fill(0).alias("path"), fill(1).alias("text"))


def wanted(cases: Sequence[Case], schema: str) -> str:
    """SQL of the rows the cases give."""
    columns = [c.split() for c in schema.split(", ")]
    sql = lambda v, kind: "CAST(NULL AS VARCHAR)" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "replace('" + v.replace("'", "''") + "', '§', CAST(p_partkey AS VARCHAR))"
    rows = [f"SELECT p_partkey AS k, {', '.join(f'{sql(v, kind)} AS {name}' for v, (name, kind) in zip(row, columns))} FROM part WHERE p_partkey % {len(cases)} = {i}" for i, c in enumerate(cases) for row in c[2]]
    return " UNION ALL ".join(rows)


def extraction(name: str, what: str, cases: Sequence[Case], schema: str, emit: Callable[[str, str], Iterable[tuple]]) -> None:
    """Register a query that reads the cases' texts."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return X.table_function(written(spark, d, cases), ["k", "path", "text"], lambda k, path, t: ((k, *row) for row in emit(path, t)), f"k bigint, {schema}")

    run.__name__, run.__doc__ = name, what
    QUERIES[name] = run
    ORACLE[name] = wanted(cases, schema)


extraction("con_columns", "Tables and columns of CREATE TABLE statements.", [
    ("a.sql", 'CREATE TABLE IF NOT EXISTS "T§" (\n  id INT PRIMARY KEY,\n  price NUMERIC(10, 2), -- net\n  PRIMARY KEY (id)\n);', [("t§", "id", "int"), ("t§", "price", "numeric(10,")]),
    ("b.sql", "create temp table x (a int); create table s.u§ (a text)", [("s.u§", "a", "text")]), ("c.sql", "select 1", []),
], "name string, column string, type string", lambda path, t: X.tables_defined(t))
extraction("con_tables", "Tables that schemas, migrations and mapped classes declare.", [
    ("schema.prisma", 'model Item§ {\n  id Int @id\n  @@map("items_§")\n}\nmodel Plain {\n  id Int\n}', [("items_§", "prisma"), ("plain", "prisma")]),
    ("changelog.xml", '<changeSet><createTable tableName="C§"><column name="x"/></createTable></changeSet>', [("c§", "liquibase")]),
    ("changelog.yaml", "- createTable:\n    schemaName: s\n    tableName: y§\n", [("y§", "liquibase")]),
    ("V1.sql", "CREATE TABLE d§ (a int);", [("d§", "ddl")]), ("Item.java", '@Entity\n@Table(name = "j_§")\nclass Item {}', [("j_§", "orm")]), ("models.py", "class Item(Base):\n    __tablename__ = 'p_§'\n", [("p_§", "orm")]), ("a.py", "x = 1", []),
], "name string, source string", X.tables_declared)
extraction("con_table_access", "Tables that SQL reads and writes; common table expressions are none.", [
    ("", "WITH x AS (SELECT * FROM a§) INSERT INTO b§ SELECT * FROM x JOIN public.c ON true", [("b§", "write"), ("c", "read"), ("a§", "read")]), ("", "DELETE FROM d§ WHERE n = 'from z'", [("d§", "write")]), ("", 'UPDATE "E§" SET a = 1', [("e§", "write")]), ("", "", []),
], "name string, access string", lambda path, t: X.tables_accessed(t))
extraction("con_proto", "Services, calls and messages of protobuf files.", [
    ("", "package p§;\n// service No {}\nservice S { rpc Get (stream Req) returns (Res); }", [("service", "p§.S", None, None), ("rpc", "p§.S/Get", "Req", "Res")]), ("", "message M§ {}", [("message", "M§", None, None)]),
], "kind string, name string, request string, response string", lambda path, t: X.proto_symbols(t))
extraction("con_api_documents", "Operations of OpenAPI and Swagger documents, in JSON and YAML.", [
    ("", "openapi: 3.0.1\nservers:\n  - url: https://h§/v1\n  - url: http://b\npaths:\n  /a/{id}:\n    parameters: []\n    get: {}\n", [("https://h§/v1", "GET", "/a/{id}"), ("http://b", "GET", "/a/{id}")]),
    ("", '{"swagger": "2.0", "host": "h§", "basePath": "/b", "schemes": ["http"], "paths": {"/x": {"post": {}}}}', [("http://h§/b", "POST", "/x")]),
    ("", "openapi: 3.1.0\npaths:\n  /n/§: { delete: {} }\n", [(None, "DELETE", "/n/§")]), ("", "a: [", []),
], "server string, method string, path string", lambda path, t: X.api_operations(t))
extraction("con_channel_documents", "Channels of AsyncAPI documents of both generations.", [
    ("", "asyncapi: 2.6.0\nchannels:\n  q§:\n    subscribe: {}\n  r:\n    publish: {}\n", [("q§", "provides"), ("r", "consumes")]),
    ("", 'asyncapi: "3.0.0"\nchannels:\n  c:\n    address: s§\n  e: {}\noperations:\n  o:\n    action: receive\n    channel:\n      $ref: "#/channels/c"\n  p:\n    action: send\n    channel: {$ref: "#/channels/e"}\n', [("s§", "consumes"), ("e", "provides")]),
], "channel string, direction string", lambda path, t: X.channel_operations(t))
extraction("con_listeners", "Channels that listener annotations read.", [
    ("", '@KafkaListener(topics = {"a§", "b"}, groupId = "g")', [("kafka", "a§"), ("kafka", "b")]), ("", '@RabbitListener(queues = "q§")', [("rabbitmq", "q§")]), ("", '@JmsListener(destination = "d§")', [("jms", "d§")]), ("", '@KafkaListener(topics = "${topic}")', []),
], "transport string, channel string", lambda path, t: X.listeners(t))
extraction("con_manifests", "Packages that manifests of ten ecosystems provide and use.", [
    ("package.json", '{"name": "@o/n§", "version": "1.0.§", "dependencies": {"x": "^1"}, "devDependencies": {"@t/y": "2"}}', [("npm", "@o", "n§", "1.0.§", True), ("npm", "", "x", "^1", False), ("npm", "@t", "y", "2", False)]),
    ("Cargo.toml", '[package]\nname = "c§"\nversion = "0.1.0"\n[dependencies]\nserde = { version = "1" }\n', [("cargo", "", "c§", "0.1.0", True), ("cargo", "", "serde", "1", False)]),
    ("pyproject.toml", '[project]\nname = "p§"\ndependencies = ["Req>=2"]\n', [("pypi", "", "p§", None, True), ("pypi", "", "req", ">=2", False)]),
    ("go.mod", "module h.io/m§\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n", [("go", "", "h.io/m§", None, True), ("go", "", "github.com/a/b", "v1.2.3", False)]),
    ("pom.xml", "<project><groupId>g</groupId><artifactId>a§</artifactId><version>1</version><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId></dependency></dependencies></project>", [("maven", "g", "a§", "1", True), ("maven", "x", "y", None, False)]),
    ("build.gradle", 'dependencies {\n  implementation "g:n§:1.0"\n}', [("maven", "g", "n§", "1.0", False)]),
    ("a.csproj", '<Project><PackageReference Include="N§" Version="2" /></Project>', [("nuget", "", "N§", "2", False)]),
    ("setup.cfg", "[metadata]\nname = S§\nversion = 3\n[options]\ninstall_requires =\n  dep>=1\n", [("pypi", "", "s§", "3", True), ("pypi", "", "dep", ">=1", False)]),
    ("alire.toml", 'name = "al§"\nversion = "1"\n[[depends-on]]\ngnat = "^1"\n', [("alire", "", "al§", "1", True), ("alire", "", "gnat", "^1", False)]),
    ("x.gpr", 'with "lib§.gpr";\nproject P§ is\nend P§;\n', [("gpr", "", "lib§", None, False), ("gpr", "", "p§", None, True)]),
], "ecosystem string, scope string, name string, version string, provided boolean", X.manifest)
extraction("ext_registered_routes", "Routes that five families of registration write, outside of comments.", [
    ("", '@app.route("/a/§")\ndef f(): pass\n', [(1, "ANY", "/a/§")]), ("", "// app.get('/no')\napp.get('/b/§', h)", [(2, "GET", "/b/§")]), ("", '@PostMapping("/c/§")', [(1, "POST", "/c/§")]), ("", 'mux.HandleFunc("PUT /d/§", h)', [(1, "PUT", "/d/§")]), ("", '#[get("/e/§")]', [(1, "GET", "/e/§")]),
], "line int, method string, path string", lambda path, t: X.routes(t))
extraction("ext_flattened", "Dotted keys and values of configuration in five formats.", [
    ("yaml", "a:\n  b: [1, x§]\nc: 'd: e'\n", [("a.b[0]", "1"), ("a.b[1]", "x§"), ("c", "d: e")]), ("json", '{"a": {"b": true, "c": null}, "k§": 1.5}', [("a.b", "true"), ("a.c", ""), ("k§", "1.5")]), ("toml", '[t]\nk = "v§"\n', [("t.k", "v§")]),
    ("xml", '<c><b id="i§">t</b></c>', [("c.b@id", "i§"), ("c.b", "t")]), ("properties", "# no\na.b = v§\nc: d\n", [("a.b", "v§"), ("c", "d")]), ("yaml", "a: [", []),
], "key string, value string", X.config_values)
extraction("src_configuration", "Strict configuration: values, or why a file is refused.", [
    ("", "[server]\nport = §\nhost = 'h'\n", [("server.port", "§", None), ("server.host", "h", None)]), ("", "[server]\nprt = 1\n", [("", None, "unknown key server.prt")]), ("", "[odd]\n", [("", None, "unknown table odd")]), ("", "[server]\nport = 'x'\n", [("", None, "server.port is no int")]),
    ("", '[rules]\nforbid = [{from_role = "r§", to_role = "b", edge = "CALLS"}]\n', [("rules.forbid[0].from_role", "r§", None), ("rules.forbid[0].to_role", "b", None), ("rules.forbid[0].edge", "CALLS", None)]),
], "key string, value string, error string", lambda path, t: configuration.values(t))
extraction("src_aliases", "Path aliases of compiler configurations with comments and trailing commas.", [
    ("", '{ // c\n "extends": "./base.json", "compilerOptions": {"baseUrl": "./src§", "paths": {"@app/*": ["app/*"],}, } }', [("./base.json", "@app/", "src§/app/")]), ("", '{"compilerOptions": {}}', []), ("", "{", []),
], "extends string, prefix string, target string", lambda path, t: X.compiler_aliases(t))
extraction("ext_redacted_env", "Dotenv files without their values.", [
    ("", "A=§\n# c=d\nexport B = x y\nC=\n", [("A=<redacted>\n# c=d\nexport B =<redacted>\nC=\n",)]), ("", "", [("",)]),
], "redacted string", lambda path, t: [(X.env_redacted(t),)])
extraction("sec_architecture", "Systems, contexts, members and what is upstream of what.", [
    ("", "contexts:\n  sales§:\n    system: shop\n    members: [a, b]\n    upstream_of:\n      - billing\n", [("context", "sales§", "shop"), ("member", "a", "sales§"), ("member", "b", "sales§"), ("upstream_of", "sales§", "billing")]),
    ("", "apiVersion: v1\nkind: Component\nmetadata:\n  name: c§\nspec:\n  system: s\n  dependsOn:\n    - component:default/other\n", [("component", "c§", "s"), ("upstream_of", "other", "c§")]),
], "relation string, subject string, object string", lambda path, t: X.architecture(t))
extraction("sec_annotations", "Names and literal arguments of annotations.", [
    ("", '@Get("/x/§")', [("Get", "0", "/x/§")]), ("", "[Route(Name = \"n§\", Order = 2)]", [("Route", "Name", "n§"), ("Route", "Order", "2")]), ("", "@Plain", [("Plain", None, None)]),
], "name string, argument string, value string", lambda path, t: ((a[0], k, v) for a in (X.parse_annotation(t),) if a for k, v in (a[1] or {None: None}).items()))
extraction("sec_signatures", "Parameter types without blanks and generic arguments.", [
    ("", "List<Map<String, T§>>|int []|", [("List,int[],?",)]), ("", "list[int]|T§", [("list,T§",)]),
], "signature string", lambda path, t: [(X.normalised_parameters(t.split("|")),)])


_CODE: list[Case] = [
    ("c", "#define SIZE§ 3\nstatic int load§(const char *p, int n) {\n  return 1;\n}\nstruct row§ {\n", [(1, "Macro", "SIZE§"), (2, "Function", "load§"), (5, "Struct", "row§")]), ("cpp", "class Box§ : public Base {\nvoid Box§::put(int a) const {\nenum class Kind§ {\n", [(1, "Class", "Box§"), (2, "Function", "Box§::put"), (3, "Enum", "Kind§")]),
    ("csharp", "public sealed class A§ : B\n{\n    public async Task<int> Run§(int a)\n", [(1, "Class", "A§"), (3, "Method", "Run§")]), ("kotlin", "data class K§(val a: Int)\n  override suspend fun <T> go§(a: T) = 1\n", [(1, "Class", "K§"), (2, "Function", "go§")]),
    ("swift", "public struct S§ {\n  mutating func m§(a: Int) {\n", [(1, "Struct", "S§"), (2, "Function", "m§")]), ("scala", "sealed trait T§\ncase class C§(a: Int)\n  def f§(x: Int) = x\n", [(1, "Trait", "T§"), (2, "Class", "C§"), (3, "Method", "f§")]),
    ("ruby", "module M§\n  class C§ < D\n    def self.go§?\n", [(1, "Module", "M§"), (2, "Class", "C§"), (3, "Method", "go§?")]), ("php", "<?php\nfinal class P§ {\n  public static function f§($a) {\n", [(2, "Class", "P§"), (3, "Function", "f§")]),
    ("perl", "package A::B§;\nsub run§ {\n", [(1, "Module", "A::B§"), (2, "Function", "run§")]), ("ada", "package body P§ is\n   procedure Go§ (A : Integer) is\n-- function No return Integer\n   type R§ is record\n", [(1, "Module", "P§"), (2, "Function", "Go§"), (4, "Struct", "R§")]),
    ("bash", "# go() {\nrun_§() {\n", [(2, "Function", "run_§")]), ("lua", "local function l§(a)\n", [(1, "Function", "l§")]),
]


@query(wanted(_CODE, "line_no int, kind string, name string"))
def src_more_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of twelve languages the driver's texts do not hold."""
    return code_facts.definitions(written(spark, d, _CODE).withColumnRenamed("path", "language"), "k").select("k", "line_no", "kind", "name")


def _scopes(t: str) -> list[tuple[int, int, str]]:
    """Procedures of a text that end as they begin."""
    lines, out = t.split("\n"), []
    for i, line in enumerate(lines, 1):
        if line.startswith("procedure "):
            name = line.split()[1]
            out.append((i, next((k for k in range(i, len(lines) + 1) if lines[k - 1] == f"end {name};"), i), name))
    return out


extraction("txt_scope_chunks", "Chunks that keep to the scopes of a text, under their names.", [
    ("", "with A;\n\nprocedure P§ is\nbegin\nend P§;\n\nX : Integer;\n", [("", "with A;\n\n"), ("-- [P§]\n", "procedure P§ is\nbegin\nend P§;\n"), ("", "\nX : Integer;\n")]), ("", "only text §", [("", "only text §")]),
], "header string, body string", lambda path, t: ((h, t[a:b]) for a, b, h in X.scope_spans(t, _scopes(t))))


# ---- files of the shared folder


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT 'c' || p_partkey AS commit_id, 'src/f' || (p_partkey % 7) || '.py' AS path, p_size AS added, p_partkey % 3 AS removed FROM part WHERE p_partkey % 2 = 0")
def src_numstat(spark: SparkSession, d: str) -> DataFrame:
    """Lines that commits changed, from a log as the version control writes it."""
    folder = _folder(spark, "log")
    p = table(spark, d, "part").filter("p_partkey % 2 = 0")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    entry = F.concat(F.lit("c"), text("p_partkey"), F.lit("\tann\t1704164645\n"), text("p_size"), F.lit("\t"), text(F.col("p_partkey") % 3), F.lit("\tsrc/f"), text(F.col("p_partkey") % 7), F.lit(".py\n-\t-\tlogo.png\n"))
    p.select(entry.alias("value")).write.json(folder)
    out = readers.numstat(spark.read.schema("value string").json(folder)).filter("added is not null")
    return out.select(F.col("commit").alias("commit_id"), "path", "added", "removed")


@query("SELECT DISTINCT 's' || (p_partkey % 5) AS service, 'p' || (p_partkey % 3) AS peer FROM part WHERE p_partkey % 4 <> 0")
def src_spans(spark: SparkSession, d: str) -> DataFrame:
    """Services and their peers of trace documents; spans without a peer give none."""
    peer = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit('{"key": "peer.service", "value": {"stringValue": "p'), (F.col("p_partkey") % 3).cast("string"), F.lit('"}}'))).otherwise("")
    doc = F.concat(F.lit('{"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "s'), (F.col("p_partkey") % 5).cast("string"), F.lit('"}}]}, "scopeSpans": [{"spans": [{"traceId": "t", "startTimeUnixNano": "1000000", "attributes": ['), peer, F.lit("]}]}]}]}"))
    return readers.spans(table(spark, d, "part").select(doc.alias("value"))).select("service", "peer").distinct()


@query("SELECT 'f' || p_partkey AS path, p_size + 1 AS start_line, 2 AS start_column, p_size + 1 AS end_line, 9 AS end_column, 's' || p_partkey AS symbol, 'definition' AS role FROM part UNION ALL SELECT 'f' || p_partkey, 1, 0, p_size + 2, 3, 't', 'reference' FROM part WHERE p_partkey % 2 = 0")
def src_compiler_index(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of a compiler index; local symbols are none."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(', {"range": [0, 0, '), (F.col("p_size") + 1).cast("string"), F.lit(', 3], "symbol": "t"}'))).otherwise(', {"range": [1, 1, 2], "symbol": "local 1"}')
    doc = F.concat(F.lit('{"relative_path": "f'), k, F.lit('", "occurrences": [{"range": ['), n, F.lit(', 2, 9], "symbol": "s'), k, F.lit('", "symbol_roles": 1}'), other, F.lit("]}"))
    return readers.compiler_index(table(spark, d, "part").select(doc.alias("value")))


@query("WITH f AS (SELECT path, blob_sha, ingested_at FROM files WHERE blob_sha IS NOT NULL) SELECT path, max(blob_sha) AS digest FROM f JOIN (SELECT path, max(ingested_at) AS newest FROM f GROUP BY 1) USING (path) WHERE ingested_at = newest GROUP BY 1")
def str_change_feed(spark: SparkSession, d: str) -> DataFrame:
    """The newest digest of each path, fed by a stream of file rows in batches."""
    rows = jobs.stream_of(spark, d, "files").filter("blob_sha is not null").select("path", F.col("blob_sha").alias("digest"), F.struct("ingested_at", "blob_sha").alias("seen_at"))
    folder = _folder(spark, "feed")
    jobs.change_feed(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}"), _folder(spark, "feed-state"))
    return spark.read.parquet(folder).groupBy("path").agg(F.max_by("digest", "batch").alias("digest"))


# ---- the driver's own texts


@query(ctes("latest", "g_files") + r", t AS (SELECT file_id, blob_sha, any_value(text) AS text FROM sources GROUP BY ALL), j AS (SELECT f.repo_id, f.path, f.language, t.text, regexp_replace(f.path, '(^|/)[^/]*$', '') AS folder FROM g_files f LEFT JOIN t ON t.file_id = f.file_id AND t.blob_sha = f.blob_sha) SELECT DISTINCT repo_id, path, concat_ws(':', language, coalesce(CASE WHEN language IN ('java', 'go') THEN nullif(regexp_extract(text, '(?m)^\s*package\s+([\w.]+)', 1), '') END, folder)) AS module FROM j")
def res_modules(spark: SparkSession, d: str) -> DataFrame:
    """The module each latest file belongs to, by its language's rule."""
    return imports.modules(facts.latest_files(spark, d).select("repo_id", "file_id", "blob_sha", "path", "language"), table(spark, d, "sources")).distinct()


@query(r"WITH s AS (SELECT DISTINCT file_id, blob_sha, text FROM sources WHERE language = 'markdown'), l AS (SELECT file_id, blob_sha, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM s), f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*(?:```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, blob_sha ORDER BY n) AS fences FROM l) SELECT file_id, blob_sha, n AS line, length(regexp_extract(line, '^(#{1,6})\s', 1)) AS level, regexp_extract(line, '^#{1,6}\s+(.*?)\s*#*\s*$', 1) AS title FROM f WHERE fences % 2 = 0 AND regexp_matches(line, '^#{1,6}\s+(.*?)\s*#*\s*$')")
def ext_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of Markdown texts outside fenced code."""
    s = table(spark, d, "sources").filter("language = 'markdown'")
    return X.table_function(s, ["file_id", "blob_sha", "text"], lambda f, b, t: ((f, b, *h) for h in X.headings(t)), "file_id string, blob_sha string, line int, level int, title string").distinct()


@query("WITH p AS (SELECT p_partkey AS k FROM part), e AS (SELECT 'r' AS repo_id, 'a' || k || ['/x.c', '/x.cpp', '/X.kt', '/X.cs', '/X.php'][k % 5 + 1] AS path, k, k % 5 AS l FROM p) SELECT path, CASE l WHEN 0 THEN 'h' || k || '.h' WHEN 1 THEN 'lib/h' || k || '.h' WHEN 2 THEN 'org.m' || k || '.T' WHEN 3 THEN 'Org.M' || k WHEN 4 THEN 'Org\\M' || k END AS module, CASE WHEN k % 3 = 0 THEN CASE WHEN l = 1 AND k % 2 = 0 THEN 'internal_candidates' ELSE 'internal' END ELSE 'external' END AS decision FROM e")
def res_more_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports of C, C++, Kotlin, C# and PHP texts against the files of their repository; a third of the files exist."""
    k, i = F.col("p_partkey"), (F.col("p_partkey") % 5 + 1).cast("int")
    put = lambda *t: F.replace(F.element_at(F.array(*map(F.lit, t)), i), F.lit("§"), k.cast("string"))
    s = table(spark, d, "part").select("p_partkey", F.lit("r").alias("repo_id"), put("a§/x.c", "a§/x.cpp", "a§/X.kt", "a§/X.cs", "a§/X.php").alias("path"), put("c", "cpp", "kotlin", "csharp", "php").alias("language"),
        put('#include "h§.h"\nint x;', "# include <lib/h§.h>\n", "package a\nimport org.m§.T\n", "using Org.M§;\n", "<?php\nuse Org\\M§;\n").alias("text"))
    there = s.filter("p_partkey % 3 = 0").select("repo_id", F.explode(F.array(put("a§/h§.h", "include/lib/h§.h", "org/m§/T.kt", "Org/M§.cs", "src/M§.php"), F.when(k % 2 == 0, put("z", "src/lib/h§.h", "z", "z", "z")))).alias("path")).filter("path is not null")
    f = s.select("repo_id", "path").unionByName(there)
    return imports.interpreted(imports.statements(s.drop("p_partkey")), f).select("path", "module", "decision")


_READ = r"(?:os\.environ\.get\(|os\.environ\[|os\.getenv\(|getenv\(|System\.getenv\(|env::var\(|process\.env\.|os\.Getenv\(|env_or!?\(|envOr\()\s*[\"'']?([A-Za-z_]\w*)"


@query(rf"WITH s AS (SELECT DISTINCT file_id, blob_sha, text FROM sources), l AS (SELECT file_id, blob_sha, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM s) SELECT DISTINCT file_id, blob_sha, line, unnest(regexp_extract_all(t, '{_READ}', 1)) AS variable FROM l")
def ext_env_keys(spark: SparkSession, d: str) -> DataFrame:
    """Variables that texts read from the environment."""
    return X.table_function(table(spark, d, "sources"), ["file_id", "blob_sha", "text"], lambda f, b, t: ((f, b, *h) for h in X.env_keys(t)), "file_id string, blob_sha string, line int, variable string").distinct()


_CUT = "length(regexp_extract(substr(text, {s} + 1, 800), '(?s)^(.*)\n', 1))"
_END = f"CASE WHEN {{s}} + 800 >= n THEN n WHEN {_CUT} > 400 THEN {{s}} + {_CUT} + 1 ELSE {{s}} + 800 END"


@query(f"WITH RECURSIVE d AS (SELECT DISTINCT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, text, n, 0 AS i, 0 AS a, {_END.format(s='0')} AS b FROM d UNION ALL SELECT doc_id, text, n, i + 1, s, {_END.format(s='s')} FROM (SELECT *, CASE WHEN b = n THEN a + 600 ELSE b - 200 END AS s FROM c WHERE n > 800) WHERE s < n) SELECT doc_id, i AS chunk_index, a AS start_char, b AS end_char, substr(text, a + 1, b - a) AS chunk FROM c")
def txt_chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping chunks of all documents, cut at line ends past their middle."""
    return X.chunks(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text").select("doc_id", "chunk_index", "start_char", "end_char", "chunk")


@query("WITH t AS (SELECT DISTINCT corpus, file, start_byte, end_byte, label, qn FROM reference WHERE category = 'definition'), v AS (SELECT DISTINCT corpus, file, start_byte, end_byte, label, qn FROM vendored WHERE category = 'definition'), m AS (SELECT v.corpus, v.file, v.start_byte, v.end_byte, count(DISTINCT t.qn) AS n, min(t.qn) AS qn FROM v JOIN t USING (corpus, file, start_byte, end_byte, label) GROUP BY ALL) SELECT corpus, file, start_byte, end_byte, CASE WHEN n = 1 THEN qn END AS target, n > 1 AS ambiguous FROM m")
def join_exact_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of one engine mapped to another's by exact byte range and kind; several leave the target open."""
    keys = ["corpus", "file", "start_byte", "end_byte"]
    side = lambda t: table(spark, d, t).filter("category = 'definition'").select(*keys, "label", "qn").distinct()
    m = side("vendored").drop("qn").join(side("reference"), [*keys, "label"]).groupBy(*keys).agg(F.count_distinct("qn").alias("n"), F.min("qn").alias("qn"))
    return m.select(*keys, F.when(F.col("n") == 1, F.col("qn")).alias("target"), (F.col("n") > 1).alias("ambiguous"))


@query(ctes("latest", "g_nodes") + " SELECT repo_id, layer_role, count(*) AS nodes, string_agg(name, ',' ORDER BY node_id) AS names, string_agg(CAST(start_line AS VARCHAR), ',' ORDER BY node_id) AS lines FROM g_nodes WHERE kind = 'Class' AND layer_role IS NOT NULL AND start_line IS NOT NULL AND repo_id >= '4' GROUP BY ALL")
def sec_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Columns of each container's nodes in one order, of permitted repositories; a container is one role of one repository."""
    n = facts.latest_graph(spark, d, "kind", "name", "layer_role", "start_line").filter("kind = 'Class' and layer_role is not null and start_line is not null")
    return structure.tiles(n.filter("repo_id >= '4'"), ["repo_id", "layer_role"], "node_id", ["name", "start_line"]).select("repo_id", "layer_role", "nodes", F.array_join("name", ",").alias("names"), F.array_join("start_line", ",").alias("lines"))


@query("WITH a AS (SELECT l_orderkey AS site, l_suppkey % 50 AS file, l_partkey % 40 AS alias FROM lineitem), b AS (SELECT DISTINCT s_suppkey % 50 AS file, s_suppkey % 40 AS alias, s_nationkey AS place FROM supplier), m AS (SELECT DISTINCT n_nationkey AS place, r_regionkey AS member, n_name || r_name AS target FROM nation, region) SELECT DISTINCT a.site, m.target FROM a JOIN b USING (file, alias) JOIN m ON m.place = b.place AND m.member = b.alias % 5")
def join_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Bare calls by imported names, to the members of the imported files."""
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), (F.col("l_suppkey") % 50).alias("path"), (F.col("l_partkey") % 40).alias("name"))
    s = table(spark, d, "supplier")
    bound = s.select((F.col("s_suppkey") % 50).alias("path"), (F.col("s_suppkey") % 40).alias("alias"), (F.col("s_suppkey") % 40 % 5).alias("member"), F.col("s_nationkey").alias("place")).distinct()
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    own = n.select(F.col("n_nationkey").alias("path"), "n_name", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("name")).join(r, F.col("name") == F.col("r_regionkey")).select("path", "name", F.concat("n_name", "r_name").alias("target"))
    return imports.alias_targets(calls, bound, own).distinct()


@query("WITH RECURSIVE s AS (SELECT p_partkey AS site, p_partkey % 60 AS type, p_size % 9 AS name FROM part), b AS (SELECT k AS child, k + 60 AS parent FROM (SELECT unnest(range(0, 600)) AS k) UNION ALL SELECT k, k + 61 FROM (SELECT unnest(range(0, 600, 7)) AS k)), m AS (SELECT DISTINCT s_suppkey * 6 AS type, s_suppkey % 9 AS name, s_name AS target FROM supplier), r AS (SELECT site, type AS at, name, 0 AS level FROM s UNION SELECT r.site, b.parent, r.name, r.level + 1 FROM r JOIN b ON b.child = r.at), h AS (SELECT r.site, m.target, r.level FROM r JOIN m ON m.type = r.at AND m.name = r.name) SELECT DISTINCT site, target, level FROM h JOIN (SELECT site, min(level) AS level FROM h GROUP BY 1) USING (site, level)")
def join_inherited(spark: SparkSession, d: str) -> DataFrame:
    """Members found in the nearest ancestor types, over chains of ten levels and more."""
    sites = table(spark, d, "part").select(F.col("p_partkey").alias("site"), (F.col("p_partkey") % 60).alias("type"), (F.col("p_size") % 9).alias("name"))
    k = spark.range(600).select(F.col("id").alias("child"))
    bases = k.withColumn("parent", F.col("child") + 60).unionByName(k.filter("child % 7 = 0").withColumn("parent", F.col("child") + 61))
    members = table(spark, d, "supplier").select((F.col("s_suppkey") * 6).alias("type"), (F.col("s_suppkey") % 9).alias("name"), F.col("s_name").alias("target")).distinct()
    return imports.inherited_members(sites, bases, members)


@query("WITH p AS (SELECT DISTINCT '@a' || (p_partkey % 3) || '/b' || (p_size % 4) || '/x' || p_partkey AS module FROM part), a(prefix, target) AS (VALUES ('@a0/', 'src/'), ('@a0/b1/', 'lib/'), ('@a1/b', 'm/')), h AS (SELECT module, prefix, target, row_number() OVER (PARTITION BY module ORDER BY length(prefix) DESC) AS r FROM p JOIN a ON starts_with(module, prefix)) SELECT module, target || substr(module, length(prefix) + 1) AS target FROM h WHERE r = 1")
def sec_longest_alias(spark: SparkSession, d: str) -> DataFrame:
    """Modules by their most specific alias."""
    m = F.concat(F.lit("@a"), (F.col("p_partkey") % 3).cast("string"), F.lit("/b"), (F.col("p_size") % 4).cast("string"), F.lit("/x"), F.col("p_partkey").cast("string"))
    aliases = spark.createDataFrame([("@a0/", "src/"), ("@a0/b1/", "lib/"), ("@a1/b", "m/")], "prefix string, target string")
    return imports.longest_alias(table(spark, d, "part").select(m.alias("module")), aliases)


@query("WITH p AS (SELECT p_partkey AS k, 'd' || (p_partkey % 20) || '/f' || (p_partkey // 20 % 9) || ['.h', '.cpp', '.c', '.py', '', '.H'][p_partkey % 6 + 1] AS path, CASE WHEN p_partkey % 12 = 4 THEN '#!/usr/bin/env python3' WHEN p_partkey % 12 = 10 THEN '#!/bin/sh' ELSE '' END AS line FROM part), c AS (SELECT DISTINCT regexp_replace(path, '\\.[^./]*$', '') AS stem FROM p WHERE regexp_matches(path, '\\.cpp$')) SELECT k, CASE WHEN starts_with(path, 'd7/') AND path LIKE '%.py' THEN 'starlark' WHEN regexp_matches(path, '\\.[hH]$') THEN CASE WHEN c.stem IS NOT NULL THEN 'cpp' ELSE 'c' END WHEN path LIKE '%.cpp' THEN 'cpp' WHEN path LIKE '%.c' THEN 'c' WHEN path LIKE '%.py' THEN 'python' WHEN line LIKE '%python%' THEN 'python' WHEN line LIKE '%/sh' THEN 'bash' END AS language FROM p LEFT JOIN c ON c.stem = regexp_replace(path, '\\.[^./]*$', '')")
def src_language_rules(spark: SparkSession, d: str) -> DataFrame:
    """Languages by override, header rule, extension and first line, in that order."""
    ending = F.element_at(F.array(*map(F.lit, (".h", ".cpp", ".c", ".py", "", ".H"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("d"), (F.col("p_partkey") % 20).cast("string"), F.lit("/f"), (F.floor(F.col("p_partkey") / 20) % 9).cast("string"), ending)
    line = F.when(F.col("p_partkey") % 12 == 4, "#!/usr/bin/env python3").when(F.col("p_partkey") % 12 == 10, "#!/bin/sh").otherwise("")
    f = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit("r").alias("repo_id"), path.alias("path"), line.alias("first_line"))
    return text.languages(f, spark.createDataFrame([("r", r"^d7/.*\.py$", "starlark")], "repo_id string, pattern string, language string")).select("k", "language")


@query("SELECT p_partkey AS site, CASE WHEN p_size % 5 = 0 THEN 'unconfirmed' WHEN p_size % 7 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'import-guided' ELSE 'unresolved' END WHEN p_partkey % 3 = 0 THEN 'import-guided' WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'scoped' END AS band FROM part")
def res_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Members of unresolved receivers take no evidence of names, and unconfirmed sites none at all."""
    from graphloom.operators import resolution

    p = table(spark, d, "part")
    stages = {"import-guided": F.col("p_partkey") % 3 == 0, "exact": F.col("p_partkey") % 2 == 0, "scoped": F.lit(True)}
    return p.select(F.col("p_partkey").alias("site"), resolution.suppressed(stages, F.col("p_size") % 7 == 0, F.col("p_size") % 5 == 0).alias("band"))


@query("SELECT p_brand, p_size % 5 AS g, count(*) AS parts, round(avg(p_retailprice), 4) AS mean FROM part WHERE p_partkey IN (SELECT ps FROM (SELECT l_partkey AS ps, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 20) GROUP BY ALL")
def flt_metric_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the nodes that another lookup names."""
    asked = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n")).filter("n > 20").select("p_partkey")
    return table(spark, d, "part").join(asked, "p_partkey", "left_semi").groupBy("p_brand", (F.col("p_size") % 5).alias("g")).agg(F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("mean"))
