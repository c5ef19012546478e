"""Facts of code: what lines declare and call, contracts of calls, lookups by tier, evidence, reports.

Where no driver table holds a construct (routes, messages, documents of an
API), its calls and texts are written from the keys of ``part``, so that the
SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import contract_keys as K
from graphloom.functions import vocab as V
from graphloom.operators import analytics as A
from graphloom.operators import code_facts as C
from graphloom.operators import graph, imports, resolution, rules
from graphloom.plans import facts
from graphloom.plans.facts import ctes, table
from graphloom.plans.registry import query
from graphloom.plans.shared import materialise

_QUOTE = lambda s: "'" + s.replace("'", "''") + "'"
_NOT_NAMES = "(" + ", ".join(map(_QUOTE, C.NO_NAMES)) + ")"
_LINES = (
    "s AS (SELECT DISTINCT file_id, blob_sha, language, text FROM sources WHERE text IS NOT NULL AND language IS NOT NULL), "
    "r AS (SELECT file_id, blob_sha, language, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM s), "
    f"l AS (SELECT * FROM r WHERE NOT regexp_matches(line, {_QUOTE(C.COMMENT)}) OR language IN ({', '.join(map(_QUOTE, C.PREPROCESSED))}) AND regexp_matches(line, '^\\s*#'))"
)
_DEFINED = "d AS (" + " UNION ALL ".join(
    f"SELECT file_id, blob_sha, language, line_no, {_QUOTE(kind)} AS kind, regexp_extract(line, {_QUOTE(pattern)}, 1) AS name FROM l WHERE language = {_QUOTE(language)}" for language, kind, pattern in C.DEFINITIONS
) + f"), found AS (SELECT * FROM d WHERE name <> '' AND name NOT IN {_NOT_NAMES})"
_CALLED = (
    "c AS (SELECT file_id, blob_sha, language, line_no, unnest(regexp_extract_all(line, " + _QUOTE(C.CALL) + ", 1)) AS callee FROM l WHERE language IN (" + ", ".join(sorted({_QUOTE(x) for x, *_ in C.DEFINITIONS}))
    + ") AND NOT regexp_matches(line, '^\\s*(?:(?:export|pub|async|public|private|protected|static|final) +)*(?:def|class|func|function|fn) ')), called AS (SELECT * FROM c WHERE callee NOT IN " + _NOT_NAMES + ")"
)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("file_id", "blob_sha", "language", "text").distinct()


@query(f"WITH {_LINES}, {_DEFINED} SELECT file_id, blob_sha, line_no, kind, name FROM found")
def src_definitions(spark: SparkSession, d: str) -> DataFrame:
    """What the lines of every text declare, by the rules of its language."""
    return C.definitions(_texts(spark, d), "file_id", "blob_sha").select("file_id", "blob_sha", "line_no", "kind", "name")


@query(f"WITH {_LINES}, {_CALLED} SELECT file_id, blob_sha, callee, count(*) AS calls, min(line_no) AS first_line FROM called GROUP BY ALL")
def src_calls(spark: SparkSession, d: str) -> DataFrame:
    return C.calls(_texts(spark, d), "file_id", "blob_sha").groupBy("file_id", "blob_sha", "callee").agg(F.count("*").alias("calls"), F.min("line_no").alias("first_line"))


@query(ctes("latest", "g_nodes", "g_files") + f", {_LINES}, {_DEFINED}, n AS (SELECT g.file_id, f.blob_sha, f.language, g.kind, g.name FROM g_nodes g JOIN g_files f ON f.repo_id = g.repo_id AND f.file_id = g.file_id WHERE g.kind IN ('Function', 'Method', 'Class', 'Struct', 'Constructor') AND f.blob_sha IN (SELECT blob_sha FROM s)), h AS (SELECT DISTINCT file_id, blob_sha, name FROM found) SELECT n.language, n.kind, count(*) AS facts, count(h.name) AS seen FROM n LEFT JOIN h USING (file_id, blob_sha, name) GROUP BY ALL")
def src_definition_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the latest nodes the line rules see in their files' texts."""
    n = facts.latest_graph(spark, d, "kind", "name", "file_id").filter(F.col("kind").isin("Function", "Method", "Class", "Struct", "Constructor"))
    f = facts.latest_files(spark, d).select("repo_id", "file_id", "blob_sha", "language")
    texts = _texts(spark, d)
    n = n.join(f, ["repo_id", "file_id"]).join(texts.filter("text is not null and language is not null").select("blob_sha").distinct(), "blob_sha", "left_semi")
    return C.recalled(C.definitions(texts, "file_id", "blob_sha"), n, ["file_id", "blob_sha", "name"], ["language", "kind"])


_ROLE = " ".join(f"WHEN language = '{lang}' AND receiver IN ({', '.join(map(_QUOTE, words.split()))}) THEN '{role}'" for role, t in (("current", resolution.CURRENT), ("super", resolution.PARENT)) for lang, words in t.items())


@query(f"WITH {_LINES}, {_CALLED}, x AS (SELECT language, regexp_extract(callee, '^(.*)(?:->|::|\\.)[^.:>]*$', 1) AS receiver FROM called) SELECT language, CASE WHEN receiver = '' AND language = 'java' THEN 'current' WHEN receiver = '' THEN 'bare' {_ROLE} ELSE 'other' END AS role, count(*) AS calls FROM x GROUP BY ALL")
def res_receivers(spark: SparkSession, d: str) -> DataFrame:
    """What the receivers of all calls stand for, by language."""
    c = C.calls(_texts(spark, d), "file_id", "blob_sha")
    receiver, _ = resolution.split_callee(F.col("callee"))
    return c.groupBy("language", resolution.receiver_role(F.col("language"), receiver).alias("role")).agg(F.count("*").alias("calls"))


# ---- contracts of calls; ``part`` writes the calls

def _k() -> Column:
    return F.col("p_partkey")


def _pick(*values) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (_k() % len(values) + 1).cast("int"))


def _said(before: str, after: str = "") -> Column:
    return F.concat(F.lit(before), _k().cast("string"), F.lit(after))


def _args(*texts: Column) -> Column:
    return F.filter(F.array(*(F.struct(F.lit(None).cast("string").alias("keyword"), t.alias("text")) for t in texts)), lambda a: a["text"].isNotNull())


def _calls(spark: SparkSession, d: str, language: Column, callee: Column, args: Column, module: Column) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").select(F.concat(F.lit("f"), _k().cast("string")).alias("path"), language.alias("language"), callee.alias("callee"), args.alias("args"), F.when(_k() % 5 == 0, "some.other").otherwise(module).alias("module"))
    return p.select("path", "language", "callee", "args"), p.select("path", "module")


_CASE = lambda *v: "CASE p_partkey % " + str(len(v)) + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(v)) + " END"


@query(f"WITH e AS (SELECT 'f' || p_partkey AS path, {_CASE(*map(_QUOTE, ('hono', 'express', 'gin', 'echo', 'net/http', 'axum', 'actix-web', 'aspnet-minimal')))} AS framework, unnest({_CASE(*(str(list(x)) for x in (('GET',), ('POST',), ('GET',), ('ANY',), ('PUT',), ('GET', 'POST'), ('DELETE',), ('DELETE',))))}) || ' /items/' || p_partkey || '/{{}}' AS key FROM part WHERE p_partkey % 5 <> 0) SELECT * FROM e")
def con_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Routes registered in eight frameworks; a file without the library has none."""
    route = lambda q, p="": _said(f"{q}{p}/items/", f"/:id{q}")
    brace = lambda p="": _said(f'"{p}/items/', '/{id}"')
    calls, imps = _calls(
        spark, d, _pick("typescript", "javascript", "go", "go", "go", "rust", "rust", "csharp"), _pick("app.get", "router.post", "r.GET", "e.Any", "http.HandleFunc", "app.route", "app.route", "app.MapDelete"),
        _args(_pick(route("'"), route("'"), route('"'), route('"'), brace("PUT "), brace(), brace(), brace()), _pick("show", "make", "h", "h", "h", "get(show).post(make)", "web::delete().to(gone)", "() => 1")),
        _pick("hono", "express", "github.com/gin-gonic/gin", "github.com/labstack/echo/v4", "net/http", "axum::Router", "actix_web::web", "Microsoft.AspNetCore.Builder"),
    )
    return rules.endpoints(calls, imps)


@query(f"SELECT 'f' || p_partkey AS path, {_CASE(*map(_QUOTE, ('nestjs', 'aspnet', 'spring')))} AS framework, {_CASE(*map(_QUOTE, ('GET /c/', 'PUT /api/Item/', 'POST /s/')))} || p_partkey AS key FROM part WHERE p_partkey % 5 <> 0")
def con_annotated_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Routes declared by annotations under those of their class."""
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("f"), _k().cast("string")))
    own = p.select("path", F.lit(None).cast("string").alias("owner"), F.lit("ItemController").alias("target"), _pick("Controller", "Route", "RequestMapping").alias("name"), _pick("'c'", '"api/[controller]"', '"/s/"').alias("argument"))
    each = p.select("path", F.lit("ItemController").alias("owner"), F.lit("show").alias("target"), _pick("Get", "HttpPut", "PostMapping").alias("name"), _pick(_said("'", "'"), _said('"', '"'), _said('"/', '"')).alias("argument"))
    imps = p.select("path", F.when(_k() % 5 == 0, "x").otherwise(_pick("@nestjs/common", "Microsoft.AspNetCore.Mvc", "org.springframework.web.bind.annotation.PostMapping")).alias("module"))
    return rules.annotated_endpoints(own.unionByName(each), imps)


@query(f"SELECT 'f' || p_partkey AS path, {_CASE(*map(_QUOTE, ('fetch', 'axios', 'requests', 'httpx', 'RestTemplate', 'HttpClient', 'reqwest', 'net/http')))} AS client, {_CASE(*map(_QUOTE, ('DELETE', 'GET', 'PATCH', 'POST', 'PUT', 'POST', 'GET', 'HEAD')))} || ' /v1/' || p_partkey AS key FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 8 = 0")
def con_clients(spark: SparkSession, d: str) -> DataFrame:
    """Requests of eight HTTP clients; the global one needs no library."""
    url = _said('"https://h:8080/v1/', '?a=1"')
    calls, imps = _calls(
        spark, d, _pick("typescript", "javascript", "python", "python", "java", "csharp", "rust", "go"),
        _pick("fetch", "axios.get", "requests.request", "httpx.post", "template.exchange", "client.PostAsJsonAsync", "client.get", "http.NewRequest"),
        _args(_pick(url, url, '"patch"', url, url, url, url, "http.MethodHead"), _pick("{ method: 'DELETE' }", "{}", url, "json", "HttpMethod.PUT", "body", F.lit(None).cast("string"), url)),
        _pick("x", "axios", "requests", "httpx", "org.springframework.web.client.RestTemplate", "System.Net.Http", "reqwest::Client", "net/http"),
    )
    return rules.client_calls(calls, imps)


_SENT = [
    ("KafkaTemplate.send", "java", "t.send", ['"q{}"', "v"], "org.springframework.kafka.core"), ("KafkaProducer.send", "java", "p.send", ['new ProducerRecord<>("q{}", v)'], "org.apache.kafka.clients.producer"),
    ("kafka-python consumer.subscribe", "python", "c.subscribe", ["['q{}', 'q{}']"], "kafka"), ("kafkajs producer.send", "typescript", "p.send", ["{ topic: 'q{}', messages }"], "kafkajs"),
    ("pika basic_publish", "python", "ch.basic_publish", ["''", "'q{}'", "b"], "pika"), ("amqplib publish", "javascript", "ch.publish", ["'q{}'", "'k'", "b"], "amqplib"), ("go-redis Publish", "go", "rdb.Publish", ["ctx", '"q{}"', "m"], "github.com/redis/go-redis/v9"),
    ("JMS MessageProducer.send", "java", "p.send", ['session.createQueue("q{}")', "m"], "jakarta.jms.Queue"), ("nats publish", "typescript", "nc.publish", ["`q{}`"], "nats"),
]
_SENT_AS = {m[0]: (m[1], m[8]) for m in rules.MESSAGES}


@query(f"SELECT 'f' || p_partkey AS path, {_CASE(*(_QUOTE(s[0]) for s in _SENT))} AS client, {_CASE(*(_QUOTE(_SENT_AS[s[0]][0]) for s in _SENT))} AS transport, {_CASE(*(_QUOTE(_SENT_AS[s[0]][1]) for s in _SENT))} AS direction, 'q' || p_partkey AS channel FROM part WHERE p_partkey % 5 <> 0")
def con_messages(spark: SparkSession, d: str) -> DataFrame:
    """Channels that messaging clients publish to or read."""
    texts = [F.regexp_replace(_pick(*(s[3][i] if i < len(s[3]) else F.lit(None).cast("string") for s in _SENT)), r"\{\}", _k().cast("string")) for i in range(3)]
    calls, imps = _calls(spark, d, _pick(*(s[1] for s in _SENT)), _pick(*(s[2] for s in _SENT)), _args(*texts), _pick(*(s[4] for s in _SENT)))
    return rules.messages(calls, imps)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'q' || p_partkey WHEN 1 THEN 'a.b' END AS channel, CASE p_partkey % 3 WHEN 0 THEN 'h1:5432,h2/d' || p_partkey WHEN 1 THEN 'h/d' END AS identity FROM part")
def con_channels_and_databases(spark: SparkSession, d: str) -> DataFrame:
    """Channel keys without placeholders, and JDBC identities with their hosts sorted."""
    named = _pick(_said(" q", " "), "a.b", "${QUEUE}")
    url = _pick(_said("jdbc:postgresql://H2,h1:5432/d", "?ssl=1"), "jdbc:mysql://h/d", "postgres://h/d")
    return table(spark, d, "part").select("p_partkey", K.channel_key(named).alias("channel"), K.jdbc_identity(url).alias("identity"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'k' || p_partkey WHEN 1 THEN 'pos' || p_partkey END AS argument, CASE p_partkey % 4 WHEN 2 THEN 'c' || p_partkey END AS built, CASE p_partkey % 4 WHEN 3 THEN 't' || p_partkey END AS keyed FROM part")
def sec_call_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Arguments by keyword or position, constructed and inside object literals; only literals count."""
    arg = lambda k, t: F.struct(F.lit(k).cast("string").alias("keyword"), t.alias("text"))
    args = F.when(_k() % 4 == 0, F.array(arg(None, F.lit("first")), arg("name", _said("'k", "'")))).when(_k() % 4 == 1, F.array(arg(None, _said('"pos', '"')), arg("other", F.lit("'x'")))).when(_k() % 4 == 2, F.array(arg(None, _said('new ProducerRecord<A>("c', '", v)')))).otherwise(F.array(arg(None, _said('{ topic: "t', '", n: 1 }'))))
    one = C.argument(args, keyword="name", position=0)
    return table(spark, d, "part").select("p_partkey", C.literal(one).alias("argument"), C.constructed(one, ["ProducerRecord"]).alias("built"), C.object_key(one, "topic").alias("keyed"))


@query("WITH p AS (SELECT DISTINCT l_suppkey AS caller, 'a' || l_linenumber AS parameter, l_returnflag AS type FROM lineitem), t AS (SELECT caller, parameter, CASE WHEN count(DISTINCT type) = 1 THEN min(type) END AS type FROM p GROUP BY ALL) SELECT ps_partkey AS site, s_suppkey AS caller, t.type FROM (SELECT s_suppkey, s_suppkey % 9 AS ps_partkey FROM supplier) LEFT JOIN t ON t.caller = s_suppkey AND t.parameter = 'a' || ps_partkey")
def sec_receiver_types(spark: SparkSession, d: str) -> DataFrame:
    """The declared type of a call's receiver among its caller's parameters."""
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("parameter"), F.col("l_returnflag").alias("type")).distinct()
    c = table(spark, d, "supplier").select((F.col("s_suppkey") % 9).alias("site"), F.col("s_suppkey").alias("caller"), F.concat(F.lit("a"), (F.col("s_suppkey") % 9).cast("string")).alias("receiver"), F.col("s_name").alias("name"))
    return C.receiver_types(c, p).select("site", "caller", "type")


# ---- lookups by tier

_TYPES = "t AS (SELECT node_id AS type, repo_id AS repo, regexp_replace(qualified_name, '\\.[^.]*$', '') AS module, qualified_name, name, file_id FROM g_nodes WHERE kind IN ('Class', 'Struct')), n AS (SELECT *, lead(name) OVER (PARTITION BY repo ORDER BY type) AS after, lead(qualified_name) OVER (PARTITION BY repo ORDER BY type) AS qafter FROM t), b AS (SELECT type AS child, repo, module, file_id, CASE WHEN type < '8' THEN after ELSE qafter END AS base FROM n WHERE after IS NOT NULL)"


@query(ctes("latest", "g_nodes") + f", {_TYPES}, i AS (SELECT DISTINCT b.file_id, b.base AS name, t.type FROM b JOIN t ON t.repo = b.repo AND t.name = b.base WHERE t.type > 'R'), f AS (SELECT child, base, 0 AS p, t.type FROM b JOIN t ON t.repo = b.repo AND t.qualified_name = b.base UNION ALL SELECT child, base, 1, t.type FROM b JOIN t ON t.repo = b.repo AND t.module = b.module AND t.name = b.base UNION ALL SELECT child, base, 2, i.type FROM b JOIN i ON i.file_id = b.file_id AND i.name = b.base UNION ALL SELECT child, base, 3, t.type FROM b JOIN t ON t.repo = b.repo AND t.name = b.base), m AS (SELECT child, base, min(p) AS p FROM f GROUP BY ALL) SELECT m.child, m.base, ['qualified', 'module', 'import', 'repository'][m.p + 1] AS tier, CASE WHEN count(DISTINCT f.type) = 1 THEN min(f.type) END AS target FROM m JOIN f ON f.child = m.child AND f.base = m.base AND f.p = m.p GROUP BY m.child, m.base, m.p")
def res_base_types(spark: SparkSession, d: str) -> DataFrame:
    """What the base of each type means; a type's base is the name of the next type of its repository."""
    g = facts.latest_graph(spark, d, "kind", "name", "qualified_name", "file_id").filter(F.col("kind").isin("Class", "Struct"))
    t = materialise(g.select(F.col("node_id").alias("type"), F.col("repo_id").alias("repo"), F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("module"), "qualified_name", "name", "file_id"), "types")
    after = Window.partitionBy("repo").orderBy("type")
    b = t.withColumn("base", F.when(F.col("type") < "8", F.lead("name").over(after)).otherwise(F.lead("qualified_name").over(after))).filter("base is not null")
    b = materialise(b.select(F.col("type").alias("child"), "repo", "module", F.col("file_id").alias("file"), "base"), "bases")
    seen = b.select("repo", "file", F.col("base").alias("name")).join(t.select("repo", "name", "type"), ["repo", "name"]).filter("type > 'R'").select("file", "name", "type").distinct()
    return imports.base_types(b, t, seen)


def supplier_parents(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): up to two parents of each type."""
    s = table(spark, d, "supplier").filter("s_suppkey > 8").select(F.col("s_suppkey").alias("child"))
    return s.withColumn("parent", F.col("child") - 1 - F.col("child") % 7).unionByName(s.withColumn("parent", F.floor(F.col("child") / 2)))


@query("WITH RECURSIVE e AS (SELECT s_suppkey AS child, s_suppkey - 1 - s_suppkey % 7 AS parent FROM supplier WHERE s_suppkey > 8 UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_suppkey > 8), r AS (SELECT child AS node, parent AS ancestor, 1 AS level FROM e UNION SELECT r.node, e.parent, r.level + 1 FROM r JOIN e ON e.child = r.ancestor) SELECT node, ancestor, min(level) AS level FROM r GROUP BY ALL")
def gr_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Every ancestor of every type that may have several parents, nearest level, however deep."""
    return graph.hierarchy_levels(supplier_parents(spark, d))


@query("WITH x AS (SELECT l_orderkey AS site, o_custkey % 100 AS file, 'm' || (l_suppkey % 10) || '.n' || (l_partkey % 10) AS module, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey), i AS (SELECT DISTINCT c_custkey % 100 AS file, 'm' || (c_nationkey % 10) || CASE WHEN c_custkey % 2 = 0 THEN '.n' || (c_custkey % 10) || '.x' ELSE '' END AS module FROM customer), d AS (SELECT DISTINCT file, module FROM x), r AS (SELECT DISTINCT d.file, d.module FROM d JOIN i ON i.file = d.file AND (starts_with(d.module || '.', i.module || '.') OR starts_with(i.module || '.', d.module || '.'))) SELECT r.file IS NOT NULL AS reachable, count(*) AS candidates FROM x LEFT JOIN r USING (file, module) GROUP BY 1")
def res_reachable(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates lie in a module that their file imports from, or whose part it imports."""
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    text = lambda c: (F.col(c) % 10).cast("string")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("site"), (F.col("o_custkey") % 100).alias("file"), F.concat(F.lit("m"), text("l_suppkey"), F.lit(".n"), text("l_partkey")).alias("module"))
    i = c.select((F.col("c_custkey") % 100).alias("file"), F.concat(F.lit("m"), text("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(".n"), text("c_custkey"), F.lit(".x"))).otherwise("")).alias("module")).distinct()
    return resolution.reachable(x, i).groupBy("reachable").agg(F.count("*").alias("candidates"))


@query("WITH k AS (SELECT DISTINCT s_name AS target FROM supplier WHERE length(s_name) > 2), a AS (SELECT c_custkey AS site, replace(replace(c_name, 'Customer', 'Suplier'), '#00', '#0') AS asked FROM customer), p AS (SELECT a.site, k.target, levenshtein(asked, target) AS distance FROM a JOIN k ON abs(length(asked) - length(target)) <= 2 WHERE levenshtein(asked, target) BETWEEN 1 AND 2), m AS (SELECT site, min(distance) AS distance FROM p GROUP BY 1) SELECT site, min(target) AS target, distance FROM m JOIN p USING (site, distance) GROUP BY site, distance HAVING count(*) = 1")
def res_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The one name within two edits of a name nothing else resolved."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.regexp_replace(F.regexp_replace("c_name", "Customer", "Suplier"), "#00", "#0").alias("name"))
    return resolution.fuzzy_fallback(c, table(spark, d, "supplier").select(F.col("s_name").alias("name")), "site", "name")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'route_reg' WHEN 2 THEN 'grpc' END AS service FROM part WHERE p_partkey % 4 <> 3")
def res_services(spark: SparkSession, d: str) -> DataFrame:
    """What the library of a callee is used for."""
    p = table(spark, d, "part").select("p_partkey", _pick(_said("requests.get", ""), _said("axum::Router", ""), _said("tonic.x", ""), _said("mine.f", "")).alias("callee"))
    return p.join(rules.service_kind(spark, p), "callee").select("p_partkey", "service")


# ---- evidence, lookups, reports


@query("WITH v AS (SELECT DISTINCT corpus, file, start_byte, end_byte, strategy, reason FROM reference WHERE category = 'typed'), q AS (SELECT DISTINCT corpus, file FROM vendored WHERE category = 'typed' AND confidence < 0.8) SELECT v.corpus, v.file, v.start_byte, v.strategy, v.reason FROM v SEMI JOIN q USING (corpus, file)")
def flt_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence in the files of which another engine has doubtful answers."""
    r = table(spark, d, "reference").filter("category = 'typed'").select("corpus", "file", "start_byte", "end_byte", "strategy", "reason").distinct()
    q = table(spark, d, "vendored").filter("category = 'typed' and confidence < 0.8").select("corpus", "file").distinct()
    return r.join(q, ["corpus", "file"], "left_semi").select("corpus", "file", "start_byte", "strategy", "reason")


@query(ctes("latest", "g_files") + " SELECT status, status_reason, count(*) AS files FROM g_files GROUP BY ALL")
def sec_file_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Status and reason of files by the outcome of their extraction."""
    f = facts.latest_files(spark, d)
    said = F.concat_ws(":", "status", "status_reason")
    outcome = F.lit(None).cast("string")
    for name, (status, reason) in C.OUTCOMES.items():
        outcome = F.when(said == ":".join(x for x in (status, reason) if x), name).otherwise(outcome)
    status, reason = C.file_status(outcome)
    return f.groupBy(status.alias("status"), reason.alias("status_reason")).agg(F.count("*").alias("files"))


@query("WITH x AS (SELECT label, regexp_extract(corpus, '^[^/]*', 0) AS language, regexp_extract(qn, '[^.]*$', 0) AS name FROM reference WHERE category = 'definition' AND qn <> '') SELECT CASE WHEN label IN ('Class', 'Interface', 'Enum', 'Struct', 'Trait', 'TypeAlias', 'Function', 'Method', 'Constructor', 'Field', 'Variable', 'Macro', 'Module') THEN label END AS kind, CASE WHEN language = 'go' THEN CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'public' ELSE 'internal' END WHEN language = 'python' THEN CASE WHEN regexp_matches(name, '^__.*__$') THEN 'public' WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END END AS visibility, count(*) AS definitions FROM x GROUP BY ALL")
def sec_node_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Node kinds of an engine's definitions, and the visibility that two languages' names show."""
    r = table(spark, d, "reference").filter("category = 'definition' and qn <> ''")
    name, language = F.regexp_extract("qn", "[^.]*$", 0), F.regexp_extract("corpus", "^[^/]*", 0)
    return r.groupBy(C.node_kind(F.col("label")).alias("kind"), C.visibility(language, name).alias("visibility")).agg(F.count("*").alias("definitions"))


@query("SELECT r_name AS region, n_name AS project, s_name AS stream, count(c_custkey) AS sources FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 50 = s_suppkey % 50 GROUP BY ALL")
def join_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Projects with their streams and what feeds them; a stream without a source stays."""
    r, n, s, c = (table(spark, d, t) for t in ("region", "nation", "supplier", "customer"))
    x = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(s, F.col("s_nationkey") == F.col("n_nationkey"))
    x = x.join(c, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_custkey") % 50 == F.col("s_suppkey") % 50), "left")
    return x.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("project"), F.col("s_name").alias("stream")).agg(F.count("c_custkey").alias("sources"))


@query(ctes("latest", "g_nodes") + ", o AS (SELECT repo_id, node_id, CASE WHEN node_id > 'N' THEN parent_id ELSE node_id END AS owner FROM g_nodes WHERE kind = 'File') SELECT repo_id, node_id AS contract, owner FROM o WHERE owner IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g_nodes g WHERE g.repo_id = o.repo_id AND g.node_id = o.owner AND g.kind = 'File')")
def con_owner_defects(spark: SparkSession, d: str) -> DataFrame:
    """Contracts whose owner is no file node of their repository."""
    g = materialise(facts.latest_graph(spark, d, "kind", "parent_id").filter("kind = 'File'"), "files")
    o = g.select("repo_id", F.col("node_id").alias("contract"), F.when(F.col("node_id") > "N", F.col("parent_id")).otherwise(F.col("node_id")).alias("owner"))
    return o.filter("owner is not null").join(g.select("repo_id", F.col("node_id").alias("owner")), ["repo_id", "owner"], "left_anti").select("repo_id", "contract", "owner")


@query(ctes("latest", "g_nodes") + ", x AS (SELECT repo_id, regexp_extract(qualified_name, '^[^./]*', 0) AS subsystem, kind, name FROM g_nodes) SELECT repo_id, subsystem, count(*) AS symbols, count(DISTINCT kind) AS kinds, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 10), ',') AS sample FROM x GROUP BY repo_id, subsystem QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, subsystem) <= 30")
def agg_subsystems(spark: SparkSession, d: str) -> DataFrame:
    """The thirty largest subsystems of each repository, with the first ten names of each; samples are kept by count, not by list."""
    x = facts.latest_graph(spark, d, "kind", "name", "qualified_name").withColumn("subsystem", F.regexp_extract("qualified_name", "^[^./]*", 0))
    size = x.groupBy("repo_id", "subsystem").agg(F.count("*").alias("symbols"), F.count_distinct("kind").alias("kinds"))
    size = graph.first_by(size, ["repo_id"], [F.col("symbols").desc(), F.col("subsystem")], 30)
    names = graph.first_by(x.filter("name is not null").select("repo_id", "subsystem", "name").distinct(), ["repo_id", "subsystem"], [F.col("name")], 10)
    names = names.groupBy("repo_id", "subsystem").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("sample"))
    return size.join(names, ["repo_id", "subsystem"], "left")


@query("WITH v AS (SELECT * FROM reference QUALIFY row_number() OVER (PARTITION BY corpus, category, file, start_byte, end_byte ORDER BY emitted_at DESC) = 1), w AS (SELECT * FROM vendored QUALIFY row_number() OVER (PARTITION BY corpus, category, file, start_byte, end_byte ORDER BY emitted_at DESC) = 1), c AS (SELECT corpus, count(*) AS sites, count(*) FILTER (WHERE confidence >= 0.9) AS drawn FROM v WHERE category = 'typed' GROUP BY 1), e AS (SELECT v.corpus, count(*) FILTER (WHERE coalesce(v.strategy, '') = coalesce(w.strategy, '')) AS same, count(*) AS sides FROM v JOIN w USING (corpus, category, file, start_byte, end_byte) GROUP BY 1) SELECT corpus, sites, drawn, round(drawn / sites, 6) AS band_coverage, round(same / sides, 6) AS equivalence FROM c JOIN e USING (corpus)")
def fresh_quality(spark: SparkSession, d: str) -> DataFrame:
    """Drawn share of call sites, and how far a rebuild gave the same, per corpus."""
    from graphloom.functions.rows import valid_rows

    keys = ["corpus", "category", "file", "start_byte", "end_byte"]
    v, w = (valid_rows(table(spark, d, t).select(*keys, "strategy", "confidence", "emitted_at"), keys, "emitted_at") for t in ("reference", "vendored"))
    c = v.filter("category = 'typed'").groupBy("corpus").agg(F.count("*").alias("sites"), F.count_if(F.col("confidence") >= 0.9).alias("drawn"))
    text = lambda c: F.coalesce(c, F.lit(""))
    e = v.select(*keys, F.col("strategy").alias("a")).join(w.select(*keys, F.col("strategy").alias("b")), keys).groupBy("corpus").agg(F.count_if(text("a") == text("b")).alias("same"), F.count("*").alias("both"))
    return c.join(e, "corpus").select("corpus", "sites", "drawn", F.round(F.col("drawn") / F.col("sites"), 6).alias("band_coverage"), F.round(F.col("same") / F.col("both"), 6).alias("equivalence"))


@query(ctes("latest", "g_nodes") + " SELECT p.qualified_name AS src, c.qualified_name AS dst, 'CONTAINS' AS kind, c.repo_id FROM g_nodes c JOIN g_nodes p ON p.repo_id = c.repo_id AND p.node_id = c.parent_id WHERE c.kind IN ('Method', 'Constructor')")
def agg_golden_edges(spark: SparkSession, d: str) -> DataFrame:
    """Drawn edges by qualified names, sorted: what a golden file holds."""
    g = materialise(facts.latest_graph(spark, d, "kind", "qualified_name", "parent_id"), "nodes")
    c = g.filter(F.col("kind").isin("Method", "Constructor")).select("repo_id", F.col("qualified_name").alias("dst"), F.col("parent_id").alias("node_id"))
    return c.join(g.select("repo_id", "node_id", F.col("qualified_name").alias("src")), ["repo_id", "node_id"]).select("src", "dst", F.lit("CONTAINS").alias("kind"), "repo_id").orderBy("repo_id", "src", "dst")


@query(ctes("latest", "g_files") + ", u AS (SELECT repo_id, file_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY file_id) AS n FROM g_files), e AS (SELECT a.repo_id, a.path AS p, b.path AS q FROM u a JOIN u b ON b.repo_id = a.repo_id AND b.n = a.n + 1), x AS (SELECT repo_id, level, array_to_string(string_split(p, '/')[1:level], '/') AS src, array_to_string(string_split(q, '/')[1:level], '/') AS dst FROM e, (SELECT unnest([1, 2, 3]) AS level)) SELECT repo_id, level, src, dst, count(*) AS n, least(1.0, count(*) / 10) AS weight FROM x WHERE src <> dst GROUP BY ALL")
def gr_level_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the folders that are visible at each of three levels; an edge joins a file to the next of its repository."""
    f = materialise(facts.latest_files(spark, d).select("repo_id", F.col("file_id").alias("node"), "path"), "files")
    after = F.lead("node").over(Window.partitionBy("repo_id").orderBy("node"))
    e = materialise(f.select("repo_id", F.col("node").alias("src"), after.alias("dst")).filter("dst is not null"), "edges")
    out = None
    for level in (1, 2, 3):
        shown = f.select("node", F.concat_ws("\x01", "repo_id", F.array_join(F.slice(F.split("path", "/"), 1, level), "/")).alias("shown"))
        part = graph.lift_edges(e, shown).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    cut = lambda c, k: F.element_at(F.split(c, "\x01"), k)
    return out.select(cut("src", 1).alias("repo_id"), "level", cut("src", 2).alias("src"), cut("dst", 2).alias("dst"), "n", "weight")


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total, true AS has_more, 'parts:' || md5('order by price') || ':40' AS cursor FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20")
def top_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a listing with its total and the cursor of the next."""
    order = [F.col("p_retailprice").desc(), F.col("p_partkey")]
    _, _, after = A.paged(table(spark, d, "part"), order, 20, "parts", "order by price")
    rows, total, after = A.paged(table(spark, d, "part"), order, 20, "parts", "order by price", cursor=after)
    told = total.first()
    return rows.select("p_partkey", "p_name", F.lit(told["total"]).alias("total"), F.lit(told["has_more"]).alias("has_more"), F.lit(after).alias("cursor"))


@query(ctes("call_edges") + " SELECT s_nationkey AS from_context, p_size AS to_context, count(*) AS edges FROM call_edges JOIN supplier ON s_suppkey = src JOIN part ON p_partkey = dst WHERE band IN ('precise', 'typed', 'import-guided', 'inheritance-guided', 'exact', 'scoped') AND (s_nationkey, p_size) IN ((1, 5), (2, 7), (3, 9)) GROUP BY ALL")
def an_rule_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Drawn edges between contexts of which a rule forbids it."""
    e = facts.call_edges(spark, d).withColumn("dst", -1 - F.col("dst"))
    members = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("context")).unionByName(table(spark, d, "part").select((-1 - F.col("p_partkey")).alias("node"), F.col("p_size").alias("context")))
    return A.forbidden_contexts(e, members, [(1, 5), (2, 7), (3, 9)]).groupBy("from_context", "to_context").agg(F.count("*").alias("edges"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, CASE WHEN s_nationkey < 20 THEN s_nationkey // 10 * 10 + (s_nationkey + 1) % 10 ELSE s_nationkey - 1 END AS dst FROM supplier), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT a.src AS node, greatest(a.src, max(a.dst)) AS cycle FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src")
def an_rule_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The members of the cycles that a rule forbids at the level of contexts."""
    n = F.col("s_nationkey")
    e = table(spark, d, "supplier").select(n.alias("src"), F.when(n < 20, F.floor(n / 10) * 10 + (n + 1) % 10).otherwise(n - 1).alias("dst")).distinct()
    return A.forbidden_cycles(materialise(e, "edges"))


@query(ctes("latest", "g_files") + " SELECT repo_id, count(*) AS files, count(*) FILTER (WHERE status = 'parsed') AS parsed, count(*) FILTER (WHERE status IN ('failed', 'skipped')) AS lost, array_to_string(list_sort(list_distinct(list(status_reason))), ',') AS reasons FROM g_files GROUP BY 1")
def sec_report(spark: SparkSession, d: str) -> DataFrame:
    """The summary of each repository's index: counts and the reasons there are."""
    f = facts.latest_files(spark, d)
    reasons = F.array_join(F.array_sort(F.collect_set("status_reason")), ",")  # a closed vocabulary
    return f.groupBy("repo_id").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "parsed").alias("parsed"), F.count_if(F.col("status").isin("failed", "skipped")).alias("lost"), reasons.alias("reasons"))


@query("SELECT source, count(*) AS documents, sum(ceil(length(text) / 600.0))::BIGINT AS chunks, count(*) FILTER (WHERE length(text) > 0) > 0 AS indexed FROM (SELECT doc_id, lower(trim(source)) AS source, text FROM documents WHERE source IS NOT NULL) GROUP BY 1")
def sec_corpus_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """What each corpus holds: documents, chunks, and whether anything is indexed."""
    x = table(spark, d, "documents").filter("source is not null").select(F.lower(F.trim("source")).alias("source"), "text")
    return x.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.ceil(F.length("text") / 600.0)).cast("bigint").alias("chunks"), (F.count_if(F.length("text") > 0) > 0).alias("indexed"))


@query("WITH a AS (SELECT DISTINCT corpus, file, start_line, regexp_extract(qn, '[^.]*$', 0) AS name, qn FROM vendored WHERE category = 'definition' AND qn <> ''), b AS (SELECT DISTINCT corpus, file, start_line, regexp_extract(qn, '[^.]*$', 0) AS name, qn FROM reference WHERE category = 'definition' AND qn <> ''), c AS (SELECT a.corpus || a.file || a.qn || a.start_line AS site, b.qn || ':' || b.start_line AS candidate, regexp_extract(a.qn, '[^.]*\\.[^.]*$', 0) = regexp_extract(b.qn, '[^.]*\\.[^.]*$', 0) AS e1, a.start_line = b.start_line AS e2 FROM a JOIN b USING (corpus, file, name)), n AS (SELECT site, count(*) AS n, sum(e1::INT) AS n1 FROM c GROUP BY 1), i AS (SELECT c.*, n.n, n.n1, CASE WHEN n1 > 0 THEN e1 ELSE true END AS i1 FROM c JOIN n USING (site)), m AS (SELECT site, n, n1, sum((i1 AND e2)::INT) AS n2 FROM i GROUP BY ALL) SELECT CASE WHEN n = 1 THEN 'name' WHEN n1 = 1 THEN 'suffix' WHEN n2 = 1 THEN 'line' ELSE 'open' END AS decided, count(*) AS definitions FROM m GROUP BY 1")
def sec_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of two generations matched by file and name, then qualified suffix, then line, each only if it leaves one."""
    side = lambda t: table(spark, d, t).filter("category = 'definition' and qn <> ''").select("corpus", "file", "start_line", F.regexp_extract("qn", "[^.]*$", 0).alias("name"), "qn").distinct()
    a, b = side("vendored").alias("a"), side("reference").alias("b")
    tail = lambda c: F.regexp_extract(c, r"[^.]*\.[^.]*$", 0)
    c = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("corpus", "file", "name")]).select(
        F.concat("a.corpus", "a.file", "a.qn", F.col("a.start_line").cast("string")).alias("site"), F.concat("b.qn", F.lit(":"), F.col("b.start_line").cast("string")).alias("candidate"),
        F.lit(True).alias("e0"), (tail("a.qn") == tail("b.qn")).alias("e1"), (F.col("a.start_line") == F.col("b.start_line")).alias("e2"),
    )
    out = resolution.narrow(c, "site", "candidate", [("e0", "name"), ("e1", "suffix"), ("e2", "line")])
    return out.groupBy(F.coalesce("stage", F.lit("open")).alias("decided")).agg(F.count("*").alias("definitions"))


@query("WITH l AS (SELECT DISTINCT path, regexp_extract(text, '^[^\\n]*', 0) AS line, language FROM sources) SELECT CASE WHEN language IN ('bash', 'python') AND regexp_matches(line, '^#!.*\\bpython') THEN 'python' WHEN language IN ('bash', 'python') AND regexp_matches(line, '^#!.*\\b(?:bash|sh)\\b') THEN 'bash' ELSE 'none' END AS shebang, count(*) AS files FROM l GROUP BY 1")
def src_shebangs(spark: SparkSession, d: str) -> DataFrame:
    """The language a text's first line asks for, for scripts."""
    l = table(spark, d, "sources").select("path", F.regexp_extract("text", r"^[^\n]*", 0).alias("line"), "language").distinct()  # noqa: E741
    script = F.col("language").isin("bash", "python")
    said = F.when(script & F.col("line").rlike(r"^#!.*\bpython"), "python").when(script & F.col("line").rlike(r"^#!.*\b(?:bash|sh)\b"), "bash").otherwise("none")
    return l.groupBy(said.alias("shebang")).agg(F.count("*").alias("files"))


@query("SELECT event_id, user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT min(CAST(ts AS DATE)) + 5 FROM events) AND (SELECT min(CAST(ts AS DATE)) + 11 FROM events)")
def snk_audit_export(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows of a range of days, written as JSON lines and read back."""
    from graphloom.operators.segments import export_range

    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    first = e.agg(F.min("day")).first()[0]
    out = export_range(e.select("event_id", "user_id", "event_type", "day"), "day", F.date_add(F.lit(first), 5), F.date_add(F.lit(first), 11))
    return out.select("event_id", "user_id", "event_type", F.col("day").cast("string").alias("day"))
