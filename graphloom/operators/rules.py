"""Data-driven rules over calls: HTTP servers and clients, messaging, service patterns, API documents.

A rule needs its library among the file's imports and its operation at the
call; the receiver's name alone is never evidence.  Rule tables are small
constants and are broadcast; calls meet them by language and operation.

Calls are (path, language, callee, args), args an array of (keyword, text)
structs; imports are (path, module).  Destinations and routes that are no
literals give no row, nor do null callees or arguments.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.contract_keys import api_key, channel_key
from graphloom.operators.code_facts import argument, constructed, listed, literal, object_key
from graphloom.operators.resolution import split_callee

_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
# Fixed values: (framework, languages, library, library that rules it out, {operation: method}); "" as a method: the route's own, or the second argument's.
ENDPOINTS = [
    ("hono", "javascript typescript", "hono", "express", {v: v.upper() for v in _VERBS if v != "head"} | {"all": "ANY"}),
    ("express", "javascript typescript", "express", None, {v: v.upper() for v in _VERBS} | {"all": "ANY"}),
    ("gin", "go", "github.com/gin-gonic/gin", "github.com/labstack/echo", {v.upper(): v.upper() for v in _VERBS} | {"Any": "ANY"}),
    ("echo", "go", "github.com/labstack/echo", "github.com/gin-gonic/gin", {v.upper(): v.upper() for v in _VERBS} | {"Any": "ANY"}),
    ("net/http", "go", "net/http", "github.com/gorilla/mux", {"HandleFunc": "", "Handle": ""}),
    ("axum", "rust", "axum", "actix_web", {"route": ""}),
    ("actix-web", "rust", "actix_web", "axum", {"route": ""}),
    ("aspnet-minimal", "csharp", "Microsoft.AspNetCore.Builder", None, {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}),
]
# Fixed values: (framework, library, controller's annotation, {annotation: method}).
ANNOTATED = [
    ("nestjs", "@nestjs/common", "Controller", {"Get": "GET", "Post": "POST", "Put": "PUT", "Delete": "DELETE", "Patch": "PATCH", "Options": "OPTIONS", "Head": "HEAD", "All": "ANY"}),
    ("aspnet", "Microsoft.AspNetCore.Mvc", "Route", {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH", "HttpHead": "HEAD", "HttpOptions": "OPTIONS"}),
    ("actix-web", "actix_web", "", {v: v.upper() for v in _VERBS}),
    ("spring", "org.springframework.web.bind.annotation", "RequestMapping", {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}),
]
# Fixed values: (client, languages, library or "" for a global, receiver or "" for any, {operation: (method or position of the method, position of the URL)}).
CLIENTS = [
    ("fetch", "javascript typescript", "", "", {"fetch": ("GET", 0)}),
    ("axios", "javascript typescript", "axios", "axios", {v: (v.upper(), 0) for v in _VERBS}),
    ("requests", "python", "requests", "requests", {v: (v.upper(), 0) for v in _VERBS} | {"request": ("0", 1)}),
    ("httpx", "python", "httpx", "httpx", {v: (v.upper(), 0) for v in _VERBS} | {"request": ("0", 1)}),
    ("RestTemplate", "java kotlin", "org.springframework.web.client", "", {
        "getForObject": ("GET", 0), "getForEntity": ("GET", 0), "postForObject": ("POST", 0), "postForEntity": ("POST", 0), "postForLocation": ("POST", 0), "put": ("PUT", 0), "delete": ("DELETE", 0),
        "patchForObject": ("PATCH", 0), "headForHeaders": ("HEAD", 0), "optionsForAllow": ("OPTIONS", 0), "exchange": ("1", 0)}),
    ("HttpClient", "csharp", "System.Net.Http", "", {
        "GetAsync": ("GET", 0), "GetStringAsync": ("GET", 0), "GetByteArrayAsync": ("GET", 0), "GetStreamAsync": ("GET", 0), "GetFromJsonAsync": ("GET", 0), "PostAsync": ("POST", 0), "PostAsJsonAsync": ("POST", 0),
        "PutAsync": ("PUT", 0), "PutAsJsonAsync": ("PUT", 0), "PatchAsync": ("PATCH", 0), "PatchAsJsonAsync": ("PATCH", 0), "DeleteAsync": ("DELETE", 0), "DeleteFromJsonAsync": ("DELETE", 0)}),
    ("reqwest", "rust", "reqwest", "", {v: (v.upper(), 0) for v in _VERBS}),
    ("net/http", "go", "net/http", "http", {"NewRequest": ("0", 1), "NewRequestWithContext": ("1", 2), "Get": ("GET", 0), "Head": ("HEAD", 0), "Post": ("POST", 0), "PostForm": ("POST", 0)}),
]
# Fixed values: (client, transport, languages, libraries, operations, receiver types if declared, fewest arguments, destination, direction).
MESSAGES = [
    ("KafkaTemplate.send", "kafka", "java", "org.springframework.kafka", "send", "KafkaTemplate", 2, "0", "provides"),
    ("KafkaProducer.send", "kafka", "java", "org.apache.kafka.clients.producer", "send", "KafkaProducer Producer", 1, "constructed", "provides"),
    ("KafkaConsumer.subscribe", "kafka", "java", "org.apache.kafka.clients.consumer", "subscribe", "KafkaConsumer Consumer", 1, "list", "consumes"),
    ("kafka-python producer.send", "kafka", "python", "kafka aiokafka", "send send_and_wait", "", 1, "0", "provides"),
    ("kafka-python consumer.subscribe", "kafka", "python", "kafka aiokafka", "subscribe", "", 1, "list", "consumes"),
    ("confluent-kafka produce", "kafka", "python", "confluent_kafka", "produce", "", 1, "0", "provides"),
    ("confluent-kafka subscribe", "kafka", "python", "confluent_kafka", "subscribe", "", 1, "list", "consumes"),
    ("kafkajs producer.send", "kafka", "javascript typescript", "kafkajs", "send", "", 1, "topic", "provides"),
    ("kafkajs consumer.subscribe", "kafka", "javascript typescript", "kafkajs", "subscribe", "", 1, "topic", "consumes"),
    ("pika basic_publish", "rabbitmq", "python", "pika", "basic_publish", "", 2, "amqp", "provides"),
    ("amqplib sendToQueue", "rabbitmq", "javascript typescript", "amqplib amqp-connection-manager", "sendToQueue", "", 2, "0", "provides"),
    ("amqplib publish", "rabbitmq", "javascript typescript", "amqplib amqp-connection-manager", "publish", "", 3, "amqp", "provides"),
    ("nats publish", "nats", "javascript typescript", "nats", "publish", "", 1, "0", "provides"),
    ("nats-py publish", "nats", "python", "nats", "publish", "", 1, "0", "provides"),
    ("nats.go Publish", "nats", "go", "github.com/nats-io/nats.go", "Publish", "", 1, "0", "provides"),
    ("redis-py publish", "redis", "python", "redis aioredis", "publish", "", 2, "0", "provides"),
    ("ioredis publish", "redis", "javascript typescript", "ioredis redis", "publish", "", 2, "0", "provides"),
    ("go-redis Publish", "redis", "go", "github.com/redis/go-redis github.com/go-redis/redis", "Publish", "", 3, "1", "provides"),
    ("Jedis publish", "redis", "java", "redis.clients.jedis io.lettuce.core", "publish", "Jedis JedisPooled UnifiedJedis JedisCluster RedisCommands RedisAsyncCommands RedisReactiveCommands", 2, "0", "provides"),
    ("RedisTemplate.convertAndSend", "redis", "java", "org.springframework.data.redis", "convertAndSend", "RedisTemplate StringRedisTemplate ReactiveRedisTemplate ReactiveStringRedisTemplate RedisOperations", 2, "0", "provides"),
    ("JmsTemplate.convertAndSend", "jms", "java", "org.springframework.jms", "convertAndSend send", "JmsTemplate JmsMessagingTemplate JmsOperations", 2, "0", "provides"),
    ("JMS MessageProducer.send", "jms", "java", "javax.jms jakarta.jms", "send", "MessageProducer JMSProducer QueueSender TopicPublisher", 2, "factory", "provides"),
]
# What a callee's library says it is used for.
SERVICE_PATTERNS = {"requests": "http", "httpx": "http", "axios": "http", "net/http": "http", "reqwest": "http", "celery": "async", "asyncio": "async", "tokio": "async", "grpc": "grpc", "tonic": "grpc", "graphql": "graphql", "apollo": "graphql", "trpc": "trpc", "viper": "config", "dotenv": "config", "express": "route_reg", "flask": "route_reg", "gin": "route_reg", "axum": "route_reg"}


def _libraries(imports: DataFrame) -> DataFrame:
    """(path, library): every leading part of a file's imports."""
    cut = lambda c, sep, out: F.transform(F.sequence(F.lit(1), F.size(F.split(c, sep))), lambda k: F.array_join(F.slice(F.split(c, sep), 1, k), out))
    every = F.array_distinct(F.concat(cut(F.col("module"), r"\.", "."), cut(F.col("module"), "/", "/"), cut(F.col("module"), "::", "::")))
    return imports.filter("module is not null").select("path", F.explode(every).alias("library")).distinct()


def _named(calls: DataFrame) -> DataFrame:
    receiver, name = split_callee(F.col("callee"))
    return calls.filter("callee is not null").select("path", "language", "callee", "args", *([F.col("receiver_type")] if "receiver_type" in calls.columns else [F.lit(None).cast("string").alias("receiver_type")]), receiver.alias("receiver"), name.alias("operation"))


def _position(at: Column) -> Column:
    return F.try_element_at(F.filter("args", lambda a: a["keyword"].isNull()), at.cast("int") + 1)["text"]


def endpoints(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, framework, key): routes that calls register."""
    spark = calls.sparkSession
    rows = [(f, lang, lib, out, op, verb) for f, langs, lib, out, ops in ENDPOINTS for lang in langs.split() for op, verb in ops.items()]
    rules = F.broadcast(spark.createDataFrame(rows, "framework string, language string, library string, excluded string, operation string, verb string"))
    have = _libraries(imports)
    hit = _named(calls).filter("receiver is not null").join(rules, ["language", "operation"]).join(have, ["path", "library"], "left_semi")
    hit = hit.join(have.select("path", F.col("library").alias("excluded")), ["path", "excluded"], "left_anti")
    route, second = literal(_position(F.lit(0))), _position(F.lit(1))
    own = F.regexp_extract(route, r"^([A-Za-z]+) +(?=/)", 1)
    routed = F.transform(F.regexp_extract_all(F.coalesce(second, F.lit("")), F.lit(r"(?:^|[.:])(get|post|put|delete|patch|head|options|any) *\("), F.lit(1)), F.upper)
    methods = F.when(F.col("verb") != "", F.array("verb")).when(F.col("framework") == "net/http", F.array(F.when(own == "", "ANY").otherwise(own))).otherwise(F.array_distinct(routed))
    bare = F.regexp_replace(route, r"^[A-Za-z]+ +(?=/)", "")
    out = hit.filter(F.startswith(bare, F.lit("/"))).select("path", "framework", bare.alias("route"), F.explode(methods).alias("method"))
    return out.select("path", "framework", api_key(F.col("method"), F.col("route")).alias("key")).filter("key is not null").distinct()


def annotated_endpoints(annotations: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, framework, key): routes that annotations (path, owner, target, name, argument) declare, under those of their owner."""
    spark = annotations.sparkSession
    rules = F.broadcast(spark.createDataFrame([(f, lib, c, n, v) for f, lib, c, names in ANNOTATED for n, v in names.items()], "framework string, library string, prefix string, name string, verb string"))
    hit = annotations.filter("owner is not null").join(rules, "name").join(_libraries(imports), ["path", "library"], "left_semi")
    owners = annotations.filter("owner is null").select("path", F.col("target").alias("owner"), F.col("name").alias("prefix"), F.col("argument").alias("base"))
    both = hit.join(owners, ["path", "owner", "prefix"], "left")
    part = lambda c: F.regexp_replace(F.coalesce(literal(c), F.lit("")), "^/+|/+$", "")
    base = F.regexp_replace(part(F.col("base")), r"\[controller\]", F.regexp_replace("owner", "Controller$", ""))
    route = F.concat(F.lit("/"), F.array_join(F.filter(F.array(base, part(F.col("argument"))), lambda x: x != ""), "/"))
    return both.select("path", "framework", api_key(F.col("verb"), route).alias("key")).filter("key is not null").distinct()


def client_calls(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, client, key): the requests that calls of HTTP clients make."""
    spark = calls.sparkSession
    rows = [(c, lang, lib, recv, op, verb, at) for c, langs, lib, recv, ops in CLIENTS for lang in langs.split() for op, (verb, at) in ops.items()]
    rules = F.broadcast(spark.createDataFrame(rows, "client string, language string, library string, wanted string, operation string, verb string, at int"))
    have = _libraries(imports)
    hit = _named(calls).join(rules, ["language", "operation"])
    anywhere = hit.filter("library = '' and (receiver is null or receiver in ('window', 'globalThis', 'self'))")
    hit = anywhere.unionByName(hit.filter("library <> '' and receiver is not null and (wanted = '' or receiver = wanted)").join(have, ["path", "library"], "left_semi"))
    said = _position(F.when(F.col("verb").rlike(r"^\d$"), F.col("verb").cast("int")))
    told = F.coalesce(literal(said), F.nullif(F.regexp_extract(said, r"(?:Method\.?|http\.Method)([A-Za-z]+)$", 1), F.lit("")))
    options = object_key(_position(F.lit(1)), "method")
    method = F.when(F.col("verb").rlike(r"^\d$"), told).when(F.col("client") == "fetch", F.coalesce(options, F.col("verb"))).otherwise(F.col("verb"))
    return hit.select("path", "client", api_key(method, literal(_position(F.col("at")))).alias("key")).filter("key is not null").distinct()


def messages(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, client, transport, direction, channel): what calls of messaging clients publish or subscribe to."""
    spark = calls.sparkSession
    rows = [(c, t, lang, lib, op, types, n, dest, way) for c, t, langs, libs, ops, types, n, dest, way in MESSAGES for lang in langs.split() for lib in libs.split() for op in ops.split()]
    rules = F.broadcast(spark.createDataFrame(rows, "client string, transport string, language string, library string, operation string, types string, least int, destination string, direction string"))
    hit = _named(calls).filter("receiver is not null").join(rules, ["language", "operation"]).filter(F.size("args") >= F.col("least")).join(_libraries(imports), ["path", "library"], "left_semi")
    hit = hit.filter(F.col("receiver_type").isNull() | (F.col("types") == "") | F.array_contains(F.split("types", " "), F.col("receiver_type")))
    first = _position(F.lit(0))
    exchange, routing = literal(argument(F.col("args"), keyword="exchange", position=0)), literal(argument(F.col("args"), keyword="routing_key", position=1))
    one = (
        F.when(F.col("destination") == "constructed", constructed(first, ["ProducerRecord"])).when(F.col("destination") == "factory", literal(F.regexp_extract(first, r"(?:createQueue|createTopic) *\( *([^()]*)\)", 1)))
        .when(F.col("destination") == "amqp", F.coalesce(exchange, routing)).when(F.col("destination") == "topic", object_key(first, "topic")).otherwise(literal(_position(F.expr("try_cast(destination AS INT)"))))
    )
    several = F.when(F.col("destination") == "list", listed(first)).when((F.col("destination") == "topic") & one.isNull(), listed(F.regexp_extract(first, r"topics *: *(\[[^\]]*\])", 1))).otherwise(F.array(one))
    return hit.select("path", "client", "transport", "direction", F.explode(several).alias("d")).select("path", "client", "transport", "direction", channel_key(F.col("d")).alias("channel")).filter("channel is not null").distinct()


def service_kind(spark: SparkSession, callees: DataFrame) -> DataFrame:
    """(callee, service): the longest library name that is a part of the callee."""
    parts = callees.select("callee").distinct().withColumn("library", F.explode(F.array_distinct(F.split("callee", r"[.:/]+"))))
    rules = F.broadcast(spark.createDataFrame(list(SERVICE_PATTERNS.items()), "library string, service string"))
    w = Window.partitionBy("callee").orderBy(F.length("library").desc(), "library")
    return parts.join(rules, "library").withColumn("r", F.row_number().over(w)).filter("r = 1").select("callee", "service")


def document_operations(d: dict) -> Iterator[tuple[str | None, str, str]]:
    """(server, METHOD, path) of a document read from JSON or YAML."""
    if d.get("openapi") or d.get("swagger") or d.get("paths"):
        servers = [s.get("url") for s in d.get("servers") or []] or ([f"{(d.get('schemes') or ['https'])[0]}://{d['host']}{d.get('basePath', '')}"] if d.get("host") else [None])
        for path, item in (d.get("paths") or {}).items():
            for method in item:
                if method.lower() in ("get", "put", "post", "delete", "patch", "head", "options", "trace"):
                    for s in servers:
                        yield s, method.upper(), path
