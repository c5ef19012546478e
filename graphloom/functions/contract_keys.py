"""Normalised keys of contracts between repositories, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def api_path(raw: Column) -> Column:
    """Path template: no scheme, authority, query or fragment; every parameter is {}; null for blank, spaced or unbalanced input."""
    t = F.trim(raw)
    ok = (t != "") & ~t.rlike(r"[\s\x00-\x1f]")
    p = F.regexp_replace(t, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*", "")
    p = F.regexp_replace(p, r"[?#].*$", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    for _ in range(3):  # patterns nest braces at most so deep
        p = F.regexp_replace(p, r"\{([^{}]*)\{[^{}]*\}", "{$1")
    p = F.regexp_replace(p, r"\{[^{}]*\}|<[^<>]*>", "\x01")
    p = F.regexp_replace(p, r"(?<=/):[^/]+", "\x01")
    balanced = ~p.rlike(r"[{<]")
    p = F.regexp_replace(p, "\x01", "{}")
    p = F.regexp_replace(p, r"(?<=.)/+$", "")
    return F.when(ok & balanced, p)


def http_method(raw: Column) -> Column:
    t = F.trim(raw)
    return F.when(t.rlike("^[A-Za-z]+$"), F.upper(t))


def api_key(method: Column, url: Column) -> Column:
    return F.concat(http_method(method), F.lit(" "), api_path(url))


def authority(url: Column) -> Column:
    """host[:port] in lower case, without user information, final dot and default port; null for loopback hosts and relative urls."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    a = F.lower(F.regexp_replace(raw, r"^.*@", ""))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.regexp_replace(F.regexp_extract(a, r"^(\[[^\]]*\]|[^:]*)", 1), r"\.$", "")
    port = F.regexp_extract(a, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    loop = host.isin("localhost", "[::1]", "0.0.0.0", "") | host.startswith("127.")
    return F.when(~loop, F.concat(host, F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))))


def table_key(raw: Column) -> Column:
    """Unquoted, lower case, without the public schema."""
    t = F.lower(F.regexp_replace(F.trim(raw), r"[\"`\[\]]", ""))
    return F.regexp_replace(t, r"^public\.", "")


def channel_key(raw: Column) -> Column:
    """A literal destination; null if a placeholder is left in it."""
    t = F.trim(raw)
    return F.when((t != "") & ~t.rlike(r"\$\{|\{\{|#\{"), t)


def artifact_key(ecosystem: Column, group: Column, name: Column, version: Column | None = None) -> Column:
    base = F.when(F.coalesce(group, F.lit("")) == "", F.concat(ecosystem, F.lit("::"), name)).otherwise(F.concat_ws(":", ecosystem, group, name))
    return base if version is None else F.when(version.isNull(), base).otherwise(F.concat(base, F.lit("@"), version))


def namespace_key(identity: Column, key: Column, strength: Column, repo: Column) -> Column:
    """Compact JSON of identity and key, or unresolved:<repo>:<key> without a known identity."""
    resolved = F.to_json(F.struct(identity.alias("identity"), key.alias("key")))
    return F.when(strength.isin("exact", "declared"), resolved).otherwise(F.concat_ws(":", F.lit("unresolved"), repo, key))


def jdbc_identity(url: Column) -> Column:
    """hosts/database of a JDBC url, hosts sorted; null for other urls."""
    body = F.regexp_extract(url, r"^jdbc:[a-z0-9]+:(?://)?([^?;]+)", 1)
    hosts = F.array_sort(F.split(F.lower(F.substring_index(body, "/", 1)), ","))
    return F.when(body != "", F.concat_ws("/", F.array_join(hosts, ","), F.regexp_extract(body, r"/([^/]+)$", 1)))
