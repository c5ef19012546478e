"""Content-derived identities as Column expressions, without a UDF.

Fields are hashed with one zero byte between them; a field that holds a zero
byte is refused.  Ids are the first 130 bits of the digest in Crockford's
base 32.  Null fields hash as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Fixed value: Crockford's alphabet.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
ZERO = "\x00"


def _text(c: Column | str) -> Column:
    return F.coalesce((F.lit(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def nul_sha256(*fields: Column | str) -> Column:
    """sha256 of the fields joined by zero bytes, in hexadecimal; a zero byte inside a field is an error."""
    cols = [_text(f) for f in fields]
    bad = F.lit(False)
    for c in cols:
        bad = bad | (F.instr(c, ZERO) > 0)
    joined = F.concat_ws(ZERO, *cols)
    return F.sha2(F.when(bad, F.raise_error(F.lit("zero byte in an identity field"))).otherwise(joined), 256)


def crockford(digest: Column) -> Column:
    """26 symbols of a hexadecimal digest: five hexadecimal digits give four symbols."""
    symbols = []
    for group in range(7):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("bigint")
        for shift in (15, 10, 5, 0):
            symbols.append(F.substring(F.lit(ALPHABET), (F.shiftright(bits, shift).bitwiseAND(31) + 1).cast("int"), F.lit(1)))
    return F.concat(*symbols[:26])


def node_id(repo: Column | str, kind: Column | str, path: Column | str, qualified_name: Column | str, disambiguator: Column | str = "") -> Column:
    return crockford(nul_sha256(repo, kind, path, qualified_name, disambiguator))


def edge_id(src: Column, dst: Column, kind: Column | str, site: Column | str = "") -> Column:
    """No separators: node ids have one length and kinds are a closed set."""
    return crockford(F.sha2(F.concat(_text(src), _text(dst), _text(kind), _text(site)), 256))


def ast_fingerprint(path: Column, callee: Column | str, receiver: Column | str, ordinal: Column) -> Column:
    """Hash of the node-type path (an array), the texts and the ordinal."""
    return F.sha2(F.concat_ws(ZERO, F.size(path).cast("string"), F.array_join(path, ZERO), _text(callee), _text(receiver), ordinal.cast("string")), 256)


def site_id(file: Column | str, enclosing: Column | str, kind: Column | str, fingerprint: Column) -> Column:
    return crockford(nul_sha256(file, enclosing, kind, fingerprint))


def disambiguator(group: list[Column], signature: Column, order: list[Column]) -> Column:
    """'' for a callable alone in its group, else eight digits of its signature's hash, numbered where signatures are equal."""
    everyone = Window.partitionBy(*group)
    same = Window.partitionBy(*group, signature)
    short = F.substring(F.sha2(_text(signature), 256), 1, 8)
    number = F.row_number().over(same.orderBy(*order))
    return F.when(F.count(F.lit(1)).over(everyone) == 1, "").when(F.count(F.lit(1)).over(same) == 1, short).otherwise(F.concat(short, F.lit("-"), number.cast("string")))


def canonical_clone_url(url: Column) -> Column:
    """https://host[:port]/path without user information and one final .git; null for anything else."""
    ok = url.rlike(r"^(?i:https)://([^/?#\s]*@)?[^/?#@\s]+/[^?#\s]+$") & ~url.rlike(r"[\s\x00-\x1f]")
    rest = F.regexp_replace(url, r"^(?i:https)://([^/?#]*@)?", "")
    host, path = F.lower(F.substring_index(rest, "/", 1)), F.regexp_replace(rest, r"^[^/]*", "")
    return F.when(ok, F.concat(F.lit("https://"), host, F.regexp_replace(path, r"\.git$", "")))


def repo_id(url: Column) -> Column:
    return F.substring(F.sha2(canonical_clone_url(url), 256), 1, 16)


def contract_id(kind: Column | str, namespace_key: Column) -> Column:
    return node_id("estate", kind, "", namespace_key, "")


def permission_hash(ids: Column) -> Column:
    """Hash of a set of ids, whatever their order and repetition."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), "\n"), 256)


def evidence_id(*fields: Column | str) -> Column:
    return crockford(nul_sha256(*fields))


def blob_sha(content: Column) -> Column:
    """Git's object id of a blob."""
    raw = F.encode(content, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.length(raw).cast("string"), F.lit(ZERO)), "UTF-8"), raw))
