"""Credentials embedded in source texts, found and masked in place.

A literal beside an assignment to a credential-like name is segmented into
dictionary words by Viterbi over the word costs of a public tokenizer's
vocabulary; what the words do not explain is the literal's residual, and its
longest run, if long enough, makes it a secret.  Digests, commit ids, UUIDs,
placeholders and references are excluded first.  Tokens of well-known issuers,
key blocks, authorization values and passwords inside URLs are recognised by
their own form, whatever the name beside them.

Defined results: null or empty texts hold no secrets; every row of a text
delivered twice gives the same lines, reported once; lines end at a line feed,
so CRLF and byte order marks move nothing; masking keeps every other character
and the length of the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from graphloom.llm.batches import map_rows

WORD_VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"

# Words that name a credential, alone or as the last part of a name.
_NAMES = (
    "password passwd passphrase passcode pass pwd pw secret token apikey accesskey secretkey privatekey encryptionkey signingkey authkey "
    "credential credentials authorization passwort kennwort contrasena clave senha"
).split()
_PAIRS = "api key, access key, secret key, private key, encryption key, signing key, auth key, de passe, account key, shared key, master key".split(", ")
# Forms of well-known issuers' tokens.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_\-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{16,})"
)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:[\s'\"+,;()]|\\n|\\r|//|#|\*)*((?:[A-Za-z0-9+/=]{16,}))")
_URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*://([^\s/:@\"'<>]*):([^\s/@\"'<>]+)@")
_LOGIN = re.compile(r"\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user|-a|--auth)[ =]\s*[\"']?([^\s:\"']+):([^\s\"']+)")
_AUTH = re.compile(r"(?i)\b(bearer|basic)\s+([A-Za-z0-9+/=._~\-]{8,})")
# Every name that name_says_credential accepts holds one of these, and every other form one of the marks of its kind.
_TERMS = ("pass", "pw", "secret", "token", "key", "credential", "authori", "kennwort", "contrase", "clave", "senha")
_ISSUED_MARKS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "k_live_", "xox", "AKIA", "ASIA", "AIza", "npm_", "SG.", "eyJ")
_TWO_PARTS = frozenset(w[:4] + " " + w[4:] for w in _NAMES if w.startswith("pass") and len(w) > 5) | {w.replace("key", " key") for w in _NAMES if w.endswith("key")}
_TRIPLE = re.compile(r"(?:=>|=|:)\s*\(?\s*[bBrRuUfF]{0,2}(\"\"\"|'''|`)")
_NAMED = re.compile(r"([A-Za-z_$][\w$.\-]*)[\"'`]?\]?(?:\s*:\s*[\w.\[\]| ]+)?\s*$")
_KEYED = re.compile(
    r"(?<![\w$.\-])(?P<name>[A-Za-z_$][\w$.\-]*)(?P<close>[\"'`]?\]?)"
    r"(?P<type>\s*:\s*&?(?:'static )?[A-Za-z_][\w.<>\[\]| ]*(?==)|\s+[A-Za-z_][\w.\[\]]*\s*(?==))?"
    r"\s*(?::=|=>|=|:)\s*(?:concat!\s*\(|\(|new String\()?\s*"
    r"(?P<value>(?:[bBrRuUfF]{0,2})(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|[^\s\"'`,;(){}<>]+(?=$|[\s,;<\"'`)]))",
    re.M,
)
_FALLBACK = re.compile(
    r"(?:(?:getenv|environ\.get|envOr|env_or!?|getProperty|getOrDefault|get_env|env|get|var)\s*\(\s*[\"'](?P<n1>[\w.\-]+)[\"']\s*,\s*(?P<v1>\"[^\"\n]*\"|'[^'\n]*'))"
    r"|(?:env(?:\.(?P<n2>\w+)|\[[\"'](?P<n3>\w+)[\"']\])\s*(?:\|\||\?\?|or)\s*(?P<v2>\"[^\"\n]*\"|'[^'\n]*'))"
    r"|(?:\$\{(?P<n4>\w+):-(?P<v3>[^}\n]+)\})"
)
_XML = re.compile(r"(?:<(?P<n1>[\w.\-]+)>(?P<v1>[^<\n]*)</)|(?:\b(?:key|name|id)=[\"'](?P<n2>[\w.\-]+)[\"'](?:\s+value=[\"'](?P<v2>[^\"'\n]*)[\"']|[^<>\n]*>(?P<v3>[^<\n]*)<))")
_PAIR = re.compile(r"[\"']([\w.\-]+)[\"']\s*,\s*(\"[^\"\n]*\"|'[^'\n]*')")
_FLAG = re.compile(r"--(?P<name>[\w\-]+)(?:=|\s+)(?P<value>\"[^\"\n]*\"|'[^'\n]*'|[^\s\"']+)")
_INNER = re.compile(r"(?i)[;&?\s\"'](password|pwd|secret|token|api_?key|accountkey|sharedaccesskey)=([^;&\s\"']+)")
_JOINED = re.compile(r"\s*(?:\+|,|\.|\.\.)?\s*\\?\s*(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')")
_JOINS = re.compile(r"\s*(?:\+|\.\.|\.|,\s*(?=\")|\\|(?=\n?\s*\"))")
_NEXT_PAIR = re.compile(r"\s*,\s*['\"][\w.\-]+['\"]\s*[:=]")
_HEX = re.compile(r"(?i)^(?:(?:md5|sha-?\d+|blake2b?)[:\-=$].*|0x[0-9a-f]+|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$")
_HOLE = re.compile(r"\$\{|\$\(|\{\{|\}\}|^\{.*\}$|^<.*>$|^%\(|^%[A-Za-z_]+%$|^\$[A-Za-z_]|^@[A-Za-z_]+@$|^#\{|\(\)$|://")
_DUMMY = re.compile(r"(?i)replace|change.?(?:me|this|it)|^your|[_\-<\s]your[_\-\s]|placeholder|example|dummy|redacted|masked|todo|fixme|insert|^(?:none|null|nil|undefined|true|false|empty|test|secret|password|token|xxx+.*|abc123.*|1234.*)$|^env[:.]|^vault[:.]|process\.env|os\.environ|getenv|^secretmanager|^ssm:|^arn:|^ssh-|^file:|^ref:")
_WOVEN = re.compile(r"[A-Za-z]\d+[A-Za-z]")
_REPEATED = re.compile(r"^(.)\1+$")
_UNQUOTED = {"yaml", "properties", "bash", "markdown", "ini", "env", "shell", "dotenv", "text", "toml", None}
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|<!--|;)|\s(?://|#)\s")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_says_credential(name: str) -> bool:
    parts = [p.lower() for p in _PARTS.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return False
    return parts[-1] in _NAMES or " ".join(parts[-2:]) in _PAIRS or " ".join(parts[-2:]) in _TWO_PARTS


@lru_cache(maxsize=2)
def word_costs(path: str) -> dict[str, float]:
    """Cost of each whole word: the logarithm of its rank in the vocabulary file."""
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    costs = {w[:-4]: math.log(rank + 2) for w, rank in vocab.items() if w.endswith("</w>") and w[:-4].isalpha() and w.isascii() and len(w) >= 7}
    for w in (*_NAMES, "api", "auth", "env", "key", "url", "user", "db", "id"):
        costs.setdefault(w, 8.0)
    return costs


_CHAR_COST = math.log(62)


def residual(value: str, costs: dict[str, float]) -> tuple[int, float]:
    """The longest run of characters of ``value`` that no dictionary word explains, and the cost per character of the best segmentation."""
    low, n = value.lower(), len(value)
    best = [0.0] * (n + 1)
    word = [0] * (n + 1)  # length of the piece that ends here: 0 a separator, 1 an unexplained character, else a word
    for i in range(1, n + 1):
        c = low[i - 1]
        sep = c in "-_. /+#" and 1 < i < n
        b, w = best[i - 1] + (1.0 if sep else _CHAR_COST), int(not sep)
        if c.isalpha():
            for k in range(3, min(14, i) + 1):
                j = i - k
                if k == 3 and not ((j == 0 or not low[j - 1].isalpha()) and (i == n or not low[i].isalpha())):
                    continue
                cost = costs.get(low[j:i])
                if cost is None:
                    continue
                x = value[j:i]
                if not (x.islower() or x.isupper() or x[1:].islower()):
                    continue
                if best[j] + cost < b:
                    b, w = best[j] + cost, k
        best[i], word[i] = b, w
    longest = run = 0
    i = n
    while i:
        run = run + 1 if word[i] == 1 else 0
        longest = max(longest, run)
        i -= max(1, word[i])
    return longest, best[n] / max(1, n)


# Unexplained characters in a row that make a literal beside a credential's name a secret, and as many in one of letters alone.
LEAST_RUN, LEAST_LETTERS = 2, 6


def usable(value: str, costs: dict[str, float]) -> bool:
    """Whether a literal beside a credential's name is a credential someone could use; one of under six characters is not."""
    v = value.strip()
    if len(v) < 6 or _HEX.match(v) or _HOLE.search(v) or _DUMMY.search(v) or _REPEATED.match(v) or not v.isprintable():
        return False
    if re.search(r"\s", v):  # words are prose; letters around digits are not
        return any(_WOVEN.search(w) and residual(w, costs)[0] >= LEAST_LETTERS for w in v.split())
    run, per_char = residual(v.replace("%", ""), costs)
    if any(c.isdigit() or c in "!@#$%^&*+=?~/" for c in v):
        return run >= LEAST_RUN and (len(v) >= 8 or run >= 5)
    words = [w for w in re.split(r"[-_.]", v) if w]
    if all(w.islower() or w.isupper() or w.istitle() for w in words) or re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)+", v):
        return run >= 8 and per_char > 3.4  # a name in words of another language costs less
    return run >= LEAST_LETTERS


def _unquote(raw: str) -> tuple[str, int]:
    i = 0
    while i < len(raw) and raw[i] not in "\"'`" and i < 3:
        i += 1
    if i < len(raw) and raw[i] in "\"'`" and raw[-1] == raw[i] and len(raw) >= i + 2:
        return raw[i + 1 : -1], i + 1
    return raw, 0


def find(text: str, language: str | None, costs: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials in ``text``, in order, not overlapping.

    A credential put together from several literals, or written over several
    lines, has one span for each; all but the first are ``continued``.
    """
    if not text:
        return []
    low = _lower(text)
    out: list[tuple[int, int, str]] = []
    for m in _BLOCK.finditer(text) if "-----BEGIN" in text else ():
        body = _BODY.match(text, m.end())
        if body:
            end = text.find("-----END", m.end())
            out.append((m.start(), m.end() if end < 0 else end, "private_key"))
    blocks = list(out)
    for m in _ISSUED.finditer(text) if any(mark in text for mark in _ISSUED_MARKS) else ():
        if "EXAMPLE" not in m[0] and not re.search(r"(.)\1{7}", m[0]) and not m[0].lower().endswith("xxxx"):
            out.append((m.start(), m.end(), "issued_token"))
    for m in _URL.finditer(text) if "://" in text else ():
        v = m[2]
        if not (_HOLE.search(v) or _DUMMY.search(v) or _REPEATED.match(v)) and len(v) >= 4 and residual(v, costs)[0] >= LEAST_RUN:
            out.append((m.start(2), m.end(2), "url_password"))
    for m in _LOGIN.finditer(text) if any(mark in text for mark in ("curl", "wget", "http")) else ():
        if usable(m[2], costs):
            out.append((m.start(2), m.end(2), "login"))
    for m in _AUTH.finditer(text) if "bearer" in low or "basic" in low else ():
        v = m[2]
        if m[1].lower() == "basic":
            try:
                plain = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("latin-1")
            except (binascii.Error, ValueError):
                continue
            if ":" not in plain or not plain.isprintable() or _DUMMY.search(plain.partition(":")[2]) or _HOLE.search(plain):
                continue
            out.append((m.start(2), m.end(2), "authorization"))
        elif len(v) >= 16 and usable(v, costs):
            out.append((m.start(2), m.end(2), "authorization"))
    named = _hinted(text, low)
    for m in named:
        line_start, line = m
        for f in _candidates(line, language):
            name, at, raw = f
            if not name_says_credential(name):
                continue
            value, skip = _unquote(raw)
            whole, end = value, at + skip + len(value)
            spans = [(line_start + at + skip, line_start + end)]
            if skip:
                j, pieces = line_start + at + len(raw), [value]
                while (p := _JOINED.match(text, j)) and _JOINS.match(text, j) and not _NEXT_PAIR.match(text, j):
                    between = text[j : p.start(1)]
                    if between.strip() == "," and "concat!" not in line:
                        break
                    if between.strip() == "" and ("\n" not in between or language not in ("python", "c", "cpp")):
                        break
                    pieces.append(p[1][1:-1])
                    spans.append((p.start(1) + 1, p.end(1) - 1))
                    j = p.end()
                whole = "".join(pieces)
            if usable(whole, costs):
                out += _assigned(spans)
    for name, spans in _long_literals(text) if named else ():
        if name_says_credential(name) and usable("".join(text[a:b] for a, b in spans), costs):
            out += _assigned(spans)
    out.sort(key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in out:
        if kept and s[0] < kept[-1][1]:
            continue
        if any(a < s[0] < b for a, b, _ in blocks):
            continue
        kept.append(s)
    return kept


def _assigned(spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    return [(a, b, "continued" if k else "assigned") for k, (a, b) in enumerate((a, b) for a, b in spans if a < b)]


def _long_literals(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(name, spans) of the literals in triple quotes or back quotes, one span for each of their lines."""
    at = 0
    while m := _TRIPLE.search(text, at):
        begin, end = m.end(), text.find(m[1], m.end())
        named = _NAMED.search(text[text.rfind("\n", 0, m.start()) + 1 : m.start()])
        if end < 0:
            return
        at = end + len(m[1])
        if named and (m[1] != "`" or "\n" in text[begin:end]):
            yield named[1], [(begin + x.start(), begin + x.end()) for x in _SOLID.finditer(text[begin:end])]


def _lower(text: str) -> str:
    """``text`` in lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def _hinted(text: str, low: str) -> list[tuple[int, str]]:
    """(offset, line) of the lines naming a credential, in order."""
    starts: set[int] = set()
    for term in _TERMS:
        at = low.find(term)
        while at >= 0:
            starts.add(low.rfind("\n", 0, at) + 1)
            end = low.find("\n", at)
            at = low.find(term, end) if end >= 0 else -1
    return [(a, text[a : b if b >= 0 else len(text)]) for a in sorted(starts) for b in (text.find("\n", a),)]


def _candidates(line: str, language: str | None) -> Iterator[tuple[str, int, str]]:
    comment = _COMMENT.search(line)
    for m in _FALLBACK.finditer(line):
        name = m["n1"] or m["n2"] or m["n3"] or m["n4"]
        g = "v1" if m["v1"] is not None else "v2" if m["v2"] is not None else "v3"
        yield name, m.start(g), m[g]
    for m in _PAIR.finditer(line):
        yield m[1], m.start(2), m[2]
    if language in ("xml", "html", None) or line.lstrip().startswith("<"):
        for m in _XML.finditer(line):
            g = next((g for g in ("v1", "v2", "v3") if m[g] is not None), None)
            if g:
                yield m["n1"] or m["n2"], m.start(g), m[g]
    for m in _FLAG.finditer(line):
        if language in ("bash", "yaml", "markdown", "shell") or comment:
            yield m["name"], m.start("value"), m["value"]
    at = 0
    while m := _KEYED.search(line, at):
        raw, start = m["value"], m.start("value")
        skip = _unquote(raw)[1] if raw[-1:] in "\"'`" else 0
        names = [m["name"]]
        if m["type"] and (":" not in m["type"] or comment):  # "final String name =" reads as a name and its type, "old login: name=" too
            names.append(m["type"].strip(" \t:"))
        if skip or language in _UNQUOTED or comment and comment.start() <= m.start():
            for name in names:
                yield name, start, raw
        for inner in _INNER.finditer(raw) if skip else ():
            yield inner[1], start + inner.start(2), inner[2]
        at = m.end() if skip or any(map(name_says_credential, names)) else start


_SOLID = re.compile(r"[^\s\\](?:[^\r\n\\]*[^\s\\])?")
_LETTER = re.compile(r"[^\r\n]")


def masked(text: str, spans: list[tuple[int, int, str]], mark: str = "X") -> str:
    """``text`` with each credential overwritten; length, line ends and all else stay."""
    parts, at = [], 0
    for start, end, kind in spans:
        if kind == "private_key":
            start = _BLOCK.match(text, start).end()
            body = re.sub(r"\\[nr]|[A-Za-z0-9+/=]", lambda m: m[0] if m[0][0] == "\\" else mark, text[start:end])
            parts += [text[at:start], body]
        else:
            parts += [text[at:start], _LETTER.sub(mark, text[start:end])]
        at = end
    return "".join([*parts, text[at:]])


def secret_lines(sources: DataFrame, vocabulary: str = WORD_VOCABULARY) -> DataFrame:
    """(file_id, blob_sha, line_no, kind): lines of each text on which a credential begins."""

    def emit(file_id, blob_sha, language, text):
        for start, _, kind in find(text, language, word_costs(vocabulary)):
            if kind == "continued":
                continue
            yield file_id, blob_sha, text.count("\n", 0, start) + 1, kind

    return map_rows(sources, ["file_id", "blob_sha", "language", "text"], emit, "file_id string, blob_sha string, line_no int, kind string").distinct()


def masked_texts(sources: DataFrame, vocabulary: str = WORD_VOCABULARY) -> DataFrame:
    """(file_id, blob_sha, credentials, text): the texts that hold credentials, masked."""

    def emit(file_id, blob_sha, language, text):
        spans = find(text, language, word_costs(vocabulary))
        if spans:
            yield file_id, blob_sha, sum(kind != "continued" for *_, kind in spans), masked(text, spans)

    return map_rows(sources, ["file_id", "blob_sha", "language", "text"], emit, "file_id string, blob_sha string, credentials int, text string").dropDuplicates(["file_id", "blob_sha"])
