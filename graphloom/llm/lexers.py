"""Token kinds of source texts, for the grammars of ``grammars``.

Each lexer returns (kinds, offsets), where ``offsets`` gives a token's place
when asked, so that the common case, a text without errors, costs one regex
scan.  A kind is a terminal of the language's grammar; what is no token at all
is ``<error>``, which no grammar accepts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from graphloom.llm.grammar import NL

ERROR = "<error>"
# A hole that holds no expression; no grammar accepts it.
NOTHING = "\x00"
Offsets = Callable[[int], int]


class Kinds(dict):
    """Token text to kind; fixed words first, others by their first character."""

    MOST = 200_000

    def __init__(self, fixed: dict[str, str], classify: Callable[[str], str]):
        super().__init__(fixed)
        self.fixed, self.classify = fixed, classify

    def __missing__(self, token: str) -> str:
        if len(self) > self.MOST:
            self.clear()
            self.update(self.fixed)
        self[token] = kind = self.classify(token)
        return kind


def _same(*groups: str) -> dict[str, str]:
    return {w: w for g in groups for w in g.split()}


_STRING = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'
_SINGLE = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
_BLOCK_COMMENT = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_BLOCK_COMMENT_1 = r"/\*[^*\n]*\*+(?:[^/*\n][^*\n]*\*+)*/"
# Combining marks that identifiers may hold after their first letter.
_MARKS = "\u0300-\u036f\u0483-\u0487\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0900-\u0903\u093a-\u094f\u200c\u200d\ufe00-\ufe0f\U000e0100-\U000e01ef"
_IDENT = r"[A-Za-z_$\u00aa-\uffff\U00010000-\U0010ffff][\w$]*"


def _regex_lexer(pattern: str, kinds: Kinds) -> Callable[[str], tuple[list[str], Offsets]]:
    compiled = re.compile(pattern)

    def lex(text: str) -> tuple[list[str], Offsets]:
        found = compiled.findall(text)
        while found and not found[-1]:  # the end of the text, behind comments and blanks
            found.pop()

        def offset(i: int) -> int:
            for k, m in enumerate(compiled.finditer(text)):
                if k == i:
                    return m.start(1)
            return len(text)

        return list(map(kinds.__getitem__, found)), offset

    return lex


# ---- C-like languages


def _number_or(token: str, otherwise: str) -> str:
    return "NUM" if token[0].isdigit() or token[0] == "." and len(token) > 1 and token[1].isdigit() else otherwise


def _javascript() -> Callable:
    before = r"(?:(?<=[=(,:\[!&|?{};+*%~^<>\-\n])|(?<=[=(,:\[!&|?{};+*%~^<>\-] )|(?<=  )|(?<=\t)|(?<=return )|(?<=typeof )|(?<=case )|(?<=of )|(?<=in )|(?<=else )|(?<=void )|(?<=await )|(?<=yield ))"
    regex = before + r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    hole = r"\$\{(?:[^{}`\"']|\"[^\"\n]*\"|'[^'\n]*'|\{(?:[^{}]|\{[^{}]*\})*\}|`[^`]*`)*\}"
    template = rf"`[^`\\$]*(?:(?:\\[\s\S]|{hole}|\$(?!\{{))[^`\\$]*)*`"
    number = r"(?:0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)(?![\w$])"
    marks = r"\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*"
    pattern = (
        rf"(?>[ \t\r\f\v\xa0\ufeff]+|//[^\n\u2028\u2029]*|{_BLOCK_COMMENT_1})*+(\n\s*|{_BLOCK_COMMENT}|{_IDENT}(?:\\u[\da-fA-F]{{4}}[\w$]*)*|{number}|{_STRING}|{_SINGLE}|{template}|{regex}|#(?={_IDENT})[\w$]+|{marks}|[\s\S]|\Z)"
    )
    from graphloom.llm.grammars import _SOFT, _WORDS

    fixed = {w: w for w in (*_WORDS, *_SOFT)} | _same("{ } ( ) [ ] ; , < > + - * | & ! ~ ? : . @ = => >= ++ -- ?. ...")
    fixed |= dict.fromkeys("=== !== == != <= && || ?? << ** / % ^".split(), "BOP")
    fixed |= dict.fromkeys("**= <<= &&= ||= ??= += -= *= /= %= &= |= ^=".split(), "AOP")
    fixed |= {"\n": NL, "instanceof": "instanceof"}

    def classify(t: str) -> str:
        c = t[0]
        if c == "\n" or t.startswith("/*"):
            return NL
        if c in "\"'":
            return "STR" if len(t) > 1 else ERROR
        if c == "`":
            return "TEMPLATE" if len(t) > 1 else ERROR
        if c == "/":
            return "REGEX" if len(t) > 1 else "BOP"
        if c == "#":
            return "PRIV" if len(t) > 1 else ERROR
        if c.isalpha() or c in "_$" or ord(c) > 0xA9 and t.isidentifier():
            return "ID"
        return _number_or(t, ERROR)

    lex = _regex_lexer(pattern, Kinds(fixed, classify))
    first = re.compile(r"^#![^\n]*")
    tokens, parts = re.compile(pattern), re.compile(rf"\\[\s\S]|({hole})")

    def run(text: str) -> tuple[list[str], Offsets]:
        return lex(first.sub(lambda m: " " * len(m[0]), text))

    def holes(text: str) -> Iterator[tuple[int, str]]:
        """(offset, expression) of the holes of the text's templates."""
        if "${" in text:
            for m in tokens.finditer(first.sub(lambda m: " " * len(m[0]), text)):
                if m[1][:1] == "`" and "${" in m[1]:
                    for h in parts.finditer(m[1], 1):
                        if h[1]:
                            yield m.start(1) + h.start() + 2, h[1][2:-1]

    run.holes = holes
    return run


def _java() -> Callable:
    number = r"(?:0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.(?!\.))?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?(?![\w$])"
    block = r'"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""'
    marks = r"\.\.\.|<<=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<"
    pattern = rf"(?>\s+|//[^\n]*|{_BLOCK_COMMENT})*+({_IDENT}|{number}|{block}|{_STRING}|'(?:[^'\\\n]|\\u+[\da-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)'|{marks}|[\s\S]|\Z)"
    words = (
        "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package "
        "private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null "
        "record sealed permits yield module open requires exports opens uses provides with to transitive when non _"
    )
    fixed = _same(words, "{ } ( ) [ ] ; , < > + - * | & ! ~ ? : . @ = -> :: >= ++ -- ...")
    fixed |= dict.fromkeys("boolean byte char double float int long short".split(), "PRIMITIVE")
    fixed |= dict.fromkeys("== != <= && || << / % ^".split(), "BOP")
    fixed |= dict.fromkeys("<<= += -= *= /= %= &= |= ^=".split(), "AOP")

    def classify(t: str) -> str:
        c = t[0]
        if c == '"':
            return "STR" if len(t) > 1 else ERROR
        if c == "'":
            return "CHAR" if len(t) > 1 else ERROR
        if c.isspace():
            return ERROR
        if c.isalpha() or c in "_$":
            return "ID"
        return _number_or(t, ERROR)

    return _regex_lexer(pattern, Kinds(fixed, classify))


GO_ENDS = frozenset({"ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"})


def _go() -> Callable:
    number = r"(?:0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)i?(?!\w)"
    marks = r"\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>"
    rune = r"'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))'"
    string = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
    pattern = rf"(?>[ \t\r]+|//[^\n]*|{_BLOCK_COMMENT_1})*+(\n\s*|{_BLOCK_COMMENT}|[^\W\d]\w*|{number}|{string}|`[^`]*`|{rune}|{marks}|[\s\S]|\Z)"
    words = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
    fixed = _same(words, "{ } ( ) [ ] ; , + - * | & ! ~ : . = := ^ <- ++ -- ...")
    fixed |= dict.fromkeys("== != <= >= < > && || << >> &^ / %".split(), "BOP")
    fixed |= dict.fromkeys("<<= >>= &^= += -= *= /= %= &= |= ^=".split(), "AOP")

    def classify(t: str) -> str:
        c = t[0]
        if c == "\n" or t.startswith("/*"):
            return NL
        if c in '"`':
            return "STR" if len(t) > 1 else ERROR
        if c == "'":
            return "CHAR" if len(t) > 1 else ERROR
        if c.isalpha() or c == "_":
            return "ID"
        return _number_or(t, ERROR)

    return _regex_lexer(pattern, Kinds(fixed, classify))


def _rust() -> Callable:
    number = r"(?:0x[\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0[ob][0-7_]+(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?(?:_?[iuf](?:8|16|32|64|128|size))?)(?!\w)"
    raw = r'(?:br|cr|r)(?:"[^"]*"|#"(?:[^"]|"(?!#))*"#|##"(?:[^"]|"(?!##))*"##|###"(?:[^"]|"(?!###))*"###)'
    string = r'[bc]?"[^"\\]*(?:\\[\s\S][^"\\]*)*"'
    char = r"b?'(?:[^'\\\n]|\\(?:[nrt\\0'\"]|x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}))'"
    life = r"'[^\W\d]\w*(?!')"
    nested = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"
    marks = r"\.\.\.|\.\.=|\.\.|::|->|=>|<<=|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<"
    pattern = rf"(?>\s+|//[^\n]*|{_BLOCK_COMMENT})*+({raw}|{string}|{char}|{life}|r#[^\W\d]\w*|[^\W\d]\w*|{number}|{marks}|[\s\S]|\Z)"
    words = (
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type "
        "unsafe use where while union auto default raw macro_rules yield box _"
    )
    fixed = _same(words, "{ } ( ) [ ] ; , < > + - * | & ! ~ ? : . @ = # $ :: -> => .. ..= ... >= && ||")
    fixed |= dict.fromkeys("== != <= << / % ^".split(), "BOP")
    fixed |= dict.fromkeys("<<= += -= *= /= %= &= |= ^=".split(), "AOP")
    del nested

    def classify(t: str) -> str:
        c = t[0]
        if t[-1] == '"' or t[-1] == "#" and len(t) > 3 and c in "rbc":
            return "STR" if len(t) > 1 else ERROR
        if c == "'" or t.startswith("b'"):
            return ERROR if len(t) == 1 else "CHAR" if t[-1] == "'" else "LIFE"
        if c.isspace():
            return ERROR
        if c.isalpha() or c == "_":
            return "ID"
        return _number_or(t, ERROR)

    lex = _regex_lexer(pattern, Kinds(fixed, classify))
    first = re.compile(r"^#!(?!\[)[^\n]*")
    return lambda text: lex(first.sub(lambda m: " " * len(m[0]), text))


# ---- Python: logical lines and indentation


def _python() -> Callable:
    prefix = r"(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?"
    triple = rf"{prefix}(?:\"\"\"[^\"\\]*(?:(?:\\[\s\S]|\"(?!\"\"))[^\"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*''')"
    single = rf"{prefix}(?:{_STRING}|{_SINGLE})"
    # Holes may hold the string's own quotes; what these patterns do not match is read as a plain string.
    hole = r"\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*')*+\}"
    for _ in range(2):
        hole = rf"\{{(?:[^{{}}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|{hole})*+\}}"
    formatted = "|".join(rf"(?:[fFtT][rR]?|[rR][fFtT]){q}(?!{q})(?:[^{q}\\\n{{}}]|\\[^\n{{}}]|\{{\{{|\}}\}}|{hole})*+{q}" for q in "\"'")
    number = r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"
    marks = r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@="
    compiled = re.compile(rf"(?>[ \t\f]+|\\\r?\n)*+((?:(?:#[^\n]*)?\r?\n[ \t\f]*)+(?:#[^\n]*\Z)?|#[^\n]*\Z|{triple}|{formatted}|{single}|[^\W\d][\w{_MARKS}]*|{number}|{marks}|[\s\S]|\Z)")
    words = "False None True as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not pass raise return try while with yield match case type"
    fixed = _same(words, "{ } ( ) [ ] ; , + - * / ** | @ ~ : . = := -> ...")
    fixed |= {"or": "LOGIC", "and": "LOGIC"}
    fixed |= dict.fromkeys("< > == >= <= != // % << >> & ^".split(), "OP")
    fixed |= dict.fromkeys("+= -= *= /= //= %= &= |= ^= @= **= >>= <<=".split(), "AUG")
    escapes = re.compile(r"\\(?:(x)(?![\da-fA-F]{2})|(u)(?![\da-fA-F]{4})|(U)(?!00(?:0[\da-fA-F]|10)[\da-fA-F]{4})|[\s\S])")

    def classify(t: str) -> str:
        c = t[0]
        if c in "\r\n#":
            return NL
        if t[-1] in "\"'" and len(t) > 1:
            lead = t[: t.index(t[-1])].lower()
            if "b" in lead and not t.isascii():
                return ERROR
            if "\\" in t and "r" not in lead and any(m[1] or (m[2] or m[3]) and "b" not in lead for m in escapes.finditer(t)):
                return ERROR
            return "BYTES" if "b" in lead else "STR"
        if c.isalpha() or c == "_":
            return "ID"
        if c == "0" and t.replace("_", "").isdigit() and t.strip("0_"):
            return ERROR
        return _number_or(t, ERROR)

    kinds = Kinds(fixed, classify)

    def lex(text: str) -> tuple[list[str], Offsets]:
        lead = len(text) - len(text.lstrip(" \t\f"))
        found = compiled.findall(text)
        while found and not found[-1]:
            found.pop()
        out: list[str] = []
        at: list[int] = []
        depth, indents = 0, [0]
        if lead and found and kinds[found[0]] != NL:
            out.append(ERROR)
            at.append(0)
        for i, t in enumerate(found):
            k = kinds[t]
            if k == NL:
                if depth or t[0] == "#" and "\n" not in t:
                    continue
                if out and out[-1] not in ("NEWLINE", "DEDENT"):
                    out.append("NEWLINE")
                    at.append(i)
                if i + 1 == len(found):
                    continue
                space = t[t.rfind("\n") + 1 :]
                width = len(space.expandtabs(8)) if "\f" not in space else len(space.replace("\f", ""))
                if width > indents[-1]:
                    indents.append(width)
                    out.append("INDENT")
                    at.append(i)
                while width < indents[-1]:
                    indents.pop()
                    out.append("DEDENT" if width >= indents[-1] or width in indents else ERROR)
                    at.append(i)
                    if width > indents[-1]:
                        out[-1] = ERROR
                        indents.append(width)
                continue
            if k in ("(", "[", "{"):
                depth += 1
            elif k in (")", "]", "}"):
                depth -= 1
                if depth < 0:
                    depth = 0
            out.append(k)
            at.append(i)
        if out and out[-1] not in ("NEWLINE", "DEDENT") and not depth:
            out.append("NEWLINE")
            at.append(len(found))
        out += ["DEDENT"] * (len(indents) - 1)

        def offset(i: int) -> int:
            if i >= len(at):
                return len(text)
            for k, m in enumerate(compiled.finditer(text)):
                if k == at[i]:
                    return m.start(1)
            return len(text)

        return out, offset

    opening = re.compile(r"(?i)(?:[ft]|[ft]r|r[ft])[\"']")

    def holes(text: str) -> Iterator[tuple[int, str]]:
        """(offset, expression) of the holes of the text's f-strings, format specifications included."""
        if opening.search(text):
            for m in compiled.finditer(text):
                if opening.match(m[1]) and len(m[1]) > 2:
                    start = m[1].index(m[1][-1])
                    quote = 3 if m[1][start : start + 3] in ('"""', "'''") else 1
                    for at, hole in _python_holes(m[1], start + quote, len(m[1]) - quote, "r" in m[1][:start].lower()):
                        yield m.start(1) + at, hole

    lex.holes = holes
    return lex


_QUOTED = re.compile(r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"[^\"\n]*\"|'[^'\n]*'")


def _python_holes(token: str, at: int, end: int, raw: bool, spec: bool = False) -> Iterator[tuple[int, str]]:
    """Holes of token[at:end], the literal part of an f-string or a format specification."""
    while at < end:
        c = token[at]
        if c == "\\" and not raw and not spec:
            at = token.find("}", at) + 1 if token.startswith("\\N{", at) else at + (1 if token[at + 1 : at + 2] in ("{", "}") else 2)
            continue
        if c == "}" and not spec:
            if not token.startswith("}}", at):
                yield at, NOTHING
                return
            at += 2
            continue
        if c != "{" or not spec and token.startswith("{{", at):
            at += 2 if c == "{" else 1
            continue
        start = k = at + 1
        depth, stop = 0, None  # where the expression ends: a conversion, a specification or the hole's own end
        while k < end:
            c = token[k]
            if c in "\"'" and (q := _QUOTED.match(token, k, end)):
                k = q.end()
                continue
            if c in "([{":
                depth += 1
            elif c == "}" and not depth or c == ":" and not depth or c == "!" and not depth and token[k + 1 : k + 2] != "=":
                stop = k
                break
            elif c in ")]}":
                depth -= 1
                if depth < 0:
                    break
            k += 1
        if stop is None:
            yield start, NOTHING
            return
        expression = token[start:stop]
        shown = expression.rstrip()
        if shown.endswith("=") and shown[-2:-1] not in ("=", "!", "<", ">"):
            expression = shown[:-1]
        yield start, expression if expression.strip() else NOTHING
        if token[stop] == "!":
            conversion = re.compile(r"![rsa]\s*(?=[:}])").match(token, stop, end)
            if not conversion:
                yield stop, NOTHING
                return
            stop = conversion.end()
        at = stop + 1
        if token[stop] == ":":
            depth, k = 1, at
            while k < end and depth:
                depth += (token[k] == "{") - (token[k] == "}")
                k += 1
            yield from _python_holes(token, at, k - 1, raw, True)
            at = k


# ---- Data languages


def _json() -> Callable:
    string = r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[\da-fA-F]{4})[^"\\\x00-\x1f]*)*"'
    pattern = rf"[ \t\r\n]*+({string}|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true|false|null|[^ \t\r\n])"
    return _regex_lexer(pattern, Kinds(_same("{ } [ ] , : true false null"), lambda t: "STR" if t[0] == '"' and len(t) > 1 else "NUM" if t[0] in "-0123456789" and t != "-" else ERROR))


def _listed(lex: Callable) -> Callable:
    """A lexer written as a generator of (kind, offset)."""

    def run(text: str) -> tuple[list[str], Offsets]:
        pairs = list(lex(text))
        return [k for k, _ in pairs], lambda i: pairs[i][1] if i < len(pairs) else len(text)

    return run


_TOML_SKIP = re.compile(r"[ \t]*(?:#[^\n]*)?")
_TOML_LINE = re.compile(r"\r?\n")
_TOML_STRING = re.compile(
    r'"""(?:[^"\\]|\\(?:[btnfre"\\]|u[\da-fA-F]{4}|U[\da-fA-F]{8}|x[\da-fA-F]{2}|[ \t]*\r?\n)|"(?!""))*"""{1,3}|\'\'\'(?:[^\']|\'(?!\'\'))*\'\'\'{1,3}'
    r'|"(?:[^"\\\n\x00-\x08]|\\(?:[btnfre"\\]|u[\da-fA-F]{4}|U[\da-fA-F]{8}|x[\da-fA-F]{2}))*"|\'[^\'\n]*\''
)
_TOML_BARE = re.compile(r"[A-Za-z0-9_\-]+")
_TOML_VALUE = re.compile(
    r"(?:\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?|[+-]?(?:inf|nan)|0x[\da-fA-F](?:_?[\da-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|true|false)(?![\w.\-+:])"
)


def _toml(text: str):
    at, n = 0, len(text)
    inside: list[str] = []
    value = False
    line_start = True
    while True:
        at = _TOML_SKIP.match(text, at).end()
        if at >= n:
            return
        if m := _TOML_LINE.match(text, at):
            yield "NEWLINE", at
            at = m.end()
            if not inside:
                value, line_start = False, True
            continue
        c = text[at]
        if m := _TOML_STRING.match(text, at):
            yield ("MSTR" if m[0][:3] in ('"""', "'''") else "STR"), at
            at = m.end()
        elif line_start and text.startswith("[[", at):
            yield "[[", at
            at += 2
        elif not inside and not value and text.startswith("]]", at):
            yield "]]", at
            at += 2
        elif c in "[{" and value:
            inside.append(c)
            value = c == "["
            yield c, at
            at += 1
        elif c in "]}" and inside:
            yield (c if (c == "]") == (inside.pop() == "[") else ERROR), at
            value = True
            at += 1
        elif c in "[].=,":
            yield c, at
            if c == "=":
                value = True
            elif c == "," and inside:
                value = inside[-1] == "["
            at += 1
        elif value and (m := _TOML_VALUE.match(text, at)):
            yield (m[0] if m[0] in ("true", "false") else "NUM"), at
            at = m.end()
        elif not value and (m := _TOML_BARE.match(text, at)):
            yield "BARE", at
            at = m.end()
        else:
            yield ERROR, at
            at += 1
        line_start = False


_XML_NAME = r"[A-Za-z_:\u00c0-\uffff][\w:.\-\u00b7-\uffff]*"
_XML_ATTRS = re.compile(rf"\s+({_XML_NAME})\s*=\s*(\"[^<\"]*\"|'[^<']*')")
_XML_TAG = re.compile(rf"<({_XML_NAME})((?:\s+{_XML_NAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*)\s*(/?)>|</({_XML_NAME})\s*>")
_XML_OTHER = re.compile(
    r"<!--(?:[^\-]|-(?!-))*-->|<!\[CDATA\[(?:[^\]]|\](?!\]>))*\]\]>|<\?xml\s(?:[^?]|\?(?!>))*\?>|<\?(?!xml\s)[A-Za-z_:][^\s?]*(?:\s(?:[^?]|\?(?!>))*)?\?>"
    r"|<!DOCTYPE(?:[^\[<>\"']|\"[^\"]*\"|'[^']*')*(?:\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\]\s*)?>"
)
_XML_TEXT = re.compile(r"[^<]+")
_XML_AMP = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[\da-fA-F]+);)")
_XML_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _xml(text: str):
    at, n, names = 0, len(text), []
    entities = "<!ENTITY" in text
    while at < n:
        if m := _XML_TEXT.match(text, at):
            t = m[0]
            bad = (not entities and _XML_AMP.search(t)) or _XML_CONTROL.search(t) or "]]>" in t
            yield (ERROR if bad else "BLANK" if not t.strip() else "TEXT"), at
        elif m := _XML_TAG.match(text, at):
            if m[4]:
                yield ("CLOSE" if names and names.pop() == m[4] else ERROR), at
            else:
                attrs = [a for a, _ in _XML_ATTRS.findall(m[2])]
                bad = len(set(attrs)) < len(attrs) or (not entities and _XML_AMP.search(m[2])) or _XML_CONTROL.search(m[2])
                if not m[3]:
                    names.append(m[1])
                yield (ERROR if bad else "EMPTY" if m[3] else "OPEN"), at
        elif m := _XML_OTHER.match(text, at):
            t = m[0]
            kind = "COMMENT" if t.startswith("<!--") else "CDATA" if t.startswith("<![") else "DOCTYPE" if t.startswith("<!D") else "PI"
            if t.startswith("<?xml") and t[5].isspace():
                kind = "DECL" if at == 0 else ERROR
            yield (ERROR if _XML_CONTROL.search(t) else kind), at
        else:
            yield ERROR, at
            return
        at = m.end()


_YAML_DOUBLE = re.compile(r'"(?:[^"\\]|\\(?:[0abtnvfre "/\\N_LP\t\n]|\r\n|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))*"')
_YAML_SINGLE = re.compile(r"'(?:[^']|'')*'")
_YAML_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s]))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:]|:\S))*")
_YAML_PLAIN_FLOW = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s,\[\]{}]))(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s#:,\[\]{}]|:[^\s,\[\]{}]))*")
_YAML_PROP = re.compile(r"(?:&[^\s,\[\]{}]+|!<[^>\s]*>|![^\s,\[\]{}]*)(?=[\s,\]}]|$)")
_YAML_ALIAS = re.compile(r"\*[^\s,\[\]{}]+")
_YAML_BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)[ \t]*(?:\s#[^\n]*)?\r?(?=\n|$)")
_YAML_KEYED = re.compile(r":(?=\s|$)")


def _yaml(text: str):
    """Tokens of a YAML stream: columns become INDENT and DEDENT, scalars over several lines one token."""
    n, at = len(text), 0
    columns = [-1]

    def line_end(i: int) -> int:
        j = text.find("\n", i)
        return n if j < 0 else j

    def close(to: int):
        while len(columns) > 1 and columns[-1] > to:
            columns.pop()
            if len(columns) > 1:  # the outermost column was opened without INDENT
                yield "DEDENT"

    while at < n:
        stop = line_end(at)
        line = text[at:stop]
        bare = line.strip()
        if not bare or bare.startswith("#"):
            at = stop + 1
            continue
        column = len(line) - len(line.lstrip(" "))
        if column == 0 and re.match(r"(?:---|\.\.\.)(?=\s|$)", line):
            for k in close(-1):
                yield k, at
            yield line[:3], at
            at += 3
            column = 3
            rest = text[at:stop].strip()
            if not rest or rest.startswith("#"):
                at = stop + 1
                continue
            at += len(text[at:stop]) - len(text[at:stop].lstrip())
            column = 0
        elif column == 0 and line.startswith("%") and len(columns) == 1:
            at = stop + 1
            continue
        else:
            at += column
            if text[at] == "\t" and line.strip()[0] not in "[]{},#":
                yield ERROR, at
                return
        if column > columns[-1]:
            if len(columns) > 1:
                yield "INDENT", at
            columns.append(column)
        else:
            for k in close(column):
                yield k, at
            if columns[-1] != column:
                yield ERROR, at
                return
        # the line's own content, entry marks first
        fresh = True
        while True:
            m = re.compile(r"([\-?:])(?=\s|$)").match(text, at)
            if not (m and fresh):
                break
            yield m[1], at
            gap = re.compile(r"[ \t]*").match(text, m.end())
            nxt = gap.end()
            if nxt >= n or text[nxt] in "\r\n#":
                at = nxt
                fresh = None
                break
            inner = column + (nxt - at)
            ahead = text[nxt : line_end(nxt)]
            nested = re.match(r"[\-?](?=\s|$)", ahead) or _is_key(text, nxt)
            if nested:
                yield "INDENT", nxt
                columns.append(inner)
                column = inner
                at = nxt
                if not re.match(r"[\-?](?=\s|$)", ahead):
                    fresh = False
            else:
                at, fresh = nxt, False
        parent = columns[-1]
        value = m is not None and fresh is False and not (columns[-1] == column and _is_key(text, at))
        end = yield from _yaml_content(text, at, parent if not value else columns[-1], len(columns) == 2 and not _is_key(text, at) and fresh)
        if end is None:
            return
        at = end
    for k in close(-1):
        yield k, n


def _is_key(text: str, at: int) -> bool:
    """Whether a scalar followed by a colon begins here, on one line."""
    while m := _YAML_PROP.match(text, at):
        at = re.compile(r"[ \t]*").match(text, m.end()).end()
    if at >= len(text):
        return False
    c = text[at]
    if c in "[{":
        depth, i = 0, at
        while i < len(text) and text[i] != "\n":
            depth += (text[i] in "[{") - (text[i] in "]}")
            i += 1
            if not depth:
                break
        return bool(_YAML_KEYED.match(text, re.compile(r"[ \t]*").match(text, i).end()))
    m = (_YAML_DOUBLE if c == '"' else _YAML_SINGLE if c == "'" else _YAML_ALIAS if c == "*" else _YAML_PLAIN).match(text, at)
    if not m or "\n" in m[0]:
        return False
    return bool(_YAML_KEYED.match(text, re.compile(r"[ \t]*").match(text, m.end()).end()))


_BLANKS = re.compile(r"[ \t]*")
_REST = re.compile(r"[ \t]*(?:(?:(?<=\s)|^)#[^\n]*)?\r?(?:\n|$)")


def _yaml_content(text: str, at: int, parent: int, top: bool):
    """Tokens from ``at`` to the end of the value begun there; returns where the next line starts, or None after an error."""
    n = len(text)
    keyed = False
    scalar = False
    while True:
        at = _BLANKS.match(text, at).end()
        if at >= n or text[at] in "\r\n" or text[at] == "#" and (at == 0 or text[at - 1] in " \t\n"):
            yield "NEWLINE", at
            j = text.find("\n", at)
            return n if j < 0 else j + 1
        c = text[at]
        if m := _YAML_PROP.match(text, at):
            yield "PROP", at
            at = m.end()
        elif c == "*" and (m := _YAML_ALIAS.match(text, at)):
            yield "ALIAS", at
            at = m.end()
        elif c == ":" and _YAML_KEYED.match(text, at):
            yield ":", at
            at += 1
            keyed, scalar = True, False
        elif c in "|>" and not scalar:
            m = _YAML_BLOCK.match(text, at)
            if not m:
                yield ERROR, at
                return None
            yield "BLOCKTEXT", at
            at = m.end() + 1
            while at < n:
                j = text.find("\n", at)
                j = n if j < 0 else j
                line = text[at:j]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= parent:
                    break
                at = j + 1
            return min(at, n)
        elif c in "[{":
            at = yield from _yaml_flow(text, at)
            if at is None:
                return None
            scalar = True
        elif c in "\"'":
            m = (_YAML_DOUBLE if c == '"' else _YAML_SINGLE).match(text, at)
            if not m:
                yield ERROR, at
                return None
            yield "SCALAR", at
            at, scalar = m.end(), True
        elif (m := _YAML_PLAIN.match(text, at)) and not scalar:
            yield "SCALAR", at
            at, scalar = m.end(), True
            if not _YAML_KEYED.match(text, _BLANKS.match(text, at).end()):
                at = yield from _more_lines(text, at, parent, top)
                if at is None:
                    return None
                return at
        else:
            yield ERROR, at
            return None


def _more_lines(text: str, at: int, parent: int, top: bool):
    """The rest of a plain scalar's line and its continuation lines."""
    n = len(text)
    m = _REST.match(text, at)
    if not m:
        yield ERROR, at
        return None
    commented = "#" in m[0]
    end = m.end()
    while end < n and not commented:
        j = text.find("\n", end)
        j = n if j < 0 else j
        line = text[end:j]
        bare = line.strip()
        if bare:
            column = len(line) - len(line.lstrip(" "))
            if column <= parent and not (top and column >= 0) or re.match(r"(?:---|\.\.\.)(?=\s|$)", line):
                break
            if bare.startswith("#"):
                commented = True
                break
            if _YAML_KEYED.search(re.sub(r"\s#.*$", "", line)) and not top or top and _is_key(text, end + column):
                yield ERROR, end
                return None
        end = j + 1
    yield "NEWLINE", min(end, n)
    return min(end, n)


def _yaml_flow(text: str, at: int):
    n, depth = len(text), 0
    while at < n:
        m = re.compile(r"(?:\s+(?:#[^\n]*)?)+").match(text, at)
        if m:
            at = m.end()
            if at >= n:
                break
        c = text[at]
        if c in "[{":
            depth += 1
            yield c, at
            at += 1
        elif c in "]}":
            depth -= 1
            yield c, at
            at += 1
            if not depth:
                return at
        elif c == ",":
            yield c, at
            at += 1
        elif c == ":" and (at + 1 >= n or text[at + 1] in " \t\r\n,[]{}" or text[at - 1] in "\"'"):
            yield ":", at
            at += 1
        elif c == "?" and text[at + 1 : at + 2].isspace():
            yield "?", at
            at += 1
        elif m := _YAML_PROP.match(text, at):
            yield "PROP", at
            at = m.end()
        elif m := _YAML_ALIAS.match(text, at):
            yield "ALIAS", at
            at = m.end()
        elif c in "\"'":
            m = (_YAML_DOUBLE if c == '"' else _YAML_SINGLE).match(text, at)
            if not m:
                break
            yield "SCALAR", at
            at = m.end()
        elif m := _YAML_PLAIN_FLOW.match(text, at):
            yield "SCALAR", at
            at = m.end()
            while more := re.compile(r"[ \t]*\r?\n[ \t]*").match(text, at):
                nxt = _YAML_PLAIN_FLOW.match(text, more.end())
                if not nxt:
                    break
                at = nxt.end()
        else:
            break
    yield ERROR, min(at, n)
    return None


LEXERS: dict[str, Callable[[str], tuple[list[str], Offsets]]] = {
    "python": _python(), "java": _java(), "javascript": _javascript(), "go": _go(), "rust": _rust(), "json": _json(),
    "toml": _listed(_toml), "xml": _listed(_xml), "yaml": _listed(_yaml),
}
LEXERS["typescript"] = LEXERS["javascript"]
NEWLINES = {"javascript": "offending", "typescript": "offending", "go": "after"}
ENDS = {"go": GO_ENDS}
