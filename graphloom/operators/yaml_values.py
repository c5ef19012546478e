"""YAML documents as nested values: the block and flow forms that configuration and API files use.

Mappings, sequences, plain and quoted scalars, literal and folded blocks, flow
collections, comments, several documents.  Anchors, aliases, tags and complex
keys raise ``ValueError``, as does whatever is not laid out in these forms;
callers take such a file for one that does not parse.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\-?:,\[\]{}&*!|>'\"%@`][^#\n]*?|-[^\s#:][^#\n]*?)\s*:(?=\s|$)")
_WORDS = {"true": True, "false": False, "null": None, "~": None, "": None}


def _bare(line: str) -> str:
    """The line without its comment and end blanks."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1 : i] != "\\" else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def scalar(text: str):
    t = text.strip()
    if t[:1] == '"':
        if len(t) < 2 or t[-1] != '"':
            raise ValueError("open string")
        return json.loads(re.sub(r"\\(?![\"\\/bfnrtu])", r"\\\\", t))
    if t[:1] == "'":
        if len(t) < 2 or t[-1] != "'":
            raise ValueError("open string")
        return t[1:-1].replace("''", "'")
    if t[:1] in ("&", "*", "!", "@", "`", "%"):
        raise ValueError(f"not read: {t[:10]}")
    if t.lower() in _WORDS:
        return _WORDS[t.lower()]
    if re.fullmatch(r"[-+]?\d+", t):
        return int(t)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?", t):
        return float(t)
    return t


class _Flow:
    """A flow collection read character by character."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blanks(self) -> str:
        while self.at < len(self.text) and self.text[self.at] in " \t\n":
            self.at += 1
        return self.text[self.at : self.at + 1]

    def word(self, ends: str) -> str:
        if self.blanks() in ("'", '"'):
            m = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'").match(self.text, self.at)
            if not m:
                raise ValueError("open string")
            self.at = m.end()
            return m[0]
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ends and not (self.text[self.at] == ":" and self.text[self.at + 1 : self.at + 2] in ("", " ", "\n")):
            self.at += 1
        return self.text[start : self.at]

    def value(self):
        c = self.blanks()
        if c == "[":
            return self.items("]")
        if c == "{":
            return self.items("}")
        return scalar(self.word(",]}"))

    def items(self, end: str):
        out: list = []
        pairs: dict = {}
        self.at += 1
        while (c := self.blanks()) != end:
            if not c:
                raise ValueError("open collection")
            if end == "]":
                out.append(self.value())
            else:
                key = scalar(self.word(",]}"))
                if self.blanks() == ":":
                    self.at += 1
                    pairs[str(key)] = self.value()
                else:
                    pairs[str(key)] = None
            c = self.blanks()
            if c == ",":
                self.at += 1
            elif c != end:
                raise ValueError("no comma")
        self.at += 1
        return out if end == "]" else pairs


class _Block:
    def __init__(self, lines: list[tuple[int, str]], raw: list[str]):
        self.lines, self.raw, self.at = lines, raw, 0  # (number in raw, bare line) of lines that say something

    def indent(self) -> int:
        line = self.lines[self.at][1]
        return len(line) - len(line.lstrip(" "))

    def node(self, least: int):
        if self.at >= len(self.lines) or self.indent() < least:
            return None
        here = self.indent()
        line = self.lines[self.at][1].strip()
        if line == "-" or line.startswith("- "):
            return self.sequence(here)
        if _KEY.match(line):
            return self.mapping(here)
        return self.inline(line, here)

    def inline(self, text: str, indent: int):
        """A value that begins on this line and may go on below."""
        number = self.lines[self.at][0]
        self.at += 1
        if text[:1] in ("|", ">"):
            return self.literal(number, indent, text)
        if text[:1] in ("[", "{"):
            while True:
                flow = _Flow(text)
                try:
                    value = flow.value()
                except ValueError:
                    if self.at >= len(self.lines):
                        raise
                    text += "\n" + self.lines[self.at][1].strip()
                    self.at += 1
                    continue
                if flow.blanks():
                    raise ValueError("text behind a collection")
                return value
        while self.at < len(self.lines) and self.indent() > indent and not (text[:1] in "\"'" and len(text) > 1 and text[-1] == text[0]):
            line = self.lines[self.at][1].strip()
            if _KEY.match(line) and text[:1] not in "\"'":
                raise ValueError("a mapping inside a scalar")
            text += " " + line
            self.at += 1
        return scalar(text)

    def literal(self, number: int, indent: int, mark: str) -> str:
        out = []
        k = number + 1
        while k < len(self.raw) and (not self.raw[k].strip() or len(self.raw[k]) - len(self.raw[k].lstrip(" ")) > indent):
            out.append(self.raw[k])
            k += 1
        while self.at < len(self.lines) and self.lines[self.at][0] < k:
            self.at += 1
        while out and not out[-1].strip():
            out.pop()
        margin = min((len(x) - len(x.lstrip(" ")) for x in out if x.strip()), default=0)
        body = [x[margin:] for x in out]
        text = "\n".join(body) if mark[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(body))
        return text + ("" if "-" in mark else "\n")

    def sequence(self, indent: int) -> list:
        out = []
        while self.at < len(self.lines) and self.indent() == indent and (self.lines[self.at][1].strip() + " ").startswith("- "):
            number, line = self.lines[self.at]
            rest = line.lstrip()[1:]
            if not rest.strip():
                self.at += 1
                out.append(self.node(indent + 1))
            else:  # what follows the dash is laid out as if the dash were a blank
                self.lines[self.at] = (number, " " * indent + " " + rest)
                inner = len(self.lines[self.at][1]) - len(self.lines[self.at][1].lstrip(" "))
                text = rest.strip()
                out.append(self.node(inner) if _KEY.match(text) or text == "-" or text.startswith("- ") else self.inline(text, indent))
        if self.at < len(self.lines) and self.indent() > indent:
            raise ValueError("indentation")
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while self.at < len(self.lines) and self.indent() == indent and (m := _KEY.match(self.lines[self.at][1].strip())):
            line = self.lines[self.at][1].strip()
            key, text = str(scalar(m[1])), line[m.end() :].strip()
            if text:
                out[key] = self.inline(text, indent)
            else:
                self.at += 1
                below = self.at < len(self.lines) and self.indent() == indent and (self.lines[self.at][1].strip() + " ").startswith("- ")
                out[key] = self.sequence(indent) if below else self.node(indent + 1)
        if self.at < len(self.lines) and self.indent() > indent:
            raise ValueError("indentation")
        return out


def documents(text: str | None) -> Iterator[object]:
    """The values of the documents of a YAML text."""
    raw = (text or "").lstrip("\ufeff").replace("\r\n", "\n").split("\n")
    if any("\t" in x[: len(x) - len(x.lstrip())] for x in raw):
        raise ValueError("a tab indents")
    parts: list[list[tuple[int, str]]] = [[]]
    for i, line in enumerate(raw):
        if line.startswith("%"):
            continue
        if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
            parts.append([])
            line = line[3:]
        bare = _bare(line)
        if bare.strip():
            parts[-1].append((i, bare))
    for lines in parts:
        if lines:
            block = _Block(lines, raw)
            value = block.node(0)
            if block.at < len(block.lines):
                raise ValueError(f"line {block.lines[block.at][0] + 1}")
            yield value
