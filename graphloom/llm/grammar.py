"""Parser tables from bundled grammars, and the parser that runs them.

``tables`` turns an EBNF grammar into SLR(1) tables: the LR(0) automaton with
reductions filtered by follow sets.  Entries may hold several actions; the
parser follows all of them side by side (generalised LR), so a grammar need
not be free of conflicts.  It only recognises: no tree is built.

Stacks are hash-consed, so equal contexts are one object, and each set of
stacks remembers where every token led.  After a few files a token costs one
dictionary lookup; the tables are consulted for new contexts alone.

Grammar notation: ``Name = alternatives ;`` with ``'literal'`` terminals,
upper-case token classes, groups, ``?``, ``*``, ``+`` and ``X % ','`` for a
separated list.  The first name is the start.
"""

from __future__ import annotations

import re
from collections import defaultdict

EOF, ASI, NL = "<eof>", "ASI", "<nl>"
_NOTATION = re.compile(r"\s*(?:(?P<lit>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>[=;|()?*+%]))")


class _Reader:
    """EBNF to plain productions; repetitions become left-recursive helpers."""

    def __init__(self, text: str):
        self.tokens = []
        text = re.sub(r"#[^\n']*$", "", text, flags=re.M)
        at = 0
        while text[at:].strip():
            m = _NOTATION.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 40]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self.made: dict[tuple, str] = {}
        self.named: set[str] = set()

    def peek(self) -> tuple[str | None, str | None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def read(self) -> str:
        start = None
        while self.at < len(self.tokens):
            _, name = self.take()
            if self.take()[1] != "=":
                raise ValueError(f"grammar: no = after {name}")
            start = start or name
            self.rules.setdefault(name, []).extend(self.alternatives())
            if self.take()[1] != ";":
                raise ValueError(f"grammar: no ; after {name}")
        return start

    def helper(self, kind: str, body: tuple, build) -> str:
        key = (kind, *body)
        if key not in self.made:
            self.made[key] = name = f"@{len(self.made)}"
            self.rules[name] = build(name)
        return self.made[key]

    def alternatives(self) -> list[tuple[str, ...]]:
        out = [self.sequence()]
        while self.peek()[1] == "|" and self.peek()[0] == "op":
            self.take()
            out.append(self.sequence())
        return out

    def sequence(self) -> tuple[str, ...]:
        out: list[str] = []
        while True:
            kind, value = self.peek()
            if kind is None or kind == "op" and value in ";|)":
                return tuple(out)
            self.take()
            if kind == "lit":
                item = value[1:-1]
            elif kind == "name":
                item = value
                self.named.add(value)
            elif value == "(":
                inner = self.alternatives()
                self.take()
                item = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else self.helper("group", tuple(inner), lambda _: inner)
            else:
                raise ValueError(f"grammar: {value}")
            while self.peek()[0] == "op" and self.peek()[1] in "?*+%":
                op = self.take()[1]
                if op == "?":
                    item = self.helper("?", (item,), lambda _, x=item: [(), (x,)])
                elif op == "*":
                    item = self.helper("*", (item,), lambda n, x=item: [(), (n, x)])
                elif op == "+":
                    item = self.helper("+", (item,), lambda n, x=item: [(x,), (n, x)])
                else:
                    sep = self.take()[1][1:-1]
                    item = self.helper("%", (item, sep), lambda n, x=item, s=sep: [(x,), (n, s, x)])
            out.append(item)


def tables(text: str) -> dict:
    """SLR(1) tables of a grammar: actions (shift, reductions) and gotos by state."""
    reader = _Reader(text)
    start = reader.read()
    rules = reader.rules
    prods: list[tuple[str, tuple[str, ...]]] = [("@start", (start, EOF))]
    by_lhs = defaultdict(list)
    by_lhs["@start"].append(0)
    for lhs, alts in rules.items():
        for rhs in dict.fromkeys(alts):
            by_lhs[lhs].append(len(prods))
            prods.append((lhs, rhs))
    missing = {x for x in reader.named if x not in rules and not x.isupper()}
    if missing:
        raise ValueError(f"grammar: undefined {sorted(missing)}")
    nullable: set[str] = set()
    grew = True
    while grew:
        n = len(nullable)
        nullable |= {lhs for lhs, rhs in prods if all(x in nullable for x in rhs)}
        grew = len(nullable) > n
    first: dict[str, set[str]] = defaultdict(set)
    grew = True
    while grew:
        grew = False
        for lhs, rhs in prods:
            n = len(first[lhs])
            for x in rhs:
                first[lhs] |= first[x] if x in rules else {x}
                if x not in nullable:
                    break
            grew |= len(first[lhs]) > n
    follow: dict[str, set[str]] = defaultdict(set)
    grew = True
    while grew:
        grew = False
        for lhs, rhs in prods:
            tail = set(follow[lhs])
            for x in reversed(rhs):
                if x in rules:
                    if not tail <= follow[x]:
                        follow[x] |= tail
                        grew = True
                    tail = tail | first[x] if x in nullable else set(first[x])
                else:
                    tail = {x}
    starts: dict[str, frozenset[int]] = {}
    for name in rules:  # productions a dot before ``name`` opens
        seen, todo = {name}, [name]
        while todo:
            for p in by_lhs[todo.pop()]:
                rhs = prods[p][1]
                if rhs and rhs[0] in rules and rhs[0] not in seen:
                    seen.add(rhs[0])
                    todo.append(rhs[0])
        starts[name] = frozenset(p for s in seen for p in by_lhs[s])
    states: dict[frozenset, int] = {}
    kernels: list[frozenset] = []

    def state(kernel: frozenset) -> int:
        if kernel not in states:
            states[kernel] = len(kernels)
            kernels.append(kernel)
        return states[kernel]

    state(frozenset([(0, 0)]))
    action: list[dict] = []
    goto: list[dict] = []
    i = 0
    while i < len(kernels):
        moves: dict[str, set] = defaultdict(set)
        reductions: dict[str, list] = defaultdict(list)
        opened: set[int] = set()
        for p, dot in kernels[i]:
            rhs = prods[p][1]
            if dot < len(rhs):
                moves[rhs[dot]].add((p, dot + 1))
                if rhs[dot] in rules:
                    opened |= starts[rhs[dot]]
            else:
                for t in follow[prods[p][0]]:
                    reductions[t].append((prods[p][0], len(rhs)))
        for p in opened:
            lhs, rhs = prods[p]
            if rhs:
                moves[rhs[0]].add((p, 1))
            else:
                for t in follow[lhs]:
                    reductions[t].append((lhs, 0))
        act, go = {}, {}
        for x, kernel in moves.items():
            target = state(frozenset(kernel))
            if x in rules:
                go[x] = target
            else:
                act[x] = (target, ())
        for t, r in reductions.items():
            act[t] = (act[t][0] if t in act else None, tuple(r))
        action.append(act)
        goto.append(go)
        i += 1
    return {"action": action, "goto": goto, "terminals": sorted({x for _, rhs in prods for x in rhs if x not in rules})}


class _Stack:
    __slots__ = ("parent", "state")

    def __init__(self, state: int, parent: _Stack | None):
        self.state, self.parent = state, parent


class _Set(dict):
    """A set of stacks, and by token the set it leads to."""

    __slots__ = ("after_newline", "owner", "soft", "stacks")

    def __init__(self, owner: Parser, stacks: frozenset, soft: bool = False):
        self.owner, self.stacks, self.soft = owner, stacks, soft

    def __missing__(self, token: str) -> _Set:
        self[token] = out = self.owner.step(self, token)
        return out


class _AfterNewline(dict):
    """A set of stacks with a line end behind it, where a statement may end unwritten."""

    __slots__ = ("before", "stacks")

    def __init__(self, before: _Set):
        self.before, self.stacks = before, before.stacks

    def __missing__(self, token: str):
        if token == NL:
            out = self
        else:
            # A sign on a new line belongs to what follows it.
            out = self.before[ASI][token] if token in ("++", "--") else self.before[token]
            if not out.stacks and token in ("++", "--"):
                out = self.before[token]
            if not out.stacks and self.stacks:
                out = self.before[ASI][token]
        self[token] = out
        return out


MOST_SETS = 60_000


class Parser:
    """Runs tables over token kinds.

    ``newlines``: '' (line ends are no tokens), 'offending' (a statement may end
    at a line end, a closing brace or the end of the text if the next token is
    not accepted otherwise) or 'after' (a line end ends the statement after one
    of ``ends``).
    """

    def __init__(self, built: dict, newlines: str = "", ends: frozenset = frozenset()):
        self.action, self.goto, self.newlines, self.ends = built["action"], built["goto"], newlines, ends
        self.reset()

    def reset(self) -> None:
        self.stacks: dict[tuple[int, int], _Stack] = {}
        self.sets: dict[tuple[frozenset, bool], _Set] = {}
        self.dead = _Set(self, frozenset())
        self.start = self.set(frozenset([self.stack(0, None)]), False)

    def stack(self, state: int, parent: _Stack | None) -> _Stack:
        key = (state, id(parent))
        found = self.stacks.get(key)
        if found is None:
            found = self.stacks[key] = _Stack(state, parent)
        return found

    def set(self, stacks: frozenset, soft: bool) -> _Set:
        if not stacks:
            return self.dead
        found = self.sets.get((stacks, soft))
        if found is None:
            found = self.sets[stacks, soft] = _Set(self, stacks, soft)
        return found

    def advance(self, stacks: frozenset, token: str) -> frozenset:
        todo, seen, shifted = list(stacks), set(stacks), set()
        action, goto = self.action, self.goto
        while todo:
            s = todo.pop()
            act = action[s.state].get(token)
            if act is None:
                continue
            if act[0] is not None:
                shifted.add(self.stack(act[0], s))
            for lhs, n in act[1]:
                p = s
                for _ in range(n):
                    p = p.parent
                to = goto[p.state].get(lhs)
                if to is not None:
                    new = self.stack(to, p)
                    if new not in seen:
                        seen.add(new)
                        todo.append(new)
        return frozenset(shifted)

    def step(self, at: _Set, token: str):
        if not at.stacks:
            return self.dead
        if token == NL:
            if self.newlines == "after":
                return self.set(self.advance(at.stacks, ";"), False) if at.soft else at
            return _AfterNewline(at)
        out = self.advance(at.stacks, token)
        if not out and self.newlines == "offending" and token in ("}", EOF):
            out = self.advance(self.advance(at.stacks, ASI), token)
        if self.newlines == "after" and token == EOF and at.soft and not out:
            out = self.advance(self.advance(at.stacks, ";"), token)
        return self.set(out, token in self.ends)

    def first_error(self, kinds: list[str]) -> int:
        """Index of the first token no reading accepts (len(kinds): the end), or -1."""
        if len(self.sets) > MOST_SETS or len(self.stacks) > 4 * MOST_SETS:
            self.reset()
        at = self.start
        for k in kinds:
            at = at[k]
        if at[EOF].stacks:
            return -1
        at = self.start
        for i, k in enumerate(kinds):
            at = at[k]
            if not at.stacks:
                return i
        return len(kinds)
