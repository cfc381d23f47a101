"""Memoised parsing with derivatives over nested token streams.

A grammar is a set of rules with regular right sides. The state of a parse is an expression; reading
a token replaces it by its derivative. Expressions are hash-consed and every derivative is computed
once per process, so a parse is one table lookup a token. Bracketed groups are derived apart: an
opening token sets the outer expression's possible continuations aside and goes on with the group's
inside alone, which makes the tables independent of how deep a group is nested. Alternatives that
open the same bracket with different insides are carried side by side.

An empty derivative is an error at exactly that token. A final expression that can't match the
empty word (or an open group) means that the text ends too early.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = {v: k for k, v in _OPEN.items()}

EMPTY, EPS = 0, 1


class Grammar:
    """Rules in the notation ``name = a 'tok' (b | c)* d?``; a rule may go on over several lines.

    Quoted words are tokens and so are names in capitals. ``'(' x ')'`` inside one sequence is a
    group. Rules must not be left-recursive.
    """

    def __init__(self, text: str, start: str):
        self.nodes: list[tuple] = [("empty",), ("eps",)]
        self.index: dict[tuple, int] = {("empty",): EMPTY, ("eps",): EPS}
        self.null: dict[int, bool] = {EMPTY: False, EPS: True}
        self.rules: dict[str, int] = {}
        self.tokens: set[str] = set()
        self._d: dict[tuple[int, str], int] = {}
        self._o: dict[tuple[int, str], tuple] = {}
        rules: dict[str, str] = {}
        name = ""
        for line in text.splitlines():
            if m := re.match(r"(\w+) = (.*)", line):
                name = m[1]
                rules[name] = m[2]
            elif line.strip():
                rules[name] += " " + line.strip()
        self._names = set(rules)
        for k, v in rules.items():
            self.rules[k] = self._read(v)
        self._nullable_rules()
        self.start = self.node("ref", start)

    # building

    def node(self, *key) -> int:
        i = self.index.get(key)
        if i is None:
            i = len(self.nodes)
            self.nodes.append(key)
            self.index[key] = i
        return i

    def seq(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        if self.nodes[a][0] == "seq":
            return self.seq(self.nodes[a][1], self.seq(self.nodes[a][2], b))
        return self.node("seq", a, b)

    def alt(self, items) -> int:
        flat: set[int] = set()
        for i in items:
            if self.nodes[i][0] == "alt":
                flat |= set(self.nodes[i][1])
            elif i != EMPTY:
                flat.add(i)
        if not flat:
            return EMPTY
        if len(flat) == 1:
            return flat.pop()
        return self.node("alt", tuple(sorted(flat)))

    def _read(self, text: str) -> int:
        toks = re.findall(r"'[^']+'|\w+|[|()*+?]", text)
        pos = 0

        def alternatives(stop: tuple[str, ...]) -> int:
            nonlocal pos
            out = [sequence(stop)]
            while pos < len(toks) and toks[pos] == "|":
                pos += 1
                out.append(sequence(stop))
            return self.alt(out)

        def sequence(stop: tuple[str, ...]) -> int:
            nonlocal pos
            items: list[int] = []
            while pos < len(toks) and toks[pos] != "|" and toks[pos] not in stop:
                t = toks[pos]
                pos += 1
                if t == "(":
                    n = alternatives((")",))
                    pos += 1
                elif t[0] == "'" and t[1:-1] in _OPEN:
                    close = f"'{_OPEN[t[1:-1]]}'"
                    n = self.node("group", t[1:-1], alternatives((close,)))
                    pos += 1
                elif t[0] == "'" or t not in self._names:
                    word = t.strip("'")
                    self.tokens.add(word)
                    n = self.node("tok", word)
                else:
                    n = self.node("ref", t)
                if pos < len(toks) and toks[pos] in "*+?":
                    op = toks[pos]
                    pos += 1
                    star = self.node("star", n)
                    n = {"*": star, "+": self.seq(n, star), "?": self.alt([n, EPS])}[op]
                items.append(n)
            out = EPS
            for n in reversed(items):
                out = self.seq(n, out)
            return out

        return alternatives(())

    def _nullable_rules(self) -> None:
        self._rule_null = dict.fromkeys(self.rules, False)
        changed = True
        while changed:
            changed = False
            for k, n in self.rules.items():
                self.null = {EMPTY: False, EPS: True}
                if self.nullable(n) and not self._rule_null[k]:
                    self._rule_null[k] = changed = True
        self.null = {EMPTY: False, EPS: True}

    def nullable(self, n: int) -> bool:
        v = self.null.get(n)
        if v is None:
            kind, *a = self.nodes[n]
            if kind == "star":
                v = True
            elif kind == "seq":
                v = self.nullable(a[0]) and self.nullable(a[1])
            elif kind == "alt":
                v = any(self.nullable(x) for x in a[0])
            else:
                v = kind == "ref" and self._rule_null[a[0]]
            self.null[n] = v
        return v

    # derivatives

    def derive(self, n: int, t: str) -> int:
        """The expression for what may follow ``t`` at the start of ``n``; ``t`` opens no group."""
        v = self._d.get((n, t))
        if v is None:
            kind, *a = self.nodes[n]
            if kind == "tok":
                v = EPS if a[0] == t else EMPTY
            elif kind == "seq":
                v = self.seq(self.derive(a[0], t), a[1])
                if self.nullable(a[0]):
                    v = self.alt([v, self.derive(a[1], t)])
            elif kind == "alt":
                v = self.alt([self.derive(x, t) for x in a[0]])
            elif kind == "star":
                v = self.seq(self.derive(a[0], t), n)
            elif kind == "ref":
                v = self.derive(self.rules[a[0]], t)
            else:
                v = EMPTY
            self._d[n, t] = v
        return v

    def opens(self, n: int, t: str) -> tuple[tuple[int, int], ...]:
        """(inside, continuation) of every group that ``t`` may open at the start of ``n``."""
        v = self._o.get((n, t))
        if v is None:
            kind, *a = self.nodes[n]
            if kind == "group":
                v = ((a[1], EPS),) if a[0] == t else ()
            elif kind == "seq":
                v = tuple((i, self.seq(r, a[1])) for i, r in self.opens(a[0], t))
                if self.nullable(a[0]):
                    v += self.opens(a[1], t)
            elif kind == "alt":
                v = tuple(x for y in a[0] for x in self.opens(y, t))
            elif kind == "star":
                v = tuple((i, self.seq(r, n)) for i, r in self.opens(a[0], t))
            elif kind == "ref":
                v = self.opens(self.rules[a[0]], t)
            else:
                v = ()
            v = tuple(dict.fromkeys(v))
            self._o[n, t] = v
        return v


@dataclass(frozen=True)
class Verdict:
    ok: bool
    kind: str = ""  # "token": empty derivative; "end": the text ends too early
    at: int = -1  # index of the failing token


class _Row(dict):
    """Derivatives of one state; those not seen before are computed on demand."""

    __slots__ = ("parser", "state")

    def __init__(self, parser, state):
        super().__init__()
        self.parser, self.state = parser, state

    def __missing__(self, t):
        p, g = self.parser, self.parser.g
        if t in _OPEN:
            insides: dict[int, list] = {}
            for slot, n in enumerate(self.state):
                for inside, rest in g.opens(n, t):
                    insides.setdefault(inside, []).append((slot, rest))
            if not insides:
                v = None
            else:
                v = (p.row(tuple(insides)), (t, len(self.state), tuple(tuple(x) for x in insides.values()), {}))
        else:
            after = tuple(g.derive(n, t) for n in self.state)
            v = p.row(after) if any(after) else None
        self[t] = v
        return v


class Parser:
    """Parses token lists by one grammar. ``semicolons``: a failing token may be preceded by an
    inserted ';' where the language says so (see ``parse``)."""

    LIMIT = 400_000  # nodes; beyond it the tables are dropped and made anew

    def __init__(self, text: str, start: str, semicolons: bool = False):
        self.text, self.start_rule, self.semicolons = text, start, semicolons
        self._reset()

    def _reset(self) -> None:
        self.g = Grammar(self.text, self.start_rule)
        self.rows: dict[tuple, _Row] = {}
        self.start = self.row((self.g.start,))

    def row(self, state: tuple) -> _Row:
        r = self.rows.get(state)
        if r is None:
            r = self.rows[state] = _Row(self, state)
        return r

    def _close(self, row: _Row, frame: tuple) -> _Row | None:
        """The outer state after a group whose inside is at ``row``; None if the inside isn't complete."""
        _, slots, back, memo = frame[1]
        mask = tuple(self.g.nullable(n) for n in row.state)
        if mask in memo:
            return memo[mask]
        outer: list[list[int]] = [[] for _ in range(slots)]
        for full, rests in zip(mask, back, strict=True):
            if full:
                for slot, rest in rests:
                    outer[slot].append(rest)
        state = tuple(self.g.alt(x) for x in outer)
        v = memo[mask] = self.row(state) if any(state) else None
        return v

    def parse(self, tokens: list[str], newline_before=None) -> Verdict:
        """``newline_before(i)`` tells whether a line ends before token i (for inserted semicolons)."""
        if len(self.g.nodes) > self.LIMIT:
            self._reset()
        row, stack, i = self.start, [], -1
        for i, t in enumerate(tokens):
            if t in _CLOSE:
                if not stack or stack[-1][1][0] != _CLOSE[t]:
                    return Verdict(False, "token", i)
                nxt = self._close(row, stack[-1])
                if nxt is None and self.semicolons and (r := row[";"]) is not None:
                    nxt = self._close(r, stack[-1])
                if nxt is None:
                    return Verdict(False, "token", i)
                stack.pop()
                row = nxt
                continue
            nxt = row[t]
            if nxt is None and self.semicolons and newline_before is not None and newline_before(i) and (r := row[";"]) is not None:
                nxt = r[t]
            if nxt is None:
                return Verdict(False, "token", i)
            if t in _OPEN:
                # alternatives of the outer state that didn't open this group are gone
                stack.append(nxt)
                row = nxt[0]
            else:
                row = nxt
        if stack:
            return Verdict(False, "end", i + 1)
        if not any(self.g.nullable(n) for n in row.state):
            if self.semicolons and (r := row[";"]) is not None and any(self.g.nullable(n) for n in r.state):
                return Verdict(True)
            return Verdict(False, "end", i + 1)
        return Verdict(True)
