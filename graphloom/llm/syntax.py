"""Source files that don't parse: tokens by regular expression, then memoised derivatives.

``check(lang, source)`` gives the verdict on one file. The tables of each grammar live in the
Python worker, so a state is derived once per worker; so do the classes of token texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import grammars
from graphloom.llm.derivatives import Parser, Verdict

#: Reserved words.
JAVA_WORDS = """abstract assert boolean break byte case catch char class continue default do double else enum extends
false final finally float for if implements import instanceof int interface long module native new null open package
permits private protected public record return sealed short static strictfp super switch synchronized this throw throws to
transient transitive true try var void volatile when while with yield""".split()
JS_WORDS = """as async await break case catch class const continue debugger default delete do else export extends false finally
for from function get if import in instanceof let new null of return set static super switch this throw true try type typeof
var void while with yield""".split()
TS_WORDS = JS_WORDS + """abstract accessor asserts declare enum global implements infer interface is keyof module namespace out
override private protected public readonly satisfies unique""".split()
PYTHON_WORDS = """False None True and as assert async await break case class continue def del elif else except finally for from
global if import in is lambda match nonlocal not or pass raise return try type while with yield""".split()
SQL_WORDS = """ACTION ADD ALL ALTER AND AS BEGIN BETWEEN BY CASCADE CASE CAST CHECK COLLATE COLUMN CONSTRAINT CREATE DEFAULT DELETE
DESC DISTINCT DROP ELSE END EXISTS FETCH FIRST FOREIGN FROM GENERATED GROUP HAVING IF IN INDEX INSERT INTERVAL INTO IS JOIN KEY
LIKE LIMIT NOT NULL OFFSET ON OR ORDER OVER PRIMARY REFERENCES RENAME REPLACE RETURNING ROLE SCHEMA SELECT SEQUENCE SET TABLE
TEMP THEN TYPE UNION UNIQUE UPDATE USING VALUES VIEW WHEN WHERE WITH""".split()
SQL_CLASSES = {
    "VERB": "GRANT REVOKE COMMIT ROLLBACK START SAVEPOINT TRUNCATE COMMENT ANALYZE VACUUM EXPLAIN USE LOCK UNLOCK CALL EXEC EXECUTE MERGE COPY DECLARE PRAGMA SHOW DESCRIBE REFRESH LOAD DO GO RESET DEALLOCATE PREPARE REINDEX CLUSTER ATTACH DETACH OPTIMIZE".split(),
    "MODIFIER": "TEMPORARY GLOBAL LOCAL UNLOGGED MATERIALIZED EXTERNAL AUTO_INCREMENT AUTOINCREMENT IDENTITY ASC RESTRICT NO IGNORE RECURSIVE OVERWRITE CONCURRENTLY CLUSTERED NONCLUSTERED DEFERRABLE INVISIBLE FULLTEXT SPATIAL BITMAP".split(),
    "OBJ": "DATABASE USER FUNCTION PROCEDURE TRIGGER DOMAIN EXTENSION TABLESPACE SYNONYM POLICY CATALOG SERVER PUBLICATION SUBSCRIPTION SYSTEM SESSION LOGIN AGGREGATE OPERATOR RULE COLLATION PACKAGE".split(),
    "JOINWORD": "LEFT RIGHT INNER OUTER FULL CROSS NATURAL LATERAL EXCEPT INTERSECT MINUS".split(),
    "TYPEWORD": "UNSIGNED ZEROFILL VARYING PRECISION ZONE TIME".split(),
    "OP": "ILIKE RLIKE REGEXP SIMILAR GLOB DIV MOD XOR AT ESCAPE".split(),
}

_NUM = r"(?:0[xX][0-9a-fA-F_]+[nlL]?|0[bB][01_]+[nlL]?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[nlLfFdDjJ]?)"
_SLASH_SKIP = r"(?:[\s﻿\x1a]+|//[^\n\r]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*+"
_DQ, _SQ = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
_REGEX = r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^`\\]|\\[\s\S])*`|\{(?:[^{}]|\{[^{}]*\})*\})*\})*`"
_WORD = r"[^\W\d]\w*"
_JS_OPS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
_AFTER = r"(?:=>|===?|!==?|&&|\|\||\?\?|[=(,\[!&|?{};:+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else)\b)"

_MASTER = {
    "java": re.compile(_SLASH_SKIP + r"(\"\"\"[ \t]*\r?\n(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|" + _DQ + r"|'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[^\n\r])'|" + r"non-sealed\b|[^\W\d][\w$]*|\$[\w$]*|" + _NUM + r"|\.\.\.|->|::|<<=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[^\s]|\Z)"),
    "javascript": re.compile(r"(?:\A#![^\n]*)?" + _SLASH_SKIP + "(" + _AFTER + r"\s*" + _REGEX + "|" + _DQ + "|" + _SQ + "|" + _TEMPLATE + r"|[^\W\d][\w$]*|\$[\w$]*|#[^\W\d][\w$]*|" + _NUM + "|" + _JS_OPS + r"|[^\s]|\Z)"),
    "python": re.compile(r"(?:[ \t\f﻿]+|\\\r?\n|#[^\n\r]*)*+((?:[rRbBfFuU]{0,2})(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|" + _DQ + "|" + _SQ + r")|(?:\r\n?|\n)(?:[ \t\f]*(?:#[^\n\r]*)?(?:\r\n?|\n))*[ \t\f]*|" + _WORD + "|" + _NUM + r"|\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[^\s]|\Z)"),
    "sql": re.compile(r"(?:[\s﻿]+|--[^\n\r]*|#(?![\w>-])[^\n\r]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*+([eEnNbBxXrR]?'(?:[^'\\]|''|\\[\s\S])*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\$(\w*)\$[\s\S]*?\$\2\$|[@#]*[^\W\d][\w$#]*|@@?\w+|\$\d+|\?|" + _NUM + r"|<=>|->>|->|<>|!=|<=|>=|\|\||&&|:=|=>|\.\.|[^\s]|\Z)"),
}
_MASTER["typescript"] = re.compile(_MASTER["javascript"].pattern.replace(r">>>=|", "").replace(r"|>>=|>>>", "").replace(r"|<<|>>|", "|<<|"))

PAIR = "\0pair"
BAD = "BAD"
_JS_PAIR = re.compile(rf"({_AFTER})\s*({_REGEX})\Z")
_PLAIN = set("()[]{};,.<>=+-*/%&|^!~?:@")


class _Classes(dict):
    """Token text -> token class, worked out once per text; emptied when it gets large."""

    LIMIT = 300_000

    def __init__(self, lang: str):
        super().__init__()
        self.lang = lang
        self.words = set({"java": JAVA_WORDS, "javascript": JS_WORDS, "typescript": TS_WORDS, "python": PYTHON_WORDS}.get(lang, ()))
        self.sql = {w: w for w in SQL_WORDS} | {w: c for c, ws in SQL_CLASSES.items() for w in ws}

    def __missing__(self, t: str) -> str:
        if len(self) > self.LIMIT:
            self.clear()
        v = self[t] = self._of(t)
        return v

    def _of(self, t: str) -> str:
        c = t[0]
        if self.lang == "sql":
            return self._sql(t, c)
        if self.lang == "python" and (c in "\r\n" or t == ""):
            return t
        if c == "_" or c.isalpha() or c == "$" or (self.lang == "java" and t == "non-sealed"):
            if self.lang == "python" and t[-1] in "'\"" and len(t) > 1:
                return "STR"
            if self.lang in ("javascript", "typescript") and t[-1] != c and "/" in t and not t.replace("$", "_").isidentifier():
                return PAIR
            if t in self.words or t == "non-sealed":
                return t
            return "ID" if t.replace("$", "_").isidentifier() else BAD
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return "NUM"
        if c in "\"'`":
            if len(t) < 2 or t[-1] != c:
                return BAD
            return "TEMPLATE" if c == "`" else "STR"
        if c == "#" and len(t) > 1:
            return "PRIVATE"
        if self.lang in ("javascript", "typescript") and "/" in t and t not in ("/", "/=") :
            return PAIR
        if len(t) > 1 or t in _PLAIN:
            return BAD if self.lang == "java" and t == "`" else t
        return BAD

    def _sql(self, t: str, c: str) -> str:
        if t[-1] == "'" and len(t) > 1:
            return "STR"
        if c in '"`':
            return "ID" if len(t) > 1 and t[-1] == c else BAD
        if c == "$" and len(t) > 1:
            return "NUM" if t[1:].isdigit() else "STR"
        if c == "?":
            return "NUM"
        if c.isalpha() or c in "_@#":
            return self.sql.get(t.upper(), "ID") if len(t) > 1 or c.isalpha() or c == "_" else "OP"
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return "NUM"
        if c == "'":
            return BAD
        if t in ("(", ")", "[", "]", "{", "}", ";", ",", ".", "*", "=", ":"):
            return t
        return "OP" if t in ("<=>", "->>", "->", "<>", "!=", "<=", ">=", "||", "&&", ":=", "=>", "..") or c in "+-/%<>|&^~!" else BAD


_START = {
    "java": (grammars.JAVA, False), "javascript": (grammars.JS, True), "typescript": (grammars.TS, True),
    "python": (grammars.PYTHON, False), "sql": (grammars.SQL, False),
}
_tools: dict[str, tuple] = {}


def _tool(lang: str) -> tuple:
    if lang not in _tools:
        text, semi = _START[lang]
        _tools[lang] = (_MASTER[lang], _Classes(lang), Parser(text, "unit", semi))
    return _tools[lang]


def _indent(ws: str) -> int:
    n = 0
    for c in ws:
        n = (n // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else n + 1
    return n


def _layout(tokens: list[str], classes: list[str]) -> tuple[list[str], list[int]]:
    """Python's NEWLINE, INDENT and DEDENT tokens, and the raw token each belongs to."""
    out: list[str] = []
    origin: list[int] = []
    levels, depth, after = [0], 0, True
    for i, (t, c) in enumerate(zip(tokens, classes, strict=True)):
        origin += [i - 1] * (len(out) - len(origin))
        first = c[0] if c else "\n"
        if first in "\r\n":
            if depth:
                continue
            ws = re.split(r"[\r\n]", t)[-1]
            if not after:
                out.append("NEWLINE")
            n = _indent(ws)
            pending, after = n, True
            continue
        if after:
            n = pending if out or tokens[0] is not t else 0
            if n > levels[-1]:
                out.append("INDENT")
                levels.append(n)
            while n < levels[-1]:
                out.append("DEDENT")
                levels.pop()
            if n != levels[-1]:
                out.append(BAD)
            after = False
        if c in ("(", "[", "{"):
            depth += 1
        elif c in (")", "]", "}"):
            depth = max(0, depth - 1)
        out.append(c)
    origin += [len(tokens) - 1] * (len(out) - len(origin))
    if not after:
        out.append("NEWLINE")
    out += ["DEDENT"] * (len(levels) - 1)
    return out, origin + [len(tokens)] * (len(out) - len(origin))


def tokens_of(lang: str, source: str) -> list[str]:
    master, classes, _ = _tool(lang)
    found = master.findall(source)
    if found and isinstance(found[0], tuple):
        found = [x[0] for x in found]
    while found and not found[-1]:
        found.pop()
    return found


def check(lang: str, source: str | None) -> Verdict:
    """The verdict of the derivative parser. Null, empty and blank sources are valid, as are
    languages without a grammar."""
    if not source or lang not in _START or not source.strip():
        return Verdict(True)
    master, classes, parser = _tool(lang)
    toks = tokens_of(lang, source)
    cls = list(map(classes.__getitem__, toks))
    newline, origin = None, None
    if lang == "python":
        lead = re.match(r"(?:[ \t\f]*(?:#[^\n\r]*)?(?:\r\n?|\n))*([ \t\f]*)", source)
        if toks and toks[0][0] not in "\r\n" and lead[1]:
            return Verdict(False, "token", 0)
        cls, origin = _layout(toks, cls)
    elif lang in ("javascript", "typescript"):
        if PAIR in cls:
            flat: list[str] = []
            origin = []
            for i, (t, c) in enumerate(zip(toks, cls, strict=True)):
                if c is PAIR:
                    m = _JS_PAIR.match(t)
                    head = classes[m[1]] if m else BAD
                    flat += [head, "REGEX"]
                    origin += [i, i]
                else:
                    flat.append(c)
                    origin.append(i)
            cls = flat
        ends: list = []

        def newline(i: int) -> bool:
            if not ends:
                spans = [(m.start(1), m.end(1)) for m in master.finditer(source)]
                ends.extend("\n" in source[a:b] or "\r" in source[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans], strict=False))
            j = origin[i] if origin else i
            return bool(ends[j]) and not (origin and i and origin[i - 1] == j)

    elif lang == "sql" and all(c in (";",) for c in cls):
        return Verdict(True)
    v = parser.parse(cls, newline)
    if v.ok or origin is None:
        return v
    at = origin[v.at] if v.at < len(origin) else len(toks)
    # what fails behind the last token is the end of the text
    return Verdict(False, v.kind if at < len(toks) else "end", at)


def verdict(lang: str | None, source: str | None) -> Verdict:
    """The derivative parser's verdict; ``at`` is the raw token whose derivative is empty."""
    return Verdict(True) if lang is None else check(lang, source)


def place(lang: str, source: str, v: Verdict) -> tuple[int, str | None]:
    """Line (from 1) and text of the failing token; of a text that ends too early its last line."""
    found = list(_MASTER[lang].finditer(source))
    if v.kind == "token" and 0 <= v.at < len(found) and found[v.at].end(1) > found[v.at].start(1):
        m = found[v.at]
        text = m[1]
        at = m.start(1) + len(text) - len(text.lstrip("\r\n")) if text.strip() else m.start(1)
        return source.count("\n", 0, at) + 1, text.strip() or None
    return source.rstrip().count("\n") + 1, None


def flag(files: DataFrame, key: str = "file_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, lang, ok, kind, line_no, token) for every row with a language: kind is 'token' for a
    failing token, with its line and text, 'end' for a text that ends too early, with its last line;
    the three are null if the source is valid.

    Rows with a null language are left out; a null, empty or blank source is valid; unknown
    languages are valid. Columns other than the three named ones are not read.
    """
    df = files.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(source).alias("s")).filter("l is not null")
    schema = f"{key} {dict(files.dtypes)[key]}, lang string, ok boolean, kind string, line_no int, token string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [verdict(a, s if isinstance(s, str) else None) for a, s in zip(b["l"], b["s"], strict=True)]
            at = [(None, None) if v.ok else place(a, s, v) for a, s, v in zip(b["l"], b["s"], out, strict=True)]
            yield pd.DataFrame({key: b["k"], "lang": b["l"], "ok": [v.ok for v in out], "kind": [v.kind or None for v in out], "line_no": pd.array([x for x, _ in at], dtype="Int32"), "token": [t for _, t in at]})

    return df.mapInPandas(run, schema)
