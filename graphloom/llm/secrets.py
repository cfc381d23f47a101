"""Credentials in source text: unnatural strings by characters per subword, then rules of context.

A string that people would read costs few subwords of a public vocabulary for its length; a random
one costs many. Every string is judged by that ratio first, strictly where nothing else speaks for a
secret and less so where its place does: the name it is assigned to, the call or statement it is
passed to, the form of well-known tokens. Redaction replaces a secret's characters one by one, so
that offsets, lines and quotes stay as they are, and leaves what stands between the parts of a
secret alone.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import DEFAULT_VOCABULARY, Subwords, subwords

#: Characters per subword at or below which a string counts as unnatural.
UNNATURAL = 2.6
#: The same where the place of a string says that it's a secret. Words and names are above it.
UNUSUAL = 4.0
LEAST = 6

_STRONG = r"pass(?:wor[dt]|wd|phrase|code)?|pass_phrase|pwd|passw|contrase(?:n|ñ)a|kennwort|mot_?de_?passe|senha|parola|geheim|secret|wachtwoord|haslo"
_WEAK = r"token|api[-_.]?key|apikey|key|cred(?:ential)?s?|auth(?:orization)?|salt|seed|jwt|bearer|pat|signing|hmac|dsn|private|identity|hook|basic"
#: Fixed value: lower-case strings of which every line with a secret holds one.
_TRIGGERS = """pass pwd contrase kennwort motdepasse senha parola geheim secret wachtwoord haslo token key cred auth salt seed jwt
bearer signing hmac :// eyj _live_ ghp_ akia asia xox glpat aiza hook -prod- connect curl login identified basic sig= _pat cipat
tochararray dsn identity""".split()
_RUN = re.compile(r"(?=[A-Za-z+/_=.-]*\d)[\w+/=.-]{10,}|(?=[\d+/_=.-]*[A-Za-z])[\w+/=.-]{20,}")
_MARKED = re.compile(r"://|AKIA|ASIA|eyJ|gh[pousr]_|_live_|-prod-|xox|glpat|AIza|[\"'`]\s*\+\s*[\"'`]|toCharArray|getConnection|(?i:identified| as \w+ ?/|login|curl|basic |auth\w*\W*[(=])")
_STRONG_RX = re.compile(rf"(?i){_STRONG}")
_CHARS = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\")\s*\.\s*toCharArray\(\)")
_STR = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_KEYWORD = re.compile(rf"(?i){_STRONG}|{_WEAK}")
_NAME_RIGHT = re.compile(r"[\w.$-]*")
_VALUE = re.compile(rf"[\"']?\s*\]?\s*(?::\s*[\w<>\[\].]+\s*=(?!=)|:=|=>|=(?!=)|:|,|\()\s*(?:\w+\()?[bru]?(?P<v>{_STR})", re.IGNORECASE)
_EXPORT = re.compile(rf"(?i)\b(?:export|set|env|-e)\s+(?P<name>[\w.-]*(?:{_STRONG}|{_WEAK})[\w.-]*)=(?P<v>[^\s\"'`;]+)")
#: A variable set for one command.
_PREFIX = re.compile(r"(?<![\w.$-])(?P<name>[A-Z][A-Z0-9_]*(?:PASS|PASSWORD|PASSWD|PWD|SECRET|TOKEN|KEY))=(?P<v>[^\s\"'`;&|$<{%]+)[ \t]+[\w./-]")
_SETTING = re.compile(rf"(?i)^\s*(?:export\s+|-\s+)?[\"']?(?P<name>[\w.$-]*(?:{_STRONG}|{_WEAK})[\w.$-]*)[\"']?\s*[:=]\s*(?P<v>\S.*?)\s*$")
#: Names of things that are no secrets though they sound like them.
_NOT_NAME = re.compile(r"(?i)hash|digest|(?:^|[^a-z])sha\d*$|expected_?sha|md5|checksum|integrity|etag|fingerprint|label|hint|help|placeholder|alias|_?name$|param|prompt|message|title|text|public|pub_?key|trace|uuid|guid|request_?id|commit|revision|field|column|header_?name|regex|pattern|format|policy|rotation|length|(?:^|[^a-z])(?:min|max)_|error|url_?path|keyword|keyboard|primary|foreign|author|path$|file$|_id$|Id$|passenger|compass|bypass|passed|passing|passive|passage")
_PLACEHOLDER = re.compile(r"(?i)^(?:x{4,}|\*{3,}|\.{3,}|-+|_+|0{6,}|1234\d*|(?:your|my|the|some|an?)[-_ ].*|<.*>|\$\{?.*\}?|\{\{.*\}\}|\{[\w.]*\}|%.*%|%\(?\w+\)?s?|@.*@|enc\[.*\]|enc\(.*\)|vault:.*|secretsmanager:.*|arn:.*|change[-_ ]?(?:me|it|this).*|replace[-_ ]?(?:me|this|with).*|to[-_ ]?be[-_ ].*|todo.*|tbd|fixme.*|dummy.*|example.*|sample|test|testing|none|null|nil|undefined|true|false|empty|redacted|masked|hidden|removed|secret|password|passwd|token|default|insert.*|enter.*|fill.*|put.*|n/?a|\[.*\]|.*\.\.\.|\?+|!\w+ .*|ref\+.*|env[.:(].*|process\.env.*|os\.(?:environ|getenv).*|system\.getenv.*|getenv.*|.*(?:your|placeholder|redacted|x{6,}|\*{4,}|example\b).*)$")
_LOOKUP = re.compile(r"(?i)\$\{|\{\{|getenv|environ|process\.env|vault|secretsmanager|keychain|getpass|config\.|cfg\.|settings\.")
_TOKEN = re.compile(
    r"ghp_[A-Za-z0-9]{30,}|gh[ousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{18,}|(?:sk|rk|pk)_(?:live|test|prod)_[A-Za-z0-9]{16,}|(?:sk|pk|rk)-(?:prod|live|proj|ant)-[\w-]{16,}"
    r"|xox[abprs]-[\w-]{16,}|AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{40,}|EAACEdEose0cBA[A-Za-z0-9]+"
)
_AWS = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])")
_HOOK = re.compile(r"https?://(?:[\w-]*hooks?[\w-]*\.)[\w.-]+/(?:services/)?(?:[\w-]+/)*([\w-]{16,})|https?://[\w.-]+/(?:api/)?webhooks?/[\w-]+/([\w-]{16,})")
_USERINFO = re.compile(r"[a-zA-Z][\w+.:-]*://([^\s:/@\"'`]*):([^\s/@\"'`]+)@[\w\[$<{]")
_QUERY = re.compile(r"(?i)[?&;](?:password|passwd|pwd|pass|access_token|api_?key|apikey|token|secret|client_secret|sig|auth|key)=([^&\s\"'`;#<>]+)")
_BASIC = re.compile(r"(?i)\bbasic\s+([A-Za-z0-9+/_-]{8,}={0,2})")
_BEARER = re.compile(r"(?i)\bbearer\s+([\w.~+/-]{12,}=*)")
_SQLPASS = re.compile(r"(?i)\b(?:identified\s+(?:with\s+\w+\s+)?by|(?:encrypted\s+)?password|pwd)\s*=?\s*N?('(?:[^']|'')*')")
_PAIR = re.compile(rf"(?i)['\"][\w.-]*(?:{_STRONG}|api[-_.]?key|token)[\w.-]*['\"]\s*,\s*({_STR})")
_CALL = re.compile(rf"(?i)(?:getConnection|connect|login|authenticate|auth|creds?|credentials?|\w*creds?)\s*(?:=\s*)?\(([^()\n]*)\)")
_EVENT = re.compile(rf"(?i)[\"'](?:login|log_in|signin|sign_in|auth|authenticate)[\"']\s*,\s*(?:{_STR})\s*,\s*({_STR})")
_HEADER = re.compile(r"(?i)\b(?:x-)?(?:[\w]+-)*(?:token|api-?key|secret|auth)\b\s*:\s*(?!Basic|Bearer)([\w.+/=-]{12,})")
_CURL = re.compile(r"(?i)\bcurl\b.*?\s(?:-u|--user)[ =]?['\"]?([\w.@-]+):([^\s'\"]+)")
_SAID = re.compile(rf"(?i)\b(?:\w+[-_ ])?(?:{_STRONG}|api[- ]?key|token|key)\b\s*(?:is|was|are|=|:|->)\s+[\"'`]?([^\s\"'`]{{6,}})")
_SLASHED = re.compile(r"(?i)\b(?:as|user|login|account|with|under)\s+[\w.@-]+\s*/\s*([^\s\"'`]{6,})")
_JOIN = re.compile(r"([\"'`])\s*(?:\+|\.)\s*[\"'`]")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: From a key's header to its first part.
_PEM_GAP = re.compile(r"PRIVATE KEY(?: BLOCK)?-----(?:\\[nrt]|[^\w\\]|(?:Proc-Type|DEK-Info|Version|Comment|Hash): [^\n\\]*)*")
#: A run of base64: a long one anywhere, a short one only alone between quotes or on its line.
_PEM_PART = re.compile(r"(?:(?<=\\n)|(?<=\\r)|(?<![\w.\\+/]))(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{1,15}={0,2}(?=[\"'`\\]|[ \t,;]*(?:\r?\n|\Z)))(?![\w:(])")
#: Code after a key that has no end.
_PEM_BREAK = re.compile(r"[(){}=:<>]|\b(?:def|class|function|public|private|static|return|import|const|let|var)\b")
_HASHES = re.compile(r"^(?:\$2[abxy]?\$|\$argon2|\$pbkdf2|\$[156]\$|\{SSHA|pbkdf2_|scrypt:|sha\d+[-:$]|md5[-:]|bcrypt)")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
#: A weak word as a whole word of a name, in snake, kebab or camel case.
_WEAK_NAME = re.compile(r"(?:^|[^A-Za-z])(?i:"+_WEAK+r")s?(?:$|[^A-Za-z]|(?<=[a-z])(?=[A-Z]))|(?:Key|Token|Pat|Seed|Jwt|Salt|Identity|Auth|Hook|Creds?|Dsn|Bearer|Basic)s?(?:$|[^a-z])|^(?:key|token|pat|seed|jwt|salt|auth|creds?|hook)(?=[A-Z]|$)|apikey|APIKEY")


class Finder:
    """Finds secrets in one text."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        self.words: Subwords = subwords(vocabulary)

    def ratio(self, s: str) -> float:
        """Characters per subword."""
        return len(s) / max(1, self.words.count(s))

    def unnatural(self, s: str) -> bool:
        return len(s) >= 10 and " " not in s and self.ratio(s) <= UNNATURAL

    @staticmethod
    def placeholder(v: str) -> bool:
        return bool(_PLACEHOLDER.match(v)) or len(set(v)) <= 3

    def _plain(self, v: str) -> bool:
        """Could ``v`` be a value somebody logs in with?"""
        if len(v) < LEAST or self.placeholder(v) or _LOOKUP.search(v) or _HASHES.match(v):
            return False
        return " " not in v.strip() and self.ratio(v) <= UNUSUAL

    def password_like(self, v: str) -> bool:
        if not self._plain(v):
            return False
        if re.fullmatch(r"[\w./:-]*/[\w./:-]+", v) and not self.unnatural(v):
            return False  # a path
        kinds = bool(re.search(r"[a-z]", v)) + bool(re.search(r"[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^\w\s]", v))
        if re.fullmatch(r"[\w-]*[#.>\[][\w-]*(?:\])?", v) and not re.search(r"\d", v) and not self.unnatural(v):
            return False  # a selector or dotted name
        return (bool(re.search(r"\d", v)) and kinds >= 2) or self.unnatural(v) or kinds == 4 or (kinds == 3 and bool(re.search(r"[!$%^&*+=?@]", v)))

    def token_like(self, v: str) -> bool:
        return self._plain(v) and self.unnatural(v) and not _UUID.match(v) and bool(re.search(r"\d|[A-Z].*[a-z].*[A-Z]", v))

    def _named(self, name: str, value: str) -> bool:
        if _NOT_NAME.search(name):
            return False
        if not _STRONG_RX.search(name):
            if not _WEAK_NAME.search(name):
                return False
            return self.token_like(value)
        return self.password_like(value)

    def _line(self, line: str, settings: bool) -> list[tuple[int, int]]:
        """Spans of secrets within a line (in the joined form of string concatenations: the line itself)."""
        out: list[tuple[int, int]] = []

        def add(m: re.Match, g: int | str, quoted: bool = False) -> None:
            a, b = m.span(g)
            out.append((a + 1, b - 1) if quoted else (a, b))

        low = line.lower()
        quoted = "'" in line or '"' in line or "`" in line
        if _RUN.search(line):
            for m in _TOKEN.finditer(line):
                if self.ratio(m[0]) <= UNUSUAL and not self.placeholder(m[0]) and not re.search(r"x{6,}|X{6,}", m[0]) and len(set(m[0])) > 8:
                    add(m, 0)
            if "basic" in low:
                for m in _BASIC.finditer(line):
                    if self._basic(m[1]) or self.token_like(m[1]):
                        add(m, 1)
            if "bearer" in low:
                for m in _BEARER.finditer(line):
                    if self.token_like(m[1]):
                        add(m, 1)
            for m in _HEADER.finditer(line):
                if self.token_like(m[1]):
                    add(m, 1)
        if "://" in line:
            for m in _HOOK.finditer(line):
                g = 1 if m[1] else 2
                if self.unnatural(m[g]) and not self.placeholder(m[g]):
                    add(m, g)
            if "@" in line:
                for m in _USERINFO.finditer(line):
                    if self._plain(m[2]) and not re.match(r"[$<{%]", m[2]):
                        add(m, 2)
        if "=" in line and ("?" in line or "&" in line or ";" in line):
            for m in _QUERY.finditer(line):
                if self._plain(m[1]) and not re.match(r"[$<{%+]", m[1]) and (self.unnatural(m[1]) or self.password_like(m[1])):
                    add(m, 1)
        if "'" in line and ("identified" in low or "password" in low or "pwd" in low):
            for m in _SQLPASS.finditer(line):
                if self.password_like(m[1][1:-1]):
                    add(m, 1, True)
        if quoted:
            if "," in line:
                for m in _PAIR.finditer(line):
                    if self.password_like(m[1][1:-1]) and not _NOT_NAME.search(line[m.start() : m.start(1)]):
                        add(m, 1, True)
                for m in _EVENT.finditer(line):
                    if self.password_like(m[1][1:-1]):
                        add(m, 1, True)
                for m in _CALL.finditer(line):
                    self._call(m, out)
            for k in _KEYWORD.finditer(line):
                m = _VALUE.match(line, _NAME_RIGHT.match(line, k.end()).end())
                if m:
                    left = k.start()
                    while left and (line[left - 1].isalnum() or line[left - 1] in "_.$-"):
                        left -= 1
                    name = line[left : _NAME_RIGHT.match(line, k.end()).end()]
                    if self._named(name, m["v"][1:-1]):
                        add(m, "v", True)
            if _AWS.search(line):
                for m in re.finditer(_STR, line):
                    if len(m[0]) >= 32 and self.token_like(m[0][1:-1]):
                        add(m, 0, True)
            if "toCharArray" in line:
                for m in _CHARS.finditer(line):
                    if self.password_like(m[1][1:-1]):
                        add(m, 1, True)
        if settings and (m := _SETTING.match(line)):
            v = m["v"].strip("\"'")
            if self._named(m["name"], v):
                a = m.start("v") + (m["v"][:1] in "\"'")
                out.append((a, a + len(v)))
        for rx in (_EXPORT, _PREFIX) if "=" in line else ():
            for m in rx.finditer(line):
                if self._named(m["name"], m["v"]):
                    add(m, "v")
        if "curl" in low:
            for m in _CURL.finditer(line):
                if self._plain(m[2]) and not re.match(r"[$<{]", m[2]):
                    add(m, 2)
        for rx in (_SAID, _SLASHED):
            for m in rx.finditer(line):
                v = m[1].rstrip(",.;:)")
                if re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and self.password_like(v) and not re.search(r"[(){}\[\]<>]|[a-z]\.[a-z]", v) and not _NOT_NAME.search(m[0][: m.start(1) - m.start()]):
                    out.append((m.start(1), m.start(1) + len(v)))
        return out

    def _basic(self, coded: str) -> bool:
        try:
            plain = base64.b64decode(coded + "=" * (-len(coded) % 4), validate=False).decode()
        except (binascii.Error, ValueError):
            return False
        return bool(re.fullmatch(r"[\x20-\x7e]+:[\x20-\x7e]{4,}", plain)) and not self.placeholder(plain.split(":", 1)[1]) and self.ratio(coded) <= UNUSUAL

    def _call(self, m: re.Match, out: list[tuple[int, int]]) -> None:
        strings = list(re.finditer(_STR, m[1]))
        if not strings or "," not in m[1]:
            return
        v = strings[-1][0][1:-1]
        named = re.match(r"(?i)getConnection|login|auth", m[0]) and self.password_like(v)
        if named or self.token_like(v) or (_AWS.search(m[1]) and self._plain(v) and len(v) >= 30):
            a = m.start(1) + strings[-1].start()
            out.append((a + 1, a + len(strings[-1][0]) - 1))

    def _joined(self, line: str, settings: bool) -> bool:
        """Does a secret appear once concatenated strings are put together?"""
        return bool(_JOIN.search(line)) and bool(self._line(_JOIN.sub("", line), settings))

    @staticmethod
    def _lines(text: str) -> list[int]:
        """Starts of the lines worth a look, in order."""
        low = text.lower()
        if len(low) != len(text):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        starts: set[int] = set()
        for t in _TRIGGERS:
            at = low.find(t)
            while at >= 0:
                starts.add(low.rfind("\n", 0, at) + 1)
                at = low.find("\n", at)
                at = low.find(t, at) if at >= 0 else -1
        starts |= {low.rfind("\n", 0, m.start()) + 1 for m in _JOIN.finditer(text)}
        return sorted(starts)

    def _key(self, text: str, begin: int) -> list[tuple[int, int]]:
        """The parts of a private key whose header ends at ``begin``; none if there is no key. What
        joins them (quotes, commas, line breaks, comment marks) belongs to the code around. A key
        without an end ends with its last line of such parts."""
        end = _PEM_END.search(text, begin)
        other = _PEM.search(text, begin)
        closed = end is not None and (other is None or end.start() < other.start())
        parts, at = [], begin
        for m in _PEM_PART.finditer(text, begin, end.start() if closed else other.start() if other else len(text)):
            if not closed and (text.count("\n", at, m.start()) > 2 or _PEM_BREAK.search(text, at, m.start()) or (len(m[0]) < 16 and not (parts and "=" in m[0]))):
                break
            parts.append(m.span())
            at = m.end()
        whole = "".join(text[a:b] for a, b in parts)
        return parts if len(whole) >= 40 and len(set(whole)) > 12 and self.ratio(whole) <= UNUSUAL else []

    def find(self, text: str | None, settings: bool = False) -> list[tuple[int, int, int]]:
        """(line from 1, start, end) of each secret, by position. A secret put together from several
        strings on its line has a span for each, the first of them with the line, the others with 0."""
        if not text:
            return []
        breaks = [m.end() for m in re.finditer("\n", text)]
        out: list[tuple[int, int, int]] = []
        pem: list[tuple[int, int]] = []
        for m in _PEM.finditer(text) if "PRIVATE KEY" in text else ():
            parts = self._key(text, m.end())
            if parts:
                no = bisect_right(breaks, m.start()) + 1
                out.append((no, parts[0][0], parts[-1][1]))
                pem.append((m.start(), parts[-1][1]))
        for a in self._lines(text):
            b = text.find("\n", a)
            b = len(text) if b < 0 else b
            if any(s < b and a < e for s, e in pem):
                continue
            line = text[a:b]
            if not _MARKED.search(line) and not _STRONG_RX.search(line) and not _RUN.search(line):
                continue
            spans = self._line(line, settings)
            no = bisect_right(breaks, a) + 1
            out += [(no, a + s, a + e) for s, e in spans]
            if not spans and self._joined(line, settings):
                out += [(0 if i else no, a + s.start() + 1, a + s.end() - 1) for i, s in enumerate(x for x in re.finditer(_STR, line) if x.end() - x.start() > 2)]
        return sorted(set(out), key=lambda x: (x[1], x[2]))


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """``text`` with the letters and digits of each span replaced by '*'; everything else keeps its
    place, so line ends, quotes and escapes inside a span stay. Of a private key only the runs of
    base64 are masked: commas, plus signs and comment marks between its strings are code."""
    if text is None:
        return None
    out, at = [], 0
    for _, a, b in spans:
        a = max(a, at)
        if b <= a:
            continue
        head = text.rfind("PRIVATE KEY", 0, a)
        if head >= 0 and _PEM_GAP.fullmatch(text, head, a):
            for m in _PEM_PART.finditer(text, a, b):
                out += [text[at : m.start()], "*" * len(m[0])]
                at = m.end()
        else:
            out += [text[at:a], re.sub(r"\\[nrt]|[^\s\"'`+\\]", lambda m: m[0] if m[0][0] == "\\" else "*", text[a:b])]
            at = b
    return "".join(out) + text[at:]


def find(files: DataFrame, key: str = "file_id", source: str = "source", lang: str = "lang", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, line_no): the lines on which a secret begins, each once. Rows with a null language are
    read as settings files; null and empty sources have none."""
    df = files.select(F.col(key).alias("k"), F.col(lang).isNull().alias("c"), F.col(source).alias("s")).filter("s is not null and s <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Finder(vocabulary)
        for b in batches:
            rows = [(k, no) for k, c, s in zip(b["k"], b["c"], b["s"], strict=True) for no in dict.fromkeys(x[0] for x in f.find(s, c) if x[0])]
            yield pd.DataFrame(rows, columns=[key, "line_no"])

    return df.mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, line_no int")


def redacted(files: DataFrame, key: str = "file_id", source: str = "source", lang: str = "lang", vocabulary: str = DEFAULT_VOCABULARY, keep: bool = False) -> DataFrame:
    """(key, n_secrets, source) of every row, secrets masked in place; null sources stay null.
    ``keep`` adds the language and the source as it was, as ``original``."""
    df = files.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(source).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Finder(vocabulary)
        for b in batches:
            texts = [s if isinstance(s, str) else None for s in b["s"]]
            found = [f.find(s, not isinstance(lg, str)) for lg, s in zip(b["l"], texts, strict=True)]
            out = {key: b["k"], "n_secrets": [sum(1 for y in x if y[0]) for x in found], source: [redact(s, x) for s, x in zip(texts, found, strict=True)]}
            yield pd.DataFrame(out | ({lang: b["l"], "original": texts} if keep else {}))

    return df.mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, n_secrets int, {source} string" + (f", {lang} string, original string" if keep else ""))
