"""Functions paired with their documentation.

``extract`` works on source files: signatures by regular expression, bodies by a stack of
indentations, braces or begin and end keywords, and the comment whose lines lie next to the
signature. ``telling`` judges a piece of documentation: it must say something beyond the function's
name and its parameters' names. ``documented`` finds the nodes of the functions so extracted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: words that carry no statement of their own beside a name.
_FILLER = frozenset("""a an the this that these those it its is are be was were to of for and or by on in at with from as into
method function func procedure constructor getter setter class object instance value values does do did done perform performs
used use uses given specified passed param params parameter parameters arg args argument arguments return returns returned
returning result results raises throws exception type self cls none null void true false todo fixme xxx hack wip
der die das ein eine el la los las un una le les une des du de funktion methode función método fonction méthode""".split())
#: Fixed value: sentences that only remark that text is missing, or point elsewhere.
_NOTHING = re.compile(
    r"""(?ix)^(?:
    (?:\W*)(?:todo|fixme|xxx|tbd|tba|tbc|wip|n/?a|hack|none|null|nil|noop|placeholder|docs?|doc\s?strings?|javadocs?|jsdoc|comments?(?:\s+me)?|summary|description|desc|overview|details?|notes?|readme|lorem\s+ipsum.*)(?:\W*)
    |(?:todo|fixme|xxx|hack|wip|tbd)\b.*
    |(?:-+\s*)?no\s+(?:docs?|documentation|description|comments?|text|doc\s?strings?|details)\b.*
    |(?:un|not\s+(?:yet\s+)?)documented(?:\s+yet)?|to\s+be\s+(?:documented|done|written|added|completed|defined|determined|described|filled.*)|needs?\s+(?:docs?|documentation|description|comments?)\b.*
    |(?:missing|add|write|insert|fill\s+in|enter|put|provide|pending|empty|incomplete)\s+(?:the\s+|a\s+|some\s+|your\s+)?(?:docs?|documentation|description|comments?|javadoc|doc\s?strings?|text|summary)\b.*
    |(?:docs?|documentation|description|comments?|javadoc|doc\s?strings?|text|summary)\s+(?:is\s+|are\s+)?(?:pending|missing|needed|required|todo|tbd|goes?\s+here|here|to\s+(?:follow|come|be\s+added)|follows?|coming\s+soon|not\s+(?:available|provided|yet.*)|unavailable)\b.*
    |(?:description|summary|documentation|comment|docs?)\s+(?:of|for)\s+(?:the\s+|this\s+)?(?:method|function|class|constructor|parameters?)
    |(?:\W*)(?:auto[- ]?generated|generated)\s+(?:by\s+.*|method|function|constructor|code|stub|javadoc|doc|comment|documentation|catch\s+block|getter|setter)\b.*|(?:method|function)\s+stub
    |(?:see|siehe|cf\.?|voir|véase|ver|refer\s+to|as|same\s+as|compare|vgl\.?)\s+(?:also\s+)?(?:the\s+)?(?:above|below|super(?:class)?|parent|base|interface|there|other|oben|unten|ci-dessus|arriba|overridden|docs?|documentation|wiki|ticket|link|javadoc|specification|spec|readme)\b.*
    |(?:see|siehe|voir|véase|ver|cf\.?|refer\s+to|same\s+as)\s+[\w.\#()/:-]+
    |(?:docs?\s+)?inherit(?:s|ed)?(?:\s+(?:docs?|documentation|javadoc|from\b.*))?|overrides?(?:\s+(?:method|super|parent).*)?|overridden.*|deprecated|non-?javadoc
    |(?:keine|ohne)\s+(?:beschreibung|dokumentation|kommentar|angabe)\b.*|(?:beschreibung|dokumentation|doku|kommentar|text|erklärung)\s+(?:folgt|fehlt|ausstehend|noch\s+offen)\b.*|noch\s+(?:zu\s+)?(?:dokumentieren|offen|undokumentiert).*|nicht\s+dokumentiert|undokumentiert
    |(?:sin|falta(?:\s+la)?|pendiente(?:\s+de)?|agregar|añadir)\s+(?:descripci[oó]n|documentaci[oó]n|documentar|comentarios?)\b.*|(?:descripci[oó]n|documentaci[oó]n)\s+(?:pendiente|faltante)|por\s+documentar|pendiente
    |(?:sans|pas\s+de|aucune?|ajouter(?:\s+une)?)\s+(?:description|documentation|commentaires?)\b.*|(?:description|documentation)\s+(?:à\s+(?:venir|compléter|faire)|manquante)|à\s+(?:documenter|compléter|faire)|non\s+documenté.*
    |(?:sem|senza)\s+(?:descri|document|comment).*|da\s+documentare|nessuna\s+descrizione
    |説明(?:なし|無し|未記入|を追加|は後で)?|未記入|未定|ドキュメント(?:なし|未作成)|要(?:説明|記述)|todo|なし|無し|暂无.*|待补充|无|无描述|описание\s+отсутствует|нет\s+описания
    )$"""
)
_BOILER = re.compile(r"(?i)copyright|\(c\)\s*\d{4}|©|all rights reserved|licen[sc]ed? (?:under|to)|spdx-|use of this source code|governed by|under the terms|@licen[sc]e|permission is hereby|without warranty|as is\b.*warrant|(?:^|\s)(?:apache|mit|bsd|gpl|mpl) licen[sc]e|redistribution and use")
#: Tags whose whole text is authorship, dates or pointers.
_DROP_TAG = re.compile(r"(?i)^[@\\:](?:author|authors|since|version|date|created|modified|changed|see|link|linkplain|copyright|license|licence|serial\w*|file|package|module|namespace|memberof|class|name|function|method|public|private|protected|static|abstract|final|override|overrides|inheritdoc|internal|hidden|ignore|todo|fixme|generated|access|api|category|group|ingroup|param-type|type|rtype|async|constructor|implements|extends|augments|exports|template|typedef|suppress\w*|category|tags?|revision|history|maintainer|credits?|contributors?)\b")
_PARAM_TAG = re.compile(r"(?i)^[@\\:](?:param|parameter|arg|argument|property|prop|tparam|keyword|key|kwarg)\b\s*(?:\[[\w,\s]*\])?\s*(?:\{[^}]*\})?\s*(?:(?:[\w<>\[\].]+\s+)?([\w$.\[\]=*]+))?\s*:?\s*[-–—:]?\s*")
_OTHER_TAG = re.compile(r"(?i)^[@\\:](?:returns?|result|throws?|exception|raises?|yields?|deprecated|example|code|note|remarks?|brief|short|details?|summary|description|desc|pre|post|warning|attention|implnote|implspec|apinote)\b\s*(?:\{[^}]*\})?\s*:?\s*")
_SECTION = re.compile(r"(?i)^(?:args|arguments|parameters|params|attributes|returns?|raises|yields?|throws|see also|references|notes?|examples?|keyword args|other parameters|parameter|rückgabe|retour|retorna)\s*:?\s*$")
_AUTHORSHIP = re.compile(r"(?i)^(?:author|authors|created|written|modified|changed|updated|last (?:modified|changed|updated)|date|since|version|maintainer|maintained|contributed|reviewed|revision|history|autor|erstellt|creado|créé|stand|ersteller|datum|fecha)s?(?:\s*[:=]|\s+(?:by|on|at|in|von|am|por|par|el|le|with)\b)|^\$(?:id|author|date|revision|header)\b|^(?:jira|ticket|issue|bug|pr|cr|refs?|fixes|closes)\b[\s:#-]*[\w-]*\d+\W*$|^https?://\S+$|^\d{4}[-/.]\d\d?[-/.]\d\d?\W*$|^[\w.+-]+@[\w.-]+$|^v?\d+(?:\.\d+)+\W*$")
_SELF_NAMED = re.compile(r"([\w$]+)\s*(?:\([^)]*\))?\s*:\s*(?:the\s+)?\1?\.?$")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")
_INLINE = re.compile(r"\{@(?:inheritDoc|see|link|linkplain)\b[^}]*\}|@inheritDoc\b|\(non-Javadoc\)|<[/]?(?:p|br|pre|code|b|i|em|strong|ul|li|ol|tt|see\b[^>]*|summary|para|inheritdoc)\s*/?>|\[(?:description|summary|todo|docs?|documentation|text|comment|tbd|placeholder)\]", re.IGNORECASE)
_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!\*)|//+[!/]?|#+!?|--+|;+|\"\"\"|'''|<!--|%+)?\s*|\s*(?:\*+/|\"\"\"|'''|-->)\s*$")
_EDGE = frozenset("/*#-;\"'<%>")


@lru_cache(maxsize=50_000)
def stem(w: str) -> str:
    """A word without the endings that verbs and nouns take in a sentence about them."""
    w = w.lower()
    for end, put in (("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z")):
        if w.endswith(end) and len(w) > len(end) + 1:
            return _short(w[: -len(end)] + put)
    if w.endswith("s") and not w.endswith("ss") and len(w) > 2:
        w = w[:-1] if not (w.endswith("sss")) else w
    if w.endswith("ss") and len(w) <= 4:
        w = w.rstrip("s") + "s"
    return _short(w)


def _short(w: str) -> str:
    for end in ("ing", "ed", "er", "or", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "sl":
                w = w[:-1]
            break
    return w


def words_of(*names: str | None) -> set[str]:
    """Stems of the words that identifiers are made of, whole identifiers included."""
    out: set[str] = set()
    for n in names:
        if n:
            for ident in re.findall(r"[\w$]+", n):
                out.add(ident.lower())
                out |= {stem(w) for w in _CAMEL.findall(ident)}
    return out


def clean(doc: str) -> list[str]:
    """Lines of a documentation comment without comment marks."""
    out = []
    for line in (doc.split("\n") if "\r" not in doc else re.split(r"\r\n?|\n", doc)):
        line = line.strip()
        for _ in range(3):
            if not line or (line[0] not in _EDGE and line[-1] not in _EDGE):
                break
            new = _MARKS.sub("", line)
            if new == line:
                break
            line = new
        out.append(line.strip())
    return out


def remainder(doc: str | None, name: str | None, signature: str | None, first_only: bool = False) -> list[str]:
    """The words of ``doc`` that say something: not the function's or parameters' names, filler,
    authorship, dates, licences, pointers elsewhere or remarks that text is missing."""
    if not doc or not doc.strip():
        return []
    known = words_of(name, signature)
    text: list[str] = []
    inline = any(c in doc for c in "{@(<[")
    skipping = False
    for line in clean(doc):
        if inline:
            line = _INLINE.sub(" ", line).strip()
        if not line:
            skipping = False
            text.append("")
            continue
        if line[0] in "@\\:" and re.match(r"[@\\:]\w", line):
            skipping = False
            if m := _PARAM_TAG.match(line):
                known |= words_of(m[1])
                line = line[m.end() :]
            elif m := _OTHER_TAG.match(line):
                line = line[m.end() :]
            elif _DROP_TAG.match(line):
                skipping = True
                continue
            text.append("")
        elif skipping:
            continue
        if m := _SELF_NAMED.match(line):
            known |= words_of(m[1])
        if _BOILER.search(line) or _AUTHORSHIP.match(line) or _SECTION.match(line):
            text.append("")
            continue
        text.append(line)
    found: list[str] = []
    joined = "\n".join(text)
    for part in re.split(r"\n\s*\n|(?<=[.!?;])\s+|(?<=[。！？；])|\n(?=\s*[\w*]+\s*(?:\([^)]*\))?\s*:)", joined):
        part = part.strip().strip("-=*#~_ \t\n\"'`")
        if not part:
            continue
        bare = part.rstrip(".!?:;。 ").strip("[](){}<>-=*~_\"'` \n")
        if not bare or _NOTHING.match(" ".join(bare.split())):
            continue
        part = re.sub(r"(?i)^deprecated\b[.:]?\s*", "", part)
        for w in _WORD.findall(part):
            if w.isdigit():
                continue
            low = w.lower()
            if low in _FILLER or low in known:
                continue
            if w.isascii():
                if len(w) == 1 and "(" not in part:
                    continue
                if all(stem(x) in known or x.lower() in _FILLER for x in _CAMEL.findall(w)):
                    continue
            found.append(w)
            if first_only:
                return found
    return found


def telling(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Does the documentation say something about the function? Null and blank documentation doesn't."""
    return bool(remainder(doc, name, signature, True))


# extraction from source files


@dataclass(frozen=True)
class Found:
    name: str
    fqn: str
    signature: str
    docstring: str | None
    start_line: int
    end_line: int


_PY_DEF = re.compile(r"^([ \t]*)(async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)[ \t]*")
_JAVA_SIG = re.compile(r"^[ \t]*(?:@[\w.]+(?:\([^)\n]*\))?[ \t]+)*((?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^>\n]+>[ \t]+)?(?:[\w$.]+(?:<[^;{}()\n]*>)?(?:\[\])*[ \t]+)?([\w$]+)[ \t]*\(([^;{}]*?)\)(?:[ \t\r\n]*throws[ \t\r\n]+[\w.,<> \t\r\n]+)?)[ \t\r\n]*([{;])", re.MULTILINE)
_JS_SIG = re.compile(r"^[ \t]*((?:(?:export|default|public|private|protected|static|readonly|abstract|override|declare|async)[ \t]+)*(?:function[ \t]*\*?[ \t]*|get[ \t]+|set[ \t]+|\*[ \t]*)?([\w$#]+)[ \t]*(?:<[^(){}\n]*>)?\(([^;{}]*?(?:\{[^{}]*\}[^;{}]*?)*)\)(?:[ \t]*:[ \t]*[^;{}=\n]+)?)[ \t\r\n]*\{|^[ \t]*((?:export[ \t]+)?(?:const|let|var)[ \t]+([\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^;{}]*?\)|[\w$]+)(?:[ \t]*:[^={}\n]+)?[ \t]*=>)[ \t\r\n]*\{", re.MULTILINE)
#: A declaration without a body, with the type it returns.
_TS_DECLARED = re.compile(r"^[ \t]*((?:(?:export|declare|public|private|protected|abstract|static|readonly|function)[ \t]+)*([\w$]+)\??[ \t]*(?:<[^(){}\n]*>)?\(([^;{}]*?(?:\{[^{}]*\}[^;{}]*?)*)\)[ \t]*:[ \t]*[^;{}=\n]+);", re.MULTILINE)
_CLASS = re.compile(r"^[ \t]*(?:@\w+(?:\([^)\n]*\))?[ \t]+)*(?:(?:public|protected|private|static|final|abstract|sealed|export|default|declare|strictfp)[ \t]+)*(?:class|interface|enum|record|@interface|namespace)[ \t]+([\w$]+)", re.MULTILINE)
_NOT_FUNCTIONS = frozenset("if for while switch catch synchronized return new else do try throw assert super this function with".split())
_BLANKS = re.compile(r"\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|//[^\n]*|/\*[\s\S]*?\*/")


#: In scripts a slash after an operator starts a regular expression, which may hold quotes and braces.
_SCRIPT_BLANKS = re.compile(_BLANKS.pattern + r"|(?<=[=(,:\[!&|?;])[ \t]*/(?![*/ ])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def _masked(source: str, lang: str = "java") -> str:
    """Strings and comments blanked out, offsets and lines kept."""
    return (_BLANKS if lang == "java" else _SCRIPT_BLANKS).sub(lambda m: re.sub(r"[^\n\r]", " ", m[0]), source)


def _comments(source: str) -> dict[int, tuple[int, str]]:
    """Last line of each block or run of line comments -> (first line, text)."""
    out: dict[int, tuple[int, str]] = {}
    for m in re.finditer(r"/\*[\s\S]*?\*/|(?:^[ \t]*//[^\n]*(?:\n|\Z))+", source, re.MULTILINE):
        first = source.count("\n", 0, m.start()) + 1
        text = m[0].rstrip("\n")
        out[first + text.count("\n")] = (first, text)
    return out


def _braced(source: str, lang: str) -> list[Found]:
    flat = _masked(source, lang)
    line_of = lambda p: source.count("\n", 0, p) + 1
    ends: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", flat):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.start()
    scopes: list[tuple[int, int, str]] = []
    for m in _CLASS.finditer(flat):
        b = flat.find("{", m.end())
        if b >= 0:
            scopes.append((b, ends.get(b, len(flat)), m[1]))
    pkg = re.search(r"^\s*package\s+([\w.]+)\s*;", flat, re.MULTILINE)
    notes = _comments(source)
    lines = source.split("\n")
    out = []
    found = list((_JAVA_SIG if lang == "java" else _JS_SIG).finditer(flat))
    if lang == "typescript":
        found = sorted([*found, *_TS_DECLARED.finditer(flat)], key=lambda m: m.start())
    for m in found:
        if m.re is _TS_DECLARED:
            sig, name, stop = source[m.start(1) : m.end(1)], m[2], m.end()
        elif lang == "java":
            sig, name, opener = source[m.start(1) : m.end(1)], m[2], m.end() - 1
            stop = ends.get(opener, len(flat)) if m[4] == "{" else m.end()
            # a call ends in ';' too; a declaration has a type before its name
            if m[4] == ";" and not re.match(r"(?:[\w$.<>,\[\]?]+\s+)+[\w$]+\s*\(", m[1]):
                continue
        else:
            g = 1 if m[2] else 4
            sig, name, opener = source[m.start(g) : m.end(g)], m[2] or m[5], m.end() - 1
            stop = ends.get(opener, len(flat))
        if name in _NOT_FUNCTIONS or re.match(r"\s*(?:return|new|else|throw|await|yield)\b", m[0]):
            continue
        first = line_of(m.start() + len(m[0]) - len(m[0].lstrip()))
        # the comment right above, over annotations and decorators; at most one blank line between
        at = first - 1
        while at >= 1 and re.match(r"\s*@\w", lines[at - 1]):
            at -= 1
        if at >= 1 and not lines[at - 1].strip():
            at -= 1
        doc = notes[at][1] if at in notes else None
        owner = [n for b, e, n in scopes if b < m.start() < e]
        fqn = ".".join([*([pkg[1]] if pkg else []), *owner]) + ("#" if owner else "") + name
        out.append(Found(name, fqn, " ".join(sig.split()), doc, first, line_of(min(stop, len(source) - 1))))
    return out


_PY_DOC = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*[rRuU]?(\"\"\"|''')([\s\S]*?)\1|(?:[ \t]*\n)*[ \t]*[rRuU]?([\"'])([^\n]*?)\3[ \t]*(?:\n|\Z)")


def _indented(source: str) -> list[Found]:
    whole = source.replace("\r\n", "\n").replace("\r", "\n")
    lines = whole.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    out: list[Found] = []
    scope: list[tuple[int, str]] = []  # (indent, name)
    open_defs: list[tuple[int, dict]] = []
    last = 0
    i = 0
    inside: str | None = None
    while i < len(lines):
        line = lines[i]
        if inside is None and line.strip() and not line.lstrip().startswith("#"):
            indent = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
            while scope and scope[-1][0] >= indent:
                scope.pop()
            while open_defs and open_defs[-1][0] >= indent:
                _, d = open_defs.pop()
                out.append(Found(**d, end_line=last))
            m = _PY_DEF.match(line)
            if m and m[3] == "class":
                scope.append((indent, m[4]))
            elif m:
                j, sig, depth = i, "", 0
                while j < len(lines):
                    part = re.sub(r"#.*$", "", lines[j])
                    depth += sum(part.count(c) for c in "([{") - sum(part.count(c) for c in ")]}")
                    sig += " " + part.strip()
                    if depth <= 0:
                        break
                    j += 1
                name = ".".join([n for _, n in scope] + [m[4]])
                text = re.sub(r"^\s*(?:async\s+)?def\s+", "", sig).strip()
                text = text[: text.rfind(":")] if ":" in text else text
                doc = None
                d = _PY_DOC.match(whole, starts[min(j + 1, len(lines))])
                if d:
                    doc = d[2] if d[2] is not None else d[4]
                else:
                    k = i - 1
                    while k >= 0 and lines[k].lstrip().startswith("@"):
                        k -= 1
                    above = []
                    while k >= 0 and lines[k].lstrip().startswith("#"):
                        above.insert(0, lines[k])
                        k -= 1
                    doc = "\n".join(above) or None
                open_defs.append((indent, {"name": m[4], "fqn": name, "signature": text, "docstring": doc, "start_line": i + 1}))
                scope.append((indent, m[4]))
                i = j
                line = lines[min(j, len(lines) - 1)]
        # triple-quoted text neither opens nor closes scopes
        comment = inside is None and line.lstrip().startswith("#")
        at = 0
        while True:
            if inside is None:
                q = re.search(r"#|\"\"\"|'''|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", line[at:])
                if not q or q[0] == "#":
                    break
                at += q.end()
                if q[0] in ('"""', "'''"):
                    inside = q[0]
            else:
                k = line.find(inside, at)
                if k < 0:
                    break
                at, inside = k + 3, None
        if line.strip() and not comment:
            last = i + 1
        i += 1
    while open_defs:
        _, d = open_defs.pop()
        out.append(Found(**d, end_line=last))
    return sorted(out, key=lambda f: f.start_line)


_SQL_SIG = re.compile(r"^[ \t]*CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+((?:[\w\"`]+\.)*([\w\"`]+)\s*\(([^;]*?)\)(?:\s*RETURNS\s+[\w.\[\]()]+)?)", re.IGNORECASE | re.MULTILINE)
_SQL_WORD = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*[\s\S]*?\*/|\$(\w*)\$[\s\S]*?\$\1\$|\b(BEGIN|CASE|LOOP|END(?:\s+(?:IF|LOOP|CASE|WHILE|REPEAT))?|IF|WHILE|REPEAT)\b|(;)", re.IGNORECASE)


def _keyworded(source: str) -> list[Found]:
    """Functions and procedures of SQL. A body is quoted by dollars, or runs from its first keyword
    that opens a block to the END of it; without either it ends with the statement."""
    lines = source.split("\n")
    line_of = lambda p: source.count("\n", 0, p) + 1
    out = []
    for m in _SQL_SIG.finditer(source):
        stack, stop = 0, len(source)
        for w in _SQL_WORD.finditer(source, m.end()):
            word = (w[2] or "").upper().split()
            if not word and not w[3]:
                if w[0].startswith("$"):
                    stop = w.end()
                    break
                continue
            if w[3]:
                if not stack:
                    stop = w.start()
                    break
            elif word[0] == "END":
                # END alone closes a block or a CASE, END LOOP its loop; an IF or WHILE has an END of its own
                stack -= 1
                if stack <= 0:
                    stop = w.end()
                    break
            elif word[0] == "WHILE" or (word[0] == "IF" and not stack):
                continue  # counted by its LOOP, or a clause of the header
            else:
                stack += 1
        first = line_of(m.start() + len(m[0]) - len(m[0].lstrip()))
        at = first - 1
        above: list[str] = []
        while at >= 1 and lines[at - 1].lstrip().startswith("--"):
            above.insert(0, lines[at - 1])
            at -= 1
        doc = "\n".join(above) or None
        if doc is None and (b := re.search(r"/\*(?:(?!\*/)[\s\S])*\*/[ \t\r]*\n?[ \t\r]*\Z", source[: m.start()])):
            doc = b[0].strip()
        out.append(Found(m[2].strip("\"`"), m[1].split("(")[0].strip(), " ".join(m[1].split()), doc, first, line_of(min(stop, len(source) - 1))))
    return out


def functions_of(lang: str | None, source: str | None) -> list[Found]:
    """Functions and methods of one file with the documentation next to them. Settings files, null
    and empty sources give none."""
    if not source or not lang:
        return []
    if lang == "python":
        return _indented(source)
    if lang in ("java", "javascript", "typescript"):
        return _braced(source, lang)
    if lang == "sql" and ("create" in source or "CREATE" in source or "Create" in source):
        return _keyworded(source)
    return []


def extract(files: DataFrame, key: str = "file_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, fqn, name, signature, docstring, start_line, end_line) of every documented function,
    those with empty or trivial documentation left out."""
    df = files.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(source).alias("s")).filter("l in ('java', 'python', 'javascript', 'typescript', 'sql') and s is not null")
    cols = [key, "fqn", "name", "signature", "docstring", "start_line", "end_line"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (k, f.fqn, f.name, f.signature, "\n".join(clean(f.docstring)).strip(), f.start_line, f.end_line)
                for k, lg, s in zip(b["k"], b["l"], b["s"], strict=True)
                for f in functions_of(lg, s)
                if telling(f.docstring, f.name, f.signature)
            ]
            yield pd.DataFrame(rows, columns=cols)

    return df.mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, fqn string, name string, signature string, docstring string, start_line int, end_line int")


def places(files: DataFrame) -> DataFrame:
    """(repo, file, name, start_line) of every function extracted from a source file together with
    telling documentation. A file scanned twice counts once; the sources themselves aren't moved."""
    df = files.select("repo", F.col("relpath").alias("file"), "lang", "source").filter("lang is not null and source is not null and repo is not null and relpath is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (repo, path, f.name, f.start_line)
                for repo, path, lg, s in zip(b["repo"], b["file"], b["lang"], b["source"], strict=True)
                for f in functions_of(lg, s)
                if telling(f.docstring, f.name, f.signature)
            ]
            yield pd.DataFrame(rows, columns=["repo", "file", "name", "start_line"])

    return df.mapInPandas(run, "repo string, file string, name string, start_line int").distinct()


def documented(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, fqn, signature, docstring): Function nodes with a signature whose function is found in
    its source file together with telling documentation.

    A function is found by repository, file, name and first line. A node written more than once
    counts as written last; of rows with the same time the one with the longest documentation. What
    the node kept of the documentation must be telling as well (it may have been cut, or taken from
    another scan); null or blank signatures and documentation leave a node out.
    """
    own = ["name", "fqn", "signature", "docstring", "repo", "file", "start_line"]
    n = nodes.filter(F.col("label") == "Function").select("id", *own, "last_indexed")
    n = n.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*own), F.struct("last_indexed", F.length("docstring"), "docstring")).alias("n")).select("id", "n.*")
    n = n.filter((F.trim(F.coalesce("signature", F.lit(""))) != "") & (F.trim(F.coalesce("docstring", F.lit(""))) != ""))
    n = n.join(places(files), ["repo", "file", "name", "start_line"], "left_semi").select("id", "name", "fqn", "signature", "docstring")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [telling(d, m, s) for d, m, s in zip(b["docstring"], b["name"], b["signature"], strict=True)]
            yield b.loc[keep, ["id", "fqn", "signature", "docstring"]]

    return n.mapInPandas(run, "id string, fqn string, signature string, docstring string")
