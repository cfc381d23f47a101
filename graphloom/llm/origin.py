"""Generated, minified and vendored source files, and data saved as code.

Identifier-masked token shingles are hashed by MinHash and banded, and what shares a band is
verified by exact Jaccard similarity. The verified families decide. A family whose members carry
marks gives its origin to the members without; a family of large shapes needs none: many different
texts in one repository were generated, the same shape in many repositories is a copy, and a family
of hardly anything but literals is data. Marks are what a file says itself: a generator's or a
foreign holder's comment anywhere in it, a foreign package or vendor folder, a token density no
person writes, hardly anything but literals, or bytes that are no text. They label families, and
decide about files that have none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.llm import syntax
from graphloom.session import Scratch, spread

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 5
#: A family of shapes with at least this many shingles needs no marks.
LARGE = 200
FAMILY = 5
#: Share of literal tokens from which a family without marks is data.
LITERAL = 0.35
SKETCH = 512
#: Pairs that one task compares; larger bands are dealt out.
PAIRS = 1_000_000
#: Large shapes of a band that are held at once; those of larger bands are dealt into squares.
SIDE = 32_768
#: Pairs that are compared in one step.
STEP = 1_000_000
#: Rows of a cell from which they are compared in blocks, and the rows of a block.
FULL, BLOCK = 64, 64

GENERATED, VENDORED, DATA, MINIFIED = 1, 2, 4, 8

#: How generators sign their output, at the start of a comment line.
_SIGNED = re.compile(
    r"""(?ix)^\W*(?:@generated\b|code\s+generated\s+(?:by|from)\b|<auto-?generated\b|auto-?generated\s+(?:file|code|by|from|on)\b|automatically\s+(?:generated|created)\b|generated\s+(?:from|by|with|using|on|automatically)\s+\S
    |(?:this|the)\s+(?:file|code|class|module|source|script)\s+(?:was|is|has\s+been)\s+(?:auto\w*[\s-]+)?(?:produced|generated|created|written)\s+(?:by|from|automatically|using)
    |machine[\s-]+(?:written|generated|made)\b|produced\s+by\s+\S+\s+(?:v|version|rev)?\s*\d|do\s+not\s+edit\b[\s.!:;-]*(?:generated|this\s+file\s+is|auto|$)|autogenerated\b|end\s+of\s+output\b
    |(?:diese\s+datei\s+wurde\s+)?(?:automatisch|maschinell)\s+(?:erzeugt|generiert|erstellt)|(?:ce\s+)?fichier\s+(?:produit|généré|créé)\s+auto|(?:archivo|fichero|código)\s+generado|gerado\s+auto|自動生成|自动生成|generated\s+code\b|compiled\s+(?:by|from)\s+\S+\s+\d|transpiled\b|bundled\s+(?:by|with)\b)"""
)
_LOST = re.compile(r"(?i)(?:changes|änderungen|modifications|edits|cambios)\b.{0,40}\b(?:lost|overwritten|gehen verloren|perdues|perdidos)|regenerate with\b|do not edit\.?\W*$|ne pas modifier\W*$|nicht (?:bearbeiten|ändern)\W*$|no editar\W*$")
_HOLDER = re.compile(r"(?i)^\W*(?:copyright\b|©|\(c\)\s*\d{4})(?P<who>.*)")
_COPY = re.compile(r"(?i)^\W*(?:(?:un)?modified|verbatim|vendored|local)\s+copy\s+of\b|^\W*(?:vendored|imported|copied|taken|adapted|borrowed)\s+(?:from|copy of)\b.*(?:https?:|\d\.\d)|\bupstream:?\s+https?:")
_BANNER = re.compile(r"(?i)^\W*(?:@license\s+)?(?P<lib>[a-z][\w.-]*?)(?:\.js)?(?:\s+|-|@|\s*/\s*)v?\d+\.\d+(?:\.\d+)?[\w.-]*\s*(?:\||\*/|-->|$|[-–—(])")
#: Folders that hold other people's code.
_FOLDERS = frozenset("vendor vendors vendored _vendored _vendor third_party thirdparty third-party 3rdparty external externals extern libs lib ext contrib node_modules bower_components deps jspm_packages site-packages godeps".split())
_ROOTS = frozenset("org com net io de fr".split())
_TRANSPILED = re.compile(r"^(?:\"use strict\";\s*)?var __(?:assign|extends|awaiter|createBinding|importDefault|importStar|decorate|rest|spreadArray|generator) = \(this && this\.__|^//[#@] sourceMappingURL=(?!data:text/plain)\S+", re.MULTILINE)
_TABLES = re.compile(r"\b(?:_lr_(?:action|goto)(?:_items|s)?|_tabversion|_lr_signature|yy(?:Check|Table|Defred|Lhs|Len|Dgoto|Sindex|Rindex|Gindex|Action|Accept|_accept|_ec|_base|_def|_nxt|_chk|r1|pact|defact|pgoto|defgoto|translate)|serializedATN|_serializedATN|DFA\d+_(?:eot|eof|min|max|accept|special|transition)|jj_la1(?:_\d)?)\b")


_TABLE_HINTS = ("_lr_", "_tabversion", "yy", "serializedATN", "DFA", "jj_la1")
_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
#: Strings and comments: a comment mark inside a string is none. Every branch begins with a letter of
#: its own, so that the text between is skipped fast.
_TEXTS = {
    "python": re.compile(r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|" + _STRINGS + r"|#[^\n]*"),
    "sql": re.compile(r"'(?:[^'\n]|'')*'|\"[^\"\n]*\"|--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|#(?<=\n#)[^\n]*"),
    "": re.compile(r"\"\"\"[\s\S]*?\"\"\"|" + _STRINGS + r"|`(?:[^`\\]|\\[\s\S])*`|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[^\n]*|#(?<=\n#)[^\n]*"),
}
_PROLOGUE = re.compile(r"\A(?:\s|#![^\n]*|<\?[^\n]*|[\"']use strict[\"'];?)*\Z")
#: How files of other formats begin.
_MAGIC = ("PK\x03\x04", "PK\x05\x06", "\x7fELF", "GIF8", "%PDF-", "\x89PNG", "BZh", "Rar!", "SQLite format 3")
_CONTROL = bytes([*range(1, 9), *range(14, 32), 127])


def no_text(source: str) -> bool:
    """Bytes of another format under a source suffix. Wide encodings, which hold a zero beside
    every letter, are texts."""
    if source.startswith(_MAGIC):
        return True
    raw = source.encode("utf-8", "replace")
    return "\x00" not in source and (len(raw) - len(raw.translate(None, _CONTROL)) + source.count("\ufffd")) * 20 > len(source)


#: Lower-case parts of words of which every mark in a comment has one.
_HINTS = frozenset("""generat erzeug generi produ créé gerado 自動 自动 machine maschinell output transpiled bundled compiled copyright © (c) copy vendored imported
copied taken adapted borrowed upstream lost overwritten verloren perdu edit modif bearbeiten ändern written automat""".split())
#: What a line of ASCII must hold besides to be a mark.
_LINE_HINTS = [*_HINTS, "creat", "auto", "generad", "perdid"]


def _comment_lines(lang: str, source: str) -> list[tuple[str, bool]]:
    """All comment lines of the text, each with whether it stands before any code. A Python file's
    leading docstring counts as a comment."""
    out: list[tuple[str, bool]] = []
    head, end = True, 0
    for m in _TEXTS.get(lang, _TEXTS[""]).finditer(source):
        if head:
            a, b = m.span()
            head = a == end or bool(_PROLOGUE.match(source[end:a]))
            end = b
        said = m[0]
        if said[0] not in "\"'`" or (head and lang == "python"):
            out += [(x, head) for x in said.split("\n")]
    return out


def self_evidence(lang: str, source: str, relpath: str | None, house: str) -> int:
    """Bits of what the file says about its own origin; comments are read in the whole text."""
    bits = 0
    low_house = house.lower()
    lines = _comment_lines(lang, source)
    said = "\n".join([x for x, _ in lines]).lower()
    hints = [h for h in _LINE_HINTS if h in said]
    if _HINTS.isdisjoint(hints):
        lines = [x for x in lines if x[1]]
    for x, head in lines:
        low = x.lower()
        if not head and low.isascii() and not any(h in low for h in hints):
            continue
        if _SIGNED.match(x) or (_LOST.search(x) and re.search(r"(?i)generat|erzeugt|produ|machine|compil|make\b|build\b|auto", x)):
            bits |= GENERATED
        if low_house in low:
            continue
        if _COPY.search(x):
            bits |= VENDORED
        elif (m := _HOLDER.match(x)) and re.search(r"[A-Za-z]{3}", re.sub(r"(?i)\(c\)|copyright|all rights reserved|licen[sc]ed?.*", "", m["who"])):
            bits |= VENDORED
        elif head and (m := _BANNER.match(x)) and len(m["lib"]) > 2 and (x.lstrip().startswith(("/*!", "/**", "#", "//", "--", "/*"))) and m["lib"].lower() not in ("version", "rev", "release", "since", "python", "java", "node", "es", "utf", "see", "iso", "rfc"):
            bits |= VENDORED
    if any(t in source for t in _TABLE_HINTS) and _TABLES.search(source) or ("this.__" in source or "sourceMappingURL" in source) and _TRANSPILED.search(source):
        bits |= GENERATED
    if relpath:
        parts = relpath.replace("\\", "/").split("/")
        lows = [p.lower() for p in parts[:-1]]
        last = max([i for i, p in enumerate(lows) if p in _FOLDERS], default=-1)
        if last >= 0 and last + 1 < len(lows) and not any(low_house in p for p in lows[last + 1 :]):
            bits |= VENDORED
        elif not any(low_house in p for p in lows) and any(p in _ROOTS and i + 1 < len(lows) for i, p in enumerate(lows)):
            bits |= VENDORED
        if parts[-1].lower().endswith((".min.js", ".min.css", ".bundle.js", ".pb.go", "_pb2.py", ".g.dart")):
            bits |= MINIFIED
    if lang == "java" and (m := re.search(r"^\s*package\s+([\w.]+)\s*;", source, re.MULTILINE)) and low_house not in m[1].lower() and m[1].split(".")[0] in _ROOTS and m[1].count("."):
        bits |= VENDORED
    return bits


def density(lang: str, source: str, tokens: list[str], ids: np.ndarray) -> int:
    """Bits from the tokens, given with the numbers of their classes: minified text and literal-only files."""
    of = np.bincount(ids, minlength=_FIXED)
    of[0] = 0
    n = int(of.sum())
    lit = int(of[_LITERALS].sum())
    if n < 20:
        return DATA if n >= 3 and len(source) > 400 and _literal_chars(tokens, ids) > 0.85 * len(source) else 0
    bits = 0
    lines = source.count("\n") + 1
    filled = sum(map(bool, map(str.strip, source.split("\n")))) or 1
    words = n - lit - int(of[_COMMAS].sum())
    dense = n / filled
    if dense < 22 and lit < 40 and len(source) <= 600:
        return 0
    lit_chars = _literal_chars(tokens, ids) if lit else 0
    if lang != "sql":
        # a person breaks lines; minifiers don't. Long literals alone don't count.
        if (dense >= 40 and (len(source) - lit_chars) / lines >= 150) or dense >= 60:
            bits |= MINIFIED
        names = _chars(tokens, ids == _NAME) if dense >= 22 and n > 300 else 0
        if names and names / of[_NAME] < 2.6:
            bits |= MINIFIED
    if len(source) > 600 and ((lit_chars > 0.8 * len(source) and words < 60) or (lit_chars > 0.6 * len(source) and words < 36)):
        bits |= DATA
    elif lit >= 60 and words <= 0.35 * n and words < max(90, 0.25 * n):
        bits |= DATA
    elif lit >= 40 and lit >= 0.28 * n and np.count_nonzero(of) <= 24 and words <= 0.3 * n + 10:
        bits |= DATA
    return bits


def _chars(tokens: list[str], which: np.ndarray) -> int:
    return sum(len(tokens[i]) for i in np.flatnonzero(which).tolist())


def _literal_chars(tokens: list[str], ids: np.ndarray) -> int:
    return _chars(tokens, (ids >= _LITERALS[0]) & (ids <= _LITERALS[-1]))


#: Numbers of token classes: 0 is no token (a line end in Python), then literals, names and commas.
_NUMBERED = ["", "NUM", "STR", "TEMPLATE", "ID", ",", "(", ")", "[", "]", "{", "}", ":", ";", "-", "NEWLINE", "+", "\n"]
_number = {c: i for i, c in enumerate(_NUMBERED)}
_FIXED = len(_NUMBERED)
_LITERALS, _NAME, _COMMAS = np.arange(1, 4), 4, np.arange(5, _FIXED)
#: The hash of each class, by number; there are a few hundred classes.
_hashes = np.zeros(4096, dtype=np.uint64)
_hashes[:_FIXED] = [zlib.crc32(c.encode()) | 1 for c in _NUMBERED]


class _Numbers(dict):
    """Token text -> number of its class, worked out once per text; emptied when it gets large."""

    def __init__(self, lang: str):
        super().__init__()
        self.lang, self.classes = lang, syntax._tool(lang)[1]

    def __missing__(self, t: str) -> int:
        if len(self) > self.classes.LIMIT:
            self.clear()
        if self.lang == "python" and t[0] in "\r\n":
            v = 0
        else:
            c = self.classes._of(t)
            v = _number.setdefault(c, len(_number))
            _hashes[v] = zlib.crc32(c.encode()) | 1
        self[t] = v
        return v


_numbers: dict[str, _Numbers] = {}


_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(SHINGLE)], dtype=np.uint64)
_MIX = np.array([pow(0xC2B2AE3D27D4EB4F, k + 1, 2**64) for k in range(ROWS)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def shingles(ids: np.ndarray) -> np.ndarray:
    """Distinct hashes of five masked tokens in a row, given by the numbers of their classes."""
    c = _hashes[ids]
    if len(c) < SHINGLE:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(c) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        h += c[k : k + len(h)] * _POWERS[k]
    h = _mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def bands(sh: np.ndarray) -> np.ndarray:
    # the shingles are mixed already, so that a line modulo 2**64 permutes them well enough
    sig = _mix((sh[None, :] * _A[:, None] + _B[:, None]).min(axis=1)).reshape(BANDS, ROWS)
    return _mix((sig * _MIX[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(sh: np.ndarray) -> np.ndarray:
    """Parities of the shingles dealt into ``SKETCH`` bits. Two sketches differ in at most as many
    bits as the sets in members, so a larger difference rules a pair out for certain."""
    odd = np.bincount((sh & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _masked(lang: str, source: str) -> tuple[list[str], np.ndarray]:
    """The tokens and the numbers of their classes."""
    if lang not in _numbers:
        _numbers[lang] = _Numbers(lang)
    toks = syntax.tokens_of(lang, source)
    return toks, np.fromiter(map(_numbers[lang].__getitem__, toks), dtype=np.int64, count=len(toks))


_NAMES = ["text_h", "shape_h", "n_shingles", "n_tokens", "n_literals", "bits", "bands", "sketch", "sh"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
_PROFILE = "k {key}, repo string, text_h long, shape_h long, n_shingles int, n_tokens int, n_literals int, bits int, bands array<long>, sketch array<long>, sh binary"


def profile(files: DataFrame, house: str, key: str) -> DataFrame:
    """One row per file with a language: its own evidence, its shape (the set of its shingles) and
    the shape's bands. Texts of fewer than five tokens have no shape."""
    df = spread(files.filter("lang is not null").select(F.col(key).alias("k"), "repo", "relpath", "lang", "source"), files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            keys, repos, paths, langs, texts = (b.column(i) for i in range(5))
            for path, lang, src in zip(paths.to_pylist(), langs.to_pylist(), texts.to_pylist(), strict=True):
                if not src or not src.strip() or lang not in syntax._START:
                    rows.append((0, 0, 0, 0, 0, 0, None, None, None))
                    continue
                toks, ids = _masked(lang, src)
                masked = ids[ids != 0] if lang == "python" else ids
                bits = self_evidence(lang, src, path, house) if len(masked) else 0
                if no_text(src):
                    bits |= DATA
                elif "\x00" not in src:
                    bits |= density(lang, src, toks, ids)
                sh = shingles(masked)
                shape = int(np.bitwise_xor.reduce(_mix(sh * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)) if len(sh) else 0
                own = (zlib.crc32(src.encode("utf-8", "replace")) << 20 | len(src) & 0xFFFFF, shape, len(sh), len(masked), int(np.count_nonzero((ids >= _LITERALS[0]) & (ids <= _LITERALS[-1]))), bits)
                rows.append((*own, bands(sh).tolist(), sketch(sh).tolist(), sh.tobytes()) if len(sh) else (*own, None, None, None))
            columns = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([keys, repos, *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["k", "repo", *_NAMES])

    return df.mapInArrow(run, _PROFILE.format(key=dict(files.dtypes)[key]))


def classify(files: DataFrame, house: str, key: str = "file_id") -> DataFrame:
    """(key, bits, family_bits) of the files that are not hand-written; the bits say why (GENERATED,
    VENDORED, DATA, MINIFIED): by the file itself, and by the family it belongs to.

    Rows with a null language are left out; null, empty and blank sources are hand-written. Equal
    shapes are compared once, and no source text is moved: the shingles come out of one pass.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "origin")
    prof, _ = scratch.write(profile(files, house, key), "profile")
    texts = prof.filter("bands is not null").groupBy("shape_h", "text_h").agg(F.max("bits").alias("bits"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    shapes, _ = scratch.write(
        texts.groupBy("shape_h").agg(
            F.count(F.lit(1)).alias("n_texts"), F.sum((F.col("bits") > 0).cast("int")).alias("n_marked"), F.bit_or("bits").alias("bits"),
            F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ),
        "shapes",
    )
    members = shapes.select("shape_h", (F.col("n_marked") * 2 >= F.col("n_texts")).alias("speaks"), "n_shingles", "sketch", F.posexplode("bands").alias("band", "h"))
    # unmarked shapes against all marked ones of their bands; large ones with each other; all with a leader
    core = _shared(scratch, members.filter(F.col("speaks") | (F.col("n_shingles") >= LARGE)))
    asked = _asked(scratch, members.filter("speaks"), members.filter("not speaks")).withColumn("star", F.lit(False))
    asked = asked.unionByName(_asked_leaders(core).unionByName(_asked_large(core)).withColumn("star", F.lit(True)))
    similar, _ = scratch.write(_verified(prof, scratch, asked.groupBy("leader", "shape_h").agg(F.max("star").alias("star"), F.bool_or(~F.col("star")).alias("heard"))), "similar")
    heard = similar.filter("heard").select("leader", "shape_h")
    alone = shapes.filter((F.col("n_marked") * 2 >= F.col("n_texts")) | (F.col("n_shingles") >= LARGE)).select(F.col("shape_h").alias("leader"), "shape_h")
    stars, _ = scratch.write(alone.unionByName(similar.filter("star").select("leader", "shape_h")).distinct(), "stars")
    by_family, _ = scratch.write(_families(prof, shapes, stars, heard), "families")
    out = prof.select("k", "shape_h", "bits").join(by_family, "shape_h", "left").select(F.col("k").alias(key), "bits", F.coalesce("family_bits", F.lit(0)).alias("family_bits"))
    return out.filter("bits <> 0 or family_bits <> 0")


def _families(prof: DataFrame, shapes: DataFrame, stars: DataFrame, heard: DataFrame) -> DataFrame:
    """(shape_h, family_bits) of the shapes in families that have an origin."""
    stats = shapes.select("shape_h", "n_texts", "n_marked", F.col("bits").alias("shape_bits"), "n_shingles")
    # an unmarked shape belongs to the family of each marked shape it is similar to
    joined = stars.unionByName(heard.select(F.col("leader").alias("via"), F.col("shape_h").alias("member")).join(stars.select(F.col("shape_h").alias("via"), "leader"), "via").select("leader", F.col("member").alias("shape_h"))).distinct()
    own = shapes.join(joined.select("shape_h").distinct(), "shape_h", "left_anti").select(F.col("shape_h").alias("leader"), "shape_h")
    links = joined.unionByName(own.join(stats.filter("n_texts >= 3").select("shape_h"), "shape_h", "left_semi"))
    marks = links.join(stats, "shape_h").groupBy("leader").agg(F.sum("n_texts").alias("n"), F.sum("n_marked").alias("marked"), F.bit_or("shape_bits").alias("b"), F.min("n_shingles").alias("least"))
    marked = marks.filter((F.col("n") >= 3) & (F.col("marked") >= 2) & (F.col("marked") * 2 > F.col("n"))).select("leader", "b")
    large = links.join(marks.filter(F.col("least") >= LARGE).select("leader"), "leader", "left_semi")
    per_repo = large.join(prof.select("shape_h", "repo", "text_h", "n_tokens", "n_literals"), "shape_h").groupBy("leader", "repo").agg(F.count_distinct("text_h").alias("texts"), F.sum("n_tokens").alias("tokens"), F.sum("n_literals").alias("literals"))
    spread_out = per_repo.groupBy("leader").agg(F.max("texts").alias("in_repo"), F.sum("texts").alias("texts"), F.count("repo").alias("repos"), F.sum("tokens").alias("tokens"), F.sum("literals").alias("literals"))
    bit = lambda cond, b: F.when(cond, F.lit(b)).otherwise(F.lit(0))
    structural = spread_out.select("leader", bit(F.col("in_repo") >= FAMILY, GENERATED).bitwiseOR(bit(F.col("repos") >= FAMILY, VENDORED)).bitwiseOR(bit((F.col("texts") >= FAMILY) & (F.col("literals") >= LITERAL * F.col("tokens")), DATA)).alias("b")).filter("b <> 0")
    decided = marked.unionByName(structural).groupBy("leader").agg(F.bit_or("b").alias("b"))
    return links.join(decided, "leader").groupBy("shape_h").agg(F.bit_or("b").alias("family_bits"))


def _apart(size: str, other_size: str, sketch: str, other: str) -> Column:
    """Surely less similar than ``SIMILAR``, by sizes and sketches."""
    # J >= s means |A - B| + |B - A| <= (1 - s) / (1 + s) * (|A| + |B|)
    most = (1 - SIMILAR) / (1 + SIMILAR) * (F.col(size) + F.col(other_size)) + 1e-6
    bits = sum((F.bit_count(F.col(sketch)[i].bitwiseXOR(F.col(other)[i])) for i in range(SKETCH // 64)), F.lit(0))
    return (F.abs(F.col(size) - F.col(other_size)) > most) | (bits > most)


def _asked(scratch: Scratch, speakers: DataFrame, members: DataFrame) -> DataFrame:
    """(leader, shape_h): each speaker and the members that share a band with it and may be similar.
    Hot bands are dealt out to many tasks. The bands in common are written first: where they are
    few, Spark sends them to all tasks and no other row moves before it is known to matter."""
    at = ["band", "h"]
    n = speakers.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).join(members.groupBy(*at).agg(F.count(F.lit(1)).alias("m")), at)
    n, _ = scratch.write(n.select(*at, (F.lit(1) + F.floor(F.col("n") * F.col("m") / PAIRS)).cast("int").alias("parts")), "bands")
    left = speakers.join(n, at).select(*at, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shape_h").alias("leader"), F.col("n_shingles").alias("size"), F.col("sketch").alias("other"))
    right = members.join(n, at).select(*at, F.pmod(F.xxhash64("shape_h"), F.col("parts")).cast("int").alias("part"), "shape_h", "n_shingles", "sketch")
    return left.join(right, [*at, "part"]).filter((F.col("leader") != F.col("shape_h")) & ~_apart("size", "n_shingles", "other", "sketch")).select("leader", "shape_h")


def _shared(scratch: Scratch, members: DataFrame) -> DataFrame:
    """The rows of bands that hold more than one shape, with the smallest shape of the band and the
    number of shapes without marks."""
    first = F.min(F.struct("shape_h", "n_shingles", "sketch"))
    n = members.groupBy("band", "h").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("speaks")).alias("n"), first.alias("first")).filter("all > 1").drop("all")
    n, _ = scratch.write(n, "shared")
    return scratch.write(members.select("band", "h", "shape_h", "speaks", "n_shingles", "sketch").join(n, ["band", "h"]), "core")[0]


def _asked_leaders(core: DataFrame) -> DataFrame:
    """(leader, shape_h): every shape and the smallest one of each of its bands, if they may be similar."""
    a = core.select("shape_h", "n_shingles", "sketch", F.col("first.shape_h").alias("leader"), F.col("first.n_shingles").alias("size"), F.col("first.sketch").alias("other"))
    return a.filter((F.col("leader") != F.col("shape_h")) & ~_apart("size", "n_shingles", "other", "sketch")).select("leader", "shape_h")


def _asked_large(core: DataFrame) -> DataFrame:
    """(leader, shape_h): every two large shapes without marks, the smaller first, that share a band
    and may be similar, whatever the size of the band. The shapes of a band of more than ``SIDE`` are
    dealt into parts by their hash, and every two parts meet in a cell of their own, so a task holds
    two parts at most. The comparisons of a band grow with the square of its shapes."""
    at = ["band", "h", "cell"]
    rows = core.filter((F.col("n") > 1) & ~F.col("speaks")).withColumn("parts", F.ceil(F.col("n") / SIDE)).withColumn("part", F.pmod(F.xxhash64("shape_h"), "parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct((F.least("part", k) * F.col("parts") + F.greatest("part", k)).alias("cell"), F.when(k == F.col("part"), 2).otherwise((k < F.col("part")).cast("int")).alias("side")))
    cells = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(2).alias("side")))).otherwise(cells)
    dealt = rows.select("band", "h", "shape_h", "n_shingles", "sketch", F.explode(cells).alias("c")).select("band", "h", "c.cell", "c.side", "shape_h", "n_shingles", "sketch")
    return dealt.repartition(*at).sortWithinPartitions(*at, "n_shingles").mapInArrow(_near_in_cells, "leader long, shape_h long")


def _near_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of cells that come one after the other, each in the order of its sizes."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        flat = b.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH // 64)
        cols = [*(b.column(c).to_numpy(zero_copy_only=False) for c in ("band", "h", "cell", "side", "shape_h", "n_shingles")), flat]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])])
        last = int(np.flatnonzero(new)[-1])  # the last cell may go on in the next batch
        rest = [x[last:] for x in cols]
        yield from _near(np.cumsum(new[:last]), *(x[:last] for x in cols[3:]))
    if rest is not None:
        yield from _near(np.zeros(len(rest[0]), np.int64), *rest[3:])


def _near(cell: np.ndarray, side: np.ndarray, shape: np.ndarray, size: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of a cell that aren't surely apart (as ``_apart``). Rows of sides 0 and 1 meet the
    other side only, those of side 2 each other."""
    size, at = size.astype(np.int64), np.arange(len(cell))
    # sizes of similar sets differ by a ratio of SIMILAR at most
    end = np.searchsorted(cell << 32 | size, cell << 32 | np.floor(size / SIMILAR + 1e-6).astype(np.int64), side="right")
    words = np.ascontiguousarray(sketches.T)
    full = np.bincount(cell)[cell] >= FULL
    for x, y in chain(_each(np.where(full, at + 1, end)), _blocks(full, end, size, words)):
        if len(x) and side.min() < 2:
            meet = (side[x] == 2) | (side[x] != side[y])
            x, y = x[meet], y[meet]
        most = _most(size[x] + size[y])
        bits = np.zeros(len(x), np.int64)
        for k, w in enumerate(words):
            bits += np.bitwise_count(w[x] ^ w[y])
            if k % 2:
                may = bits <= most
                x, y, most, bits = x[may], y[may], most[may], bits[may]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(shape[x], shape[y])), pa.array(np.maximum(shape[x], shape[y]))], names=["leader", "shape_h"])


def _most(sizes: np.ndarray) -> np.ndarray:
    return (1 - SIMILAR) / (1 + SIMILAR) * sizes + 1e-6


def _each(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with the rows behind it up to its end, some ``STEP`` pairs at a time."""
    at = np.arange(len(end))
    upto = np.cumsum(end - at - 1)
    a = 0
    while a < len(end):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STEP, side="right")))
        n = end[a:b] - at[a:b] - 1
        x = np.repeat(at[a:b], n)
        yield x, np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + x + 1
        a = b


def _blocks(full: np.ndarray, end: np.ndarray, size: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_each`` for the rows of full cells, without most of the pairs that the sketches tell
    apart: blocks of rows meet blocks of rows."""
    for a in range(0, len(end), BLOCK):
        b = min(a + BLOCK, len(end))
        if not full[a:b].any():
            continue
        last, largest = int(end[a:b].max()), size[a:b].max()
        for c in range(a + 1, last, 16 * BLOCK):
            d = min(c + 16 * BLOCK, last)
            bits = np.zeros((b - a, d - c), np.uint16)
            for w in words:
                bits += np.bitwise_count(w[a:b, None] ^ w[None, c:d])
            x, y = np.nonzero(bits <= np.minimum(_most(largest + size[c:d]), SKETCH).astype(np.uint16))
            x, y = x + a, y + c
            met = full[x] & (x < y) & (y < end[x])
            if met.any():
                yield x[met], y[met]


def _verified(prof: DataFrame, scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """The pairs (leader, shape_h, ...) whose shingle sets are similar."""
    pairs, _ = scratch.write(pairs, "candidates")
    cols = pairs.columns
    used = pairs.select("shape_h").union(pairs.select("leader")).distinct()
    sets, _ = scratch.write(prof.filter("sh is not null").select("shape_h", "sh").join(used, "shape_h", "left_semi").groupBy("shape_h").agg(F.first("sh").alias("sh")), "sets")
    j = pairs.join(sets, "shape_h").join(sets.select(F.col("shape_h").alias("leader"), F.col("sh").alias("lsh")), "leader")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["sh"], b["lsh"], strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(8 * both >= SIMILAR * (len(x) + len(y) - 8 * both))
            yield b.loc[keep, cols]

    return j.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in pairs.dtypes))
