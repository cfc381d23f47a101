"""Compiled classes as tables: the constant pool, methods with their calls, and line numbers."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that follow each opcode; 0 where not listed. The two switches and wide vary.
_ONE = [16, 18, *range(21, 26), *range(54, 59), 169, 188]
_TWO = [17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199]
_SIZES = {**dict.fromkeys(_ONE, 1), **dict.fromkeys(_TWO, 2), 185: 4, 186: 4, 197: 3, 200: 4, 201: 4}
_INVOKE = {182: "virtual", 183: "special", 184: "static", 185: "interface", 186: "dynamic"}
_FIELDS = {178: "get", 179: "put", 180: "get", 181: "put"}
#: Sizes of constants by tag, without the tag.
_CONSTANTS = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
SYNTHETIC, BRIDGE, STATIC, PRIVATE, FINAL = 0x1000, 0x0040, 0x0008, 0x0002, 0x0010


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str) -> int:
        (v,) = struct.unpack_from(">" + fmt, self.data, self.at)
        self.at += struct.calcsize(fmt)
        return v


def _text(raw: bytes) -> str:
    return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "replace")


def parse(data: bytes) -> dict:
    """name, super, interfaces, source, access, fields and methods (name, descriptor, access, line,
    calls, accesses) of a class file. ValueError for anything else; truncated files too."""
    try:
        return _parse(data)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"broken class file: {e}") from e


def _parse(data: bytes) -> dict:
    r = _Reader(data)
    if r.take("I") != 0xCAFEBABE:
        raise ValueError("no class file")
    r.at += 4
    n, pool = r.take("H"), {}
    i = 1
    while i < n:
        tag = r.take("B")
        if tag == 1:
            size = r.take("H")
            pool[i] = (tag, _text(data[r.at : r.at + size]))
            r.at += size
        else:
            size = _CONSTANTS[tag]
            raw = data[r.at : r.at + size]
            pool[i] = (tag, struct.unpack(">HH", raw) if tag in (9, 10, 11, 12, 17, 18) else struct.unpack(">H", raw) if size == 2 else raw)
            r.at += size
        i += 2 if tag in (5, 6) else 1  # long and double take two places

    def utf(k: int) -> str:
        return pool[k][1]

    def cls(k: int) -> str:
        return utf(pool[k][1][0]).replace("/", ".") if k else ""

    def member(k: int) -> tuple[str, str, str]:
        tag, v = pool[k]
        name, desc = pool[v[1]][1]
        return ("" if tag == 18 else cls(v[0])), utf(name), utf(desc)

    access, name, parent = r.take("H"), cls(r.take("H")), cls(r.take("H"))
    out = {"name": name, "super": parent, "access": access, "interfaces": [cls(r.take("H")) for _ in range(r.take("H"))], "source": "", "fields": [], "methods": []}

    def attributes() -> Iterator[tuple[str, int, int]]:
        for _ in range(r.take("H")):
            what, size = utf(r.take("H")), r.take("I")
            start = r.at
            yield what, start, size
            r.at = start + size

    for _ in range(r.take("H")):
        flags, f, d = r.take("H"), utf(r.take("H")), utf(r.take("H"))
        for _a in attributes():
            pass
        out["fields"].append({"name": f, "descriptor": d, "access": flags})
    for _ in range(r.take("H")):
        m = {"access": r.take("H"), "name": utf(r.take("H")), "descriptor": utf(r.take("H")), "line": 0, "last_line": 0, "calls": [], "accesses": []}
        for what, start, _size in attributes():
            if what != "Code":
                continue
            r.at = start + 4
            length = r.take("I")
            code, begin = data[r.at : r.at + length], r.at
            r.at = begin + length
            r.at += 2 + 8 * struct.unpack_from(">H", data, r.at)[0]
            lines: list[tuple[int, int]] = []
            for inner, s, _z in attributes():
                if inner == "LineNumberTable":
                    r.at = s
                    lines += [(r.take("H"), r.take("H")) for _ in range(r.take("H"))]
            lines.sort()
            offsets = [o for o, _ in lines]
            at_line = lambda o, lines=lines, offsets=offsets: lines[bisect_right(offsets, o) - 1][1] if offsets and offsets[0] <= o else 0
            if lines:
                m["line"], m["last_line"] = min(x for _, x in lines), max(x for _, x in lines)
            p = 0
            while p < length:
                op = code[p]
                if op in _INVOKE:
                    owner, callee, desc = member(struct.unpack_from(">H", code, p + 1)[0])
                    m["calls"].append({"kind": _INVOKE[op], "owner": owner, "name": callee, "descriptor": desc, "line": at_line(p)})
                elif op in _FIELDS:
                    owner, field, desc = member(struct.unpack_from(">H", code, p + 1)[0])
                    m["accesses"].append({"kind": _FIELDS[op], "owner": owner, "name": field, "descriptor": desc, "line": at_line(p)})
                if op in (170, 171):
                    q = p + 4 - p % 4
                    if op == 170:
                        low, high = struct.unpack_from(">ii", code, q + 4)
                        p = q + 12 + 4 * (high - low + 1)
                    else:
                        p = q + 8 + 8 * struct.unpack_from(">i", code, q + 4)[0]
                elif op == 196:
                    p += 6 if code[p + 1] == 132 else 4
                else:
                    p += 1 + _SIZES.get(op, 0)
        out["methods"].append(m)
    for what, start, _size in attributes():
        if what == "SourceFile":
            r.at = start
            out["source"] = utf(r.take("H"))
    return out


_USE = "array<struct<kind: string, owner: string, name: string, descriptor: string, line: int>>"
SCHEMA = f"path string, entry string, error string, name string, super string, access int, interfaces array<string>, source string, fields array<struct<name: string, descriptor: string, access: int>>, methods array<struct<access: int, name: string, descriptor: string, line: int, last_line: int, calls: {_USE}, accesses: {_USE}>>"
_COLUMNS = [c.split()[0] for c in "path, entry, error, name, super, access, interfaces, source, fields, methods".split(", ")]


def classes(files: DataFrame) -> DataFrame:
    """One row per class in ``files`` (path, content): class files, and archives of them, each in one
    task. An entry that is broken gives a row with its error; entries that are no classes give none."""
    import io
    import zipfile

    def rows(path: str, content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
        if content[:2] != b"PK":
            yield "", content, None
            return
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for e in z.namelist():
                    if e.endswith(".class"):
                        try:
                            yield e, z.read(e), None
                        except Exception as x:  # one bad entry is skipped
                            yield e, None, str(x)[:200]
        except zipfile.BadZipFile as x:
            yield "", None, str(x)[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                out = []
                for entry, data, error in rows(path, bytes(content)):
                    c: dict = {}
                    try:
                        c = parse(data) if data is not None else {}
                    except ValueError as x:
                        error = str(x)[:200]
                    out.append((path, entry, error, *(c.get(k) for k in _COLUMNS[3:])))
                    if len(out) >= 500:
                        yield pd.DataFrame(out, columns=_COLUMNS)
                        out = []
                yield pd.DataFrame(out, columns=_COLUMNS)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def calls(c: DataFrame) -> DataFrame:
    """(caller, caller_method, caller_descriptor, owner, method, descriptor, line) of every call of
    methods a person wrote: synthetic and bridge methods are left out unless they are lambdas."""
    m = c.filter("error is null").select(F.col("name").alias("caller"), F.explode("methods").alias("m"))
    m = m.filter((F.col("m.access").bitwiseAND(SYNTHETIC | BRIDGE) == 0) | F.startswith("m.name", F.lit("lambda$")))
    x = m.select("caller", F.col("m.name").alias("caller_method"), F.col("m.descriptor").alias("caller_descriptor"), F.explode("m.calls").alias("c")).filter("c.kind <> 'dynamic'")
    return x.select("caller", "caller_method", "caller_descriptor", F.col("c.owner").alias("owner"), F.col("c.name").alias("method"), F.col("c.descriptor").alias("descriptor"), F.col("c.line").alias("line"))
