import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from graphloom.llm import origin, syntax

FILES = "file_id long, repo string, relpath string, lang string, source string"


def statements(rng, n):
    return ["    x = " + "".join(f"a{i} {rng.choice('+-*/%&|^')} " for i in range(7)) + "b;\n" for _ in range(n)]


def jaccard(x, y):
    both = len(np.intersect1d(x, y))
    return both / (len(x) + len(y) - both)


def test_families_do_not_depend_on_the_size_of_a_band(spark, monkeypatch):
    rng = random.Random(4)
    body = statements(rng, 90)

    def varied(n):
        out = list(body)
        for i in rng.sample(range(90), n):
            out[i] = statements(rng, 1)[0]
        return "class A {\n  void f() {\n" + "".join(out) + "  }\n}\n"

    # similar to one text in the middle, and few of them to each other
    rows = [(k, "one", f"src/org/harborlight/f{k}", "java", varied(n)) for k, n in enumerate([0] + [18] * 60)]
    df = spark.createDataFrame(rows, FILES)
    prof = origin.profile(df, "harborlight", "file_id").collect()
    sets = {r["shape_h"]: np.frombuffer(r["sh"], np.uint64) for r in prof}
    bands = {r["shape_h"]: set(enumerate(r["bands"])) for r in prof}
    assert len(sets) == len(rows) and all(len(s) >= origin.LARGE for s in sets.values())
    stars = defaultdict(set)
    for x in sets:
        stars[x].add(x)
        for y in sets:
            if x < y and bands[x] & bands[y] and jaccard(sets[x], sets[y]) >= origin.SIMILAR:
                stars[x].add(y)
    families = [s for s in stars.values() if len(s) >= origin.FAMILY]
    want = {r["k"] for r in prof if any(r["shape_h"] in s for s in families)}
    assert 5 <= len(want) < len(rows)
    for name, size in (("COLD", 4), ("SIDE", 32_768), ("SIDE", 4)):
        monkeypatch.setattr(origin, name, size, raising=False)
        assert {r["file_id"] for r in origin.classify(df, "harborlight").collect()} == want, (name, size)


def test_cells_are_compared_across_batches(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(origin, "STEP", 7)
    n = 90
    band, cell = np.sort(rng.integers(0, 3, n)), np.zeros(n, np.int64)
    side = np.where(band == 1, rng.integers(0, 2, n), 2)
    size = rng.integers(200, 400, n)
    size = size[np.lexsort((size, band))]
    odd = rng.integers(0, 2**63, 8).astype(np.uint64)
    sketch = np.stack([odd ^ np.uint64(2 ** int(k) - 1) for k in rng.integers(0, 12, n)])
    most = lambda x, y: (1 - origin.SIMILAR) / (1 + origin.SIMILAR) * (size[x] + size[y]) + 1e-6
    want = {
        (x, y) for x in range(n) for y in range(x + 1, n)
        if band[x] == band[y] and (side[x] == 2 or side[x] != side[y]) and size[y] - size[x] <= most(x, y) and np.bitwise_count(sketch[x] ^ sketch[y]).sum() <= most(x, y)
    }
    cols = [pa.array(band), pa.array(band), pa.array(cell), pa.array(side.astype(np.int32)), pa.array(np.arange(n)), pa.array(size.astype(np.int32)), pa.array(sketch.view(np.int64).tolist(), pa.list_(pa.int64()))]
    whole = pa.RecordBatch.from_arrays(cols, names=["band", "h", "cell", "side", "shape_h", "n_shingles", "sketch"])
    for step, full, block in ((n, n + 1, 1), (11, n + 1, 1), (1, n + 1, 1), (n, 30, 1), (n, 30, 4), (40, 2, 7)):
        monkeypatch.setattr(origin, "FULL", full, raising=False)
        monkeypatch.setattr(origin, "BLOCK", block, raising=False)
        parts = [whole.slice(i, step) for i in range(0, n, step)]
        got = [(x, y) for b in origin._near_in_cells(iter([whole.slice(0, 0), *parts])) for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 100


class Counted:
    def __init__(self, pattern):
        self.pattern, self.n = pattern, 0

    def search(self, text):
        self.n += 1
        return self.pattern.search(text)


def test_only_lines_that_may_hold_a_mark_are_searched(monkeypatch):
    monkeypatch.setattr(origin, "_COPY", Counted(origin._COPY))
    source = "class A {\n" + "".join(f"  int f{i}() {{ return {i}; }} // plain words, no more\n" for i in range(300)) + "}\n"
    marks = ["// This file was created by stubforge 4\n", "// Vendored from https://x.org/y\n", "// fichier généré auto\n", "// cambios a mano perdidos, build\n"]
    bits = [origin.GENERATED, origin.VENDORED, origin.GENERATED, origin.GENERATED]
    assert origin.self_evidence("java", source, None, "harborlight") == 0
    for mark, bit in zip(marks, bits, strict=True):
        origin._COPY.n = 0
        assert origin.self_evidence("java", source + mark + "// edited, written and copied by hand\n", None, "harborlight") == bit
        assert 0 < origin._COPY.n < 5


def test_tokens_have_the_numbers_of_their_classes():
    texts = {"java": 'class A { String s = "x" + 1; /* "no" */ }', "python": "# a\ndef f(a):\n\treturn [a, 'b',\n  1.5]\n", "sql": "SELECT a, 'b' FROM t WHERE x = 1;", "typescript": "const a: X = `b${c}`; d(/e/)"}
    for lang, text in texts.items():
        tokens, ids = origin._masked(lang, text)
        of = syntax._tool(lang)[1]
        names = {i: c for c, i in origin._number.items()}
        assert [names[i] for i in ids.tolist()] == ["" if lang == "python" and t[0] in "\r\n" else of[t] for t in tokens]
        assert origin._hashes[ids[-1]] == zlib.crc32(of[tokens[-1]].encode()) | 1 or not ids[-1]
