"""Held-out items that turn up in a corpus: CGK embedding, bit-sampling LSH, exact edit check.

The random walk of the CGK embedding turns a few changed, dropped or added words into a few changed
positions, so equal samples of positions find windows at small edit distance. Every position of
every item and of every text where a long enough match is possible at all starts a window; several
walks and samples together reach the target recall. What they propose is decided by dynamic
programming: a stretch of the item of at least ``MIN_WORDS`` words with at most one edit in ``PER``.

Texts are read whole and in place: no text or window is shuffled. The items are taken in blocks of
bounded size, each sent to all tasks; the number of passes grows with the items, not their memory.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 25
PER = 12
#: With at most one edit in 12 words, 25 words hold an unchanged run of at least this many.
RUN = 8
WALKS = 6
STEPS = 14
SAMPLES = 10
BLOCK_CHARS = 2_000_000
#: Texts embedded together, in characters.
CHUNK_CHARS = 1_500_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|&(?:[a-z]{2,8}|#\d{1,6});")
_GONE = re.compile("[­​‌‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case, punctuation, spacing and markup."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", _GONE.sub("", text)).casefold())


class _Ids(dict):
    """Word -> id; unknown words are 0."""

    def __missing__(self, w: str) -> int:
        return 0


@dataclass
class Items:
    """A block of items, ready for search."""

    keys: list
    arrays: list[np.ndarray]
    ids: _Ids
    bits: np.ndarray  # walk, step, word -> advance
    picks: np.ndarray  # walk, sampled steps
    hashes: np.ndarray  # sorted
    where: np.ndarray  # item number of each hash
    offset: np.ndarray
    member: np.ndarray  # item, word -> does the item have it


_K = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _walk(w: np.ndarray, starts: np.ndarray, bits: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Sampled CGK hashes, one row per walk. ``w`` is padded with at least STEPS zeros."""
    out = np.empty((len(bits), len(starts)), dtype=np.uint64)
    for r in range(len(bits)):
        at = starts.copy()
        h = np.full(len(starts), r + 1, dtype=np.uint64)
        chosen = set(picks[r].tolist())
        for j in range(STEPS):
            sym = w[at]
            if j in chosen:
                h = _scramble(h * _K + sym.astype(np.uint64))
            at += bits[r, j][sym]
        out[r] = h
    return out


def prepare(keys: list, texts: list[str | None], seed: int = 11) -> Items:
    tokens = [words(t) for t in texts]
    ids = _Ids()
    for ws in tokens:
        for x in ws:
            if x not in ids:
                dict.__setitem__(ids, x, len(ids) + 1)
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (WALKS, STEPS, len(ids) + 1)).astype(np.int64)
    picks = np.stack([np.sort(np.concatenate([[0], rng.choice(np.arange(1, STEPS), SAMPLES - 1, replace=False)])) for _ in range(WALKS)])
    arrays = [np.array([ids[x] for x in ws], dtype=np.int64) for ws in tokens]
    hashes, where, offset = [], [], []
    for n, a in enumerate(arrays):
        if len(a) < MIN_WORDS:
            continue
        starts = np.arange(len(a) - RUN + 1)
        h = _walk(np.concatenate([a, np.zeros(STEPS + 1, dtype=np.int64)]), starts, bits, picks)
        hashes.append(h.ravel())
        where.append(np.full(h.size, n))
        offset.append(np.tile(starts, WALKS))
    if hashes:
        h, wh, of = np.concatenate(hashes), np.concatenate(where), np.concatenate(offset)
        order = np.argsort(h, kind="stable")
        h, wh, of = h[order], wh[order], of[order]
    else:
        h, wh, of = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    member = np.zeros((len(arrays), len(ids) + 1), dtype=bool)
    for n, x in enumerate(arrays):
        member[n, x] = True
    return Items(keys, arrays, ids, bits, picks, h, wh, of, member)


_FAR = np.int16(1000)


def holds(item: np.ndarray, text: np.ndarray, least: int = MIN_WORDS, per: int = PER) -> bool:
    """Is some stretch of at least ``least`` words of ``item`` within one edit in ``per`` words of a
    stretch of ``text``? The stretch's first and last words must be there, so dropped words don't
    make a shorter one longer. Exact, by dynamic programming over all starts at once."""
    n, m = len(item), len(text)
    if n < least or m < least - least // per:
        return False
    ramp = np.arange(m + 1, dtype=np.int16)
    starts = np.arange(n - least + 1)
    cost = np.zeros((len(starts), m + 1), dtype=np.int16)
    differs = item[:, None] != text[None, :]
    for length in range(1, n + 1):
        alive = starts + length <= n
        if not alive.all():
            starts, cost = starts[alive], cost[alive]
            if not len(starts):
                return False
        off = differs[starts + length - 1]
        new = np.empty_like(cost)
        new[:, 0] = _FAR
        if length == 1:
            new[:, 1:] = off * _FAR
        else:
            if length >= least and ((cost[:, :-1] + off * _FAR).min(axis=1) * per <= length).any():
                return True
            np.minimum(cost[:, :-1] + off, cost[:, 1:] + 1, out=new[:, 1:])
            new = np.minimum(np.minimum.accumulate(new - ramp, axis=1) + ramp, _FAR)
        best = new.min(axis=1)
        keep = best * per <= n - starts
        if not keep.all():
            starts, new = starts[keep], new[keep]
            if not len(starts):
                return False
        cost = new
    return False


def search(items: Items, text: str | None) -> list[int]:
    """Numbers of the items the text holds."""
    return [i for _, i in search_all(items, [text])]


def _aligned(item: np.ndarray, w: np.ndarray, diag: int, a: int, b: int) -> bool:
    """The easy case of ``holds``: MIN_WORDS words of the item that lie in the text as they are,
    but for words changed in place."""
    i = max(0, a - diag)
    k = min(len(item), b - diag)
    if k - i < MIN_WORDS:
        return False
    eq = item[i:k] == w[diag + i : diag + k]
    same = np.concatenate([[0], np.cumsum(eq)])
    enough = same[MIN_WORDS:] - same[:-MIN_WORDS] >= MIN_WORDS - MIN_WORDS // PER
    return bool((enough & eq[: 1 - MIN_WORDS] & eq[MIN_WORDS - 1 :]).any())


_GAP = 64  # unknown words between texts


def search_all(items: Items, texts: list[str | None]) -> list[tuple[int, int]]:
    """(text number, item number) of the items each text holds, all texts embedded together."""
    if not len(items.hashes):
        return []
    least = MIN_WORDS - 2 * (MIN_WORDS // PER)
    get = items.ids.get
    parts, bounds, at = [], [], 0
    for t in texts:
        ws = words(t)
        bounds.append(at)
        parts.append(list(map(get, ws, repeat(0))))
        parts.append(_PAD)
        at += len(ws) + _GAP
    w = np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=at)
    begin = np.array(bounds)
    known = w > 0
    n = len(w)
    total = np.concatenate([np.zeros(1, np.int32), np.cumsum(known, dtype=np.int32)])
    # a stretch lies in or around a window of MIN_WORDS with nearly all words known
    m = n - MIN_WORDS + 1
    if m <= 0:
        return []
    dense = np.zeros(n + 1, dtype=np.int32)
    dense[1 : m + 1] = total[MIN_WORDS:] - total[:-MIN_WORDS] >= least
    dense[m + 1 :] = 0
    reach = np.cumsum(dense)[1:]
    near = reach.copy()
    near[MIN_WORDS:] -= reach[:-MIN_WORDS]
    run = np.zeros(n, dtype=bool)
    run[: n - RUN + 1] = total[RUN:] - total[:-RUN] == RUN
    starts = np.nonzero((near > 0) & run)[0]
    if not len(starts):
        return []
    h = _walk(w, starts, items.bits, items.picks).ravel()
    lo = np.searchsorted(items.hashes, h, "left")
    lo[lo == len(items.hashes)] -= 1
    hit = np.nonzero(items.hashes[lo] == h)[0]
    if not len(hit):
        return []
    lo = lo[hit]
    counts = np.searchsorted(items.hashes, h[hit], "right") - lo
    pos = np.tile(starts, WALKS)[hit]
    flat = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    which, pos = items.where[flat], np.repeat(pos, counts)
    cand = np.unique(np.stack([which, pos - items.offset[flat], pos]), axis=1)
    keep: list[np.ndarray] = []
    for a in range(0, cand.shape[1], 100_000):
        c = cand[:, a : a + 100_000]
        # around the hit, of MIN_WORDS words in a row nearly all must be the item's, wherever they stand in it
        span = np.clip(c[2][:, None] + np.arange(RUN - MIN_WORDS, MIN_WORDS)[None, :], 0, n - 1)
        own = np.cumsum(items.member[c[0][:, None], w[span]], axis=1, dtype=np.int16)
        own[:, MIN_WORDS:] -= own[:, :-MIN_WORDS].copy()
        keep.append(own.max(axis=1) >= least)
    which, diag, pos = cand[:, np.concatenate(keep)]
    doc = np.searchsorted(begin, pos, "right") - 1
    found = []
    order = np.lexsort((diag, which, doc))
    doc, which, diag = doc[order], which[order], diag[order]
    edges = np.nonzero((np.diff(doc) != 0) | (np.diff(which) != 0))[0] + 1
    for g in np.split(np.arange(len(doc)), edges):
        if not len(g):
            continue
        d, item = int(doc[g[0]]), int(which[g[0]])
        arr = items.arrays[item]
        slack = len(arr) // PER + 2
        a0, b0 = bounds[d], (bounds[d + 1] if d + 1 < len(bounds) else n) - _GAP
        ds = np.unique(diag[g])
        if any(_aligned(arr, w, int(x), a0, b0) for x in ds):
            found.append((d, item))
            continue
        for s in np.split(ds, np.nonzero(np.diff(ds) > slack)[0] + 1):
            if holds(arr, w[max(a0, int(s[0]) - slack) : min(b0, int(s[-1]) + len(arr) + slack)]):
                found.append((d, item))
                break
    return found


_PAD = [0] * _GAP


def find(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_key, item_key) of every document and item it holds.

    Null and blank texts hold nothing and are held by nothing; items of fewer than MIN_WORDS words
    can't be found. Documents delivered twice are found twice. Items may grow: they are processed
    in blocks of about ``block_chars`` characters, by the hash of their key.
    """
    spark = documents.sparkSession
    it = items.select(F.col(item_key).alias("k"), F.col(text).alias("t")).filter("t is not null and k is not null")
    size = it.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, ceil(size / block_chars))
    docs = documents.select(F.col(doc_key).alias("d"), F.col(text).alias("t")).filter(F.length("t") >= 2 * (MIN_WORDS - 2))
    schema = f"{doc_key} {dict(documents.dtypes)[doc_key]}, {item_key} {dict(items.dtypes)[item_key]}"
    out: DataFrame | None = None
    for b in range(blocks):
        rows = it.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()  # one block
        part = _pass(spark, docs, sorted((r["k"], r["t"]) for r in rows), doc_key, item_key, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _pass(spark, docs: DataFrame, rows: list[tuple], doc_key: str, item_key: str, schema: str) -> DataFrame:
    sent = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = prepare([k for k, _ in sent.value], [t for _, t in sent.value])
        for b in batches:
            keys, texts = b["d"].tolist(), b["t"].tolist()
            sizes = np.cumsum([len(t) for t in texts])
            got = []
            for c in np.split(np.arange(len(texts)), np.searchsorted(sizes, np.arange(CHUNK_CHARS, sizes[-1], CHUNK_CHARS)) if len(sizes) else []):
                if len(c):
                    got += [(keys[c[0] + d], items.keys[i]) for d, i in search_all(items, texts[c[0] : c[-1] + 1])]
            yield pd.DataFrame(got, columns=[doc_key, item_key])

    return docs.mapInPandas(run, schema)
