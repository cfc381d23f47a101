"""Texts cut into pieces under a limit of tokens, at natural boundaries, with overlap.

A text is read into a tree: headings within headings, then blocks (paragraphs, tables, fenced code),
lists within lists, lines, sentences, and words. Only a node larger than the limit is opened; what
its children come to is put together from the bottom up, neighbour by neighbour, as long as it stays
under the limit. Sizes are sums over the tokenizer's pre-tokens, and cuts fall between pre-tokens
where there are any, so they are exact.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import DEFAULT_VOCABULARY, Subwords, subwords

LIMIT = 512
OVERLAP = 48

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n(?:.*\n)*?[ \t]*\1[ \t]*(?:\n|\Z)", re.MULTILINE)
_HEADING = re.compile(r"^(?:(#{1,6})[ \t]+\S[^\n]*|([^\s#>|*+-][^\n]*)\n(=+|-{3,})[ \t]*|<[hH]([1-6])\b[^\n]*)$", re.MULTILINE)
_LEVELS = (
    re.compile(r"\n[ \t]*\r?\n\s*"),  # blocks
    re.compile(r"\n([ \t]*)(?=(?:[-*+•]|\d+[.)])[ \t]+\S)"),  # list items
    re.compile(r"\n"),  # lines, table rows
    re.compile(r"(?<=[.!?…][\"')\]])\s+|(?<=[.!?…;])\s+|(?<=[。！？；])"),  # sentences
    re.compile(r"(?<=[,:、，)])\s*(?=\S)|\s+"),  # clauses and words
)


class Splitter:
    """Cuts single texts."""

    def __init__(self, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = DEFAULT_VOCABULARY):
        if limit < 1 or not 0 <= overlap < limit:
            raise ValueError("the overlap must be smaller than the limit")
        self.limit, self.overlap = limit, overlap
        self.words: Subwords = subwords(vocabulary)

    def _measure(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of pre-tokens in characters, and tokens up to each."""
        pre = self.words.split(text)
        return [0, *accumulate(map(len, pre))], [0, *accumulate(map(self.words.counts.__getitem__, pre))]

    def pieces(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(start, end, tokens, overlap) in characters and tokens; ``overlap`` counts the tokens at
        a piece's start that the piece before holds too. An empty text gives one empty piece, null
        none. A single pre-token beyond the limit is cut between characters."""
        if text is None:
            return []
        if not text:
            return [(0, 0, 0, 0)]
        total = self.words.count(text) if len(text) > self.limit else None
        if (total is not None and total <= self.limit) or (total is None and (total := self.words.count(text)) <= self.limit):
            return [(0, len(text), total, 0)]
        ends, upto = self._measure(text)
        cuts = self._cuts(text, ends, upto, self.limit - self.overlap)
        out = []
        at = 0
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            start = self._back(text, ends, upto, a, at) if a and self.overlap else a
            n = self._size(text, ends, upto, start, b)
            while n > self.limit and start < a:  # subwords may fall otherwise where a pre-token is cut
                start = min(a, start + 1 + (n - self.limit))
                n = self._size(text, ends, upto, start, b)
            out.append((start, b, n, self._size(text, ends, upto, start, a) if start < a else 0))
            at = start + 1
        return out

    def _back(self, text: str, ends: list[int], upto: list[int], cut: int, least: int) -> int:
        """Where the overlap before ``cut`` starts: whole pre-tokens as far as they fit, and inside a
        pre-token that is larger than what is left, characters. Never before ``least``: a piece holds
        less than all of the one before."""
        k = self._at.get(cut)
        room, start = self.overlap, cut
        if k is not None:
            j = bisect_left(upto, upto[k] - room, 0, k + 1)
            start, room = ends[j], room - (upto[k] - upto[j])
        if room * 2 >= self.overlap and start > least:
            first = max(least, ends[bisect_right(ends, start - 1) - 1])
            lo, step = start, 1
            while lo - step >= first and self.words.count(text[lo - step : start]) <= room:
                step *= 2
            lo = max(first, lo - step)
            while lo < start and self.words.count(text[lo:start]) > room:
                lo += max(1, (start - lo) // 16)
            start = lo
        return max(start, least)

    def _size(self, text: str, ends: list[int], upto: list[int], a: int, b: int) -> int:
        i, j = self._at.get(a), self._at.get(b)
        if i is None or j is None:
            return self.words.count(text[a:b])
        # white space at the end of a text is one pre-token, before a word it is two
        k = j
        while k > i and text[ends[k - 1] : ends[k]].isspace():
            k -= 1
        return upto[k] - upto[i] + (self.words.count(text[ends[k] : b]) if k < j else 0)

    def _cuts(self, text: str, ends: list[int], upto: list[int], budget: int) -> list[int]:
        self._at = {c: i for i, c in enumerate(ends)}

        def size(a: int, b: int) -> int:
            return upto[self._at[b]] - upto[self._at[a]]

        def snap(c: int) -> int:
            """The pre-token boundary at or before a character."""
            return ends[bisect_right(ends, c) - 1]

        def merged(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
            """Neighbours put together from left to right as long as they fit."""
            out: list[tuple[int, int, int]] = []
            for a, b, n in parts:
                if out and out[-1][2] + n <= budget:
                    out[-1] = (out[-1][0], b, out[-1][2] + n)
                else:
                    out.append((a, b, n))
            return out

        def opened(a: int, b: int, level: int) -> list[tuple[int, int, int]]:
            """An oversized node as (start, end, tokens) of its parts: its children, the oversized
            among them opened first, put together."""
            at: list[int] = []
            while not at:
                if level == len(_LEVELS):
                    return hard(a, b)
                at = sorted({snap(a + x) for x in self._parts(text[a:b], level) if 0 < x < b - a} - {a, b})
                level += not at
            below = level if level in (-1, 1) else level + 1  # headings and lists nest
            out: list[tuple[int, int, int]] = []
            for x, y in zip([a, *at], [*at, b], strict=True):
                n = size(x, y)
                out += [(x, y, n)] if n <= budget else opened(x, y, below)
            return merged(out)

        def hard(a: int, b: int) -> list[tuple[int, int, int]]:
            """No boundary is left: between pre-tokens, or inside a single oversized one."""
            i, last = self._at[a], self._at[b]
            out: list[tuple[int, int, int]] = []
            while i < last:
                j = bisect_right(upto, upto[i] + budget, i, last + 1) - 1
                if j > i:
                    out.append((ends[i], ends[j], upto[j] - upto[i]))
                    i = j
                    continue
                x, stop = ends[i], ends[i + 1]
                while x < stop:
                    step = min(stop - x, budget * 8)
                    while step > 1 and self.words.count(text[x : x + step]) > budget:
                        step = max(1, step * 7 // 8)
                    out.append((x, x + step, budget))  # nothing is put beside it
                    x += step
                i += 1
            return out

        return [a for a, _, _ in opened(0, len(text), -1)[1:]]

    @staticmethod
    def _parts(body: str, level: int) -> list[int]:
        """Where the children of a node start, at one level of the tree."""
        if level < 0:
            return Splitter._sections(body)
        found = list(_LEVELS[level].finditer(body))
        if level == 1:
            # items of the outermost list only; those inside come with their own item
            inner = [(len(m[1].expandtabs(4)), m.end(0) - len(m[1])) for m in found]
            least = min((n for n, _ in inner), default=0)
            marks = [x for n, x in inner if n == least]
        else:
            marks = [m.end() for m in found]
        if level < 3:
            fences = [m.span() for m in _FENCE.finditer(body)]
            if fences and not (len(fences) == 1 and fences[0][1] - fences[0][0] > 0.9 * len(body)):
                marks = [x for x in marks if not any(s < x < e for s, e in fences)] + [x for f in fences for x in f]
        return marks

    @staticmethod
    def _sections(body: str) -> list[int]:
        """Starts of the sections of the highest heading level in use."""
        fences = [m.span() for m in _FENCE.finditer(body)]
        heads = []
        for m in _HEADING.finditer(body):
            if any(s <= m.start() < e for s, e in fences):
                continue
            level = len(m[1]) if m[1] else (1 if m[3] and m[3][0] == "=" else 2 if m[3] else int(m[4]))
            heads.append((level, m.start()))
        inner = [h for h in heads if h[1] > 0]
        top = min((lv for lv, _ in inner), default=0)
        return [p for lv, p in inner if lv == top]


def split(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, piece, start_char, end_char, tokens, overlap_tokens, piece_text) of every text; those
    within the limit come as they are. Null texts give no row, empty ones one empty piece."""
    df = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")
    cols = [key, "piece", "start_char", "end_char", "tokens", "overlap_tokens", "piece_text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Splitter(limit, overlap, vocabulary)
        for b in batches:
            rows = [(k, i, a, e, n, o, t[a:e]) for k, t in zip(b["k"], b["t"], strict=True) for i, (a, e, n, o) in enumerate(s.pieces(t))]
            yield pd.DataFrame(rows, columns=cols)

    return df.mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, piece int, start_char int, end_char int, tokens int, overlap_tokens int, piece_text string")
