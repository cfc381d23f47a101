"""Packing whole texts into containers of a fixed number of tokens by the sum-of-squares rule.

Let N(g) be the number of open containers with g tokens of room. A text goes where the sum of
N(g) squared over all g is smallest afterwards: into an open container or a new one. Texts are
packed in groups dealt by the hash of their key, largest first; only keys and sizes are moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import DEFAULT_VOCABULARY, subwords
from graphloom.session import Scratch

CAPACITY = 2048
#: Tokens packed by one task; the room left open at a group's end is at most a few containers.
GROUP_TOKENS = 40_000_000


class SumOfSquares:
    """Places sizes one by one; at most ``capacity`` each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, dtype=np.int64)  # open containers by filled tokens; 0 and capacity stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """The container for a text of ``size`` tokens (1 to capacity)."""
        c, n = self.capacity, self.n
        # change of the sum for each level it could be added to; a full container no longer counts
        levels = np.nonzero(n[1 : c - size + 1])[0] + 1
        best, at = (2 * int(n[size]) + 1 if size < c else 0), 0
        if len(levels):
            after = np.where(levels + size == c, -1, 2 * n[levels + size] + 1)
            change = -2 * n[levels] + 1 + after
            change[levels + size == c] = -2 * n[levels[levels + size == c]] + 1
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal changes the fullest
            if change[k] <= best:
                best, at = int(change[k]), int(levels[k])
        if at:
            box = self.open[at].pop()
            n[at] -= 1
        else:
            box = self.made
            self.made += 1
        if at + size < c:
            self.open[at + size].append(box)
            n[at + size] += 1
        return box


def pack_sizes(sizes: list[int], capacity: int) -> list[int]:
    """Container of each size, larger sizes first, ties in the given order."""
    s = SumOfSquares(capacity)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = s.place(sizes[i])
    return out


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, tokens): the size of every text; null and empty texts have 0."""
    df = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = subwords(vocabulary).count
        for b in batches:
            yield pd.DataFrame({key: b["k"], "tokens": [count(t) if isinstance(t, str) else 0 for t in b["t"]]})

    return df.mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, tokens long")


def pack(documents: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(key, piece, first_token, tokens, container): every text in one container, or, if larger than
    one, as full pieces and a rest.

    Null and empty texts take no room: piece 0, 0 tokens, container null. Repeated texts are packed
    each on its own. Containers are named group-number; equal inputs give equal packings.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = documents.sparkSession
    sizes, _ = Scratch(spark, "packing").write(sized(documents, key, text, vocabulary), "sizes")
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, ceil(total / group_tokens))
    full = F.floor(F.col("tokens") / capacity)
    pieces = sizes.filter("tokens > 0").select(key, "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity))).alias("piece"))
    pieces = pieces.select(key, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("tokens"))
    kind = dict(documents.dtypes)[key]
    schema = f"{key} {kind}, piece int, first_token long, tokens long, container string"

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(part)
        if not rows:
            return
        b = pd.concat(rows).sort_values(["tokens", key, "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        for g, x in b.groupby("__g", sort=True):
            s = SumOfSquares(capacity)
            yield x.drop(columns="__g").assign(container=[f"{g}-{s.place(n)}" for n in x["tokens"].tolist()])

    dealt = pieces.withColumn("__g", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).repartitionById(groups, F.col("__g"))
    empty = sizes.filter("tokens = 0").select(key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), F.col("tokens"), F.lit(None).cast("string").alias("container"))
    return dealt.mapInPandas(run, schema).unionByName(empty)
