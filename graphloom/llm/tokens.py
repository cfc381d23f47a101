"""Public tokenizers: counts of subwords, with a cache per pre-token.

The vocabulary's path is a parameter. A byte-level BPE never merges across its pre-tokens, so a
text's count is the sum of its pre-tokens' counts, and a text cut between pre-tokens has exactly
the sum of its parts.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text of ASCII characters only, for the faster engine.
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


#: And for text in which letters and digits are all that Python's own classes take them for.
_WIDE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")


class _Counts(dict):
    LIMIT = 400_000

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, pre: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        v = self[pre] = len(self.encoding.encode_ordinary(pre))
        return v


class Subwords:
    """Counts subwords under one vocabulary file."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._any = regex.compile(PATTERN)
        self._odd = regex.compile(r"[\p{Nl}\p{No}\p{M}\x1c-\x1f\x85\u180e\u200b-\u200d]")
        self.counts = _Counts(self.encoding)

    def split(self, text: str) -> list[str]:
        """Pre-tokens; they tile the text."""
        if text.isascii():
            return _ASCII.findall(text)
        return (self._any if self._odd.search(text) else _WIDE).findall(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.counts.__getitem__, self.split(text)))


@lru_cache(maxsize=4)
def subwords(path: str = DEFAULT_VOCABULARY) -> Subwords:
    """One instance per Python worker and vocabulary."""
    return Subwords(path)
