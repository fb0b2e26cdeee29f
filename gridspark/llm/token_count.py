"""Token counts by byte-pair merging with a heap and a linked list; no token identifiers are made.

The text is cut into pre-tokens by the byte-level pattern.  A pre-token starts as one symbol per UTF-8 byte; the
adjacent pair of lowest rank (leftmost among equals) is popped from a heap and merged in a doubly linked list until no
ranked pair is left.  Its count is the initial symbols minus the merges.  Counts of words and pre-tokens are kept in
bounded tables per Python worker, since words repeat.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The byte-level pre-token pattern. White space is Unicode's White_Space property, spelled out.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|["
            + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+")

#: A blank before white space: the cut at blanks is not exact there.
BLANK_PAIRS = tuple(" " + chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Words and pre-tokens whose counts a worker keeps, and the length beyond which one is counted but not kept.
KEPT, KEPT_CHARS = 300_000, 64
#: Texts longer than this are scanned match by match instead of into a list.
LIST_CHARS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return [table[b] for b in range(256)]


def load_ranks(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Merge ranks and the added tokens' strings of a byte-level BPE file."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return {(a, b): rank for rank, (a, b) in enumerate(merges)}, [t["content"] for t in spec.get("added_tokens", [])]


def merged_count(data: bytes, ranks: dict[tuple[str, str], int], symbols: list[str]) -> int:
    """Symbols left of ``data`` when no adjacent pair has a rank."""
    part = [symbols[b] for b in data]
    n = len(part)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((part[i], part[i + 1]))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        rank, i = heappop(heap)
        j = right[i]
        if part[i] is None or j >= n or ranks.get((part[i], part[j])) != rank:
            continue  # one of the two symbols has been merged meanwhile
        part[i] += part[j]
        part[j] = None
        merges += 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (rank := ranks.get((part[i], part[k]))) is not None:
                heappush(heap, (rank, i))
        if (h := left[i]) >= 0 and (rank := ranks.get((part[h], part[i]))) is not None:
            heappush(heap, (rank, h))
    return n - merges


class Kept(dict):
    """Text to count, by ``count`` where missing; forgets all when full."""

    def __init__(self, count: Callable[[str], int]) -> None:
        self.of = count

    def __missing__(self, text: str) -> int:
        n = self.of(text)
        if len(text) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[text] = n
        return n


class Counter:
    """Counts texts under one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.ranks, special = load_ranks(path)
        self.symbols = byte_symbols()
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PRETOKEN)
        self.pretokens, self.words = Kept(self._merged), Kept(self._pretokens)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        total = start = 0
        for m in self.special.finditer(text):  # an added token's string is one token and ends the text before it
            total += 1 + self._plain(text[start:m.start()])
            start = m.end()
        return total + self._plain(text[start:] if start else text)

    def _merged(self, pretoken: str) -> int:
        return merged_count(pretoken.encode("utf-8", "surrogatepass"), self.ranks, self.symbols)

    def _pretokens(self, text: str) -> int:
        return sum(map(self.pretokens.__getitem__, self.find.findall(text)))

    def _plain(self, text: str) -> int:
        """A blank before anything but white space always begins a pre-token, so a text may be cut there."""
        if len(text) > LIST_CHARS:
            return sum(self.pretokens[m.group()] for m in self.find.finditer(text))
        if text.endswith(" ") or any(map(text.__contains__, BLANK_PAIRS)):
            return self._pretokens(text)
        first, *rest = text.split(" ")
        return self.words[first] + sum(map(self.words.__getitem__, map(" ".__add__, rest)))


_counters: dict[str, Counter] = {}


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a text column under the byte-level BPE file at ``path`` (readable on every executor)."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _counters:
            _counters[path] = Counter(path)
        counter = _counters[path]
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, in one pass and without a shuffle.

    NULL and empty texts have no tokens.  Repeated rows and ids are counted each for itself, other columns are ignored,
    an empty table gives an empty result.
    """
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
                          token_count(F.col(text_col), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
