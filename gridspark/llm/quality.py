"""Quality rules: base counts of a text and compression bands.

A text that says the same thing again and again compresses too well, and random characters hardly compress at all.
Zstandard ratios (bytes over compressed bytes) are taken of the whole text and of fixed chunks of it, and each must lie
in a band that depends on the length, because short inputs compress less and small samples vary more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_word = re.compile(WORD)


@dataclass(frozen=True)
class Bands:
    """``whole``: (bytes from, least ratio, greatest ratio), the last row that applies holds; likewise ``chunk``.

    A text fails if its own ratio is outside the band of its length, or if more than ``bad_share`` of its chunks are
    outside the band of theirs.  Texts and chunks shorter than the first row's length have no band.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (256, 1.10, 4.5), (1024, 1.25, 6.0), (4096, 1.40, 8.0), (16384, 1.50, 9.0), (65536, 1.50, 10.0))
    chunk: tuple[tuple[int, float, float], ...] = ((1024, 1.20, 7.0), (4096, 1.35, 9.0))
    chunk_bytes: int = 4096
    bad_share: float = 0.5
    level: int = 3


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found twice or more in the text, the first included.

    Windows are compared exactly: numbers stand for words, then for runs of 2, 4, ... words.
    """
    n = len(words)
    if n <= window:
        return 0
    ids: dict[str, int] = {}
    runs = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    size = 1
    while size < window:
        pairs = runs[:-size] << 32 | runs[size:]
        distinct, runs = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0  # no run of this size is found twice, so no longer one is
        size *= 2
    starts = np.flatnonzero(np.bincount(runs)[runs] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _word.findall(text)
    lines = [line for line in text.split("\n") if _word.search(line)] if "\n" in text else []
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def in_band(n: int, ratio: float, bands: tuple[tuple[int, float, float], ...]) -> bool:
    least, most = next(((lo, hi) for start, lo, hi in reversed(bands) if n >= start), (0.0, float("inf")))
    return least <= ratio <= most


def compression(data: bytes, compressor: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, int, int, bool]:
    """Ratio of the whole (0 if empty), number of chunks, chunks out of band, and the verdict."""
    if not data:
        return 0.0, 0, 0, True
    ratio = len(data) / len(compressor.compress(data))
    chunks = bad = 0
    if len(data) > bands.chunk_bytes:
        for start in range(0, len(data), bands.chunk_bytes):
            chunk = data[start:start + bands.chunk_bytes]
            chunks += 1
            bad += not in_band(len(chunk), len(chunk) / len(compressor.compress(chunk)), bands.chunk)
    return ratio, chunks, bad, in_band(len(data), ratio, bands.whole) and bad <= bands.bad_share * chunks


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "ratio double, n_chunks long, n_bad_chunks long, in_bands boolean")


def quality(text: Column, bands: Bands = Bands()) -> Column:
    """A struct of :data:`RESULT` for a text column."""

    @F.pandas_udf(RESULT)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        names = [field.split()[0] for field in RESULT.split(", ")]
        for texts in batches:
            yield pd.DataFrame([base_counts(t) + compression((t or "").encode("utf-8", "surrogatepass"), compressor, bands) for t in texts], columns=names)

    return measured(text)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(),
                  least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Base counts, ratios and verdict of every row, in one pass and without a shuffle.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeated`` % of them in repeated windows.  ``kept``:
    not ``base_failed`` and inside the compression bands.  NULL and empty texts have no words and fail; repeated rows and
    ids are judged each for itself, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), quality(F.col(text_col), bands).alias("q")).select("doc_id", "q.*")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("in_bands"))
