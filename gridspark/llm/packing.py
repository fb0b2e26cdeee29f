"""Best-fit decreasing packing of whole documents into token sequences.

Texts are tokenised in one pass, each cut into pieces of ``length`` tokens at most; only the lengths go on.  Best fit decreasing takes
pieces from the longest to the shortest and puts each into the open sequence with the least room that is enough.  Pieces of one
length are alike, and so are sequences of one remaining capacity: a segment tree over the capacities finds the tightest
one in logarithmic time, and as many alike pieces as fit into it and into the sequences like it are placed in one step.  So the
driver packs *counts* of lengths, at most ``length`` of them however large the corpus is, and gets exactly what packing piece by
piece gives.  Its steps say which pieces of a length, by their rank, go to which sequences; the executors apply them.

A rank is a piece's place among the pieces of its length in its input task, plus the pieces of that length in the tasks before.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from .common import written
from .token_count import byte_symbols
from .training_order import FOR_RUNS, PATTERN


class Step(NamedTuple):
    """Pieces of ``size`` from rank ``first`` on, ``each`` of them into one sequence after another from ``sequence`` on, at ``offset``."""

    size: int
    first: int
    pieces: int
    each: int
    sequence: int
    offset: int


class Capacities:
    """A segment tree over capacities 0..n: which of them an open sequence has left."""

    def __init__(self, n: int) -> None:
        self.leaves = 1 << n.bit_length()
        self.some = bytearray(2 * self.leaves)

    def set(self, capacity: int, some: bool) -> None:
        at = capacity + self.leaves
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def tightest(self, size: int) -> int | None:
        """The least capacity of at least ``size`` that is there."""
        at = size + self.leaves
        if self.some[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: Mapping[int, int], length: int) -> list[Step]:
    """Best-fit decreasing over ``counts`` of sizes, as steps.

    Open sequences of a capacity are kept as ranges of numbers.  A step ends a size, or a range: a size splits one range at most and
    opens two, so steps are bounded by the square of ``length`` and do not grow with the counts.
    """
    tree, open_, steps, sequences = Capacities(length), {}, [], 0

    def put(capacity: int, low: int, high: int) -> None:
        if capacity and low < high:
            found = open_.setdefault(capacity, [])
            if found and found[-1][1] == low:
                found[-1] = (found[-1][0], high)
            else:
                found.append((low, high))
            tree.set(capacity, True)

    for size in sorted(counts, reverse=True):
        first, left = 0, counts[size]
        while left:
            capacity = tree.tightest(size)
            if capacity is None:  # open as many as the rest needs
                capacity = length
                low, high = sequences, sequences - (-left // (length // size))
                sequences = high
            else:
                low, high = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
            each = capacity // size
            filled, rest = min(high - low, left // each), 0
            if filled:
                steps.append(Step(size, first, filled * each, each, low, length - capacity))
                put(capacity - each * size, low, low + filled)
            elif left:
                rest = left
                steps.append(Step(size, first, rest, rest, low, length - capacity))
                filled = 1
                put(capacity - rest * size, low, low + 1)
            placed = rest or filled * each
            first, left = first + placed, left - placed
            put(capacity, low + filled, high)
    return steps


class Places:
    """Looks up sequence and offset of pieces by their size and rank."""

    def __init__(self, steps: list[Step]) -> None:
        self.steps = np.array(sorted(steps), np.int64).reshape(-1, 6)
        self.starts = [0, *(np.flatnonzero(np.diff(self.steps[:, 0])) + 1).tolist(), len(self.steps)]
        self.of_size = {int(self.steps[a, 0]): (a, b) for a, b in zip(self.starts, self.starts[1:], strict=False) if a < b}

    def find(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(sizes), np.int64)
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            low, high = self.of_size[size]
            at[mine] = low + np.searchsorted(self.steps[low:high, 1], ranks[mine], side="right") - 1
        step = self.steps[at]
        within = ranks - step[:, 1]
        return step[:, 4] + within // step[:, 3], step[:, 5] + within % step[:, 3] * step[:, 0]


class Ids:
    """Identifiers of texts as the library of the vocabulary file gives them, without added tokens.

    Texts of Latin letters that hold no special string go through the quicker merging of the same ranks, which gives the same
    identifiers; all others through the file's own library.
    """

    _other = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-ɏ]")

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.full, self.plain = (tiktoken.Encoding("words", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, PATTERN.replace(FOR_RUNS, "")))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self._other.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        model = self.full if re.search(r"\s\s", text) else self.plain
        return model.encode_to_numpy(text, disallowed_special=()).astype("<u4")


_ids: dict[str, Ids] = {}


def pieces(docs: DataFrame, path: str, length: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, local``, written once: ``local`` counts the pieces of a length in their task, ``part``.

    A text's identifiers are followed by ``end``.  Longer ones are cut; the first piece takes what the others, all full, leave.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        if path not in _ids:
            _ids[path] = Ids(path)
        ids, part, seen = _ids[path], TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = np.append(ids.of(text), np.uint32(end)).astype("<u4")
                start, stop, piece = 0, len(found) % length or length, 0
                while start < len(found):
                    stop = min(stop, len(found))
                    size = stop - start
                    out.append((doc, piece, start, size, zlib.crc32(found[start:stop].tobytes()), part, seen[size]))
                    seen[size] += 1
                    start, stop, piece = stop, stop + length, piece + 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    found = rows.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long, part int, local long")
    return written(found.withColumn("doc_id", F.col("doc_id").cast(kind)))


def ranked(table: DataFrame) -> DataFrame:
    """``table`` with ``rank``, the place of a piece among all of its length: tasks stand one after the other.

    The offsets have a row per task and length that occurs; they are joined by both, so no length is brought together.
    """
    here = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = here.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return table.join(offsets, ["length", "part"]).withColumn("rank", F.col("local") + F.col("before")).drop("local", "before", "part")


def packed(docs: DataFrame, path: str, length: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row.

    NULL and empty texts are the end identifier alone.  Rows that repeat an id or a text are packed each for itself, a NULL id
    is a value like any other, other columns are ignored, an empty table gives an empty result.
    """
    table = pieces(docs, path, length, end, id_col, text_col)
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``length`` rows at most
    steps = table.sparkSession.sparkContext.broadcast(best_fit(counts, length))  # bounded by the square of ``length``
    rows = ranked(table)
    schema = T.StructType([*(f for f in rows.schema if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    kind, rows = rows.schema["doc_id"].dataType, rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema["doc_id"].dataType = T.StringType()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(steps.value)
        for batch in batches:
            if len(batch):
                sequence, offset = places.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
                yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    placed = rows.mapInPandas(assign, schema)
    return placed.select(F.col("doc_id").cast(kind).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
