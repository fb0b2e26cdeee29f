"""Training-order materialisation: packed token sequences in a keyed pseudo-random order, as fixed-stride shards.

Documents stand in the order of a hash of their id and text, so the corpus is one stream of tokens that depends on its
rows and on nothing else: not on files, partitions or cores.  Texts are tokenised once, into a table.  Running sums over
its narrow columns (hash, id, count), dealt into ``BINS`` ranges of the hash, give each document its place in the stream.
The stream is cut into sequences of equal length; a Feistel permutation of [0, n), keyed by a seed, turns a sequence's
number into a global slot.  Its domain is the next power of four, and a value outside [0, n) is permuted again until it
falls inside (cycle walking), so the order needs no shuffle buffer and no table of positions.  Each document's tokens are
cut where sequences end and sent to the shards of their slots, those that go from one task to one shard as one
compressed block; only that shuffle carries tokens.  Slots are dealt by ranges, and each range is written as a shard of
fixed-stride binary records (a task writes a run of consecutive shards, one after the other, so shuffle partitions do not
grow with the number of shards): slot ``s`` is record ``s mod per_shard`` of shard ``s div per_shard``, so a reader starts
again at any slot with one seek.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import tiktoken
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch, written

#: The byte-level pre-token pattern, and the part of it that only matters for runs of white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOR_RUNS = r"|\s+(?!\S)"
ROUNDS = 6
#: Ranges of the hash that orders the documents: the driver gets one row of each.
BINS = 1 << 12
#: Bytes of tokens that a task gathers before it sends blocks to the shards.
GATHERED = 32 << 20
#: Tokens of the consecutive shards that one task writes, where there are more than the session's shuffle partitions would take.
RANGE = 1 << 31
#: Folders at most that the places of rows are dealt into, by the task that tokenised them.
FOLDERS = 1 << 12
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit function of each element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def permuted(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slot of each index in [0, n): a permutation of [0, n) for every key."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = _U((1 << half) - 1), _U(half)
    keys = _mixed(_mixed(np.arange(1, rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) ^ _U(key & (2 ** 64 - 1)))
    out = index.astype(_U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


_run = re.compile(r"\s\s")


class Tokens:
    """Identifiers of texts under one vocabulary, which has to have less than 2^16 of them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.full, self.plain = (tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
                                 for pattern in (PATTERN, PATTERN.replace(FOR_RUNS, "")))
        self.end = len(ranks)
        if self.end >= 1 << 16:
            raise ValueError("identifiers do not fit into 16 bits")

    def of(self, text: str | None) -> np.ndarray:
        """Unsigned 16-bit little-endian identifiers. Without runs of white space the pattern needs no look-ahead, which is quicker."""
        model = self.full if text and _run.search(text) else self.plain
        return model.encode_to_numpy(text or "", disallowed_special=()).astype("<u2")


_tokens: dict[str, Tokens] = {}


def _vocabulary(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def tokenised(text: Column, path: str) -> Column:
    """Struct of a text's identifiers (unsigned 16-bit little-endian) with the end identifier after them, and their number; both empty without any."""

    @F.pandas_udf("tokens binary, n long")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = _vocabulary(path)
        end = tokens.end.to_bytes(2, "little")
        for texts in batches:
            data = [ids.tobytes() + end if len(ids) else b"" for ids in map(tokens.of, texts)]
            yield pd.DataFrame({"tokens": data, "n": np.array([len(d) // 2 for d in data], np.int64)})

    return found(text)


def tokens_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bin, hash, id, row, n, tokens`` of the rows with a token, written once; ``row`` is the partition and the place in it."""
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("hash"), F.col(id_col).cast("string").alias("id"), F.monotonically_increasing_id().alias("row"), tokenised(text, path).alias("r"))
    table = rows.select(F.shiftrightunsigned("hash", 64 - BINS.bit_length() + 1).alias("bin"), "hash", "id", "row", "r.n", "r.tokens").filter("n > 0")
    to = scratch(spark)
    table.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(to)
    return spark.read.schema(table.schema).parquet(to)


def place(table: DataFrame) -> tuple[DataFrame, int]:
    """``part, row, start`` for each row of :func:`tokens_table`, and the tokens of all: ``start`` is where its tokens begin in the stream.

    Rows stand in the order of their hash, then of their id; where rows are repeated it does not matter which stands first.
    """
    bins = dict(table.groupBy("bin").agg(F.sum("n")).collect())  # BINS rows at most
    before, total = {}, 0
    for at in sorted(bins):
        before[at], total = total, total + bins[at]
    starts = table.sparkSession.createDataFrame(list(before.items()), "bin long, before long")
    running = F.sum("n").over(W.partitionBy("bin").orderBy("hash", "id", "row").rowsBetween(W.unboundedPreceding, -1))
    placed = table.select("bin", "hash", "id", "row", "n").withColumn("start", F.coalesce(running, F.lit(0))).join(F.broadcast(starts), "bin")
    return placed.select(F.shiftright("row", 33).alias("part"), "row", (F.col("start") + F.col("before")).alias("start")), total


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _places_of(path: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that one task has tokenised, in order, and where their tokens begin."""
    fs, base = _open(f"{path}/folder={part % FOLDERS}")
    files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet")]
    mine = [("part", "=", part)]  # rows stand by part, so other row groups are not read
    found = pa.concat_tables([pyarrow.parquet.read_table(f, columns=["row", "start"], filesystem=fs, partitioning=None, filters=mine) for f in files]).sort_by("row")
    return found["row"].to_numpy(), found["start"].to_numpy()


#: A piece of a sequence: its slot and number, the place of its first token in the sequence, and how many it has.
PIECE = np.dtype([("slot", "<i8"), ("sequence", "<i8"), ("start", "<i4"), ("n", "<i4")])


def blocks(table: DataFrame, places: str, total: int, key: int, length: int = 2048, per_shard: int = 4096) -> DataFrame:
    """``shard, pieces, tokens``: what a task has for a shard, as an array of ``PIECE`` and the compressed tokens of these pieces.

    ``places`` is the path of the table made by :func:`place`, by partition.
    """
    n = -(-total // length)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, known, starts = None, None, None
        found, data, size = [], [], 0

        def sent() -> pd.DataFrame:
            pieces = np.array(found, PIECE)
            pieces["slot"] = permuted(pieces["sequence"], n, key)
            shard = pieces["slot"] // per_shard
            order = np.lexsort((pieces["start"], pieces["slot"]))
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            packer = zstandard.ZstdCompressor(level=3)
            groups = np.split(order, cuts)
            out = pd.DataFrame({"shard": [shard[g[0]] for g in groups], "pieces": [pieces[g].tobytes() for g in groups],
                                "tokens": [packer.compress(b"".join(data[i] for i in g)) for g in groups]})
            found.clear()
            data.clear()
            return out

        for batch in batches:
            for row, tokens in zip(batch["row"].tolist(), batch["tokens"], strict=True):
                if row >> 33 != part:
                    part = row >> 33
                    known, starts = _places_of(places, part)
                start, tokens = int(starts[np.searchsorted(known, row)]), memoryview(tokens)
                while len(tokens):
                    sequence, offset = divmod(start, length)
                    piece, tokens = bytes(tokens[:2 * (length - offset)]), tokens[2 * (length - offset):]
                    found.append((0, sequence, offset, len(piece) // 2))
                    data.append(piece)
                    start, size = start + len(piece) // 2, size + len(piece)
                    if size >= GATHERED:
                        yield sent()
                        size = 0
        if found:
            yield sent()

    return table.select("row", "tokens").mapInPandas(cut, "shard long, pieces binary, tokens binary")


def _file(path: str, shard: int) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, base = _open(path)
    return fs, f"{base}/shard-{shard:08d}.bin"


def _writer(path: str, total: int, end: int, length: int, per_shard: int):
    """Over blocks sorted by shard: writes each shard under a name of its own first, so that a task that runs twice leaves whole files only."""
    n = -(-total // length)

    def write(shard: int, pieces: list[bytes], tokens: list[bytes]) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        found = np.concatenate([np.frombuffer(p, PIECE) for p in pieces])
        data = np.frombuffer(b"".join(map(unpack.decompress, tokens)), "<u2")
        slots = np.arange(shard * per_shard, min(n, (shard + 1) * per_shard))
        records = np.full(len(slots) * length, end, "<u2")
        to = (found["slot"] - slots[0]) * length + found["start"]
        ends = np.cumsum(found["n"])
        if len(data) != len(records) - (total < n * length and (found["sequence"] == n - 1).any()) * (n * length - total):
            raise RuntimeError(f"shard {shard} is not whole")
        for at, size, stop in zip(to.tolist(), found["n"].tolist(), ends.tolist(), strict=True):
            records[at:at + size] = data[stop - size:stop]
        fs, name = _file(path, shard)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        own = f"{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(records)
        fs.move(own, name)
        sequence = np.zeros(len(slots), np.int64)
        sequence[found["slot"] - slots[0]] = found["sequence"]
        return pd.DataFrame({"slot": slots, "shard": shard, "sequence": sequence, "n_tokens": np.where(sequence == n - 1, total - (n - 1) * length, length),
                             "sha256": [hashlib.sha256(r).hexdigest() for r in records.reshape(-1, length)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pieces, tokens = None, [], []
        for batch in batches:
            for shard, piece, token in zip(batch["shard"].tolist(), batch["pieces"], batch["tokens"], strict=True):
                if shard != at and pieces:
                    yield write(at, pieces, tokens)
                    pieces, tokens = [], []
                at = shard
                pieces.append(bytes(piece))
                tokens.append(bytes(token))
        if pieces:
            yield write(at, pieces, tokens)

    return run


def materialise(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, per_shard: int = 4096,
                key: int = 42) -> DataFrame:
    """Write the shards below ``path`` (a folder that all executors share) and return the index of their records.

    One row per sequence: ``slot, shard, byte_offset, n_tokens, sequence, sha256, path``.  Files are written once, by this call, and the index
    is a table; a task holds one shard at a time.  Every text with a token is followed by the end identifier (the first free one);
    the last sequence is filled up with it, ``n_tokens`` counts the ones before that.  NULL and empty texts add nothing,
    repeated rows are packed as often as they occur, a NULL id is a value like any other; other columns are ignored.  An empty
    table writes nothing and gives an empty result.  The same rows, key and lengths give the same shards in any partitioning.
    """
    table = tokens_table(docs, vocabulary, id_col, text_col)
    found, total = place(table)
    places = scratch(docs.sparkSession)
    dealt = found.withColumn("folder", F.col("part") % FOLDERS).repartition("folder").sortWithinPartitions("folder", "part", "row")
    dealt.write.option("parquet.block.size", 8 << 20).partitionBy("folder").parquet(places)
    shards = max(1, -(-total // (length * per_shard)))
    ranges = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE)))
    run = F.expr(f"cast(shard * {ranges} div {shards} as int)")
    ordered = blocks(table, places, total, key, length, per_shard).repartitionById(ranges, run).sortWithinPartitions("shard")
    index = written(ordered.mapInPandas(_writer(path, total, _vocabulary(vocabulary).end, length, per_shard), "slot long, shard long, sequence long, n_tokens int, sha256 string"))
    return index.select("slot", "shard", (F.col("slot") % per_shard * (2 * length)).alias("byte_offset"), "n_tokens", "sequence", "sha256",
                        F.concat(F.lit(f"{path}/shard-"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit(".bin")).alias("path"))


def read_from(path: str, slot: int, length: int = 2048, per_shard: int = 4096) -> Iterator[np.ndarray]:
    """Sequences in training order from ``slot`` on, one seek and then sequential reads."""
    shard, skip = divmod(slot, per_shard)
    while True:
        fs, name = _file(path, shard)
        if fs.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
            return
        with fs.open_input_file(name) as file:
            file.seek(skip * 2 * length)
            while record := file.read(2 * length):
                yield np.frombuffer(record, "<u2")
        shard, skip = shard + 1, 0
