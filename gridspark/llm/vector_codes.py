"""Product codes of vectors, learned in whole numbers, with nearest entries found by LAESA pivots.

Each vector is cut into parts; a part's code is the index of the nearest of its position's entries.  The first entries of a
position are its fixed *pivots*: the distances from every part to them are computed once, in the pass that turns components
into whole numbers, and stored beside the vector.  A round then needs the distances between pivots and entries only, a small
table made on the driver: by the triangle inequality an entry is no nearer than the difference of its and the part's distance
to any pivot.  Entries are tried in order of that bound; an exact whole-number distance is computed while the bound does
not exceed the least one found, so results are those of trying all entries, ties included.

A round sends counts and sums of each entry, combined in each task and then by Spark; the driver gets ``PARTS * ENTRIES`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Pivots of a position, of its first entries.
PIVOTS = 4
#: A bound computed from rounded distances may be too large by this share of them.
SLACK = 1e-9
#: Whole numbers from here on are no component: sums of them would not fit into Spark's decimals.
LARGEST = 1 << 62


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit numbers where sums of squared differences fit into these, else as Python's whole numbers."""
    width = max(a.shape[-1] for a in arrays)
    limit = int((2.0 ** 61 / max(width, 1)) ** 0.5) // 2
    small = all(a.size == 0 or max(int(a.max()), -int(a.min())) < limit for a in arrays)
    return [a.astype(np.int64 if small else object) for a in arrays]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, exact."""
    a, b = _exact(a, b)
    difference = a - b
    return (difference * difference).sum(axis=-1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each row of ``a`` to each row of ``b``."""
    return np.sqrt(np.stack([squared(a, row) for row in b], axis=-1).astype(np.float64)) if len(b) else np.zeros((len(a), 0))


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray, tried: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, the lowest of several, and the squared distance; ``tried`` gets the number of exact distances."""
    between = distances(pivots, entries)
    bound = np.zeros((len(parts), len(entries)))
    for p in range(len(pivots)):
        of_part = to_pivots[:, p, None]
        np.maximum(bound, np.abs(of_part - between[p]) - SLACK * (of_part + between[p]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    bound *= bound * (1 - SLACK)
    parts, entries = _exact(parts, entries)
    best = np.full(len(parts), -1, np.int64)
    least = np.zeros(len(parts), parts.dtype)
    limit = np.full(len(parts), np.inf)
    rows = np.arange(len(parts))
    for step in range(len(entries)):
        rows = rows[bound[rows, step] <= limit[rows]]  # bounds grow from step to step
        if not len(rows):
            break
        entry = order[rows, step]
        found = squared(parts[rows], entries[entry])
        if tried is not None:
            tried.append(len(rows))
        old, low = best[rows], least[rows]
        better = (old < 0) | (found < low) | ((found == low) & (entry < old))
        changed = rows[better]
        best[changed], least[changed] = entry[better], found[better]
        limit[changed] = least[changed].astype(np.float64) * (1 + SLACK)
    return best, least


class Codebooks:
    """Entries of each position, and the pivots among which they began."""

    def __init__(self, vectors: list[np.ndarray], width: int) -> None:
        stacked = np.stack(vectors).reshape(len(vectors), PARTS, width) if vectors else np.zeros((0, PARTS, width), np.int64)
        self.entries = [stacked[:, p, :].copy() for p in range(PARTS)]
        self.pivots = [e[:PIVOTS].copy() for e in self.entries]
        self.width = width

    def assign(self, vectors: np.ndarray, to_pivots: np.ndarray, tried: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances, a column per part, of vectors (n, parts, width)."""
        found = [nearest(vectors[:, p, :], to_pivots[:, p, :], self.entries[p], self.pivots[p], tried) for p in range(PARTS)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.reshape(-1)).encode("ascii")).hexdigest()


def _read(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    numbers, to_pivots = (b"".join(batch.column(c).to_pylist()) for c in ("numbers", "to_pivots"))
    vectors = np.frombuffer(numbers, "<i8").reshape(batch.num_rows, PARTS, books.width)
    return vectors, np.frombuffer(to_pivots, "<f8").reshape(batch.num_rows, PARTS, len(books.pivots[0]))


def _usual_length(vectors: DataFrame, vector_col: str) -> int:
    """The most frequent length of a vector that can be cut into parts, the least of several; 0 if there is none."""
    n = F.size(F.col(f"`{vector_col}`"))
    found = vectors.select(n.alias("n")).filter((F.col("n") > 0) & (F.col("n") % PARTS == 0)).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def _first(vectors: DataFrame, id_col: str, vector_col: str, length: int) -> list[np.ndarray]:
    """The whole numbers of the kept rows with the smallest ids; rows of one id stand by their components, and NULL ids do not count."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    unfit = F.exists(vector, lambda v: v.isNull() | ~(F.abs(v * SCALE) < LARGEST))  # NaN is larger than any number
    rows = vectors.filter(F.col(f"`{id_col}`").isNotNull() & (F.size(vector) == length) & ~unfit)
    found = rows.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v")).orderBy("id", "v").limit(ENTRIES).collect()
    return [np.floor(np.array(r["v"], np.float64) * SCALE).astype(np.int64) for r in found]


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, books: Codebooks) -> DataFrame:
    """``vec_id, label, numbers, to_pivots`` of the kept rows, written once: this pass computes all distances to pivots."""
    length = PARTS * books.width

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            sized = np.flatnonzero((np.diff(offsets) == length) & ~column.is_null().to_numpy(zero_copy_only=False))
            block = values[(offsets[sized][:, None] + np.arange(length)).reshape(-1)].astype(np.float64).reshape(len(sized), length)  # a NULL is NaN
            with np.errstate(over="ignore"):
                scaled = np.floor(block * SCALE)
            fits = (np.abs(scaled) < LARGEST).all(axis=1)
            whole = scaled[fits].astype(np.int64).reshape(-1, PARTS, books.width)
            far = np.stack([distances(whole[:, p, :], books.pivots[p]) for p in range(PARTS)], axis=1)
            rows = pa.array(sized[fits])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("label").take(rows),
                                              pa.array([w.astype("<i8").tobytes() for w in whole], pa.binary()), pa.array([f.astype("<f8").tobytes() for f in far], pa.binary())],
                                             ["vec_id", "label", "numbers", "to_pivots"])

    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return written(rows.mapInArrow(prepare, f"vec_id {kinds['vec_id']}, label {kinds['label']}, numbers binary, to_pivots binary"))


def _renewed(table: DataFrame, books: Codebooks) -> None:
    """One round: replace each entry that parts are nearest to by the floor of their mean."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            vectors, to_pivots = _read(batch, books)
            index, _ = books.assign(vectors, to_pivots)
            for p in range(PARTS):
                part = vectors[:, p, :] if np.abs(vectors[:, p, :]).max(initial=0) < LARGEST // len(vectors) else vectors[:, p, :].astype(object)
                for e in np.unique(index[:, p]).tolist():
                    mine = index[:, p] == e
                    key = (p, e)
                    count[key] = count.get(key, 0) + int(mine.sum())
                    total[key] = total.get(key, 0) + part[mine].sum(axis=0).astype(object)
        rows = [{"part": p, "entry": e, "place": i, "n": count[p, e], "total": str(v)} for (p, e), t in total.items() for i, v in enumerate(t)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))

    partial = table.select("numbers", "to_pivots").mapInArrow(sums, "part int, entry int, place int, n long, total string")
    found = partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    for r in found:
        books.entries[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of the rows that are kept.

    Rows go whose vector is NULL or has a NULL, a non-finite component or one beyond 2^50, or another length than the usual
    one: the most frequent that can be cut into ``PARTS`` equal parts.  Repeated rows and ids are coded each for itself; of them
    the ones with the least components come first where entries begin.  With fewer rows than ``ENTRIES`` codebooks are
    smaller.  NULL labels are one label; an error that does not fit into a long is NULL.  Other columns are ignored, an empty
    table gives an empty result.
    """
    length = _usual_length(vectors, vector_col)
    books = Codebooks(_first(vectors, id_col, vector_col, length) if length else [], length // PARTS)
    if not len(books.entries[0]):
        return vectors.limit(0).select(F.col(f"`{id_col}`").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                       F.lit(0).cast("long").alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))
    table = _prepared(vectors, id_col, vector_col, label_col, books)
    for _ in range(ROUNDS):
        _renewed(table, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, error = books.assign(*_read(batch, books))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([bytes(r).hex() for r in index.astype(np.uint8)], pa.string()),
                                              pa.array([str(e) for e in error.sum(axis=1)], pa.string())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    coded = written(table.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error string").withColumn("error", F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    fits = lambda c: F.expr(f"try_cast({c} as bigint)").alias(c)
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", fits("error"), fits("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))


def vector_codes_sql(length: int = 64) -> str:
    """The same as DuckDB SQL over ``embeddings`` whose vectors have ``length`` components."""
    width = length // PARTS
    near = """a{r} as materialized (select vec_id, part, entry, d from (select vec_id, part, entry, d, row_number() over (partition by vec_id, part order by d, entry) as k
  from (select v.vec_id, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{r} c on v.part = c.part and v.place = c.place group by all)) where k = 1)"""
    renew = """c{s} as materialized (select c.part, c.entry, c.place, coalesce(m.x, c.x) as x from c{r} c left join (
   select v.part, a.entry, v.place, cast(sum(v.x) as hugeint) as t, count(*) as n, case when t >= 0 then t // n else -((-t + n - 1) // n) end as x
   from v join a{r} a on v.vec_id = a.vec_id and v.part = a.part group by v.part, a.entry, v.place) m
  on c.part = m.part and c.entry = m.entry and c.place = m.place)"""
    rounds = ",\n ".join(f"{near.format(r=r)},\n {renew.format(r=r, s=r + 1)}" for r in range(ROUNDS))
    return f"""
with kept as materialized (select vec_id, label, list_transform(embedding, lambda e: cast(floor({SCALE} * cast(e as double)) as bigint)) as xs from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
 v as materialized (select vec_id, (i - 1) // {width} as part, (i - 1) % {width} as place, xs[i] as x from kept, range(1, {length + 1}) r(i)),
 starts as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {ENTRIES}),
 c0 as materialized (select v.part, s.entry, v.place, v.x from v join starts s on v.vec_id = s.vec_id),
 {rounds},
 {near.format(r=ROUNDS)},
 coded as (select a.vec_id, k.label, string_agg(printf('%02x', a.entry), '' order by part) as code, cast(sum(d) as bigint) as error
  from a{ROUNDS} a join kept k on a.vec_id = k.vec_id group by a.vec_id, k.label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
 (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, place)) from c{ROUNDS}) as codebooks_sha256
from coded
"""
