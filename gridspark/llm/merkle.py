"""Merkle manifest of a dataset: a tree per source, a tree over the sources' roots, and proofs of single documents.

A node is the SHA-256 (hexadecimal) of its up to ``FANOUT`` children's digests.  Leaves of a tree are numbered in order and
cut into aligned blocks of ``BLOCK`` leaves.  A builder takes a block's leaves in order and appends each node to a log as
soon as its last child is there, so nodes stand in postorder and one open run per level is all that it holds.  The place of
a node follows from the sizes of the subtrees before it (:func:`postorder`), so a proof looks its siblings up by arithmetic;
there is no index.  The roots of a tree's blocks are the leaves of the next round, until each tree has one block.  Paths come
back the other way: a block's path above itself is the path of its root as a leaf of the next round.

Texts never leave their input task: only ids and digests are shuffled.  A builder or a proof task holds one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import LOWER, UPPER, written

FANOUT = 16
#: Levels and leaves of a whole block.
LEVELS = 3
BLOCK = FANOUT ** LEVELS
#: Columns whose values a leaf is made of.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 over each value as ``-`` if NULL, else its UTF-8 byte count, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def node(digests: str) -> str:
    """A node's digest from the joined digests of its children."""
    return hashlib.sha256(digests.encode("ascii")).hexdigest()


def widths(leaves: int, levels: int | None = None) -> list[int]:
    """Nodes at each level of a tree, leaves first; up to its root, or to a given level."""
    found = [leaves]
    while (found[-1] > 1) if levels is None else (len(found) <= levels):
        found.append(-(-found[-1] // FANOUT))
    return found


def postorder(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder of a tree: the nodes that are complete before its first leaf, and its own subtree."""
    first = index * FANOUT ** level
    place, size = first, 1
    while size <= first:
        size *= FANOUT
        place += first // size
    under = min(FANOUT ** level, leaves - first)
    return place + sum(-(-under // FANOUT ** n) for n in range(level + 1)) - 1


class Log:
    """Appends nodes in the order in which they are complete."""

    def __init__(self) -> None:
        self.nodes, self.open, self.leaves = [], [[]], 0

    def add(self, digest: str) -> None:
        self.leaves += 1
        self._put(0, digest)

    def _put(self, level: int, digest: str) -> None:
        self.nodes.append(digest)
        if len(self.open) == level:
            self.open.append([])
        self.open[level].append(digest)
        if len(self.open[level]) == FANOUT and level < LEVELS:
            run = self.open[level]
            self.open[level] = []
            self._put(level + 1, node("".join(run)))

    def close(self, whole: bool) -> bytes:
        """The log, after runs that are not full are closed; up to the level of a whole block, or until one node is left."""
        top = LEVELS if whole else len(widths(self.leaves)) - 1
        for level in range(top):
            if level < len(self.open) and self.open[level]:
                run, self.open[level] = self.open[level], []
                self._put(level + 1, node("".join(run)))
        return bytes.fromhex("".join(self.nodes))


def _numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``index``, the place of a row in its tree: rows are dealt by ranges of tree and order, and counted from the start of their range.

    Only a range's first tree can have begun in an earlier one, so the table of offsets has a row per range at most.
    """
    spread = leaves.repartitionByRange(F.col("tree").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order))
    spread = spread.sortWithinPartitions(F.col("tree").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)).drop(*(c for c in order if c.startswith("_")))
    fields = [f for f in spread.schema if f.name != "part"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at, n = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            index = []
            for tree in batch["tree"]:
                if at != (tree,):
                    at, n = (tree,), 0
                index.append(n)
                n += 1
            yield batch.assign(part=part, local=index)

    schema = T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    table = written(spread.mapInPandas(count, schema))
    here = table.groupBy("tree", "part").agg(F.max("local").alias("last"))
    before = F.sum(F.col("last") + 1).over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = here.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), before.alias("before")).filter("before > 0")
    same = (F.col("part") == F.col("_part")) & F.col("tree").eqNullSafe(F.col("_tree"))
    placed = table.join(F.broadcast(offsets), same, "left")  # one row per range at most
    return placed.withColumn("index", F.col("local") + F.coalesce("before", F.lit(0))).drop("part", "local", "before", "_part", "_tree")


def _built(leaves: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``tree, block, n, log, root`` of ``leaves(tree, index, digest)``, each block with its leaves' ``extra`` columns as arrays in order."""
    spread = leaves.withColumn("block", F.floor(F.col("index") / BLOCK))
    spread = spread.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, log, kept = None, None, {}

        def done() -> pd.DataFrame:
            tree, block = at
            whole = block > 0 or log.leaves == BLOCK
            nodes = log.close(whole)
            return pd.DataFrame([{"tree": tree, "block": block, "n": log.leaves, "log": nodes, "root": nodes[-32:].hex(), **kept}])

        for batch in batches:
            for tree, block, digest, *values in batch[["tree", "block", "digest", *extra]].itertuples(index=False, name=None):
                if at != (tree, block):
                    if at:
                        yield done()
                    at, log, kept = (tree, block), Log(), {c: [] for c in extra}
                log.add(digest)
                for c, v in zip(extra, values, strict=True):
                    kept[c].append(v)
        if at:
            yield done()

    return written(spread.mapInPandas(build, "tree string, block long, n int, log binary, root string" + "".join(f", {c} array<string>" for c in extra)))


def runs(log: bytes, leaves: int, levels: int) -> list[list[str]]:
    """For each level below the top, the joined digests of each run of siblings, looked up by their closed-form places."""
    hexes, found = log.hex(), []
    for level, width in enumerate(widths(leaves, levels)[:levels]):
        at = [64 * postorder(level, i, leaves) for i in range(width)]
        found.append(["".join(hexes[p:p + 64] for p in at[i:i + FANOUT]) for i in range(0, width, FANOUT)])
    return found


def _levels(block: int, n: int) -> int:
    return LEVELS if block > 0 or n == BLOCK else len(widths(n)) - 1


def steps(found: list[list[str]], index: int) -> list[tuple[str, str]]:
    """A leaf's siblings before and after its branch at each level."""
    out = []
    for level in found:
        run, place = divmod(index, FANOUT)
        out.append((level[run][:64 * place], level[run][64 * (place + 1):]))
        index = run
    return out


def fold(digest: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a digest and its siblings give."""
    for before, after in path:
        digest = node(before + digest + after)
    return digest


#: A path as a column: the siblings before and after a branch, level by level.
PATH = "array<struct<before: string, after: string>>"


def _paths(blocks: DataFrame) -> DataFrame:
    """``tree, index, path`` of each leaf of ``blocks``, whose own paths are in ``above``."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, block, n, log, above in batch[["tree", "block", "n", "log", "above"]].itertuples(index=False, name=None):
                found, rest = runs(log, n, _levels(block, n)), [] if above is None else [(s["before"], s["after"]) for s in above]
                for low in range(0, n, 256):
                    some = range(low, min(n, low + 256))
                    yield pd.DataFrame({"tree": tree, "index": [block * BLOCK + i for i in some],
                                        "path": [[{"before": b, "after": a} for b, a in steps(found, i) + rest] for i in some]})

    return blocks.mapInPandas(find, f"tree string, index long, path {PATH}")


def _with_paths(blocks: DataFrame, upper: DataFrame | None) -> DataFrame:
    """``blocks`` with the path ``above`` each of them."""
    if upper is None:
        return blocks.withColumn("above", F.lit(None).cast(PATH))
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("index"))
    return blocks.join(upper.select(F.col("tree").alias("_tree"), "index", F.col("path").alias("above")), same, "left").drop("_tree", "index")


class Forest:
    """The logs of all trees of ``leaves(tree, index, digest, ...)``, round by round; every round's table is written."""

    def __init__(self, leaves: DataFrame, extra: Sequence[str] = ()) -> None:
        self.rounds = [_built(leaves, extra)]
        while not (more := self.rounds[-1].filter("block > 0")).isEmpty():
            large = more.select(F.col("tree").alias("_tree")).distinct()
            roots = self.rounds[-1].join(large, F.col("tree").eqNullSafe(F.col("_tree")), "left_semi")
            self.rounds.append(_built(roots.select("tree", F.col("block").alias("index"), F.col("root").alias("digest"))))

    def roots(self) -> DataFrame:
        """``tree, root``: a tree's root is in the last round that it took part in."""
        found = None
        for n, blocks in enumerate(self.rounds):
            one = blocks.groupBy("tree").agg(F.count("*").alias("blocks"), F.max("root").alias("root")).filter("blocks = 1").select("tree", "root")
            found = one if found is None else found.union(one)
        return found

    def with_paths(self, above: DataFrame | None = None) -> DataFrame:
        """The blocks of the first round with the path above each, which goes on with the path of its tree, ``above(tree, path)``."""
        upper, tops = None, None if above is None else above.select(F.col("tree").alias("_top"), F.col("path").alias("_rest"))
        for n in reversed(range(len(self.rounds))):
            blocks = _with_paths(self.rounds[n], upper)
            if tops is not None:  # a tree's only block is where the tree ends
                only = F.col("tree").eqNullSafe(F.col("_top")) & F.col("above").isNull()
                blocks = blocks.join(tops, only, "left").withColumn("above", F.coalesce("above", "_rest")).drop("_top", "_rest")
            upper = _paths(blocks) if n else None
        return blocks


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: Sequence[str] = LEAF_COLUMNS, text_col: str = "text",
             tampered: Column | None = None) -> DataFrame:
    """``id, source, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    Per source, leaves stand by id, NULL ids first, and rows that share an id by digest.  Sources stand by their bytes, NULL
    first.  ``proof_sha256`` is the SHA-256 of all siblings up to the root.  ``folded_root`` is computed from the leaf again, where
    ``tampered`` holds from the leaf of the text with A-Z lower-cased, and ``verified`` tells whether it is the root.  NULL and
    empty values and repeated rows are leaves like any other, an empty table gives an empty result, and columns that are
    not named are ignored.  Rows that agree in source, id and all values are interchangeable.
    """
    col = lambda c: F.col(f"`{c}`")
    changed = F.translate(col(text_col), UPPER, LOWER)
    wrong = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(col(source_col).cast("string").alias("tree"), col(id_col).alias("_id"), col(id_col).cast("string").alias("id"), leaf_digest([col(c) for c in columns]).alias("digest"),
                         F.when(wrong, leaf_digest([changed if c == text_col else col(c) for c in columns])).alias("other"))
    forest = Forest(_numbered(written(leaves), ("_id", "digest")), ("id", "other"))
    subroots = written(forest.roots())
    top = Forest(_numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")), ("source",)), ("source",))
    found = top.roots().first()
    root = found["root"] if found else ""
    blocks = forest.with_paths(_tops(top.with_paths()))

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, block, n, log, subroot, ids, others, above in batch[["tree", "block", "n", "log", "subroot", "id", "other", "above"]].itertuples(index=False, name=None):
                found, rest = runs(log, n, _levels(block, n)), [] if above is None else [(s["before"], s["after"]) for s in above]
                after, out = {}, []
                for i in range(n):
                    run = i // FANOUT
                    if run not in after:  # the siblings above its run are the same for all leaves of a run
                        upper = steps(found[1:], run) + rest if found else rest
                        after = {run: (upper, "".join(b + a for b, a in upper))}
                    upper, joined = after[run]
                    first = steps(found[:1], i)
                    p = 32 * postorder(0, i, n)
                    leaf = log[p:p + 32].hex()
                    folded = fold(leaf if others[i] is None else others[i], first + upper)
                    out.append((ids[i], tree, leaf, subroot, node("".join(b + a for b, a in first) + joined), folded))
                yield pd.DataFrame(out, columns=["id", "source", "leaf", "subroot", "proof_sha256", "folded_root"])

    named = subroots.select(F.col("tree").alias("_tree"), F.col("root").alias("subroot"))
    blocks = blocks.join(named, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    rows = blocks.mapInPandas(prove, "id string, source string, leaf string, subroot string, proof_sha256 string, folded_root string")
    kind = docs.select(col(id_col)).schema[0].dataType
    return rows.select(F.col("id").cast(kind).alias("id"), "source", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                       (F.col("folded_root") == root).alias("verified"))


def _tops(blocks: DataFrame) -> DataFrame:
    """``tree, path`` of each source, from the blocks of the tree over the sources."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, n, log, sources, above in batch[["block", "n", "log", "source", "above"]].itertuples(index=False, name=None):
                found, rest = runs(log, n, _levels(block, n)), [] if above is None else [(s["before"], s["after"]) for s in above]
                yield pd.DataFrame({"tree": list(sources), "path": [[{"before": b, "after": a} for b, a in steps(found, i) + rest] for i in range(n)]})

    return blocks.mapInPandas(find, f"tree string, path {PATH}")


def manifest_sql(columns: Sequence[str] = LEAF_COLUMNS, tampered: str = "false") -> str:
    """The same as DuckDB SQL over ``documents``; ``tampered`` is a condition in SQL."""
    value = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    digest = lambda text: "sha256(concat(" + ", ".join(value(text if c == "text" else c) for c in columns) + "))"
    climb = """select {tree}, lvl + 1 as lvl, i // 16 as i, sha256(string_agg(h, '' order by i)) as h, (n + 15) // 16 as n
  from {up} where n > 1 group by {tree}, lvl, i // 16, n"""
    return f"""
with recursive leaf as (select doc_id, source, {digest('text')} as leaf,
   case when {tampered} then {digest(f"translate(text, '{UPPER}', '{LOWER}')")} end as other from documents),
 numbered as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from leaf),
 up as (select source, 0 as lvl, i, leaf as h, count(*) over (partition by source) as n from numbered union all {climb.format(tree='source', up='up')}),
 subroots as (select source, h as subroot, lvl as height from up where n = 1),
 tops as (select 1 as tree, 0 as lvl, row_number() over (order by source nulls first) - 1 as i, subroot as h, count(*) over () as n, source from subroots),
 top as (select tree, lvl, i, h, n from tops union all {climb.format(tree='tree', up='top')}),
 rooted as (select h as root, lvl as top_height from top where n = 1),
 nodes as (select source, false as upper, lvl, i, h from up where n > 1 union all select null, true, lvl, i, h from top where n > 1),
 walk as (select d.source, d.i as leaf_i, false as upper, s.lvl, d.i // cast(pow(16, s.lvl) as bigint) as i, s.lvl as step
    from numbered d join subroots h on d.source is not distinct from h.source, range(0, 64) s(lvl) where s.lvl < h.height
  union all select d.source, d.i, true, s.lvl, t.i // cast(pow(16, s.lvl) as bigint), h.height + s.lvl
    from numbered d join subroots h on d.source is not distinct from h.source join tops t on d.source is not distinct from t.source, rooted,
    range(0, 64) s(lvl) where s.lvl < top_height),
 beside as (select w.source, w.leaf_i, w.step, coalesce(string_agg(n.h, '' order by n.i) filter (n.i < w.i), '') as before,
   coalesce(string_agg(n.h, '' order by n.i) filter (n.i > w.i), '') as after
  from walk w join nodes n on w.upper = n.upper and (w.upper or w.source is not distinct from n.source) and w.lvl = n.lvl and w.i // 16 = n.i // 16
  group by w.source, w.leaf_i, w.step),
 proofs as (select source, leaf_i, sha256(string_agg(before || after, '' order by step)) as proof_sha256, max(step) + 1 as steps from beside group by source, leaf_i),
 folded as (select source, i, 0 as step, coalesce(other, leaf) as h from numbered
  union all select f.source, f.i, f.step + 1, sha256(b.before || f.h || b.after) from folded f join beside b
    on f.source is not distinct from b.source and f.i = b.leaf_i and f.step = b.step),
 ends as (select source, i, arg_max(h, step) as folded_root from folded group by source, i)
select d.doc_id, d.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = r.root as verified
from numbered d join subroots s on d.source is not distinct from s.source join ends e on d.source is not distinct from e.source and d.i = e.i
 left join proofs p on d.source is not distinct from p.source and d.i = p.leaf_i, rooted r
"""
