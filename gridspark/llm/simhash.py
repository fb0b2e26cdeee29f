"""SimHash near-duplicates: exact tiled comparison with exclusive-or and bit counts.

Texts become 64-bit fingerprints; equal fingerprints become one node.  Nodes are dealt into tiles by their population
counts: the bits are cut into ``sections`` and a tile holds the fingerprints with the same count in every section.
Flipping one bit moves one count by one, so two tiles whose counts differ by more than the radius in sum cannot hold a
link, and only pairs of tiles within the radius meet.  A large tile is cut into parts of about ``TILE`` fingerprints;
each part is held in memory while the fingerprints of its neighbour tiles stream past in sorted order, so a task's
memory does not depend on the input.  Below some ten million fingerprints a tile is one part, and what is shuffled is in
proportion to them; beyond, each visitor goes to every part of a tile.  A part reports a spanning forest of what it links and not every pair, which
loses no connection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, written
from .components import components

SEED, SHINGLE = 42, 3
#: Fingerprints of one part of a tile; those of it, and of its visitors, that are compared at once.
TILE, HELD, STRIP = 1 << 16, 4096, 512
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint over word shingles, repeats included; zero without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    hash_, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return hash_(join(words), seed)
    runs, n, ones = zip(*(words[i:] for i in range(shingle)), strict=False), len(words) - shingle + 1, np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        size = min(BLOCK, n - start)
        hashes = np.fromiter((hash_(join(next(runs)), seed) for _ in range(size)), np.dtype("<u8"), size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """Signed 64-bit fingerprint of a text column."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return hashed(text)


def neighbour_steps(sections: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of section counts within the radius, one of each pair of opposites, without zero."""
    steps = (s for s in product(range(-radius, radius + 1), repeat=sections) if sum(map(abs, s)) <= radius)
    return [s for s in steps if s > (0,) * sections]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _linked(radius: int):
    """Over rows sorted by (tile, part, visitor): links of each part's own fingerprints and of its visitors."""

    def strip_links(own: np.ndarray, ids: np.ndarray, parent: np.ndarray, at: int, prints: np.ndarray, names: np.ndarray, out: list) -> np.ndarray:
        near = np.bitwise_count(own[at:at + HELD, None] ^ prints[None, :]) <= radius
        if not near.any():
            return parent
        hit = near.any(axis=0)
        first = near.argmax(axis=0) + at
        out.append((names[hit], ids[first[hit]]))
        i, j = np.nonzero(near)
        i += at
        ties = np.unique(np.stack([parent[i], parent[first[j]]]), axis=1)
        extra = []
        for a, b in ties[:, ties[0] != ties[1]].T:  # own fingerprints that share this visitor
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                extra.append((ids[a], ids[b]))
        if extra:
            out.append(tuple(np.array(extra, np.int64).T))
        return _roots(parent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, ids, parent, held = None, None, None, None, []
        for batch in batches:
            out: list = []
            cols = [batch[c].to_numpy() for c in ("tile", "part", "visitor", "fp", "node")]
            group = cols[0].astype(np.int64) << 32 | cols[1]
            cuts = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(cols[2]) != 0)) + 1), len(group)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if group[lo] != at:
                    at, held, own = group[lo], [], None
                prints, names = cols[3][lo:hi].view(np.uint64), cols[4][lo:hi]
                if not cols[2][lo]:  # the part's own, perhaps over several batches
                    held.append((prints, names))
                    own = np.concatenate([h[0] for h in held])
                    ids = np.concatenate([h[1] for h in held])
                    parent = np.arange(len(own))
                elif own is None:
                    continue  # visitors of a tile that does not exist
                for s, o in product(range(0, hi - lo, STRIP), range(0, len(own), HELD)):
                    parent = strip_links(own, ids, parent, o, prints[s:s + STRIP], names[s:s + STRIP], out)
            if out:
                links = pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})
                yield links[links.a != links.b].drop_duplicates()

    return run


def fingerprint_links(nodes: DataFrame, radius: int = 2, sections: int = 4, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` between ``nodes(node, fp)`` of distinct fingerprints: a spanning forest of all pairs within ``radius`` bits."""
    width = 64 // sections
    if width * sections != 64:
        raise ValueError("sections must divide 64")
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << width) - 1)).cast("int") for i in range(sections)]
    base = width + 3  # room for a count and a step beyond either end; tiles are at most base ** sections
    place = [base ** i for i in range(sections)]
    tiled = nodes.withColumn("tile", sum(((c + 1) * p for c, p in zip(counts, place, strict=True)), F.lit(0)).cast("int"))
    parts = (tiled.groupBy("tile").count()
             .select("tile", F.ceil(F.col("count") / tile).cast("int").alias("parts")))
    steps = [sum(d * p for d, p in zip(s, place, strict=True)) for s in neighbour_steps(sections, radius)]
    home = F.array(*(F.lit(s) for s in [0, *steps]))
    visits = tiled.select("node", "fp", F.pmod(F.xxhash64("fp"), F.lit(1 << 30)).cast("int").alias("spread"),
                          F.col("tile").alias("from"), F.explode(home).alias("step")).withColumn("tile", F.col("from") + F.col("step"))
    # at most (width + 1) ** sections rows, whatever the input: 83,521 for four sections
    placed = visits.join(F.broadcast(parts), "tile").withColumn("own", F.pmod("spread", "parts"))
    dealt = placed.withColumn("part", F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.when(F.col("step") == 0, F.sequence(F.lit(0), F.col("own"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    rows = dealt.select("tile", F.explode("part").alias("part"), "step", "own", "fp", "node").select(
        "tile", "part", ((F.col("step") != 0) | (F.col("own") != F.col("part"))).alias("visitor"), "fp", "node")
    return (rows.repartition("tile", "part").sortWithinPartitions("tile", "part", "visitor")
            .mapInPandas(_linked(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = SHINGLE,
                    sections: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; ``component_id`` is the least id reachable over links.

    Two rows link when their fingerprints differ in ``radius`` bits or fewer.  Texts without a word (NULL, empty, blanks)
    have fingerprint zero and link like any other.  Texts of up to ``shingle`` words hash as a whole.  Rows that repeat an
    id keep one row each; a NULL id has the component of its fingerprint's least id, or NULL where there is none.  An
    empty table gives an empty result; other columns are ignored.
    """
    prints = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), simhash(F.col(text_col), shingle).alias("fp")))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(fingerprint_links(nodes.filter("node is not null"), radius, sections))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


# --- similar texts: tiles of fingerprints that agree in some bits, exclusive-or and bit counts inside them, exact similarity decides ---

#: 64-bit words of a long fingerprint; the first so many of them travel to the tiles, bits of the others say to which.
WORDS, NARROW = 16, 2
_U = np.uint64
#: Least chance that fingerprints which differ in as many bits as expected share a tile.
REACH = 0.9993
#: Sets of fewer shingles differ in up to a quarter more bits than larger ones (four shingles of five: 3/16 of them, where 0.15 is expected).
FEW = 64
#: Members of a tile that are compared in one task; tiles have half of them on average, larger ones are cut, see :func:`_tiles`.
FULL = 4096
#: Shingles of the sets that are held in memory together, see :func:`_grouped`; a pair of larger sets is held whatever its size.
HOLD = 1 << 21


def _further(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` well-mixed hashes for each hash."""
    x = hashes[:, None] + np.arange(1, WORDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """Sorted distinct unsigned hashes of a text's word shingles; a shorter text is one shingle, a text without a word has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both know ASCII only
    if not words:
        return np.zeros(0, "<u8")
    hash_, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else iter([words])
    return np.unique(np.fromiter((hash_(join(r), seed) for r in runs), np.dtype("<u8")))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` unsigned words over a shingle set: a bit is set in over half of the hashes; zero for the empty set."""
    ones = np.zeros(64 * WORDS, np.int64)
    for start in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(_further(hashes[start:start + BLOCK]).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def differing_share(similarity: float) -> float:
    """Share of differing bits that is expected between sets of a Jaccard similarity: their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float, words: int = WORDS, few: bool = False) -> int:
    """Differing bits beyond which texts are not held against each other: those expected and three standard errors (four for the narrow fingerprint)."""
    n, share = 64 * words, min(0.5, differing_share(similarity) * (1.25 if few else 1))
    return math.floor(n * share + (3 if words == WORDS else 4) * math.sqrt(n * share * (1 - share)))


def tile_bits(nodes: int, full: int = FULL) -> int:
    """Bits that the fingerprints of a tile agree in, so that tiles hold ``full / 2`` of ``nodes`` on average; none for few nodes, which all meet."""
    return max(0, math.ceil(math.log2(max(1, nodes) / (full / 2))))


def deals(similarity: float, bits: int) -> int:
    """How often fingerprints are dealt into tiles, each time by other bits, so that similar ones meet."""
    if not bits:
        return 1
    return math.ceil(math.log(1 - REACH) / math.log(1 - (1 - differing_share(similarity)) ** bits))


def tile_keys(words: np.ndarray, bits: int, times: int) -> np.ndarray:
    """The tiles of long fingerprints (a row each), one for each time they are dealt: its number and the bits sampled for it."""
    ones = np.unpackbits(np.ascontiguousarray(words[:, NARROW:]).view(np.uint8), axis=1, bitorder="little")
    place = 1 << np.arange(bits, dtype=np.int64)
    sampled = (np.random.default_rng([SEED, t]).choice(ones.shape[1], bits, replace=False) for t in range(times))
    return np.stack([(t << bits) + ones[:, at] @ place for t, at in enumerate(sampled)], axis=1)


def band_keys(hashes: np.ndarray, bits: int = 8, similarity: float = 0.8) -> np.ndarray:
    """The tiles of a shingle set."""
    return tile_keys(long_fingerprint(hashes)[None], bits, deals(similarity, bits))[0]


def sketch(text: Column, shingle: int) -> Column:
    """Struct of the hash of a text's whole shingle set, its size and its long fingerprint."""

    @F.pandas_udf("node long, n int, words binary")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, shingle) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"node": nodes, "n": np.array([len(s) for s in sets], np.int32), "words": [long_fingerprint(s).tobytes() for s in sets]})

    return sketched(text)


def _unpacked(words: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(words), "<u8").reshape(-1, WORDS)


def _within(bits: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float, words: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles whose fingerprints differ in ``bits`` may be as similar as ``similarity``."""
    small = np.minimum(n, m)
    return (bits <= np.where(small < FEW, most_bits(similarity, words, True), most_bits(similarity, words))) & (small >= similarity * np.maximum(n, m))


def _apart(words: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Differing bits of one fingerprint to others, -1 if they cannot be as similar as ``similarity``."""
    bits = np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64)
    bits[~_within(bits, n[others], n[i], similarity, words.shape[1])] = -1
    return bits


def _near(words: np.ndarray, n: np.ndarray, root: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of different roots that may be similar: all pairs by exclusive-or and bit counts, a strip at a time."""
    most, columns = most_bits(similarity, words.shape[1], True), [np.ascontiguousarray(c) for c in words.T]
    count = np.uint8 if words.shape[1] < 4 else np.uint16
    for start in range(0, len(n), STRIP):
        bits = sum(np.bitwise_count(c[start:start + STRIP, None] ^ c[None, start:]).astype(count, copy=False) for c in columns)
        i, j = np.nonzero(bits <= most)
        found = bits[i, j]
        i, j = i + start, j + start
        near = (i < j) & (root[i] != root[j]) & _within(found, n[i], n[j], similarity, words.shape[1])
        yield i[near], j[near]


def _meeting(words: np.ndarray, n: np.ndarray, root: np.ndarray, similarity: float) -> np.ndarray:
    """Members that may be similar to one of another root."""
    out = np.zeros(len(n), bool)
    for i, j in _near(words, n, root, similarity):
        out[i] = out[j] = True
    return np.flatnonzero(out)


def _forest(words: np.ndarray, n: np.ndarray, root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may be similar, the nearest first; members of one root are together already."""
    size = len(n)
    best, parent, todo, out = np.full(size, 1 << 30, np.int64), np.full(size, -1), np.ones(size, bool), []
    while todo.any():
        rest = np.flatnonzero(todo)
        v = rest[best[rest].argmin()]
        if best[v] not in (-1, 1 << 30):
            out.append((int(parent[v]), int(v)))
        todo[v] = False
        rest = rest[rest != v]
        if len(rest):
            bits = _apart(words, n, v, rest, similarity)
            bits[bits < 0] = 1 << 30
            bits[root[rest] == root[v]] = -1
            nearer = bits < best[rest]
            best[rest[nearer]], parent[rest[nearer]] = bits[nearer], v
    return out


def _connected(near: np.ndarray) -> Iterator[np.ndarray]:
    """The members of each component of a symmetric table of pairs, neighbours one after the other; none for members without a pair."""
    todo = near.any(axis=0)
    while todo.any():
        reached = [np.array([todo.argmax()])]
        while len(reached[-1]):
            todo[reached[-1]] = False
            reached.append(np.flatnonzero(near[reached[-1]].any(axis=0) & todo))
        yield np.concatenate(reached)


def _by(key: str, columns: tuple[str, ...], done, schema: str):
    """For ``mapInPandas`` over rows sorted by ``key``: ``done(key, *arrays)`` of each key's rows gives the arrays of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def result(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
            return done(at, *(np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*parts, strict=True)))

        def table(found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            return pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*found, strict=True), strict=True)})

        at, held = None, []
        for batch in batches:
            keys, arrays = batch[key].to_numpy(), [batch[c].to_numpy() for c in columns]
            cuts, found = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    if held and keys[lo] != at:
                        found.append(result(held))
                        held = []
                    at = keys[lo]
                    held.append([c[lo:hi] for c in arrays])
            if found:
                yield table(found)
        if held:
            yield table([result(held)])

    return run


def _each(rows: DataFrame, key: str, columns: tuple[str, ...], done, schema: str) -> DataFrame:
    """``done`` over the rows of each ``key``, a key in one task, see :func:`_by`."""
    return rows.repartition(key).sortWithinPartitions(key).mapInPandas(_by(key, columns, done, schema), schema)


def _proposed(units: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs ``a < b`` to look at first, a forest in each of ``units(unit, node, root, n, words...)``."""
    def done(_, node: np.ndarray, root: np.ndarray, n: np.ndarray, *words: np.ndarray) -> tuple[np.ndarray, ...]:
        words = np.stack(words, axis=1).view(np.uint64)
        at = _meeting(words, n, root, similarity)
        ends = node[at][np.array(_forest(words[at], n[at], root[at], similarity), np.int64).reshape(-1, 2)]
        return ends.min(axis=1, initial=2 ** 63 - 1), ends.max(axis=1, initial=-2 ** 63)

    return _each(units, "unit", ("node", "root", "n", *_SHORT), done, "a long, b long").distinct()


def _unsettled(units: DataFrame, similarity: float) -> DataFrame:
    """``unit, node`` of the members that may, by their narrow fingerprints, be similar to one of another root in their unit."""
    def done(unit: int, node: np.ndarray, root: np.ndarray, n: np.ndarray, *words: np.ndarray) -> tuple[np.ndarray, ...]:
        found = node[_meeting(np.stack(words, axis=1).view(np.uint64), n, root, similarity)]
        return np.full(len(found), unit), found

    return _each(units, "unit", ("node", "root", "n", *_SHORT), done, "unit long, node long")


def _groups(node: np.ndarray, n: np.ndarray, near: np.ndarray, hold: int) -> list[np.ndarray]:
    """Members to hold against each other so that each pair of ``near`` meets: components, or parts of a large one two by two."""
    out = []
    for some in _connected(near):
        if n[some].sum() <= hold:
            out.append(some)
            continue
        part = (np.cumsum(n[some]) - n[some]) // (hold // 2)
        parts = [some[part == p] for p in np.unique(part)]
        for k, one in enumerate(parts):
            for other in parts[k:]:
                both = one if other is one else np.concatenate([one, other])
                pairs = near[np.ix_(one, other)]
                if pairs.any():
                    out.append(both[near[np.ix_(both, both)].any(axis=1)])
    return out


def _grouped(units: DataFrame, similarity: float, bits: int, hold: int) -> DataFrame:
    """Distinct ``group, node``: of ``units(unit, node, root, n, words)`` the members whose whole sets are to be held against each other.

    A pair is looked at in the first tile that it shares.  Groups hold some ``hold`` shingles at most, or two members.
    """
    def done(unit: int, node: np.ndarray, root: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        words, near = _unpacked(words), np.zeros((len(node), len(node)), bool)
        before = int(unit) >> bits  # parts of large tiles have numbers below zero
        keys = tile_keys(words, bits, before).T if before > 0 else ()
        for i, j in _near(words, n, root, similarity):
            met = np.zeros(len(i), bool)
            for k in keys:
                met |= k[i] == k[j]
            near[i[~met], j[~met]] = near[j[~met], i[~met]] = True
        found = [np.sort(node[some]) for some in _groups(node, n, near, hold)]
        names = np.array([xxhash.xxh64_intdigest(some.tobytes(), SEED) for some in found], np.uint64).view(np.int64)
        return np.repeat(names, [len(some) for some in found]), np.concatenate([node[:0], *found])

    return _each(units, "unit", ("node", "root", "n", "words"), done, "group long, node long").distinct()


def _joined(root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets that are similar, as many as connect the roots that such pairs connect."""
    n, out = np.array([len(s) for s in sets]), []
    starts, codes = np.cumsum(n) - n, np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, label = np.zeros(codes.max() + 1, np.uint8), np.unique(root, return_inverse=True)[1]
    for i in range(len(n) - 1):
        rest, m = label[i + 1:], n[i + 1:]
        able = (rest != label[i]) & (np.minimum(m, n[i]) >= similarity * np.maximum(m, n[i]))
        if not able.any():
            continue
        own = codes[starts[i]:starts[i] + n[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes[starts[i + 1]:]], starts[i + 1:] - starts[i + 1], dtype=np.int64)
        mark[own] = 0
        for j in (np.flatnonzero(able & (common >= similarity * (m + n[i] - common))) + i + 1).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _settled(groups: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` between the roots of each of ``groups(group, node, root, set)``, by whole sets; fewer than a group has members."""
    def done(_, node: np.ndarray, root: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, ...]:
        pairs = np.array(_joined(root, [np.frombuffer(s, "<u8") for s in sets], similarity), np.int64).reshape(-1, 2)
        return node[pairs[:, 0]], node[pairs[:, 1]]

    return _each(groups, "group", ("node", "root", "set"), done, "a long, b long")


#: Columns of the narrow fingerprint.
_SHORT = [f"w{i}" for i in range(NARROW)]


def _shortened(words: Column) -> Column:
    """Struct of the narrow fingerprint's words; exclusive-or and bit counts do not mind their byte order."""
    word = lambda i: F.conv(F.hex(F.substring(words, 8 * i + 1, 8)), 16, -10).cast("long")
    return F.struct(*(word(i).alias(c) for i, c in enumerate(_SHORT)))


def _dealt(nodes: DataFrame, bits: int, similarity: float, *columns: str) -> DataFrame:
    """``unit`` and ``columns`` of each fingerprint in each of its tiles."""

    @F.pandas_udf("array<long>")
    def tiles(words: pd.Series) -> pd.Series:
        return pd.Series(list(tile_keys(_unpacked(words), bits, deals(similarity, bits))))

    return nodes.select(*columns, F.explode(tiles("words")).alias("unit"))


def _close(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose long fingerprints are near enough to be looked at."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        bits = np.bitwise_count(_unpacked(a) ^ _unpacked(b)).sum(axis=1, dtype=np.int64)
        return pd.Series(_within(bits, n.to_numpy(), m.to_numpy(), similarity, WORDS))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("words").alias(f"words_{c}")).hint("merge")
    return written(pairs.join(side("a"), "a").join(side("b"), "b").filter(near("words_a", "words_b", "n_a", "n_b")).select("a", "b"))


def _sets(texts: DataFrame, asked: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """``node, set`` of the distinct nodes ``needed(node)``, their whole shingle sets; ``asked(node, key)`` names a text of each by its hash."""

    @F.pandas_udf("binary")
    def whole(found: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).tobytes() for t in found])

    named = asked.join(needed, "node", "left_semi").hint("merge")
    return written(texts.join(named, "key").dropDuplicates(["node"]).select("node", whole("text").alias("set")))


def _verified(pairs: DataFrame, texts: DataFrame, asked: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``a, b, similar`` of distinct pairs of nodes by their whole shingle sets, see :func:`_sets`."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common >= similarity * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    sets = _sets(texts, asked, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle)
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")).hint("merge"), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")).hint("merge"), "b"))
    return written(both.select("a", "b", similar("set_a", "set_b").alias("similar")))


def _parts(large: DataFrame, check, full: int) -> tuple[DataFrame, DataFrame]:
    """``unit, node`` of the members of tiles of over ``full`` members, units below zero, and links found on the way.

    All members are held against one that has most of them near it, of three drawn, so that a group of near copies costs as many comparisons
    as it has members; the others, which are *open*, then meet each other and the rest part by part, two parts to a unit.
    """
    drawn = [F.min(F.struct(F.xxhash64(F.lit(i), "node"), "node"))["node"] for i in range(3)]
    heads = large.groupBy("unit").agg(F.array_distinct(F.array(*drawn)).alias("leaders")).select("unit", F.explode("leaders").alias("leader"))
    led = large.join(heads, "unit")
    near = check(written(led.filter("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()))
    links = near.filter("similar").select("a", "b")
    both = links.union(links.select("b", "a")).select(F.col("a").alias("leader"), F.col("b").alias("node"), F.lit(True).alias("near"))
    marks = written(led.join(both, ["leader", "node"], "left"))
    chosen = marks.groupBy("unit", "leader").agg(F.count("near").alias("near")).groupBy("unit").agg(F.max_by("leader", F.struct("near", "leader")).alias("leader"))
    marks = written(marks.join(chosen, ["unit", "leader"]).select("unit", "node", (F.col("near").isNull() & (F.col("node") != F.col("leader"))).alias("open")))
    half = full // 2
    sizes = marks.groupBy("unit").agg(F.ceil(F.count_if("open") / half).cast("int").alias("opens"), F.ceil(F.count_if(~F.col("open")) / half).cast("int").alias("nears"))
    dealt = marks.join(sizes.filter("opens > 0"), "unit").withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("open"), F.col("opens")).otherwise(F.col("nears"))).cast("int"))
    other = F.when(F.col("open"), F.sequence(F.lit(0), F.col("opens") + F.col("nears") - 1)).otherwise(F.sequence(F.lit(0), F.col("opens") - 1))
    met = dealt.withColumn("part", F.when(F.col("open"), F.col("part")).otherwise(F.col("part") + F.col("opens"))).withColumn("other", F.explode(other))
    return written(met.select(F.xxhash64("unit", F.least("part", "other"), F.greatest("part", "other"), F.lit("parts")).bitwiseOR(F.lit(-1 << 63)).alias("unit"), "node")), links


def similar_links(rows: DataFrame, texts: DataFrame, similarity: float = 0.8, shingle: int = 5, full: int = FULL, hold: int = HOLD) -> DataFrame:
    """Links ``a, b`` between nodes of ``rows(key, node, n, words)`` whose shingle sets have ``similarity`` or more, enough to connect all that are.

    Fingerprints are dealt into tiles by sampled bits, :func:`deals` times; those of a tile are compared by exclusive-or and bit counts, all
    pairs, first in 128 bits, then, for pairs that pass, in all 1,024.  First a forest of the nearest pairs is verified by whole sets of
    ``texts(key, text)``, then every pair between what that left apart: the whole sets of the members that have such a pair meet in
    groups, which give a forest of what is similar, so that no pair that is not becomes a row.  Few fingerprints make one tile, where all meet.
    Ids and narrow fingerprints are shuffled for all sets, whole texts only for members that are verified.
    """
    # a set of fewer shingles cannot be as similar to another one
    able = rows.filter(F.col("n") + 1e-9 >= similarity * (F.col("n") + 1))
    nodes = written(able.dropDuplicates(["node"]).select("node", "key", "n", "words", _shortened(F.col("words")).alias("short")).select("node", "key", "n", "words", "short.*"))
    bits = tile_bits(nodes.count(), full)
    check = lambda pairs: _verified(_close(pairs, nodes, similarity), texts, nodes.select("node", "key"), similarity, shingle)
    members = _dealt(nodes, bits, similarity, "node")
    crowded = written(members.groupBy("unit").count().filter(F.col("count") > full).select("unit"))
    cut, links = (None, None) if crowded.isEmpty() else _parts(written(members.join(crowded, "unit", "left_semi")), check, full)
    carried = ["node", "root", "n", *_SHORT]

    def units(some: DataFrame) -> DataFrame:
        dealt = _dealt(some, bits, similarity, *carried)
        return dealt if cut is None else dealt.join(crowded, "unit", "left_anti").unionByName(cut.join(some.select(*carried), "node"))

    def placed() -> DataFrame:
        if links is None:
            return nodes.withColumn("root", F.col("node"))
        return nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    pairs = written(_proposed(units(placed()), similarity))
    found = check(pairs).filter("similar").select("a", "b")
    links = found if links is None else links.union(found)
    # members of classes that the forest has a pair of; all others have none
    every = written(placed())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = every.join(ends, "node", "left_semi").select("root").distinct()
    rest = written(_unsettled(units(written(every.join(roots, "root", "left_semi"))), similarity))
    groups = written(_grouped(rest.join(every.select("node", "root", "n", "words"), "node"), similarity, bits, hold))
    sets = _sets(texts, nodes.select("node", "key"), groups.select("node").distinct(), shingle)
    met = groups.join(every.select("node", "root").join(sets, "node"), "node")
    return links.union(written(_settled(met, similarity)))


def without_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", full: int = FULL) -> DataFrame:
    """The rows of ``docs`` but those that are near copies of another: of each component the row with the least id stays.

    Rows link when the Jaccard similarity of their sets of word shingles is ``similarity`` or more, counted over the whole sets.  Pairs are
    found by their fingerprints, see :func:`similar_links`.  A pair at 0.8 is looked at with a probability of 0.998, one at 0.85 of 0.99998; nothing below ``similarity`` links.  Texts without a
    word link with each other, texts of fewer words than a shingle has are one shingle.  The verdict is a row's own: of rows
    that repeat an id only those go whose text is a copy, one of whole rows that are repeated stays, and a row with a NULL id
    stays only where its component has no other.  An empty table gives an empty result; all columns are kept.
    """
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = written(docs.select(F.col(id_col).alias("id"), key.alias("key"), F.monotonically_increasing_id().alias("row"), sketch(F.col(text_col), shingle).alias("sketch"))
                   .select("id", "key", "row", "sketch.*"))
    links = similar_links(rows, docs.select(key.alias("key"), F.col(text_col).alias("text")), similarity, shingle, full)
    nodes = rows.groupBy("node").agg(F.count("*").alias("n")).join(components(links), "node", "left")
    classes = nodes.select("node", "n", F.coalesce("root", "node").alias("component"))
    whole = classes.groupBy("component").agg(F.sum("n").alias("n")).filter("n > 1").select("component")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("place")
    members = written(rows.select("id", "key", "node", "row", place).join(classes.join(whole, "component").select("node", "component"), "node").select("id", "key", "row", "component", "place"))
    first = members.groupBy("component").agg(F.min("place").alias("first"))
    verdicts = members.join(first, "component").select("id", "key", (F.col("row") == F.col("first.row")).alias("kept"))
    return keep_rows(docs, id_col, key, verdicts)
