"""Removal of repeated passages by a sparse suffix array, sorted deep-shallow.

Any two equal passages of ``length`` bytes hold the same *anchor*: the ``ANCHOR``-byte string of least hash in them, at
the same place.  So only the suffixes at anchors are sorted, about one in 35, and two passages are compared only if they
share an anchor.

1. Each text's anchors are found, with a 128-bit digest of the bytes around each (all that a passage with that anchor can
   hold), under a seed drawn for the run.
2. Anchors are grouped by hash.  Where the digests are equal, all but the first are repeated as a whole.  Where
   an anchor has different surroundings, the first of each kind is asked for.
3. The bytes around those are cut out of the texts and sorted by the anchor's own bytes: rightwards as suffixes and leftwards as
   reversed prefixes, with a multikey quicksort of eight-byte characters to a shallow depth and blind tries for the
   groups that remain.  From the two orders and their common prefix lengths follows, for every place of the anchor in
   a passage, which passages are equal; all but the first are repeated.
4. The spans found are joined to the texts, merged and cut out.

Copies are resolved inside a batch before anything is shuffled, so a passage that a third of all texts share costs one
row per batch and kind of surroundings.  An anchor with more than ``HOT`` kinds of surroundings, of which there may be many,
is not sorted in one task: its passages are split into those with few and with many bytes before the anchor, each kind into
groups that agree in the bytes that all of the kind hold, and again while a group is too large.  In the end a
group holds one passage only, whose first place is an aggregate.  Texts are looked through in blocks of ``SCANNED`` bytes,
so a very long one does not fill a worker.
"""

from __future__ import annotations

import functools
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ANCHOR = 32
#: Bytes after the anchor that the multikey quicksort looks at.
SHALLOW = 16
#: Rows that a task sorts at once at least, if that many groups of an anchor are there.
BLOCK = 8192
#: Kinds of surroundings that are sorted as one group.
HOT = 100_000
#: Bytes whose anchors are looked for at once, and bytes whose repeated anchors are resolved before anything is sent.
SCANNED, RESOLVED = 1 << 20, 8 << 20
#: Places that are cut out of texts at once.
CUT_ROWS = 20_000
#: Order of rows without an id: after all others.
LAST = (1 << 63) - 1


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over every ``width`` successive elements, by doubling."""
    size = 1
    while size * 2 <= width:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def rolling_hash(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """Hash of the ``size`` bytes (a multiple of eight) at every position."""
    w = data.astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] << np.uint64(8 * step) | w[step:]
    n = len(data) - size + 1
    h = np.zeros(n, np.uint64)
    for at in range(0, size, 8):
        h = (h ^ w[at:at + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash is the least of some passage of ``length`` bytes, and the hashes."""
    h, width = rolling_hash(data, size), length - size + 1
    least = slide(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    return at, h[at]


def _anchor_rows(length: int, seed: int):
    """Rows ``hash, wide, more, doc, at`` of the anchors, ``wide`` and ``more`` being the digest of what is around; ``at`` is position
    << 32 | text's checksum, or its complement for one that an earlier one of the batch repeats with all that is around it."""
    reach = length - ANCHOR

    def sent(parts: list[pd.DataFrame]) -> pd.DataFrame:
        out = pd.concat(parts, ignore_index=True)
        h, wide, more, doc, at = (out[c].to_numpy() for c in ("hash", "wide", "more", "doc", "at"))
        order = np.lexsort((at, doc, more, wide, h))
        out = out.iloc[order].drop_duplicates()  # of a row that the table has twice, and of places where blocks overlap
        again = np.zeros(len(out), bool)
        again[1:] = np.logical_and.reduce([out[c].to_numpy()[1:] == out[c].to_numpy()[:-1] for c in ("hash", "wide", "more")])
        # a repeated one needs no meeting with others: it is dealt anywhere
        out["hash"] = np.where(again, out["wide"] ^ out["at"] ^ out["doc"] * 0x5851F42D4C957F2D, out["hash"])
        out["at"] = np.where(again, ~out["at"], out["at"])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = [bytes(t) for t in batch["text"]]
            doc, check = batch["doc"].to_numpy(), batch["check"].to_numpy()
            use = [i for i, t in enumerate(texts) if len(t) >= length]
            if not use:
                continue
            data = b"".join(texts[i] for i in use)
            sizes = np.array([len(texts[i]) for i in use])
            stops = np.cumsum(sizes)
            del texts
            parts = []
            for begin in range(0, len(data) - length + 1, SCANNED):  # a block has every passage that starts in it
                at, h = anchors(np.frombuffer(data, np.uint8, min(SCANNED + length - 1, len(data) - begin), begin), length)
                at += begin
                owner = np.searchsorted(stops, at, side="right")
                inside = at + ANCHOR <= stops[owner]
                at, h, owner = at[inside], h[inside], owner[inside]
                start = stops[owner] - sizes[owner]
                lo, hi = np.maximum(start, at - reach), np.minimum(stops[owner], at + length)
                wide = np.frombuffer(b"".join(digest(data[a:b], c) for a, b, c in zip(lo.tolist(), hi.tolist(), (at - lo + seed).tolist(), strict=True)), np.int64).reshape(-1, 2)
                row = np.array(use)[owner]
                parts.append(pd.DataFrame({"hash": h.view(np.int64), "wide": wide[:, 0], "more": wide[:, 1], "doc": doc[row], "at": (at - start) << 32 | check[row]}))
                if len(parts) * SCANNED >= RESOLVED:
                    yield sent(parts)
                    parts = []
            if parts:
                yield sent(parts)

    return run


def _judged(length: int):
    """Over anchors sorted by (hash, wide, more, doc, at): spans that are repeated, and those that must be compared (``hash`` set)."""
    reach = length - ANCHOR

    def spans(doc: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        place = at >> 32
        return pd.DataFrame({"hash": pd.array([None] * len(at), dtype="Int64"), "doc": doc, "check": at & 0xFFFFFFFF,
                             "span": np.maximum(0, place - reach) << 32 | (place + length)})

    def asked(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"hash": pd.array(h, dtype="Int64"), "doc": doc, "check": at & 0xFFFFFFFF, "span": at >> 32})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the last row
        waiting = None  # the first kind of the last group, if there is no second yet
        for batch in batches:
            h, wide, more, doc, at = (batch[c].to_numpy() for c in ("hash", "wide", "more", "doc", "at"))
            done = at < 0
            if done.any():
                yield spans(doc[done], ~at[done])
                h, wide, more, doc, at = h[~done], wide[~done], more[~done], doc[~done], at[~done]
            if not len(h):
                continue
            same_hash, same_kind = h[1:] == h[:-1], (h[1:] == h[:-1]) & (wide[1:] == wide[:-1]) & (more[1:] == more[:-1])
            twice = np.append(last == (h[0], wide[0], more[0], doc[0], at[0]), same_kind & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]))
            # the first of all is like the last of the batch before, or not
            new_hash = np.append(last is None or h[0] != last[0], ~same_hash)
            new_kind = np.append(last is None or (h[0], wide[0], more[0]) != last[:3], ~same_kind)
            last = h[-1], wide[-1], more[-1], doc[-1], at[-1]
            if twice.any():  # rows that the table has twice; none of them opens a kind
                h, doc, at, new_hash, new_kind = h[~twice], doc[~twice], at[~twice], new_hash[~twice], new_kind[~twice]
                if not len(h):
                    continue
            if not new_kind.all():
                yield spans(doc[~new_kind], at[~new_kind])
            kinds = np.flatnonzero(new_kind)
            if not len(kinds):
                continue
            if waiting is not None and not new_hash[kinds[0]]:
                yield asked(*waiting)
            waiting = None
            opens = new_hash[kinds]
            followed = np.append(~opens[1:], False)
            if opens[-1]:
                k = kinds[-1:]
                waiting = h[k], doc[k], at[k]
            ask = kinds[~opens | followed]
            if len(ask):
                yield asked(h[ask], doc[ask], at[ask])

    return run


def _cut(length: int):
    """Bytes around each place that is asked for: ``hash, doc, at, left`` (bytes before the anchor) and ``around``."""
    reach = length - ANCHOR
    names = ["hash", "doc", "at", "left", "around"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, check, text, asks = (batch.column(c)[row] for c in ("doc", "check", "text", "asks"))
                text, check, asks = memoryview(text.as_buffer()), check.as_py(), asks.values
                for first in range(0, len(asks), CUT_ROWS):
                    part = asks.slice(first, CUT_ROWS)
                    place = part.field("span").to_numpy()
                    lo = np.maximum(0, place - reach)
                    around = [bytes(text[a:b]) for a, b in zip(lo.tolist(), (place + length).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.field("hash"), pa.array(np.full(len(place), doc.as_py())), pa.array(place << 32 | check),
                                                      pa.array((place - lo).astype(np.int32)), pa.array(around, pa.binary())], names)

    return run


def blind_order(strings: list[bytes]) -> list[int]:
    """Order of strings of equal length by a blind trie; equal ones keep theirs.

    An inner node is [depth, children by byte], a leaf the list of its strings' numbers.  A string is first led down by the
    branching bytes alone, then compared once, with the leaf it meets, and put where the two part.
    """
    root: list | None = None
    bits = 8 * len(strings[0])
    numbers = [int.from_bytes(s) for s in strings]
    for i, s in enumerate(strings):
        if root is None:
            root = [-1, i]
            continue
        node = root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        differ = numbers[i] ^ numbers[other]
        if not differ:
            node.append(i)
            continue
        depth = (bits - differ.bit_length()) // 8
        above, node = None, root
        while 0 <= node[0] < depth:
            above, node = node, node[1][s[node[0]]] if s[node[0]] in node[1] else None
            if node is None:
                break
        leaf = [-1, i]
        if node is None:  # pragma: no cover - the strings would part at that depth already
            above[1][s[above[0]]] = leaf
        elif node[0] == depth:
            node[1][s[depth]] = leaf
        else:
            inner = [depth, {strings[other][depth]: node, s[depth]: leaf}]
            if above is None:
                root = inner
            else:
                above[1][s[above[0]]] = inner
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out.extend(node[1:])
        else:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return out


def deep_shallow(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows (equal length, a multiple of eight) within ascending groups, and common prefixes with the row before.

    The prefix is -1 at the first row of a group.
    """
    n, size = rows.shape
    words = rows.view(">u8")
    order, tie = np.arange(n), group.astype(np.int64)
    for depth in range(min(shallow, size) // 8):  # one eight-byte character of all groups that are tied so far
        counts = np.bincount(tie)
        open_ = np.flatnonzero(counts[tie] > 1)
        if not len(open_):
            break
        key = words[order[open_], depth].astype(np.uint64)
        order[open_] = order[open_][np.lexsort((key, tie[open_]))]
        key = words[order, depth]
        tie = np.cumsum(np.append(0, (tie[1:] != tie[:-1]) | ((key[1:] != key[:-1]) & (counts[tie[1:]] > 1))))
    edges = np.flatnonzero(np.append(True, tie[1:] != tie[:-1]))
    stops = np.append(edges[1:], n)
    big = stops - edges > 1
    if big.any():
        # groups whose rows are all equal are in order already
        same = np.append(True, (words[order[1:]] == words[order[:-1]]).all(axis=1))
        unequal = np.add.reduceat(~same, edges) - ~same[edges] > 0
        for lo, hi in zip(edges[big & unequal], stops[big & unequal], strict=True):
            part = order[lo:hi]
            order[lo:hi] = part[blind_order([r.tobytes() for r in rows[part]])]
    prefix = np.full(n, -1)
    if n > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        prefix[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        prefix[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, prefix


def repeated_places(group: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray,
                    length: int, low: np.ndarray | int = 0, high: np.ndarray | int = 1 << 30) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes before the anchor with which a row's passage repeats an earlier row's; -1 if none.

    A row's passages have ``low`` to ``high`` bytes before the anchor. Rows are in order of place within a group; ``left`` has the bytes before the anchor, nearest first.
    """
    n, reach = len(group), length - ANCHOR
    (order_l, prefix_l), (order_r, prefix_r) = deep_shallow(group, left), deep_shallow(group, right)
    rank_l, rank_r = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_l[order_l], rank_r[order_r] = np.arange(n), np.arange(n)
    least, most = np.full(n, -1), np.full(n, -1)
    for before in range(reach + 1):
        use = np.flatnonzero((n_left >= before) & (n_right >= length - ANCHOR - before) & (low <= before) & (before <= high))
        if len(use) < 2:
            continue
        class_l = np.cumsum(prefix_l < before)[rank_l[use]]
        class_r = np.cumsum(prefix_r < length - ANCHOR - before)[rank_r[use]]
        _, first, which = np.unique(class_l * (n + 1) + class_r, return_index=True, return_inverse=True)
        again = use[first[which] != np.arange(len(use))]
        least[again] = np.where(least[again] < 0, before, least[again])
        most[again] = before
    return least, most


def _compared(length: int):
    """Over rows sorted by (hash, doc, at): spans that repeat an earlier row's, of passages in the range of ``low, high`` if rows have one."""
    reach = length - ANCHOR
    size_l, size_r = -(-reach // 8) * 8, -(-reach // 8) * 8

    def spans(block: pd.DataFrame) -> pd.DataFrame | None:
        ranged = "low" in block.columns
        block = block.drop_duplicates(["hash", "doc", "at", *["low"] * ranged])  # rows that the table has twice
        h = block["hash"].to_numpy()
        group = np.cumsum(np.append(0, h[1:] != h[:-1]))
        n_left = block["left"].to_numpy()
        around = block["around"].tolist()
        own = np.frombuffer(b"".join(a[n:n + ANCHOR] for a, n in zip(around, n_left.tolist(), strict=True)), np.uint64).reshape(-1, ANCHOR // 8)
        opens = np.append(True, h[1:] != h[:-1])
        if (own != own[np.flatnonzero(opens)[group]]).any():  # other bytes of the same hash: a group for each
            order = np.lexsort((*own.T[::-1], group))
            same = np.append(False, (own[order][1:] == own[order][:-1]).all(axis=1) & (group[order][1:] == group[order][:-1]))
            block, around, n_left, group = block.iloc[order], [around[i] for i in order], n_left[order], np.cumsum(~same)
        n_right = np.array([len(a) for a in around]) - n_left - ANCHOR
        left = np.frombuffer(b"".join(a[:n][::-1].ljust(size_l, b"\0") for a, n in zip(around, n_left.tolist(), strict=True)), np.uint8).reshape(-1, size_l)
        right = np.frombuffer(b"".join(a[n + ANCHOR:].ljust(size_r, b"\0") for a, n in zip(around, n_left.tolist(), strict=True)), np.uint8).reshape(-1, size_r)
        limits = (block["low"].to_numpy(), block["high"].to_numpy()) if ranged else ()
        least, most = repeated_places(group, left, right, n_left, n_right, length, *limits)
        hit = least >= 0
        at = block["at"].to_numpy()[hit]
        place = at >> 32
        return pd.DataFrame({"doc": block["doc"].to_numpy()[hit], "check": at & 0xFFFFFFFF,
                             "span": (place - most[hit]) << 32 | (place - least[hit] + length)}) if hit.any() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < BLOCK:
                continue
            block = pd.concat(held, ignore_index=True)
            h = block["hash"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut:
                if (found := spans(block.iloc[:cut])) is not None:
                    yield found
                block = block.iloc[cut:].reset_index(drop=True)
            held, rows = [block], len(block)
        if rows and (found := spans(pd.concat(held, ignore_index=True))) is not None:
            yield found

    return run


def _first_spared(rows: DataFrame, length: int) -> DataFrame:
    """Spans of single passages, with ``low`` bytes before the anchor, but for the first of each content."""
    begin = F.col("at") - F.shiftleft(F.col("low").cast("long"), 32)
    keyed = rows.select("doc", begin.alias("at"), F.sha2(F.substring("around", F.col("left") - F.col("low") + 1, F.lit(length)), 256).alias("content"))
    first = keyed.groupBy("content").agg(F.min(F.struct("doc", "at")).alias("first"))
    again = keyed.join(first, "content").filter(F.struct("doc", "at") > F.col("first"))
    place = F.shiftright("at", 32)
    return again.select("doc", F.col("at").bitwiseAND(0xFFFFFFFF).alias("check"), F.shiftleft(place, 32).bitwiseOR(place + length).alias("span"))


def _hot_spans(cuts: DataFrame, length: int, hot: int) -> DataFrame:
    """Spans of anchors with over ``hot`` kinds of surroundings.

    Passages with ``low`` to ``high`` bytes before the anchor all hold the ``low`` bytes before it and those after it that
    the longest still has, so equal ones meet in groups of equal such bytes. The range starts as a whole and is halved in every round, for
    the groups that are too large; a row that is alone in its group repeats nothing.
    """
    reach, spans = length - ANCHOR, []
    rows = cuts.dropDuplicates(["hash", "doc", "at"]).withColumns({"low": F.lit(0), "high": F.lit(reach)})
    while not rows.isEmpty():  # at most seven rounds at 100 bytes
        middle = F.expr("(low + high) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high")))).alias("half")
        each = rows.select("doc", "at", "left", "around", halves).select("doc", "at", "left", "around", "half.low", "half.high")
        held = F.substring("around", F.col("left") - F.col("low") + 1, F.col("low") + ANCHOR + reach - F.col("high"))
        fits = (F.col("left") >= F.col("low")) & (F.octet_length("around") - F.col("left") - ANCHOR >= reach - F.col("high"))
        each = written(each.filter(fits).withColumn("hash", F.xxhash64("low", "high", held)))
        counts = written(each.groupBy("hash").count().filter("count > 1"))
        sorted_ = each.join(counts.filter(F.col("count") <= hot), "hash", "left_semi")
        spans.append(sorted_.repartition("hash").sortWithinPartitions("hash", "low", "doc", "at").mapInPandas(_compared(length), "doc long, check long, span long"))
        large = each.join(counts.filter(F.col("count") > hot), "hash", "left_semi")
        spans.append(_first_spared(large.filter("low = high"), length))
        rows = large.filter("low < high")
    return functools.reduce(DataFrame.union, spans)


def cut_spans(text: Column, spans: Column) -> Column:
    """Struct of the merged ``spans`` and the bytes ``kept`` of a binary column, from packed spans in any order."""

    @F.pandas_udf("spans array<struct<start:long,stop:long>>, kept binary")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, packed in zip(texts, all_spans, strict=True):
            text = bytes(text)
            if packed is None or not len(packed):
                out.append(([], text))
                continue
            packed = np.sort(np.asarray(packed, np.int64))
            start, stop = packed >> 32, np.minimum(np.maximum.accumulate(packed & 0xFFFFFFFF), len(text))
            new = np.append(True, start[1:] > stop[:-1])
            merged = list(zip(start[new].tolist(), stop[np.append(new[1:], True)].tolist(), strict=True))
            edges = [0, *(x for span in merged for x in span), len(text)]
            out.append(([{"start": a, "stop": b} for a, b in merged], b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
        return pd.DataFrame(out, columns=["spans", "kept"])

    return cut(text, spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row: merged spans of bytes removed, and the bytes that stay.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a smaller id, or further up in the
    same text.  Strings are judged on the input and never cross texts.  NULL counts as the empty text.  Rows that repeat an
    id and its text get the same result each; different texts of one id are told apart, their passages ordered by place.
    A NULL id comes after all others.  Texts of 2 GiB and more are not supported by Spark itself.  An empty table gives an
    empty result; other columns are ignored.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length must be {ANCHOR + 8} at least")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
                       F.crc32(text).alias("check"), text.alias("text"))
    found = rows.filter(F.octet_length("text") >= length).select("doc", "check", "text").mapInPandas(_anchor_rows(length, secrets.randbits(62)), "hash long, wide long, more long, doc long, at long")
    judged = written(found.repartition("hash").sortWithinPartitions("hash", "wide", "more", "doc", "at")
                     .mapInPandas(_judged(length), "hash long, doc long, check long, span long"))

    asks = judged.filter("hash is not null").select("doc", "check", "hash", "span").distinct()
    crowded = written(asks.groupBy("hash").count().filter(F.col("count") > hot).select("hash"))
    by_text = asks.groupBy("doc", "check").agg(F.collect_list(F.struct("hash", "span")).alias("asks"))
    first = rows.select("doc", "check", "text").filter(F.octet_length("text") >= length)
    cuts = first.join(by_text, ["doc", "check"]).mapInArrow(_cut(length), "hash long, doc long, at long, left int, around binary")
    known = spans_known(judged)
    if not crowded.isEmpty():  # most inputs have none
        cuts = written(cuts)
        known = known.union(_hot_spans(cuts.join(crowded, "hash", "left_semi"), length, hot))
        cuts = cuts.join(crowded, "hash", "left_anti")
    compared = (cuts.repartition("hash").sortWithinPartitions("hash", "doc", "at").mapInPandas(_compared(length), "doc long, check long, span long"))
    spans = known.union(compared).groupBy("doc", "check").agg(F.collect_list("span").alias("packed"))
    cut = rows.join(spans, ["doc", "check"], "left").select(F.col("_id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), cut_spans(F.col("text"), F.col("packed")).alias("r"))
    return cut.select("doc_id", "n_bytes", "r.spans", "r.kept")


def spans_known(judged: DataFrame) -> DataFrame:
    return judged.filter("hash is null").select("doc", "check", "span")
