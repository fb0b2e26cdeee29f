"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and their scores come from a model file; the trie is built once on the driver, over the pieces' UTF-8 bytes,
and broadcast (its size is that of the vocabulary).  White space becomes the marker, a text gets a marker in front, and
the segmentation with the greatest sum of scores wins.  A character that no piece covers is written as byte pieces, at
the cost of an unknown piece.  No piece goes on after a marker that follows another character, so the best
segmentation of a text is made of the best segmentations of its words, and those are kept in a bounded table.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, expanded, sums

MARKER = "▁"
#: What an unknown piece costs below the lowest score, as in the library.
UNKNOWN_PENALTY = 10.0
#: Bytes up to which words are segmented together.
TOGETHER = 256
#: Scores below this mark pieces that are placed by the library's own rules and not by score.
LEAST_SCORE = -1e8


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.least = min((self.scores[i] for i in self.normal if self.scores[i] > LEAST_SCORE), default=0.0)
        self.by_word = not any(MARKER in self.pieces[i].lstrip(MARKER) for i in self.normal)


class DoubleArray:
    """A trie in two arrays: the child of ``s`` by byte ``c`` is ``t = base[s] + c + 1`` if ``check[t] == s``; ``value[s]`` is the piece that ends at ``s``, or -1."""

    def __init__(self, words: dict[bytes, int]) -> None:
        children: dict[bytes, set[int]] = defaultdict(set)
        for word in words:
            for i, c in enumerate(word):
                children[word[:i]].add(c)
        size = 1 << 12
        self.base, self.check, self.value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        place, last = {b"": 0}, defaultdict(int)
        self.check[0] = -2  # the root is no one's child
        for prefix in sorted(children, key=lambda p: (len(p), p)):  # parents before their children
            s, codes = place[prefix], sorted(children[prefix])
            b = last[min(len(codes), 8)]  # where the last node with about as many children found room
            while True:
                while b + 257 >= len(self.check):
                    for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        x.extend([fill] * len(x))
                if all(self.check[b + c + 1] == -1 for c in codes):
                    break
                b += 1
            self.base[s] = last[min(len(codes), 8)] = b
            for c in codes:
                self.check[b + c + 1] = s
                place[prefix + bytes([c])] = b + c + 1
        for word, i in words.items():
            self.value[place[word]] = i


class Encoder:
    """Encodes and decodes under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray | None = None) -> None:
        self.vocabulary = vocabulary
        self.trie = trie or DoubleArray({vocabulary.pieces[i].encode(): i for i in vocabulary.normal})
        self.base, self.check, self.value = map(list, (self.trie.base, self.trie.check, self.trie.value))  # quicker to read
        self.literal = {i: vocabulary.pieces[i].replace(MARKER, " ").encode() for i in range(len(vocabulary.pieces))}
        self.literal |= {i: bytes([b]) for b, i in vocabulary.bytes.items()}
        self.byte_ids = frozenset(vocabulary.bytes.values())
        self.is_byte = np.zeros(len(vocabulary.pieces), bool)
        self.is_byte[list(self.byte_ids)] = True
        self.piece_scores = np.where(self.is_byte, vocabulary.least - UNKNOWN_PENALTY, np.array(vocabulary.scores))
        self.byte_table = np.array([vocabulary.bytes.get(b, vocabulary.unknown) for b in range(256)], np.int32)
        self.tables = tuple(np.array(x, np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)) + (np.array(vocabulary.scores),)
        self.words = Words(self.worked_out)

    def viterbi(self, word: str) -> tuple[int, ...]:
        """Identifiers of the segmentation with the greatest score; among equals the first found wins."""
        data, base, check, value, scores = word.encode("utf-8", "replace"), self.base, self.check, self.value, self.vocabulary.scores
        n, unknown, none = len(data), self.vocabulary.least - UNKNOWN_PENALTY, float("-inf")
        best, begin, piece = [none] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            if here == none:  # inside a character
                continue
            lead = data[at]
            single = at + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            covered = False
            state, end = 0, at
            while end < n:
                to = base[state] + data[end] + 1
                if check[to] != state:
                    break
                state, end = to, end + 1
                if (found := value[state]) >= 0:
                    if end == single:
                        covered = True
                    if (score := here + scores[found]) > best[end]:
                        best[end], begin[end], piece[end] = score, at, found
            if not covered and (score := here + unknown) > best[single]:
                best[single], begin[single], piece[single] = score, at, -1
        out: list[int] = []
        while n > 0:
            start = begin[n]
            if piece[n] >= 0:
                out.append(piece[n])
            elif self.vocabulary.bytes:
                out.extend(self.vocabulary.bytes[b] for b in reversed(data[start:n]))
            else:
                out.append(self.vocabulary.unknown)
            n = start
        out.reverse()
        return tuple(out)

    def viterbi_of_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`viterbi` of many words at once: identifiers, one word after the other, and the number of each word's.

        One step of the search is taken in all words together: from the same place in each, along the trie as far as it goes.
        """
        base, check, value, scores, unknown = *self.tables, self.vocabulary.least - UNKNOWN_PENALTY
        encoded = [w.encode("utf-8", "replace") for w in words]
        data, many = np.frombuffer(b"".join(encoded), np.uint8), np.fromiter(map(len, encoded), np.int64, len(words))
        first = np.cumsum(many) - many
        node = first + np.arange(len(words))  # of a word's beginning; the node of a place in it is so much further
        best, begin, piece = np.full(len(data) + len(words), -np.inf), np.zeros(len(data) + len(words), np.int32), np.full(len(data) + len(words), -1, np.int32)
        best[node] = 0
        by_length = np.argsort(-many, kind="stable")
        longer = np.searchsorted(-many[by_length], -np.arange(many.max(initial=0)), side="left")  # words with a byte at each place

        def offered(to: np.ndarray, score: np.ndarray, at: int, found: np.ndarray | int) -> None:
            up = score > best[to]
            best[to[up]], begin[to[up]], piece[to[up]] = score[up], at, found[up] if isinstance(found, np.ndarray) else found

        for at, n in enumerate(longer.tolist()):
            word = by_length[:n]
            word = word[best[node[word] + at] > -np.inf]  # others are inside a character there
            if not len(word):
                continue
            here, pos, stop, to = best[node[word] + at], first[word] + at, first[word] + many[word], node[word] + at
            lead = data[pos]
            single = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            covered, i, state, k = np.zeros(len(word), bool), np.arange(len(word)), np.zeros(len(word), np.int64), 0
            while len(i):
                child = base[state] + data[pos] + 1
                goes = check[child] == state
                i, state, pos, k = i[goes], child[goes], pos[goes] + 1, k + 1
                found = value[state]
                if (hit := found >= 0).any():
                    j = i[hit]
                    covered[j] |= single[j] == k
                    offered(to[j] + k, here[j] + scores[found[hit]], at, found[hit])
                if not (inside := pos < stop[i]).all():
                    i, state, pos = i[inside], state[inside], pos[inside]
            if not covered.all():
                offered((to + single)[~covered], here[~covered] + unknown, at, -1)

        word, end, parts = np.arange(len(words)), many, []
        while len(word):  # back from all ends
            start = begin[node[word] + end].astype(np.int64)
            parts.append((word, start, end, piece[node[word] + end]))
            word, end = word[start > 0], start[start > 0]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        word, start, end, found = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((start, word))
        word, start, end, found = word[order], start[order], end[order], found[order]
        sizes = np.where((found < 0) & bool(self.vocabulary.bytes), end - start, 1)
        part = np.repeat(np.arange(len(word)), sizes)
        place = first[word[part]] + start[part] + np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.where(found[part] >= 0, found[part], self.byte_table[data[place]]).astype(np.int32), np.bincount(word, sizes, len(words)).astype(np.int64)

    def cut(self, text: str) -> str:
        """The text with one blank between each two words, which are what stands after the marker in front of each."""
        if not self.vocabulary.by_word:
            return text.replace(" ", MARKER)
        if "  " in text or MARKER in text or text[:1] == " ":  # runs of markers are not cut
            return " ".join(w[1:] for w in _words.findall(MARKER + text.replace(" ", MARKER)))
        return text

    def worked_out(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of new words: their identifiers, how many each has, how many of them are bytes, the score, and whether decoding gives the word."""
        marked = [MARKER + w for w in words]
        long = [i for i, w in enumerate(marked) if len(w) > TOGETHER // 4 and len(w.encode("utf-8", "replace")) > TOGETHER]
        for i in long:
            marked[i] = ""
        flat, sizes = self.viterbi_of_all(marked)
        if long:
            alone = {i: np.array(self.viterbi(MARKER + words[i]), np.int32) for i in long}
            ends = np.cumsum(sizes)
            flat = np.concatenate([x for i in range(len(words)) for x in (flat[ends[i] - sizes[i]:ends[i]], alone.get(i, flat[:0]))])
            sizes[long] = [len(alone[i]) for i in long]
        fallen = sums(self.is_byte[flat].astype(np.int64), sizes)
        literal = [self.literal[i] for i in flat.tolist()]
        expected = [b" " + w.replace(MARKER, " ").encode("utf-8", "replace") for w in words]
        same = sums(np.fromiter(map(len, literal), np.int64, len(literal)), sizes) == np.fromiter(map(len, expected), np.int64, len(words))
        if b"".join(literal) != b"".join(expected) or not same.all():  # then word by word
            ends = np.cumsum(sizes)
            same = np.array([b"".join(literal[end - n:end]) == e for e, n, end in zip(expected, sizes.tolist(), ends.tolist(), strict=True)], bool)
        return flat, sizes, fallen, sums(self.piece_scores[flat], sizes), same

    def encode(self, text: str | None) -> list[tuple[int, ...]]:
        """Identifiers, word by word."""
        return [self.viterbi(MARKER + w) for w in self.cut(text).split(" ")] if text else []

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Of texts: all identifiers, one text after the other; then for each text their number, the bytes among them, the score, and
        whether decoding gives the text.

        Each different word of the batch is looked up once in the worker's table.
        """
        lists = pc.split_pattern(pa.array([self.cut(t) if t else None for t in texts], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        of_word = self.words.codes(coded.dictionary.to_pylist())
        codes, n_words = of_word[coded.indices.to_numpy()], np.diff(lists.offsets.to_numpy())
        flat, sizes, (fallen, scores, same) = self.words.flat, self.words.sizes, self.words.facts
        unmarked = np.array([t is None or MARKER not in t for t in texts], bool)
        return (expanded(flat, sizes, codes), *(sums(x[codes], n_words) for x in (sizes, fallen, scores)),
                (sums((~same[codes]).astype(np.int64), n_words) == 0) & unmarked)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of identifiers: byte pieces to bytes, markers to blanks, without the one put in front."""
        data = b"".join(map(self.literal.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")


#: A run of markers and what follows up to the next marker.
_words = re.compile(f"{MARKER}+[^{MARKER}]*")
_here: dict[str, Encoder] = {}


def _encoder(path: str, shared) -> Encoder:
    """This worker's encoder, from the vocabulary and trie that the driver has sent."""
    if path not in _here:
        _here[path] = Encoder(*shared.value)
    return _here[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_pieces, n_bytes_fallen_back, score, decoded_equal`` for every row, in one pass without a shuffle.

    ``decoded_equal`` says whether decoding gives the text back; it does unless the text itself holds the marker
    character.  NULL and empty texts have no pieces; repeated rows are encoded each for itself; other columns are ignored;
    an empty table gives an empty result.
    """
    built = Encoder(Vocabulary(path))
    shared = docs.sparkSession.sparkContext.broadcast((built.vocabulary, built.trie))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared)
        for batch in batches:
            ids, n, fallen, scores, same = encoder.batch(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, *map(pa.array, (n, fallen, scores, same))],
                                             ["doc_id", "ids", "n_pieces", "n_bytes_fallen_back", "score", "decoded_equal"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encoded, f"doc_id {kind}, ids array<int>, n_pieces long, n_bytes_fallen_back long, score double, decoded_equal boolean")


def decode(ids: Column, path: str) -> Column:
    """Text of a column of identifier arrays; NULL stays NULL."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _here:
            _here[path] = Encoder(Vocabulary(path))
        for rows in batches:
            yield pd.Series([None if r is None else _here[path].decode(list(r)) for r in rows], dtype=object)

    return decoded(ids)
