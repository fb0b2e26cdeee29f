"""The registered queries of the corpus operators over a whole small table: SQL, or a plain version of each contract."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from gridspark.llm import language_id, queries, sentencepiece, toxicity, training_order
from gridspark.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}


def rows(spark, name) -> dict:
    found = queries.QUERIES[name](spark, SMALL).collect()
    assert len({r.doc_id for r in found}) == len(found)
    return {r.doc_id: r for r in found}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {file.stem} as from '{file}'")
    df = queries.QUERIES[name](spark, SMALL)
    names = ", ".join(f'"{c}"' for c in df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(con.sql(f"select {names} from ({queries.ORACLES[name]})").fetchall(), key=key)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_op1_scores_every_text(spark, texts):
    got = rows(spark, "op1_toxicity")
    assert set(got) == set(texts)
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = toxicity.train(docs, labels, ~queries.held_out(3, 1))
    weights = {int(s): float(w) for s, w in zip(model.slots, model.weights, strict=True)}
    for i, r in got.items():
        words, margin, of = [w for w in re.findall("[^\\W\\d_]+", texts[i].lower())], model.bias, Counter()
        for word in words:  # a word, and its beginnings of three to six letters
            of[zlib.crc32(b"=" + word.encode()) % 2 ** 20] += 1
            for n in (3, 4, 5, 6):
                if n <= len(word):
                    of[zlib.crc32(word[:n].encode()) % 2 ** 20] += 1
        for s, n in of.items():
            margin += weights.get(s, 0.0) * min(1.0, n / (0.015 * len(words)))
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -50, 50))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_op1_on_labels_that_it_has_not_seen(spark):
    larger = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op1_toxicity"](spark, larger).collect()}
    marks = [(got[r.doc_id], r.toxic) for r in table(spark, larger, "labels").collect() if r.doc_id in got and got[r.doc_id].held_out]
    toxic, clean = [r.predicted for r, t in marks if t], [r.predicted for r, t in marks if not t]
    assert sum(toxic) >= 0.7 * len(toxic) > 0 and sum(clean) <= 0.05 * len(clean)


def test_op3_fingerprints_and_components(spark, texts):
    def fingerprint(text: str) -> int:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in prints}
    for _ in prints:  # labels move to the least neighbour until nothing changes
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if new == root:
            break
        root = new
    got = rows(spark, "op3_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_op4_against_all_windows(spark, texts):
    seen, expected = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(data[s:s + 100])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        expected[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    got = rows(spark, "op4_suffix_dedup")
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == expected


def test_op5_shards_hold_every_text(spark, texts):
    index = sorted(queries.QUERIES["op5_training_order"](spark, SMALL).collect(), key=lambda r: r.sequence)
    tokens, held, found = training_order.Tokens(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"), [], Counter()
    assert sorted(r.slot for r in index) == list(range(len(index)))
    for r in index:
        with open(r.path.removeprefix("file://"), "rb") as shard:
            shard.seek(r.byte_offset)
            record = shard.read(2 * 2048)
        assert hashlib.sha256(record).hexdigest() == r.sha256
        for t in np.frombuffer(record, "<u2")[:r.n_tokens].tolist():
            held.append(t)
            if t == tokens.end:
                found[tuple(held)] += 1
                held = []
    assert not held and found == Counter((*tokens.full.encode_ordinary(t), tokens.end) for t in texts.values() if t)


def test_op6_segments_every_text(spark, texts):
    encoder = sentencepiece.Encoder(sentencepiece.Vocabulary(f"{queries.TOKENIZERS}/piece_bpe_32k.model"))
    got = rows(spark, "op6_sentencepiece")
    assert {i: list(r.ids) for i, r in got.items()} == {i: [p for w in encoder.encode(t) for p in w] for i, t in texts.items()}
    assert all(r.n_pieces == len(r.ids) and r.decoded_equal and encoder.decode(list(r.ids)) == texts[i] for i, r in got.items())
    assert all(r.n_bytes_fallen_back == sum(p in encoder.byte_ids for p in r.ids) for r in got.values())


def test_op7_names_a_learned_language(spark, texts):
    got = rows(spark, "op7_language_id")
    learned = {r.lang for r in table(spark, SMALL, "documents").filter("lang is not null").collect()}
    for i, r in got.items():
        letters = any(map(str.isalpha, texts[i]))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in learned if letters else r.lang_pred == "und"
    model = language_id.train(table(spark, SMALL, "documents"), ~queries.held_out(4, 2))
    for i in sorted(texts, key=lambda i: len(texts[i]))[::20]:  # byte by byte, unit by unit
        if any(map(str.isalpha, texts[i])):
            chance = plain_language(texts[i].encode(), model)
            assert got[i].lang_pred == model.names[int(np.argmax(chance))] and got[i].score == pytest.approx(float(max(chance)), abs=1e-4)


def plain_language(data: bytes, model) -> np.ndarray:
    """Mean probabilities over the positions of all windows, one state after the other."""
    w, total = {k: v.astype(float) for k, v in model.weights.items()}, 0
    h, squash = len(w["uf"]), lambda x: 1 / (1 + np.exp(-x))
    for start in range(0, len(data), model.window):
        codes = [*data[start:start + model.window], *[256] * (model.window - len(data[start:start + model.window]))]
        states = {}
        for side, order in (("f", range(len(codes))), ("b", reversed(range(len(codes))))):
            state = np.zeros(h)
            for t in order:
                x = w["embed"][codes[t]] @ w[f"w{side}"] + w[f"c{side}"]
                u = w[f"u{side}"]
                update, reset = squash(x[:h] + state @ u[:, :h]), squash(x[h:2 * h] + state @ u[:, h:2 * h])
                state = state + update * (np.tanh(x[2 * h:] + (reset * state) @ u[:, 2 * h:]) - state)
                states[side, t] = state
        for t in range(len(data[start:start + model.window])):
            logits = np.concatenate([states["f", t], states["b", t]]) @ w["out"] + w["bias"]
            total = total + np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    return total / len(data)


def test_op7_on_languages_that_it_has_not_seen(spark):
    larger = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_id"](spark, larger).collect()}
    unseen = [(got[r.doc_id].lang_pred, r.lang) for r in table(spark, larger, "documents").collect() if r.lang is not None and got[r.doc_id].held_out and got[r.doc_id].lang_pred != "und"]
    assert len(unseen) > 100 and sum(a == b for a, b in unseen) >= 0.95 * len(unseen)


def test_op8_counts_are_the_librarys(spark, texts):
    library = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    got = rows(spark, "op8_token_counts")
    expected = {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == expected
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())


def test_op10_base_counts(spark, texts):
    got = rows(spark, "op10_quality_rules")
    for i, text in texts.items():
        words, lines = WORD.findall(text), text.split("\n")
        windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        repeated = {j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                    sum(1 for k, line in enumerate(lines) if WORD.search(line) and line in lines[:k]), len(repeated))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (r.kept and r.base_failed)
    assert any(r.kept for r in got.values()) and not all(r.kept for r in got.values())


def test_op11_packs_the_librarys_tokens(spark, texts):
    library = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    got, expected = queries.QUERIES["op11_packing"](spark, SMALL).collect(), {}
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i, piece] = (start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes()))
    assert len(got) == len(expected) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected
    sequences: dict[int, list] = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == sum(sequences.setdefault(r.sequence_id, []))
        sequences[r.sequence_id].append(r.length)
    assert all(sum(s) <= 1024 for s in sequences.values())
    left: list[int] = []  # best fit decreasing, piece by piece
    for size in sorted((r.length for r in got), reverse=True):
        fits = [c for c in left if c >= size]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else 1024) - size)
    assert sorted(left) == sorted(1024 - sum(s) for s in sequences.values())
