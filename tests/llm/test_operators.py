"""The corpus operators against brute force, round trips, held-out labels and the tokenizers' libraries."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece as library
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspark.llm import components, exact_dedup, language_id, merkle, mixing, packing, quality, queries, sentencepiece, simhash, suffix_dedup, token_count, toxicity, training_order, vector_codes
from gridspark.llm.common import scratch

SMALL = "/root/testdata/sf0.001"
BPE, TIKTOKEN, PIECES = (f"{queries.TOKENIZERS}/{n}" for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# --- exact dedup ---------------------------------------------------------------------------------------------------

def test_exact_dedup_tells_texts_apart_at_every_round(spark):
    same_prefix = ["p" * 300 + "a", "p" * 300 + "b", "P" * 300 + "A"]
    rows = list(enumerate([*same_prefix, "É", "é", "ab", "AB", "abc"]))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].keep_id for i in range(8)] == [2, 1, 2, 3, 4, 6, 6, 7]
    assert got[0].full_hash and got[7].full_hash is None  # the last shares its length with no other


# --- SimHash -------------------------------------------------------------------------------------------------------

def plain_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int], radius: int = 2) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[n] ^ values[:n]) <= radius):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(texts):
    for text in [*list(texts.values())[:40], None, "", " ", "one", "one two", "É ß 日本 x", "w " * 50_000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_against_all_pairs(docs, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    got = {r.doc_id: (r.fp & (2 ** 64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], root) for i, root in plain_components(prints).items()}


@pytest.mark.parametrize("tile", [4, 4096])
def test_tiles_of_any_size_find_the_same_components(spark, tile):
    random.seed(8)
    prints = {}
    for base in (random.getrandbits(64) for _ in range(12)):
        for _ in range(25):
            prints[len(prints)] = base
            base ^= 1 << random.randrange(64)
            base ^= random.choice([0, 1 << random.randrange(64)])
    first = {v: k for k, v in reversed(prints.items())}
    nodes = spark.createDataFrame([(k, np.uint64(v).astype(np.int64).item()) for v, k in first.items()], "node long, fp long")
    links = simhash.fingerprint_links(nodes, tile=tile)
    assert links.count() <= 40 * len(prints)
    roots = {r.node: r.root for r in components.components(links).collect()}
    plain = plain_components({k: v for v, k in first.items()})
    assert {k: roots.get(k, k) for k in plain} == plain


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}


# --- suffix array --------------------------------------------------------------------------------------------------

def plain_removal(rows: list[tuple[int, bytes]], length: int = 100) -> dict[int, list[bool]]:
    seen, out = set(), {}
    for i, data in rows:
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            if data[s:s + length] in seen:
                gone[s:s + length] = [True] * length
            seen.add(data[s:s + length])
        out[i] = gone
    return out


@pytest.mark.parametrize("seed,hot", [(0, suffix_dedup.HOT), (1, suffix_dedup.HOT), (2, 2)])
def test_removed_bytes_against_all_windows(spark, seed, hot):
    random.seed(seed)
    passages = ["".join(random.choice("abcd ") for _ in range(random.randint(60, 300))) for _ in range(6)]
    rows = []
    for i in range(50):
        parts = (random.choice(passages)[random.randint(0, 40):][:random.randint(50, 300)] if random.random() < 0.6
                 else "".join(random.choice("abé ") for _ in range(random.randint(0, 80))) for _ in range(random.randint(0, 5)))
        rows.append((i, "xy" * random.randint(1, 200) if random.random() < 0.1 else "".join(parts)))
    expected = plain_removal([(i, t.encode()) for i, t in rows])
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect():
        data = rows[r.doc_id][1].encode()
        assert bytes(r.kept) == bytes(b for b, gone in zip(data, expected[r.doc_id], strict=True) if not gone)


def test_anchors_with_one_hash_are_told_apart(spark):
    """Two strings of 32 bytes whose rolling hashes are equal, between equal bytes: no 100 bytes are repeated."""
    a, b = "bf yywlnvigfgmyqffh oettytyjskfv", "ndeyozmqijihvipdnnoeofkxmLM2BNT3"
    assert suffix_dedup.rolling_hash(np.frombuffer(a.encode(), np.uint8)) == suffix_dedup.rolling_hash(np.frombuffer(b.encode(), np.uint8))
    random.seed(0)
    left, right = ("".join(random.choice("abcdefghij ") for _ in range(68)) for _ in range(2))
    rows = [(1, left + a + right), (2, left + b + right), (3, left + b + "another end " * 6), (4, "x" + left[1:] + a + right)]
    for hot in (suffix_dedup.HOT, 1):
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
        assert got == {1: [], 2: [], 3: [(0, 100)], 4: [(1, 168)]}


@pytest.mark.parametrize("hot", [4, 60])
def test_a_phrase_with_many_surroundings(spark, hot):
    """A phrase of 90 bytes, of which alone nothing goes, in texts that share some bytes on one side, on both or on none; some repeat the text."""
    random.seed(9)
    phrase, ends = "".join(random.choice("abcdefgh ") for _ in range(90)), ["".join(random.choice("abcdefgh ") for _ in range(70)) for _ in range(5)]
    piece = lambda n: "".join(random.choice("xyz ") for _ in range(random.randint(0, n)))
    rows = [(i, piece(30) + random.choice(ends)[random.randint(40, 70):] + phrase + random.choice(ends)[:random.randint(0, 30)] + piece(30)) for i in range(300)]
    rows += [(300 + i, rows[i * 7][1] + piece(5)) for i in range(30)]
    expected = plain_removal([(i, t.encode()) for i, t in rows])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()
    assert len(got) == 330 and 50 < sum(any(gone) for gone in expected.values())
    for r in got:
        data = rows[r.doc_id][1].encode()
        assert bytes(r.kept) == bytes(b for b, gone in zip(data, expected[r.doc_id], strict=True) if not gone)


def test_long_texts_are_looked_through_in_blocks(monkeypatch):
    random.seed(2)
    texts = [bytes(random.choice(b"ab ") for _ in range(n)) for n in (5000, 90, 100, 3000)] + [b"xy" * 900]
    batch = pd.DataFrame({"doc": range(5), "check": [7] * 5, "text": texts})

    def found() -> set:
        rows = pd.concat(list(suffix_dedup._anchor_rows(100, 5)(iter([batch.copy()]))))
        return {(doc, at if at >= 0 else ~at) for doc, at in zip(rows["doc"].tolist(), rows["at"].tolist(), strict=True)}

    whole = found()
    monkeypatch.setattr(suffix_dedup, "SCANNED", 128)
    monkeypatch.setattr(suffix_dedup, "RESOLVED", 512)
    assert found() == whole and len(whole) > 200


def test_removed_bytes_on_documents(docs, texts):
    expected = plain_removal([(i, (texts[i] or "").encode()) for i in sorted(texts)])
    got = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {i: hashlib.sha256(bytes(b for b, g in zip((texts[i] or "").encode(), gone, strict=True) if not g)).hexdigest() for i, gone in expected.items()}


def test_deep_shallow_order_and_prefixes():
    random.seed(3)
    for _ in range(100):
        n = random.randint(1, 30)
        strings = [bytes(random.choice(b"ab") for _ in range(8)) + random.choice([b"x" * 8, b"xxxxxxxy"]) for _ in range(n)]
        assert [strings[i] for i in suffix_dedup.blind_order(strings)] == sorted(strings)
        group = np.unique(np.sort([random.randint(0, 3) for _ in range(n)]), return_inverse=True)[1]
        order, prefix = suffix_dedup.deep_shallow(group, np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 16), random.choice([0, 8, 16]))
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings, strict=True))
        for a, b, p in zip(order, order[1:], prefix[1:], strict=False):
            common = next((k for k in range(16) if strings[a][k] != strings[b][k]), 16)
            assert p == (common if group[a] == group[b] else -1)


# --- tokens --------------------------------------------------------------------------------------------------------

def odd_texts(n: int) -> list[str]:
    random.seed(1)
    pool = [*"abc 's'tTH\n\t\r\x85\xa0 　\x1c​٣é中日😀́ß_-!?.", "<|endoftext|>", "  ", "\n\n", "'ll", " ", " ", "▁"]
    return ["".join(random.choice(pool) for _ in range(random.randint(0, 30))) for _ in range(n)]


def test_token_counts_are_the_librarys(texts):
    tokenizer, counter = Tokenizer.from_file(BPE), token_count.Counter(BPE)
    for text in [*texts.values(), *odd_texts(3000), "a" * 20_000, "ab" * 700_000]:
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert counter.count(None) == 0


def test_a_full_table_of_counts_is_emptied(monkeypatch):
    monkeypatch.setattr(token_count, "KEPT", 3)
    counter = token_count.Counter(BPE)
    assert [counter.count(f"w{i} x y z") for i in range(20)] == [token_count.Counter(BPE).count(f"w{i} x y z") for i in range(20)]
    assert len(counter.words) <= 3


def test_training_order_round_trip(spark, docs, texts):
    path = scratch(spark)
    index = training_order.materialise(docs, TIKTOKEN, path, length=128, per_shard=50).orderBy("slot").collect()
    records = list(training_order.read_from(path, 0, 128, 50))
    assert [hashlib.sha256(r.tobytes()).hexdigest() for r in records] == [r.sha256 for r in index]
    assert [r.tobytes() for r in training_order.read_from(path, 77, 128, 50)] == [r.tobytes() for r in records[77:]]
    assert {r.path for r in index} == {f"{path}/shard-{i:08d}.bin" for i in range(-(-len(index) // 50))}
    assert training_order.permuted(np.array([r.sequence for r in index]), len(index), 42).tolist() == list(range(len(index)))
    ranks = training_order.Tokens(TIKTOKEN)
    expected = Counter(tuple(ranks.full.encode_ordinary(t)) for t in texts.values() if t)
    found, held = Counter(), []
    for r, record in sorted(zip(index, records, strict=True), key=lambda x: x[0].sequence):
        for t in record[:r.n_tokens].tolist():
            if t == ranks.end:
                found[tuple(held)] += 1
                held = []
            else:
                held.append(t)
    assert not held and found == expected


def test_training_order_does_not_depend_on_partitions(spark, docs):
    both = []
    for n in (3, 7):
        index = training_order.materialise(docs.repartition(n), TIKTOKEN, scratch(spark), length=128, per_shard=50)
        both.append(sorted((r.slot, r.sequence, r.n_tokens, r.sha256) for r in index.collect()))
    assert both[0] == both[1]


def test_tokens_with_and_without_runs_of_white_space():
    ranks = training_order.Tokens(TIKTOKEN)
    for text in odd_texts(5000):
        assert ranks.of(text).tolist() == ranks.full.encode_ordinary(text)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation_that_depends_on_the_key(n):
    one, other = (training_order.permuted(np.arange(n), n, key) for key in (1, 2))
    assert sorted(one) == sorted(other) == list(range(n))
    assert n < 64 or (one != other).any() and (one != np.arange(n)).any()


# --- SentencePiece -------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def encoder():
    return sentencepiece.Encoder(sentencepiece.Vocabulary(PIECES))


def score_of(encoder, ids) -> float:
    unknown = encoder.vocabulary.least - sentencepiece.UNKNOWN_PENALTY
    return sum(0 if i in encoder.byte_ids else encoder.vocabulary.scores[i] for i in ids) + unknown * sum(i in encoder.byte_ids for i in ids)


def test_viterbi_against_every_segmentation(encoder):
    random.seed(6)
    pieces = {encoder.vocabulary.pieces[i]: encoder.vocabulary.scores[i] for i in encoder.vocabulary.normal}
    for _ in range(60):
        word = "▁" + "".join(random.choice(["the", "re", "a", "in", "s", "▁", "ing", "t"]) for _ in range(random.randint(1, 4)))

        def best(at: int) -> float:
            if at == len(word):
                return 0.0
            return max(pieces[word[at:end]] + best(end) for end in range(at + 1, len(word) + 1) if word[at:end] in pieces)

        assert score_of(encoder, encoder.viterbi(word)) == best(0)


def varint(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def test_the_librarys_lattice_finds_nothing_better(encoder):
    """The library runs its unigram search on the same pieces when the model file's type is changed."""
    data, at, out = open(PIECES, "rb").read(), 0, b""
    while at < len(data):
        tag, size, shift, at = data[at], 0, 0, at + 1
        while True:
            size, shift, at = size | (data[at] & 127) << shift, shift + 7, at + 1
            if data[at - 1] < 128:
                break
        body, at = data[at:at + size] + (b"\x18\x01" if tag >> 3 == 2 else b""), at + size
        out += bytes([tag]) + varint(len(body)) + body
    unigram = library.SentencePieceProcessor(model_proto=out)
    random.seed(5)
    for _ in range(500):
        text = "".join(random.choice(["the", "tion", "er", "a", " ", "e", "t", "he"]) for _ in range(random.randint(1, 10))).strip()
        ours = [i for word in encoder.encode(text) for i in word]
        assert score_of(encoder, ours) >= score_of(encoder, unigram.nbest_encode_as_ids(text, 2)[0])


def test_decoding_gives_the_text_back(spark, encoder, texts):
    library_model = library.SentencePieceProcessor(model_file=PIECES)
    for text in [*texts.values(), *(t for t in odd_texts(500) if "▁" not in t), "a  b ", " lead"]:
        ids = [i for word in encoder.encode(text) for i in word]
        assert encoder.decode(ids) == text and (not text or library_model.decode(ids) == text)
    rows = spark.createDataFrame([(list(encoder.viterbi("▁hello")),), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in rows.select(sentencepiece.decode(F.col("ids"), PIECES)).collect()] == ["hello", None, ""]


# --- quality -------------------------------------------------------------------------------------------------------

def test_repeated_words_against_windows():
    random.seed(3)
    for _ in range(500):
        words = [random.choice("abc"[:random.randint(1, 3)]) for _ in range(random.randint(0, 60))]
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        marked = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert quality.repeated_words(words) == len(marked)


def test_base_counts_and_bands(spark):
    assert quality.base_counts("a b\n\na b\n a b\n#x*") == (7, 9, 2, 1, 0)
    random.seed(9)
    noise = "".join(chr(random.randint(0x4E00, 0x9000)) + " " * (i % 7 == 0) for i in range(4000))
    prose = " ".join("".join(random.choice(["an", "the", "or", "ing", "st"]) for _ in range(random.randint(1, 4))) for _ in range(600))
    rows = [(1, prose), (2, noise), (3, "again and again " * 400), (4, prose + " spam" * 30_000)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].in_bands for i in (1, 3, 4)] == [True, False, False] and not got[4].kept and got[1].kept


# --- learned operators ---------------------------------------------------------------------------------------------

def test_non_negative_risk_gradient():
    margin, positive, h = np.array([0.3, -1.2, 2.0, 0.1, -0.7]), np.array([True, False, True, False, False]), 1e-6

    def risk(m, prior):
        loss = lambda z: np.logaddexp(0, -z)
        bracket = loss(-m[~positive]).mean() - prior * loss(-m[positive]).mean()
        return (prior * loss(m[positive]).mean() + bracket) if bracket >= 0 else -bracket

    for prior in (0.2, 0.95):
        gradient, _ = toxicity.risk_gradient(margin, positive, prior)
        for i in range(5):
            up, down = margin.copy(), margin.copy()
            up[i], down[i] = up[i] + h, down[i] - h
            assert abs((risk(up, prior) - risk(down, prior)) / (2 * h) - gradient[i]) < 1e-5


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r.predicted for r in got if r.toxic], [r.predicted for r in got if not r.toxic]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.05


def test_network_gradient():
    s = language_id.Settings(hidden=3, embedding=2, window=5)
    w = {k: v.astype(np.float64) for k, v in language_id.initial(3, s).items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (4, 5)), rng.integers(0, 3, 4)
    _, g = language_id.loss_gradient(x, y, w)
    for k in w:
        at = (x[0, 1], 0) if k == "embed" else tuple(rng.integers(0, n) for n in w[k].shape)
        old, losses = w[k][at], []
        for d in (1e-3, -1e-3):
            w[k][at] = old + d
            losses.append(language_id.loss_gradient(x, y, w)[0])
        w[k][at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[k][at]) < 1e-4


def test_only_letters_have_a_language(spark):
    model = language_id.fit(["plain words of one", "otras palabras de otra"] * 3, ["en", "es"] * 3, language_id.Settings(steps=2, batch=4))
    texts = ["²", "½ ① Ⅷ", "12 _ ٣", "a", "１x", "日", "ª", None, ""]
    got = language_id.language_id(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or "")))


def test_labels_of_positions_are_the_plain_networks():
    s = language_id.Settings(hidden=5, embedding=4, window=9)
    w = {k: v * 3 for k, v in language_id.initial(3, s).items()}
    rows = np.random.default_rng(1).integers(0, 257, (6, 9)).astype(np.int16)
    embedded = w["embed"][rows.T]
    states = [language_id.scan(embedded @ w["wf"] + w["cf"], w["uf"]), language_id.scan((embedded @ w["wb"] + w["cb"])[::-1], w["ub"])[::-1]]
    logits = np.exp(np.concatenate(states, axis=2) @ w["out"] + w["bias"])
    assert np.abs(language_id.position_scores(rows, w) - (logits / logits.sum(axis=2, keepdims=True)).transpose(2, 0, 1)).max() < 1e-5


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


# --- mixing --------------------------------------------------------------------------------------------------------

def test_raked_shares_meet_every_marginal(spark):
    cells = spark.createDataFrame([(s, t, 10 * (s + 1) * (t + 2) + s * t) for s in range(4) for t in range(3)], "s int, t int, tokens long")
    targets = mixing.with_targets(cells, ["s", "t"], 0.5)
    raked = mixing.rake(targets, ["s", "t"], 12)
    for d in "st":
        for r in raked.groupBy(d).agg(F.sum("share").alias("share"), F.first(f"target_{d}").alias("target")).collect():
            assert abs(r.share - r.target) < 1e-9


def test_sample_has_the_calibrated_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
                                      F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    mixed = mixing.mix(docs, power=0.5)
    kept = {r.source: r.n for r in mixed.filter("kept").groupBy("source").agg(F.count("*").alias("n")).collect()}
    wanted = {r.source: r.w for r in mixed.groupBy("source").agg(F.sum("weight").alias("w")).collect()}
    for source in kept:
        assert abs(kept[source] / sum(kept.values()) - wanted[source] / sum(wanted.values())) < 0.02


def test_given_targets_against_sql(spark, docs):
    """Shares for sources and topics, one of a source that does not occur, one that is NULL; languages keep theirs."""
    named = docs.withColumn("source", F.when(F.col("doc_id") % 11 != 0, F.col("source")))
    sources = [r[0] for r in named.select("source").distinct().orderBy("source").collect()]
    wanted = [(v, float(i + 1)) for i, v in enumerate(sources)] + [("nowhere", 5.0)]
    kinds = [("short", 0.5), ("article", 0.3), ("note", 0.2)]
    mixed = mixing.mix(named, targets={"source": spark.createDataFrame(wanted, "value string, share double"), "topic": spark.createDataFrame(kinds, "value string, share double")})
    con = duckdb.connect()
    con.register("documents", named.toPandas())
    con.register("by_source", pd.DataFrame(wanted, columns=["value", "share"]))
    con.register("by_topic", pd.DataFrame(kinds, columns=["value", "share"]))
    theirs = con.sql(mixing.mix_sql(targets={"source": "by_source", "topic": "by_topic"})).fetchall()
    mine = [(r.doc_id, r.source, r.lang, r.topic, r.tokens, round(r.weight, 6), round(r.probability, 6), r.kept) for r in mixed.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(mine, key=key) == sorted(theirs, key=key)
    assert not any(r[3] == "long" and r[7] for r in mine) and any(r[7] for r in mine)
    tokens, total = {}, sum(r[4] for r in mine)
    for r in mine:
        tokens[r[3]] = tokens.get(r[3], 0) + r[4] * r[5] / total
    there = sum(v for k, v in kinds if k in tokens)
    assert all(abs(tokens.get(k, 0) - v / there) < 1e-3 for k, v in kinds if k in tokens)


# --- similar texts -------------------------------------------------------------------------------------------------

def shingle_set(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard(a, b) -> float:
    return len(a & b) / len(a | b)


def changed(words, n):
    out = list(words)
    for i in random.sample(range(len(out)), n):
        out[i] = f"other{random.randint(0, 99999)}"
    return out


@pytest.mark.parametrize("full", [8, 4096])
def test_near_copies_against_all_pairs(spark, full):
    """Pairs from 0.6 to 0.98 alike, groups of up to 40: none below 0.8 links, of those above all do but a few just at 0.8."""
    random.seed(8)
    texts = []
    for group in range(40):
        words = [f"w{random.randint(0, 9999)}" for _ in range(random.choice([9, 40, 150, 300, 1000]))]
        texts.append(words)
        for _ in range(40 if group == 0 else random.choice([1, 2, 5])):
            texts.append(changed(words, max(1, round(len(words) * random.uniform(0.002, 0.05)))))
    random.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if jaccard(a, b) >= 0.8}
    for i, j in similar:
        root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sketches = docs.select(F.sha2("text", 256).alias("key"), "doc_id", simhash.sketch(F.col("text"), 5).alias("s")).select("key", "doc_id", "s.*")
    ids = {r.node: r.doc_id for r in sketches.collect()}
    links = simhash.similar_links(sketches, docs.select(F.sha2("text", 256).alias("key"), "text"), full=full).collect()
    assert all(tuple(sorted((ids[r.a], ids[r.b]), reverse=True)) in similar for r in links)  # nothing below
    kept, expected = {r.doc_id for r in simhash.without_near_copies(docs, full=full).collect()}, {find(i) for i in range(len(rows))}
    assert expected <= kept and len(kept) - len(expected) <= 0.02 * (len(rows) - len(expected))
    assert sum(0.7 < jaccard(sets[i], sets[j]) < 0.8 for i in range(len(rows)) for j in range(i)) > 20


def test_pairs_that_are_not_similar_make_no_rows(spark, monkeypatch):
    """150 texts alike by 0.65 to 0.8 but for four pairs: what is written grows with the texts, not with their pairs."""
    random.seed(31)
    base, made, write = [f"w{random.randint(0, 9999)}" for _ in range(300)], [], simhash.written
    texts = [" ".join(changed(base, 5)) for _ in range(150)]
    sets = [shingle_set(t) for t in texts]
    alike = {(i, j): jaccard(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])}
    assert sum(0.65 < s < 0.8 for s in alike.values()) > 11_000

    def counted(df, *rest):
        made.append(write(df, *rest))
        return made[-1]

    monkeypatch.setattr(simhash, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sketches = docs.select(F.sha2("text", 256).alias("key"), "doc_id", simhash.sketch(F.col("text"), 5).alias("s")).select("key", "doc_id", "s.*")
    ids = {r.node: r.doc_id for r in sketches.collect()}
    # sets of so few shingles together that the group is cut into eight parts
    links = simhash.similar_links(sketches, docs.select(F.sha2("text", 256).alias("key"), "text"), hold=12_000).collect()
    assert {tuple(sorted((ids[r.a], ids[r.b]), reverse=True)) for r in links} == {p for p, s in alike.items() if s >= 0.8}
    assert max(t.count() for t in made) <= 10 * len(texts)


@pytest.mark.parametrize("hold", [10, 200, 10 ** 6])
def test_groups_hold_every_pair(hold):
    rng = np.random.default_rng(hold)
    near = np.triu(rng.random((120, 120)) < 0.01, 1)
    near, n = near | near.T, rng.integers(4, 12, 120)
    groups = simhash._groups(np.arange(120), n, near, hold)
    met = np.zeros_like(near)
    for some in groups:
        assert len(set(some.tolist())) == len(some) > 1
        assert len(some) == 2 or n[some].sum() <= hold + 2 * 12
        met[np.ix_(some, some)] = True
    assert (near <= met).all()
    assert not simhash._groups(np.arange(3), n[:3], np.zeros((3, 3), bool), hold)


def test_joined_sets_against_all_pairs():
    """Links connect what similar pairs connect, also through members that are of one root already."""
    rng = np.random.default_rng(17)
    base = [rng.integers(0, 1 << 63, 60, np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([b[rng.permutation(60)[:rng.integers(50, 60)]], rng.integers(0, 1 << 63, rng.integers(0, 6), np.uint64)])) for b in base for _ in range(12)]
    root = np.where(rng.random(48) < 0.3, -1, np.arange(48)).astype(np.int64)
    similar = {(i, j) for i in range(48) for j in range(i + 1, 48) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8}

    def classes(pairs):
        label = root.tolist()
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        return [label.index(x) for x in label]

    found = simhash._joined(root, sets, 0.8)
    assert set(found) <= similar and len(found) < 48 and classes(found) == classes(similar) != classes([])


def test_keys_find_similar_sets():
    """Of pairs at 0.8 to 0.82 nearly all share a key and are near by their fingerprints."""
    random.seed(2)
    found = []
    for _ in range(300):
        a = np.array([random.getrandbits(64) for _ in range(500)], np.uint64)
        b = np.concatenate([a[:450], np.array([random.getrandbits(64) for _ in range(random.choice([50, 55, 60]))], np.uint64)])  # 450 / 560 is 0.804
        share = (simhash.band_keys(np.unique(a)) == simhash.band_keys(np.unique(b))).any()
        bits = np.bitwise_count(simhash.long_fingerprint(a) ^ simhash.long_fingerprint(b)).sum()
        found.append(share and bits <= simhash.most_bits(0.8))
    assert sum(found) >= 0.98 * len(found)


def test_tiles_are_cut_by_bits_of_the_fingerprint():
    """Fingerprints as far apart as 0.8 is expected to be meet in a tile; few fingerprints make one tile, where all pairs meet."""
    rng = np.random.default_rng(4)
    for nodes in (300_000, 20_000_000):
        bits = simhash.tile_bits(nodes)
        times = simhash.deals(0.8, bits)
        one = rng.integers(0, 1 << 63, (500, simhash.WORDS), np.uint64)
        flips = np.packbits(rng.random((500, 64 * simhash.WORDS)) < simhash.differing_share(0.8), axis=1).view("<u8")
        keys, other = (simhash.tile_keys(w, bits, times) for w in (one, one ^ flips))
        assert (keys == other).any(axis=1).mean() >= 0.995
        assert (keys[:-1] == other[1:]).mean() < 4 / 2 ** bits  # strangers meet by chance only
    assert simhash.tile_bits(2048) == 0 and simhash.deals(0.8, 0) == 1 and not simhash.tile_keys(one, 0, 1).any()


def test_fingerprints_of_small_sets_tell_enough():
    """Four shingles of five: more bits differ than in large sets, and still the pair is looked at, strangers are not."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, 5, np.uint64)) for _ in range(200)]
    wide = np.stack([simhash.long_fingerprint(s) for s in sets])
    less = np.stack([simhash.long_fingerprint(s[:4]) for s in sets])
    for words in (simhash.NARROW, simhash.WORDS):
        bits = lambda a, b, k=words: np.bitwise_count(a[:, :k] ^ b[:, :k]).sum(axis=1, dtype=np.int64)
        near = lambda d, k=words: simhash._within(d, np.full(len(d), 5), np.full(len(d), 4), 0.8, k)
        assert near(bits(wide, less)).mean() >= 0.99 and near(bits(wide[1:], less[:-1])).mean() < 0.05


def test_share_of_differing_bits():
    random.seed(3)
    for n in (4, 12, 30):
        words = [f"w{random.randint(0, 9999)}" for _ in range(1500)]
        a, b = " ".join(words), " ".join(changed(words, n * 3))
        bits = int(np.bitwise_count(simhash.long_fingerprint(simhash.shingle_set(a, 5)) ^ simhash.long_fingerprint(simhash.shingle_set(b, 5))).sum())
        assert abs(bits / 1024 - simhash.differing_share(jaccard(shingle_set(a), shingle_set(b)))) < 0.05
    assert not len(simhash.shingle_set(None, 5)) and (simhash.shingle_set("A b", 5) == simhash.shingle_set("a  B", 5)).all()



# --- packing -------------------------------------------------------------------------------------------------------

def test_best_fit_over_counts_is_best_fit_piece_by_piece():
    random.seed(5)
    for _ in range(200):
        length = random.choice([1, 2, 7, 20, 64, 100])
        counts = {s: random.randint(1, random.choice([3, 40])) for s in random.sample(range(1, length + 1), random.randint(1, length))}
        left: list[int] = []
        for size in sorted(counts, reverse=True):
            for _ in range(counts[size]):
                fits = [c for c in left if c >= size]
                if fits:
                    left.remove(min(fits))
                left.append((min(fits) if fits else length) - size)
        sizes, ranks = (np.array(a) for a in zip(*((s, r) for s, n in counts.items() for r in range(n)), strict=True))
        sequence, offset = packing.Places(packing.best_fit(counts, length)).find(sizes, ranks)
        ends = Counter()
        for q, o, s in sorted(zip(sequence.tolist(), offset.tolist(), sizes.tolist(), strict=True)):
            assert ends[q] == o  # no gaps, no overlaps
            ends[q] += s
        assert sorted(length - e for e in ends.values()) == sorted(left)


def test_best_fit_does_not_grow_with_counts():
    random.seed(6)
    small = {s: random.randint(1, 100) for s in range(1, 1025)}
    large = {s: n * 10 ** 9 for s, n in small.items()}
    assert len(packing.best_fit(large, 1024)) < 4 * len(packing.best_fit(small, 1024)) + 1024


def test_tightest_capacity():
    tree, there = packing.Capacities(37), set()
    random.seed(7)
    for _ in range(500):
        c = random.randint(1, 37)
        there ^= {c}
        tree.set(c, c in there)
        size = random.randint(1, 37)
        assert tree.tightest(size) == min((x for x in there if x >= size), default=None)


# --- Merkle manifest -----------------------------------------------------------------------------------------------

def test_postorder_places_are_where_the_log_has_them():
    for leaves in (1, 2, 15, 16, 17, 33, 255, 256, 257, 300, 4095, 4096):
        log = merkle.Log()
        for i in range(leaves):
            log.add(f"{i:064x}")
        nodes, levels = log.close(False).hex(), len(merkle.widths(leaves)) - 1
        level = [f"{i:064x}" for i in range(leaves)]
        for n, width in enumerate(merkle.widths(leaves)):
            assert len(level) == width
            for i, digest in enumerate(level):
                at = 64 * merkle.postorder(n, i, leaves)
                assert nodes[at:at + 64] == digest
            level = ["".join(level[i:i + 16]) for i in range(0, width, 16)]
            level = [merkle.node(run) for run in level] if n < levels else []
        assert len(nodes) == 64 * sum(merkle.widths(leaves))


def test_manifest_over_several_rounds(spark):
    rows = [(i, "big", i) for i in range(5000)] + [(i, f"s{i % 20}", i) for i in range(5000, 5060)] + [(6000, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long").select("*", F.lit("en").alias("lang"), F.concat(F.lit("Text "), "doc_id").alias("text"))
    got = {r.id: r for r in merkle.manifest(df.repartition(7), tampered=F.col("doc_id") % 5 == 0).collect()}

    def levels(digests):
        found = [digests]
        while len(found[-1]) > 1:
            found.append([merkle.node("".join(found[-1][i:i + 16])) for i in range(0, len(found[-1]), 16)])
        return found

    trees = {}
    for i, source, _ in rows:
        trees.setdefault(source, []).append(got[i].leaf)
    trees = {s: levels(t) for s, t in sorted(trees.items(), key=lambda x: (x[0] is not None, x[0] or ""))}
    top = levels([t[-1][0] for t in trees.values()])
    seen = Counter()
    for i, source, _ in rows:
        path, tree = [], trees[source]
        for nodes, at in ((tree, seen[source]), (top, list(trees).index(source))):
            for level in nodes[:-1]:
                run = at // 16 * 16
                path += [d for j, d in enumerate(level[run:run + 16]) if j + run != at]
                at //= 16
        seen[source] += 1
        assert got[i].proof_sha256 == hashlib.sha256("".join(path).encode()).hexdigest()
        assert (got[i].subroot, got[i].root) == (tree[-1][0], top[-1][0]) and got[i].verified == (i % 5 != 0)


# --- vector codes --------------------------------------------------------------------------------------------------

def test_pivots_leave_out_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 8))
    parts = (centres[rng.integers(0, 16, 5000)] + rng.integers(-300, 300, (5000, 8))).astype(np.int64)
    entries = np.concatenate([centres[:14], centres[:1], centres[:1]]).astype(np.int64)  # equal entries tie
    pivots, tried = parts[:4], []
    index, least = vector_codes.nearest(parts, vector_codes.distances(parts, pivots), entries, pivots, tried)
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert sum(tried) < 0.5 * every.size
    huge = parts.astype(object) * 10 ** 12
    index_huge, least_huge = vector_codes.nearest(huge, vector_codes.distances(huge, huge[:4]), entries.astype(object) * 10 ** 12, huge[:4])
    assert (index_huge == index).all() and (least_huge == least.astype(object) * 10 ** 24).all()


# --- language: every language, windows from all over a text ---------------------------------------------------------

def test_every_language_is_learned(spark):
    random.seed(9)
    rows = [(10 * k + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 40, f"l{k:03}") for k in range(230) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, settings=language_id.Settings(steps=2, batch=8))
    assert len(model.names) == 230


def test_windows_are_drawn_from_whole_texts(spark):
    text = "".join(f"{i:08d}" * 8 for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.w) for r in df.select("doc_id", language_id.some_windows(F.col("text"), F.col("doc_id"), 64, 10, 1).alias("w")).collect()}
    places = [int(got[1][i:i + 8]) for i in range(0, 640, 64)]
    assert len(got[1]) == 640 and places == sorted(set(places)) and places[-1] > 500 and got[2] == b"short" and got[3] == b""


# --- training order: few ranges, many shards --------------------------------------------------------------------------

def test_a_task_writes_several_shards(spark, docs, texts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        path = scratch(spark)
        index = training_order.materialise(docs.repartition(5), TIKTOKEN, path, length=128, per_shard=16)
        rows = sorted(index.collect(), key=lambda r: r.sequence)
        assert len({r.shard for r in rows}) > 30 and index.count() == len(rows)
        read = list(training_order.read_from(path, 0, 128, 16))
        tokens = training_order.Tokens(TIKTOKEN)
        stream = [t for r in rows for t in read[r.slot][:r.n_tokens].tolist()]
        assert len(stream) == sum(len(tokens.of(t)) + 1 for t in texts.values() if t)
        assert [hashlib.sha256(read[r.slot].tobytes()).hexdigest() for r in rows] == [r.sha256 for r in rows]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
