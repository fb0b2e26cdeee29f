"""The pipeline: every stage against a plain version of it, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import mixing, queries, sentencepiece, simhash, toxicity
from gridspark.llm.common import DOCUMENT_COLUMNS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_copies(rows):
    """Of equal texts the row with the largest id stays, of whole rows one; an id is a number here."""
    best = {}
    for row in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in row.text or "")
        best[text] = max(best.get(text, row), row, key=lambda r: r.doc_id)
    return set(best.values())


def plain_near_copies(rows):
    rows = sorted(rows, key=lambda r: r.doc_id)
    sets, root = [shingle_set(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {r for i, r in enumerate(rows) if find(i) == i}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic texts, copies of a third of all, near copies, NULL and empty texts, repeated rows; no two texts are nearly similar enough."""
    random.seed(12)
    folder = str(tmp_path_factory.mktemp("corpus"))
    words = [f"{c}{d}ord" for c in "abcdefghij" for d in "klmnopqrst"]
    bad = ["vilest", "filthy", "hateful"]
    rows, labels, hot = [], [], " ".join(random.choice(words) for _ in range(120))
    for i in range(240):
        text = [random.choice(words) for _ in range(random.randint(90, 200))]
        toxic = i % 4 == 0
        if toxic:
            for at in random.sample(range(len(text)), 8):
                text[at] = random.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, hot.upper() if i % 2 else hot) for i in range(120)]
    for i in range(1, 60, 2):
        near = rows[i][1].split()
        near[random.randrange(len(near))] = "changed"
        rows.append((2000 + i, " ".join(near)))
    rows += [(3000, None), (3001, ""), (3002, " \n"), rows[1], rows[1]]
    spark.createDataFrame([(i, t, random.choice(["en", None]), random.choice(["a", "a", "b", None]), len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_every_stage_and_the_run(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at.collect()
        at = stage(spark, at, corpus)
        assert at.columns == list(DOCUMENT_COLUMNS)
        at = spark.createDataFrame(at.collect(), SCHEMA)
        kept[name] = after = at.collect()
        assert after and (name == "toxicity" or len(after) < len(before))
        if name == "toxicity":  # too few texts to learn from; test_toxic_texts_go has more
            model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"), ~queries.held_out(3, 1))
            scored = {(r.doc_id, r.text): r.s for r in docs.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("s")).collect()}
            assert sorted(map(str, after)) == sorted(str(r) for r in before if not (r.text or "").split() or scored[r.doc_id, r.text] < 0.7)
        elif name == "exact_dedup":
            assert len(after) == len(set(after)) and {(r.doc_id, r.text) for r in after} == {(r.doc_id, r.text) for r in plain_copies(before)}
        elif name == "near_dedup":
            assert set(after) == plain_near_copies(before)
        elif name == "mixing":
            wanted = {r.doc_id for r in mixing.mix(spark.createDataFrame(before, SCHEMA)).filter("kept").collect()}
            assert {r.doc_id for r in after} == wanted
    encoder = sentencepiece.Encoder(sentencepiece.Vocabulary(PIECES))
    expected = {r.doc_id: [i for w in encoder.encode(r.text) for i in w] for r in at.collect()}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, corpus).collect()}
    assert {i: list(r.ids) for i, r in found.items()} == expected and all(r.decoded_equal for r in found.values())


def test_toxic_texts_go(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, sf).collect()}
    marks = labels.filter(~queries.held_out(3, 1)).join(docs.select("doc_id"), "doc_id").collect()
    assert sum(r.doc_id in left for r in marks if r.toxic) <= 0.25 * sum(r.toxic for r in marks)
    assert sum(r.doc_id in left for r in marks if not r.toxic) >= 0.95 * sum(not r.toxic for r in marks)


def test_verdicts_are_a_rows_own(spark):
    """An id with two texts, copies with a NULL id, whole rows repeated."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c), (3, d), (3, d), (None, d)]
    stays = lambda stage: sorted((r.doc_id or 0, r.text[0]) for r in stage(spark, frame(spark, rows), "").collect())
    assert stays(corpus_pipeline.without_copies) == [(0, "c"), (1, "b"), (2, "a"), (3, "d")]
    assert stays(corpus_pipeline.without_near_copies) == [(0, "c"), (1, "a"), (1, "b"), (3, "d")]


def test_texts_without_words_are_not_toxic(spark, tmp_path):
    """Even where nearly every labelled text is toxic, so that the prior is above the threshold."""
    spark.createDataFrame([(i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"some vile text {i}") for i in range(40)] + [(50, None), (51, ""), (52, " \t\n")]
    left = {r.doc_id for r in corpus_pipeline.without_toxic(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert {50, 51, 52} <= left


def test_sketches_need_whole_texts():
    text = " ".join(f"w{i}" for i in range(5000))
    one, two = simhash.shingle_set(text, 5), simhash.shingle_set(text + " more words at the very end", 5)
    assert len(two) == len(one) + 6 and (simhash.long_fingerprint(one) != simhash.long_fingerprint(two)).any()
