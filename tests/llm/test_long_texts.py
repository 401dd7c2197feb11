"""Very long texts, with and without white space, through the operators that read whole texts."""

import random

import pytest

from turnloom.llm import block_anchors, decontaminate, difference_cover, exact_dedup, importance, jaccard_join

R = random.Random(11)
SOLID = "".join(R.choice("abcdefgh") for _ in range(1_000_000))
WORDS = " ".join(str(R.randrange(10**6)) for _ in range(300_000))
SAME = "word " * 1_000_000
ROWS = [(1, SOLID), (2, WORDS), (3, SAME), (4, SOLID), (5, WORDS + " tail"), (6, None), (7, "")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "d")
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).select("row.doc_id", "n_shingles", "component_id").collect()}
    assert got[1] == (1, 1) and got[4] == (1, 1) and got[3] == (1, 3) and got[6] == (0, 6) and got[7] == (0, 7)
    assert got[2][1] == got[5][1] == 2 and got[5][0] == got[2][0] + 1


def test_repeated_words(docs):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in block_anchors.remove_repeats(docs).select("row.doc_id", "n_words", "n_removed").collect()}
    assert got[1] == (1, 0) and got[2] == (300_000, 0) and got[5] == (300_001, 300_000) and got[3] == (1_000_000, 999_999) and got[6] == (0, 0)


def test_repeated_bytes(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in difference_cover.remove_repeated_bytes(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got[1] == got[4] == (10**6, 10**6, 1) and got[3] == (5 * 10**6, 5 * 10**6, 1) and got[6] == (0, 0, 0)
    assert got[2] == (len(WORDS), len(WORDS), 1) and got[5] == (len(WORDS) + 5, len(WORDS), 1)


def test_exact_copies(docs):
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [2, 3, 4, 5, 7]


def test_benchmark_passages(spark, docs):
    items = spark.createDataFrame([(1, SOLID[500_000:500_400]), (2, " ".join(WORDS.split(" ")[1000:1060]))], "item_id long, text string")
    got = {(r.row.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, items).collect()}
    assert got == {(1, 1), (4, 1), (2, 2), (5, 2)}


def test_weights(spark, docs):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = importance.Resampler(docs, labels).draw().collect()
    assert len(got) == len(ROWS) and all(r.log_weight == r.log_weight for r in got)
