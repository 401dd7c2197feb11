import hashlib
import random
import re

import pytest

from turnloom.llm.block_anchors import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen, gone = set(), []
    for i in sorted(range(len(docs)), key=lambda i: (-1 if docs[i][0] is None else docs[i][0])):
        w, g = docs[i][1], set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                g.update(range(p, p + window))
            seen.add(key)
        gone.append((docs[i][0], len(w), len(g), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in g).encode()).hexdigest()))
    return gone


@pytest.mark.parametrize("window,seed", [(20, 1), (6, 2), (4, 3)])
def test_equals_brute_force(spark, tmp_path, window, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(50 if window > 4 else 6)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(window // 2, 3 * window))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choice(passages) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 30))]
            if w and r.random() < 0.4:
                w[r.randrange(len(w))] = "X"
        rows.append((i * 7 % 120, r.choice([" ", " \n", "\t"]).join(w)))
    rows += [(200, None), (201, ""), (202, "  "), (None, " ".join(passages[0] * 2)), (203, "same word " * 4000), (204, rows[3][1])]
    spark.createDataFrame([(i, t, 0, "r") for i, t in rows], "doc_id long, text string, n_words int, row string").repartition(4).write.parquet(f"{tmp_path}/d")
    got = remove_repeats(spark.read.parquet(f"{tmp_path}/d"), window=window, unit_bytes=4000, part_probes=500)
    got = got.select("row.doc_id", "n_words", "n_removed", "kept_sha256", "spans").collect()
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted([tuple(x)[:4] for x in got], key=key) == sorted(brute(rows, window), key=key)
    assert all(sum(s.end - s.first for s in x.spans) == x.n_removed for x in got) and sum(x.n_removed for x in got) > 1000


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_that_clash_modulo_powers_of_two(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, " ".join([a] * 20)), (2, " ".join([b] * 20)), (3, " ".join([b] * 20))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0), (3, 20)]


def test_splits_may_change_between_scans(spark, tmp_path):
    """Places do not depend on how Spark cuts the files."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(str(r.random()) for _ in range(30)) + (" " + passage if i % 3 else "")) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    frame = remove_repeats(spark.read.parquet(f"{tmp_path}/d"))
    for name, value in (("spark.sql.leafNodeDefaultParallelism", "2"), ("spark.sql.files.maxPartitionBytes", "1000")):
        spark.conf.set(name, value)
    try:
        assert frame.where("n_removed > 0").count() == sum(i % 3 > 0 for i, _ in rows) - 1
    finally:
        for name in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(name)
