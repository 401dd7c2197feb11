import hashlib

from turnloom.llm.exact_dedup import build_index, drop_exact_duplicates, exact_dedup

ROWS = [(1, "a", 5), (2, "b", 5), (3, "a", 6), (None, "a", 7), (4, "", 1), (5, None, 1), (6, "A", 2), (6, "A", 3), (None, "n", 1), (None, "n", 2), (7, "é" * 5000, 0), (8, "é" * 5000, 0)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, gid int").repartition(4)


def check(rows):
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(t or "", []).append(i)
    assert len(rows) == len(ROWS)
    for r in rows:
        same = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(same) and r.keep_id == max((x for x in same if x is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups)


def test_equal_texts(spark):
    check(exact_dedup(docs(spark)).collect())


def test_colliding_keys_and_split_buckets(spark):
    for bits, size in ((1, 64), (3, 64), (63, 4), (63, 2000)):
        index = build_index(docs(spark), key_bits=bits, bucket_bytes=size)
        check(index.rows().collect())
        firsts = [a for a, _ in index.directory]
        assert firsts == sorted(set(firsts)) and sum(2.0**-d for _, d in index.directory) == 1
    assert build_index(docs(spark), key_bits=1, bucket_bytes=64).classes.agg({"chain": "max"}).first()[0] > 0


def test_kept_rows_have_the_columns(spark):
    kept = drop_exact_duplicates(docs(spark))
    assert kept.columns == ["doc_id", "text", "gid"]
    assert sorted(r.text for r in kept.collect()) == sorted({t or "" for _, t, _ in ROWS})


def test_no_rows(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
