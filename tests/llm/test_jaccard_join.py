import random
import re

import pytest

from turnloom.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted(((-1 if rows[i][0] is None else rows[i][0]), len(sets[i]), min((x for x in groups[root(i)] if x is not None), default=None)) for i in range(len(rows)))


def make(seed, n, vocabulary, hot):
    r = random.Random(seed)
    word = lambda: r.choice(vocabulary)
    base = [[word() for _ in range(r.randint(1, 120))] for _ in range(n // 4)]
    passage, rows = [word() for _ in range(60)], []
    for i in range(n):
        w = list(r.choice(base) if not hot or r.random() < 0.5 else base[0])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w += passage
        rows.append((i, r.choice([" ", "  ", "\n", " \t"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "A b"), (n + 4, "a B"), (n + 5, "a b c d"), (5, "repeated id one two three"), (n + 6, "É é X"), (n + 7, "é é x"), (n + 8, "long " * 5000)]
    return rows


@pytest.mark.parametrize("seed,n,size,hot,small", [(1, 160, 40, False, 24), (2, 160, 4000, True, 24), (3, 200, 12, True, 24), (4, 200, 60, True, 2), (5, 200, 60, True, 500)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, size, hot, small):
    monkeypatch.setattr(jj, "SMALL", small)
    monkeypatch.setattr(jj, "BLOCK", 5 if small == 2 else 1500)
    rows = make(seed, n, [f"w{i}" for i in range(size)], hot)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, c string, n int").repartition(5)
    got = jj.near_duplicates(docs, part_postings=300, unit_bytes=20_000).select("row.doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    if seed > 1:
        return
    kept = {r.doc_id for r in jj.one_of_each_group(docs).collect()}
    assert kept == {c for _, _, c in brute(rows)}


def test_null_id_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "z"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(docs).select("row.doc_id", "n_shingles", "component_id").collect()}
    assert got == {(None, 2, 3), (3, 2, 3), (None, 1, None), (4, 0, 4)}
    assert jj.near_duplicates(docs.limit(0)).count() == 0


def test_match_grows_with_cost():
    import numpy as np

    assert jj.choose_match(np.ones(100), jj.Rule()) == 1
    assert jj.choose_match(np.full(100, 50.0), jj.Rule()) > 1


def split_matches():
    """Documents 0 and 1 share two prefix shingles when two matches are demanded: one
    in a bucket of their own, one in a bucket whose central member is document 2."""
    own = lambda name, n: [f"{name}-{i}" for i in range(n)]
    w, passage = own("w", 34), own("p", 60)
    docs = [w, w + own("y", 10), w[1:6] + passage]
    docs += [w[2:] + own(f"f{i}", 60) for i in range(5)] + [passage + own(f"g{i}", 60) for i in range(30)]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_matches_in_buckets_of_two_and_of_more_add_up(spark):
    rows = split_matches()
    assert [c for _, _, c in brute(rows)][:3] == [0, 0, 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 2, 4):
        got = jj.near_duplicates(docs, rule=jj.Rule(min_match=least)).select("row.doc_id", "n_shingles", "component_id").collect()
        assert sorted(tuple(r) for r in got) == brute(rows)


def test_clashing_class_numbers(spark):
    rows = make(7, 120, [f"w{i}" for i in range(60)], True)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.near_duplicates(docs, rule=jj.Rule(class_bits=3)).select("row.doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_long_words_that_clash_modulo_powers_of_two(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, " ".join([a] * 5)), (2, " ".join([b] * 5)), (3, a), (4, b)]
    got = jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)]


def test_one_of_each_group_decides_by_row(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (5, text), (5, "something else that is unique to this row"), (1, text), (None, text), (None, None), (7, ""), (None, "alone by itself and without an id")]
    kept = jj.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame([(1, text), rows[2], (None, ""), (7, ""), rows[7]], "doc_id long, text string").collect()))
