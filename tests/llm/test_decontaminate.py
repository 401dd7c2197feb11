import random

from turnloom.llm.decontaminate import Myers, budget, drop_contaminated, find_contamination, normalise, pieces


def least(pattern, text):
    """Plain dynamic programme for the same distance."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(200):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 80)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        assert Myers(p).best(t)[0] == least(p, t)


def test_pieces_cover_the_item():
    for n in (1, 19, 20, 41, 200):
        item = "x" * n
        got = pieces(item, 0.05)
        assert len(got) == budget(n, 0.05) + 1 and "".join(p for _, p in got) == item


def test_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(6)] + [(6, None), (7, ""), (8, "short"), (9, None), (None, " ".join(["ab"] * 20))]
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(30))
        if i % 2:
            item = list(items[i % 6][1])
            for _ in range(r.randint(0, 7)):
                item[r.randrange(len(item))] = r.choice(["", "z", "zz"])
            text += "  \n" + "".join(item).upper() + " " + word()
        docs.append((i, text, "x"))
    docs += [(60, None, "x"), (61, "", "x"), (62, items[0][1], "x"), (62, items[0][1], "x"), (63, (items[1][1] + " ") * 400, "x"), (64, "AB " * 300, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, k string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t, _ in docs:
        for j, s in items:
            s, n = normalise(s), normalise(t)
            if s and n and (x := least(s, n[:4000])) <= budget(len(s), 0.05):
                want.append((i, j, x))
    got = [(x.row.doc_id, x.item_id, x.distance) for x in find_contamination(d, b).collect()]
    key = lambda x: (x[0], -1 if x[1] is None else x[1], x[2])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) >= 15
    small = [(x.row.doc_id, x.item_id, x.distance) for x in find_contamination(d, b, block_chars=150).collect()]
    assert sorted(small, key=key) == sorted(want, key=key)
    bad = {x[0] for x in want}
    assert sorted(x.doc_id for x in drop_contaminated(d, b).collect()) == sorted(i for i, _, _ in docs if i not in bad)


def test_each_call_has_its_own_items(spark):
    d = spark.createDataFrame([(i, f"some text about subject number{i} and more") for i in range(8)], "doc_id long, text string")
    for i in range(8):
        b = spark.createDataFrame([(i, f"about subject number{i} and")], "item_id long, text string")
        assert (i, i) in [(x.row.doc_id, x.item_id) for x in find_contamination(d, b, rate=0.0).collect()]
        assert drop_contaminated(d, b, rate=0.0).count() == 7


def test_no_rows(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(d, b).count() == 0 and drop_contaminated(d, b).count() == 0
