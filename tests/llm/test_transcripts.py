import random

import numpy as np

from turnloom.llm import transcripts
from turnloom.llm.transcripts import ROLES, STATES, Model, chain, fit, observe, opening, recover_turns


def test_markers():
    assert observe("### Human: hi?")[0] == 2 and observe("<|assistant|> x")[0] == 3 and observe("System：x")[0] == 1
    assert observe("the user: x")[0] == 0 and observe("")[:2] == (0, 0) and observe("Q: Why?")[1] == 4 + 2


def model(**k):
    return Model([[(1, "What is it?\nand so"), (2, "It is so.\nAnd more of it."), (1, "Why?"), (2, "Because.")]] * 5 + [[(0, "Be kind."), (1, "Hi?"), (2, "Hello.")]], **k)


def test_best_path_equals_enumeration():
    m, r = model(), random.Random(4)
    from itertools import product

    for _ in range(30):
        n = r.randint(1, 4)
        emit = m.emits([r.randrange(4) for _ in range(n)], [r.randrange(16) for _ in range(n)])

        def score(path, emit=emit):
            before, total = STATES, 0
            for s, e in zip(path, emit, strict=True):
                total += m.move[before, s] + e[s]
                before = s
            return total

        best = max(product(range(STATES), repeat=n), key=score)
        assert score(m.trace(emit)) == score(best)


def test_chained_stretches_equal_the_whole():
    m, r = model(), random.Random(9)
    for _ in range(30):
        n = r.randint(3, 40)
        emit = m.emits([r.randrange(4) for _ in range(n)], [r.randrange(16) for _ in range(n)])
        whole = m.trace(emit)
        cuts = sorted({0, n, *(r.randrange(n) for _ in range(3))})
        parts = [emit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        fixed = chain([m.product(p) for p in parts])
        pieces = np.concatenate([m.trace(p, before, end) for p, (before, end, _) in zip(parts, fixed, strict=True)])
        total = lambda path, emit=emit: sum(m.move[a, b] + e[b] for a, b, e in zip([STATES, *path[:-1]], path, emit, strict=True))
        assert total(list(pieces)) == total(list(whole)) and fixed[-1][2]
    assert opening()[STATES] == 0


def test_markers_left_out_are_recovered(spark):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    m = fit(turns.where("conv_id % 2 = 0"))
    held = turns.where("conv_id % 2 = 1 AND conv_id < 200").selectExpr("conv_id", "turn", "IF(turn % 4 = 3, NULL, role) AS role", "role AS truth", "text")
    got = recover_turns(held, m, partition_rows=100).collect()
    right = sum(r.roles[0] == r.row.truth for r in got)
    assert right / len(got) > 0.9 and len(got) == held.count()


def test_rendering_and_odd_rows(spark):
    rows = [(1, 0, "system", "Be kind.", "x"), (1, 1, "Human", "Hi?\nthere", "x"), (1, 2, None, "Assistant: Hello.\nUser: And?", "x"), (1, 3, "bot", None, "x"), (2, 0, "user", "a", "x"), (2, 0, "user", "a", "x"), (None, None, None, "", "x"), (3, 0, "user", "w " * 40000, "x")] + [(7, i, ["user", "assistant"][i % 2], f"line {i}", "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, roles string").repartition(4)
    whole = None
    for size in (10_000, 40, 7):
        got = recover_turns(docs, model(), partition_rows=size).collect()
        assert len(got) == len(rows)
        conv = {}
        for r in sorted(got, key=lambda r: (r.row.conv_id or -1, r.row.turn or -1)):
            conv[r.row.conv_id] = conv.get(r.row.conv_id, "") + r.rendered
        whole = whole or conv
        assert conv == whole
    assert whole[1] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user\nHi?\nthere<|im_end|>\n<|im_start|>assistant\nHello.<|im_end|>\n<|im_start|>user\nAnd?<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert whole[7].count("<|im_start|>") == 300 == whole[7].count("<|im_end|>") and all(r in ROLES for x in got for r in x.roles)
    assert recover_turns(docs.limit(0), model()).count() == 0


def test_dotted_column(spark):
    docs = spark.createDataFrame([(1, 0, "user", "Hi?", "v"), (1, 1, None, "Hello.", "v")], "conv_id long, turn long, role string, text string, `a.b` string")
    assert {r.row["a.b"] for r in recover_turns(docs, model()).collect()} == {"v"}


def test_fit_chars_bounds_labelled_texts(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "Model", lambda held, **_: held)
    turns = spark.createDataFrame([(1, 0, "user", "u" * 12_000)], "conv_id long, turn int, role string, text string")
    sizes = [len(transcripts.fit(turns, **o)[0][0][1]) for o in ({}, {"fit_chars": 5}, {"fit_chars": None})]
    assert sizes == [10_000, 5, 12_000]
