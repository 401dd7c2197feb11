import hashlib
import random
from collections import Counter

import pytest

from turnloom.llm.difference_cover import cover, remove_repeated_bytes


@pytest.mark.parametrize("v", [1, 2, 7, 10, 31, 91, 133])
def test_every_difference_is_covered(v):
    d = cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,v,seed", [(400, 91, 1), (40, 10, 2), (30, 7, 3), (12, 3, 4), (8, 1, 5)])
def test_equals_brute_force(spark, tmp_path, length, v, seed):
    r = random.Random(seed)
    letters = "abcdefghé" if length > 12 else "ab"
    some = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [some(r.randint(length // 2, 3 * length)) for _ in range(8)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            t += p[a : a + r.randint(1, 2 * length)] if r.random() < 0.6 else some(r.randint(1, 2 * length))
            if t and r.random() < 0.5:
                j = r.randrange(len(t))
                t = t[:j] + "X" + t[j + 1 :]
        rows.append((i, t))
    rows += [(90, None), (91, ""), (92, "z" * (3 * length)), (93, "y" * length), (94, "xy" * length), (95, passages[0] * 9), (5, rows[7][1]), (None, rows[8][1])]
    spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int").repartition(3).write.parquet(f"{tmp_path}/d")
    got = remove_repeated_bytes(spark.read.parquet(f"{tmp_path}/d"), length=length, v=v, unit_bytes=6 * length, part_names=300)
    got = got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted([tuple(x) for x in got], key=key) == sorted(brute(rows, length), key=key)


def test_no_rows(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
