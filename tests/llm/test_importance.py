import math
import re

import numpy as np

from turnloom.llm import importance
from turnloom.llm.importance import Resampler, kth_largest, log_ratios, tokens

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")


def test_tokens_equal_a_plain_split():
    texts = [t.encode() for t in ("ab 12cd!! é-x", "", " \t", "a\x1cb", "x" * 999 + "1")]
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, at = tokens(data, np.cumsum([0, *map(len, texts)]))
    plain = [TOKEN.findall(t) for t in texts]
    assert np.diff(at).tolist() == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_ratio_of_the_models():
    got = log_ratios(np.array([10, 30, 0]), np.array([10, 10, 0]), 2.0) / importance.FIXED
    assert np.allclose(got, [math.log(12 / 7), math.log(12 / 17), 0], atol=1e-5)


def test_kth_largest(spark):
    values = [0.0, -0.5, 3.25, 3.25, -1e300, 7.0, 1e-310, -7.0]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k, want in enumerate(sorted(values, reverse=True), 1):
        assert kth_largest(df, "key", k) == want


def test_held_out_accuracy_and_share(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = Resampler(docs, labels.where("doc_id % 2 = 0"))
    got = r.draw().selectExpr("row.doc_id", "kept", "row.lang").join(labels.where("doc_id % 2 = 1"), "doc_id")
    good, bad = (got.where(f"quality = {q}").selectExpr("avg(int(kept))").first()[0] for q in (1, 0))
    assert good > 0.97 and bad < 0.2
    n = docs.count()
    kept = r.kept_rows()
    assert kept.columns == docs.columns and kept.count() == math.ceil(r.share * n)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 1), (1, "good text here", 1), (2, None, 2), (None, "bad !! bad", 3), (None, None, 3), (4, "", 4), (5, "w " * 50000, 5)], "doc_id long, text string, key int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, None, 0), (None, 1, 0), (9, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = Resampler(docs, labels, share=0.5).draw().collect()
    assert len(got) == 7 and len({(r.log_weight, r.key, r.kept) for r in got if r.row.doc_id == 1}) == 1
    assert all(r.log_weight == 0 for r in got if r.row.doc_id in (2, 4))
    assert Resampler(docs, labels.limit(0)).draw().where("kept").count() == 7
    assert Resampler(docs.limit(0), labels).draw().count() == 0 and Resampler(docs.limit(0), labels).kept_rows().count() == 0
    assert Resampler(docs, labels, share=0.0).draw().where("kept").count() == 0
