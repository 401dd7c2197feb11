"""Exact order statistics and strata against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions.spec import ContractError
from turnloom.operators import causal, selection


def groups():
    rnd = random.Random(2)
    yield "many", [rnd.gauss(0, 1) for _ in range(3000)]
    yield "equal", [7.5] * 500
    yield "wide", [s * 2.0**e for e in range(-1000, 1000, 7) for s in (-1, 1)] + [0.0, -0.0, 1.7e308, -1.7e308, 5e-324]
    yield "ties", [float(rnd.randint(1, 6)) for _ in range(900)]
    yield "one", [3.0]
    yield "near", [1.0 + i * 2.0**-52 for i in range(300)]


@pytest.mark.parametrize("few", [4096, 5])
def test_ranks_of_all_groups(spark, few):
    held = dict(groups())
    rows = spark.createDataFrame([(g, v) for g, x in held.items() for v in x] + [("many", None), ("none", None)], "g string, v double").repartition(6)
    ranks = {g: sorted({0, len(x) // 3, len(x) // 2, len(x) - 1}) for g, x in held.items()}
    wanted = spark.createDataFrame([(g, r) for g, x in ranks.items() for r in x] + [("one", 1), ("one", -1), ("none", 0)], "g string, rank long")
    got = {(r.g, r.rank): r.value for r in selection.select_ranks(rows, ["g"], "v", wanted, parts=16, few=few).collect()}
    assert got == {(g, r): sorted(held[g])[r] for g, x in ranks.items() for r in x}


def test_percentiles_of_both_kinds(spark):
    held = {g: x for g, x in groups() if g != "wide"}
    rows = spark.createDataFrame([(g, v) for g, x in held.items() for v in x], "g string, v double")
    shares = [0.0, 0.025, 0.5, 0.975, 1.0]
    for kind in ("interpolated", "order"):
        got = {(r.g, r.share): r.value for r in selection.percentiles(rows, ["g"], "v", shares, kind).collect()}
        for g, x in held.items():
            x = sorted(x)
            for p in shares:
                at = (len(x) - 1) * p
                lo, hi = math.floor(at), math.ceil(at)
                want = x[lo] + (at - lo) * (x[hi] - x[lo]) if kind == "interpolated" else x[int(p * (len(x) - 1))]
                assert got[g, p] == pytest.approx(want, abs=1e-12)
    with pytest.raises(ContractError, match="INVALID_PROBABILITY"):
        selection.percentiles(rows, ["g"], "v", [1.5])
    with pytest.raises(Exception, match="PERCENTILE_OF_INFINITE_VALUES"):
        selection.percentiles(spark.createDataFrame([("a", float("nan"))], "g string, v double"), ["g"], "v", [0.5]).collect()


def test_strata_in_the_order_of_their_tuples(spark):
    rnd = random.Random(5)
    rows = [(i, {"b": rnd.choice("xyz"), "a": rnd.choice("pq")} | ({"c": rnd.choice("01")} if i % 4 else {})) for i in range(200)]
    df = spark.createDataFrame(rows, "student_key int, covariates map<string,string>").repartition(5)
    got = {r.student_key: r.stratum for r in causal.covariate_strata(df, ["a", "b", "c"]).collect()}
    key = lambda m: (m["a"], m["b"], m.get("c", ""))
    places = {k: i for i, k in enumerate(sorted({key(m) for _, m in rows}), 1)}
    assert got == {i: f"stratum_{places[key(m)]}" for i, m in rows}
    assert causal.covariate_strata(df.withColumn("stratum", F.lit("old")), ["a"]).select("stratum").distinct().count() == 2
