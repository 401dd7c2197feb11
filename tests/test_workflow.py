import pytest
from pyspark.sql import functions as F

from turnloom.functions.spec import ContractError
from turnloom.operators import workflow as W

FROZEN = {"term": "t", "time_zero": "2024-02-01T00:00:00Z", "window": ("2024-02-02T00:00:00Z", "2024-06-01T00:00:00Z"), "lower": 0, "upper": 200, "frozen_by": "x", "evidence": ("e",) * 5, "assumptions": (("assumed", "r"),) * 3, "independent": True, "comparable": True}


def test_simulation_finds_the_effect(spark):
    r = W.simulate(W.simulated_panels(spark, 20, 5.0), 5.0, 50).first()
    assert abs(r.mean_estimate - 5) < 0.5 and r.coverage >= 0.7 and r.rejection > 0.9 and r.simulations == 20
    bad = W.simulate(W.simulated_panels(spark, 20, 0.0, 4.0), 0.0, 50).first()
    assert bad.coverage < 0.2


TIMES = {"baseline_time": "2024-01-10T00:00:00Z", "covariates_time": "2024-01-10T00:00:00Z", "followup_time": "2024-03-01T00:00:00Z"}


def timed(panel, **times):
    for name, value in (TIMES | times).items():
        panel = panel.withColumn(name, F.lit(value))
    panel = panel.withColumn("term", F.lit("t")).withColumn("covariates", F.create_map(F.lit("stratum"), "stratum"))
    return panel.withColumn("treatment_time", F.when(F.col("treated") == 1, "2024-02-01T00:00:00+00:00"))


def test_study(spark):
    panel = timed(W.simulated_panels(spark, 1, 5.0).drop("simulation"))
    out = W.study(panel, W.Protocol(**FROZEN, biases=(0.0, 5.0), threshold=1.0), 100)
    assert out["status"] == "ready_under_assumptions" and abs(out["fit"]["estimate"] - 5) < 2 and out["bias_bounds"][5.0]["effect"][0] == pytest.approx(out["fit"]["estimate"] - 5)
    assert out["threshold_exceeded"] is True and len(out["subgroups"]) == 2 and out["bias_bounds"][5.0]["interval"][0] == pytest.approx(out["inference"]["ci_low"] - 5)
    assert W.study(panel, W.Protocol(**(FROZEN | {"frozen_by": ""})))["blockers"] == ["PROTOCOL_NOT_FROZEN"]
    with pytest.raises(ContractError):
        W.Protocol(**FROZEN, biases=())
    with pytest.raises(ContractError, match="INVALID_FOLLOWUP_WINDOW"):
        W.Protocol(**(FROZEN | {"window": FROZEN["window"][::-1]}))


def test_study_minds_the_times(spark):
    panel = W.simulated_panels(spark, 1, 5.0).drop("simulation")
    protocol = W.Protocol(**FROZEN)
    assert {"TIME_ZERO_UNVERIFIED", "TERM_MISMATCH", "COVARIATE_SCHEMA_MISMATCH"} <= set(W.study(panel, protocol)["blockers"])
    late = W.study(timed(panel, baseline_time="2024-02-01T01:00:00+01:00"), protocol)
    assert late["status"] == "blocked" and late["blockers"] == ["BASELINE_NOT_PRETREATMENT"]
    other = timed(panel).withColumn("term", F.lit("u")).withColumn("covariates", F.create_map(F.lit("age"), F.lit("x")))
    assert W.study(other, protocol)["blockers"] == ["COVARIATE_SCHEMA_MISMATCH", "TERM_MISMATCH"]


def test_admission(spark):
    records = spark.createDataFrame([("a", W.READY), ("b", W.READY), ("c", "needs_review")], "record_id string, status string")
    yes = spark.createDataFrame([("a", "accepted", "read it")], "record_id string, decision string, reason string")
    assert [r[0] for r in W.admit(records, yes).collect()] == ["a"]
    assert sorted(r[0] for r in W.admit(records, yes, yes.select("record_id")).collect()) == ["a", "b"]
    no = spark.createDataFrame([("a", "rejected", "no")], yes.schema)
    assert W.admit(records, no.withColumn("record_id", F.lit("c")), no.limit(0).select("record_id")).count() == 2
    odd = [(("a", "maybe", "x"), "INVALID_PARSE_DECISION"), (("a", None, "x"), "INVALID_PARSE_DECISION"), (("a", "accepted", " "), "PARSE_REASON_REQUIRED"), (("a", "accepted", None), "PARSE_REASON_REQUIRED"), (("c", "rejected", "x"), "NO_ADMITTED_RECORDS")]
    for row, code in odd:
        with pytest.raises(ContractError, match=code):
            W.admit(records, spark.createDataFrame([row], yes.schema))
    for decisions, sample, code in ((no, no.select("record_id"), "PARSE_SAMPLE_FAILURE"), (yes, records.select("record_id"), "PARSE_SAMPLE_INCOMPLETE"), (spark.createDataFrame([("c", "accepted", "x")], yes.schema), None, "REPARSE_REQUIRED"), (yes.union(yes), None, "INVALID_PARSE_REVIEW_IDS")):
        with pytest.raises(ContractError, match=code):
            W.admit(records, decisions, sample)


def test_probes(spark):
    rows = [("p", "base", 2), ("p", "attack", 4), ("q", "base", 3), ("q", "attack", 3), ("r", "base", None), ("r", "attack", 1)]
    got = {r.pair: (r.status, r.label_delta) for r in W.probe_pairs(spark.createDataFrame(rows, "pair string, variant string, label int")).collect()}
    assert got == {"p": ("FAIL", 2), "q": ("PASS", 0), "r": ("NA", None)}


def test_question_texts(spark):
    rows = spark.createDataFrame([("r1", "s", "Q: a\nA: b\nQ: c\nA: d"), ("r2", "s", "Q: x\nA: y"), ("r3", "z", "Q: x\nA: y"), ("r4", "s", "Q: only")], "record_id string, student_key string, raw string")
    got = W.question_texts(rows, spark.createDataFrame([("s",)], "student_key string"), ["r2"]).collect()
    assert [(r.record_id, r.questions) for r in got] == [("r2", "x"), ("r1", "a\nc")]
