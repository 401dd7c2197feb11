"""Stability bounds at their edges, and panels without the columns of a protocol."""

import math

import pytest

from turnloom.functions.spec import Aggregation, ContractError, MetricSpec, feature_stability_bound, weight_stability_bound
from turnloom.operators import workflow

W = (0.5, 0.3, 0.15, 0.05)


def test_weights_of_other_sums_are_refused():
    assert weight_stability_bound(W, (0.3, 0.3, 0.3, 0.1)) == pytest.approx(20)
    with pytest.raises(ContractError, match="INVALID_SIMPLEX"):
        weight_stability_bound(W, (0.5, 0.3, 0.15, 0.5))


@pytest.mark.parametrize("rho", [1e-300, 1e-17, 1e-8, 1.0, 50.0])
def test_slope_of_small_and_large_rho(rho):
    got = feature_stability_bound((0.1, -0.1, 0.1, 0.1), W, Aggregation("concave", rho))
    assert got == pytest.approx(10 * max(1.0, rho / -math.expm1(-rho)))


def test_penalties_of_too_wide_a_range():
    with pytest.raises(ContractError, match="PENALTY_DYNAMIC_RANGE_TOO_LARGE"):
        MetricSpec(dhi_mode="asymmetric", shortage=(5e-324, 1, 1, 1, 1, 1), excess=(1e300,) * 6)


def test_missing_columns_block_a_panel(spark):
    rows = [(f"s{i}", f"c{i}", i % 2, "x", 1.0, 2.0) for i in range(4)]
    panel = spark.createDataFrame(rows, "student_key string, cluster_id string, treated int, stratum string, pre_score double, post_score double")
    plan = workflow.Protocol(term="T1", time_zero="2024-02-01T00:00:00Z", window=("2024-03-15T00:00:00Z", "2024-06-30T00:00:00Z"), lower=0.0, upper=9.0, covariates=("segment",), biases=(0.0,), threshold=1.0)
    assert {"TERM_MISMATCH", "COVARIATE_SCHEMA_MISMATCH", "TIME_ZERO_UNVERIFIED"} <= {r.code for r in workflow.blockers(panel, plan).collect()}
