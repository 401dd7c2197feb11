"""Agreement of labels, adjudication, adoption of labels, the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.spec import finite, require


def agreement(pairs: DataFrame, within: list[str], tiers: int = 1) -> DataFrame:
    """Weighted agreement of ``gold`` and ``prediction`` (1..6, no nulls) with
    positive ``weight``. With ``tiers`` levels to a class (2: three-tier) classes
    are merged first. Undefined values (no pairs, certain chance) are null."""
    k = 6 // tiers
    bad = ~(F.col("gold").between(1, 6) & F.col("prediction").between(1, 6) & (F.col("weight") > 0))
    cell = pairs.select(*within, F.when(bad, F.raise_error(F.lit("INVALID_PAIR")).cast("int")).otherwise(F.floor((F.col("gold") - 1) / tiers)).cast("int").alias("g"), F.floor((F.col("prediction") - 1) / tiers).cast("int").alias("p"), "weight")
    cell = cell.groupBy(*within, "g", "p").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    hits = lambda i, c: F.coalesce(F.sum(F.when(F.col(c) == i, F.col("w"))), F.lit(0.0))
    m = cell.groupBy(*within).agg(
        F.sum("n").alias("pairs"), F.sum("w").alias("total"), F.coalesce(F.sum(F.when(F.col("g") == F.col("p"), F.col("w"))), F.lit(0.0)).alias("diagonal"), F.sum(F.abs(F.col("g") - F.col("p")) / (k - 1) * F.col("w")).alias("distance"),
        F.array(*[hits(i, "g") for i in range(k)]).alias("row"), F.array(*[hits(i, "p") for i in range(k)]).alias("col"),
        F.array(*[F.coalesce(F.sum(F.when((F.col("g") == i) & (F.col("p") == i), F.col("w"))), F.lit(0.0)) for i in range(k)]).alias("both"),
    )
    at = lambda c, i: F.element_at(c, i + 1)
    plus = lambda cs: sum(cs[1:], cs[0])
    chance = plus([at("row", i) * at("col", i) for i in range(k)]) / F.col("total") ** 2
    expected = plus([F.lit(abs(i - j) / (k - 1)) * at("row", i) * at("col", j) for i in range(k) for j in range(k) if i != j]) / F.col("total") ** 2
    m = m.withColumns({"accuracy": F.col("diagonal") / F.col("total"), "chance": chance, "expected": expected})
    f1 = plus([F.coalesce(F.try_divide(2 * at("both", i), at("row", i) + at("col", i)), F.lit(0.0)) for i in range(k)]) / k
    return m.select(*within, "pairs", "accuracy", F.when(F.col("chance") < 1 - 1e-12, (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"), F.when(F.col("expected") > 1e-12, 1 - F.col("distance") / F.col("total") / F.col("expected")).alias("linear_kappa"), f1.alias("macro_f1"))


def missingness(reference: DataFrame, predictions: DataFrame, on: str, within: list[str]) -> DataFrame:
    """Pairs by what is missing: nothing, the reference, the prediction, both."""
    r, p = reference.select(*within, on, F.col("label").alias("r")), predictions.select(on, F.col("label").alias("p"), F.lit(True).alias("there"))
    both = r.join(p, on, "left")
    kind = F.when(F.col("there").isNull(), "unavailable").when(F.col("r").isNull() & F.col("p").isNull(), "both_missing").when(F.col("r").isNull(), "reference_missing").when(F.col("p").isNull(), "prediction_missing").otherwise("both_labelled")
    return both.groupBy(*within, kind.alias("kind")).agg(F.count("*").alias("n"))


def conflicts(a: DataFrame, b: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """Rows on which two reviews differ (nulls are values), or that one lacks."""
    left, right = a.select(on, *[F.col(c).alias(f"{c}_a") for c in cols], F.lit(1).alias("in_a")), b.select(on, *[F.col(c).alias(f"{c}_b") for c in cols], F.lit(1).alias("in_b"))
    differ = F.col("in_a").isNull() | F.col("in_b").isNull()
    for c in cols:
        differ = differ | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return left.join(right, on, "full_outer").where(differ).drop("in_a", "in_b")


def adjudicate(a: DataFrame, b: DataFrame, resolutions: DataFrame, on: str, col: str = "label") -> DataFrame:
    """Agreed labels and resolved conflicts; a resolution of no conflict or a
    conflict without one raises an error."""
    c = conflicts(a, b, on, [col]).select(on, F.lit(True).alias("conflict"))
    r = resolutions.select(on, F.col(col).alias("resolved"), F.lit(True).alias("given"))
    both = a.select(on, F.col(col).alias("agreed")).join(c, on, "left").join(r, on, "full_outer")
    bad = F.coalesce("conflict", F.lit(False)) != F.coalesce("given", F.lit(False))
    return both.select(on, F.when(bad, F.raise_error(F.lit("RESOLUTIONS_DO_NOT_COVER_CONFLICTS")).cast("int")).when(F.col("conflict"), F.col("resolved")).otherwise(F.col("agreed")).alias(col))


def adopt(turns: DataFrame, gold: DataFrame, predictions: DataFrame, on: str = "turn_id") -> DataFrame:
    """Adopted label of every turn: a human row wins, also when it says 'none'."""
    g, p = gold.select(on, F.col("label").alias("g"), F.lit(True).alias("has_gold")), predictions.select(on, F.col("label").alias("p"), F.lit(True).alias("has_prediction"))
    row = turns.join(g, on, "left").join(p, on, "left")
    origin = F.when(F.col("has_gold"), "human").when(F.col("has_prediction"), "model").otherwise("none")
    label = F.when(F.col("has_gold"), F.col("g")).otherwise(F.col("p"))
    reason = F.when(label.isNotNull(), None).when(F.col("has_gold"), "human_insufficient_evidence").when(F.col("has_prediction"), "model_insufficient_evidence").otherwise("not_labelled")
    return row.select(*turns.columns, label.alias("label"), origin.alias("origin"), reason.alias("missing_reason"))


def repeated(df: DataFrame, on: str) -> DataFrame:
    """Keys that occur more than once: overlapping gold sets, for instance."""
    return df.groupBy(on).agg(F.count("*").alias("n")).where("n > 1")


def quality_gate(pairs: int, prediction_missing: int, linear_kappa: float | None, weights_missing: bool, policy: dict) -> dict:
    """Reasons against using predictions; none means the gate is passed. A limit of
    None is unconfirmed."""
    limits = [policy.get(k) for k in ("min_n", "min_coverage", "min_linear_kappa")]
    for x in limits:
        require(x is None or finite(x, 0) is not None, "INVALID_POLICY")
    coverage = pairs / (pairs + prediction_missing) if pairs + prediction_missing else None
    found = {
        "quality_criteria_not_confirmed": None in limits, "not_attested_independent_audit": not (policy.get("audit_unseen") and policy.get("attested_by")),
        "insufficient_pairs": limits[0] is not None and pairs < limits[0], "insufficient_prediction_coverage": limits[1] is not None and (coverage is None or coverage < limits[1]),
        "missing_design_weights": weights_missing, "insufficient_linear_kappa": limits[2] is not None and (linear_kappa is None or linear_kappa < limits[2]),
    }
    return {"coverage": coverage, "reasons": [k for k, v in found.items() if v]}


def policy_checked(policy: dict) -> dict:
    """A policy of the quality gate; a limit of None is unconfirmed."""
    require(set(policy) == {"min_n", "min_coverage", "min_linear_kappa", "audit_unseen", "attested_by"}, "INVALID_QUALITY_POLICY")
    n = policy["min_n"]
    require(n is None or (isinstance(n, int) and not isinstance(n, bool) and n >= 2), "INVALID_MIN_N")
    for c, low in (("min_coverage", 0), ("min_linear_kappa", -1)):
        require(policy[c] is None or finite(policy[c], low, 1) is not None, "INVALID_POLICY")
    require(isinstance(policy["audit_unseen"], bool), "INVALID_AUDIT_ATTESTATION")
    require(isinstance(policy["attested_by"], str) and bool(policy["attested_by"].strip()), "ATTESTATION_REQUIRED")
    return policy


def quality_gates(rows: DataFrame, within: list[str], policy: dict, pool: str = "audit") -> DataFrame:
    """Whether the predictions of each group may be used. ``rows``: gold, prediction and
    weight, each null where there is none. within, pairs, gold_na, prediction_na, coverage,
    linear_kappa (of pairs with a weight), reasons (an array) and passed."""
    p = policy_checked(policy)
    both = F.col("gold").isNotNull() & F.col("prediction").isNotNull()
    n = rows.groupBy(*within).agg(F.count_if(both).alias("pairs"), F.count_if(F.col("gold").isNull()).alias("gold_na"), F.count_if(F.col("gold").isNotNull() & F.col("prediction").isNull()).alias("prediction_na"), F.count_if(both & F.col("weight").isNotNull()).alias("weighted"))
    kappa = agreement(rows.where(both & F.col("weight").isNotNull()), within).select(*within, "linear_kappa")
    m = n.join(kappa, within, "left").withColumn("coverage", F.coalesce(F.try_divide(F.col("pairs"), F.col("pairs") + F.col("prediction_na")), F.lit(0.0)))
    below = lambda c, key: F.lit(False) if p[key] is None else F.col(c) < p[key]
    rules = {
        "quality_criteria_not_confirmed": F.lit(None in (p["min_n"], p["min_coverage"], p["min_linear_kappa"])), "not_attested_independent_audit": F.lit(pool != "audit" or not p["audit_unseen"]), "insufficient_pairs": below("pairs", "min_n"),
        "insufficient_prediction_coverage": below("coverage", "min_coverage"), "missing_design_weights": F.col("weighted") != F.col("pairs"), "insufficient_linear_kappa": F.col("linear_kappa").isNull() | below("linear_kappa", "min_linear_kappa"),
    }
    reasons = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return m.withColumn("reasons", reasons).select(*within, "pairs", "gold_na", "prediction_na", "coverage", "linear_kappa", "reasons", (F.size("reasons") == 0).alias("passed"))


def label_contract(label: Column, insufficient: Column, evidence: Column, question: Column) -> Column:
    """First broken rule of a labelled row, or null."""
    return (
        F.when(label.isNotNull() & ~label.between(1, 6), "INVALID_LABEL")
        .when(label.isNull() != F.coalesce(insufficient, F.lit(False)), "LABEL_AND_INSUFFICIENT_DISAGREE")
        .when(label.isNotNull() & (F.coalesce(F.trim(evidence), F.lit("")) == ""), "EVIDENCE_MISSING")
        .when(label.isNotNull() & ~F.contains(question, evidence), "EVIDENCE_NOT_VERBATIM")
    )


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
