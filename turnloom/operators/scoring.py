"""Student indicators and the composite score.

Missing is never zero: shares are over labelled turns, a conversation counts
towards CTQ only by its original first and last turn, and without an indicator of
positive weight there are bounds instead of a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import columns as C
from turnloom.functions.spec import MetricSpec

KEYS = ["term", "student_key"]


def conversations(turns: DataFrame, utilities, legacy: bool = False) -> DataFrame:
    """One row for each conversation: counts by level, endpoints, agents, ctq."""
    unknown = F.col("agent_id").isNull() | (F.col("agent_id") == "")
    rec = turns.groupBy(*KEYS, "record_id").agg(
        F.count("*").alias("n"), F.max("turn_index").alias("last_index"), F.min("turn_index").alias("first_index"), F.count_distinct("turn_index").alias("indices"),
        F.max(F.when(F.col("turn_index") == 1, F.col("level"))).alias("first"), F.max_by("level", "turn_index").alias("last"),
        *[F.count_if(F.col("level") == k).alias(f"n{k}") for k in range(1, 7)],
        F.collect_set("agent_id").alias("agents"), F.max(unknown).alias("unknown_agent"),
    )
    whole = (F.col("first_index") == 1) & (F.col("last_index") == F.col("n")) & (F.col("indices") == F.col("n"))
    ends = whole & (F.col("n") >= 2) & F.col("first").isNotNull() & F.col("last").isNotNull()
    score = 0.5 + (F.col("last") - F.col("first")) / 10 if legacy else C.transition(F.col("first"), F.col("last"), utilities)
    change = (F.col("last") >= 4).cast("int") - (F.col("first") >= 4).cast("int")
    return rec.withColumn("ctq", F.when(ends, score)).withColumn("hot_change", F.when(ends, change))


def students(turns: DataFrame, spec: MetricSpec) -> DataFrame:
    """One row for each (term, student): all indicators of ``spec``'s version."""
    legacy = spec.version == "legacy-v1"
    n = [F.col(f"n{k}") for k in range(1, 7)]
    s = conversations(turns, spec.utilities, legacy).groupBy(*KEYS).agg(
        F.sum("n").alias("candidate_turns"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(1, 7)], F.avg("ctq").alias("ctq"), F.count("ctq").alias("valid_conversations"),
        F.avg("hot_change").alias("hot_change"), F.size(F.array_distinct(F.flatten(F.collect_list("agents")))).alias("agents"), F.max("unknown_agent").alias("unknown_agent"),
    )
    labelled = n[0] + n[1] + n[2] + n[3] + n[4] + n[5]
    some = F.col("labeled_turns") > 0
    s = s.withColumn("labeled_turns", labelled).withColumn("coverage", F.col("labeled_turns") / F.col("candidate_turns"))
    s = s.withColumns({p: F.when(some, c / F.col("labeled_turns")) for p, c in zip(C.P, n, strict=True)})
    s = s.withColumn("abl", F.when(some, sum((k * c for k, c in enumerate(n, 1)), F.lit(0)) / F.col("labeled_turns"))).withColumn("hot", F.col("p4") + F.col("p5") + F.col("p6"))
    if legacy:
        s = s.withColumn("dhi", F.when(some, C.dhi_legacy(spec.reference))).withColumn("mab", F.when(~F.col("unknown_agent"), F.least(F.col("agents"), F.lit(3)) / 3))
        w = spec.weights
        base = 100 * (w[0] * F.col("hot") + w[2] * F.col("dhi"))
        bare = F.col("ctq").isNull()
        return s.withColumn("aiv", F.when(~bare, base + 100 * w[1] * F.col("ctq"))).withColumn("aiv_lower", F.when(bare, base)).withColumn("aiv_upper", F.when(bare, base + 100 * w[1]))
    s = s.withColumn("dhi_symmetric", F.when(some, C.dhi_symmetric(spec))).withColumn("dhi_asymmetric", F.when(some, C.dhi_asymmetric(spec))).withColumn("dhi", F.col(f"dhi_{spec.dhi_mode}"))
    if spec.catalog is None:
        s = s.withColumn("mab", F.lit(None).cast("double"))
    else:
        # an agent outside the frozen catalogue makes the whole run fail
        alien = F.size(F.array_except("seen", F.array(*[F.lit(a) for a in spec.catalog])))
        seen = turns.where("agent_id <> ''").groupBy(*KEYS).agg(F.collect_set("agent_id").alias("seen"))
        s = s.join(seen, KEYS, "left").withColumn("mab", F.when(F.coalesce(alien, F.lit(0)) > 0, F.raise_error(F.lit("AGENT_OUTSIDE_FROZEN_CATALOG")).cast("double")).when(~F.col("unknown_agent"), C.breadth(F.col("agents"), len(spec.catalog)))).drop("seen")
    score, low, high = C.composite([F.col(i) for i in ("hot", "ctq", "dhi", "mab")], spec.weights, spec.aggregation)
    reasons = F.array_compact(F.array(F.when(~some, "no_valid_labels"), F.when(F.col("ctq").isNull(), "no_valid_endpoints"), F.lit("unknown_agent_catalog") if spec.catalog is None else F.when(F.col("unknown_agent"), "unknown_agent_identity")))
    return s.withColumns({"aiv": score, "aiv_lower": low, "aiv_upper": high, "missing_reasons": reasons})


def with_inventory(metrics: DataFrame, inventory: DataFrame) -> DataFrame:
    """Students of the inventory without a turn get an empty row."""
    empty = inventory.join(metrics, KEYS, "left_anti").select(*KEYS, F.lit(0).cast("long").alias("candidate_turns"), F.lit(0).cast("long").alias("labeled_turns"))
    return metrics.unionByName(empty, allowMissingColumns=True)
