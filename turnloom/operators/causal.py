"""Two-period panels: audit, overlap and balance, stratified difference in
differences, and its cluster bootstrap on sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.columns import uniform
from turnloom.functions.spec import require
from turnloom.operators.ordering import numbered
from turnloom.sources.tables import partitions


def treated() -> Column:
    return F.col("treated") == 1


def change() -> Column:
    return F.col("post_score") - F.col("pre_score")



def strata(panel: DataFrame) -> DataFrame:
    """Counts and sums of the change by stratum and arm."""
    return panel.groupBy("stratum").agg(F.count_if(treated()).alias("n1"), F.count_if(~treated()).alias("n0"), F.sum(F.when(treated(), change())).alias("d1"), F.sum(F.when(~treated(), change())).alias("d0"))


def covariate_strata(panel: DataFrame, names: list[str], covariates: str = "covariates") -> DataFrame:
    """``panel`` with stratum: ``stratum_1`` and so on, in the order of the values of
    ``names`` in the map ``covariates`` (a missing value comes first). The distinct tuples
    are numbered over range partitions; rows meet their number by a join on the tuple."""
    require(len(names) > 0 and len(set(names)) == len(names), "INVALID_COVARIATES")
    cells = [F.try_element_at(covariates, F.lit(c)) for c in names]
    keyed = panel.withColumn("_tuple", F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), {"ignoreNullFields": "false"}))
    tuples = keyed.select("_tuple", *[c.alias(f"_c{i}") for i, c in enumerate(cells)]).distinct()
    order = [F.col(f"_c{i}").asc_nulls_first() for i in range(len(names))]
    ids = numbered(tuples, [], order, "_no").select("_tuple", F.concat(F.lit("stratum_"), (F.col("_no") + 1).cast("string")).alias("stratum"))
    return keyed.drop("stratum").join(ids, "_tuple").drop("_tuple")


def audit(panel: DataFrame, low: float, high: float) -> DataFrame:
    """Blocking codes with the number of rows, clusters or strata behind each."""
    rows = panel.agg(
        F.count_if(F.col("pre_score").isNull() | F.col("post_score").isNull()).alias("MISSING_OUTCOME_NO_STRATEGY"),
        F.count_if(~F.col("pre_score").between(low, high) | ~F.col("post_score").between(low, high)).alias("OUTCOME_OUT_OF_RANGE"),
        F.when(F.count_if(~treated()) == 0, 1).otherwise(0).alias("NO_VALID_CONTROL"), F.when(F.count_if(treated()) == 0, 1).otherwise(0).alias("NO_TREATED_STUDENTS"),
    )
    mixed = panel.groupBy("cluster_id").agg(F.count_distinct("treated").alias("k")).agg(F.count_if(F.col("k") > 1).alias("MIXED_TREATMENT_CLUSTER"))
    support = strata(panel).agg(F.count_if((F.col("n1") == 0) | (F.col("n0") == 0)).alias("NO_COMMON_SUPPORT"))
    one = rows.crossJoin(mixed).crossJoin(support)  # three single rows
    codes = ["MISSING_OUTCOME_NO_STRATEGY", "OUTCOME_OUT_OF_RANGE", "NO_VALID_CONTROL", "NO_TREATED_STUDENTS", "MIXED_TREATMENT_CLUSTER", "NO_COMMON_SUPPORT"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("long").alias("n")) for c in codes])).alias("x")).select("x.*").where("n > 0")


def schema_blockers(panel: DataFrame, term: str, covariates: tuple[str, ...]) -> DataFrame:
    """Rows of another term, and rows whose covariates (a map) are not the protocol's."""
    names = F.array(*[F.lit(c) for c in sorted(covariates)]).cast("array<string>")
    held = F.array_sort(F.map_keys("covariates")) if "covariates" in panel.columns else F.array().cast("array<string>")
    rules = {"TERM_MISMATCH": ~F.col("term").eqNullSafe(F.lit(term)), "COVARIATE_SCHEMA_MISMATCH": ~held.eqNullSafe(names)}
    return _counted(panel, rules)


def _counted(panel: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """code, n for the rules that some row breaks, from one row of counts."""
    one = panel.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in rules])).alias("x")).select("x.*").where("n > 0")


def time_blockers(panel: DataFrame, time_zero: str, window: tuple[str, str]) -> DataFrame:
    """The codes that the four times of a full panel (ISO-8601 with offset) give."""
    zero, (a, b) = F.to_timestamp(F.lit(time_zero)), (F.to_timestamp(F.lit(w)) for w in window)
    time = lambda c: F.when(F.col(c).rlike(r"([+-]\d\d:?\d\d|Z)$"), F.to_timestamp(c)).otherwise(F.when(F.col(c).isNotNull(), F.raise_error(F.lit("TIME_WITHOUT_OFFSET")).cast("timestamp")))
    known = F.col("baseline_time").isNotNull() & F.col("followup_time").isNotNull() & F.col("covariates_time").isNotNull()
    rules = {
        "TIME_ZERO_UNVERIFIED": ~known, "BASELINE_NOT_PRETREATMENT": known & (time("baseline_time") >= zero), "POST_TREATMENT_COVARIATE": known & (time("covariates_time") >= zero),
        "FOLLOWUP_OUTSIDE_WINDOW": known & ~time("followup_time").between(a, b), "TREATMENT_START_MISMATCH": treated() & ~F.coalesce(time("treatment_time") == zero, F.lit(False)), "CONTROL_CONTAMINATION": ~treated() & F.col("treatment_time").isNotNull(),
    }
    return _counted(panel, rules)


def weighted(panel: DataFrame) -> DataFrame:
    """Controls get the odds of their stratum as weight; strata are few."""
    odds = strata(panel).select("stratum", F.try_divide(F.col("n1"), F.col("n0")).alias("odds"))
    return panel.join(odds, "stratum").withColumn("w", F.when(treated(), F.lit(1.0)).otherwise(F.col("odds")))


def overlap(panel: DataFrame) -> DataFrame:
    s = strata(panel).withColumn("e", F.col("n1") / (F.col("n1") + F.col("n0")))
    a = s.agg(F.count("*").alias("strata"), F.min("e").alias("propensity_min"), F.max("e").alias("propensity_max"), F.count_if((F.col("e") < 0.05) | (F.col("e") > 0.95)).alias("extreme_strata"), F.coalesce(F.sum(F.when((F.col("n1") == 0) | (F.col("n0") == 0), F.col("n1") + F.col("n0"))), F.lit(0)).alias("unsupported"))
    c = weighted(panel).groupBy("treated", "cluster_id").agg(F.sum("w").alias("w"), F.sum(F.col("w") ** 2).alias("w2"), F.max("w").alias("top"))
    arm = c.groupBy().agg(*[x for t, name in ((0, "control"), (1, "treated")) for own in [F.col("treated") == t] for x in (
        (F.sum(F.when(own, F.col("w"))) ** 2 / F.sum(F.when(own, F.col("w2")))).alias(f"{name}_ess"), (F.sum(F.when(own, F.col("w"))) ** 2 / F.sum(F.when(own, F.col("w") ** 2))).alias(f"{name}_cluster_ess"),
        (F.max(F.when(own, F.col("w"))) / F.sum(F.when(own, F.col("w")))).alias(f"max_{name}_cluster_share"), F.max(F.when(own, F.col("top"))).alias(f"max_{name}_weight"))])
    return a.crossJoin(arm).drop("treated_ess", "max_treated_weight")


def balance(panel: DataFrame) -> DataFrame:
    """Pre-score and each stratum's indicator: what is available, means, weighted
    control mean, and standardised differences on the scale before weighting.
    ``scale_status`` tells why a difference may be undefined; with a missing pre-score
    or fewer than two rows in an arm there is none. Without common support there is no
    weighted mean."""
    w = weighted(panel)
    names = strata(panel).select(F.col("stratum").alias("category"))
    arms = w.groupBy("stratum").agg(F.count_if(treated()).alias("n1"), F.count_if(~treated()).alias("n0"), F.sum(F.when(~treated(), F.col("w"))).alias("wc"))
    total = arms.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.sum("wc").alias("tw"), F.max(((F.col("n1") == 0) | (F.col("n0") == 0)).cast("int")).alias("apart"))
    cat = names.join(arms, names.category == arms.stratum).crossJoin(F.broadcast(total))  # one row
    cat = cat.select(F.lit("stratum").alias("feature"), "category", F.col("t1").alias("have1"), F.col("t0").alias("have0"), "t1", "t0", (F.col("n1") / F.col("t1")).alias("mt"), (F.col("n0") / F.col("t0")).alias("mc"), (F.col("wc") / F.col("tw")).alias("mw"), "apart")
    cat = cat.withColumn("var", (F.col("mt") * (1 - F.col("mt")) + F.col("mc") * (1 - F.col("mc"))) / 2)
    x = F.col("pre_score")
    own, other = F.when(treated(), x), F.when(~treated(), x)
    num = w.agg(F.count(own).alias("have1"), F.count(other).alias("have0"), F.count_if(treated()).alias("t1"), F.count_if(~treated()).alias("t0"), F.avg(own).alias("mt"), F.avg(other).alias("mc"), F.try_divide(F.sum(other * F.col("w")), F.sum(F.when(~treated(), F.col("w")))).alias("mw"), ((F.var_samp(own) + F.var_samp(other)) / 2).alias("var"))
    num = num.crossJoin(F.broadcast(total.select("apart")))  # single rows
    both = num.select(F.lit("pre_score").alias("feature"), F.lit(None).cast("string").alias("category"), "have1", "have0", "t1", "t0", "mt", "mc", "mw", "apart", "var").unionByName(cat)
    whole = (F.col("have1") == F.col("t1")) & (F.col("have0") == F.col("t0"))
    enough = whole & (F.col("t1") >= 2) & (F.col("t0") >= 2)
    scale, mw = F.sqrt("var"), F.when(whole & (F.col("apart") == 0), F.col("mw"))
    status = F.when(~enough, "insufficient_or_missing_baseline").when(F.col("var") > 0, "positive_variance").when(F.col("mt") == F.col("mc"), "constant_equal").otherwise("zero_variance_imbalance")
    smd = lambda c: F.when(enough, F.when(scale > 0, (F.col("mt") - c) / scale).when(F.col("mt") == c, 0.0))
    return both.select("feature", "category", F.col("have1").alias("treated_available"), F.col("have0").alias("control_available"), F.col("mt").alias("mean_treated"), F.col("mc").alias("mean_control"), mw.alias("weighted_control_mean"), status.alias("scale_status"), smd(F.col("mc")).alias("smd_before"), smd(mw).alias("smd_after"))


# When a reviewer should look again.
SMD_LIMIT, PROPENSITY_LIMITS, SHARE_LIMIT = 0.1, (0.05, 0.95), 0.2


def warnings(panel: DataFrame) -> DataFrame:
    """code, n of what in overlap, weights and balance calls for a review. They neither
    establish nor reject identification."""
    o = overlap(panel)
    low, high = PROPENSITY_LIMITS
    rules = {"NO_COMMON_SUPPORT": F.col("unsupported") > 0, "EXTREME_PROPENSITY": (F.col("propensity_min") < low) | (F.col("propensity_max") > high), "CONCENTRATED_CONTROL_CLUSTER": F.col("max_control_cluster_share") > SHARE_LIMIT}
    b = balance(panel)
    more = {"BASELINE_IMBALANCE": F.abs("smd_before") > SMD_LIMIT, "RESIDUAL_IMBALANCE": F.abs("smd_after") > SMD_LIMIT, "SMD_UNDEFINED": F.col("smd_before").isNull()}
    return _counted(o, rules).unionByName(_counted(b, more))


def estimate(sums: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Effect on the treated from (stratum, n1, n0, d1, d0), or null where a present
    stratum lacks an arm: sum of n1 * (mean change treated - control) / sum of n1."""
    within, n1 = within or [], F.col("n1")
    gap = n1 * (F.try_divide(F.col("d1"), n1) - F.try_divide(F.col("d0"), F.col("n0")))
    bad = F.max(((n1 > 0) != (F.col("n0") > 0)).cast("int"))
    out = sums.groupBy(*within).agg(F.sum(gap).alias("g"), F.sum("n1").alias("t"), F.sum("n0").alias("c"), bad.alias("bad"), F.sum("d1").alias("s1"), F.sum("d0").alias("s0"))
    return out.select(*within, F.when(F.col("bad") == 0, F.try_divide("g", "t")).alias("estimate"), (F.try_divide("s1", "t") - F.try_divide("s0", "c")).alias("unadjusted"))


def fit(panel: DataFrame) -> DataFrame:
    sd = panel.agg(F.coalesce(F.stddev_samp("pre_score"), F.lit(0.0)).alias("baseline_sd"), F.count("*").alias("students"))
    return estimate(strata(panel)).crossJoin(sd).withColumn("standardized", F.when(F.col("baseline_sd") > 0, F.col("estimate") / F.col("baseline_sd")))


def stretches(sizes: DataFrame, by: list[str], replicates: int, most: int) -> DataFrame:
    """``sizes`` (by, n_units, ...) with replicate, first and many: the draws of each group and
    replicate, in stretches of at most ``most``."""
    each = sizes.withColumn("replicate", F.explode(F.expr(f"sequence(0L, {replicates - 1}L)")))
    each = each.withColumn("first", F.explode(F.expr(f"sequence(0L, n_units - 1, {most}L)")))
    return each.withColumn("many", F.least(F.lit(most).cast("long"), F.col("n_units") - F.col("first")))


def counted(picks: DataFrame, units: DataFrame, by: list[str]) -> DataFrame:
    """by, replicate, times and the rest of ``units`` (by, slot, ...), from picks (by,
    replicate, slot, times). Picks are dealt by slot once. They are many rows that come from
    few: an estimate from before that would broadcast them, so the join is named."""
    times = picks.repartition(*by, "slot").groupBy(*by, "replicate", "slot").agg(F.sum("times").alias("times"))
    rest = [c for c in units.columns if c not in (*by, "slot")]
    return times.join(units.hint("shuffle_hash"), [*by, "slot"]).select(*by, "replicate", *rest, "times")


def draws(clusters: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """How often each cluster of each group ``by`` is drawn in each replicate: as many
    draws as clusters, each by a counter-based uniform number. Clusters are numbered
    in order; a draw is a number until it has been counted. ``clusters`` (by, unit) may have
    more columns, which stay."""
    units = numbered(clusters, by, [F.col("unit")], "slot")
    sizes = units.groupBy(*by).agg(F.count("*").alias("n_units"))
    slots = stretches(sizes, by, replicates, 1 << 14)
    slots = slots.repartition(partitions(slots.sparkSession), *by, "replicate", "first").select("*", F.explode(F.sequence("first", F.col("first") + F.col("many") - 1)).alias("slot"))
    pick = F.floor(uniform(F.lit(str(seed)), *[F.col(b) for b in by], F.col("replicate"), F.col("slot")) * F.col("n_units")).cast("long")
    return counted(slots.select(*by, "replicate", pick.alias("slot"), F.lit(1).cast("long").alias("times")), units, by)


def bootstrap(panel: DataFrame, replicates: int = 200, seed: int = 2045, draw=None) -> DataFrame:
    """Estimates of every replicate: whole clusters drawn within their arm. Sums by
    cluster and stratum are weighted by how often the cluster is drawn, so students
    are read once whatever the number of replicates. ``draw``: ``draws``, or another
    function of clusters, groups, replicates and seed."""
    sums = panel.groupBy("treated", F.col("cluster_id").alias("unit"), "stratum").agg(F.count("*").alias("n"), F.sum(change()).alias("d"))
    units = sums.select("treated", "unit").distinct()
    drawn = (draw or draws)(units, ["treated"], replicates, seed).join(sums, ["treated", "unit"])
    arm = lambda c, t: F.coalesce(F.sum(F.when(F.col("treated") == t, F.col(c) * F.col("times"))), F.lit(0))
    by = drawn.groupBy("replicate", "stratum").agg(arm("n", 1).alias("n1"), arm("n", 0).alias("n0"), arm("d", 1).alias("d1"), arm("d", 0).alias("d0"))
    return estimate(by, ["replicate"]).select("replicate", "estimate")


def subgroups(panel: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Each stratum fitted and resampled by itself, all in one job: exploratory, without
    adjustment for their number."""
    sums = panel.groupBy("stratum", "treated", F.col("cluster_id").alias("unit")).agg(F.count("*").alias("n"), F.sum(change()).alias("d"))
    arm = lambda c, t, times: F.coalesce(F.sum(F.when(F.col("treated") == t, F.col(c) * times)), F.lit(0))
    four = lambda w: [arm("n", 1, w).alias("n1"), arm("n", 0, w).alias("n0"), arm("d", 1, w).alias("d1"), arm("d", 0, w).alias("d0")]
    point = estimate(sums.groupBy("stratum").agg(*four(F.lit(1))), ["stratum"]).select("stratum", F.col("estimate").alias("point"))
    sizes = sums.groupBy("stratum").agg(F.sum("n").alias("students"), F.count_if(treated()).alias("k1"), F.count_if(~treated()).alias("k0"))
    drawn = draws(sums.select("stratum", "treated", "unit"), ["stratum", "treated"], replicates, seed).join(sums, ["stratum", "treated", "unit"])
    each = estimate(drawn.groupBy("stratum", "replicate").agg(*four(F.col("times"))), ["stratum", "replicate"])
    spread = each.groupBy("stratum").agg(F.count("estimate").alias("valid"), F.percentile("estimate", 0.025).alias("low"), F.percentile("estimate", 0.975).alias("high"), (F.max("estimate") - F.min("estimate")).alias("range"))
    both = point.join(sizes, "stratum").join(spread, "stratum", "left")
    fewest = F.least("k1", "k0")
    status = F.when(fewest < 10, "insufficient_clusters").when(F.coalesce("valid", F.lit(0)) < replicates, "bootstrap_support_failure").when(F.col("range") <= 1e-12, "degenerate_bootstrap").otherwise("approximate_cluster_bootstrap")
    fine = status == "approximate_cluster_bootstrap"
    return both.select("stratum", "students", F.col("point").alias("estimate"), F.when(fine, F.col("low")).alias("ci_low"), F.when(fine, F.col("high")).alias("ci_high"), status.alias("status"))


def inference(samples: DataFrame, point: DataFrame, replicates: int) -> DataFrame:
    """Interval and centred p-value; any draw without support voids both."""
    a = samples.crossJoin(point.select(F.col("estimate").alias("point"))).agg(F.count("estimate").alias("valid"), F.percentile("estimate", 0.025).alias("low"), F.percentile("estimate", 0.975).alias("high"), (F.max("estimate") - F.min("estimate")).alias("range"), ((1 + F.count_if(F.abs(F.col("estimate") - F.col("point")) >= F.abs("point"))) / (replicates + 1)).alias("p"), F.max("point").alias("estimate"))
    status = F.when(F.col("valid") < replicates, "bootstrap_support_failure").when(F.col("range") <= 1e-12, "degenerate_bootstrap").otherwise("approximate_cluster_bootstrap")
    fine = status == "approximate_cluster_bootstrap"
    return a.select("estimate", F.when(fine, F.col("low")).alias("ci_low"), F.when(fine, F.col("high")).alias("ci_high"), F.when(fine, F.col("p")).alias("p_value"), status.alias("status"), F.col("valid").alias("valid_replicates"))
