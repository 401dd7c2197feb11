"""Label noise and component bootstrap of student metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import columns as C
from turnloom.functions.columns import uniform
from turnloom.functions.spec import MetricSpec, finite, require
from turnloom.operators.causal import draws
from turnloom.operators.ranks import order_statistic, top_set
from turnloom.sources.tables import cut, new_folder


def in_components(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` with root; a student without a component is an error."""
    both = rows.join(members.select("student_key", "root"), "student_key", "left")
    return both.withColumn("root", F.when(F.col("root").isNull(), F.raise_error(F.lit("STUDENT_WITHOUT_COMPONENT")).cast(both.schema["root"].dataType)).otherwise(F.col("root")))


def observed_bootstrap(metrics: DataFrame, members: DataFrame, value: str = "hot_change", replicates: int = 200, seed: int = 20260925, draw=draws) -> DataFrame:
    """Mean of each term, with the order-statistic interval over draws of whole
    components; below five components there is no interval. ``draw``: ``causal.draws``
    or ``streams.seeded_draws``."""
    rows = in_components(metrics.where(F.col(value).isNotNull()), members)
    sums = rows.groupBy("term", F.col("root").alias("unit")).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    point = sums.groupBy("term").agg(F.sum("n").alias("students"), F.count("*").alias("components"), (F.sum("s") / F.sum("n")).alias("mean_change"))
    means = draw(sums, ["term"], replicates, seed).groupBy("term", "replicate").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    ci = means.groupBy("term").agg(F.collect_list("m").alias("m")).select("term", order_statistic(F.col("m"), 0.025).alias("low"), order_statistic(F.col("m"), 0.975).alias("high"))
    enough = F.col("components") >= 5
    return point.join(ci, "term", "left").select("term", "students", "components", "mean_change", F.when(enough, F.col("low")).alias("ci_low"), F.when(enough, F.col("high")).alias("ci_high"), F.when(~enough, "fewer_than_five_components").alias("ci_missing_reason"))


def kernel(turns: DataFrame, masses: list[float]) -> DataFrame:
    """(term, mass, level, stay, lower, upper): probability of an assumed error to
    a neighbour, shared in proportion to its count + 0.5; edges send all to one."""
    n = turns.where("level IS NOT NULL").groupBy("term").agg(*[F.count_if(F.col("level") == k).alias(f"n{k}") for k in range(1, 7)])
    arr = F.array(*[F.col(f"n{k}") + 0.5 for k in range(1, 7)])
    k = n.select("term", arr.alias("n"), F.explode(F.array(*[F.lit(float(m)) for m in masses])).alias("mass")).select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("level"))
    below, above = F.try_element_at("n", F.col("level") - 1 + F.when(F.col("level") == 1, 6).otherwise(0)), F.try_element_at("n", F.col("level") + 1)
    below, above = F.when(F.col("level") > 1, below).otherwise(0.0), F.when(F.col("level") < 6, above).otherwise(0.0)
    return k.select("term", "mass", "level", (1 - F.col("mass")).alias("stay"), (F.col("mass") * below / (below + above)).alias("lower"), (F.col("mass") * above / (below + above)).alias("upper"))


def perturb(level: Column, u: Column, stay: Column, lower: Column) -> Column:
    """Inverse distribution function over (stay, lower, upper); the last possible
    value takes what rounding leaves."""
    return moved(level, u < stay, u < stay + lower)


def moved(level: Column, stays: Column, lowers: Column) -> Column:
    return F.when(stays, level).when((level > 1) & (lowers | (level == 6)), level - 1).otherwise(level + 1)


def endpoints(turns: DataFrame) -> DataFrame:
    """``turns`` with ``side``: -1 for the first and 1 for the last turn of a
    conversation that counts towards CTQ, else 0. Noise changes neither which turns
    have a label nor their order, so this holds for every replicate."""
    keys = ["term", "student_key", "record_id"]
    at_first = F.max(F.when(F.col("turn_index") == 1, F.col("level")))
    rec = turns.groupBy(*keys).agg(F.count("*").alias("n"), F.min("turn_index").alias("lo"), F.max("turn_index").alias("hi"), F.count_distinct("turn_index").alias("k"), at_first.alias("a"), F.max_by("level", "turn_index").alias("z"))
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("k") == F.col("n")) & (F.col("n") >= 2) & F.col("a").isNotNull() & F.col("z").isNotNull()
    ends = rec.where(whole).select(*keys, "hi")
    side = F.when(F.col("hi").isNull(), 0).when(F.col("turn_index") == 1, -1).when(F.col("turn_index") == F.col("hi"), 1).otherwise(0)
    return turns.join(ends, keys, "left").withColumn("side", side).drop("hi")


def histograms(rows: DataFrame, keys: list[str], spec: MetricSpec) -> DataFrame:
    """keys, n1..n6, and the sum of utilities at the ends of conversations with their
    number, from which every indicator of labels follows."""
    u = C.utility(F.col("level"), spec.utilities)
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("level") == k).alias(f"n{k}") for k in range(1, 7)], F.sum(F.col("side") * u).alias("ends"), F.count_if(F.col("side") == 1).alias("valid"))


def label_indicators(h: DataFrame, spec: MetricSpec) -> DataFrame:
    """``h`` (of ``histograms``) with abl, hot, ctq and dhi; rows without a label go."""
    n = [F.col(f"n{k}") for k in range(1, 7)]
    h = h.withColumn("labelled", n[0] + n[1] + n[2] + n[3] + n[4] + n[5]).where("labelled > 0")
    h = h.withColumns({p: c / F.col("labelled") for p, c in zip(C.P, n, strict=True)})
    abl = sum((k * c for k, c in enumerate(n[1:], 2)), n[0]) / F.col("labelled")
    dhi = C.dhi_symmetric(spec) if spec.dhi_mode == "symmetric" else C.dhi_asymmetric(spec)
    return h.withColumns({"abl": abl, "hot": F.col("p4") + F.col("p5") + F.col("p6"), "ctq": F.when(F.col("valid") > 0, 0.5 + 0.5 * F.col("ends") / F.col("valid")), "dhi": dhi})


def noise_sensitivity(turns: DataFrame, members: DataFrame, spec: MetricSpec, masses: list[float], replicates: int = 200, seed: int = 2045, metrics: tuple[str, ...] = ("abl", "hot", "ctq", "dhi")) -> DataFrame:
    """For each term, mass and metric: the observed mean over students with labels,
    its range over perturbed labels, and jointly over draws of components. Uniform
    numbers do not depend on the mass, nulls stay null, and the joint range needs
    five supporting components and every replicate.

    Turns are dealt by student once. Replicates are rows within a student's partition
    and leave it as sums of its component."""
    require(isinstance(seed, int) and not isinstance(seed, bool), "INVALID_SEED")
    require(isinstance(replicates, int) and replicates >= 100, "TOO_FEW_REPLICATES")
    require(len(masses) > 0 and len(set(masses)) == len(masses) and all(finite(m, 0, 1) is not None for m in masses), "INVALID_ERROR_MASS")
    require(set(metrics) <= {"abl", "hot", "ctq", "dhi"}, "UNKNOWN_METRIC")
    own = ["term", "student_key"]
    known = turns.where("level IS NOT NULL").select("term").distinct()
    placed = endpoints(turns.join(known, "term")).where("level IS NOT NULL")
    base = in_components(label_indicators(histograms(placed, own, spec), spec), members)
    units = base.select("term", F.col("root").alias("unit")).distinct()

    dealt = in_components(placed, members).repartition(*own)
    each = dealt.withColumn("replicate", F.explode(F.expr(f"sequence(0L, {replicates - 1}L)")))
    each = each.withColumn("u", uniform(F.lit(str(seed)), F.lit("noise"), F.col("replicate"), F.col("turn_id")))
    # masses are columns until a student's replicate has been counted: a turn is hashed once for all of them
    order = sorted(masses)
    k = kernel(turns, order).groupBy("term", "level").agg(F.sort_array(F.collect_list(F.struct("mass", "stay", "lower"))).alias("k"))
    at = [F.element_at("k", i + 1) for i in range(len(order))]
    noisy = each.join(F.broadcast(k), ["term", "level"])  # 6 rows for each term
    noisy = noisy.select(*own, "root", "replicate", "side", *[perturb(F.col("level"), F.col("u"), x["stay"], x["lower"]).alias(f"level{i}") for i, x in enumerate(at)])
    counts = [F.count_if(F.col(f"level{i}") == n).alias(f"n{n}_{i}") for i in range(len(order)) for n in range(1, 7)]
    ends = [F.sum(F.col("side") * C.utility(F.col(f"level{i}"), spec.utilities)).alias(f"ends_{i}") for i in range(len(order))]
    wide = noisy.groupBy(*own, "root", "replicate").agg(*counts, *ends, F.count_if(F.col("side") == 1).alias("valid"))
    cell = lambda i, m: F.struct(F.lit(float(m)).alias("mass"), *[F.col(f"n{n}_{i}").alias(f"n{n}") for n in range(1, 7)], F.col(f"ends_{i}").alias("ends"))
    long = wide.select(*own, "root", "replicate", "valid", F.explode(F.array(*[cell(i, m) for i, m in enumerate(order)])).alias("x"))
    keys = ["term", "mass", "replicate"]
    scored = label_indicators(long.select(*own, "root", "replicate", "valid", "x.*"), spec)
    sums = [x for m in metrics for x in (F.sum(m).alias(f"{m}_s"), F.count(m).alias(f"{m}_n"))]
    cells = scored.groupBy(*keys, F.col("root").alias("unit")).agg(*sums)

    def ranges(df: DataFrame, times: Column, names: tuple[str, ...]) -> DataFrame:
        """Percentiles over replicates of each metric's mean."""
        means = df.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(f"{m}_s") * times), F.sum(F.col(f"{m}_n") * times)).alias(m) for m in metrics])
        long = means.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select(*keys, "x.*")
        return long.groupBy("term", "mass", "metric").agg(F.percentile("v", 0.025).alias(names[0]), F.percentile("v", 0.975).alias(names[1]), F.count("v").alias(names[2]))

    cells = cut(cells, new_folder(turns.sparkSession, "noise"))
    label = ranges(cells, F.lit(1), ("low", "high", "replicates")).drop("replicates")
    drawn = cells.join(draws(units, ["term"], replicates, seed + 1), ["term", "replicate", "unit"])
    joint = ranges(drawn, F.col("times"), ("j_low", "j_high", "valid"))
    cell = lambda m: F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"))
    long = base.select("term", "root", F.explode(F.array(*[cell(m) for m in metrics])).alias("x")).select("term", "root", "x.*")
    point = long.groupBy("term", "metric").agg(F.avg("v").alias("observed"), F.count("v").alias("students"), F.count_distinct(F.when(F.col("v").isNotNull(), F.col("root"))).alias("support"))
    enough = (F.col("support") >= 5) & (F.col("valid") == replicates)
    both = label.join(joint, ["term", "mass", "metric"]).join(point, ["term", "metric"])
    return both.select("term", "mass", "metric", "observed", "students", "support", "low", "high", F.when(enough, F.col("j_low")).alias("joint_low"), F.when(enough, F.col("j_high")).alias("joint_high"), F.col("valid").alias("joint_valid"))


def ranking_stability(metrics: DataFrame, noisy: DataFrame, by: list[str], share: float = 0.25) -> DataFrame:
    """Mean overlap of the fixed-size top sets of replicates with the observed one, and
    the mean flip rate: of the students in either set, those in one only."""
    folder = new_folder(metrics.sparkSession, "stability")
    held = lambda df, keys, name: cut(df.select(*keys, "student_key", "abl"), f"{folder}/{name}")
    top = lambda df, keys, name: top_set(held(df, keys, name), keys, "abl", share)
    a = top(metrics, ["term"], "metrics").select("term", "student_key", F.lit(1).alias("was"))
    b = top(noisy, ["term", *by], "noisy").select("term", *by, "student_key", "size")
    each = b.join(a, ["term", "student_key"], "left").groupBy("term", *by).agg(F.count("was").alias("same"), F.max("size").alias("k"))
    sizes = a.groupBy("term").agg(F.count("*").alias("observed"))
    union = F.col("k") + F.col("observed") - F.col("same")
    return each.join(sizes, "term").groupBy("term").agg(F.avg(F.col("same") / F.col("k")).alias("overlap"), F.avg((union - F.col("same")) / union).alias("flip_rate"))
