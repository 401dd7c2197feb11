"""Ranks, rank correlation, schemes side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import columns as C
from turnloom.functions.spec import INDICATORS, MetricSpec, schemes, weight_stability_bound
from turnloom.operators.ordering import numbered, places, running
from turnloom.sources.tables import cut, new_folder


def with_places(df: DataFrame, cols: list[str], within: list[str]) -> DataFrame:
    """``df`` with, for each of ``cols``, ``{col}_below``, ``{col}_ties`` and
    ``{col}_total``: rows of the group with a smaller value, with the same one (itself
    included), and with any."""
    found = places(df, cols, within)
    for c in cols:
        own = found.where(F.col("which") == c).select(*within, F.col("value").alias(f"_{c}"), F.col("below").alias(f"{c}_below"), F.col("n").alias(f"{c}_ties"), F.col("total").alias(f"{c}_total"))
        df = df.withColumn(f"_{c}", F.col(c).cast("double")).join(own, [*within, f"_{c}"], "left").drop(f"_{c}")
    return df


def average_rank(col: str, descending: bool = False) -> Column:
    """Mean place of the tie block, from 0 (ascending) or from 1 (descending), of a
    column that ``with_places`` has seen."""
    below, ties, total = (F.col(f"{col}_{x}") for x in ("below", "ties", "total"))
    return total - below - (ties - 1) / 2 if descending else below + (ties - 1) / 2


def correlations(df: DataFrame, pairs: list[tuple[str, str]], within: list[str]) -> DataFrame:
    """within, n and, for each pair of columns without nulls, Spearman's coefficient
    ``{left}_{right}``: null below two rows or for a constant side."""
    r = with_places(df, sorted({c for p in pairs for c in p}), within)
    mean = (F.col(f"{pairs[0][0]}_total") - 1) / 2  # of the ranks 0 .. n - 1, ties or not
    centred = {c: average_rank(c) - mean for p in pairs for c in p}
    out = []
    for a, b in pairs:
        rho = F.try_divide(F.sum(centred[a] * centred[b]), F.sqrt(F.sum(centred[a] ** 2) * F.sum(centred[b] ** 2)))
        out.append(F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias(f"{a}_{b}"))
    return r.groupBy(*within).agg(F.count("*").alias("n"), *out)


def spearman(df: DataFrame, left: str, right: str, within: list[str]) -> DataFrame:
    """within, n, spearman."""
    return correlations(df, [(left, right)], within).withColumnRenamed(f"{left}_{right}", "spearman")


def complete(metrics: DataFrame) -> DataFrame:
    for i in INDICATORS:
        metrics = metrics.where(F.col(i).isNotNull())
    return metrics


def scheme_scores(metrics: DataFrame, spec: MetricSpec, sensitivity: bool = True) -> DataFrame:
    """Every student of the complete cohort under every scheme (at most 12): the
    scores are expressions, so the fan-out needs no join."""
    values = [F.col(i) for i in INDICATORS]
    rows = [F.struct(F.lit(name).alias("scenario"), C.composite(values, w, a)[0].alias("score"), F.lit(weight_stability_bound(spec.weights, w) if a == spec.aggregation else None).cast("double").alias("bound")) for name, w, a in schemes(spec, sensitivity)]
    out = complete(metrics).withColumn("primary", C.composite(values, spec.weights, spec.aggregation)[0])
    return out.select("term", "student_key", "primary", F.explode(F.array(*rows)).alias("s")).select("term", "student_key", "primary", "s.*")


def compare_schemes(metrics: DataFrame, spec: MetricSpec) -> DataFrame:
    """Twelve rows for each term, also for a term without a complete student."""
    spark = metrics.sparkSession
    scores = scheme_scores(metrics, spec)
    keys = ["term", "scenario"]
    means = scores.groupBy(*keys).agg(F.count("*").alias("students"), F.avg("score").alias("mean_aiv"), F.max(F.abs(F.col("score") - F.col("primary"))).alias("max_change"))
    rho = spearman(scores, "primary", "score", keys).select(*keys, "spearman")
    names = spark.createDataFrame([(n, weight_stability_bound(spec.weights, w) if a == spec.aggregation else None) for n, w, a in schemes(spec)], "scenario string, weight_change_bound double")
    terms = metrics.groupBy("term").agg(F.count("*").alias("candidates")).crossJoin(F.broadcast(names))  # 12 rows
    return terms.join(means, keys, "left").join(rho, keys, "left").select(*keys, F.coalesce("students", F.lit(0)).alias("students"), (F.col("candidates") - F.coalesce("students", F.lit(0))).alias("excluded_students"), "mean_aiv", "spearman", "max_change", "weight_change_bound")


def indicator_spearman(metrics: DataFrame) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(INDICATORS) for b in INDICATORS[i + 1 :]]
    wide = correlations(complete(metrics), pairs, ["term"])
    cells = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}_{b}").alias("spearman")) for a, b in pairs])
    return wide.select("term", F.col("n").alias("students"), F.explode(cells).alias("x")).select("term", "x.left", "x.right", "students", "x.spearman")


def student_ranks(metrics: DataFrame, spec: MetricSpec) -> DataFrame:
    """Descending average rank and top quartile, boundary ties included."""
    s = with_places(scheme_scores(metrics, spec, sensitivity=False), ["score"], ["term", "scenario"])
    above = F.col("score_total") - F.col("score_below") - F.col("score_ties")
    return s.select("term", "scenario", "student_key", "score", average_rank("score", True).alias("rank"), (above + 1 <= F.ceil(F.col("score_total") / 4)).alias("top_quartile"), F.col("score_total").alias("population"))


def top_share(df: DataFrame, by: list[str], score: str, share: float) -> DataFrame:
    """``df`` (rows with a score) with place, from 1 by falling score and, for equal
    ones, by a hash of the student, and ``size``: ceil(share * n) of the group."""
    rows = df.where(F.col(score).isNotNull()).withColumn("_tie", F.sha2(F.col("student_key").cast("string"), 256))
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") * share).alias("size"))
    return numbered(rows, by, [F.col(score).desc(), F.col("_tie")], "_n").join(sizes, by).withColumn("place", F.col("_n") + 1).drop("_n", "_tie")


def top_set(df: DataFrame, by: list[str], score: str, share: float) -> DataFrame:
    """The rows that ``top_share`` gives a place up to ``size``, with ``size``. The last score
    comes from a histogram; only rows that have it are ordered. Reads ``df`` three times."""
    rows = df.where(F.col(score).isNotNull())
    seen = rows.groupBy(*by, score).agg(F.count("*").alias("_n"))
    sizes = seen.groupBy(*by).agg(F.ceil(F.sum("_n") * share).alias("size"))
    last = running(seen, by, [F.col(score).desc()], "_n", "_before").join(sizes, by).where("_before < size AND _before + _n >= size")
    last = cut(last.select(*by, F.col(score).alias("_last"), (F.col("size") - F.col("_before")).alias("_room"), "size"), new_folder(df.sparkSession, "last"))
    near = rows.join(F.broadcast(last), by)  # a row for each group
    ties = near.where(F.col(score) == F.col("_last")).withColumn("_tie", F.sha2(F.col("student_key").cast("string"), 256))
    ties = numbered(ties, by, [F.col("_tie")], "_at").where("_at < _room")
    return near.where(F.col(score) > F.col("_last")).select(*df.columns, "size").unionByName(ties.select(*df.columns, "size"))


def fixed_top_quartile(metrics: DataFrame) -> DataFrame:
    """Exactly ceil(n / 4) students of each term by ABL, ties by a hash of the key."""
    rows = top_share(metrics.select("term", "student_key", "abl"), ["term"], "abl", 0.25)
    return rows.select("term", "student_key", "abl", (F.col("place") <= F.col("size")).alias("top"))


def order_statistic(values: Column, q: float) -> Column:
    """The truncating-index percentile: sorted[int(q * (n - 1))]."""
    s = F.array_sort(values)
    return F.element_at(s, F.floor(q * (F.size(s) - 1)).cast("int") + 1)
