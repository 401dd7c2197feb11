"""Exact order statistics of groups of any size, without sorting or listing a group.

The rows with several ranks of all groups are looked for at once. A round counts, for each
group and wanted rank, the rows of equal parts of the interval that still holds it (a
histogram, so partial sums leave a task, not rows), picks the part with the rank, and goes
on with the least and the greatest value in it. An interval of one value is found; one of
few rows is sorted. Parts are of equal width and, every other round, of equal width on a
logarithmic scale, so neither close values nor magnitudes far apart take many rounds; each
round separates the ends of its interval, so it ends for any values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.spec import require
from turnloom.sources.tables import cut, new_folder

#: Parts of an interval; rows of one that are sorted, in one window.
PARTS, FEW = 4096, 4096


def _finite(value: Column) -> Column:
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, F.raise_error(F.lit("PERCENTILE_OF_INFINITE_VALUES")).cast("double")).otherwise(value)


def _scale(x: Column) -> Column:
    """Never falling over all numbers, and even over their magnitudes."""
    # -745 is below the logarithm of the smallest double
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 746))


def _share(n: int) -> Column:
    """Where between lo and hi x lies, 0 to 1, never falling in x."""
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    # halves, so that the width of no interval is infinite
    even = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    return even if n % 2 == 0 else F.when(_scale(hi) > _scale(lo), (_scale(x) - _scale(lo)) / F.nullif(_scale(hi) - _scale(lo), F.lit(0.0))).otherwise(even)


def select_ranks(rows: DataFrame, by: list[str], value: str, wanted: DataFrame, *, parts: int = PARTS, few: int = FEW) -> DataFrame:
    """by, rank, value: the values with the ranks of ``wanted`` (by, rank; from 0, in
    ascending order) among the rows of their group. Nulls have no rank; ranks beyond a
    group's rows are left out; a value that is not finite is an error."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "selection")
    x = rows.select(*by, _finite(F.col(value).cast("double")).alias("x")).where("x IS NOT NULL")
    sizes = x.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    todo = wanted.select(*by, F.col("rank").cast("long").alias("rank")).distinct().join(sizes, by).where("rank BETWEEN 0 AND n - 1")
    todo, found, n = cut(todo.withColumn("below", F.lit(0).cast("long")), f"{folder}/round-0"), None, 0
    own = [*by, "rank"]
    while True:
        done = todo.where("lo = hi").select(*own, F.col("lo").alias("value"))
        small = x.join(todo.where(f"lo < hi AND n <= {few}"), by).where("x BETWEEN lo AND hi")
        sorted_ = small.withColumn("at", F.row_number().over(Window.partitionBy(*own).orderBy("x")) - 1)  # few rows each
        done = done.unionByName(sorted_.where("at = rank - below").select(*own, F.col("x").alias("value")))
        found = done if found is None else found.unionByName(done)
        large = todo.where(f"lo < hi AND n > {few}").drop("n")
        if large.isEmpty():
            return found
        part = F.least(F.lit(parts - 1), F.floor(_share(n) * parts)).cast("int").alias("part")
        counts = x.join(large, by).where("x BETWEEN lo AND hi").groupBy(*own, "below", part).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        # as many rows as parts, at most, for each rank
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        n += 1
        next_ = counts.withColumn("below", F.col("below") + before).where("rank >= below AND rank < below + n").select(*own, "n", "lo", "hi", "below")
        todo = cut(next_, f"{folder}/round-{n}")


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], kind: str = "interpolated") -> DataFrame:
    """by, share, value, n: percentiles of each group. ``interpolated``: between the two
    values around place share * (n - 1); ``order``: the value at that place, cut to a whole
    number. Groups without a value have no row."""
    require(kind in ("interpolated", "order"), "UNKNOWN_PERCENTILE")
    require(len(shares) > 0 and len(set(shares)) == len(shares) and all(0 <= s <= 1 for s in shares), "INVALID_PROBABILITY")
    n = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    asked = n.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("at", F.col("share") * (F.col("n") - 1))
    asked = cut(asked.withColumns({"low": F.floor("at"), "high": F.ceil("at") if kind == "interpolated" else F.floor("at")}), new_folder(rows.sparkSession, "asked"))
    ranks = asked.select(*by, F.explode(F.array("low", "high")).alias("rank"))
    told = cut(select_ranks(rows, by, value, ranks), new_folder(rows.sparkSession, "told"))
    low, high = (told.select(*by, F.col("rank").alias(c), F.col("value").alias(f"v_{c}")) for c in ("low", "high"))
    both = asked.join(low, [*by, "low"]).join(high, [*by, "high"])
    return both.select(*by, "share", (F.col("v_low") + (F.col("at") - F.col("low")) * (F.col("v_high") - F.col("v_low"))).alias("value") if kind == "interpolated" else F.col("v_low").alias("value"), "n")
