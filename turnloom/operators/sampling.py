"""Sampling of turns: students that share a long question are one component, pools
are drawn by component, turns by (pool, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import uniform
from turnloom.functions.text import casefold
from turnloom.operators.components import connected_components
from turnloom.operators.digests import ordered_sha256

# Probabilities and requests of the pools, words that mark a risk.
POOLS = {"development": (0.15, 30), "audit": (0.65, 120), "risk": (0.20, 30)}
RISK_WORDS = ("直接", "答案", "生成", "高级", "创造", "批判")


def normal(text: Column) -> Column:
    """Letters, digits and underscores, folded."""
    return casefold(F.regexp_replace(text, "[^\\p{L}\\p{N}_]", ""))


def components(rows: DataFrame, member: str = "student_key", text: str = "question", least: int = 36) -> DataFrame:
    """member, component: members joined by equal normalised texts of ``least``
    characters or more. Edges form a star for each text, never all pairs."""
    t = rows.select(member, normal(F.col(text)).alias("t")).where(F.length("t") >= least).select(member, F.sha2("t", 256).alias("k")).distinct()
    hub = t.groupBy("k").agg(F.min(member).alias("hub"))
    edges = t.join(hub, "k").where(F.col("hub") != F.col(member)).select(F.col(member).alias("src"), F.col("hub").alias("dst"))
    found = connected_components(edges).toDF(member, "root")
    return rows.select(member).distinct().join(found, member, "left").select(member, F.coalesce("root", member).alias("root"))


def component_ids(members: DataFrame, member: str = "student_key") -> DataFrame:
    """member, root, component_id: 16 hexadecimal digits of the hash of the sorted
    members, joined by a bar, for components of any size."""
    name = F.col(member).cast("string")
    ids = ordered_sha256(members.select("root", name.alias("m")), ["root"], [F.col("m")], "m", "|")
    return members.join(ids.select("root", F.substring("sha256", 1, 16).alias("component_id")), "root")


def pools(members: DataFrame, seed: int) -> DataFrame:
    """``members`` with pool: one draw for each component."""
    u = uniform(F.lit(str(seed)), F.lit("pool"), F.col("root"))
    return members.withColumn("pool", F.when(u < 0.15, "development").when(u < 0.80, "audit").otherwise("risk"))


def risk_score(text: Column) -> Column:
    out = (F.length(text) < 12).cast("int")
    for w in RISK_WORDS:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def stratified_sample(turns: DataFrame, assigned: DataFrame, seed: int, member: str = "student_key", text: str = "question", place: str | None = None) -> DataFrame:
    """Selected turns with both probabilities and the design weight (none for the
    purposive risk pool). ``place``: a column to order candidates by, in place of a hash."""
    rows = turns.join(assigned, member).withColumn("score", F.when(F.col("pool") == "risk", risk_score(F.col(text))).otherwise(0)).withColumn("u", F.col(place) if place else uniform(F.lit(str(seed)), F.lit("turn"), F.col("turn_id")))
    population = rows.groupBy("pool", "term").agg(F.count("*").alias("population"))  # a row for each pool and term
    by, most = Window.partitionBy("pool", "term").orderBy(F.col("score").desc(), "u", "turn_id"), max(n for _, n in POOLS.values())
    # the filter right above the place lets every task drop what cannot be among the first
    rows = rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).join(F.broadcast(population), ["pool", "term"])
    take = F.lit(0)
    p1 = F.lit(0.0)
    for name, (p, n) in POOLS.items():
        take, p1 = F.when(F.col("pool") == name, n).otherwise(take), F.when(F.col("pool") == name, p).otherwise(p1)
    p2 = F.when(F.col("pool") != "risk", F.least(take, F.col("population")) / F.col("population"))
    chosen = rows.where(F.col("place") <= take)
    return chosen.select("turn_id", member, "pool", "term", p1.alias("stage1_probability"), p2.alias("stage2_probability"), (1 / (p1 * p2)).alias("design_weight"), "population")


def top_for_review(rows: DataFrame, group: str, anomaly: str, key: str, seed: str, k: int = 15) -> DataFrame:
    """The first k of each group: anomalies first, then by hash of seed and key."""
    order = Window.partitionBy(group).orderBy(F.col(anomaly).desc(), F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
