"""What large tables broke."""

from pyspark.sql import functions as F

from turnloom.functions.columns import bar, hashed, uniform
from turnloom.operators import causal, lineage, ranks, resample, streams
from turnloom.sources.tables import made_since


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_draws_of_few_units_are_not_broadcast(spark):
    """an estimate from before the draws are listed would send them through the driver."""
    units = spark.range(50).select(F.lit("t").alias("term"), F.col("id").alias("unit"))
    drawn = causal.draws(units, ["term"], 40, 7)
    assert "ShuffledHashJoin [term" in plan(drawn) and "BroadcastHashJoin [term" not in plan(drawn).split("ShuffledHashJoin [term")[0]
    n = drawn.groupBy("replicate").agg(F.sum("times").alias("n")).collect()
    assert len(n) == 40 and {r.n for r in n} == {50}


def test_top_set_is_that_of_places(spark):
    """F1: ties at the last score are ordered, the rest is not."""
    df = spark.range(1000).select((F.col("id") % 3).alias("term"), F.col("id").alias("student_key"), F.when(F.col("id") % 50 > 0, (F.col("id") * 7 % 12).cast("double")).alias("abl"))
    want = ranks.top_share(df, ["term"], "abl", 0.25).where("place <= size").select("term", "student_key", "abl", "size").collect()
    got = ranks.top_set(df, ["term"], "abl", 0.25).select("term", "student_key", "abl", "size").collect()
    assert sorted(got) == sorted(want) and len(got) == 246


def test_digits_compare_as_numbers(spark):
    """a number that is only compared needs no conversion."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in (-0.5, 0, 2**-60, 0.1, 1 / 3, 0.8, 1 - 2**-53, 1, 1.5)])).alias("t")
    df = spark.range(400).select("id", t).select((hashed(F.col("id")) < bar(F.col("t"))).alias("a"), (uniform(F.col("id")) < F.col("t")).alias("b"))
    assert df.where("a <> b OR a IS NULL").count() == 0 and df.where("a").count() > 1000


def test_seeded_draws_leave_in_counts(spark):
    """draws are listed inside a task, not as rows that are sorted by their number; what
    the clusters carry stays."""
    units = spark.range(50).select(F.lit("t").alias("term"), F.col("id").alias("unit"), (F.col("id") * 2).alias("s"))
    drawn = streams.seeded_draws(units, ["term"], 40, 7)
    assert drawn.columns == ["term", "replicate", "unit", "s", "times"]
    import random

    loop, want = random.Random(7), {}
    for r in range(40):
        for u in loop.choices(range(50), k=50):
            want[r, u] = want.get((r, u), 0) + 1
    got = drawn.collect()
    assert {(r.replicate, r.unit): r.times for r in got} == want and len(got) == len(want) and all(r.s == 2 * r.unit for r in got)


def test_audit_by_slices_of_artifacts(spark):
    """pairs of a slice are gone when the next one begins; cycles are known across slices."""
    edges = [(k, k // 2) for k in range(1, 200)] + [(k, k // 3) for k in range(5, 200, 5)] + [(40, 41), (41, 40), (60, -1), (7, None), (0, None)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).update(() if b is None else (b,))
    reach = {}
    for a in up:
        seen, todo = set(), list(up[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        reach[a] = seen
    df = spark.createDataFrame(edges, "artifact long, input long")
    mark = len(made_since(0))
    got = {r.artifact: tuple(r)[1:] for r in lineage.audit(df, 100).collect()}
    want = {a: (len((s - {a}) & up.keys()), len(s - up.keys()), a in s, not (s - up.keys()) and not any(x in reach.get(x, ()) for x in s)) for a, s in reach.items()}
    assert got == want
    assert len([p for p in made_since(mark) if "/reach-" in p]) <= 1  # that of the cycles
    assert {tuple(r) for r in lineage.closure(df, 100).collect()} == {(a, x) for a, s in reach.items() for x in s}


def test_stability_orders_no_replicate(spark):
    """places of all rows are not asked for."""
    base = spark.range(40).select(F.lit("t").alias("term"), F.col("id").alias("student_key"), (F.col("id") % 9).cast("double").alias("abl"))
    noisy = base.crossJoin(spark.range(3).select(F.col("id").alias("replicate"))).withColumn("abl", F.col("abl") + F.col("replicate"))
    mark = len(made_since(0))
    r = resample.ranking_stability(base, noisy, ["replicate"]).first()
    assert (r.overlap, r.flip_rate) == (1.0, 0.0)
    rows = [spark.read.parquet(p).count() for p in made_since(mark) if "/order-" in p]
    assert sum(rows) < 120  # 160 rows had places
