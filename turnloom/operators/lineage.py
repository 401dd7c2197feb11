"""What artifacts were made from, all the way: the closure of a table of inputs.

Paths double in each round: what is upstream of an artifact by at most 2**k steps is joined
with what is upstream of that by exactly 2**k, so chains of n artifacts take about log2(n)
rounds, and a pair is found by few paths. A round writes only what is new. Artifacts are
taken in slices, since there are many more pairs than artifacts: an audit holds the pairs of
one slice at a time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.tables import cut, made_since, new_folder, release

#: Inputs of a slice.
SLICE = 2_000_000
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _clean(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table goes once the table is written."""
    was = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if was is None else spark.conf.set(CLEAN, was)


def _behind(left: DataFrame, right: DataFrame) -> DataFrame:
    """artifact, upstream: by way of what is upstream in ``left``. Files of pairs are far
    smaller than their rows, so the join is named: neither side is to be broadcast."""
    via = right.select(F.col("artifact").alias("via"), "upstream").hint("shuffle_hash")
    return left.select("artifact", F.col("upstream").alias("via")).join(via, "via").select("artifact", "upstream").distinct()


class _Steps:
    """Pairs that are 1, 2, 4, ... steps apart by some path, each written when first asked for."""

    def __init__(self, inputs: DataFrame):
        self.folder = new_folder(inputs.sparkSession, "lineage")
        edges = inputs.where("artifact IS NOT NULL AND input IS NOT NULL").select("artifact", F.col("input").alias("upstream")).distinct()
        self.tables = [cut(edges, f"{self.folder}/steps-0")]

    def __getitem__(self, k: int) -> DataFrame:
        while len(self.tables) <= k:
            self.tables.append(cut(_behind(self.tables[-1], self.tables[-1]), f"{self.folder}/steps-{len(self.tables)}"))
        return self.tables[k]

    def slices(self, least: int) -> list[DataFrame]:
        """Inputs in slices of artifacts."""
        n = 1 + self.tables[0].count() // least
        return [self.tables[0].where(F.pmod(F.xxhash64("artifact"), F.lit(n)) == i) for i in range(n)]

    def reach(self, start: DataFrame) -> DataFrame:
        """All pairs of the artifacts of ``start`` (their inputs)."""
        folder, parts, k = new_folder(start.sparkSession, "reach"), [start], 0
        while True:
            known = reduce(DataFrame.union, parts)
            new = cut(_behind(known, self[k]).join(known, ["artifact", "upstream"], "left_anti"), f"{folder}/new-{k}")
            if new.isEmpty():
                return known
            parts.append(new)
            k += 1


def closure(inputs: DataFrame, slice_inputs: int = SLICE) -> DataFrame:
    """artifact, upstream: every pair of an artifact and another (or itself, on a cycle)
    that it was made from, at any distance. ``inputs``: artifact, input; null inputs are
    none, repeated rows are one."""
    with _clean(inputs.sparkSession):
        steps = _Steps(inputs)
        return reduce(DataFrame.union, [steps.reach(s) for s in steps.slices(slice_inputs)])


def _cycles(steps: _Steps) -> DataFrame:
    """Artifacts that rest on themselves. Paths of any length begin and end at them, so others
    need not be followed."""
    far = steps[5]
    on = far.select("artifact").distinct().join(far.select(F.col("upstream").alias("artifact")).distinct(), "artifact")
    pairs = steps.reach(cut(steps[0].join(on, "artifact", "left_semi"), f"{steps.folder}/on"))
    return cut(pairs.where("artifact = upstream").select("artifact").distinct(), f"{steps.folder}/cycles")


def audit(inputs: DataFrame, slice_inputs: int = SLICE) -> DataFrame:
    """One row for each artifact of ``inputs``: n_upstream (other artifacts that it rests
    on and that exist), missing (names that it rests on and that do not exist), cyclic (it
    rests on itself) and verified (none missing, no cycle at it or upstream)."""
    spark = inputs.sparkSession
    with _clean(spark):
        folder = new_folder(spark, "artifacts")
        have = cut(inputs.where("artifact IS NOT NULL").select("artifact").distinct(), f"{folder}/have")
        steps, sums = _Steps(inputs), []
        cycles = _cycles(steps)
        known = have.select(F.col("artifact").alias("upstream"), F.lit(1).alias("there")).join(cycles.select(F.col("artifact").alias("upstream"), F.lit(1).alias("loop")), "upstream", "full")
        for i, part in enumerate(steps.slices(slice_inputs)):
            before = set(made_since(0))
            seen = steps.reach(part).join(known, "upstream", "left")
            one = seen.groupBy("artifact").agg(F.count_if(F.col("there").isNotNull() & (F.col("artifact") != F.col("upstream"))).alias("n_upstream"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("artifact") == F.col("upstream")).alias("own"), F.count("loop").alias("loops"))
            sums.append(cut(one, f"{folder}/sums-{i}"))
            release([p for p in made_since(0) if p not in before])  # the slice's pairs
    out = have.join(reduce(DataFrame.union, sums), "artifact", "left").na.fill(0, ["n_upstream", "missing", "own", "loops"])
    return out.select("artifact", "n_upstream", "missing", (F.col("own") > 0).alias("cyclic"), ((F.col("missing") == 0) & (F.col("loops") == 0)).alias("verified"))
