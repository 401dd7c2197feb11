"""Replays of seeded studies: the published generator, read by every partition from its
own place (see ``twister``). A draw is known by its number in the stream, so results are
those of one loop over all of it, whatever the partitions; rows that need a number are
range-partitioned by it, and a task jumps to its first one."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions import twister
from turnloom.operators import causal, sampling
from turnloom.operators.ordering import numbered, running
from turnloom.sources.tables import cut, new_folder, partitions


def seeded(df: DataFrame, index: str, seed: int, out: str = "u") -> DataFrame:
    """``df`` with ``out``: result number ``index`` (long, from 0) of ``random()`` after
    ``random.Random(seed)``."""

    def run(batches):
        stream = twister.Uniforms(seed)
        for b in batches:
            at = b.column(b.schema.get_field_index(index)).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(stream.take(at))], [*b.schema.names, out])

    placed = df.repartitionByRange(index).sortWithinPartitions(index)
    return placed.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def seeded_draws(clusters: DataFrame, by: list[str], replicates: int, seed: int, *, joint: bool = False, lies: DataFrame | None = None) -> DataFrame:
    """As ``causal.draws``, by the seeded stream: ``random.choices`` of all units of a
    group, in their order, once a replicate. Every group has a generator of its own with
    the same seed; with ``joint`` one generator goes through the groups, in their order,
    in every replicate. ``lies`` (by, before, stride) tells where in a replicate's stretch
    of the stream a group's draws begin, and how long that stretch is. ``clusters`` (by, unit)
    may have more columns, which stay."""
    spark, folder = clusters.sparkSession, new_folder(clusters.sparkSession, "units")
    units = cut(numbered(clusters.distinct(), by, [F.col("unit")], "slot"), f"{folder}/units")
    sizes = units.groupBy(*by).agg(F.count("*").alias("n_units"))
    if lies is not None:
        sizes = sizes.join(lies, by)
    elif joint:  # a row for each group
        sizes = running(sizes, [], [F.col(b) for b in by], "n_units", "before").withColumn("stride", F.sum("n_units").over(Window.partitionBy()))
    else:
        sizes = sizes.withColumn("before", F.lit(0).cast("long")).withColumn("stride", F.col("n_units"))
    sizes = cut(sizes, f"{folder}/sizes")
    index = (F.col("replicate") * F.col("stride") + F.col("before") + F.col("first")).cast("long")
    each = causal.stretches(sizes, by, replicates, 1 << 17).select(*by, "replicate", "n_units", "many", index.alias("index"))
    # stretches are rows until a task draws them: about a million numbers a task, next to one another
    many = 1 + (replicates * (sizes.agg(F.sum("n_units")).first()[0] or 0) >> 20)
    placed = each.repartitionByRange(min(many, 8 * partitions(spark)), "index").sortWithinPartitions("index")
    types = T.StructType([*each.schema.fields[: len(by) + 1], T.StructField("slot", T.LongType()), T.StructField("times", T.LongType())])
    return causal.counted(placed.mapInArrow(_picked(len(by), seed), types), units, by)


def _picked(by: int, seed: int):
    """Of stretches (by, replicate, n_units, many, index), in order: the slots they pick."""

    def run(batches):
        stream = twister.Uniforms(seed)
        for b in batches:
            for row, (size, many, index) in enumerate(zip(*(c.to_pylist() for c in b.columns[by + 1 :]), strict=True)):
                u = stream.take(np.arange(index, index + many))
                slot, times = np.unique(np.floor(u * size).astype(np.int64), return_counts=True)
                same = [pa.repeat(c[row], len(slot)) for c in b.columns[: by + 1]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(slot), pa.array(times)], [*b.schema.names[: by + 1], "slot", "times"])

    return run


def seeded_pools(members: DataFrame, seed: int) -> DataFrame:
    """``members`` (with root) and pool: one draw for each component, in order of roots."""
    roots = numbered(members.select("root").distinct(), [], [F.col("root")], "index")
    u = F.col("u")
    pool = F.when(u < 0.15, "development").when(u < 0.80, "audit").otherwise("risk")
    return members.join(seeded(roots, "index", seed).select("root", pool.alias("pool")), "root")


def swaps(sizes: list[tuple[int, int]], seed: int, skip: int, block: int = 1 << 16):
    """The swaps (group, i, j) of ``random.shuffle`` for groups (number, size) one after
    the other, after ``skip`` words of the stream: arrays of a block each. Of a draw's
    words, cut to the bits of the bound, the first below it counts."""
    stream, held = twister.Stream(seed, skip), np.zeros(0, np.uint32)
    for group, size in sizes:
        i = size - 1
        while i > 0:
            bits = (i + 1).bit_length()
            room = i + 2 - (1 << bits - 1)  # draws left with as many bits
            if not len(held):
                held = stream.words(block)
            if bits > 32:  # such a bound takes two words a draw
                raise ValueError("GROUP_TOO_LARGE")
            r = (held[: 4 * room + 64] >> np.uint32(32 - bits)).astype(np.int64)
            # word t is taken if it is below i + 1 less the number taken before it
            low = r <= i - np.minimum(np.arange(len(r)), room)
            unsure = np.flatnonzero(~low & (r <= i))
            taken = low.copy()
            if len(unsure):
                for t in unsure.tolist():
                    taken[t] = r[t] <= i - int(taken[:t].sum())
            at = np.flatnonzero(taken)[:room]
            used = int(at[-1]) + 1 if len(at) == room else len(r)
            if len(at):
                steps = i - np.arange(len(at))
                yield group, steps, r[at]
                i -= len(at)
            held = held[used:]


def _swapped(seed: int, skip: int):
    """Of groups (number, size), in order in one task: their swaps. Words are generated
    and told in blocks; how many a group takes depends on those before it."""

    def run(batches):
        sizes = [(g, n) for b in batches for g, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        for group, i, j in swaps(sizes, seed, skip):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), group, np.int64)), pa.array(i), pa.array(j)], ["group", "i", "j"])

    return run


def shuffled(rows: DataFrame, by: list[str], order: list[Column], seed: int, skip: int = 0, out: str = "place") -> DataFrame:
    """``rows`` with ``out``: where ``random.shuffle`` puts each row of its group, groups
    being shuffled in their order by one generator after ``skip`` words.

    Swap i exchanges place i with a place j up to it, from the last i on. What stands at
    place i before its swap came there by the next larger swap to i, so pointers lead to
    the row that was there first; they are followed by doubling. The words are drawn in
    one task, since each draw takes as many as it needs; that task holds a block of them,
    and the swaps are dealt out at once."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "shuffle")
    placed = cut(numbered(rows, by, order, "_was"), f"{folder}/rows")
    groups = numbered(placed.groupBy(*by).agg(F.count("*").alias("_size")), [], [F.col(b) for b in by], "_group")
    groups = cut(groups, f"{folder}/groups")
    sizes = groups.select("_group", "_size").coalesce(1).sortWithinPartitions("_group")
    told = cut(sizes.mapInArrow(_swapped(seed, skip), "group long, i long, j long").repartition("group", "j"), f"{folder}/swaps")
    same = Window.partitionBy("group", "j").orderBy("i")
    # the next larger swap to the same place, and the first one to a place from above it
    links = told.withColumn("succ", F.lead("i").over(same))
    firsts = links.where("i > j").groupBy("group", "j").agg(F.min("i").alias("up")).select("group", F.col("j").alias("at"), "up")
    known = told.select("group", F.col("i").alias("at")).join(firsts, ["group", "at"], "left")
    root = cut(known.select("group", "at", F.coalesce("up", "at").alias("to")), f"{folder}/root-0")
    for n in itertools.count(1):
        over = root.select("group", F.col("at").alias("to"), F.col("to").alias("far"))
        root = cut(root.join(over, ["group", "to"]).select("group", "at", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), f"{folder}/root-{n}")
        if root.where("moved").isEmpty():
            break
        root = root.drop("moved")
    source = F.when(F.col("i") == F.col("j"), F.col("i")).otherwise(F.col("succ"))
    ends = links.select("group", F.col("i").alias("place"), "j", source.alias("at"))
    zero = groups.select(F.col("_group").alias("group"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("j")).join(firsts.where("at = 0").select("group", F.col("up").alias("at")), "group", "left")
    final = ends.unionByName(zero).join(root.select("group", "at", "to"), ["group", "at"], "left").select(F.col("group").alias("_group"), F.coalesce("to", "j").alias("_was"), F.col("place").alias(out))
    return placed.join(groups.select(*by, "_group"), by).join(final, ["_group", "_was"]).drop("_group", "_was")


def seeded_sample(turns: DataFrame, members: DataFrame, seed: int, member: str = "student_key", text: str = "question") -> DataFrame:
    """The sample of ``sampling.stratified_sample`` as a seeded loop draws it: a pool for
    each component, then the candidates of each pool and term, by id, shuffled."""
    pooled = cut(seeded_pools(members, seed), new_folder(turns.sparkSession, "pools"))
    used = 2 * pooled.select("root").distinct().count()
    placed = shuffled(turns.join(pooled.select(member, "pool"), member), ["pool", "term"], [F.col("turn_id")], seed, used)
    return sampling.stratified_sample(placed.drop("pool"), pooled, seed, member, text, place="place")
