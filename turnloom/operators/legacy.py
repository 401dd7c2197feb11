"""The older study of labelled records and multi-turn conversations: means of
students, and rounds that draw students, perturb labels and rank anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import bar, hashed
from turnloom.functions.spec import ContractError
from turnloom.operators.causal import draws
from turnloom.operators.ordering import numbered
from turnloom.operators.ranks import order_statistic, top_set
from turnloom.operators.resample import moved, perturb
from turnloom.operators.streams import seeded, seeded_draws
from turnloom.sources.tables import cut, new_folder, partitions


def record_metrics(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, abl (mean level), hot (percent of levels 4 to 6) of labelled records."""
    return records.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("level").alias("abl"), (100 * F.avg((F.col("level") >= 4).cast("double"))).alias("hot"))


def ctq_metrics(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ctq: mean over conversations of half and a tenth of the rise from the
    first to the last turn."""
    ends = turns.groupBy(*keys, "record_id").agg(F.min_by("level", "turn_index").alias("a"), F.max_by("level", "turn_index").alias("z"))
    return ends.groupBy(*keys).agg(F.avg(0.5 + (F.col("z") - F.col("a")) / 10).alias("ctq"))


def checked_sample(turns: DataFrame, conversations: int | None = None) -> DataFrame:
    """``turns`` of a sample: levels 1 to 6, two turns or more to a conversation,
    numbered from 1 without a gap, and as many conversations as expected."""
    rec = turns.groupBy("record_id").agg(F.count("*").alias("n"), F.count_distinct("turn_index").alias("k"), F.min("turn_index").alias("a"), F.max("turn_index").alias("z"), F.count_if(~F.coalesce(F.col("level").between(1, 6), F.lit(False))).alias("bad"))
    one = rec.agg(F.count("*").alias("n"), F.count_if((F.col("n") < 2) | (F.col("k") != F.col("n")) | (F.col("a") != 1) | (F.col("z") != F.col("n"))).alias("broken"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    for wrong, code in ((one.bad, "INVALID_LABEL"), (one.broken, "INCOMPLETE_TURN_SEQUENCE"), (conversations is not None and one.n != conversations, "UNEXPECTED_SAMPLE_SIZE")):
        if wrong:
            raise ContractError(code)
    return turns


def sample_students(turns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sampled turns (conversation_id, ...) with the student of their record: a
    conversation's id names its record's, but for the letter before its number."""
    key = F.regexp_replace("conversation_id", "-c(?=[^-]*$)", "-r")
    both = turns.withColumn("qid", key).join(mapping.select("qid", "student_key"), "qid", "left")
    return both.withColumn("student_key", F.when(F.col("student_key").isNull(), F.raise_error(F.lit("UNKNOWN_TURN_KEY")).cast(mapping.schema["student_key"].dataType)).otherwise(F.col("student_key")))


def mapping_counts(mapping: DataFrame) -> DataFrame:
    """term, records, students, shared (students who are in another term too)."""
    terms = mapping.groupBy("student_key").agg(F.count_distinct("term").alias("_t"))
    return mapping.join(terms, "student_key").groupBy("term").agg(F.count("*").alias("records"), F.count_distinct("student_key").alias("students"), F.count_distinct(F.when(F.col("_t") > 1, F.col("student_key"))).alias("shared"))


def _noisy(rows: DataFrame, used: DataFrame, drawn: DataFrame, mass: float, seed: int, key: str, tag: str, lies: DataFrame | None = None) -> DataFrame:
    """Everybody's labels of ``used`` (some of ``rows``) in every replicate, perturbed by the
    kernel of what the replicate drew of ``rows``: an error goes to a neighbour in proportion
    to its count + 0.5. ``lies`` (term, before, stride): where a replicate's numbers lie in a
    seeded stream, in the order of student and ``key``."""
    own, levels = ["term", "student_key"], range(1, 7)
    held = rows.groupBy(*own).agg(*[F.count_if(F.col("level") == k).alias(f"n{k}") for k in levels])
    n = drawn.withColumnRenamed("unit", "student_key").join(held, own).groupBy("term", "replicate").agg(*[(F.sum(F.col(f"n{k}") * F.col("times")) + 0.5).alias(f"n{k}") for k in levels])
    near = lambda k: F.col(f"n{k}") if k in levels else F.lit(0.0)
    lower = F.array(*[F.struct(F.lit(k).alias("level"), (mass * near(k - 1) / (near(k - 1) + near(k + 1))).alias("lower")) for k in levels])
    kernel = n.select("term", "replicate", F.explode(lower).alias("x")).select("term", "replicate", "x.*")
    kernel = kernel.withColumn("bar", bar(F.lit(1 - mass) + F.col("lower")))
    kernel = cut(kernel, new_folder(rows.sparkSession, "kernel"))  # six rows for each term and replicate
    dealt = used.withColumn("level", F.col("level").cast("int")).repartition(partitions(rows.sparkSession), *own)
    if lies is None:
        h = hashed(F.lit(str(seed)), F.lit(tag), F.col("replicate"), F.col(key))
        each = dealt.join(F.broadcast(kernel), ["term", "level"]).withColumn("_h", h)
        return each.withColumn("level", moved(F.col("level"), F.col("_h") < bar(F.lit(1 - mass)), F.col("_h") < F.col("bar"))).drop("lower", "bar", "_h")
    at = numbered(rows.select(*own, key), ["term"], [F.col("student_key"), F.col(key)], "at")
    each = dealt.join(at, [*own, key]).join(F.broadcast(lies), "term").join(F.broadcast(kernel), ["term", "level"])  # a row for each term
    each = seeded(each.withColumn("at", F.col("replicate") * F.col("stride") + F.col("before") + F.col("at")), "at", seed)
    return each.withColumn("level", perturb(F.col("level"), F.col("u"), F.lit(1 - mass), F.col("lower"))).drop("lower", "bar")


def _ends(turns: DataFrame) -> DataFrame:
    """The first and the last turn of every conversation: all that ``ctq_metrics`` looks at."""
    whole = Window.partitionBy("term", "student_key", "record_id")
    at = F.col("turn_index")
    both = turns.withColumns({"_a": F.min(at).over(whole), "_z": F.max(at).over(whole)})
    return both.where((at == F.col("_a")) | (at == F.col("_z"))).drop("_a", "_z")


def _stretches(records: DataFrame, turns: DataFrame) -> dict[str, DataFrame]:
    """Where a round of a seeded study draws from, of its stretch of the stream: for each
    term students by records and by turns, then labels of records and of turns."""
    names = ("record_draw", "turn_draw", "record_noise", "turn_noise")
    size = lambda df, students, labels: df.groupBy("term").agg(F.count_distinct("student_key").alias(students), F.count("*").alias(labels))
    n = size(records, names[0], names[2]).join(size(turns, names[1], names[3]), "term", "full").na.fill(0)
    order = Window.partitionBy().orderBy("term")  # a row for each term
    whole = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    n = n.withColumn("all", whole).withColumn("before", F.sum("all").over(order) - F.col("all")).withColumn("stride", F.sum("all").over(Window.partitionBy()))
    out, before = {}, F.col("before")
    for c in names:
        out[c] = n.select("term", before.alias("before"), "stride")
        before = before + F.col(c)
    return out


def rounds(records: DataFrame, turns: DataFrame, replicates: int, seed: int, mass: float = 0.2, *, replay: bool = False) -> DataFrame:
    """term, replicate, abl, hot, ctq (means over the students drawn, each as often as
    drawn) and stability (share of the observed top quarter by abl that stays). With
    ``replay`` all numbers come from one seeded generator, in the order of a loop over
    rounds, terms, draws and labels; else from hashes of keys."""
    by, folder = ["term", "replicate"], new_folder(records.sparkSession, "rounds")
    records = cut(records.select("term", "student_key", "record_id", "level"), f"{folder}/records")
    turns = cut(turns.select("term", "student_key", "record_id", "turn_id", "turn_index", "level"), f"{folder}/turns")
    lies = _stretches(records, turns) if replay else {}
    units = lambda df: df.select("term", F.col("student_key").alias("unit")).distinct()
    if replay:
        one, two = (seeded_draws(units(df), ["term"], replicates, seed, lies=lies[c]) for df, c in ((records, "record_draw"), (turns, "turn_draw")))
    else:
        one, two = draws(units(records), ["term"], replicates, seed), draws(units(turns), ["term"], replicates, seed + 1)
    # packed files are far smaller than their rows: neither is to be broadcast for its size
    one, two = cut(one, f"{folder}/one").hint("merge"), cut(two, f"{folder}/two").hint("merge")
    rec = record_metrics(_noisy(records, records, one, mass, seed, "record_id", "record", lies.get("record_noise")), [*by, "student_key"])
    rec = cut(rec.withColumn("score", F.round("abl", 9)), f"{folder}/rec")
    ctq = ctq_metrics(_noisy(turns, _ends(turns), two, mass, seed, "turn_id", "turn", lies.get("turn_noise")), [*by, "student_key"])
    mean = lambda df, drawn, cols: df.join(drawn.withColumnRenamed("unit", "student_key"), [*by, "student_key"]).groupBy(*by).agg(*[(F.sum(F.col(c) * F.col("times")) / F.sum("times")).alias(c) for c in cols])
    base = record_metrics(records, ["term", "student_key"]).withColumn("score", F.round("abl", 9))
    base = top_set(base, ["term"], "score", 0.25).select("term", "student_key", F.lit(1).alias("was"))
    same = top_set(rec.select(*by, "student_key", "score"), by, "score", 0.25).join(base, ["term", "student_key"], "left").groupBy(*by).agg((F.count("was") / F.max("size")).alias("stability"))
    # a row for each term and replicate; the parts are written one after another
    parts = [cut(p, f"{folder}/{name}") for name, p in (("same", same), ("means", mean(rec, one, ["abl", "hot"])), ("ctq", mean(ctq, two, ["ctq"])))]
    return parts[1].join(parts[2], by).join(parts[0], by)


def intervals(found: DataFrame) -> DataFrame:
    """term, metric, low, high (order statistics) over the rounds; the flip rate is
    what of the top quarter does not stay."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("abl", "hot", "ctq")])
    long = found.select("term", F.explode(cells).alias("x")).select("term", "x.*").groupBy("term", "metric").agg(F.collect_list("v").alias("v"))
    flip = found.groupBy("term").agg((1 - F.avg("stability")).alias("flip_rate"))
    return long.select("term", "metric", order_statistic(F.col("v"), 0.025).alias("low"), order_statistic(F.col("v"), 0.975).alias("high")).join(flip, "term")
