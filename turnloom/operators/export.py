"""Students by name: a roster joined to the metrics, and the rows of an export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import columns as C
from turnloom.functions.spec import INDICATORS, MetricSpec, require, schemes
from turnloom.operators.contracts import ROSTER_ID, faults
from turnloom.operators.ranks import average_rank, complete, scheme_scores, with_places

KEYS = ["term", "student_key"]


def roster_faults(roster: DataFrame, metrics: DataFrame) -> DataFrame:
    """term, student_key, code: a roster's rows that are not of the metrics' terms, not
    an anonymous id, or repeated, and students of the metrics that it lacks."""
    own = roster.select("term", F.col("student_key").cast("string").alias("student_key"))
    terms = metrics.select("term").distinct().withColumn("_term", F.lit(True))
    many = own.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    seen = many.join(terms, "term", "left")
    rules = [("INVALID_ROSTER_TERM", F.col("_term").isNull()), ("INVALID_ROSTER_ID", ~F.coalesce(F.col("student_key").rlike(ROSTER_ID), F.lit(False))), ("DUPLICATE_ROSTER_STUDENT", F.col("_n") > 1)]
    lost = metrics.select("term", F.col("student_key").cast("string").alias("student_key")).distinct().join(own, KEYS, "left_anti")
    return faults(seen, KEYS, rules).unionByName(lost.withColumn("code", F.lit("ROSTER_MISSING_METRIC_STUDENT")))


def with_roster(metrics: DataFrame, roster: DataFrame) -> DataFrame:
    """``metrics`` and, for each student of the roster without a row in them, a row of
    nulls with a reason; ``source_population`` is the roster's size in the term. A
    student of the metrics who is not in the roster is an error."""
    own = roster.select(*KEYS).distinct()
    sizes = own.groupBy("term").agg(F.count("*").alias("source_population"))
    both = own.withColumn("_in", F.lit(True)).join(metrics.withColumn("_seen", F.lit(True)), KEYS, "full_outer")
    stray = F.when(F.col("_in").isNull(), F.raise_error(F.lit("ROSTER_MISSING_METRIC_STUDENT")).cast(metrics.schema["term"].dataType)).otherwise(F.col("term"))
    reasons = F.when(F.col("_seen").isNull(), F.array(F.lit("no_metric_row_for_roster_member"))).otherwise(F.col("missing_reasons"))
    return both.withColumn("term", stray).withColumn("missing_reasons", reasons).drop("_in", "_seen").join(F.broadcast(sizes), "term")


def export_rows(metrics: DataFrame, spec: MetricSpec) -> DataFrame:
    """One row for each student and scheme: indicators, score or bounds, coverage, rank
    and top quartile within the term's complete cohort, and both populations."""
    require(spec.version == "aiv-v2", "V2_EXPORT_REQUIRED")
    if "source_population" not in metrics.columns:
        metrics = metrics.withColumn("source_population", F.lit(None).cast("long"))
    values, cells = [F.col(i) for i in INDICATORS], []
    for name, weights, aggregation in schemes(spec, False):
        score, low, high = C.composite(values, weights, aggregation)
        cells.append(F.struct(F.lit(name).alias("scenario"), score.alias("score"), low.alias("conditional_lower"), high.alias("conditional_upper")))
    ranked = with_places(scheme_scores(metrics, spec, False).select(*KEYS, "scenario", "score"), ["score"], ["term", "scenario"])
    above = F.col("score_total") - F.col("score_below") - F.col("score_ties")
    places = ranked.select(*KEYS, "scenario", average_rank("score", True).alias("rank"), (above + 1 <= F.ceil(F.col("score_total") / 4)).alias("top_quartile"))
    sizes = metrics.groupBy("term").agg(F.count("*").alias("metric_population"))
    cohort = complete(metrics).groupBy("term").agg(F.count("*").alias("comparison_population"))
    lacks = [F.when(F.col(i).isNull(), F.lit(f"missing_{i}")) for i in INDICATORS]
    reasons = F.array_distinct(F.concat(F.coalesce("missing_reasons", F.array().cast("array<string>")), F.array_compact(F.array(*lacks))))
    rows = metrics.withColumn("s", F.explode(F.array(*cells))).withColumn("reasons", F.array_join(reasons, ";")).withColumn("scenario", F.col("s.scenario"))
    rows = rows.join(places, [*KEYS, "scenario"], "left").join(F.broadcast(sizes), "term").join(F.broadcast(cohort), "term", "left")
    return rows.select(
        *KEYS, "scenario", *INDICATORS, F.col("s.score").alias("aiv"), "s.conditional_lower", "s.conditional_upper", "candidate_turns", "labeled_turns",
        F.try_divide("labeled_turns", "candidate_turns").alias("label_coverage"), "rank", "top_quartile", F.coalesce("comparison_population", F.lit(0)).alias("comparison_population"),
        "metric_population", "source_population", F.col("reasons").alias("missing_reasons"),
    )


def term_rollup(metrics: DataFrame) -> DataFrame:
    """What a report shows of each term: students, those with labels and with a score,
    turns, labelled turns, mean score. A term without a student has no row here."""
    return metrics.groupBy("term").agg(
        F.count("*").alias("students"), F.count_if(F.col("labeled_turns") > 0).alias("with_labels"), F.count("aiv").alias("with_score"),
        F.sum("candidate_turns").alias("turns"), F.sum("labeled_turns").alias("labelled"), F.avg("aiv").alias("mean_score"),
    )


def all_terms(rollup: DataFrame, terms: DataFrame) -> DataFrame:
    """``rollup`` with a row of zeros for every term (term, source_population) that it lacks."""
    both = terms.select("term", "source_population").join(rollup, "term", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("students", "with_labels", "with_score", "turns", "labelled")}
    return both.withColumns(counts)


def legacy_scheme_means(metrics: DataFrame, schemes_: list[tuple[str, tuple[float, ...]]]) -> DataFrame:
    """term, scenario, students, mean_aiv of the older score: the same students (those
    with a score) under each weighting of hot, ctq and dhi."""
    rows = [F.struct(F.lit(name).alias("scenario"), (100 * (w[0] * F.col("hot") + w[1] * F.col("ctq") + w[2] * F.col("dhi"))).alias("v")) for name, w in schemes_]
    cells = metrics.withColumn("s", F.explode(F.array(*rows)))
    value = F.when(F.col("aiv").isNotNull(), F.col("s.v"))
    return cells.groupBy("term", F.col("s.scenario").alias("scenario")).agg(F.count(value).alias("students"), F.avg(value).alias("mean_aiv"))


def source_students(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """``answers`` (qid, ...) with the source student of their question; a question that
    the mapping (qid, student_key) lacks, or has twice, has a reason instead."""
    one = mapping.groupBy("qid").agg(F.count_distinct("student_key").alias("_k"), F.min("student_key").alias("_s"))
    both = answers.join(one, "qid", "left")
    reason = F.when(F.col("_k").isNull(), "unmapped_question").when(F.col("_k") > 1, "ambiguous_question")
    return both.withColumn("source_student", F.when(F.col("_k") == 1, F.col("_s"))).withColumn("reason", reason).drop("_k", "_s")
