"""Row contracts: each rule is an expression, and a table's faults are rows.

A contract is an ordered list of (code, what must not hold). Checks within a row are
one projection; checks against another table are joins on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.spec import ContractError

# Answers that the review form and the prediction format allow.
OUTSOURCING = ("yes", "no", "uncertain")
REVIEW_LABELS = ("1", "2", "3", "4", "5", "6", "NA")
CONFIDENCE = ("1", "2", "3", "4", "5")
ROSTER_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"
ISO_TIME = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?([+-]\d\d:?\d\d|Z)?)?$"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def first_fault(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule that is broken, or null; an unknown truth is no fault."""
    out = F.lit(None).cast("string")
    for code, wrong in reversed(rules):
        out = F.when(F.coalesce(wrong, F.lit(False)), code).otherwise(out)
    return out


def faults(df: DataFrame, key: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """key, code of the rows that break a rule."""
    return df.select(*key, first_fault(rules).alias("code")).where("code IS NOT NULL")


def checked(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df``, an error where a row breaks a rule."""
    code, first = first_fault(rules), df.columns[0]
    kind = df.schema[first].dataType
    return df.withColumn(first, F.when(code.isNotNull(), F.raise_error(code).cast(kind)).otherwise(F.col(first)))


def set_faults(rows: DataFrame, expected: DataFrame, key: str, code: str) -> DataFrame:
    """key, code for keys that are repeated, missing or not expected."""
    seen = rows.groupBy(key).agg(F.count("*").alias("n"))
    both = seen.join(expected.select(key).distinct().withColumn("there", F.lit(True)), key, "full_outer")
    return both.where("n IS NULL OR n > 1 OR there IS NULL").select(key, F.lit(code).alias("code"))


def label_rules(label: Column, insufficient: Column, evidence: Column, question: Column, reason: Column) -> list[tuple[str, Column]]:
    return [
        ("INVALID_LABEL", label.isNotNull() & ~label.between(1, 6)),
        ("INSUFFICIENT_EVIDENCE_MISMATCH", label.isNull() != F.coalesce(insufficient, F.lit(False))),
        ("EVIDENCE_NOT_VERBATIM", label.isNotNull() & (blank(evidence) | ~F.contains(question, evidence))),
        ("REASON_REQUIRED", blank(reason)),
    ]


def prediction_faults(predictions: DataFrame, turns: DataFrame) -> DataFrame:
    """turn_id, code: predictions (turn_id, label, evidence, reason, outsourcing,
    insufficient_evidence, self_reported_confidence) against the turns (turn_id,
    question) of their task, which they must cover once each."""
    both = predictions.join(turns.select("turn_id", "question"), "turn_id")
    confidence = F.col("self_reported_confidence")
    rules = label_rules(F.col("label"), F.col("insufficient_evidence"), F.col("evidence"), F.col("question"), F.col("reason"))
    rules += [("INVALID_OUTSOURCING", ~F.coalesce(F.col("outsourcing").isin(*OUTSOURCING), F.lit(False))), ("INVALID_CONFIDENCE", ~F.coalesce(confidence.between(0, 1) & ~F.isnan(confidence), F.lit(False)))]
    return set_faults(predictions, turns, "turn_id", "PREDICTION_ID_SET_MISMATCH").unionByName(faults(both, ["turn_id"], rules))


def review_rules(r, question: Column) -> list[tuple[str, Column]]:
    """Rules of a filled review form; ``r`` names its columns. All are text."""
    none, cell = r("bloom_level") == "NA", lambda c: F.coalesce(F.trim(r(c)), F.lit(""))
    return [
        ("LABEL_BLANK", cell("bloom_level") == ""),
        ("INVALID_LABEL", ~cell("bloom_level").isin(*REVIEW_LABELS)),
        ("REVIEWER_OR_DATE_MISSING", (cell("reviewer_id") == "") | (cell("reviewed_at") == "")),
        ("INVALID_REVIEW_DATE", ~cell("reviewed_at").rlike(ISO_TIME)),
        ("INVALID_REVIEW_FLAGS", ~(cell("outsourcing").isin(*OUTSOURCING) & cell("insufficient_evidence").isin("yes", "no"))),
        ("INVALID_CONFIDENCE", ~cell("confidence_1_to_5").isin(*CONFIDENCE)),
        ("INSUFFICIENT_EVIDENCE_MISMATCH", none != (r("insufficient_evidence") == "yes")),
        ("EVIDENCE_NOT_VERBATIM", ~none & ((cell("evidence_quote") == "") | ~F.contains(question, cell("evidence_quote")))),
        ("NA_REASON_REQUIRED", none & (cell("notes") == "")),
    ]


def annotation_faults(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """row_number, code of a filled form (row_number and the form's columns) against
    the turns (turn_id, question): unknown and repeated ids, then the form's rules."""
    first = rows.groupBy("turn_id").agg(F.min("row_number").alias("_first"))
    both = rows.join(first, "turn_id", "left").join(turns.select("turn_id", "question"), "turn_id", "left")
    known = [("UNKNOWN_OR_REPEATED_TURN", F.col("question").isNull() | (F.col("row_number") != F.col("_first")))]
    return faults(both, ["row_number"], known + review_rules(F.col, F.col("question")))


def review_task(turns: DataFrame, selected: DataFrame, reviewer: str) -> DataFrame:
    """The rows that a reviewer gets: turn_id, question, prior_context, text_hash and
    reviewer_id; a selected id without a turn is an error."""
    both = selected.select("turn_id").join(turns.select("turn_id", "question", "prior_context", F.lit(True).alias("_there")), "turn_id", "left")
    both = checked(both, [("UNKNOWN_SAMPLE_ID", F.col("_there").isNull())])
    return both.select("turn_id", "question", "prior_context", text_hash().alias("text_hash"), F.lit(reviewer).alias("reviewer_id"))


def text_hash() -> Column:
    return F.sha2(F.concat_ws("\u0000", "question", "prior_context"), 256)


def review_labels(form: DataFrame, task: DataFrame) -> DataFrame:
    """A filled form as a review: turn_id, label, outsourcing. It must hold the task's
    rows, unchanged, once each."""
    bad = set_faults(form, task, "turn_id", "REVIEW_SAMPLE_CHANGED").select("turn_id", "code")
    if not bad.isEmpty():
        raise ContractError("REVIEW_SAMPLE_CHANGED")
    own = task.select("turn_id", F.col("question").alias("_q"), F.col("text_hash").alias("_h"), F.col("reviewer_id").alias("_r"))
    both = form.join(own, "turn_id")
    rules = [("REVIEW_INPUT_CHANGED", ~(F.col("question").eqNullSafe(F.col("_q")) & (text_hash() == F.col("_h")))), ("REVIEWER_MISMATCH", ~F.col("reviewer_id").eqNullSafe(F.col("_r")))]
    fine = checked(both, rules + review_rules(F.col, F.col("_q")))
    return fine.select("turn_id", F.when(F.col("bloom_level") != "NA", F.col("bloom_level").cast("int")).alias("label"), "outsourcing")


def panel_faults(panel: DataFrame) -> DataFrame:
    """student_key, code of an imported panel: ids, repeated students, treatment,
    covariates (a map of texts), scores and times."""
    number = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
    offset = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(r"([+-]\d\d:?\d\d|Z)$")
    times, hollow = offset("baseline_time"), F.exists(F.map_values("covariates"), lambda v: v.isNull() | (F.trim(v) == ""))
    for c in ("covariates_time", "treatment_time", "followup_time"):
        times = times | offset(c)
    many = panel.groupBy("student_key").agg(F.count("*").alias("_n"))
    rules = [
        ("INVALID_PANEL_ID", blank(F.col("student_key")) | blank(F.col("cluster_id")) | blank(F.col("term"))),
        ("DUPLICATE_STUDENT", F.col("_n") > 1), ("INVALID_TREATMENT", ~F.coalesce(F.col("treated").isin(0, 1), F.lit(False))),
        ("CATEGORICAL_COVARIATES_REQUIRED", F.col("covariates").isNull() | hollow),
        ("INVALID_NUMBER", number("pre_score") | number("post_score")), ("TIME_WITHOUT_OFFSET", times),
    ]
    return faults(panel.join(many, "student_key", "left"), ["student_key"], rules)


def without_gold_overlap(sets: list[DataFrame], key: str = "turn_id") -> DataFrame:
    """All gold rows of several sets; a key that two of them hold is an error."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    many = out.groupBy(key).agg(F.count("*").alias("_n"))
    return checked(out.join(many, key), [("OVERLAPPING_GOLD", F.col("_n") > 1)]).drop("_n")


def gold_pairs(gold: DataFrame, predictions: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """gold, prediction, weight of the turns with a gold label and a prediction. Without
    ``weights`` each counts once; with them a turn without a weight is an error."""
    both = gold.where("label IS NOT NULL").select("turn_id", F.col("label").alias("gold")).join(predictions.where("label IS NOT NULL").select("turn_id", F.col("label").alias("prediction")), "turn_id")
    if weights is None:
        return both.withColumn("weight", F.lit(1.0))
    both = both.join(weights.select("turn_id", F.col("weight").cast("double").alias("weight")), "turn_id", "left")
    return checked(both, [("DESIGN_WEIGHT_MISSING", F.col("weight").isNull() | (F.col("weight") <= 0))])


def complete_sets(parts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, state of ids in two disjoint outcomes (status 'ok' or 'failed'): 'both',
    'neither', 'unknown' where they do not partition the expected ones."""
    seen = parts.groupBy(key).agg(F.max((F.col("status") == "ok").cast("int")).alias("ok"), F.max((F.col("status") == "failed").cast("int")).alias("failed"))
    both = seen.join(expected.select(key).distinct().withColumn("there", F.lit(True)), key, "full_outer")
    state = F.when(F.col("there").isNull(), "unknown").when(F.coalesce("ok", F.lit(0)) + F.coalesce("failed", F.lit(0)) == 0, "neither").when((F.col("ok") == 1) & (F.col("failed") == 1), "both")
    return both.select(key, state.alias("state")).where("state IS NOT NULL")
