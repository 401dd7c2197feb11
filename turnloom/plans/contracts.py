"""Queries of the steps around the scores: contracts of imported rows, rosters and
exports, admission, gates of a panel, what-ifs. Inputs come from the driver's tables
with faults sown by remainders of a key."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.columns import feature_bound, uniform
from turnloom.functions.spec import BALANCED, INDICATORS, Aggregation, legacy_schemes, weight_stability_bound
from turnloom.operators import agreement, allocate, causal, contracts, dialogue, export, ledger, legacy, lineage, resample, scoring, selection, workflow
from turnloom.plans import adapters as D
from turnloom.plans.queries import KEYS, SEED, _members, metrics, pilot, rounded
from turnloom.sources import json_lines
from turnloom.sources.files import identity
from turnloom.sources.tables import table

ZERO, WINDOW = "2024-02-01T00:00:00Z", ("2024-03-15T00:00:00Z", "2024-06-30T00:00:00Z")
PROTOCOL = workflow.Protocol(term="T1", time_zero=ZERO, window=WINDOW, lower=0.0, upper=300_000.0, higher_is_better=False, covariates=("segment",), biases=(0.0, 1000.0), threshold=10.0)


def every(n: int, key: str = "k") -> Column:
    return F.col(key) % n == 0


def full_panel(spark, sf) -> DataFrame:
    """The two-period panel with terms, covariates and times, and faults in all of them."""
    p = D.panel(spark, sf).withColumn("k", F.col("student_key"))
    time = lambda fine, *faults: _case(F.lit(fine), *[(every(n), F.lit(t)) for n, t in faults])
    treated = F.when(every(89), 1 - F.col("treated")).otherwise(F.col("treated")).cast("int")
    start = F.when(F.col("t") == 1, F.when(every(67), "2024-02-03T00:00:00Z").otherwise(ZERO)).when(every(61), ZERO)
    return p.withColumn("t", treated).select(
        F.concat(F.lit("S"), F.when(every(101), F.lit("0")).otherwise(F.col("k").cast("string"))).alias("student_key"), F.concat(F.lit("n"), F.col("cluster_id").cast("string")).alias("cluster_id"),
        F.when(every(97), "T2").otherwise("T1").alias("term"), F.col("t").alias("treated"), F.create_map(F.when(every(83), "other").otherwise("segment"), F.col("stratum")).alias("covariates"), "stratum",
        "pre_score", "post_score", time("2024-01-10T08:00:00+08:00", (79, None), (73, "2024-03-01T00:00:00Z")).alias("baseline_time"), time("2024-01-09T00:00:00Z", (71, "2024-02-02T00:00:00Z")).alias("covariates_time"),
        start.alias("treatment_time"), time("2024-04-01T00:00:00Z", (59, "2024-09-01T00:00:00Z")).alias("followup_time"),
    )


def _case(default: Column, *cases: tuple[Column, Column]) -> Column:
    for when, then in reversed(cases):
        default = F.when(when, then).otherwise(default)
    return default


def panel_blockers(spark, sf):
    return workflow.blockers(full_panel(spark, sf), PROTOCOL)


def panel_import_faults(spark, sf):
    """First broken rule of each row of an imported panel, with faults of all six kinds."""
    p = full_panel(spark, sf)
    n = F.length("stratum") + 7 * F.coalesce(F.substring("student_key", 2, 12).cast("long"), F.lit(0))
    sown = p.withColumn("n", n).withColumns({
        "cluster_id": F.when(F.col("n") % 31 == 0, " ").otherwise(F.col("cluster_id")), "treated": F.when(F.col("n") % 29 == 0, 2).otherwise(F.col("treated")),
        "covariates": F.when(F.col("n") % 23 == 0, F.create_map(F.lit("segment"), F.lit(" "))).when(F.col("n") % 19 == 0, F.lit(None)).otherwise(F.col("covariates")),
        "pre_score": F.when(F.col("n") % 17 == 0, float("inf")).otherwise(F.col("pre_score")), "followup_time": F.when(F.col("n") % 13 == 0, "2024-04-01T00:00:00").otherwise(F.col("followup_time")),
    })
    return contracts.panel_faults(sown.drop("n")).groupBy("code").agg(F.count("*").alias("n"))


def panel_warnings(spark, sf):
    return causal.warnings(D.panel(spark, sf, True))


def did_subgroups(spark, sf):
    return rounded(causal.subgroups(D.panel(spark, sf, True), 100, SEED), 4)


def did_threshold(spark, sf):
    p = D.panel(spark, sf, True)
    found = causal.inference(causal.bootstrap(p, 100, SEED), causal.fit(p), 100)
    bias = F.explode(F.array(*[F.lit(b) for b in PROTOCOL.biases])).alias("bias")
    bounds = found.select("ci_low", "ci_high", "estimate", bias)
    return rounded(bounds.select("bias", (F.col("estimate") - F.col("bias")).alias("low"), (F.col("estimate") + F.col("bias")).alias("high"), (F.col("ci_low") - F.col("bias")).alias("ci_low"), (F.col("ci_high") + F.col("bias")).alias("ci_high"), (F.col("ci_low") > PROTOCOL.threshold).alias("threshold_exceeded")), 4)


def roster(spark, sf) -> DataFrame:
    """Everyone seen in a term, and every fifth customer."""
    seen = D.turns(spark, sf).select(*KEYS).distinct()
    more = table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("student_key"))
    return seen.union(_terms(seen, more)).distinct()


def _terms(seen: DataFrame, students: DataFrame) -> DataFrame:
    """Each student with each term; terms are a few, so they travel as an array."""
    terms = seen.groupBy().agg(F.collect_set("term").alias("terms"))
    return students.crossJoin(F.broadcast(terms)).select(F.explode("terms").alias("term"), "student_key")


def student_export(spark, sf):
    m = metrics(spark, sf).withColumns({i: F.round(i, 9) for i in ("hot", "ctq", "dhi", "mab")})
    rows = export.export_rows(export.with_roster(m.drop("aiv", "aiv_lower", "aiv_upper"), roster(spark, sf)), D.SPEC)
    return rounded(rows.withColumn("aiv", F.round("aiv", 6)), 6)


def roster_gaps(spark, sf):
    """Faults of a roster with strange terms and ids, repeated rows and gaps."""
    r = roster(spark, sf).withColumn("k", F.col("student_key")).withColumn("student_key", F.col("k").cast("string"))
    odd = r.withColumn("student_key", F.when(every(13), F.concat(F.lit("_"), "student_key")).otherwise(F.col("student_key"))).withColumn("term", F.when(every(17), "never").otherwise(F.col("term"))).where(~every(19))
    return export.roster_faults(odd.union(odd.where(every(23))).drop("k"), metrics(spark, sf))


def term_rollup(spark, sf):
    terms = D.turns(spark, sf).groupBy("term").agg(F.count_distinct("student_key").alias("source_population"))
    terms = terms.union(spark.createDataFrame([("1999-01a", 7)], "term string, source_population long"))
    return rounded(export.all_terms(export.term_rollup(metrics(spark, sf)), terms), 6)


def legacy_scheme_means(spark, sf):
    return rounded(export.legacy_scheme_means(metrics(spark, sf, D.LEGACY), legacy_schemes()), 6)


def stability_bounds(spark, sf):
    """Largest change of a term's scores when each indicator of a student is off by its
    own gap to the middle, for both aggregations, and when weights are balanced."""
    gaps = [F.col(i) - 0.5 for i in INDICATORS]
    bound = {name: F.max(feature_bound(gaps, D.SPEC.weights, a)).alias(name) for name, a in (("linear", Aggregation()), ("concave", Aggregation("concave", 2.0)))}
    found = metrics(spark, sf).groupBy("term").agg(*bound.values(), F.count("*").alias("students"))
    return rounded(found.withColumn("weights", F.lit(weight_stability_bound(D.SPEC.weights, BALANCED))), 6)


def question(key: Column) -> Column:
    return F.concat(F.lit("turn "), key.cast("string"), F.lit(" asks why"))


def _tasks(spark, sf) -> DataFrame:
    t = D.turns(spark, sf).withColumn("k", F.col("turn_id"))
    return t.select("k", "turn_id", "term", "level", question(F.col("k")).alias("question"), F.lit("").alias("prior_context"))


def _form(spark, sf) -> DataFrame:
    label = _case((1 + F.col("k") % 6).cast("string"), (every(13), F.lit("")), (F.col("k") % 13 == 1, F.lit("9")), (F.col("k") % 13 == 2, F.lit("NA")))
    cell = lambda fine, n, bad: F.when(every(n), bad).otherwise(fine)
    f = _tasks(spark, sf).withColumn("bloom_level", label).select(
        "k", (F.col("k") + 2).alias("row_number"), "turn_id", "bloom_level", cell("r1", 17, "").alias("reviewer_id"), cell("2024-05-01T10:00:00", 19, "yesterday").alias("reviewed_at"), cell("no", 23, "maybe").alias("outsourcing"),
        F.when(F.col("bloom_level") == "NA", cell("yes", 5, "no")).otherwise("no").alias("insufficient_evidence"), cell("3", 29, "7").alias("confidence_1_to_5"), cell("asks", 31, "not there").alias("evidence_quote"), cell("n", 7, "").alias("notes"),
    )
    again = f.where(every(37)).withColumn("row_number", F.col("row_number") + 1_000_000_000)
    stray = f.where(every(41)).withColumn("row_number", F.col("row_number") + 2_000_000_000).withColumn("turn_id", -F.col("turn_id") - 1)
    return f.union(again).union(stray)


def annotation_faults(spark, sf):
    return contracts.annotation_faults(_form(spark, sf), _tasks(spark, sf))


def prediction_faults(spark, sf):
    t = _tasks(spark, sf)
    none = F.col("k") % 11 == 1
    p = t.where(~every(47)).select(
        "turn_id", _case(F.when(~none, F.col("k") % 6 + 1), (every(11), F.lit(9))).cast("int").alias("label"), (none & ~every(2)).alias("insufficient_evidence"), F.when(every(31), "absent").otherwise("asks").alias("evidence"),
        F.when(every(29), " ").otherwise("because").alias("reason"), F.when(every(23), "perhaps").otherwise("yes").alias("outsourcing"), F.when(every(19), 1.5).otherwise(0.5).alias("self_reported_confidence"),
    )
    return contracts.prediction_faults(p.union(p.where("turn_id % 43 = 0")), t)


def review_labels(spark, sf):
    task = contracts.review_task(_tasks(spark, sf), _tasks(spark, sf).where(every(3)).select("turn_id"), "r1")
    form = task.select("turn_id", "question", "prior_context", "text_hash", "reviewer_id", F.when(F.col("turn_id") % 4 == 0, "NA").otherwise((F.col("turn_id") % 6 + 1).cast("string")).alias("bloom_level"), F.lit("2024-05-01").alias("reviewed_at"), F.when(F.col("turn_id") % 5 == 0, "uncertain").otherwise("no").alias("outsourcing"), F.when(F.col("turn_id") % 4 == 0, "yes").otherwise("no").alias("insufficient_evidence"), F.lit("4").alias("confidence_1_to_5"), F.lit("why").alias("evidence_quote"), F.lit("note").alias("notes"))
    return contracts.review_labels(form, task)


def label_faults(spark, sf):
    t = _tasks(spark, sf)
    code = agreement.label_contract(F.when(every(5), 7).when(~every(3), F.col("k") % 6 + 1), every(6), F.when(every(7), "").when(every(11), "never").otherwise("asks"), F.col("question"))
    return t.select("turn_id", code.alias("code")).where("code IS NOT NULL")


def gold_overlap(spark, sf):
    t = _tasks(spark, sf).select("turn_id")
    return agreement.repeated(t.where("turn_id % 3 = 0").union(t.where("turn_id % 7 = 0")), "turn_id")


def gold_pairs(spark, sf):
    t = _tasks(spark, sf)
    gold = contracts.without_gold_overlap([t.where("turn_id % 2 = 0").select("turn_id", F.col("level").alias("label")), t.where("turn_id % 2 = 1 AND turn_id % 3 = 0").select("turn_id", F.col("level").alias("label"))])
    made = t.where(~every(5)).select("turn_id", (F.col("k") % 6 + 1).cast("int").alias("label"))
    return contracts.gold_pairs(gold, made, t.select("turn_id", (1 + F.col("k") % 4).alias("weight")))


def _parsed(spark, sf) -> DataFrame:
    return dialogue.parse(D.transcripts(spark, sf)).select(F.col("conv_id").alias("record_id"), "status", "turns")


def accepted_records(spark, sf):
    """Records admitted one by one and, as a reviewed sample had no failure, the rest
    of the well-formed ones; then their turns."""
    records = _parsed(spark, sf)
    well = F.col("status") == workflow.READY
    decided = records.where("record_id % 3 = 0").select("record_id", F.when(well, "accepted").otherwise("rejected").alias("decision"), F.lit("read").alias("reason"))
    ids = workflow.admit(records.select("record_id", "status"), decided, decided.where("record_id % 6 = 0").select("record_id"))
    return records.join(ids, "record_id", "left_semi").select("record_id", F.size("turns").alias("turns"))


def request_projection(spark, sf):
    """Requests of one pool: what a model is asked, under a hash of rubric, model and prompt."""
    t = _tasks(spark, sf).where(uniform(F.lit(str(SEED)), F.lit("pool"), F.col("turn_id")) < 0.15)
    asked = t.select("turn_id", F.concat_ws("\u0000", F.lit("rubric-1"), F.lit("model-a"), F.lit("Label this."), "question", "prior_context").alias("body"))
    p = ledger.plan(asked, "body", "2", "8", 100)
    return p.select("turn_id", "request_hash", F.col("reserved").cast("string").alias("reserved"))


def set_states(spark, sf):
    t = _tasks(spark, sf)
    parts = t.where(~every(7)).select("turn_id", F.lit("ok").alias("status")).union(t.where(every(5)).select("turn_id", F.lit("failed").alias("status"))).union(t.where(every(11)).select(-F.col("turn_id") - 1, F.lit("ok").alias("status")))
    return contracts.complete_sets(parts, t, "turn_id")


def probe_status(spark, sf):
    t = _tasks(spark, sf).withColumn("pair", F.floor(F.col("k") / 2))
    rows = t.select("pair", F.when(every(2), "base").otherwise("attack").alias("variant"), F.when(~every(9), F.col("k") % 3 + 1).cast("int").alias("label"))
    return workflow.probe_pairs(rows)


def source_students(spark, sf):
    t = D.turns(spark, sf).select("turn_id", "student_key")
    mapping = t.where("turn_id % 4 > 0").select(F.col("turn_id").alias("qid"), "student_key").union(t.where("turn_id % 9 = 1").select(F.col("turn_id").alias("qid"), F.col("student_key") + 1))
    return export.source_students(t.where("turn_id % 3 = 1").select(F.col("turn_id").alias("qid")), mapping)


def identity_values(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    raw = _case(F.concat(F.lit(" "), F.col("k").cast("string"), F.lit(".0 ")), (every(3), F.concat(F.col("k").cast("string"), F.lit(".50"))), (every(5), F.lit("  ")), (every(7), F.lit(None)), (every(11), F.concat(F.lit("A-"), F.col("k").cast("string"))))
    return c.select(F.col("k").alias("row_id"), identity(raw).alias("id"))


COVARIATES = ["segment", "region", "balance"]


def covariate_panel(spark, sf) -> DataFrame:
    """The complete panel with a map of three covariates, one of them not always known."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("student_key"), F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 5).cast("string").alias("region"), F.floor(F.col("c_acctbal") / 4000).cast("string").alias("balance"))
    known = F.when(every(13, "student_key"), F.create_map(F.lit("segment"), "segment", F.lit("region"), "region")).otherwise(F.create_map(F.lit("segment"), "segment", F.lit("region"), "region", F.lit("balance"), "balance"))
    return D.panel(spark, sf, True).drop("stratum").join(c.select("student_key", known.alias("covariates")), "student_key")


def covariate_strata(spark, sf):
    """Strata of the tuples of three covariates, with their arms and changes."""
    p = causal.covariate_strata(covariate_panel(spark, sf), COVARIATES)
    tuples = p.groupBy("stratum").agg(*[F.min(F.try_element_at("covariates", F.lit(c))).alias(c) for c in COVARIATES])
    s = causal.strata(p).join(tuples, "stratum")
    return rounded(s.select("stratum", *COVARIATES, "n1", "n0", (F.col("d1") / F.when(F.col("n1") > 0, F.col("n1"))).alias("treated_change"), (F.col("d0") / F.when(F.col("n0") > 0, F.col("n0"))).alias("control_change")), 4)


SHARES = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]


def score_percentiles(spark, sf):
    """Percentiles of raw levels, conversation lengths and scores of a term, both kinds."""
    t, m = D.turns(spark, sf), metrics(spark, sf)
    values = t.select("term", F.lit("level").alias("what"), F.col("level").cast("double").alias("v")).unionByName(t.select("term", F.lit("gap").alias("what"), (F.col("turn_id") * 37 % 1009 / 8.0).alias("v"))).unionByName(m.select("term", F.lit("score").alias("what"), F.round("aiv", 9).alias("v")))
    one, two = (selection.percentiles(values, ["term", "what"], "v", SHARES, kind).withColumnRenamed("value", kind) for kind in ("interpolated", "order"))
    return rounded(one.join(two.drop("n"), ["term", "what", "share"]))


def simulated_effects(spark, sf):
    """Point estimates over the panel with a known effect added, once a simulation."""
    p = workflow.injected_panels(D.panel(spark, sf, True), 20, 5000.0, spread=2000.0)
    change = F.col("post_score") - F.col("pre_score")
    arm = lambda c, t: F.sum(F.when(F.col("treated") == t, c).otherwise(F.lit(0.0)))
    sums = p.groupBy("simulation", "stratum").agg(arm(F.lit(1.0), 1).alias("n1"), arm(F.lit(1.0), 0).alias("n0"), arm(change, 1).alias("d1"), arm(change, 0).alias("d0"))
    return rounded(causal.estimate(sums, ["simulation"]), 4)


def allocation_whatifs(spark, sf):
    """The cheapest plan that meets the targets, whatever the budget, in each what-if."""
    out = None
    for name, spec in allocate.what_ifs(pilot(spark, sf)).items():
        free = replace(spec, budget=None)
        best = allocate.cheapest(allocate.plans(spark, free), free, 1)
        part = best.select(F.lit(name).alias("scenario"), F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("n"), F.col("cost").cast("double").alias("cost"), "lower_six", "lower_three")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def json_faults(spark, sf):
    """Lines of an event each, some with faults: what a strict reader says of them."""
    k, n = F.col("event_id").cast("string"), F.col("event_id")
    line = _case(
        F.concat(F.lit('{"k":'), k, F.lit(',"v":{"w":[1,2.5e3],"t":"NaN \\" {"}}')), (n % 7 == 0, F.concat(F.lit('{"k":'), k, F.lit(',"v":1,"k":2}'))), (n % 11 == 0, F.concat(F.lit('{"k":'), k, F.lit(',"v":{"w":{"x":1,"x":2}}}'))),
        (n % 13 == 0, F.concat(F.lit('{"k":'), k, F.lit(',"v":-Infinity}'))), (n % 17 == 0, F.concat(F.lit('{"k":'), k, F.lit(',"v":1e999}'))), (n % 19 == 0, F.concat(F.lit('{"k":'), k, F.lit("} {}"))), (n % 23 == 0, F.concat(F.lit("["), k, F.lit("]"))),
    )
    return table(spark, sf, "events").select("event_id", json_lines.fault(line).alias("code")).where("code IS NOT NULL")


def manifest_inputs(spark, sf) -> DataFrame:
    """A manifest for each event: made from that of half its number, some from another
    too, a few from one that is not there, and a few in a ring."""
    k = F.col("k")
    e = table(spark, sf, "events").select(F.col("event_id").alias("k"))
    two = F.when(every(5), F.floor(k / 3).cast("long"))
    lost = F.when(every(89), -k - 1)
    ring = F.when((k >= 600) & (k % 200 < 3), F.when(k % 200 == 2, k - 2).otherwise(k + 1))
    inputs = F.array_compact(F.array(F.when(k > 0, F.floor(k / 2).cast("long")), F.when(k > 2, two), F.when(k > 0, lost), ring))
    return e.select(k.alias("artifact"), F.explode_outer(inputs).alias("input"))


def lineage_audit(spark, sf):
    return lineage.audit(manifest_inputs(spark, sf))


def roots_of_noise(spark, sf):
    """Students of each component with labels: what a draw of components moves."""
    base = resample.in_components(scoring.students(D.turns(spark, sf), D.SPEC).where("labeled_turns > 0"), _members(spark, sf))
    return base.groupBy("term", "root").agg(F.count("*").alias("students"))


def question_build(spark, sf):
    """Question-only texts of a roster's students, some records first."""
    t = D.transcripts(spark, sf).select(F.col("conv_id").cast("string").alias("record_id"), (F.col("conv_id") % 10).alias("student_key"), "raw")
    keep = spark.range(7).select(F.col("id").alias("student_key"))
    made = workflow.question_texts(t, keep, ["3", "1"])
    return made.select("record_id", "student_key", F.sha2("questions", 256).alias("text_hash"), "priority")


def _labelled(spark, sf) -> DataFrame:
    """Whole conversations of two labelled turns or more."""
    t = D.turns(spark, sf)
    whole = t.groupBy("record_id").agg(F.count("*").alias("n"), F.count("level").alias("k")).where("n >= 2 AND n = k").select("record_id")
    return t.join(whole, "record_id", "left_semi")


def legacy_metrics(spark, sf):
    t = _labelled(spark, sf)
    keys = ["term", "student_key"]
    return rounded(legacy.record_metrics(t, keys).join(legacy.ctq_metrics(legacy.checked_sample(t), keys), keys))


def legacy_rounds(spark, sf):
    """Fifty rounds over labelled turns as records, and over whole conversations."""
    records = D.turns(spark, sf).where("level IS NOT NULL").select("term", "student_key", F.col("turn_id").alias("record_id"), "level")
    return rounded(legacy.intervals(legacy.rounds(records, _labelled(spark, sf), 50, SEED)), 6)


def sampled_students(spark, sf):
    t = D.turns(spark, sf)
    rows = t.where("turn_id % 5 = 0").select(F.concat(F.lit("u-c"), F.col("turn_id").cast("string")).alias("conversation_id"), "turn_index")
    mapping = t.select(F.concat(F.lit("u-r"), F.col("turn_id").cast("string")).alias("qid"), "student_key")
    return legacy.sample_students(rows, mapping).select("conversation_id", "qid", "student_key")


def mapping_counts(spark, sf):
    return legacy.mapping_counts(D.turns(spark, sf).select("term", "student_key"))


QUERIES = {f.__name__: f for f in (
    panel_blockers, panel_import_faults, panel_warnings, did_subgroups, did_threshold, student_export, roster_gaps, term_rollup, legacy_scheme_means, stability_bounds, annotation_faults, prediction_faults,
    review_labels, label_faults, gold_overlap, gold_pairs, accepted_records, request_projection, set_states, probe_status, source_students, identity_values, simulated_effects, allocation_whatifs, roots_of_noise, question_build, legacy_metrics, legacy_rounds, covariate_strata, score_percentiles, lineage_audit, json_faults, sampled_students, mapping_counts)}
