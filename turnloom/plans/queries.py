"""Whole queries on the driver's tables. Computed doubles are rounded, so that the
order of a sum does not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import columns as C
from turnloom.functions.spec import Aggregation, MetricSpec
from turnloom.operators import agreement as A
from turnloom.operators import allocate, causal, dialogue, ledger, ranks, resample, sampling, scoring, streams
from turnloom.plans import adapters as D
from turnloom.sources.commits import TableLog
from turnloom.sources.tables import new_folder, partitions, table

KEYS = ["term", "student_key"]
SEED, MASSES = 2045, [0.0, 0.1, 0.2, 0.3]
#: Draws of the interval of a mean, of an effect, and of label noise.
MEAN_REPLICATES, REPLICATES, NOISE_REPLICATES = 1000, 500, 100


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    return df.select(*[(F.round(f.name, places) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def metrics(spark, sf_dir, spec: MetricSpec = D.SPEC) -> DataFrame:
    return scoring.students(D.turns(spark, sf_dir), spec)


def student_summary(spark, sf):
    return rounded(metrics(spark, sf).select(*KEYS, "candidate_turns", "labeled_turns", "coverage", "abl", "hot", *C.P))


def conversation_ctq(spark, sf):
    turns = D.turns(spark, sf)
    a, b = (scoring.conversations(turns, D.SPEC.utilities, legacy).select("term", "student_key", "record_id", "n", F.col("ctq").alias(name), "hot_change") for legacy, name in ((False, "ctq"), (True, "ctq_legacy")))
    return rounded(a.join(b.drop("n", "hot_change"), ["term", "student_key", "record_id"]))


def dhi_symmetric(spark, sf):
    return rounded(metrics(spark, sf).select(*KEYS, "dhi_symmetric"))


def dhi_asymmetric(spark, sf):
    return rounded(metrics(spark, sf, D.ASYMMETRIC).select(*KEYS, "dhi_asymmetric"))


def dhi_legacy(spark, sf):
    return rounded(metrics(spark, sf, D.LEGACY).select(*KEYS, F.col("dhi").alias("dhi_legacy")))


def agent_breadth(spark, sf):
    legacy = metrics(spark, sf, D.LEGACY).select(*KEYS, F.col("mab").alias("mab_legacy"))
    return rounded(metrics(spark, sf).select(*KEYS, "agents", "mab").join(legacy, KEYS))


def aiv_v2(spark, sf):
    return rounded(metrics(spark, sf).select(*KEYS, "hot", "ctq", "dhi", "mab", "aiv"))


CONCAVE = MetricSpec(catalog=D.CATALOG, aggregation=Aggregation("concave", 1))


def aiv_concave(spark, sf):
    return rounded(metrics(spark, sf, CONCAVE).select(*KEYS, "aiv"))


def aiv_bounds(spark, sf):
    """Without a catalogue MAB is missing, so every student has bounds."""
    return rounded(metrics(spark, sf, MetricSpec()).select(*KEYS, "aiv", "aiv_lower", "aiv_upper", F.array_join("missing_reasons", ",").alias("missing_reasons")))


def aiv_legacy(spark, sf):
    return rounded(metrics(spark, sf, D.LEGACY).select(*KEYS, "aiv", "aiv_lower", "aiv_upper"))


def metrics_with_inventory(spark, sf):
    seen = D.turns(spark, sf).select(*KEYS).distinct()
    terms, who = seen.select("term").distinct(), table(spark, sf, "customer").select(F.col("c_custkey").alias("student_key"))
    roster = who.crossJoin(F.broadcast(terms))  # a roster has a row for each term; terms are few
    return rounded(scoring.with_inventory(metrics(spark, sf).select(*KEYS, "candidate_turns", "labeled_turns", "hot"), roster))


def scheme_compare(spark, sf):
    m = metrics(spark, sf).withColumns({i: F.round(i, 9) for i in ("hot", "ctq", "dhi", "mab")})
    return rounded(ranks.compare_schemes(m, D.SPEC), 6)


def indicator_spearman(spark, sf):
    # what differs by rounding only is a tie
    m = metrics(spark, sf).withColumns({i: F.round(i, 9) for i in ("hot", "ctq", "dhi", "mab")})
    return rounded(ranks.indicator_spearman(m), 6)


def student_ranks(spark, sf):
    # scores that differ by rounding only count as ties
    m = metrics(spark, sf).withColumns({i: F.round(i, 9) for i in ("hot", "ctq", "dhi", "mab")})
    return rounded(ranks.student_ranks(m, D.SPEC).withColumn("score", F.round("score", 6)), 6)


def top_quartile_fixed(spark, sf):
    return rounded(ranks.fixed_top_quartile(metrics(spark, sf).withColumn("abl", F.round("abl", 9))), 9)


def predicted(spark, sf) -> DataFrame:
    """Levels moved to a neighbour with probability .2; some have no prediction."""
    t = D.turns(spark, sf)
    u = C.uniform(F.lit(str(SEED)), F.lit("prediction"), F.col("turn_id"))
    moved = F.when(u < 0.8, F.col("level")).when((F.col("level") > 1) & ((u < 0.9) | (F.col("level") == 6)), F.col("level") - 1).otherwise(F.col("level") + 1)
    lost = C.uniform(F.lit(str(SEED)), F.lit("lost"), F.col("turn_id")) < 0.05
    return t.withColumn("prediction", F.when(F.col("level").isNotNull() & ~lost, moved)).withColumn("weight", 1 + F.col("turn_index") % 3)


def _pairs(spark, sf):
    return predicted(spark, sf).where("level IS NOT NULL AND prediction IS NOT NULL").select("term", F.col("level").alias("gold"), "prediction", F.col("weight").cast("double").alias("weight"))


def agreement_weighted(spark, sf):
    return rounded(A.agreement(_pairs(spark, sf), ["term"]))


#: Limits of the gate in three cases; those of the last are unconfirmed.
GATES = {"lenient": (2, 0.5, 0.0, True), "strict": (10**9, 0.99, 0.99, True), "open": (None, None, None, False)}


def quality_gates(spark, sf):
    """The gate of each term under three policies; terms of a month's second half have no
    design weights."""
    p = predicted(spark, sf).select("term", F.col("level").alias("gold"), "prediction", F.when(~F.endswith(F.col("term"), F.lit("b")), F.col("weight").cast("double")).alias("weight"))
    out = None
    for name, (n, coverage, kappa, unseen) in GATES.items():
        policy = {"min_n": n, "min_coverage": coverage, "min_linear_kappa": kappa, "audit_unseen": unseen, "attested_by": "auditor"}
        part = A.quality_gates(p, ["term"], policy).withColumn("policy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out.withColumn("reasons", F.array_join("reasons", ",")))


def agreement_three_tier(spark, sf):
    return rounded(A.agreement(_pairs(spark, sf).withColumn("weight", F.lit(1.0)), ["term"], tiers=2).drop("linear_kappa", "macro_f1"))


def missingness_4way(spark, sf):
    p = predicted(spark, sf)
    ref = p.select("term", "turn_id", F.col("level").alias("label"))
    made = p.where("agent_id <> 'view'").select("turn_id", F.col("prediction").alias("label"))
    return A.missingness(ref, made, "turn_id", ["term"])


def _gold(p):
    return p.where("agent_id IN ('click', 'error')").select("turn_id", F.col("level").alias("label"))


def label_freeze(spark, sf):
    p = predicted(spark, sf)
    return A.adopt(p.select("turn_id", "term"), _gold(p), p.where("agent_id <> 'signup'").select("turn_id", F.col("prediction").alias("label")))


def _reviews(spark, sf):
    p = predicted(spark, sf)
    a = p.where("agent_id <> 'view' OR turn_index > 1").select("turn_id", F.col("level").alias("label"), (F.col("turn_id") % 7 == 0).alias("outsourcing"))
    b = p.select("turn_id", F.col("prediction").alias("label"), (F.col("turn_id") % 11 == 0).alias("outsourcing"))
    return a, b


def adjudication_conflicts(spark, sf):
    return A.conflicts(*_reviews(spark, sf), "turn_id", ["label", "outsourcing"])


def adjudicated_labels(spark, sf):
    a, b = _reviews(spark, sf)
    b = b.join(a, "turn_id", "left_semi")
    answers = A.conflicts(a, b, "turn_id", ["label"]).select("turn_id", F.coalesce("label_a", "label_b").alias("label"))
    return A.adjudicate(a, b, answers, "turn_id")


def exclusion_cascade(spark, sf):
    t = D.turns(spark, sf)
    roster = F.col("student_key") % 10 != 3
    out = dialogue.exclude(t, {"not_in_primary_roster": ~roster, "outside_provisional_window": F.substring("term", 8, 1) == "b", "different_channel": F.col("agent_id") == "purchase"})
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def reconcile_usage(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("declared"))
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("found"))
    both = dialogue.reconcile(o, items, ["k"], "declared", "found")
    return both.agg(F.count("*").alias("orders"), F.count_if("mismatch").alias("mismatches"), F.count_if(F.col("found").isNull()).alias("without_items"), F.sum("found").alias("items"))


def parse_status(spark, sf):
    p = dialogue.parse(D.transcripts(spark, sf))
    return p.select("conv_id", "status", "reason", F.size("turns").alias("turns"))


def parse_turns(spark, sf):
    t = dialogue.explode_turns(dialogue.parse(D.transcripts(spark, sf)), "conv_id")
    return t.select("conv_id", "turn_index", "turn_id", F.sha2("question", 256).alias("question_hash"), F.length("prior_context").alias("prior_chars"))


def question_texts(spark, sf):
    t = D.transcripts(spark, sf)
    return t.select("conv_id", dialogue.count_questions(F.col("raw")).alias("questions"), F.sha2(dialogue.questions_only(F.col("raw")), 256).alias("text_hash"))


def _questions(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("turn_id"), F.col("lang").alias("term"), F.col("doc_id").alias("student_key"), F.col("text").alias("question"))


def dup_components(spark, sf):
    return sampling.components(_questions(spark, sf)).withColumnRenamed("root", "component")


def component_labels(spark, sf):
    return sampling.component_ids(sampling.components(_questions(spark, sf))).select("student_key", "component_id")


def pool_assignment(spark, sf):
    return sampling.pools(sampling.components(_questions(spark, sf)), SEED).select("student_key", F.col("root").alias("component"), "pool")


def stratified_sample(spark, sf):
    q = _questions(spark, sf)
    return rounded(sampling.stratified_sample(q, sampling.pools(sampling.components(q), SEED), SEED))


def seeded_split(spark, sf):
    """The sample as the published seeded loop draws it."""
    q = _questions(spark, sf)
    return rounded(streams.seeded_sample(q, sampling.components(q), SEED))


def parse_review_top15(spark, sf):
    p = dialogue.parse(D.transcripts(spark, sf)).withColumn("anomaly", F.col("status") != "format_ok_pending_review").withColumn("term", (F.col("conv_id") % 4).cast("string"))
    return sampling.top_for_review(p, "term", "anomaly", "conv_id", "2045").select("term", "conv_id", "status", "place")


def panel_audit(spark, sf):
    return causal.audit(D.panel(spark, sf), 0.0, 1e9)


def panel_balance(spark, sf):
    return rounded(causal.balance(D.panel(spark, sf, True)), 6)


def panel_overlap(spark, sf):
    return rounded(causal.overlap(D.panel(spark, sf, True)), 6)


def did_fit(spark, sf):
    return rounded(causal.fit(D.panel(spark, sf, True)), 4)


def did_strata(spark, sf):
    s = causal.strata(D.panel(spark, sf, True))
    return rounded(s.select("stratum", "n1", "n0", (F.col("d1") / F.col("n1")).alias("treated_change"), (F.col("d0") / F.col("n0")).alias("control_change")), 4)


def did_bias_bounds(spark, sf):
    e = causal.fit(D.panel(spark, sf, True)).select("estimate")
    bounds = F.explode(F.array(*[F.lit(b) for b in (0.0, 1000.0, 5000.0)])).alias("bias")
    return rounded(e.select("estimate", bounds).select("bias", (F.col("estimate") - F.col("bias")).alias("low"), (F.col("estimate") + F.col("bias")).alias("high")), 4)


def did_replicates(spark, sf):
    return rounded(causal.bootstrap(D.panel(spark, sf, True), REPLICATES, SEED), 4)


def did_bootstrap(spark, sf):
    p = D.panel(spark, sf, True)
    return rounded(causal.inference(causal.bootstrap(p, REPLICATES, SEED), causal.fit(p), REPLICATES), 4)


def _members(spark, sf):
    """Students in components: those with the same remainder by 400."""
    return D.turns(spark, sf).select("student_key").distinct().withColumn("root", F.col("student_key") % 400)


def observed_bootstrap(spark, sf):
    return rounded(resample.observed_bootstrap(metrics(spark, sf), _members(spark, sf), replicates=MEAN_REPLICATES, seed=SEED))


def seeded_observed(spark, sf):
    """The same, by the published stream, over components of equal questions; a student
    without a question is a component of one."""
    found = sampling.component_ids(sampling.components(_questions(spark, sf))).select("student_key", "component_id")
    m = metrics(spark, sf)
    members = m.select("student_key").distinct().join(found, "student_key", "left").select("student_key", F.coalesce("component_id", F.concat(F.lit("alone-"), "student_key")).alias("root"))
    return rounded(resample.observed_bootstrap(m, members, replicates=MEAN_REPLICATES, seed=SEED, draw=streams.seeded_draws))


def noise_kernel(spark, sf):
    return rounded(resample.kernel(D.turns(spark, sf), MASSES))


def noise_sensitivity(spark, sf):
    return rounded(resample.noise_sensitivity(D.turns(spark, sf), _members(spark, sf), D.SPEC, MASSES, NOISE_REPLICATES, SEED), 6)


def rank_stability(spark, sf):
    """Top sets under label noise of mass .2."""
    t = D.turns(spark, sf)
    stay, both = F.col("stay"), F.col("stay") + F.col("lower")
    kernel = resample.kernel(t, [0.2]).select("term", "level", C.bar(stay).alias("stays"), C.bar(both).alias("lowers"))
    known = t.where("level IS NOT NULL").select(*KEYS, "turn_id", "level").join(F.broadcast(kernel), ["term", "level"])  # six rows for each term
    known = known.repartition(partitions(spark), *KEYS)  # a hundred rows come from each
    noisy = known.withColumn("replicate", F.explode(F.expr(f"sequence(0L, {NOISE_REPLICATES - 1}L)")))
    noisy = noisy.withColumn("h", C.hashed(F.lit(str(SEED)), F.lit("noise"), F.col("replicate"), F.col("turn_id")))
    noisy = noisy.withColumn("level", resample.moved(F.col("level"), F.col("h") < F.col("stays"), F.col("h") < F.col("lowers")))
    keys = ["term", "replicate", "student_key"]
    means = noisy.groupBy(*keys).agg(F.round(F.avg("level"), 9).alias("abl"))
    base = t.groupBy(*KEYS).agg(F.round(F.avg("level"), 9).alias("abl"))
    return rounded(resample.ranking_stability(base, means, ["replicate"]))


#: Agents whose days are audited; what an audit costs and must prove.
AUDITED, TERMS = ("click", "purchase"), {"least": 2, "ai": "0.01", "review": "1", "adjudication": "0.5", "disagreement": 0.1, "floor_six": 0.4, "floor_three": 0.5, "coverage": 0.8}


def pilot(spark, sf) -> allocate.AllocationSpec:
    """Days with turns of two agents as frames, and the predictions for them as a pilot."""
    own = F.col("agent_id").isin(*AUDITED)
    pairs = predicted(spark, sf).where(own).select(F.col("agent_id").alias("stratum"), F.col("level").alias("gold"), "prediction")
    days = table(spark, sf, "events").where(F.col("event_type").isin(*AUDITED)).groupBy(F.col("event_type").alias("stratum")).agg(F.count_distinct(F.to_date("ts")).cast("int").alias("frame"))
    return allocate.AllocationSpec(allocate.pilot_strata(pairs, days, **TERMS), 0.05, (0.6, 0.7), "90", 20_000)


def allocation_options(spark, sf):
    o = allocate.options(spark, pilot(spark, sf))
    return rounded(o.withColumn("cost", F.col("cost").cast("double")).drop("h"))


def _plans(df):
    return rounded(df.select(F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("n"), F.col("cost").cast("double").alias("cost"), "lower_six", "lower_three"))


def allocation_optimal(spark, sf):
    spec = allocate.what_ifs(pilot(spark, sf))["low_human_cost"]
    return _plans(allocate.cheapest(allocate.plans(spark, spec), spec))


def allocation_frontier(spark, sf):
    spec = pilot(spark, sf)
    return _plans(allocate.frontier(allocate.plans(spark, spec), spec))


def _attempts(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "submitted_unknown").when(F.col("event_type") == "view", "validation_failed").otherwise("validated")
    return e.select(F.col("user_id").cast("string").alias("request_hash"), F.col("event_id").cast("int").alias("attempt"), status.alias("status"), F.when(status != "submitted_unknown", ledger.charge(F.col("user_id"), F.col("event_id"), "2", "8")).alias("charge"), F.lit("0.5").cast(ledger.MONEY).alias("reserved"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))


def ledger_spend(spark, sf):
    s = ledger.spend(_attempts(spark, sf), "1.25")
    return s.select(F.col("spent").cast("string").alias("spent"), "input_tokens", "output_tokens")


def ledger_versions(spark, sf):
    """Spend after each version of a shared table of attempts: one commit a status."""
    a, log = _attempts(spark, sf), TableLog(spark, new_folder(spark, "ledger"))
    for s in ("validated", "validation_failed", "submitted_unknown"):
        log.append(a.where(F.col("status") == s))
    each = [ledger.spend(log.rows(v), "1.25").select(F.lit(v).alias("version"), F.col("spent").cast("string").alias("spent"), "input_tokens", "output_tokens") for v in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def ledger_snapshot(spark, sf):
    a = _attempts(spark, sf)
    requests = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("request_hash"))
    return ledger.snapshot(requests, a.select("request_hash", "attempt", "status")).select("request_hash", "attempt", "status")


def plan_reserve(spark, sf):
    p = ledger.plan(table(spark, sf, "benchmark"), "text", "2", "8", 200)
    return p.select("item_id", "request_hash", F.col("reserved").cast("string").alias("reserved"))


def csv_guard(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit(" =")).when(F.col("doc_id") % 3 == 1, F.lit("@")).otherwise(F.lit("")), F.col("source")).alias("cell"))
    return t.select("doc_id", C.csv_safe(F.col("cell")).alias("cell"))


def session_windows(spark, sf):
    from turnloom.streaming.sessions import sessions

    return sessions(table(spark, sf, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.max("turns").alias("longest"), F.sum("labelled").alias("labelled"))


def readiness(spark, sf):
    t = D.turns(spark, sf)
    return t.groupBy("term", "agent_id").agg(F.count("*").alias("turns"), F.count_distinct("student_key").alias("students"), F.min("turn_id").alias("first"), F.max("turn_id").alias("last"))


QUERIES = {f.__name__: f for f in (
    student_summary, conversation_ctq, dhi_symmetric, dhi_asymmetric, dhi_legacy, agent_breadth, aiv_v2, aiv_concave, aiv_bounds, aiv_legacy, metrics_with_inventory, scheme_compare, indicator_spearman,
    student_ranks, top_quartile_fixed, agreement_weighted, quality_gates, agreement_three_tier, missingness_4way, label_freeze, adjudication_conflicts, adjudicated_labels, exclusion_cascade, reconcile_usage, parse_status,
    parse_turns, question_texts, dup_components, component_labels, pool_assignment, stratified_sample, seeded_split, parse_review_top15, panel_audit, panel_balance, panel_overlap, did_fit, did_strata, did_bias_bounds, did_replicates, did_bootstrap,
    observed_bootstrap, seeded_observed, noise_kernel, noise_sensitivity, rank_stability, allocation_options, allocation_optimal, allocation_frontier, ledger_spend, ledger_versions, ledger_snapshot, plan_reserve, csv_guard, session_windows, readiness)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aiv_v2(spark, sf_dir)
