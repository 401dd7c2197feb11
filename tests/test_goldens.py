"""Exact values from the published test strategy, on tiny inputs."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions import columns as C
from turnloom.functions.spec import REFERENCE, Aggregation, ContractError, MetricSpec, money, schemes, weight_stability_bound
from turnloom.operators import agreement as A
from turnloom.operators import allocate, causal, dialogue, ledger, ranks, resample, sampling, scoring
from turnloom.operators.components import connected_components
from turnloom.sources import artifacts, files, report

TURN = "turn_id string, term string, student_key string, record_id string, turn_index int, agent_id string, level int"


def turns(spark, levels, agents=None, record="r", student="s"):
    agents = agents or ["a"] * len(levels)
    return spark.createDataFrame([(f"{record}{i}", "t", student, record, i + 1, a, x) for i, (x, a) in enumerate(zip(levels, agents, strict=True))], TURN)


SPEC = MetricSpec(catalog=("a", "b", "c"))


def one(spark, levels, spec=SPEC, **k):
    return scoring.students(turns(spark, levels, **k), spec).first()


def test_rise_from_1_to_6(spark):
    r = one(spark, [1, 6])
    assert r.ctq == 1 and r.mab == pytest.approx(math.log(2) / math.log(4)) and r.aiv == pytest.approx(25 + 30 + 15 * (1 - 0.85 / 0.95) + 2.5)
    assert one(spark, [1, 6], MetricSpec(version="legacy-v1", weights=(0.5, 0.3, 0.2))).dhi == pytest.approx(0.15)


def test_no_label_gives_bounds(spark):
    r = one(spark, [None, None])
    assert r.aiv is None and (r.aiv_lower, r.aiv_upper) == (pytest.approx(2.5), pytest.approx(97.5)) and r.abl is None
    old = one(spark, [None, None], MetricSpec(version="legacy-v1", weights=(0.5, 0.3, 0.2)))
    assert old.aiv is None and old.aiv_lower is None


def test_original_endpoints_only(spark):
    assert one(spark, [None, 3, 6]).ctq is None
    assert one(spark, [2, None, 5], MetricSpec(utilities=(0, 0.1, 0.2, 0.5, 0.9, 1), catalog=("a",))).ctq == pytest.approx(0.9)
    assert one(spark, [3]).ctq is None


def test_unknown_and_alien_agents(spark):
    assert one(spark, [1, 2], agents=["a", ""]).mab is None
    with pytest.raises(Exception, match="AGENT_OUTSIDE_FROZEN_CATALOG"):
        one(spark, [1, 2], agents=["a", "z"])


def test_vertices_of_the_distribution(spark):
    row = lambda k: spark.createDataFrame([tuple(float(i == k) for i in range(6))], ", ".join(f"{p} double" for p in C.P))
    assert row(5).select(C.dhi_symmetric(SPEC)).first()[0] == pytest.approx(0)
    assert row(0).select(C.dhi_symmetric(SPEC)).first()[0] == pytest.approx(1 - 0.9 / 0.95)


def test_bounds_of_a_partial_composite(spark):
    df = spark.createDataFrame([(0.6, None, 0.8, None)], "hot double, ctq double, dhi double, mab double")
    s, low, high = C.composite([F.col(c) for c in ("hot", "ctq", "dhi", "mab")], (0.5, 0.3, 0.15, 0.05), Aggregation())
    assert tuple(df.select(s, low, high).first()) == (None, pytest.approx(42), pytest.approx(77))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=4, max_size=4), st.sampled_from([Aggregation(), Aggregation("concave", 1), Aggregation("concave", 5)]))
def test_composite_is_bounded_and_adds_up(spark, values, agg):
    df = spark.createDataFrame([tuple(values)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    r = df.select(C.composite(cols, (0.5, 0.3, 0.15, 0.05), agg)[0].alias("s"), F.array(*C.contributions(cols, (0.5, 0.3, 0.15, 0.05), agg)).alias("p")).first()
    assert -1e-9 <= r.s <= 100 and r.s == pytest.approx(min(100, sum(r.p)))


def test_schemes(spark):
    assert len(schemes(SPEC)) == 12 and all(sum(w) == pytest.approx(1) for _, w, _ in schemes(SPEC))
    assert weight_stability_bound((1, 0, 0, 0), (0, 1, 0, 0)) == 100
    m = scoring.students(turns(spark, [1, 6]).union(turns(spark, [2, 5], record="q", student="z")).union(turns(spark, [2], record="p", student="y")), SPEC)
    got = ranks.compare_schemes(m, SPEC).collect()
    assert len(got) == 12 and {(r.students, r.excluded_students) for r in got} == {(2, 1)}


def test_spearman_and_ranks(spark):
    df = spark.createDataFrame([("t", 1.0, 2.0, 5.0), ("t", 1.0, 2.0, 5.0), ("t", 2.0, 1.0, 5.0)], "term string, a double, b double, c double")
    assert ranks.spearman(df, "a", "b", ["term"]).first().spearman == pytest.approx(-1)
    assert ranks.spearman(df, "a", "c", ["term"]).first().spearman is None
    four = spark.createDataFrame([("t", x) for x in (2.0, 2.0, 1.0, 1.0)], "term string, x double")
    assert sorted(r[0] for r in ranks.with_places(four, ["x"], ["term"]).select(ranks.average_rank("x", True)).collect()) == [1.5, 1.5, 3.5, 3.5]


def test_agreement(spark):
    df = spark.createDataFrame([("t", 1, 1, 3.0), ("t", 2, 1, 1.0)], "term string, gold int, prediction int, weight double")
    assert A.agreement(df, ["term"]).first().accuracy == 0.75
    same = A.agreement(df.where("gold = 1"), ["term"]).first()
    assert same.accuracy == 1 and same.kappa is None and same.linear_kappa is None
    with pytest.raises(Exception, match="INVALID_PAIR"):
        A.agreement(df.withColumn("gold", F.lit(7)), ["term"]).collect()


def test_human_na_wins(spark):
    t = spark.createDataFrame([(i,) for i in range(4)], "turn_id int")
    g = spark.createDataFrame([(0, None), (1, 5)], "turn_id int, label int")
    p = spark.createDataFrame([(0, 3), (1, 3), (2, 3)], "turn_id int, label int")
    got = {r.turn_id: (r.label, r.origin, r.missing_reason) for r in A.adopt(t, g, p).collect()}
    assert got == {0: (None, "human", "human_insufficient_evidence"), 1: (5, "human", None), 2: (3, "model", None), 3: (None, "none", "not_labelled")}


def test_resolutions_must_cover(spark):
    a = spark.createDataFrame([(1, 2), (2, None)], "turn_id int, label int")
    b = spark.createDataFrame([(1, 3), (2, None)], "turn_id int, label int")
    fix = spark.createDataFrame([(1, 6)], "turn_id int, label int")
    assert {tuple(r) for r in A.adjudicate(a, b, fix, "turn_id").collect()} == {(1, 6), (2, None)}
    with pytest.raises(Exception, match="RESOLUTIONS_DO_NOT_COVER"):
        A.adjudicate(a, b, fix.limit(0), "turn_id").collect()


def test_quality_gates_by_group(spark):
    rows = [("a", 1, 1, 1.0), ("a", 2, 3, 2.0), ("a", 3, None, 1.0), ("a", None, 2, 1.0), ("b", 4, 4, None), ("c", None, 1, 1.0)]
    df = spark.createDataFrame(rows, "term string, gold int, prediction int, weight double")
    policy = {"min_n": 2, "min_coverage": 0.6, "min_linear_kappa": 0.1, "audit_unseen": True, "attested_by": "x"}
    got = {r.term: r for r in A.quality_gates(df, ["term"], policy).collect()}
    assert got["a"].passed and (got["a"].pairs, got["a"].gold_na, got["a"].prediction_na) == (2, 1, 1)
    assert got["b"].reasons == ["insufficient_pairs", "missing_design_weights", "insufficient_linear_kappa"]
    assert got["c"].reasons == ["insufficient_pairs", "insufficient_prediction_coverage", "insufficient_linear_kappa"] and got["c"].coverage == 0
    assert A.quality_gates(df, ["term"], policy, "risk").where("passed").isEmpty()
    for change, code in (({"min_n": 1}, "INVALID_MIN_N"), ({"attested_by": " "}, "ATTESTATION_REQUIRED"), ({"audit_unseen": 1}, "INVALID_AUDIT_ATTESTATION"), ({"more": 1}, "INVALID_QUALITY_POLICY")):
        with pytest.raises(ContractError, match=code):
            A.quality_gates(df, ["term"], policy | change)


def test_quality_gate():
    policy = {"min_n": 10, "min_coverage": 0.9, "min_linear_kappa": None, "audit_unseen": True, "attested_by": "x"}
    assert A.quality_gate(8, 2, 0.9, True, policy)["reasons"] == ["quality_criteria_not_confirmed", "insufficient_pairs", "insufficient_prediction_coverage", "missing_design_weights"]


@pytest.mark.parametrize(
    "raw,status,reason,n",
    [
        (None, "missing", "", 0), ("  ", "missing", "", 0), ("https://x.y/z", "url_only", "", 0), ("no marks", "needs_review", "no_role_markers", 0), ("Q: a\nA: b\nQ：c\nA: d", "format_ok_pending_review", "", 2),
        ("Q: a\nQ: b\nA: c", "needs_review", "ambiguous_or_incomplete_roles", 0), ("x\nQ: a\nA: b", "needs_review", "ambiguous_or_incomplete_roles", 0), ("Q: a\nA: b\nQ: c", "needs_review", "ambiguous_or_incomplete_roles", 0), ("Q: a\nA:  ", "needs_review", "empty_role_content", 0),
        ("Q: a\n```\nA: code\n```\nA: b", "format_ok_pending_review", "", 1), ("Q: a\n~~~\nA: b", "needs_review", "ambiguous_or_incomplete_roles", 0), ("<p>Q: x &lt; y</p><div>A: <b>yes</b></div>", "format_ok_pending_review", "", 1), ("Q: a\rA: b Q: c\x0bA: d", "format_ok_pending_review", "", 2),
        ("Q: a\n````\nA: x\n```\nA: y\n````\nA: z", "format_ok_pending_review", "", 1),
    ],
)
def test_parse(spark, raw, status, reason, n):
    r = dialogue.parse(spark.createDataFrame([(1, raw)], "id int, raw string")).first()
    assert (r.status, r.reason, len(r.turns)) == (status, reason, n)
    if "&lt;" in (raw or ""):
        assert r.turns[0].question == "x < y"


def test_components_and_sample(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "src long, dst long")
    got = {r.vertex: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    q = "this one question is long enough to count as a shared one"
    rows = spark.createDataFrame([(f"t{i}", "x", f"s{i}", q.upper() if i < 2 else "short" + str(i)) for i in range(80)], "turn_id string, term string, student_key string, question string")
    members = sampling.components(rows)
    assert members.select("root").distinct().count() == 79
    picked = sampling.stratified_sample(rows, sampling.pools(members, 1), 1).collect()
    assert all((r.design_weight is None) == (r.pool == "risk") for r in picked)


def panel(spark, drop=False):
    rows = []
    for arm in (0, 1):
        for i in range(36):
            low = i < (24 if arm == 0 else 12)
            pre = 30.0 if low else 60.0
            post = pre + (2 if low else 8) + (1 if i % 2 else -1) + 5 * arm
            rows.append((f"{arm}-{i}", f"c{arm}-{i % 12}", arm, "low" if low else "high", pre, None if drop and i == 0 else post))
    return spark.createDataFrame(rows, "student_key string, cluster_id string, treated int, stratum string, pre_score double, post_score double")


def test_effect_of_five(spark):
    p = panel(spark)
    f = causal.fit(p).first()
    assert f.estimate == pytest.approx(5) and f.unadjusted == pytest.approx(7)
    o = causal.overlap(p).first()
    assert o.control_ess == pytest.approx(24) and o.max_treated_cluster_share < 0.2
    b = {r.category: r for r in causal.balance(p).collect()}
    assert (b[None].mean_treated, b[None].mean_control, b[None].weighted_control_mean) == (pytest.approx(50), pytest.approx(40), pytest.approx(50)) and b[None].smd_after == pytest.approx(0)
    got = causal.inference(causal.bootstrap(p, 100), causal.fit(p), 100).first()
    assert got.status in ("approximate_cluster_bootstrap", "bootstrap_support_failure")
    assert causal.audit(p, 0, 100).count() == 0
    assert {r.code: r.n for r in causal.audit(panel(spark, True), 0, 100).collect()} == {"MISSING_OUTCOME_NO_STRATEGY": 2}
    assert causal.fit(p.where("NOT (treated = 0 AND stratum = 'high')")).first().estimate is None


def test_times_of_a_panel(spark):
    cols = "treated int, baseline_time string, covariates_time string, treatment_time string, followup_time string"
    ok = (1, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00+00:00", "2024-03-01T00:00:00Z")
    bad = (0, "2024-02-02T00:00:00Z", None, "2024-02-01T00:00:00Z", "2024-09-01T00:00:00Z")
    window = ("2024-02-02T00:00:00Z", "2024-06-01T00:00:00Z")
    assert causal.time_blockers(spark.createDataFrame([ok], cols), "2024-02-01T00:00:00Z", window).count() == 0
    got = {r.code for r in causal.time_blockers(spark.createDataFrame([ok, bad], cols), "2024-02-01T00:00:00Z", window).collect()}
    assert got == {"TIME_ZERO_UNVERIFIED", "CONTROL_CONTAMINATION"}


def test_noise(spark):
    t = turns(spark, [1, 1, 3, 6])
    k = {(r.mass, r.level): (r.stay, r.lower, r.upper) for r in resample.kernel(t, [0.0, 0.2]).collect()}
    assert k[0.2, 1] == (0.8, 0, pytest.approx(0.2)) and k[0.2, 6] == (0.8, pytest.approx(0.2), 0) and k[0.0, 3] == (1, 0, 0)
    assert k[0.2, 2] == (0.8, pytest.approx(0.2 * 2.5 / 4), pytest.approx(0.2 * 1.5 / 4))
    members = spark.createDataFrame([("s", "s")], "student_key string, root string")
    with pytest.raises(ContractError, match="TOO_FEW_REPLICATES"):
        resample.noise_sensitivity(t, members, SPEC, [0.0], 5)
    with pytest.raises(ContractError, match="INVALID_ERROR_MASS|INVALID_NUMBER"):
        resample.noise_sensitivity(t, members, SPEC, [1.5], 100)
    with pytest.raises(Exception, match="STUDENT_WITHOUT_COMPONENT"):
        resample.noise_sensitivity(t, members.where("false"), SPEC, [0.0], 100).collect()
    for r in resample.noise_sensitivity(t, members, SPEC, [0.0], 100).collect():
        assert r.low == r.high == pytest.approx(r.observed) and r.joint_low is None


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert df.agg(F.percentile("x", 0.5)).first()[0] == 2.5
    assert df.agg(F.collect_list("x").alias("v")).select(ranks.order_statistic(F.col("v"), 0.5)).first()[0] == 2


def audit(**changes):
    """Two strata of 20 and 6: a class is right three times of four, else its neighbour."""
    from dataclasses import replace

    m = tuple(tuple(15 if i == j else 5 if abs(i - j) == 1 and i // 2 == j // 2 else 0 for j in range(6)) for i in range(6))
    large = allocate.Stratum("large", 20, 3, m, 0, "0.02", "2", "0.25", 0.2, 0.3, 0.4, 0.7)
    return replace(allocate.AllocationSpec((large, replace(large, name="small", frame=6, least=1)), 0.1, (0.5, 0.6), "60", 20_000), **changes)


def test_allocation(spark):
    from dataclasses import replace

    spec = audit()
    full = allocate.options(spark, spec).where("n = 6 AND name = 'small'").first()
    assert full.radius == 0 and full.adjudicated == 2 and full.lower_six == pytest.approx(0.75) and full.lower_three == pytest.approx(1.0)
    census = replace(spec, strata=(replace(spec.strata[1], frame=1, least=1),))
    assert allocate.options(spark, census).first().cost == money("2.27")
    assert allocate.solve(spark, audit(limit=10))["status"] == "search_limit"
    with pytest.raises(ContractError, match="SEARCH_LIMIT"):
        allocate.plans(spark, audit(limit=10))
    assert allocate.solve(spark, replace(spec, strata=(replace(spec.strata[0], ai=None),)))["reasons"] == ["unknown_cost"]
    assert allocate.solve(spark, replace(spec, budget="1"))["status"] == "infeasible"
    front = allocate.solve(spark, replace(spec, targets=None))["frontier"]
    assert front and all(not (a.cost <= b.cost and a.lower_six >= b.lower_six and a.lower_three >= b.lower_three) for a in front for b in front if a != b)


def test_what_ifs(spark):
    found = allocate.what_ifs(audit())
    assert sorted(found) == sorted([*allocate.COSTS, *allocate.ERRORS, *allocate.FRAMES]) and len(found) == 7
    base, doubted = audit().strata[0], found["higher_error"].strata[0]
    assert doubted.rate(1) == pytest.approx(8 / 20) and doubted.rate(2) == base.rate(2) and doubted.attempted == base.attempted
    assert found["smaller_rare_stratum"].strata[1].frame == 3 and found["larger_rare_stratum"].strata[1].frame == 12


def test_pilot_strata(spark):
    pairs = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, None), ("b", 6, 6), ("b", None, 3)], "stratum string, gold int, prediction int")
    frames = spark.createDataFrame([("a", 4), ("b", 2)], "stratum string, frame int")
    terms = {"least": 1, "ai": "0", "review": "1", "adjudication": "1", "disagreement": 0.1, "floor_six": 0.0, "floor_three": 0.0, "coverage": 0.0}
    a, b = allocate.pilot_strata(pairs, frames, **terms)
    assert (a.name, a.frame, a.attempted, a.missing, a.rate(1), a.covered) == ("a", 4, 3, 1, pytest.approx(1 / 3), pytest.approx(2 / 3)) and b.attempted == 1


def test_ledger(spark):
    requests = [{"request_hash": h, "reserved": "1"} for h in "abc"]

    def send(r):
        if r["request_hash"] == "b":
            raise TimeoutError
        return {"input_tokens": 10, "output_tokens": 5, "label": 3}

    log = ledger.run(requests, [], send, "10", ("2", "8"), execute=True)
    assert [a["status"] for a in log] == ["validated", "submitted_unknown"] and ledger.run(requests, log, send, "10", ("2", "8")) == log
    with pytest.raises(ContractError, match="UNRESOLVED_CHARGE"):
        ledger.run(requests, log, send, "10", ("2", "8"), execute=True)
    assert ledger.run(requests, [], send, "0.5", ("2", "8"), execute=True)[0]["status"] == "budget_exhausted"
    df = spark.createDataFrame([tuple(a[k] for k in ("request_hash", "attempt", "status", "charge", "reserved", "input_tokens", "output_tokens", "error_code", "label")) for a in log], ledger.ATTEMPT)
    assert ledger.spend(df, "1").first().spent == money("2.00006")
    names = spark.createDataFrame([("a",), ("c",)], "request_hash string")
    assert {r.request_hash: r.status for r in ledger.snapshot(names, df).collect()} == {"a": "validated", "c": "not_attempted"}


def test_strict_json_and_answers():
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "{"):
        with pytest.raises(ContractError):
            files.strict_json(bad)
    assert files.decode_answer('```json\n{"a": 1}\n```') == {"a": 1}
    with pytest.raises(ContractError):
        files.decode_answer("[1]")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ("  @x", 2), ("fine", 3), (None, 4)], "a string, b int")
    files.write_csv(df, f"{tmp_path}/c", ["b", "a"])
    got = {r.b: r.a for r in files.read_csv(spark, f"{tmp_path}/c", "b int, a string").collect()}
    assert got == {1: "'=1+1", 2: "'  @x", 3: "fine", 4: None}
    assert all(p.read_bytes().startswith("\ufeffb,a".encode()) for p in (tmp_path / "c").glob("*.csv"))
    (tmp_path / "plain.csv").write_text("b,a\n7,x\n")
    assert files.read_csv(spark, f"{tmp_path}/plain.csv", "b int, a string").first().b == 7
    files.write_jsonl(df, f"{tmp_path}/j")
    assert files.read_jsonl(spark, f"{tmp_path}/j", df.schema).count() == 4
    (tmp_path / "~$x.txt").write_text("no")
    (tmp_path / "x.txt").write_text("yes")
    assert [r.size for r in files.inventory(spark, str(tmp_path), ".txt").collect()] == [3]
    ids = spark.createDataFrame([("12.0",), (" 7 ",), ("",), ("a1",)], "x string")
    assert [r[0] for r in ids.select(files.identity(F.col("x"))).collect()] == ["12", "7", None, "a1"]
    p = ids.select(files.pseudonym(b"key", F.lit("t"), F.col("x")), files.pseudonym(b"key", F.lit("u"), F.col("x"))).first()
    assert p[0] != p[1] and p[0].startswith("S-") and len(p[0]) == 22


def test_artifacts(spark, tmp_path):
    store = artifacts.ArtifactStore(str(tmp_path))
    a = store.put("dataset", {"x": 1}, table=spark.range(5).toDF("x"))
    assert store.put("dataset", {"x": 1}, table=spark.range(5).toDF("x")) == a and store.rows(spark, a).count() == 5
    b = store.put("metrics", {"y": 2}, [a])
    assert store.verify_tree(b) == 2
    with pytest.raises(ContractError, match="WRONG_ARTIFACT_KIND"):
        store.get(a, "metrics")
    m = tmp_path / a / "manifest.json"
    m.write_text(m.read_text().replace('"x":1', '"x":2'))
    with pytest.raises(ContractError, match="ARTIFACT_CORRUPT"):
        store.verify_tree(b)


def test_report(spark):
    md, page = report.build("T <x>", {"s": spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double")})
    assert "| 1 |  | 0.5000 |" in md and "T &lt;x&gt;" in page


def test_specs_are_checked():
    for k in ({"weights": (1, 1, 1, 1)}, {"utilities": (0, 1, 0, 1, 1, 1)}, {"reference": (0, 0.2, 0.2, 0.2, 0.2, 0.2)}, {"catalog": ("a", "a")}, {"dhi_mode": "x"}):
        with pytest.raises(ContractError):
            MetricSpec(**k)
    assert sum(REFERENCE) == pytest.approx(1)
    with pytest.raises(ContractError):
        money("-1")
