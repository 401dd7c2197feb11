"""The queries of ``contracts`` in DuckDB's SQL, with numbers of their own."""

from __future__ import annotations

from turnloom.plans.oracles import DID_REPS, FOUR, INDICATORS, PARSED, PRIMARY, REPS, ST, P, S, T, U, drawn, g, plan_sql, score
from turnloom.plans.oracles import ORACLES as OTHERS

PANEL = f"""{P}, f AS (SELECT student_key AS k, stratum, pre_score, post_score, cluster_id, CASE WHEN student_key % 101 = 0 THEN 'S0' ELSE 'S' || student_key END AS student_key, CASE WHEN student_key % 97 = 0 THEN 'T2' ELSE 'T1' END AS term,
    CASE WHEN student_key % 89 = 0 THEN 1 - treated ELSE treated END AS treated, student_key % 83 = 0 AS odd,
    CASE WHEN student_key % 79 = 0 THEN NULL WHEN student_key % 73 = 0 THEN TIMESTAMPTZ '2024-03-01 00:00:00+00' ELSE TIMESTAMPTZ '2024-01-10 00:00:00+00' END AS base,
    CASE WHEN student_key % 71 = 0 THEN TIMESTAMPTZ '2024-02-02 00:00:00+00' ELSE TIMESTAMPTZ '2024-01-09 00:00:00+00' END AS cov,
    CASE WHEN student_key % 59 = 0 THEN TIMESTAMPTZ '2024-09-01 00:00:00+00' ELSE TIMESTAMPTZ '2024-04-01 00:00:00+00' END AS follow FROM raw_panel),
  h AS (SELECT *, base IS NULL AS unverified, CASE WHEN treated = 1 THEN k % 67 <> 0 END AS on_time, treated = 0 AND k % 61 = 0 AS touched FROM f)"""
ZERO = "TIMESTAMPTZ '2024-02-01 00:00:00+00'"
BLOCKS = {
    "TERM_MISMATCH": "term <> 'T1'", "COVARIATE_SCHEMA_MISMATCH": "odd", "MISSING_OUTCOME_NO_STRATEGY": "pre_score IS NULL OR post_score IS NULL", "OUTCOME_OUT_OF_RANGE": "pre_score NOT BETWEEN 0 AND 300000 OR post_score NOT BETWEEN 0 AND 300000",
    "TIME_ZERO_UNVERIFIED": "unverified", "BASELINE_NOT_PRETREATMENT": f"NOT unverified AND base >= {ZERO}", "POST_TREATMENT_COVARIATE": f"NOT unverified AND cov >= {ZERO}",
    "FOLLOWUP_OUTSIDE_WINDOW": "NOT unverified AND follow NOT BETWEEN TIMESTAMPTZ '2024-03-15 00:00:00+00' AND TIMESTAMPTZ '2024-06-30 00:00:00+00'", "TREATMENT_START_MISMATCH": "treated = 1 AND NOT on_time", "CONTROL_CONTAMINATION": "touched",
}
OWN = ("PROTOCOL_NOT_FROZEN", "DESIGN_EVIDENCE_MISSING", "ASSUMPTION_UNDOCUMENTED", "NO_INDEPENDENT_OUTCOME", "OUTCOME_NOT_COMPARABLE", "UNSUPPORTED_OUTCOME_DIRECTION")
TASK = f"{T}, task AS (SELECT turn_id AS k, turn_id, term, level, 'turn ' || turn_id || ' asks why' AS question FROM turns)"
ROSTER = f"""roster AS (SELECT DISTINCT term, student_key FROM turns UNION SELECT t.term, c_custkey FROM (SELECT DISTINCT term FROM turns) t, customer WHERE c_custkey % 5 = 0)"""


def bounds(weights, concave: bool) -> tuple[str, str, str]:
    """Score, lower and upper bound."""
    whole = sum(weights)
    part = {i: f"100 * (CAST({w!r} AS DOUBLE) / CAST({whole!r} AS DOUBLE)) * {g(i, concave)}" for i, w in zip(INDICATORS, weights, strict=True)}
    low = "least(100.0, " + " + ".join(f"coalesce({p}, 0)" for p in part.values()) + ")"
    gap = " + ".join(f"CASE WHEN {i} IS NULL THEN 100 * {w!r}::DOUBLE / {whole!r} ELSE 0 END" for i, w in zip(INDICATORS, weights, strict=True))
    some = " OR ".join(f"{i} IS NULL" for i in INDICATORS)
    return f"CASE WHEN NOT ({some}) THEN {low} END", f"CASE WHEN {some} THEN {low} END", f"CASE WHEN {some} THEN least(100.0, {low} + {gap}) END"


def export_sql() -> str:
    rows = " UNION ALL ".join("SELECT *, '{}' AS scenario, {} AS aiv, {} AS conditional_lower, {} AS conditional_upper FROM m".format(n, *bounds(w, c)) for n, w, c in FOUR)
    none = ", ".join(f"CASE WHEN {i} IS NULL THEN 'missing_{i}' END" for i in INDICATORS)
    return f"""WITH {ST}, {ROSTER}, n9 AS (SELECT term, student_key, candidate_turns, labeled_turns, {", ".join(f"round({i}, 9) AS {i}" for i in INDICATORS)}, ctq IS NULL AS no_ends, unknown_agent, TRUE AS seen FROM students),
      m AS (SELECT r.term, r.student_key, n9.* EXCLUDE (term, student_key), count(*) OVER (PARTITION BY r.term) AS metric_population, count(*) OVER (PARTITION BY r.term) AS source_population,
              count(*) FILTER (hot IS NOT NULL AND ctq IS NOT NULL AND dhi IS NOT NULL AND mab IS NOT NULL) OVER (PARTITION BY r.term) AS comparison_population FROM roster r LEFT JOIN n9 USING (term, student_key)),
      x AS ({rows}), y AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY term, scenario, aiv) - 1) / 2.0::DOUBLE AS rank, rank() OVER w <= ceil(count(*) OVER (PARTITION BY term, scenario) / 4.0) AS top_quartile FROM x WHERE aiv IS NOT NULL WINDOW w AS (PARTITION BY term, scenario ORDER BY aiv DESC)
        UNION ALL SELECT *, NULL, NULL FROM x WHERE aiv IS NULL)
      SELECT term, student_key, scenario, {", ".join(f"round({i}, 6) AS {i}" for i in INDICATORS)}, round(aiv, 6) AS aiv, round(conditional_lower, 6) AS conditional_lower, round(conditional_upper, 6) AS conditional_upper, candidate_turns::BIGINT AS candidate_turns, labeled_turns::BIGINT AS labeled_turns,
        round(labeled_turns / candidate_turns::DOUBLE, 6) AS label_coverage, rank, top_quartile, comparison_population, metric_population, source_population,
        concat_ws(';', CASE WHEN seen IS NULL THEN 'no_metric_row_for_roster_member' END, CASE WHEN labeled_turns = 0 THEN 'no_valid_labels' END, CASE WHEN seen AND no_ends THEN 'no_valid_endpoints' END, CASE WHEN unknown_agent THEN 'unknown_agent_identity' END, {none}) AS missing_reasons FROM y"""


def first_of(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {wrong} THEN '{code}'" for code, wrong in rules) + " END"


FORM = f"""{TASK}, f0 AS (SELECT k, k + 2 AS row_number, turn_id, CASE WHEN k % 13 = 0 THEN '' WHEN k % 13 = 1 THEN '9' WHEN k % 13 = 2 THEN 'NA' ELSE (1 + k % 6)::VARCHAR END AS lab FROM task),
  f1 AS (SELECT * FROM f0 UNION ALL SELECT k, row_number + 1000000000, turn_id, lab FROM f0 WHERE k % 37 = 0 UNION ALL SELECT k, row_number + 2000000000, -turn_id - 1, lab FROM f0 WHERE k % 41 = 0),
  f2 AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY row_number) AS nth, lab = 'NA' AS na FROM f1)"""
NONE = "(k % 11 = 1)"
WHATIFS = {"low_human_cost": {"review": "0.5"}, "medium_human_cost": {}, "high_human_cost": {"review": "2"}, "higher_error": {"six": "d - d // 2"}, "higher_na": {"missing": 4}, "smaller_rare_stratum": {"rare": "greatest(1, frame // 2)"}, "larger_rare_stratum": {"rare": "2 * frame"}}
LEGACY = (("primary", (0.5, 0.3, 0.2)), ("balanced", (1, 1, 1)), ("w1_x0.9", (0.45, 0.3, 0.2)), ("w1_x1.1", (0.55, 0.3, 0.2)), ("w2_x0.9", (0.5, 0.27, 0.2)), ("w2_x1.1", (0.5, 0.33, 0.2)), ("w3_x0.9", (0.5, 0.3, 0.18)), ("w3_x1.1", (0.5, 0.3, 0.22)))
BEST = "SELECT na || ',' || nb AS n, cost::DOUBLE AS cost, round(lower_six, 8) AS lower_six, round(lower_three, 8) AS lower_three FROM good WHERE lower_six >= 0.6 AND lower_three >= 0.7 ORDER BY good.cost, good.lower_six DESC, good.lower_three DESC, na, nb LIMIT 1"


def normal(who: str) -> str:
    u, v = (U(S, f"'{x}'", "simulation", "cluster_id", *([who] if who else [])) for x in "uv")
    return f"sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v})"


WHOLE = f"{T}, whole AS (SELECT * FROM turns WHERE record_id IN (SELECT record_id FROM turns GROUP BY 1 HAVING count(*) >= 2 AND count(*) = count(level)))"


def noisy(source: str, dr: str, key: str, tag: str) -> str:
    """Labels of ``source`` in every round, moved by the kernel of what ``dr`` drew."""
    counts = ", ".join(f"sum(CASE WHEN level = {k} THEN times ELSE 0 END) + 0.5" for k in range(1, 7))
    return f"""SELECT s.* EXCLUDE (level), replicate, CASE WHEN u < 0.8 THEN level WHEN level > 1 AND (u < 0.8 + 0.2 * below / (below + above) OR level = 6) THEN level - 1 ELSE level + 1 END AS level FROM (
      SELECT s.*, replicate, {U(S, f"'{tag}'", 'replicate', f's.{key}')} AS u, CASE WHEN level > 1 THEN n[level - 1] ELSE 0 END AS below, CASE WHEN level < 6 THEN n[level + 1] ELSE 0 END AS above
      FROM {source} s JOIN (SELECT d.term, replicate, [{counts}]::DOUBLE[] AS n FROM {dr} d JOIN {source} q ON q.term = d.term AND q.student_key = d.unit GROUP BY d.term, replicate) k USING (term)) s"""


ORACLES = {
    "legacy_metrics": f"""WITH {WHOLE}, c AS (SELECT term, student_key, record_id, arg_max(level, turn_index) - arg_min(level, turn_index) AS rise FROM whole GROUP BY ALL), q AS (SELECT term, student_key, avg(0.5 + rise / 10.0::DOUBLE) AS ctq FROM c GROUP BY ALL)
      SELECT term, student_key, count(*) AS n, round(avg(level), 8) AS abl, round(100 * avg((level >= 4)::INT), 8) AS hot, round(any_value(ctq), 8) AS ctq FROM whole JOIN q USING (term, student_key) GROUP BY ALL""",
    "legacy_rounds": f"""WITH {WHOLE}, rec AS (SELECT term, student_key, turn_id AS record_id, level FROM turns WHERE level IS NOT NULL), u1 AS (SELECT DISTINCT term, student_key AS unit FROM rec), u2 AS (SELECT DISTINCT term, student_key AS unit FROM whole),
      d1 AS ({drawn('u1', 'term', 2045, 50)}), d2 AS ({drawn('u2', 'term', 2046, 50)}), n1 AS ({noisy('rec', 'd1', 'record_id', 'record')}), n2 AS ({noisy('whole', 'd2', 'turn_id', 'turn')}),
      m1 AS (SELECT term, replicate, student_key, avg(level) AS abl, 100 * avg((level >= 4)::INT) AS hot FROM n1 GROUP BY ALL), c2 AS (SELECT term, replicate, student_key, record_id, 0.5 + (arg_max(level, turn_index) - arg_min(level, turn_index)) / 10.0::DOUBLE AS c FROM n2 GROUP BY ALL),
      m2 AS (SELECT term, replicate, student_key, avg(c) AS ctq FROM c2 GROUP BY ALL),
      a1 AS (SELECT m1.term, m1.replicate, sum(abl * times) / sum(times) AS abl, sum(hot * times) / sum(times) AS hot FROM m1 JOIN d1 ON d1.term = m1.term AND d1.replicate = m1.replicate AND d1.unit = m1.student_key GROUP BY ALL),
      a2 AS (SELECT m2.term, m2.replicate, sum(ctq * times) / sum(times) AS ctq FROM m2 JOIN d2 ON d2.term = m2.term AND d2.replicate = m2.replicate AND d2.unit = m2.student_key GROUP BY ALL),
      b AS (SELECT term, student_key, round(avg(level), 9) AS abl FROM rec GROUP BY ALL), tb AS (SELECT term, student_key FROM b QUALIFY row_number() OVER (PARTITION BY term ORDER BY abl DESC, sha256(student_key::VARCHAR)) <= ceil(count(*) OVER (PARTITION BY term) * 0.25)),
      tz AS (SELECT term, replicate, student_key FROM m1 QUALIFY row_number() OVER (PARTITION BY term, replicate ORDER BY round(abl, 9) DESC, sha256(student_key::VARCHAR)) <= ceil(count(*) OVER (PARTITION BY term, replicate) * 0.25)),
      st AS (SELECT term, replicate, count(tb.student_key) / count(*)::DOUBLE AS s FROM tz LEFT JOIN tb USING (term, student_key) GROUP BY ALL), ar AS (SELECT * FROM a1 JOIN a2 USING (term, replicate) JOIN st USING (term, replicate)), fl AS (SELECT term, 1 - avg(s) AS flip FROM ar GROUP BY 1),
      lg AS (SELECT term, 'abl' AS metric, list(abl ORDER BY abl) AS v FROM ar GROUP BY 1 UNION ALL SELECT term, 'hot', list(hot ORDER BY hot) FROM ar GROUP BY 1 UNION ALL SELECT term, 'ctq', list(ctq ORDER BY ctq) FROM ar GROUP BY 1)
      SELECT term, metric, round(v[floor(0.025 * (len(v) - 1))::INT + 1], 6) AS low, round(v[floor(0.975 * (len(v) - 1))::INT + 1], 6) AS high, round(flip, 6) AS flip_rate FROM lg JOIN fl USING (term)""",
    "sampled_students": f"WITH {T} SELECT 'u-c' || turn_id AS conversation_id, 'u-r' || turn_id AS qid, student_key FROM turns WHERE turn_id % 5 = 0",
    "mapping_counts": f"WITH {T}, x AS (SELECT *, (SELECT count(DISTINCT o.term) FROM turns o WHERE o.student_key = turns.student_key) > 1 AS two FROM turns) SELECT term, count(*) AS records, count(DISTINCT student_key) AS students, count(DISTINCT CASE WHEN two THEN student_key END) AS shared FROM x GROUP BY 1",
    "panel_blockers": f"""WITH {PANEL}, c AS ({" UNION ALL ".join(f"SELECT '{k}' AS code, count(*) AS n FROM h WHERE {v}" for k, v in BLOCKS.items())}
      UNION ALL SELECT 'MIXED_TREATMENT_CLUSTER', count(*) FROM (SELECT cluster_id FROM h GROUP BY 1 HAVING count(DISTINCT treated) > 1) UNION ALL SELECT 'NO_COMMON_SUPPORT', count(*) FROM (SELECT stratum FROM h GROUP BY 1 HAVING count(DISTINCT treated) < 2)
      UNION ALL SELECT unnest({list(OWN)}), 1) SELECT code, n FROM c WHERE n > 0""",
    "panel_import_faults": f"""WITH {PANEL}, n AS (SELECT *, length(stratum) + 7 * CASE WHEN k % 101 = 0 THEN 0 ELSE k END AS n, count(*) OVER (PARTITION BY student_key) AS many FROM h),
      c AS (SELECT CASE WHEN n % 31 = 0 THEN 'INVALID_PANEL_ID' WHEN many > 1 THEN 'DUPLICATE_STUDENT' WHEN n % 29 = 0 THEN 'INVALID_TREATMENT' WHEN n % 23 = 0 OR n % 19 = 0 THEN 'CATEGORICAL_COVARIATES_REQUIRED' WHEN n % 17 = 0 THEN 'INVALID_NUMBER' WHEN n % 13 = 0 THEN 'TIME_WITHOUT_OFFSET' END AS code FROM n)
      SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1""",
    "json_faults": """SELECT event_id, code FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'DUPLICATE_JSON_KEY' WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'NON_FINITE_JSON_NUMBER'
      WHEN event_id % 19 = 0 THEN 'INVALID_JSON' WHEN event_id % 23 = 0 THEN 'NOT_AN_OBJECT' END AS code FROM events) WHERE code IS NOT NULL""",
    "panel_warnings": f"""WITH ov AS ({OTHERS["panel_overlap"]}), ba AS ({OTHERS["panel_balance"]}), c AS (
      SELECT 'NO_COMMON_SUPPORT' AS code, count(*) FILTER (unsupported > 0) AS n FROM ov UNION ALL SELECT 'EXTREME_PROPENSITY', count(*) FILTER (propensity_min < 0.05 OR propensity_max > 0.95) FROM ov
      UNION ALL SELECT 'CONCENTRATED_CONTROL_CLUSTER', count(*) FILTER (max_control_cluster_share > 0.2) FROM ov UNION ALL SELECT 'BASELINE_IMBALANCE', count(*) FILTER (abs(smd_before) > 0.1) FROM ba
      UNION ALL SELECT 'RESIDUAL_IMBALANCE', count(*) FILTER (abs(smd_after) > 0.1) FROM ba UNION ALL SELECT 'SMD_UNDEFINED', count(*) FILTER (smd_before IS NULL) FROM ba) SELECT code, n FROM c WHERE n > 0""",
    "did_subgroups": f"""WITH {P}, cs AS (SELECT stratum, treated, cluster_id AS unit, count(*) AS n, sum(post_score - pre_score) AS d FROM panel GROUP BY ALL),
      us AS (SELECT stratum || '#' || treated AS grp, * FROM (SELECT DISTINCT stratum, treated, unit FROM cs)),
      dr AS (SELECT stratum, treated, replicate, units[floor({U(S, 'stratum', 'treated', 'replicate', 'slot')} * n)::INT + 1] AS unit, count(*) AS times FROM (SELECT stratum, treated, count(*) AS n, list(unit ORDER BY unit) AS units FROM us GROUP BY ALL), range(100) r(replicate), LATERAL (SELECT unnest(range(n)) AS slot) GROUP BY ALL),
      rs AS (SELECT stratum, replicate, coalesce(sum(n * times) FILTER (treated = 1), 0) AS n1, coalesce(sum(n * times) FILTER (treated = 0), 0) AS n0, sum(d * times) FILTER (treated = 1) AS d1, sum(d * times) FILTER (treated = 0) AS d0 FROM dr JOIN cs USING (stratum, treated, unit) GROUP BY ALL),
      es AS (SELECT stratum, CASE WHEN n1 > 0 AND n0 > 0 THEN d1 / n1 - d0 / n0 END AS e FROM rs),
      sp AS (SELECT stratum, count(e) AS valid, quantile_cont(e, 0.025) AS low, quantile_cont(e, 0.975) AS high, max(e) - min(e) AS span FROM es GROUP BY 1),
      pt AS (SELECT stratum, sum(n)::BIGINT AS students, count(*) FILTER (treated = 1) AS k1, count(*) FILTER (treated = 0) AS k0, sum(d) FILTER (treated = 1) / sum(n) FILTER (treated = 1) - sum(d) FILTER (treated = 0) / sum(n) FILTER (treated = 0) AS e FROM cs GROUP BY 1),
      y AS (SELECT *, CASE WHEN least(k1, k0) < 10 THEN 'insufficient_clusters' WHEN coalesce(valid, 0) < 100 THEN 'bootstrap_support_failure' WHEN span <= 1e-12 THEN 'degenerate_bootstrap' ELSE 'approximate_cluster_bootstrap' END AS status FROM pt LEFT JOIN sp USING (stratum))
      SELECT stratum, students, round(e, 4) AS estimate, round(CASE WHEN status LIKE 'approx%' THEN low END, 4) AS ci_low, round(CASE WHEN status LIKE 'approx%' THEN high END, 4) AS ci_high, status FROM y""",
    "did_threshold": f"""WITH {REPS.replace(f'range({DID_REPS}) r(replicate)', 'range(100) r(replicate)')}, z AS (SELECT max(f.estimate) AS e, quantile_cont(r.estimate, 0.025) AS lo, quantile_cont(r.estimate, 0.975) AS hi FROM reps r, fit f HAVING count(r.estimate) = 100)
      SELECT bias, round(e - bias, 4) AS low, round(e + bias, 4) AS high, round(lo - bias, 4) AS ci_low, round(hi + bias, 4) AS ci_high, lo > 10 AS threshold_exceeded FROM z, (SELECT unnest([0.0, 1000.0]::DOUBLE[]) AS bias)""",
    "student_export": export_sql(),
    "roster_gaps": f"""WITH {T}, {ROSTER}, o0 AS (SELECT student_key AS k, CASE WHEN student_key % 17 = 0 THEN 'never' ELSE term END AS term, CASE WHEN student_key % 13 = 0 THEN '_' ELSE '' END || student_key AS student_key FROM roster WHERE student_key % 19 <> 0),
      o AS (SELECT term, student_key, count(*) + count(*) FILTER (k % 23 = 0) AS n FROM o0 GROUP BY ALL), c AS (SELECT term, student_key, {first_of([('INVALID_ROSTER_TERM', "term = 'never'"), ('INVALID_ROSTER_ID', "student_key LIKE '\\_%' ESCAPE '\\'"), ('DUPLICATE_ROSTER_STUDENT', 'n > 1')])} AS code FROM o)
      SELECT * FROM c WHERE code IS NOT NULL UNION ALL SELECT DISTINCT term, student_key::VARCHAR, 'ROSTER_MISSING_METRIC_STUDENT' FROM turns WHERE student_key % 19 = 0 OR student_key % 17 = 0 OR student_key % 13 = 0""",
    "term_rollup": f"""WITH {ST}, s2 AS (SELECT *, CASE WHEN hot IS NOT NULL AND ctq IS NOT NULL AND dhi IS NOT NULL AND mab IS NOT NULL THEN least(100.0, {score(PRIMARY)}) END AS aiv FROM students),
      r AS (SELECT term, count(*) AS students, count(*) FILTER (labeled_turns > 0) AS with_labels, count(aiv) AS with_score, sum(candidate_turns)::BIGINT AS turns, sum(labeled_turns)::BIGINT AS labelled, round(avg(aiv), 6) AS mean_score, count(*) AS source_population FROM s2 GROUP BY 1)
      SELECT * FROM r UNION ALL SELECT '1999-01a', 0, 0, 0, 0, 0, NULL, 7""",
    "legacy_scheme_means": f"""WITH {ST} SELECT term, scenario, count(v) AS students, round(avg(v), 6) AS mean_aiv FROM ({" UNION ALL ".join(f"SELECT term, '{n}' AS scenario, CASE WHEN ctq_legacy IS NOT NULL AND hot IS NOT NULL THEN 100 * ({w[0]!r}::DOUBLE * hot + {w[1]!r}::DOUBLE * ctq_legacy + {w[2]!r}::DOUBLE * dhi_legacy) / {sum(w)!r} END AS v FROM students" for n, w in LEGACY)}) GROUP BY ALL""",
    "stability_bounds": f"""WITH {ST}, x AS (SELECT term, 0.5 * abs(hot - 0.5) + 0.3 * abs(ctq - 0.5) + 0.15 * abs(dhi - 0.5) + 0.05 * abs(mab - 0.5) AS e FROM students)
      SELECT term, round(100 * max(e), 6) AS linear, round(100 * 2.0::DOUBLE / (1 - exp(-2.0::DOUBLE)) * max(e), 6) AS concave, count(*) AS students, round(50 * (abs(0.5 - 0.3) + abs(0.3 - 0.3) + abs(0.15 - 0.3) + abs(0.05 - 0.1))::DOUBLE, 6) AS weights FROM x GROUP BY 1""",
    "annotation_faults": f"""WITH {FORM}, c AS (SELECT row_number, {first_of([('UNKNOWN_OR_REPEATED_TURN', 'turn_id < 0 OR nth > 1'), ('LABEL_BLANK', "lab = ''"), ('INVALID_LABEL', "lab = '9'"), ('REVIEWER_OR_DATE_MISSING', 'k % 17 = 0'), ('INVALID_REVIEW_DATE', 'k % 19 = 0'), ('INVALID_REVIEW_FLAGS', 'k % 23 = 0'), ('INVALID_CONFIDENCE', 'k % 29 = 0'), ('INSUFFICIENT_EVIDENCE_MISMATCH', 'na AND k % 5 = 0'), ('EVIDENCE_NOT_VERBATIM', 'NOT na AND k % 31 = 0'), ('NA_REASON_REQUIRED', 'na AND k % 7 = 0')])} AS code FROM f2) SELECT * FROM c WHERE code IS NOT NULL""",
    "prediction_faults": f"""WITH {TASK}, p AS (SELECT * FROM task WHERE k % 47 <> 0), q AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE k % 43 = 0), lab AS (SELECT *, CASE WHEN k % 11 = 0 THEN 9 WHEN {NONE} THEN NULL ELSE k % 6 + 1 END AS l FROM q),
      c AS (SELECT turn_id, {first_of([('INVALID_LABEL', 'l = 9'), ('INSUFFICIENT_EVIDENCE_MISMATCH', f'(l IS NULL) <> ({NONE} AND k % 2 <> 0)'), ('EVIDENCE_NOT_VERBATIM', 'l IS NOT NULL AND k % 31 = 0'), ('REASON_REQUIRED', 'k % 29 = 0'), ('INVALID_OUTSOURCING', 'k % 23 = 0'), ('INVALID_CONFIDENCE', 'k % 19 = 0')])} AS code FROM lab)
      SELECT * FROM c WHERE code IS NOT NULL UNION ALL SELECT turn_id, 'PREDICTION_ID_SET_MISMATCH' FROM task WHERE k % 47 = 0 OR k % 43 = 0""",
    "review_labels": f"WITH {TASK} SELECT turn_id, CASE WHEN k % 4 <> 0 THEN (k % 6 + 1)::INT END AS label, CASE WHEN k % 5 = 0 THEN 'uncertain' ELSE 'no' END AS outsourcing FROM task WHERE k % 3 = 0",
    "label_faults": f"""WITH {TASK}, l AS (SELECT *, CASE WHEN k % 5 = 0 THEN 7 WHEN k % 3 <> 0 THEN k % 6 + 1 END AS lab, CASE WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN 'never' ELSE 'asks' END AS e FROM task),
      c AS (SELECT turn_id, {first_of([('INVALID_LABEL', 'lab = 7'), ('LABEL_AND_INSUFFICIENT_DISAGREE', '(lab IS NULL) <> (k % 6 = 0)'), ('EVIDENCE_MISSING', "lab IS NOT NULL AND e = ''"), ('EVIDENCE_NOT_VERBATIM', "lab IS NOT NULL AND e = 'never'")])} AS code FROM l) SELECT * FROM c WHERE code IS NOT NULL""",
    "gold_overlap": f"WITH {T} SELECT turn_id, 2 AS n FROM turns WHERE turn_id % 21 = 0",
    "gold_pairs": f"WITH {TASK} SELECT turn_id, level AS gold, (k % 6 + 1)::INT AS prediction, (1 + k % 4)::DOUBLE AS weight FROM task WHERE level IS NOT NULL AND (k % 2 = 0 OR k % 3 = 0) AND k % 5 <> 0",
    "accepted_records": f"WITH {PARSED} SELECT conv_id AS record_id, n_q::INT AS turns FROM parsed WHERE status = 'format_ok_pending_review'",
    "request_projection": f"""WITH {TASK}, b AS (SELECT turn_id, 'rubric-1' || chr(0) || 'model-a' || chr(0) || 'Label this.' || chr(0) || question || chr(0) AS body FROM task WHERE {U(S, "'pool'", 'turn_id')} < 0.15)
      SELECT turn_id, sha256(body) AS request_hash, (((strlen(body) * 2 + 800)::DECIMAL(20,6) * 0.000001::DECIMAL(10,6))::DECIMAL(38,12))::VARCHAR AS reserved FROM b""",
    "set_states": f"""WITH {T}, s AS (SELECT turn_id, turn_id % 7 <> 0 AS ok, turn_id % 5 = 0 AS failed FROM turns) SELECT turn_id, CASE WHEN ok THEN 'both' ELSE 'neither' END AS state FROM s WHERE ok = failed UNION ALL SELECT -turn_id - 1, 'unknown' FROM s WHERE turn_id % 11 = 0""",
    "probe_status": f"""WITH {T}, v AS (SELECT turn_id // 2 AS pair, turn_id % 2 AS side, CASE WHEN turn_id % 9 <> 0 THEN (turn_id % 3 + 1)::INT END AS l FROM turns), p AS (SELECT pair, max(l) FILTER (side = 0) AS base, max(l) FILTER (side = 1) AS attack FROM v GROUP BY 1)
      SELECT pair, base, attack, CASE WHEN base IS NULL OR attack IS NULL THEN 'NA' WHEN base = attack THEN 'PASS' ELSE 'FAIL' END AS status, attack - base AS label_delta FROM p""",
    "source_students": f"""WITH {T} SELECT turn_id AS qid, CASE WHEN turn_id % 4 > 0 AND turn_id % 9 = 1 THEN NULL WHEN turn_id % 4 > 0 THEN student_key WHEN turn_id % 9 = 1 THEN student_key + 1 END AS source_student,
      CASE WHEN turn_id % 4 = 0 AND turn_id % 9 <> 1 THEN 'unmapped_question' WHEN turn_id % 4 > 0 AND turn_id % 9 = 1 THEN 'ambiguous_question' END AS reason FROM turns WHERE turn_id % 3 = 1""",
    "identity_values": "SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || '.50' WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'A-' || c_custkey ELSE c_custkey::VARCHAR END AS id FROM customer",
    "covariate_strata": f"""WITH {P}, c AS (SELECT p.*, c_mktsegment AS segment, (c_nationkey % 5)::VARCHAR AS region, CASE WHEN c_custkey % 13 <> 0 THEN floor(c_acctbal / 4000)::BIGINT::VARCHAR END AS balance FROM panel p JOIN customer ON c_custkey = student_key),
      d AS (SELECT *, dense_rank() OVER (ORDER BY segment, region, balance NULLS FIRST) AS no, post_score - pre_score AS d FROM c)
      SELECT 'stratum_' || no AS stratum, segment, region, balance, count(*) FILTER (treated = 1) AS n1, count(*) FILTER (treated = 0) AS n0, round(avg(d) FILTER (treated = 1), 4) AS treated_change, round(avg(d) FILTER (treated = 0), 4) AS control_change FROM d GROUP BY ALL""",
    "score_percentiles": f"""WITH {ST}, v AS (SELECT term, 'level' AS what, level::DOUBLE AS v FROM turns WHERE level IS NOT NULL UNION ALL SELECT term, 'gap', turn_id * 37 % 1009 / 8.0::DOUBLE FROM turns UNION ALL SELECT term, 'score', v FROM (SELECT term, round({score(PRIMARY, False)}, 9) AS v FROM students) WHERE v IS NOT NULL),
      s AS (SELECT term, what, list_sort(list(v)) AS l, count(*) AS n FROM v GROUP BY ALL), q AS (SELECT *, unnest([0.0, 0.025, 0.25, 0.5, 0.975, 1.0]::DOUBLE[]) AS share FROM s)
      SELECT term, what, share, n, round(l[floor(share * (n - 1))::BIGINT + 1] + (share * (n - 1) - floor(share * (n - 1))) * (l[ceil(share * (n - 1))::BIGINT + 1] - l[floor(share * (n - 1))::BIGINT + 1]), 8) AS interpolated, round(l[floor(share * (n - 1))::BIGINT + 1], 8) AS "order" FROM q""",
    "lineage_audit": """WITH RECURSIVE k AS (SELECT DISTINCT event_id AS k FROM events),
      i AS (SELECT k AS a, k // 2 AS b FROM k WHERE k > 0 UNION SELECT k, k // 3 FROM k WHERE k > 2 AND k % 5 = 0 UNION SELECT k, -k - 1 FROM k WHERE k > 0 AND k % 89 = 0
            UNION SELECT k, CASE WHEN k % 200 = 2 THEN k - 2 ELSE k + 1 END FROM k WHERE k >= 600 AND k % 200 < 3),
      r AS (SELECT a, b FROM i UNION SELECT r.a, i.b FROM r JOIN i ON r.b = i.a),
      c AS (SELECT DISTINCT a FROM r WHERE a = b),
      s AS (SELECT r.a, count(*) FILTER (k.k IS NOT NULL AND r.a <> r.b) AS up, count(*) FILTER (k.k IS NULL) AS lost, count(*) FILTER (r.a = r.b) AS own, count(c.a) AS loops FROM r LEFT JOIN k ON k.k = r.b LEFT JOIN c ON c.a = r.b GROUP BY 1)
      SELECT k AS artifact, coalesce(up, 0) AS n_upstream, coalesce(lost, 0) AS missing, coalesce(own, 0) > 0 AS cyclic, coalesce(lost, 0) = 0 AND coalesce(loops, 0) = 0 AS verified FROM k LEFT JOIN s ON s.a = k""",
    "simulated_effects": f"""WITH {P}, d AS (SELECT simulation, stratum, treated, post_score + treated * 5000.0::DOUBLE + 2000 * {normal('')} + 500 * {normal('student_key')} - pre_score AS d FROM panel, range(20) s(simulation)),
      x AS (SELECT simulation, stratum, count(*) FILTER (treated = 1) AS n1, sum(d) FILTER (treated = 1) AS d1, sum(d) FILTER (treated = 0) AS d0, avg(d) FILTER (treated = 1) - avg(d) FILTER (treated = 0) AS gap, count(*) FILTER (treated = 0) AS n0 FROM d GROUP BY ALL)
      SELECT simulation, round(sum(n1 * gap) / sum(n1), 4) AS estimate, round(sum(d1) / sum(n1) - sum(d0) / sum(n0), 4) AS unadjusted FROM x GROUP BY 1""",
    "allocation_whatifs": " UNION ALL ".join(f"SELECT '{n}' AS scenario, * FROM ({plan_sql(BEST, budget=None, **k)})" for n, k in WHATIFS.items()),
    "roots_of_noise": f"WITH {ST} SELECT term, student_key % 400 AS root, count(*) AS students FROM students WHERE labeled_turns > 0 GROUP BY ALL",
    "question_build": f"""SELECT conv_id::VARCHAR AS record_id, conv_id % 10 AS student_key, text_hash, CASE conv_id WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS priority FROM ({OTHERS["question_texts"]}) WHERE text_hash IS NOT NULL AND conv_id % 10 < 7""",
}
