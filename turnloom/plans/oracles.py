"""The queries in DuckDB's SQL, written apart from the Spark code."""

from __future__ import annotations

from turnloom.plans import adapters as D

SEED = 2045
#: Everything below is written out again, not taken from the code under test.
INDICATORS = ("hot", "ctq", "dhi", "mab")
UTILITIES, REFERENCE = (0, 0.2, 0.4, 0.6, 0.8, 1), (0.1, 0.2, 0.25, 0.25, 0.15, 0.05)
SHORTAGE, EXCESS = (0.5, 0.5, 1, 1.5, 2, 2), (2, 1.5, 1, 1, 0.5, 0.5)
AGENTS = 5
PRIMARY, W = (0.5, 0.3, 0.15, 0.05), (0.5, 0.3, 0.2)
MASSES, NREP = (0, 0.1, 0.2, 0.3), 100
DID_REPS, MEAN_REPS = 500, 1000
#: name, weights before they are made to sum to one, whether concave
FOUR = (("primary", PRIMARY, False), ("high_order_linear", (0.5, 0.3, 0.15, 0.05), False), ("balanced_linear", (0.3, 0.3, 0.3, 0.1), False), ("diminishing_returns", (0.5, 0.3, 0.15, 0.05), True))
EIGHT = (
    ("w1_x0.9", (0.45, 0.3, 0.15, 0.05), False), ("w1_x1.1", (0.55, 0.3, 0.15, 0.05), False), ("w2_x0.9", (0.5, 0.27, 0.15, 0.05), False), ("w2_x1.1", (0.5, 0.33, 0.15, 0.05), False),
    ("w3_x0.9", (0.5, 0.3, 0.135, 0.05), False), ("w3_x1.1", (0.5, 0.3, 0.165, 0.05), False), ("w4_x0.9", (0.5, 0.3, 0.15, 0.045), False), ("w4_x1.1", (0.5, 0.3, 0.15, 0.055), False),
)

T, P, X = D.TURNS_SQL, D.PANEL_SQL, D.TRANSCRIPTS_SQL
U = lambda *parts: f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::UBIGINT)::DOUBLE / 4503599627370496.0)"
S = f"'{SEED}'"


def vec(values) -> str:
    return "([" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[])"


def dhi_sym(q) -> str:
    gap = " + ".join(f"abs(p{k} - {v!r})" for k, v in enumerate(q, 1))
    return f"least(1.0, greatest(0.0, 1 - ({gap}) / 2 / {1 - min(q)!r}))"


def dhi_asym() -> str:
    """The distance, divided by the largest one: that of some vertex."""
    def gap(share):
        return [f"{a} * greatest({q} - {p}, 0.0) + {b} * greatest({p} - {q}, 0.0)" for q, a, b, p in zip(REFERENCE, SHORTAGE, EXCESS, share, strict=True)]

    worst = max(sum(a * max(q - (k == r), 0) + b * max((k == r) - q, 0) for k, (q, a, b) in enumerate(zip(REFERENCE, SHORTAGE, EXCESS, strict=True))) for r in range(6))
    return f"least(1.0, greatest(0.0, 1 - ({' + '.join(gap([f'p{k}' for k in range(1, 7)]))}) / {worst!r}))"


def g(x: str, concave: bool, rho: float = 1) -> str:
    return f"((1 - exp({-rho} * {x})) / (1 - exp({-rho})))" if concave else x


def score(weights, concave: bool = False) -> str:
    whole = sum(weights)
    return " + ".join(f"100 * (CAST({w!r} AS DOUBLE) / CAST({whole!r} AS DOUBLE)) * {g(i, concave)}" for i, w in zip(INDICATORS, weights, strict=True) if w)


def students(turns: str = "turns", name: str = "students", keys: str = "term, student_key") -> str:
    """CTEs for all indicators from a table of turns; level tests skip nulls."""
    pre = f"_{name}"
    counts = ", ".join(f"count(*) FILTER (level = {k}) AS n{k}" for k in range(1, 7))
    sums = ", ".join(f"sum(n{k}) AS n{k}" for k in range(1, 7))
    total = " + ".join(f"n{k}" for k in range(1, 7))
    shares = ", ".join(f"CASE WHEN labeled_turns > 0 THEN n{k} / labeled_turns::DOUBLE END AS p{k}" for k in range(1, 7))
    return f"""
  {pre}1 AS (SELECT *, count(*) OVER (PARTITION BY {keys}, record_id) AS size FROM {turns}),
  {pre}2 AS (SELECT {keys}, record_id, count(*) AS n, {counts}, max(CASE WHEN turn_index = 1 THEN level END) AS first, max(CASE WHEN turn_index = size THEN level END) AS last FROM {pre}1 GROUP BY ALL),
  {name}_conv AS (SELECT *, CASE WHEN n >= 2 AND first IS NOT NULL AND last IS NOT NULL THEN 0.5 + 0.5 * ({vec(UTILITIES)}[last] - {vec(UTILITIES)}[first]) END AS ctq,
     CASE WHEN n >= 2 AND first IS NOT NULL AND last IS NOT NULL THEN 0.5 + (last - first) / 10.0::DOUBLE END AS ctq_legacy,
     CASE WHEN n >= 2 AND first IS NOT NULL AND last IS NOT NULL THEN (last >= 4)::INT - (first >= 4)::INT END AS hot_change FROM {pre}2),
  {pre}3 AS (SELECT {keys}, sum(n) AS candidate_turns, {sums}, avg(ctq) AS ctq, avg(ctq_legacy) AS ctq_legacy, avg(hot_change) AS hot_change FROM {name}_conv GROUP BY ALL),
  {pre}4 AS (SELECT {keys}, count(DISTINCT agent_id) AS agents, bool_or(agent_id IS NULL OR agent_id = '') AS unknown_agent FROM {turns} GROUP BY ALL),
  {pre}5 AS (SELECT *, {total} AS labeled_turns FROM {pre}3 JOIN {pre}4 USING ({keys})),
  {pre}6 AS (SELECT *, {shares}, (n1 + 2 * n2 + 3 * n3 + 4 * n4 + 5 * n5 + 6 * n6) / nullif(labeled_turns, 0)::DOUBLE AS abl FROM {pre}5),
  {name} AS (SELECT *, p4 + p5 + p6 AS hot, CASE WHEN labeled_turns > 0 THEN {dhi_sym(REFERENCE)} END AS dhi, CASE WHEN labeled_turns > 0 THEN {dhi_asym()} END AS dhi_asymmetric,
     CASE WHEN labeled_turns > 0 THEN 1 - ({" + ".join(f"abs(p{k} - {v!r})" for k, v in enumerate(REFERENCE, 1))}) / 2 END AS dhi_legacy,
     CASE WHEN NOT unknown_agent THEN ln(1 + agents) / ln({1 + AGENTS}) END AS mab, CASE WHEN NOT unknown_agent THEN least(agents, 3) / 3::DOUBLE END AS mab_legacy FROM {pre}6)"""


ST = f"{T}, {students()}"
K = "term, student_key"
R = lambda x, n=8: f"round({x}, {n}) AS {x}"
COHORT = f"{ST}, cohort AS (SELECT {K}, {', '.join(f'round({i}, 9) AS {i}' for i in INDICATORS)} FROM students WHERE hot IS NOT NULL AND ctq IS NOT NULL AND dhi IS NOT NULL AND mab IS NOT NULL)"
RHO = "CASE WHEN sum(a * a) * sum(b * b) > 0 THEN greatest(-1.0, least(1.0, sum(a * b) / sqrt(sum(a * a) * sum(b * b)))) END"


def ranked(source: str, a: str, b: str, keys: str) -> str:
    """Centred average ranks a and b of two columns."""
    one = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0::DOUBLE"
    return f"(SELECT *, a0 - avg(a0) OVER (PARTITION BY {keys}) AS a, b0 - avg(b0) OVER (PARTITION BY {keys}) AS b FROM (SELECT *, {one(a)} AS a0, {one(b)} AS b0 FROM {source}))"


def scored(which=FOUR + EIGHT, source: str = "cohort") -> str:
    return " UNION ALL ".join(f"SELECT {K}, {score(PRIMARY)} AS prime, '{n}' AS scenario, {score(w, c)} AS score FROM {source}" for n, w, c in which)


def change_bound(weights) -> str:
    """Half the distance of two weightings, times 100."""
    return "50 * (" + " + ".join(f"abs({w!r}::DOUBLE / {sum(weights)!r} - {p!r})" for w, p in zip(weights, PRIMARY, strict=True)) + ")"


SCHEMES = " UNION ALL ".join(f"SELECT '{n}' AS scenario, {'CAST(NULL AS DOUBLE)' if c else change_bound(w)} AS weight_change_bound" for n, w, c in FOUR + EIGHT)

PRED = f"""{T}, pred AS (SELECT *, CASE WHEN level IS NOT NULL AND {U(S, "'lost'", 'turn_id')} >= 0.05 THEN
    CASE WHEN u < 0.8 THEN level WHEN level > 1 AND (u < 0.9 OR level = 6) THEN level - 1 ELSE level + 1 END END AS prediction, 1 + turn_index % 3 AS weight
  FROM (SELECT *, {U(S, "'prediction'", 'turn_id')} AS u FROM turns))"""


def agree(source: str, k: int, tiers: int, weight: str) -> str:
    """Agreement by term from all pairs of class marginals."""
    return f"""WITH {PRED}, c AS (SELECT term, (level - 1) // {tiers} AS g, (prediction - 1) // {tiers} AS p, sum({weight})::DOUBLE AS w, count(*) AS n FROM pred WHERE level IS NOT NULL AND prediction IS NOT NULL GROUP BY ALL),
      t AS (SELECT term, sum(w) AS total, sum(n)::BIGINT AS pairs, coalesce(sum(w) FILTER (g = p), 0) / sum(w) AS accuracy, sum(abs(g - p) / {k - 1}.0::DOUBLE * w) / sum(w) AS observed FROM c GROUP BY 1),
      i AS (SELECT term, x AS k FROM t, range({k}) r(x)),
      m AS (SELECT term, k, coalesce((SELECT sum(w) FROM c WHERE c.term = i.term AND g = k), 0) AS r, coalesce((SELECT sum(w) FROM c WHERE c.term = i.term AND p = k), 0) AS s, coalesce((SELECT sum(w) FROM c WHERE c.term = i.term AND p = k AND g = k), 0) AS d FROM i),
      e AS (SELECT a.term, sum(a.r * b.s) FILTER (a.k = b.k) AS chance, sum(abs(a.k - b.k) / {k - 1}.0::DOUBLE * a.r * b.s) AS expected FROM m a JOIN m b USING (term) GROUP BY 1),
      f AS (SELECT term, sum(CASE WHEN r + s > 0 THEN 2 * d / (r + s) ELSE 0 END) / {k} AS macro_f1 FROM m GROUP BY 1)
      SELECT term, pairs, round(accuracy, 8) AS accuracy, round(CASE WHEN chance / total / total < 1 - 1e-12 THEN (accuracy - chance / total / total) / (1 - chance / total / total) END, 8) AS kappa{source}
      FROM t JOIN e USING (term) JOIN f USING (term)"""


DOCS = """q AS (SELECT doc_id, lang, text, replace(lower(regexp_replace(replace(text, 'ß', 'ss'), '[^\\p{L}\\p{N}_]', '', 'g')), 'ς', 'σ') AS t FROM documents),
  comp AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN length(t) >= 36 THEN t ELSE 'own' || doc_id END) AS root FROM q)"""
POOL = f"CASE WHEN {U(S, chr(39) + 'pool' + chr(39), 'root')} < 0.15 THEN 'development' WHEN {U(S, chr(39) + 'pool' + chr(39), 'root')} < 0.80 THEN 'audit' ELSE 'risk' END"
RISK = " + ".join(f"contains(text, '{w}')::INT" for w in ("直接", "答案", "生成", "高级", "创造", "批判"))

STRATA = """s AS (SELECT stratum, count(*) FILTER (treated = 1) AS n1, count(*) FILTER (treated = 0) AS n0, sum(post_score - pre_score) FILTER (treated = 1) AS d1, sum(post_score - pre_score) FILTER (treated = 0) AS d0 FROM panel GROUP BY 1)"""
FIT = f"{P}, {STRATA}, fit AS (SELECT sum(n1 * (d1 / n1 - d0 / n0)) / sum(n1) AS estimate, sum(d1) / sum(n1) - sum(d0) / sum(n0) AS unadjusted FROM s)"
WEIGHTED = f"{P}, {STRATA}, w AS (SELECT p.*, CASE WHEN treated = 1 THEN 1.0 ELSE n1 / n0::DOUBLE END AS w FROM panel p JOIN s USING (stratum))"


def drawn(units: str, by: str, seed: int = SEED, reps: int = DID_REPS) -> str:
    """times by group, replicate and unit; units: a table of (by, unit)."""
    return f"""SELECT {by}, replicate, units[floor({U(f"'{seed}'", by, 'replicate', 'slot')} * n)::INT + 1] AS unit, count(*) AS times
      FROM (SELECT {by}, count(*) AS n, list(unit ORDER BY unit) AS units FROM {units} GROUP BY 1), range({reps}) r(replicate), LATERAL (SELECT unnest(range(n)) AS slot) GROUP BY ALL"""


REPS = f"""{FIT}, cs AS (SELECT treated, cluster_id AS unit, stratum, count(*) AS n, sum(post_score - pre_score) AS d FROM panel GROUP BY ALL),
  us AS (SELECT DISTINCT treated, unit FROM cs), dr AS ({drawn('us', 'treated')}),
  rs AS (SELECT replicate, stratum, coalesce(sum(n * times) FILTER (treated = 1), 0) AS n1, coalesce(sum(n * times) FILTER (treated = 0), 0) AS n0, coalesce(sum(d * times) FILTER (treated = 1), 0) AS d1, coalesce(sum(d * times) FILTER (treated = 0), 0) AS d0 FROM dr JOIN cs USING (treated, unit) GROUP BY ALL),
  reps AS (SELECT replicate, CASE WHEN bool_and((n1 > 0) = (n0 > 0)) THEN sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n1 * (d1 / n1 - d0 / n0) END) / sum(n1) END AS estimate FROM rs GROUP BY 1)"""


def noise(reps: int, seed: int = SEED) -> str:
    arr = ", ".join(f"count(*) FILTER (level = {k}) + 0.5" for k in range(1, 7))
    return f"""{T}, members AS (SELECT DISTINCT student_key, student_key % 400 AS root FROM turns),
  kn AS (SELECT term, [{arr}]::DOUBLE[] AS n FROM turns WHERE level IS NOT NULL GROUP BY 1),
  kk AS (SELECT term, mass, level, CASE WHEN level > 1 THEN n[level - 1] ELSE 0.0 END AS below, CASE WHEN level < 6 THEN n[level + 1] ELSE 0.0 END AS above FROM kn, (SELECT unnest({vec(MASSES)}) AS mass), range(1, 7) l(level)),
  kernel AS (SELECT term, mass, level::INT AS level, 1 - mass AS stay, mass * below / (below + above) AS lower, mass * above / (below + above) AS upper FROM kk),
  ns AS (SELECT t.turn_id, t.term || '#' || m.mass || '#' || r AS term, t.student_key, t.record_id, t.turn_index, t.agent_id, t.level AS old, t.term AS term0, m.mass AS mass, r, {U(f"'{seed}'", "'noise'", 'r', 't.turn_id')} AS u
         FROM turns t, (SELECT unnest({vec(MASSES)}) AS mass) m, range({reps}) x(r)),
  noisy AS (SELECT ns.turn_id, ns.term, student_key, record_id, turn_index, agent_id, CASE WHEN old IS NULL THEN NULL WHEN u < stay THEN old WHEN old > 1 AND (u < stay + lower OR old = 6) THEN old - 1 ELSE old + 1 END AS level
            FROM ns LEFT JOIN kernel k ON k.term = ns.term0 AND k.mass = ns.mass AND k.level = ns.old)"""


METRICS = ("abl", "hot", "ctq", "dhi")
LONG = lambda src, keys: " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {m} AS v FROM {src}" for m in METRICS)


#: The published example, as numbers: frame, least reviews; 6 classes with 9 agreements and one
#: error to the class beside it in its pair, so every three-tier comparison agrees.
BASE = {"a": (48, 4), "b": (12, 2)}


def plan_sql(tail: str, *, rare: str = "frame", review: str = "1", six: str = "d", missing: int = 1, budget: str | None = "90") -> str:
    """All plans for two strata whose frames and pilots come from events; ``tail`` selects
    from them. ``rare``: frame of the second; ``six``: what of a class's agreements ``d`` counts."""
    alpha = 0.05 / 4

    def opt(name, frame):
        radius = f"CASE WHEN n = {frame} THEN 0.0::DOUBLE WHEN n = 0 THEN 1.0 ELSE least(1.0, sqrt(({frame} - n) / (4 * n * ({frame} - 1) * {alpha!r}::DOUBLE))) END"
        low = lambda rate: f"greatest(0.0, {rate} - radius)"
        return f"""SELECT name, size AS frame, n, adjudicated, radius, cost, {low('rate_six')} AS lower_six, {low('rate_three')} AS lower_three, {low('rate_six')} >= 0.4 AND {low('rate_three')} >= 0.5 AND covered >= 0.8 AS fine FROM (
          SELECT name, {frame} AS size, n::INT AS n, rate_six, rate_three, covered, ceil(n::DECIMAL(12,0) * 0.1::DECIMAL(20,12))::INT AS adjudicated, {radius} AS radius,
            {frame} * 0.01::DECIMAL(18,6) + n * {review}::DECIMAL(18,6) + ceil(n::DECIMAL(12,0) * 0.1::DECIMAL(20,12))::INT * 0.5::DECIMAL(18,6) AS cost
          FROM (SELECT *, unnest(range(2, {frame} + 1)) AS n FROM pilot WHERE name = '{name}'))"""

    limit = f" AND cost <= {budget}" if budget else ""
    mean = lambda c: f"a.frame / (a.frame + b.frame)::DOUBLE * a.{c} + b.frame / (a.frame + b.frame)::DOUBLE * b.{c} AS {c}"
    return f"""WITH {PRED}, day AS (SELECT event_type AS name, count(DISTINCT ts::DATE)::INT AS frame FROM events GROUP BY 1),
      cell AS (SELECT agent_id AS name, level, count(*) FILTER (prediction = level) AS d, count(*) FILTER ((prediction - 1) // 2 = (level - 1) // 2) AS t, count(prediction) AS n, count(*) - count(prediction) AS lost FROM pred WHERE level IS NOT NULL GROUP BY ALL),
      pilot AS (SELECT name, frame, sum({six}) / tried AS rate_six, sum(t) / tried AS rate_three, sum(n) / tried AS covered FROM (SELECT *, (sum(n) OVER p + {missing} * sum(lost) OVER p)::DOUBLE AS tried FROM cell WINDOW p AS (PARTITION BY name)) JOIN day USING (name) GROUP BY name, frame, tried),
      a AS ({opt('click', 'frame')}), b AS ({opt('purchase', rare)}), opts AS (SELECT * FROM a UNION ALL SELECT * FROM b),
      plans AS (SELECT a.n AS na, b.n AS nb, a.cost + b.cost AS cost, {mean('lower_six')}, {mean('lower_three')}, a.fine AND b.fine AS fine FROM a, b),
      good AS (SELECT * FROM plans WHERE fine{limit}) {tail}"""


PLAN = "na || ',' || nb AS n, cost::DOUBLE AS cost, round(lower_six, 8) AS lower_six, round(lower_three, 8) AS lower_three"
STATUS = """CASE WHEN raw_text = '' THEN 'missing' WHEN n_q + n_a > 0 AND no_system = 1 AND regexp_matches(signature, '^(QA)+$') THEN 'format_ok_pending_review' ELSE 'needs_review' END"""
PARSED = f"{X}, parsed AS (SELECT *, {STATUS} AS status FROM (SELECT *, trim(raw) AS raw_text FROM transcripts))"
ATTEMPTS = """att AS (SELECT user_id::VARCHAR AS request_hash, event_id::INT AS attempt, CASE event_type WHEN 'error' THEN 'submitted_unknown' WHEN 'view' THEN 'validation_failed' ELSE 'validated' END AS status, user_id AS i, event_id AS o FROM events)"""
CONFLICT_A = "a AS (SELECT turn_id, level AS label, turn_id % 7 = 0 AS outsourcing FROM pred WHERE agent_id <> 'view' OR turn_index > 1), b AS (SELECT turn_id, prediction AS label, turn_id % 11 = 0 AS outsourcing FROM pred)"

ORACLES = {
    "student_summary": f"WITH {ST} SELECT {K}, candidate_turns::BIGINT AS candidate_turns, labeled_turns::BIGINT AS labeled_turns, round(labeled_turns / candidate_turns::DOUBLE, 8) AS coverage, {R('abl')}, {R('hot')}, {', '.join(R(f'p{k}') for k in range(1, 7))} FROM students",
    "conversation_ctq": f"WITH {ST} SELECT {K}, record_id, n, {R('ctq')}, {R('ctq_legacy')}, hot_change FROM students_conv",
    "dhi_symmetric": f"WITH {ST} SELECT {K}, round(dhi, 8) AS dhi_symmetric FROM students",
    "dhi_asymmetric": f"WITH {ST} SELECT {K}, {R('dhi_asymmetric')} FROM students",
    "dhi_legacy": f"WITH {ST} SELECT {K}, {R('dhi_legacy')} FROM students",
    "agent_breadth": f"WITH {ST} SELECT {K}, agents::INT AS agents, {R('mab')}, {R('mab_legacy')} FROM students",
    "aiv_v2": f"WITH {ST} SELECT {K}, {R('hot')}, {R('ctq')}, {R('dhi')}, {R('mab')}, round(least(100.0, {score(PRIMARY)}), 8) AS aiv FROM students",
    "aiv_concave": f"WITH {ST} SELECT {K}, round(least(100.0, {score(PRIMARY, True)}), 8) AS aiv FROM students",
    "aiv_bounds": f"""WITH {ST}, b AS (SELECT *, least(100.0, 50 * coalesce(hot, 0) + 30 * coalesce(ctq, 0) + 15 * coalesce(dhi, 0)) AS low, 5.0 + CASE WHEN hot IS NULL THEN 50 ELSE 0 END + CASE WHEN ctq IS NULL THEN 30 ELSE 0 END + CASE WHEN dhi IS NULL THEN 15 ELSE 0 END AS open FROM students)
      SELECT {K}, NULL::DOUBLE AS aiv, round(low, 8) AS aiv_lower, round(least(100.0, low + open), 8) AS aiv_upper, concat_ws(',', CASE WHEN labeled_turns = 0 THEN 'no_valid_labels' END, CASE WHEN ctq IS NULL THEN 'no_valid_endpoints' END, 'unknown_agent_catalog') AS missing_reasons FROM b""",
    "aiv_legacy": f"""WITH {ST}, b AS (SELECT *, 100 * ({W[0]} * hot + {W[2]} * dhi_legacy) AS base FROM students)
      SELECT {K}, round(base + {100 * W[1]} * ctq_legacy, 8) AS aiv, round(CASE WHEN ctq_legacy IS NULL THEN base END, 8) AS aiv_lower, round(CASE WHEN ctq_legacy IS NULL THEN base + {100 * W[1]} END, 8) AS aiv_upper FROM b""",
    "metrics_with_inventory": f"""WITH {ST} SELECT {K}, candidate_turns::BIGINT AS candidate_turns, labeled_turns::BIGINT AS labeled_turns, {R('hot')} FROM students
      UNION ALL SELECT t.term, c_custkey, 0, 0, NULL FROM customer, (SELECT DISTINCT term FROM turns) t WHERE (t.term, c_custkey) NOT IN (SELECT ({K}) FROM students)""",
    "scheme_compare": f"""WITH {COHORT}, sc AS ({scored()}), m AS (SELECT term, scenario, count(*) AS students, avg(score) AS mean_aiv, max(abs(score - prime)) AS max_change FROM sc GROUP BY ALL),
      r AS (SELECT term, scenario, {RHO} AS spearman FROM {ranked('sc', 'prime', 'score', 'term, scenario')} GROUP BY ALL), t AS (SELECT term, count(*) AS candidates FROM students GROUP BY 1), n AS ({SCHEMES})
      SELECT term, scenario, coalesce(students, 0) AS students, candidates - coalesce(students, 0) AS excluded_students, {R('mean_aiv', 6)}, {R('spearman', 6)}, {R('max_change', 6)}, {R('weight_change_bound', 6)} FROM t CROSS JOIN n LEFT JOIN m USING (term, scenario) LEFT JOIN r USING (term, scenario)""",
    "indicator_spearman": f"WITH {COHORT} " + " UNION ALL ".join(f"SELECT term, '{a}' AS left, '{b}' AS right, count(*) AS students, round({RHO}, 6) AS spearman FROM {ranked(f'(SELECT term, {a} AS x, {b} AS y FROM cohort)', 'x', 'y', 'term')} GROUP BY term" for i, a in enumerate(INDICATORS) for b in INDICATORS[i + 1 :]),
    "student_ranks": f"""WITH {COHORT}, c9 AS (SELECT {K}, {', '.join(f'round({i}, 9) AS {i}' for i in INDICATORS)} FROM cohort), sc AS ({scored(FOUR, 'c9')})
      SELECT term, scenario, student_key, round(score, 6) AS score, rank() OVER w + (count(*) OVER (PARTITION BY term, scenario, score) - 1) / 2.0::DOUBLE AS rank, rank() OVER w <= ceil(count(*) OVER (PARTITION BY term, scenario) / 4.0) AS top_quartile, count(*) OVER (PARTITION BY term, scenario) AS population
      FROM sc WINDOW w AS (PARTITION BY term, scenario ORDER BY score DESC)""",
    "top_quartile_fixed": f"""WITH {ST} SELECT {K}, round(abl, 9) AS abl, row_number() OVER (PARTITION BY term ORDER BY round(abl, 9) DESC, sha256(student_key::VARCHAR)) <= ceil(count(*) OVER (PARTITION BY term) / 4.0) AS top FROM students WHERE abl IS NOT NULL""",
    "agreement_weighted": agree(", round(CASE WHEN expected / total / total > 1e-12 THEN 1 - observed / (expected / total / total) END, 8) AS linear_kappa, round(macro_f1, 8) AS macro_f1", 6, 1, "weight"),
    "agreement_three_tier": agree("", 3, 2, "1"),
    "missingness_4way": f"""WITH {PRED} SELECT term, CASE WHEN agent_id = 'view' THEN 'unavailable' WHEN level IS NULL AND prediction IS NULL THEN 'both_missing' WHEN level IS NULL THEN 'reference_missing' WHEN prediction IS NULL THEN 'prediction_missing' ELSE 'both_labelled' END AS kind, count(*) AS n FROM pred GROUP BY ALL""",
    "label_freeze": f"""WITH {PRED}, x AS (SELECT *, agent_id IN ('click', 'error') AS h, agent_id <> 'signup' AS m FROM pred), y AS (SELECT *, CASE WHEN h THEN level WHEN m THEN prediction END AS label FROM x)
      SELECT turn_id, term, label, CASE WHEN h THEN 'human' WHEN m THEN 'model' ELSE 'none' END AS origin, CASE WHEN label IS NOT NULL THEN NULL WHEN h THEN 'human_insufficient_evidence' WHEN m THEN 'model_insufficient_evidence' ELSE 'not_labelled' END AS missing_reason FROM y""",
    "adjudication_conflicts": f"""WITH {PRED}, {CONFLICT_A} SELECT b.turn_id, a.label AS label_a, a.outsourcing AS outsourcing_a, b.label AS label_b, b.outsourcing AS outsourcing_b FROM b LEFT JOIN a USING (turn_id)
      WHERE a.turn_id IS NULL OR a.label IS DISTINCT FROM b.label OR a.outsourcing IS DISTINCT FROM b.outsourcing""",
    "adjudicated_labels": f"WITH {PRED}, {CONFLICT_A} SELECT turn_id, CASE WHEN a.label IS DISTINCT FROM b.label THEN coalesce(a.label, b.label) ELSE a.label END AS label FROM a JOIN b USING (turn_id)",
    "exclusion_cascade": f"""WITH {T} SELECT CASE WHEN student_key % 10 = 3 THEN 'not_in_primary_roster' WHEN term LIKE '%b' THEN 'outside_provisional_window' WHEN agent_id = 'purchase' THEN 'different_channel' ELSE 'kept' END AS reason, count(*) AS n FROM turns GROUP BY 1""",
    "reconcile_usage": """SELECT count(*) AS orders, count(*) FILTER (declared IS DISTINCT FROM found) AS mismatches, count(*) FILTER (found IS NULL) AS without_items, sum(found)::BIGINT AS items
      FROM (SELECT o_orderkey AS k, count(*) AS declared FROM orders GROUP BY 1) FULL JOIN (SELECT l_orderkey AS k, count(*) AS found FROM lineitem GROUP BY 1) USING (k)""",
    "parse_status": f"WITH {PARSED} SELECT conv_id, status, CASE WHEN status <> 'needs_review' THEN '' WHEN n_q + n_a = 0 THEN 'no_role_markers' ELSE 'ambiguous_or_incomplete_roles' END AS reason, (CASE WHEN status = 'format_ok_pending_review' THEN n_q ELSE 0 END)::INT AS turns FROM parsed",
    "parse_turns": f"""WITH {PARSED}, q AS (SELECT c.conv_id, c.turn, c.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS turn_index FROM conversations c JOIN parsed p USING (conv_id) WHERE p.status = 'format_ok_pending_review' AND c.role = 'user'),
      x AS (SELECT q.conv_id, q.turn_index, q.text, coalesce((SELECT sum(length(b.text) + 4) - 1 FROM conversations b WHERE b.conv_id = q.conv_id AND b.turn < q.turn), 0) AS prior FROM q)
      SELECT conv_id, turn_index::INT AS turn_index, conv_id || '-T' || lpad(turn_index::VARCHAR, 3, '0') AS turn_id, sha256(text) AS question_hash, prior::INT AS prior_chars FROM x""",
    "question_texts": """SELECT conv_id, (count(*) FILTER (role = 'user'))::INT AS questions, CASE WHEN count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0 THEN sha256(string_agg(t, chr(10) ORDER BY turn) FILTER (role = 'user')) END AS text_hash
      FROM (SELECT c.*, text || CASE WHEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' THEN chr(10) || lead(text) OVER (PARTITION BY conv_id ORDER BY turn) ELSE '' END AS t FROM conversations c) GROUP BY 1""",
    "dup_components": f"WITH {DOCS} SELECT doc_id AS student_key, root AS component FROM comp",
    "component_labels": f"WITH {DOCS} SELECT doc_id AS student_key, substr(sha256(ids), 1, 16) AS component_id FROM comp JOIN (SELECT root, array_to_string(list_sort(list(doc_id::VARCHAR)), '|') AS ids FROM comp GROUP BY 1) USING (root)",
    "pool_assignment": f"WITH {DOCS} SELECT doc_id AS student_key, root AS component, {POOL} AS pool FROM comp",
    "stratified_sample": f"""WITH {DOCS}, pl AS (SELECT doc_id, {POOL} AS pool FROM comp),
      r AS (SELECT q.doc_id, lang, pool, row_number() OVER (PARTITION BY pool, lang ORDER BY CASE WHEN pool = 'risk' THEN (length(text) < 12)::INT + {RISK} ELSE 0 END DESC, {U(S, "'turn'", 'q.doc_id')}, q.doc_id) AS place, count(*) OVER (PARTITION BY pool, lang) AS population FROM q JOIN pl USING (doc_id)),
      c AS (SELECT *, CASE pool WHEN 'audit' THEN 120 ELSE 30 END AS take, CASE pool WHEN 'development' THEN 0.15 WHEN 'audit' THEN 0.65 ELSE 0.2 END::DOUBLE AS p1 FROM r)
      SELECT doc_id AS turn_id, doc_id AS student_key, pool, lang AS term, p1 AS stage1_probability, round(CASE WHEN pool <> 'risk' THEN least(take, population) / population::DOUBLE END, 8) AS stage2_probability, round(CASE WHEN pool <> 'risk' THEN 1 / (p1 * (least(take, population) / population::DOUBLE)) END, 8) AS design_weight, population FROM c WHERE place <= take""",
    "parse_review_top15": f"""WITH {PARSED} SELECT * FROM (SELECT (conv_id % 4)::VARCHAR AS term, conv_id, status, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY status = 'format_ok_pending_review', sha256('2045' || conv_id))::INT AS place FROM parsed) WHERE place <= 15""",
    "panel_audit": f"""WITH {P} SELECT * FROM (SELECT 'MISSING_OUTCOME_NO_STRATEGY' AS code, count(*) AS n FROM raw_panel WHERE pre_score IS NULL OR post_score IS NULL
      UNION ALL SELECT 'OUTCOME_OUT_OF_RANGE', count(*) FROM raw_panel WHERE pre_score NOT BETWEEN 0 AND 1e9 OR post_score NOT BETWEEN 0 AND 1e9
      UNION ALL SELECT 'MIXED_TREATMENT_CLUSTER', count(*) FROM (SELECT cluster_id FROM raw_panel GROUP BY 1 HAVING count(DISTINCT treated) > 1)
      UNION ALL SELECT 'NO_COMMON_SUPPORT', count(*) FROM (SELECT stratum FROM raw_panel GROUP BY 1 HAVING count(DISTINCT treated) < 2)) WHERE n > 0""",
    "panel_balance": f"""WITH {WEIGHTED}, k AS (SELECT count(*) FILTER (treated = 1) AS t1, count(*) FILTER (treated = 0) AS t0 FROM panel), sup AS (SELECT bool_or(n1 = 0 OR n0 = 0) AS apart FROM s),
      n AS (SELECT 'pre_score' AS feature, NULL::VARCHAR AS category, count(pre_score) FILTER (treated = 1) AS h1, count(pre_score) FILTER (treated = 0) AS h0, avg(pre_score) FILTER (treated = 1) AS mt, avg(pre_score) FILTER (treated = 0) AS mc, sum(pre_score * w) FILTER (treated = 0) / sum(w) FILTER (treated = 0) AS mw, (var_samp(pre_score) FILTER (treated = 1) + var_samp(pre_score) FILTER (treated = 0)) / 2 AS v FROM w),
      c0 AS (SELECT 'stratum' AS feature, c.stratum AS category, count(*) FILTER (treated = 1) AS h1, count(*) FILTER (treated = 0) AS h0, avg((w.stratum = c.stratum)::INT) FILTER (treated = 1) AS mt, avg((w.stratum = c.stratum)::INT) FILTER (treated = 0) AS mc, sum((w.stratum = c.stratum)::INT * w) FILTER (treated = 0) / sum(w) FILTER (treated = 0) AS mw FROM w, (SELECT DISTINCT stratum FROM panel) c GROUP BY c.stratum),
      b0 AS (SELECT * FROM n UNION ALL SELECT *, (mt * (1 - mt) + mc * (1 - mc)) / 2 FROM c0),
      b AS (SELECT feature, category, h1, h0, mt, mc, CASE WHEN NOT apart AND h1 = t1 AND h0 = t0 THEN mw END AS mw, v, CASE WHEN h1 < t1 OR h0 < t0 OR t1 < 2 OR t0 < 2 THEN 'insufficient_or_missing_baseline' WHEN v > 0 THEN 'positive_variance' WHEN mt = mc THEN 'constant_equal' ELSE 'zero_variance_imbalance' END AS st FROM b0, k, sup)
      SELECT feature, category, h1 AS treated_available, h0 AS control_available, round(mt, 6) AS mean_treated, round(mc, 6) AS mean_control, round(mw, 6) AS weighted_control_mean, st AS scale_status,
        round(CASE WHEN st LIKE 'insuf%' THEN NULL WHEN v > 0 THEN (mt - mc) / sqrt(v) WHEN mt = mc THEN 0 END, 6) + 0.0 AS smd_before, round(CASE WHEN st LIKE 'insuf%' THEN NULL WHEN v > 0 THEN (mt - mw) / sqrt(v) WHEN mt = mw THEN 0 END, 6) + 0.0 AS smd_after FROM b""",
    "panel_overlap": f"""WITH {WEIGHTED}, e AS (SELECT *, n1 / (n1 + n0)::DOUBLE AS e FROM s), c AS (SELECT treated, cluster_id, sum(w) AS cw, max(w) AS top FROM w GROUP BY ALL)
      SELECT strata, round(propensity_min, 6) AS propensity_min, round(propensity_max, 6) AS propensity_max, extreme_strata, unsupported, round(control_ess, 6) AS control_ess, round(control_cluster_ess, 6) AS control_cluster_ess, round(treated_cluster_ess, 6) AS treated_cluster_ess, round(max_control_cluster_share, 6) AS max_control_cluster_share, round(max_treated_cluster_share, 6) AS max_treated_cluster_share, round(max_control_weight, 6) AS max_control_weight
      FROM (SELECT count(*) AS strata, min(e) AS propensity_min, max(e) AS propensity_max, count(*) FILTER (e < 0.05 OR e > 0.95) AS extreme_strata, coalesce(sum(n1 + n0) FILTER (n1 = 0 OR n0 = 0), 0)::BIGINT AS unsupported FROM e),
       (SELECT sum(w) * sum(w) / sum(w * w) AS control_ess, max(w) AS max_control_weight FROM w WHERE treated = 0),
       (SELECT sum(cw) * sum(cw) / sum(cw * cw) AS control_cluster_ess, max(cw) / sum(cw) AS max_control_cluster_share FROM c WHERE treated = 0), (SELECT sum(cw) * sum(cw) / sum(cw * cw) AS treated_cluster_ess, max(cw) / sum(cw) AS max_treated_cluster_share FROM c WHERE treated = 1)""",
    "did_fit": f"WITH {FIT} SELECT round(estimate, 4) AS estimate, round(unadjusted, 4) AS unadjusted, round(sd, 4) AS baseline_sd, n AS students, round(estimate / nullif(sd, 0), 4) AS standardized FROM fit, (SELECT coalesce(stddev_samp(pre_score), 0) AS sd, count(*) AS n FROM panel)",
    "did_strata": f"WITH {P}, {STRATA} SELECT stratum, n1, n0, round(d1 / n1, 4) AS treated_change, round(d0 / n0, 4) AS control_change FROM s",
    "did_bias_bounds": f"WITH {FIT} SELECT bias, round(estimate - bias, 4) AS low, round(estimate + bias, 4) AS high FROM fit, (SELECT unnest([0.0, 1000.0, 5000.0]::DOUBLE[]) AS bias)",
    "did_replicates": f"WITH {REPS} SELECT replicate, round(estimate, 4) AS estimate FROM reps",
    "did_bootstrap": f"""WITH {REPS}, z AS (SELECT max(f.estimate) AS estimate, quantile_cont(r.estimate, 0.025) AS lo, quantile_cont(r.estimate, 0.975) AS hi, (1 + count(*) FILTER (abs(r.estimate - f.estimate) >= abs(f.estimate))) / {DID_REPS + 1}::DOUBLE AS p, count(r.estimate) AS valid, max(r.estimate) - min(r.estimate) AS span FROM reps r, fit f),
      y AS (SELECT *, CASE WHEN valid < {DID_REPS} THEN 'bootstrap_support_failure' WHEN span <= 1e-12 THEN 'degenerate_bootstrap' ELSE 'approximate_cluster_bootstrap' END AS status FROM z)
      SELECT round(estimate, 4) AS estimate, round(CASE WHEN status LIKE 'approx%' THEN lo END, 4) AS ci_low, round(CASE WHEN status LIKE 'approx%' THEN hi END, 4) AS ci_high, round(CASE WHEN status LIKE 'approx%' THEN p END, 4) AS p_value, status, valid AS valid_replicates FROM y""",
    "observed_bootstrap": f"""WITH {ST}, v AS (SELECT term, student_key % 400 AS unit, sum(hot_change) AS s, count(*) AS n FROM students WHERE hot_change IS NOT NULL GROUP BY ALL), dr AS ({drawn('v', 'term', SEED, MEAN_REPS)}),
      m AS (SELECT term, replicate, sum(s * times) / sum(n * times) AS m FROM dr JOIN v USING (term, unit) GROUP BY ALL), l AS (SELECT term, list(m ORDER BY m) AS m FROM m GROUP BY 1), p AS (SELECT term, sum(n)::BIGINT AS students, count(*) AS components, sum(s) / sum(n) AS mean_change FROM v GROUP BY 1)
      SELECT term, students, components, round(mean_change, 8) AS mean_change, round(CASE WHEN components >= 5 THEN m[floor(0.025 * (len(m) - 1))::INT + 1] END, 8) AS ci_low, round(CASE WHEN components >= 5 THEN m[floor(0.975 * (len(m) - 1))::INT + 1] END, 8) AS ci_high, CASE WHEN components < 5 THEN 'fewer_than_five_components' END AS ci_missing_reason FROM p LEFT JOIN l USING (term)""",
    "noise_kernel": f"WITH {noise(1)} SELECT term, mass, level, round(stay, 8) AS stay, round(lower, 8) AS lower, round(upper, 8) AS upper FROM kernel",
    "noise_sensitivity": f"""WITH {noise(NREP)}, {students('noisy', 'sn')}, {students()}, base AS (SELECT *, student_key % 400 AS root FROM students WHERE labeled_turns > 0),
      sc AS (SELECT *, string_split(term, '#')[1] AS t0, string_split(term, '#')[2]::DOUBLE AS mass, string_split(term, '#')[3]::BIGINT AS replicate, student_key % 400 AS unit FROM sn WHERE labeled_turns > 0),
      ln AS ({LONG('sc', 't0 AS term, mass, replicate, unit')}), pt AS (SELECT term, metric, avg(v) AS observed, count(v) AS students, count(DISTINCT CASE WHEN v IS NOT NULL THEN root END) AS support FROM ({LONG('base', 'term, root')}) GROUP BY ALL),
      lb AS (SELECT term, mass, metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT term, mass, metric, replicate, avg(v) AS m FROM ln GROUP BY ALL) GROUP BY ALL),
      us AS (SELECT DISTINCT term, root AS unit FROM base), dr AS ({drawn('us', 'term', SEED + 1, NREP)}),
      jn AS (SELECT term, mass, metric, count(m) AS valid, quantile_cont(m, 0.025) AS jl, quantile_cont(m, 0.975) AS jh FROM (SELECT ln.term, mass, metric, ln.replicate, sum(v * times) / nullif(sum(times) FILTER (v IS NOT NULL), 0) AS m FROM ln JOIN dr ON dr.term = ln.term AND dr.replicate = ln.replicate AND dr.unit = ln.unit GROUP BY ALL) GROUP BY ALL)
      SELECT term, mass, metric, round(observed, 6) AS observed, students, support, round(low, 6) AS low, round(high, 6) AS high, round(CASE WHEN support >= 5 AND valid = {NREP} THEN jl END, 6) AS joint_low, round(CASE WHEN support >= 5 AND valid = {NREP} THEN jh END, 6) AS joint_high, valid AS joint_valid FROM lb JOIN jn USING (term, mass, metric) JOIN pt USING (term, metric)""",
    "rank_stability": f"""WITH {noise(NREP)}, zz AS (SELECT string_split(term, '#')[1] AS term, r, student_key, round(avg(level), 9) AS abl FROM (SELECT n.*, split_part(n.term, '#', 3)::BIGINT AS r FROM noisy n WHERE split_part(n.term, '#', 2)::DOUBLE = 0.2) GROUP BY ALL HAVING avg(level) IS NOT NULL),
      bb AS (SELECT term, student_key, round(avg(level), 9) AS abl FROM turns GROUP BY ALL HAVING avg(level) IS NOT NULL),
      tz AS (SELECT * FROM zz QUALIFY row_number() OVER (PARTITION BY term, r ORDER BY abl DESC, sha256(student_key::VARCHAR)) <= ceil(count(*) OVER (PARTITION BY term, r) * 0.25)), tb AS (SELECT * FROM bb QUALIFY row_number() OVER (PARTITION BY term ORDER BY abl DESC, sha256(student_key::VARCHAR)) <= ceil(count(*) OVER (PARTITION BY term) * 0.25)),
      cc AS (SELECT tz.term, tz.r, count(tb.student_key) AS same, count(*) AS k FROM tz LEFT JOIN tb USING (term, student_key) GROUP BY ALL), oo AS (SELECT term, count(*) AS o FROM tb GROUP BY 1)
      SELECT term, round(avg(same / k::DOUBLE), 8) AS overlap, round(avg((k + o - 2 * same) / (k + o - same)::DOUBLE), 8) AS flip_rate FROM cc JOIN oo USING (term) GROUP BY 1""",
    "allocation_options": plan_sql("SELECT name, frame, n, adjudicated, round(radius, 8) AS radius, cost::DOUBLE AS cost, round(lower_six, 8) AS lower_six, round(lower_three, 8) AS lower_three, fine FROM opts"),
    "allocation_optimal": plan_sql(f"SELECT {PLAN} FROM (SELECT * FROM good WHERE lower_six >= 0.6 AND lower_three >= 0.7 ORDER BY cost, lower_six DESC, lower_three DESC, na, nb LIMIT 4)", review="0.5"),
    "allocation_frontier": plan_sql(f""", pt AS (SELECT cost, lower_six, lower_three, min((na, nb)) AS z FROM good GROUP BY ALL), pp AS (SELECT cost, lower_six, lower_three, z[1] AS na, z[2] AS nb FROM pt)
      SELECT {PLAN} FROM pp p WHERE NOT EXISTS (SELECT 1 FROM pp q WHERE q.cost <= p.cost AND q.lower_six >= p.lower_six AND q.lower_three >= p.lower_three AND (q.cost < p.cost OR q.lower_six > p.lower_six OR q.lower_three > p.lower_three))"""),
    "ledger_spend": f"""WITH {ATTEMPTS} SELECT (1.25::DECIMAL(38,12) + sum(CASE WHEN status = 'submitted_unknown' THEN 0.5::DECIMAL(38,12) ELSE ((i * 2 + o * 8)::DECIMAL(20,6) * 0.000001::DECIMAL(10,6))::DECIMAL(38,12) END))::VARCHAR AS spent, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens FROM att""",
    "ledger_versions": f"""WITH {ATTEMPTS}, o AS (SELECT *, CASE status WHEN 'validated' THEN 1 WHEN 'validation_failed' THEN 2 ELSE 3 END AS added FROM att)
      SELECT version::INT AS version, (1.25::DECIMAL(38,12) + sum(CASE WHEN status = 'submitted_unknown' THEN 0.5::DECIMAL(38,12) ELSE ((i * 2 + o * 8)::DECIMAL(20,6) * 0.000001::DECIMAL(10,6))::DECIMAL(38,12) END))::VARCHAR AS spent, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens FROM o JOIN range(1, 4) v(version) ON added <= version GROUP BY 1""",
    "ledger_snapshot": f"""WITH {ATTEMPTS}, p AS (SELECT request_hash, coalesce(min(attempt) FILTER (status = 'validated'), max(attempt)) AS attempt FROM att GROUP BY 1)
      SELECT c_custkey::VARCHAR AS request_hash, p.attempt, coalesce(a.status, 'not_attempted') AS status FROM customer LEFT JOIN p ON p.request_hash = c_custkey::VARCHAR LEFT JOIN att a ON a.request_hash = p.request_hash AND a.attempt = p.attempt""",
    "plan_reserve": "SELECT item_id, sha256(text) AS request_hash, (((strlen(text) * 2 + 1600)::DECIMAL(20,6) * 0.000001::DECIMAL(10,6))::DECIMAL(38,12))::VARCHAR AS reserved FROM benchmark",
    "csv_guard": "SELECT doc_id, CASE WHEN regexp_matches(ltrim(cell), '^[=+@-]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' =' WHEN 1 THEN '@' ELSE '' END || source AS cell FROM documents)",
    "session_windows": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 28800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
      c AS (SELECT user_id, k, count(*) AS n, count(*) FILTER (event_type <> 'error') AS l FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS turns, max(n) AS longest, sum(l)::BIGINT AS labelled FROM c GROUP BY 1""",
    "readiness": f"WITH {T} SELECT term, agent_id, count(*) AS turns, count(DISTINCT student_key) AS students, min(turn_id) AS first, max(turn_id) AS last FROM turns GROUP BY ALL",
}
PRED_ROWS = f"WITH {PRED} SELECT term, count(*) FILTER (level IS NOT NULL AND prediction IS NOT NULL) AS pairs_, count(*) FILTER (level IS NULL) AS gold_na, count(*) FILTER (level IS NOT NULL AND prediction IS NULL) AS lost FROM pred GROUP BY 1"
ORACLES["quality_gates"] = f"""WITH n AS ({PRED_ROWS}), k AS ({ORACLES["agreement_weighted"]}),
  m AS (SELECT n.*, CASE WHEN n.term NOT LIKE '%b' THEN k.linear_kappa END AS kappa, CASE WHEN pairs_ + lost > 0 THEN pairs_ / (pairs_ + lost)::DOUBLE ELSE 0 END AS cov FROM n LEFT JOIN k USING (term)),
  g AS (SELECT * FROM (VALUES ('lenient', 2, 0.5::DOUBLE, 0.0::DOUBLE, true), ('strict', 1000000000, 0.99, 0.99, true), ('open', NULL, NULL, NULL, false)) v(policy, a, b, c, unseen)),
  r AS (SELECT *, concat_ws(',', CASE WHEN a IS NULL THEN 'quality_criteria_not_confirmed' END, CASE WHEN NOT unseen THEN 'not_attested_independent_audit' END, CASE WHEN pairs_ < a THEN 'insufficient_pairs' END, CASE WHEN cov < b THEN 'insufficient_prediction_coverage' END,
    CASE WHEN term LIKE '%b' AND pairs_ > 0 THEN 'missing_design_weights' END, CASE WHEN kappa IS NULL OR kappa < c THEN 'insufficient_linear_kappa' END) AS reasons FROM m, g)
  SELECT term, policy, pairs_ AS pairs, gold_na, lost AS prediction_na, round(cov, 8) AS coverage, kappa AS linear_kappa, reasons, reasons = '' AS passed FROM r"""
