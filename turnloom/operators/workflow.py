"""Steps between the operators: protocols, admission of parsed records, paired
probes, simulated panels, question texts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.columns import uniform
from turnloom.functions.spec import ContractError, finite, require
from turnloom.operators import causal
from turnloom.operators.dialogue import questions_only

READY = "format_ok_pending_review"


@dataclass(frozen=True)
class Protocol:
    """A frozen protocol of a two-period comparison."""

    term: str
    time_zero: str
    window: tuple[str, str]
    lower: float
    upper: float
    frozen_by: str = ""
    evidence: tuple[str, ...] = ("", "", "", "", "")
    assumptions: tuple[tuple[str, str], ...] = (("", ""),) * 3
    independent: bool = False
    comparable: bool = False
    higher_is_better: bool = True
    min_clusters: int = 10
    biases: tuple[float, ...] = (0.0,)
    threshold: float = 0.0
    covariates: tuple[str, ...] = ("stratum",)

    def __post_init__(self):
        require(finite(self.lower) < finite(self.upper), "INVALID_OUTCOME_RANGE")
        require(len(self.window) == 2 and moment(self.time_zero) < moment(self.window[0]) <= moment(self.window[1]), "INVALID_FOLLOWUP_WINDOW")
        finite(self.threshold, 0, self.upper - self.lower)
        require(len(set(self.covariates)) == len(self.covariates) and all(c.strip() for c in self.covariates), "INVALID_COVARIATES")
        require(self.min_clusters >= 10, "TOO_FEW_CLUSTERS_ALLOWED")
        require(1 <= len(self.biases) <= 20 and len(set(self.biases)) == len(self.biases) and all(finite(b, 0) >= 0 for b in self.biases), "INVALID_BIAS_BOUNDS")

    def blockers(self) -> list[str]:
        """Codes that the protocol itself gives, whatever the panel."""
        found = {
            "PROTOCOL_NOT_FROZEN": not self.frozen_by.strip(), "DESIGN_EVIDENCE_MISSING": not all(e.strip() for e in self.evidence), "ASSUMPTION_UNDOCUMENTED": any(s != "assumed" or not r.strip() for s, r in self.assumptions),
            "NO_INDEPENDENT_OUTCOME": not self.independent, "OUTCOME_NOT_COMPARABLE": not self.comparable, "UNSUPPORTED_OUTCOME_DIRECTION": not self.higher_is_better,
        }
        return [k for k, v in found.items() if v]


def moment(text: str) -> datetime:
    """A time with its offset."""
    try:
        out = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        raise ContractError("INVALID_TIME") from None
    require(out.tzinfo is not None, "TIME_WITHOUT_OFFSET")
    return out


TIMES = ("baseline_time", "covariates_time", "treatment_time", "followup_time")


def blockers(panel: DataFrame, protocol: Protocol) -> DataFrame:
    """code, n of everything that forbids an estimate: the protocol's own codes (n 1),
    those of terms and covariates, of times, and of outcomes, arms and support. A panel
    without times has them all unverified, one without terms is of no term, and one
    without covariates has none."""
    spark = panel.sparkSession
    if "term" not in panel.columns:
        panel = panel.withColumn("term", F.lit(None).cast("string"))
    for c in TIMES:
        if c not in panel.columns:
            panel = panel.withColumn(c, F.lit(None).cast("string"))
    own = spark.createDataFrame([(c, 1) for c in protocol.blockers()], "code string, n long")
    found = own.unionByName(causal.audit(panel, protocol.lower, protocol.upper)).unionByName(causal.time_blockers(panel, protocol.time_zero, protocol.window))
    return found.unionByName(causal.schema_blockers(panel, protocol.term, protocol.covariates))


def study(panel: DataFrame, protocol: Protocol, replicates: int = 500, seed: int = 2045) -> dict:
    """Audit first; only an unblocked panel is estimated, and only with enough
    clusters in both arms is there an interval. What is blocked still says why."""
    require(isinstance(replicates, int) and 100 <= replicates <= 10_000 and isinstance(seed, int), "INVALID_BOOTSTRAP_CONFIG")
    codes = sorted({r.code for r in blockers(panel, protocol).collect()})
    clusters = {r.treated: r.n for r in panel.groupBy("treated").agg(F.count_distinct("cluster_id").alias("n")).collect()}
    if codes:
        return {"status": "blocked", "blockers": codes, "clusters": clusters}
    point = causal.fit(panel)
    out = {"status": "ready_under_assumptions", "clusters": clusters, "fit": point.first().asDict()}
    effect, few = out["fit"]["estimate"], min(clusters.get(0, 0), clusters.get(1, 0)) < protocol.min_clusters
    found = {"status": "insufficient_clusters"} if few else causal.inference(causal.bootstrap(panel, replicates, seed), point, replicates).first().asDict()
    low, high = found.get("ci_low"), found.get("ci_high")
    bounds = {b: {"effect": (effect - b, effect + b), "interval": None if low is None else (low - b, high + b)} for b in sorted(protocol.biases)}
    return out | {
        "inference": found, "bias_bounds": bounds, "threshold_exceeded": None if low is None else low > protocol.threshold,
        "subgroups": [r.asDict() for r in causal.subgroups(panel, replicates, seed).orderBy("stratum").collect()], "warnings": sorted(r.code for r in causal.warnings(panel).collect()),
    }


def admit(records: DataFrame, decisions: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Ids of the admitted records (record_id, status): those accepted one by one, with
    a reason, and, where a review sample is given and none of its well-formed records was
    rejected, all other well-formed ones."""
    both = decisions.join(records.select("record_id", F.col("status").alias("parsed")), "record_id", "left")
    bad = both.agg(F.count_if(F.col("parsed").isNull()).alias("unknown"), F.count_if((F.col("decision") == "accepted") & (F.col("parsed") != READY)).alias("malformed"), (F.count("*") - F.count_distinct("record_id")).alias("repeated"), F.count_if((F.col("decision") == "rejected") & (F.col("parsed") == READY)).alias("failures")).first()
    require(not bad.unknown and not bad.repeated, "INVALID_PARSE_REVIEW_IDS")
    odd = decisions.agg(F.count_if(~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False))).alias("other"), F.count_if(F.trim(F.coalesce("reason", F.lit(""))) == "").alias("silent")).first()
    require(not odd.other, "INVALID_PARSE_DECISION")
    require(not odd.silent, "PARSE_REASON_REQUIRED")
    require(not bad.malformed, "REPARSE_REQUIRED")
    accepted = decisions.where("decision = 'accepted'").select("record_id")
    if sample is None:
        require(not accepted.isEmpty(), "NO_ADMITTED_RECORDS")
        return accepted
    require(sample.join(decisions, "record_id", "left_anti").isEmpty(), "PARSE_SAMPLE_INCOMPLETE")
    require(not bad.failures, "PARSE_SAMPLE_FAILURE")
    every = accepted.union(records.where(F.col("status") == READY).select("record_id")).distinct()
    require(not every.isEmpty(), "NO_ADMITTED_RECORDS")
    return every


def probe_pairs(labels: DataFrame) -> DataFrame:
    """Labels (pair, variant, label) of an input and its mutation side by side."""
    p = labels.groupBy("pair").agg(F.max(F.when(F.col("variant") == "base", F.col("label"))).alias("base"), F.max(F.when(F.col("variant") == "attack", F.col("label"))).alias("attack"))
    status = F.when(F.col("base").isNull() | F.col("attack").isNull(), "NA").when(F.col("base") == F.col("attack"), "PASS").otherwise("FAIL")
    return p.select("pair", "base", "attack", status.alias("status"), (F.col("attack") - F.col("base")).alias("label_delta"))


def simulated_panels(spark: SparkSession, simulations: int, effect: float, violation: float = 0.0, seed: int = 2045) -> DataFrame:
    """Panels with a known effect: two strata, unbalanced arms, 36 clusters of two
    an arm, normal noise of clusters (sd 2) and members (sd .5)."""
    sizes = [(arm, s, n, pre, trend) for arm in (0, 1) for s, n, pre, trend in (("low", 24 - 12 * arm, 30.0, 2.0), ("high", 12 + 12 * arm, 60.0, 8.0))]
    cells = spark.createDataFrame(sizes, "treated int, stratum string, n int, pre_score double, trend double")
    rows = spark.range(simulations).withColumnRenamed("id", "simulation").crossJoin(F.broadcast(cells)).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("member", F.explode(F.array(F.lit(0), F.lit(1))))
    cluster = F.concat_ws("-", "treated", "stratum", "j")

    def normal(*key):
        u, v = (uniform(F.lit(str(seed)), F.lit(x), F.col("simulation"), cluster, *key) for x in ("u", "v"))
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)

    post = F.col("pre_score") + F.col("trend") + F.col("treated") * (effect + violation) + 2 * normal() + 0.5 * normal(F.col("member"))
    return rows.select("simulation", F.concat_ws("-", cluster, "member").alias("student_key"), cluster.alias("cluster_id"), "treated", "stratum", "pre_score", post.alias("post_score"))


def injected_panels(panel: DataFrame, simulations: int, effect: float, violation: float = 0.0, *, spread: float = 1.0, seed: int = 2045) -> DataFrame:
    """``panel`` once for each simulation, with a known effect (and a violation of equal
    trends) added to the treated's follow-up, and normal noise of clusters (standard
    deviation ``spread``) and members (a quarter of it)."""
    rows = panel.withColumn("simulation", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))

    def normal(*key):
        u, v = (uniform(F.lit(str(seed)), F.lit(x), F.col("simulation"), F.col("cluster_id"), *key) for x in ("u", "v"))
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)

    return rows.withColumn("post_score", F.col("post_score") + F.col("treated") * (effect + violation) + spread * normal() + spread / 4 * normal(F.col("student_key")))


def simulate(panels: DataFrame, effect: float, replicates: int = 200, seed: int = 2045) -> DataFrame:
    """Mean estimate, coverage with its Monte Carlo error, and rejection rate, all
    simulations in one job."""
    change = F.col("post_score") - F.col("pre_score")
    sums = panels.groupBy("simulation", "treated", F.col("cluster_id").alias("unit"), "stratum").agg(F.count("*").alias("n"), F.sum(change).alias("d"))
    arm = lambda c, t, w: F.coalesce(F.sum(F.when(F.col("treated") == t, F.col(c) * w)), F.lit(0))
    four = lambda w: [arm("n", 1, w).alias("n1"), arm("n", 0, w).alias("n0"), arm("d", 1, w).alias("d1"), arm("d", 0, w).alias("d0")]
    point = causal.estimate(sums.groupBy("simulation", "stratum").agg(*four(F.lit(1))), ["simulation"]).select("simulation", F.col("estimate").alias("point"))
    drawn = causal.draws(sums.select("simulation", "treated", "unit").distinct(), ["simulation", "treated"], replicates, seed).join(sums, ["simulation", "treated", "unit"])
    reps = causal.estimate(drawn.groupBy("simulation", "replicate", "stratum").agg(*four(F.col("times"))), ["simulation", "replicate"]).join(point, "simulation")
    each = reps.groupBy("simulation").agg(F.max("point").alias("point"), F.percentile("estimate", 0.025).alias("low"), F.percentile("estimate", 0.975).alias("high"), ((1 + F.count_if(F.abs(F.col("estimate") - F.col("point")) >= F.abs("point"))) / (replicates + 1)).alias("p"))
    inside = F.avg(F.lit(effect).between(F.col("low"), F.col("high")).cast("double"))
    return each.agg(F.count("*").alias("simulations"), F.avg("point").alias("mean_estimate"), inside.alias("coverage"), F.avg((F.col("p") <= 0.05).cast("double")).alias("rejection")).withColumn("coverage_se", F.sqrt(F.col("coverage") * (1 - F.col("coverage")) / F.col("simulations")))


def question_texts(rows: DataFrame, roster: DataFrame, first: list[str]) -> DataFrame:
    """Question-only texts of the roster's students; ids in ``first`` are put first."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(i) for i in first]).cast("array<string>"), F.col("record_id")), F.lit(0)), F.lit(len(first) + 1))
    kept = rows.join(roster, "student_key", "left_semi").select("record_id", "student_key", questions_only(F.col("raw")).alias("questions"), place.alias("priority"))
    return kept.where("questions IS NOT NULL").orderBy("priority", "record_id")
