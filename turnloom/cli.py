"""Command line: run queries, and the steps of a study from tables to tables.

A table is a folder of Parquet, or a file of JSON lines or CSV with a header.

Exit codes: 0 done, 1 failed, 2 an input breaks its contract."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.spec import Aggregation, ContractError, MetricSpec, legacy_schemes
from turnloom.operators import agreement, allocate, causal, contracts, dialogue, export, ledger, ranks, resample, sampling, scoring, workflow
from turnloom.plans.queries import pilot
from turnloom.plans.registry import QUERIES
from turnloom.sources import artifacts, files, report, workbook


def read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".jsonl", ".json")):
        return spark.read.option("mode", "FAILFAST").json(path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return spark.read.parquet(path)


def metric_spec(path: str | None) -> MetricSpec:
    if path is None:
        return MetricSpec()
    with open(path, encoding="utf-8-sig") as f:
        given = files.strict_json(f.read())
    mode = given.pop("aggregation", None)
    plain = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    return MetricSpec(**plain, **({"aggregation": Aggregation(**mode)} if mode else {}))


def protocol(path: str) -> workflow.Protocol:
    with open(path, encoding="utf-8-sig") as f:
        given = files.strict_json(f.read())
    deep = lambda v: tuple(map(deep, v)) if isinstance(v, list) else v
    return workflow.Protocol(**{k: deep(v) for k, v in given.items()})


def _prepare(spark, a):
    parsed = dialogue.parse(read(spark, a.inputs[0]))
    return dialogue.explode_turns(parsed, a.key) if a.turns else parsed.drop("turns")


def _sample(spark, a):
    turns = read(spark, a.inputs[0])
    return sampling.stratified_sample(turns, sampling.pools(sampling.components(turns), a.seed), a.seed)


def _schemes(spark, a):
    m, spec = read(spark, a.inputs[0]), metric_spec(a.spec)
    return ranks.compare_schemes(m, spec) if spec.version == "aiv-v2" else export.legacy_scheme_means(m, legacy_schemes(spec.weights))


def _export(spark, a):
    m = read(spark, a.inputs[0])
    return export.export_rows(export.with_roster(m, read(spark, a.inputs[1])) if len(a.inputs) > 1 else m, metric_spec(a.spec))


#: Steps from tables to a table: what they read, what they do.
STEPS = {
    "prepare": ("transcripts (key, raw) as parsed records, or as turns", _prepare),
    "components": ("turns as components of students with equal questions", lambda s, a: sampling.component_ids(sampling.components(read(s, a.inputs[0])))),
    "sample": ("turns as a stratified sample with its probabilities", _sample),
    "exclude-questions": ("raw transcripts as question-only texts", lambda s, a: read(s, a.inputs[0]).select(a.key, dialogue.questions_only(F.col("raw")).alias("questions"), dialogue.count_questions(F.col("raw")).alias("n"))),
    "review-task": ("turns, selected ids: the rows of a reviewer", lambda s, a: contracts.review_task(read(s, a.inputs[0]), read(s, a.inputs[1]), a.reviewer)),
    "annotation-check": ("a filled form, turns: its faults", lambda s, a: contracts.annotation_faults(read(s, a.inputs[0]), read(s, a.inputs[1]))),
    "review-import": ("a filled form, its task: labels", lambda s, a: contracts.review_labels(read(s, a.inputs[0]), read(s, a.inputs[1]))),
    "review-compare": ("two reviews: rows on which they differ", lambda s, a: agreement.conflicts(read(s, a.inputs[0]), read(s, a.inputs[1]), "turn_id", ["label", "outsourcing"])),
    "adjudicate": ("two reviews, resolutions: gold labels", lambda s, a: agreement.adjudicate(*[read(s, p) for p in a.inputs[:3]], "turn_id")),
    "prediction-check": ("predictions, turns: faults", lambda s, a: contracts.prediction_faults(read(s, a.inputs[0]), read(s, a.inputs[1]))),
    "request-plan": ("rows (body): requests with hash and reserve", lambda s, a: ledger.plan(read(s, a.inputs[0]), "body", a.price[0], a.price[1], a.max_output)),
    "spend": ("attempts of a ledger: what was spent", lambda s, a: ledger.spend(read(s, a.inputs[0]))),
    "agreement": ("gold, predictions, weights: agreement", lambda s, a: agreement.agreement(contracts.gold_pairs(*[read(s, p) for p in a.inputs]).withColumn("all", F.lit("all")), ["all"])),
    "freeze": ("turns, gold, predictions: adopted labels", lambda s, a: agreement.adopt(*[read(s, p) for p in a.inputs[:3]])),
    "metrics": ("turns with levels: students' indicators and score", lambda s, a: scoring.students(read(s, a.inputs[0]), metric_spec(a.spec))),
    "schemes": ("metrics: schemes side by side", _schemes),
    "correlations": ("metrics: rank correlation of the indicators", lambda s, a: ranks.indicator_spearman(read(s, a.inputs[0]))),
    "ranks": ("metrics: ranks within terms", lambda s, a: ranks.student_ranks(read(s, a.inputs[0]), metric_spec(a.spec))),
    "student-export": ("metrics, a roster: rows of an export", _export),
    "roster-check": ("a roster, metrics: faults", lambda s, a: export.roster_faults(read(s, a.inputs[0]), read(s, a.inputs[1]))),
    "rollup": ("metrics: one row a term", lambda s, a: export.term_rollup(read(s, a.inputs[0]))),
    "observed": ("metrics, members (student_key, root): observed change with intervals", lambda s, a: resample.observed_bootstrap(read(s, a.inputs[0]), read(s, a.inputs[1]), replicates=a.replicates, seed=a.seed)),
    "label-sensitivity": ("turns with levels, members: ranges under label noise", lambda s, a: resample.noise_sensitivity(read(s, a.inputs[0]), read(s, a.inputs[1]), metric_spec(a.spec), a.mass or [0.0, 0.1, 0.2, 0.3], a.replicates, a.seed)),
    "panel-check": ("an imported panel: faults", lambda s, a: contracts.panel_faults(read(s, a.inputs[0]))),
    "causal-audit": ("a panel: what forbids an estimate", lambda s, a: workflow.blockers(read(s, a.inputs[0]), protocol(a.protocol))),
    "causal-balance": ("a panel: balance of the baseline", lambda s, a: causal.balance(read(s, a.inputs[0]))),
    "causal-simulate": ("nothing: coverage over simulated panels", lambda s, a: workflow.simulate(workflow.simulated_panels(s, a.replicates, 5.0, seed=a.seed), 5.0, a.replicates, a.seed)),
    "workbook": ("workbooks: rows of cells", lambda s, a: workbook.read_rows(s, a.inputs[0])),
}


def write(df: DataFrame, out: str, kind: str) -> None:
    if kind == "csv":
        files.write_csv(df, out, df.columns)
    elif kind == "jsonl":
        files.write_jsonl(df, out)
    else:
        df.write.mode("overwrite").parquet(out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="turnloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    form = {"choices": ["parquet", "csv", "jsonl"], "default": "parquet"}
    run = sub.add_parser("run", help="one query, written as Parquet, guarded CSV or JSON lines")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--format", **form)
    for name, (text, _) in STEPS.items():
        step = sub.add_parser(name, help=text)
        step.add_argument("inputs", nargs="*")
        step.add_argument("--out", required=True)
        step.add_argument("--format", **form)
        step.add_argument("--key", default="record_id")
        step.add_argument("--turns", action="store_true")
        step.add_argument("--reviewer", default="")
        step.add_argument("--spec")
        step.add_argument("--protocol")
        step.add_argument("--price", nargs=2, default=["0", "0"])
        step.add_argument("--max-output", type=int, default=0)
        step.add_argument("--mass", nargs="*", type=float)
        step.add_argument("--replicates", type=int, default=500)
        step.add_argument("--seed", type=int, default=2045)
    rep = sub.add_parser("report", help="aggregate queries as Markdown")
    rep.add_argument("tables")
    rep.add_argument("queries", nargs="+", choices=sorted(QUERIES))
    own = sub.add_parser("metrics-report", help="metrics as a report of terms")
    own.add_argument("metrics")
    own.add_argument("--spec")
    own.add_argument("--synthetic", action="store_true")
    study = sub.add_parser("causal-run", help="audit, estimate and report a panel under a protocol")
    study.add_argument("panel")
    study.add_argument("protocol")
    study.add_argument("--replicates", type=int, default=500)
    study.add_argument("--seed", type=int, default=2045)
    study.add_argument("--synthetic", action="store_true")
    inv = sub.add_parser("inventory", help="files below a folder with their hashes")
    inv.add_argument("folder")
    inv.add_argument("--suffix", default="")
    ver = sub.add_parser("verify", help="an artifact and all it was made from")
    ver.add_argument("store")
    ver.add_argument("artifact")
    put = sub.add_parser("put", help="a table as an artifact")
    put.add_argument("store")
    put.add_argument("kind")
    put.add_argument("table")
    put.add_argument("--made-from", nargs="*", default=[])
    alloc = sub.add_parser("allocation", help="the named what-ifs of audit effort")
    alloc.add_argument("tables")
    alloc.add_argument("--name", choices=[*allocate.COSTS, *allocate.ERRORS, *allocate.FRAMES])
    return p


def dispatch(args: argparse.Namespace, spark: SparkSession) -> object:
    if args.command in STEPS:
        write(STEPS[args.command][1](spark, args), args.out, args.format)
        return {"step": args.command, "out": args.out}
    if args.command == "run":
        write(QUERIES[args.query](spark, args.tables), args.out, args.format)
        return {"query": args.query, "out": args.out}
    if args.command == "metrics-report":
        return report.metrics_report(export.term_rollup(read(spark, args.metrics)), metric_spec(args.spec), synthetic=args.synthetic)[0]
    if args.command == "causal-run":
        panel, plan = read(spark, args.panel), protocol(args.protocol)
        found = workflow.study(panel, plan, args.replicates, args.seed)
        fine = found["status"] != "blocked"
        return report.causal_report(found, plan, synthetic=args.synthetic, balance=causal.balance(panel) if fine else None, overlap=causal.overlap(panel) if fine else None)[0]
    if args.command == "put":
        return artifacts.ArtifactStore(args.store).put(args.kind, None, args.made_from, table=read(spark, args.table))
    if args.command == "report":
        return report.build("Report", {q: QUERIES[q](spark, args.tables) for q in args.queries})[0]
    if args.command == "inventory":
        return [r.asDict() for r in files.inventory(spark, args.folder, args.suffix).orderBy("path").collect()]
    if args.command == "allocation":
        return {n: allocate.solve(spark, s)["status"] for n, s in allocate.what_ifs(pilot(spark, args.tables)).items() if args.name in (None, n)}
    raise ContractError("UNKNOWN_COMMAND")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "list":
            out: object = sorted(QUERIES)
        elif args.command == "verify":
            out = {"verified": artifacts.ArtifactStore(args.store).verify_tree(args.artifact)}
        else:
            out = dispatch(args, SparkSession.builder.getOrCreate())
        print(out if isinstance(out, str) else json.dumps(out, default=str, ensure_ascii=False))
    except ContractError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
