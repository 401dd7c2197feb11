"""Places in groups, row contracts, rosters, workbooks, reports, strict answers, commands."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from turnloom.cli import main
from turnloom.functions.spec import Aggregation, ContractError, MetricSpec, feature_stability_bound, schemes, weight_stability_bound
from turnloom.operators import contracts, export, ordering, ranks, sampling, workflow
from turnloom.sources import artifacts, files, report, workbook

SPEC = MetricSpec(catalog=("a", "b"))


def test_running_sums_span_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.range(2000).select(F.floor(F.col("id") % 3 / 2).alias("g"), (F.col("id") * 7919 % 2003).alias("x"))
        got = ordering.running(df, ["g"], [F.col("x").desc()], "x", "before").collect()
        n = ordering.numbered(df, ["g"], [F.col("x")], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: -r.x):
            assert r.before == total
            total += r.x
        assert [r.n for r in sorted((r for r in n if r.g == g), key=lambda r: r.x)] == list(range(sum(r.g == g for r in n)))
    assert ordering.running(df.limit(0), ["g"], [F.col("x")], "x", "before").count() == 0


def test_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("t", 1.0), ("t", 2.0), ("t", 2.0), ("t", None), ("u", 5.0)], "term string, x double")
    got = {(r.term, r.x): (r.up, r.down) for r in ranks.with_places(df, ["x"], ["term"]).select("term", "x", ranks.average_rank("x").alias("up"), ranks.average_rank("x", True).alias("down")).collect()}
    assert got == {("t", 1.0): (0.0, 3.0), ("t", 2.0): (1.5, 1.5), ("t", None): (None, None), ("u", 5.0): (0.0, 1.0)}


def test_bounds():
    assert feature_stability_bound((0.1, -0.2, 0, 0), SPEC.weights, Aggregation()) == pytest.approx(11)
    assert weight_stability_bound((0.5, 0.3, 0.15, 0.05), (0.3, 0.3, 0.3, 0.1)) == pytest.approx(20)
    assert all(sum(w) == pytest.approx(1) for _, w, _ in schemes(SPEC)) and len(schemes(SPEC)) == 12
    with pytest.raises(ContractError):
        feature_stability_bound((2, 0, 0, 0), SPEC.weights, Aggregation())
    with pytest.raises(ContractError, match="INVALID_UTILITIES"):
        MetricSpec(utilities=(0, 0.1, 0.1, 0.5, 0.9, 1))


def test_answers():
    for text in ('{"a": 1}', '```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', '```json\r\n{"a": 1}\r\n```', ' {"a": 1} '):
        assert files.decode_answer(text) == {"a": 1}
    for text in ('{"a": 1e999}', '{"a": NaN}', '{"a": 1, "a": 2}', "[1]", '```json\n{"a": 1}\n``` and more', 'see {"a": 1}'):
        with pytest.raises(ContractError):
            files.decode_answer(text)


def test_folded_texts_join_components(spark):
    long = "x" * 40
    rows = spark.createDataFrame([(1, f"Straße {long}"), (2, f"STRASSE {long}"), (3, f"ΟΔΟΣ {long}"), (4, f"οδος {long}")], "student_key long, question string")
    got = {r.student_key: r.root for r in sampling.components(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    ids = {r.student_key: r.component_id for r in sampling.component_ids(sampling.components(rows)).collect()}
    assert ids[1] == ids[2] == hashlib.sha256(b"1|2").hexdigest()[:16] and ids[3] == hashlib.sha256(b"3|4").hexdigest()[:16]


def test_reviews(spark):
    turns = spark.createDataFrame([(1, "why so", ""), (2, "how come", "x")], "turn_id long, question string, prior_context string")
    task = contracts.review_task(turns, turns.select("turn_id"), "r")
    row = lambda i, **k: {"turn_id": i, "question": ["why so", "how come"][i - 1], "prior_context": ["", "x"][i - 1], "reviewer_id": "r", "bloom_level": "2", "reviewed_at": "2024-01-01", "outsourcing": "no", "insufficient_evidence": "no", "confidence_1_to_5": "3", "evidence_quote": ["why", "how"][i - 1], "notes": ""} | k
    kind = "turn_id long, " + ", ".join(f"{c} string" for c in list(row(1))[1:])
    form = lambda *rows: spark.createDataFrame(list(rows), kind)
    assert sorted((r.turn_id, r.label) for r in contracts.review_labels(form(row(1), row(2, bloom_level="NA", insufficient_evidence="yes", notes="no idea")), task).collect()) == [(1, 2), (2, None)]
    with pytest.raises(ContractError, match="REVIEW_SAMPLE_CHANGED"):
        contracts.review_labels(form(row(1)), task)
    for bad, code in (({"question": "why not", "evidence_quote": "why"}, "REVIEW_INPUT_CHANGED"), ({"reviewer_id": "q"}, "REVIEWER_MISMATCH"), ({"bloom_level": "7"}, "INVALID_LABEL"), ({"evidence_quote": "never"}, "EVIDENCE_NOT_VERBATIM"), ({"reviewed_at": "soon"}, "INVALID_REVIEW_DATE")):
        with pytest.raises(Exception, match=code):
            contracts.review_labels(form(row(1, **bad), row(2)), task).collect()
    with pytest.raises(Exception, match="UNKNOWN_SAMPLE_ID"):
        contracts.review_task(turns, spark.createDataFrame([(9,)], "turn_id long"), "r").collect()


def test_gold(spark):
    one = spark.createDataFrame([(1, 2), (2, 3)], "turn_id long, label int")
    with pytest.raises(Exception, match="OVERLAPPING_GOLD"):
        contracts.without_gold_overlap([one, one]).collect()
    with pytest.raises(Exception, match="DESIGN_WEIGHT_MISSING"):
        contracts.gold_pairs(one, one, spark.createDataFrame([(1, 1.0)], "turn_id long, weight double")).collect()
    assert contracts.gold_pairs(one, one).count() == 2


def test_roster_rows_and_strangers(spark):
    m = spark.createDataFrame([("t", "a", 2, 1, 0.5, 0.5, 0.5, 0.5, [])], "term string, student_key string, candidate_turns long, labeled_turns long, hot double, ctq double, dhi double, mab double, missing_reasons array<string>")
    got = {r.student_key: r for r in export.export_rows(export.with_roster(m, spark.createDataFrame([("t", "a"), ("t", "b")], "term string, student_key string")), SPEC).where("scenario = 'primary'").collect()}
    assert got["a"].aiv == pytest.approx(50) and got["a"].rank == 1 and got["a"].top_quartile and got["a"].source_population == 2
    assert got["b"].aiv is None and got["b"].missing_reasons.startswith("no_metric_row_for_roster_member;missing_hot") and got["b"].rank is None and got["b"].conditional_upper == pytest.approx(100)
    with pytest.raises(Exception, match="ROSTER_MISSING_METRIC_STUDENT"):
        export.with_roster(m, spark.createDataFrame([("t", "b")], "term string, student_key string")).collect()


def book(path, rows, name="Sheet"):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda r, i: "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(r) if v is not None)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i}">{cells(r, i)}</row>' for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    book(tmp_path / "a.xlsx", [["Student\n ID", "Text", None], ["s1", "hi", 3], [None, None, None], ["s2", None, 4.5]])
    book(tmp_path / "~$a.xlsx", [["x"]])
    rows = workbook.read_rows(spark, str(tmp_path))
    assert [(r.row, r.cells) for r in rows.orderBy("row").collect()] == [(1, ["Student ID".replace(" ", "\n "), "Text"]), (2, ["s1", "hi", "3"]), (4, ["s2", None, "4.5"])]
    got = workbook.table(rows, {"student": ["student id", "Student ID"], "text": ["Text"]}).orderBy("_row").collect()
    assert [(r._row, r.student, r.text) for r in got] == [(2, "s1", "hi"), (4, "s2", None)]
    with pytest.raises(ContractError, match="COLUMN_MISSING"):
        workbook.table(rows, {"agent": ["Agent"]})
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="INVALID_WORKBOOK"):
        workbook.read_rows(spark, str(tmp_path)).collect()


def test_blocked_studies_report(spark):
    protocol = workflow.Protocol(term="t", time_zero="2024-02-01T00:00:00Z", window=("2024-02-02T00:00:00Z", "2024-06-01T00:00:00Z"), lower=0, upper=200)
    text, page = report.causal_report({"status": "blocked", "blockers": ["NO_VALID_CONTROL"], "clusters": {1: 3}}, protocol, synthetic=True)
    assert "NO_VALID_CONTROL" in text and "## Effect" not in text and "Synthetic" in page
    roll = export.all_terms(spark.createDataFrame([], "term string, students long, with_labels long, with_score long, turns long, labelled long, mean_score double"), spark.createDataFrame([("empty", 4)], "term string, source_population long"))
    assert "| empty | 4 | 0 |" in report.metrics_report(roll, SPEC, synthetic=False)[0]


def test_no_infinities_in_json(spark, tmp_path):
    with pytest.raises(Exception, match="NON_FINITE_NUMBER"):
        files.write_jsonl(spark.createDataFrame([(float("inf"),)], "x double"), f"{tmp_path}/j")


def test_tables_of_artifacts_go_where_told(spark, tmp_path):
    store = artifacts.ArtifactStore(str(tmp_path / "s"), f"file://{tmp_path}/shared")
    name = store.put("numbers", None, table=spark.range(5))
    assert (tmp_path / "shared" / name).exists() and store.rows(spark, name).count() == 5


def test_steps_by_command(spark, tmp_path, capsys):
    turns = "/root/testdata/sf0.001"
    from turnloom.plans import adapters

    adapters.turns(spark, turns).write.parquet(f"{tmp_path}/turns")
    (tmp_path / "spec.json").write_text(json.dumps({"catalog": list(adapters.CATALOG)}))
    assert main(["metrics", f"{tmp_path}/turns", "--spec", f"{tmp_path}/spec.json", "--out", f"{tmp_path}/m"]) == 0
    assert main(["schemes", f"{tmp_path}/m", "--spec", f"{tmp_path}/spec.json", "--out", f"{tmp_path}/s", "--format", "jsonl"]) == 0
    assert spark.read.json(f"{tmp_path}/s").count() % 12 == 0
    assert main(["student-export", f"{tmp_path}/m", "--spec", f"{tmp_path}/spec.json", "--out", f"{tmp_path}/e", "--format", "csv"]) == 0
    assert main(["metrics-report", f"{tmp_path}/m", "--spec", f"{tmp_path}/spec.json"]) == 0
    out = capsys.readouterr().out
    assert "## Terms" in out
    (tmp_path / "bad.json").write_text('{"weights": [1, 1, 1, 1]}')
    assert main(["metrics", f"{tmp_path}/turns", "--spec", f"{tmp_path}/bad.json", "--out", f"{tmp_path}/x"]) == 2


def test_runs_are_registered_by_their_hashes(spark, tmp_path):
    from turnloom.sources import runs

    run = tmp_path / "run"
    run.mkdir()
    turn = {"turn_id": "t1", "record_id": "r1", "student_key": "s", "term": "x", "turn_index": 1, "question": "q", "prior_context": "", "label": None}
    (run / "turns.jsonl").write_text(json.dumps(turn) + "\n")
    (run / "records.jsonl").write_text(json.dumps({"record_id": "r1", "term": "x", "student_key": "s"}) + "\n")
    (run / "sampling.json").write_text("{}")
    (run / "readiness.json").write_text('{"population_counts": {"x": 3}}')
    store, made = artifacts.ArtifactStore(str(tmp_path / "s")), runs.write_manifest(str(run))
    name = runs.register_run(spark, store, str(run), made)
    assert store.get(name)["payload"]["population"] == {"x": 3} and store.rows(spark, name).first().text_hash
    (run / "sampling.json").write_text('{"a": 1}')
    with pytest.raises(ContractError, match="PREPARED_INPUT_CHANGED"):
        runs.register_run(spark, store, str(run), made)
    with pytest.raises(ContractError, match="POPULATION_COUNT_BELOW_RECORDS"):
        (run / "readiness.json").write_text('{"population_counts": {"x": 0}}')
        runs.register_run(spark, store, str(run), runs.write_manifest(str(run)))
    with pytest.raises(ContractError, match="INPUT_PATH_INVALID"):
        runs.inside(str(run), "../s")
    with runs.writer_lock(str(tmp_path)), pytest.raises(ContractError, match="WRITER_LOCKED"), runs.writer_lock(str(tmp_path)):
        pass
    with pytest.raises(ContractError, match="REDIRECT_REFUSED"):
        runs._Stay().redirect_request(None, None, 302, "", {}, "http://elsewhere")
    with pytest.raises(ContractError, match="COLUMNS_MISSING"):
        runs.required_columns(spark.range(1), ["x"])


def test_legacy_samples(spark):
    from turnloom.operators import legacy

    t = spark.createDataFrame([("c1", 1, 2), ("c1", 2, 5)], "record_id string, turn_index int, level int")
    assert legacy.checked_sample(t, 1).count() == 2
    for rows, n, code in ((t.where("turn_index = 2"), None, "INCOMPLETE_TURN_SEQUENCE"), (t, 2, "UNEXPECTED_SAMPLE_SIZE"), (t.withColumn("level", F.lit(9)), None, "INVALID_LABEL")):
        with pytest.raises(ContractError, match=code):
            legacy.checked_sample(rows, n)
    with pytest.raises(Exception, match="UNKNOWN_TURN_KEY"):
        legacy.sample_students(spark.createDataFrame([("x-c1",)], "conversation_id string"), spark.createDataFrame([("x-r2", "s")], "qid string, student_key string")).collect()
