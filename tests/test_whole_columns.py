"""Columns are taken whole."""

from turnloom.plans.queries import csv_guard


def test_csv_guard_takes_the_whole_source(spark, tmp_path):
    rows = [(i, "s" * 30) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.cell for r in csv_guard(spark, str(tmp_path)).collect()}
    assert got == {0: "' =" + "s" * 30, 1: "'@" + "s" * 30, 2: "s" * 30}
