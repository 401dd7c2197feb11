"""Every query of the engine against its oracle, and the entry module."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from turnloom.cli import main
from turnloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that replay a sequential generator; see test_streams.
BEYOND_SQL = {"seeded_split", "seeded_observed"}


def plain(rows):
    number = lambda v: None if v is None else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([number(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert plain(map(tuple, df.select(*cols).collect())) == plain(db.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) - set(ORACLES) == BEYOND_SQL and set(QUERIES) <= set(entry.queries())


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['turnloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) == %d, e.queries().keys(); e.oracle_sql()" % len(QUERIES)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_suite_without_the_corpus_operators(tmp_path):
    """A copy without the corpus operators, their tests and the pipeline still collects."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json", "*.md")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = f"import sys; sys.path.insert(0, {str(tmp_path / 'copy')!r}); import __spark_entry__ as e; assert 'turnloom.llm' not in sys.modules and len(e.queries()) == {len(QUERIES)}"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""})
    libraries = os.pathsep.join(p for p in sys.path if p and not os.path.realpath(p).startswith(os.path.realpath(root)))  # wherever this run finds them
    done = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "copy", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": libraries})
    assert done.returncode == 0, done.stdout[-2000:]


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "aiv_v2" in capsys.readouterr().out
    assert main(["run", "readiness", SF, f"{tmp_path}/o", "--format", "csv"]) == 0 and spark.read.csv(f"{tmp_path}/o", header=True).count() > 0
    assert main(["verify", str(tmp_path / "s"), "x"]) == 2
    assert main(["report", SF, "panel_audit"]) == 0 and "MISSING_OUTCOME" in capsys.readouterr().out


def test_streaming_sessions(spark, tmp_path):
    from turnloom.streaming.sessions import sessions

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    (tmp_path / "in").mkdir()
    os.symlink(f"{SF}/events.parquet", tmp_path / "in" / "e.parquet")
    stream = sessions(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("s").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed, whole = spark.table("s").count(), sessions(spark.read.parquet(f"{SF}/events.parquet")).count()
    assert 0 < closed <= whole
