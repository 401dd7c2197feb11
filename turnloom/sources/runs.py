"""Prepared runs taken into an artifact store, with their hashes; paths, locks and
the opening of addresses that such steps need on the driver."""

from __future__ import annotations

import contextlib
import hashlib
import os
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.spec import ContractError, require
from turnloom.sources.artifacts import ArtifactStore
from turnloom.sources.files import strict_json

NEEDED = ("turns.jsonl", "records.jsonl", "sampling.json", "readiness.json")


def inside(root: str, name: str) -> Path:
    """The path of ``name`` below ``root``; one that leads out is an error."""
    base = Path(root).resolve()
    path = (base / name).resolve()
    require(path.is_relative_to(base) and path.exists(), "INPUT_PATH_INVALID", name)
    return path


def digest(path: Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    lost = [n for n in names if n not in df.columns]
    require(not lost, "COLUMNS_MISSING", ", ".join(lost))
    return df


@contextlib.contextmanager
def writer_lock(folder: str):
    """One writer at a time: a file that only its maker may make."""
    path = Path(folder) / ".writer.lock"
    try:
        held = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise ContractError("WRITER_LOCKED") from None
    try:
        os.write(held, str(os.getpid()).encode())
        os.close(held)
        yield path
    finally:
        path.unlink(missing_ok=True)


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_, **__):
        raise ContractError("REDIRECT_REFUSED")


def opener() -> urllib.request.OpenerDirector:
    """Opens addresses, but follows none to another place."""
    return urllib.request.build_opener(_Stay)


def write_manifest(folder: str) -> dict[str, str]:
    """Hashes of the files of a run, by name."""
    root = Path(folder)
    return {str(p.relative_to(root)): digest(p) for p in sorted(root.rglob("*")) if p.is_file() and not p.name.startswith(".")}


def register_run(spark: SparkSession, store: ArtifactStore, folder: str, manifest: dict[str, str]) -> str:
    """The dataset artifact of a prepared run: its files must be as the manifest has
    them, turn and record ids unique, every turn of a known record and unlabelled, and
    no term may count fewer people than it has records of."""
    for name in NEEDED:
        require(name in manifest and digest(inside(folder, name)) == manifest[name], "PREPARED_INPUT_CHANGED", name)
    turns, records = (spark.read.option("mode", "FAILFAST").json(f"file://{inside(folder, n)}") for n in NEEDED[:2])
    required_columns(turns, ["turn_id", "record_id", "student_key", "term", "turn_index", "question", "prior_context"])
    required_columns(records, ["record_id", "term", "student_key"])
    for df, key, code in ((turns, "turn_id", "DUPLICATE_TURN"), (records, "record_id", "DUPLICATE_RECORD")):
        require(df.groupBy(key).count().where("count > 1").isEmpty(), code)
    stray = turns.join(records, "record_id", "left_anti")
    labelled = turns.where("label IS NOT NULL") if "label" in turns.columns else turns.limit(0)
    require(stray.isEmpty() and labelled.isEmpty(), "INVALID_CANDIDATE_TURN")
    counts = strict_json(inside(folder, "readiness.json").read_text(encoding="utf-8")).get("population_counts", {})
    seen = records.groupBy("term").agg(F.count_distinct("student_key").alias("n")).collect()
    require(all(r.term in counts for r in seen), "INVALID_POPULATION_TERM")
    require(all(r.n <= counts[r.term] for r in seen), "POPULATION_COUNT_BELOW_RECORDS")
    payload = {"population": counts, "sampling": strict_json(inside(folder, "sampling.json").read_text(encoding="utf-8")), "files": {n: manifest[n] for n in NEEDED}}
    rows = turns.drop("label").withColumn("text_hash", F.sha2(F.concat_ws("\u0000", "question", "prior_context"), 256))
    with store.lock() if hasattr(store, "lock") else writer_lock(str(store.root)):
        return store.put("dataset", payload, table=rows)
