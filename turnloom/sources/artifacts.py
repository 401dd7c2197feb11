"""Content-addressed artifacts: small ones as canonical JSON, tables as Parquet.

An id is the kind and the hash of kind, payload, inputs and configuration, so the
same content is written once. A folder is staged and then moved into place."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.spec import require
from turnloom.sources.files import canonical, fingerprint, strict_json


def code_hash() -> str:
    root = Path(__file__).resolve().parent.parent
    h = hashlib.sha256()
    for p in sorted(root.rglob("*.py")):
        h.update(str(p.relative_to(root)).encode() + b"\0" + p.read_bytes())
    return h.hexdigest()


class ArtifactStore:
    """``root``: the driver's folder of manifests. ``tables``: a URI that all executors
    reach, where tables are kept; without one they lie beside the manifests, which only
    a local session may do."""

    def __init__(self, root: str, tables: str | None = None):
        self.root, self.tables = Path(root), tables
        self.root.mkdir(parents=True, exist_ok=True)

    def _rows_at(self, spark: SparkSession, name: str, staged: Path | None = None) -> str:
        if self.tables is not None:
            return f"{self.tables.rstrip('/')}/{name}"
        require(spark.sparkContext.master.startswith("local"), "SHARED_FOLDER_NOT_SET")
        return f"file://{staged or self._at(name)}/rows"

    @staticmethod
    def checked(name: str) -> str:
        require(bool(re.fullmatch(r"[a-z_]+-[0-9a-f]{64}", name)), "INVALID_ARTIFACT_ID")
        return name

    def _at(self, name: str) -> Path:
        return self.root / self.checked(name)

    def put(self, kind: str, payload, inputs: list[str] = (), config=None, table: DataFrame | None = None) -> str:
        for i in inputs:
            self.get(i)
        if table is not None and self.tables is None:
            require(table.sparkSession.sparkContext.master.startswith("local"), "SHARED_FOLDER_NOT_SET")
        body = {"kind": kind, "payload": payload, "inputs": sorted(inputs), "config": fingerprint(config), "rows": table_hash(table) if table is not None else None}
        name = f"{kind}-{fingerprint(body)}"
        place = self._at(name)
        if place.exists():
            return name
        staged = self.root / f".{uuid.uuid4().hex}"
        staged.mkdir()
        try:
            if table is not None:
                table.write.mode("overwrite").parquet(self._rows_at(table.sparkSession, name, staged))
            with open(staged / "manifest.json", "w", encoding="utf-8") as f:
                f.write(canonical(body | {"code": code_hash()}))
                f.flush()
                os.fsync(f.fileno())
            os.replace(staged, place)
        finally:
            shutil.rmtree(staged, ignore_errors=True)
        return name

    def _body(self, name: str) -> dict:
        place = self._at(name) / "manifest.json"
        require(place.exists(), "ARTIFACT_NOT_FOUND", name)
        return strict_json(place.read_text(encoding="utf-8"))

    def get(self, name: str, kind: str | None = None) -> dict:
        body = self._body(name)
        content = {k: body[k] for k in ("kind", "payload", "inputs", "config", "rows")}
        require(name == f"{body['kind']}-{fingerprint(content)}", "ARTIFACT_CORRUPT", name)
        require(kind is None or body["kind"] == kind, "WRONG_ARTIFACT_KIND", name)
        return body

    def rows(self, spark: SparkSession, name: str) -> DataFrame:
        body, df = self.get(name), spark.read.parquet(self._rows_at(spark, name))
        require(table_hash(df) == body["rows"], "ARTIFACT_CORRUPT", name)
        return df

    def verify_tree(self, name: str, seen: set | None = None) -> int:
        """Check an artifact and all it was made from; returns how many."""
        seen = set() if seen is None else seen
        if name not in seen:
            seen.add(name)
            for i in self.get(name)["inputs"]:
                self.verify_tree(i, seen)
        return len(seen)


def table_hash(df: DataFrame) -> str:
    """Order does not matter; repeated rows do."""
    cols = sorted(df.columns)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in cols]).cast("decimal(20,0)")
    h2 = F.hash(*[F.col(f"`{c}`") for c in cols]).cast("long")
    r = df.agg(F.count("*").alias("n"), F.sum(h).alias("s"), F.sum(h2).alias("t")).first()
    return hashlib.sha256(json.dumps([cols, r.n, str(r.s), str(r.t)]).encode()).hexdigest()
