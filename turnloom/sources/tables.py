"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where the
    session has none, a local session (tests) gets a temporary one; a cluster must
    name one, for a folder of one machine would lose what others write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("SHARED_FOLDER_NOT_SET: set spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="turnloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle has: given by number, they stay as many where a few
    rows turn into many behind it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Folders made and not yet deleted.
_held: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, deleted by ``release`` or when the driver ends."""
    path = f"{shared_folder(spark)}/turnloom/{name}-{uuid.uuid4().hex[:12]}"
    if not _held:
        atexit.register(release)
    _held.append((spark, path))
    return path


def made_since(mark: int) -> list[str]:
    """Folders made after ``mark`` (the length of this list then, from 0)."""
    return [path for _, path in _held][mark:]


def release(paths: list[str] | None = None) -> None:
    """Delete intermediate tables once what was computed from them is written: those
    of ``paths``, by default all made so far."""
    gone = {path for _, path in _held} if paths is None else set(paths)
    for spark, path in _held:
        if path in gone:
            delete(spark, path)
    _held[:] = [x for x in _held if x[1] not in gone]


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        pass


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back: lineage ends here, and a lost executor
    costs no more than its running tasks."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
