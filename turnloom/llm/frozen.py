"""Rows written once to the shared folder, in *units* that never change.

Operators that scan the same rows several times, and name a row by its place, must
see the same places whatever tasks, splits or executors do. So the rows (``packed``)
are written once as Parquet files of row groups, by one pass through the input. The
later scans do not let Spark split these files anew: a task takes whole files, named
by the manifest, and reads their row groups itself. A *unit* is one or more
consecutive row groups of one file; its number is the file's number and the first
group's. A lost task writes its file again under another name, and the manifest
holds the names of those that ended.

Units grow with the square root of the corpus (``unit_bytes``): what a unit sends to
one part of a hash space then stays a packed array of useful size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import lean, packed, text_buffers

#: Text bytes of a row group.
GROUP_BYTES = 2 << 20
#: A unit has sqrt(GROWTH * corpus bytes) text bytes, within these bounds: a worker
#: holds some tens of bytes for each of them.
UNIT_BYTES, MOST_BYTES = 2 << 20, 64 << 20
GROWTH = 324


@dataclass
class Unit:
    number: int  # file << 24 | first row group
    rows: pa.StructArray
    data: np.ndarray  # UTF-8 bytes
    offsets: np.ndarray


def _groups(batches, limit: int):
    """Tables of about ``limit`` text bytes, in order."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        offsets = text_buffers(b.column(b.schema.get_field_index("text")))[1]
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(offsets, offsets[i] + max(0, limit - size), "right")) - 1
            j = min(b.num_rows, max(j, i + (not held)))
            if j > i:
                held.append(b.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                i = j
            if i < b.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _write(folder: str, limit: int):
    def run(batches):
        place, root = fs.FileSystem.from_uri(folder)
        name, out, writer, groups, rows, size = f"{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex[:12]}.parquet", None, None, 0, 0, 0
        for t in _groups(batches, limit):
            if writer is None:
                place.create_dir(root, recursive=True)
                out = place.open_output_stream(f"{root}/{name}")
                writer = pq.ParquetWriter(out, t.schema, compression="zstd", compression_level=1, use_dictionary=False, write_statistics=False)
            writer.write_table(t, row_group_size=max(1, t.num_rows))
            groups, rows = groups + 1, rows + t.num_rows
            size += pa.compute.sum(pa.compute.binary_length(t.column("text"))).as_py()
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "groups": [groups], "n_rows": [rows], "n_bytes": [size]})

    return run


def _unit(t: pa.Table, number: int) -> Unit:
    data, offsets = text_buffers(t.column("text"))
    rows = t.column("row").combine_chunks()
    return Unit(number, rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows, data, offsets)


@dataclass(frozen=True)
class Frozen:
    spark: SparkSession
    folder: str
    row_type: T.StructType
    files: list[tuple[str, int, int, int]]  # name, row groups, rows, text bytes
    unit_bytes: int

    @property
    def n_bytes(self) -> int:
        return sum(f[3] for f in self.files)

    @property
    def n_rows(self) -> int:
        return sum(f[2] for f in self.files)

    def manifest(self) -> DataFrame:
        """One row for each file (no, name, groups, n_bytes), a task for each."""
        rows = [(i, name, groups, size) for i, (name, groups, _, size) in enumerate(self.files)]
        df = self.spark.createDataFrame(rows, "no int, name string, groups long, n_bytes long")
        return df.repartitionById(max(1, len(rows)), "no")

    def units(self, batches) -> Iterator[Unit]:
        """The units of the files that ``batches`` of the manifest name."""
        place, root = fs.FileSystem.from_uri(self.folder)
        for b in batches:
            for no, name, groups, size in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                step = max(1, groups * self.unit_bytes // max(1, size))
                with place.open_input_file(f"{root}/{name}") as f:
                    file = pq.ParquetFile(f)
                    for g in range(0, groups, step):
                        t = file.read_row_groups(range(g, min(groups, g + step)), use_threads=False).combine_chunks()
                        yield _unit(t, no << 24 | g)

    def pick(self, wanted: DataFrame, run, schema) -> DataFrame:
        """``run`` over (unit, places in it, batch) for the rows that ``wanted`` (unit,
        pos and further columns) names; of a file only the units asked for are read."""
        me, more = _Reader(self.folder, self.unit_bytes), [c for c in wanted.columns if c not in ("unit", "pos")]
        files = self.manifest().select("no", "name", "groups", "n_bytes")
        named = wanted.withColumn("no", F.shiftright("unit", 24).cast("int")).join(files, "no")
        dealt = named.select("no", "name", "groups", "n_bytes", "unit", "pos", *more).repartition("no").sortWithinPartitions("unit", "pos")
        return dealt.mapInArrow(lean(lambda batches: run(_picked(me, batches))), schema)

    def without(self, gone: DataFrame) -> DataFrame:
        """row and text of all rows but those that ``gone`` (unit, pos, each once)
        names. The places of one file's rows meet in one row, texts do not move."""
        me = _Reader(self.folder, self.unit_bytes)
        marks = gone.groupBy(F.shiftright("unit", 24).cast("int").alias("no")).agg(F.collect_list(F.struct("unit", "pos")).alias("gone"))
        todo = self.manifest().join(marks, "no", "left").repartitionById(max(1, len(self.files)), "no")

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    marked = b.column(b.schema.get_field_index("gone")).slice(i, 1)
                    cells = marked.flatten()
                    at, pos = (cells.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    for u in Frozen.units(me, [b.slice(i, 1)]):
                        stay = np.ones(len(u.rows), bool)
                        stay[pos[at == u.number]] = False
                        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(u.rows), [None, pa.py_buffer(u.offsets), pa.py_buffer(u.data)])
                        keep = pa.array(np.flatnonzero(stay))
                        if len(keep):
                            yield pa.RecordBatch.from_arrays([u.rows.take(keep), text.take(keep).cast(pa.binary())], ["row", "text"])

        wire = T.StructType([T.StructField("row", self.row_type), T.StructField("text", T.BinaryType())])
        return todo.mapInArrow(lean(run), wire).select("row", F.col("text").cast("string").alias("text"))

    def scan(self, run: Callable[[Iterator[Unit]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
        """``run`` over the units of each file."""
        me = _Reader(self.folder, self.unit_bytes)
        return self.manifest().mapInArrow(lean(lambda batches: run(Frozen.units(me, batches))), schema)


def _picked(me: _Reader, batches):
    place, root = fs.FileSystem.from_uri(me.folder)
    for b in batches:
        unit = b.column(b.schema.get_field_index("unit")).to_numpy()
        at = np.flatnonzero(np.diff(unit, prepend=-1))
        for a, z in zip(at, np.append(at[1:], len(unit)), strict=True):
            some = b.slice(a, z - a)
            name, groups, size = (some.column(some.schema.get_field_index(n))[0].as_py() for n in ("name", "groups", "n_bytes"))
            first, step = int(unit[a]) & 0xFFFFFF, max(1, groups * me.unit_bytes // max(1, size))
            with place.open_input_file(f"{root}/{name}") as f:
                t = pq.ParquetFile(f).read_row_groups(range(first, min(groups, first + step)), use_threads=False).combine_chunks()
            yield _unit(t, int(unit[a])), some.column(some.schema.get_field_index("pos")).to_numpy(), some


@dataclass(frozen=True)
class _Reader:
    """What of a Frozen the workers need."""

    folder: str
    unit_bytes: int


def freeze(docs: DataFrame, folder: str, text_col: str = "text", *, group_bytes: int = GROUP_BYTES, unit_bytes: int | None = None) -> Frozen:
    """Write ``docs`` as packed rows under ``folder``. ``unit_bytes``: text bytes of a
    unit; by default it grows with the corpus."""
    df = packed(docs, text_col)
    made = df.mapInArrow(lean(_write(folder, min(group_bytes, unit_bytes or group_bytes))), "name string, groups long, n_rows long, n_bytes long").collect()
    files = [(r.name, r.groups, r.n_rows, r.n_bytes) for r in sorted(made)]
    if unit_bytes is None:
        unit_bytes = min(MOST_BYTES, max(UNIT_BYTES, math.isqrt(GROWTH * sum(f[3] for f in files))))
    return Frozen(docs.sparkSession, folder, df.schema["row"].dataType, files, unit_bytes)


def unpacked(kept: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (row, text) with the columns of ``docs`` again."""
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
