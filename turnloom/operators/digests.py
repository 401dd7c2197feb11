"""SHA-256 over the ordered values of groups of any size.

``sha2`` has no state that can be carried on, and a list of a group's values is as
large as the group. Here rows are range-partitioned by (group, order), so that a large
group spans many partitions. A task packs what it meets, in order, into chunks of bounded
size: a group that begins and ends inside its partition is hashed there, and only the
chunks of the first and the last group of each partition move once more and run through
one hash in their order. That task holds one chunk at a time. SHA-256 is a chain, so the
bytes of one group pass through one task; they are its values, packed, and nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.sources.tables import cut, new_folder

#: Characters of a chunk.
CHUNK = 1 << 20


def _changes(cols: list[list], n: int) -> list[int]:
    """Where a group begins, among n rows."""
    return [i for i in range(n) if i == 0 or any(c[i] != c[i - 1] for c in cols)]


def _pack(by: int, sep: str, limit: int):
    """(by ..., n, sha256) of groups inside the partition, (by ..., n, part, chunk, text)
    of its first and last one."""

    def run(batches):
        part, state = TaskContext.get().partitionId(), None
        out: list = []

        def full(s):
            """A chunk of a group that may reach beyond the partition, or is too large to wait."""
            out.append((*s["key"], s["m"], None, part, s["chunk"], sep.join(s["held"])))
            s.update(chunk=s["chunk"] + 1, held=[], size=0, m=0, sent=True)

        def close(s, last):
            if s["first"] or last or s["sent"]:
                full(s)
            else:
                out.append((*s["key"], s["m"], hashlib.sha256(sep.join(s["held"]).encode()).hexdigest(), None, None, None))

        def flush(types):
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*[f"k{i}" for i in range(by)], "n", "sha256", "part", "chunk", "text"])

        types = None
        for b in batches:
            if not b.num_rows:
                continue
            types = [*[b.schema.field(i).type for i in range(by)], pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            keys, values = [b.column(i).to_pylist() for i in range(by)], b.column(by).to_pylist()
            starts = _changes(keys, b.num_rows)
            for x, y in zip(starts, [*starts[1:], b.num_rows], strict=True):
                key = tuple(k[x] for k in keys)
                if state is None or key != state["key"]:
                    first = state is None
                    if state is not None:
                        close(state, False)
                    state = {"key": key, "first": first, "held": [], "size": 0, "m": 0, "chunk": 0, "sent": False}
                sizes = np.cumsum([len(v) + len(sep) for v in values[x:y]])
                i = x
                while i < y:
                    room = max(1, int(np.searchsorted(sizes, (sizes[i - x - 1] if i > x else 0) + limit - state["size"], "right")) - (i - x))
                    j = min(y, i + room)
                    state["held"] += values[i:j]
                    state["size"] += int(sizes[j - x - 1] - (sizes[i - x - 1] if i > x else 0))
                    state["m"] += j - i
                    i = j
                    if state["size"] >= limit:
                        full(state)
            if len(out) > 20_000 or sum(len(o[-1] or "") for o in out) > limit:
                yield flush(types)
        if state is not None:
            close(state, True)
            yield flush(types)

    return run


def _chain(by: int, sep: str):
    """One hash through the chunks of a group, in their order."""

    def run(batches):
        key, h, n, types = None, None, 0, None

        def done():
            cells = [*key, n, h.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], [*[f"k{i}" for i in range(by)], "n", "sha256"])

        for b in batches:
            types = [*[b.schema.field(i).type for i in range(by)], pa.int64(), pa.string()]
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                k, m, text = row[:by], row[by], row[-1]
                if not m:
                    continue
                if key is None or k != key:
                    if key is not None:
                        yield done()
                    key, h, n = k, hashlib.sha256(), 0
                elif n:
                    h.update(sep.encode())
                h.update(text.encode())
                n += m
        if key is not None:
            yield done()

    return run


def ordered_sha256(rows: DataFrame, by: list[str], order: list[Column], value: str, sep: str = ",", *, chunk_chars: int = CHUNK) -> DataFrame:
    """One row for each group of ``rows``: ``by``, ``n`` (values) and ``sha256`` (lower-case
    hexadecimal, of the values in ``order``, joined by ``sep``, in UTF-8). Null keys are
    a group; null values are empty texts. Equal rows may stand in any order. No row holds
    more than ``chunk_chars`` characters and one value."""
    keyed = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)], F.coalesce(F.col(f"`{value}`").cast("string"), F.lit("")).alias("v"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    keys = [F.col(f"k{i}") for i in range(len(by))]
    orders = [F.col(f"o{i}") for i in range(len(order))]
    sorted_ = keyed.repartitionByRange(*keys, *orders).sortWithinPartitions(*keys, *orders).select(*keys, "v")
    types = ", ".join(f"k{i} {t}" for i, t in enumerate(keyed.select(*keys).schema[i].dataType.simpleString() for i in range(len(by))))
    packed = cut(sorted_.mapInArrow(_pack(len(by), sep, chunk_chars), f"{types}, n long, sha256 string, part int, chunk long, text string"), new_folder(rows.sparkSession, "digests"))
    names = [f"k{i}" for i in range(len(by))]
    inside = packed.where("sha256 IS NOT NULL").select(*names, "n", "sha256")
    across = packed.where("sha256 IS NULL").drop("sha256").repartition(*names).sortWithinPartitions(*names, "part", "chunk")
    return inside.unionByName(across.select(*names, "n", "part", "chunk", "text").mapInArrow(_chain(len(by), sep), f"{types}, n long, sha256 string")).toDF(*by, "n", "sha256")
