"""Exact duplicates by an extendible-hash index on shared files.

1. Rows are frozen in the shared folder (see ``frozen``). A scan groups the equal
   texts of each unit by comparing bytes, so a text that fills a third of the table
   counts once for each unit. What is left are the index's *entries*: hash key,
   size, the unit's best row, and the member rows without their text.
2. A directory is grown by doubling: buckets whose entries exceed the capacity
   split on one more leading key bit until they fit or hold a single key. The
   driver sees histograms of key prefixes only, never keys.
3. Owner tasks take contiguous ranges of buckets, and each entry's text goes to its
   owner: the only time that texts move. Within a bucket, entries with the same key
   form a chain, and bytes are compared along it, so colliding keys never merge
   different texts. Their verdicts are the index's *classes* table.
4. Verdicts, which name a row by its place, go back to the members; rows that stay
   are read from the frozen files.

Defined cases: null text counts as empty; of rows with the same text the one
with the largest id stays, null ids lowest, and among rows with the same id the
first one read; an empty table gives an empty result; other columns, whatever
their names, travel in the struct ``row``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import cut, lean, new_folder, text_buffers
from turnloom.llm.frozen import Frozen, Unit, freeze, unpacked

#: Leading key bits that one histogram pass tells apart (so many rows reach the driver at most per parent cell).
PASS_BITS = 10


@dataclass(frozen=True)
class ExactIndex:
    """``entries``: unit, lead, key, n_bytes, sha, members (pos, row); ``classes``:
    unit, lead, keep_unit, keep_pos, keep_id, group_size, bucket, chain."""

    path: str
    frozen: Frozen
    entries: DataFrame
    classes: DataFrame
    directory: list[tuple[int, int]]

    def rows(self) -> DataFrame:
        """One row per input row: row, text_sha256, keep_id, group_size, kept."""
        members = self.entries.select("unit", "lead", "sha", F.explode("members").alias("m"))
        kept = (F.col("unit") == F.col("keep_unit")) & (F.col("m.pos") == F.col("keep_pos"))
        return members.join(self.classes, ["unit", "lead"]).select("m.row", F.col("sha").alias("text_sha256"), "keep_id", "group_size", kept.alias("kept"))

    def kept(self) -> DataFrame:
        """row and text of the rows that stay."""
        members = self.entries.select("unit", "lead", F.explode("members.pos").alias("pos"))
        gone = members.join(self.classes, ["unit", "lead"]).where("unit <> keep_unit OR pos <> keep_pos")
        return self.frozen.without(gone.select("unit", "pos"))


def _groups(u: Unit, id_name: str, key_bits: int):
    """text, digest, key, members and the best of them, for each text of a unit."""
    ids, view, groups = u.rows.field(id_name).to_pylist(), u.data.tobytes(), {}
    for i in range(len(ids)):
        groups.setdefault(view[u.offsets[i] : u.offsets[i + 1]], []).append(i)
    for text, at in groups.items():
        digest = hashlib.sha256(text).digest()
        best = max(at, key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, -i))
        yield text, digest, int.from_bytes(digest[:8], "big") >> 64 - key_bits << 63 - key_bits, at, best, ids[best]


def _survey(id_name: str, key_bits: int, schema: pa.Schema):
    def run(some_units):
        for u in some_units:
            out, order, n = {x: [] for x in ("lead", "key", "n_bytes", "sha")}, [], [0]
            for text, digest, key, at, _, _ in _groups(u, id_name, key_bits):
                for x, v in zip(out, (at[0], key, len(text), digest.hex()), strict=True):
                    out[x].append(v)
                order.extend(at)
                n.append(len(order))
            cells = pa.StructArray.from_arrays([pa.array(order, pa.int32()), u.rows.take(pa.array(order))], fields=list(schema.field("members").type.value_type))
            members = pa.ListArray.from_arrays(pa.array(n, pa.int32()), cells).cast(schema.field("members").type)
            cols = [pa.array([u.number] * len(out["lead"]), pa.int64()), *[pa.array(v, schema.field(x).type) for x, v in out.items()], members]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _texts(id_name: str, key_bits: int, firsts: np.ndarray, owner: np.ndarray, schema: pa.Schema):
    """Every entry with its text, bucket and owner."""

    def run(some_units):
        for u in some_units:
            rows = [(u.number, at[0], key, text, best, i, len(at)) for text, _, key, at, best, i in _groups(u, id_name, key_bits)]
            bucket = np.searchsorted(firsts, np.array([r[2] for r in rows], np.int64), "right") - 1
            cols = [pa.array([r[k] for r in rows], schema.field(k).type) for k in range(7)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bucket.astype(np.int32)), pa.array(owner[bucket])], schema=schema)

    return run


class Directory:
    """Buckets of an extendible hash: each owns the keys with one prefix. Keys
    have 63 bits; a bucket is (first key, depth)."""

    def __init__(self, capacity: int, max_depth: int = 60):
        self.capacity, self.max_depth = capacity, max_depth
        self.buckets: list[tuple[int, int, int]] = []  # first key, depth, bytes

    def grow(self, entries: DataFrame) -> Directory:
        open_cells, depth = [(0, 0)], 0
        while open_cells:
            deeper = min(depth + PASS_BITS, self.max_depth)
            cell = F.shiftrightunsigned("key", 63 - deeper)
            df = entries
            if depth:
                df = df.where(F.shiftrightunsigned("key", 63 - depth).isin([c for c, _ in open_cells]))
            seen = df.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
            sizes = {r.cell: (r.size, r.lo == r.hi) for r in seen}
            open_next = []
            for first, _ in open_cells:
                self._split(first, depth, deeper, sizes, open_next)
            open_cells, depth = open_next, deeper
        self.buckets.sort()
        return self

    def _split(self, prefix: int, depth: int, deepest: int, sizes: dict, open_next: list) -> None:
        lo, hi = prefix << (deepest - depth), (prefix + 1) << (deepest - depth)
        inside = [(c, v) for c, v in sizes.items() if lo <= c < hi]
        self._place(prefix, depth, deepest, inside, open_next)

    def _place(self, prefix, depth, deepest, inside, open_next) -> None:
        total = sum(v[0] for _, v in inside)
        if total <= self.capacity or (len(inside) == 1 and inside[0][1][1]) or depth >= self.max_depth:
            self.buckets.append((prefix << (63 - depth), depth, total))
        elif depth == deepest:
            open_next.append((prefix, depth))
        else:
            middle = (2 * prefix + 1) << (deepest - depth - 1)
            self._place(2 * prefix, depth + 1, deepest, [x for x in inside if x[0] < middle], open_next)
            self._place(2 * prefix + 1, depth + 1, deepest, [x for x in inside if x[0] >= middle], open_next)

    def owners(self) -> tuple[np.ndarray, np.ndarray, int]:
        """First key and owner of every bucket; neighbouring small buckets share
        an owner up to the capacity."""
        firsts, owner, filled, at = [], [], 0, 0
        for first, _, size in self.buckets:
            if filled and filled + size > self.capacity:
                at, filled = at + 1, 0
            firsts.append(first)
            owner.append(at)
            filled += size
        return np.array(firsts, np.int64), np.array(owner, np.int32), at + 1


def _own(schema: pa.Schema):
    """Chains of one owner's buckets: bytes are compared, never only keys."""

    def run(batches):
        chains: dict[int, list[dict]] = {}
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            data, offsets = text_buffers(c["text"])
            unit, lead, key, pos, best, n, bucket = (c[x].to_pylist() for x in ("unit", "lead", "key", "best_pos", "best_id", "n", "bucket"))
            for i in range(len(unit)):
                text, chain = data[offsets[i] : offsets[i + 1]].tobytes(), chains.setdefault(key[i], [])
                link = next((x for x in chain if x["text"] == text), None)
                rank = (best[i] is not None, best[i] if best[i] is not None else 0, -unit[i], -pos[i])
                if link is None:
                    chain.append({"text": text, "rank": rank, "keep": (unit[i], pos[i], best[i]), "n": n[i], "at": [(unit[i], lead[i])], "bucket": bucket[i]})
                    continue
                link["n"] += n[i]
                link["at"].append((unit[i], lead[i]))
                if rank > link["rank"]:
                    link |= {"rank": rank, "keep": (unit[i], pos[i], best[i])}
        out = {x: [] for x in schema.names}

        def block():
            return pa.RecordBatch.from_arrays([pa.array(v, schema.field(x).type) for x, v in out.items()], schema=schema)

        for chain in chains.values():
            for place, x in enumerate(chain):
                for at in x["at"]:
                    for name, v in zip(out, (*at, *x["keep"], x["n"], x["bucket"], place), strict=True):
                        out[name].append(v)
                if len(out["unit"]) > 20_000:
                    yield block()
                    for v in out.values():
                        v.clear()
        yield block()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bucket_bytes: int = 32 << 20, key_bits: int = 63, path: str | None = None, unit_bytes: int | None = None) -> ExactIndex:
    """Index ``docs``. ``bucket_bytes``: capacity of a bucket and of an owner,
    in text bytes. ``key_bits``: fewer than 63 force collisions (tests)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    path = path or new_folder(docs.sparkSession, "exact")
    rows = freeze(docs, f"{path}/rows", text_col, unit_bytes=unit_bytes)
    id_type, f = docs.schema[id_col].dataType, lambda n, t: T.StructField(n, t, True)
    long, whole = T.LongType(), T.IntegerType()
    wire = T.StructType([f("unit", long), f("lead", whole), f("key", long), f("n_bytes", long), f("sha", T.StringType()), f("members", T.ArrayType(T.StructType([f("pos", whole), f("row", rows.row_type)])))])
    entries = cut(rows.scan(_survey(id_col, key_bits, to_arrow_schema(wire)), wire), f"{path}/entries")

    directory = Directory(bucket_bytes).grow(entries.select("key", "n_bytes"))
    firsts, owner, n = directory.owners() if directory.buckets else (np.zeros(1, np.int64), np.zeros(1, np.int32), 1)
    sent = T.StructType([f("unit", long), f("lead", whole), f("key", long), f("text", T.BinaryType()), f("best_pos", whole), f("best_id", id_type), f("n", long), f("bucket", whole), f("owner", whole)])
    owned = rows.scan(_texts(id_col, key_bits, firsts, owner, to_arrow_schema(sent)), sent).repartitionById(n, "owner")
    found = T.StructType([f("unit", long), f("lead", whole), f("keep_unit", long), f("keep_pos", whole), f("keep_id", id_type), f("group_size", long), f("bucket", whole), f("chain", whole)])
    classes = cut(owned.mapInArrow(lean(_own(to_arrow_schema(found))), found), f"{path}/classes")
    return ExactIndex(path, rows, entries, classes, [(a, b) for a, b, _ in directory.buckets])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: every other column in ``row``, text_sha256,
    keep_id, group_size and kept."""
    return build_index(docs, id_col, text_col, **options).rows()


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; null texts come back as
    empty ones."""
    return unpacked(build_index(docs, id_col, text_col, **options).kept(), docs, text_col)
