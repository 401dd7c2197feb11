"""Questions about hashes, asked by scan tasks and answered by the tasks that own
a share of the hash space.

A scan goes through the units of frozen rows (see ``frozen``). For each unit it asks
about an array of *distinct* 64-bit hashes in ascending order (with side arrays), so
what is repeated within a unit is asked once. The hashes are dealt to parts, which
are ranges of the hash space, and shuffled as packed arrays. The owner of a part sees
all askers of its hashes at once, in the order of the scan, and answers each with a
few packed bits. Answers are regrouped by unit and kept as one small file for each
unit in the shared folder, where the next scan picks them up. So texts are never
shuffled, and an asker is never named in a record: it is known by its place.

The file of a unit holds the number of questions and their sum; a mismatch is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext

from turnloom.llm.common import U64, lean
from turnloom.llm.frozen import UNIT_BYTES, Frozen, Unit

SHIFT = U64(32)


def parts_for(rows: Frozen, questions: float, each: int) -> int:
    """Parts for so many questions: ``each`` in a part, and more where units are larger."""
    return max(1, math.ceil(questions / each / max(1, rows.unit_bytes // UNIT_BYTES)))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash; ascending where the hashes are."""
    return ((h >> SHIFT) * U64(parts) >> SHIFT).astype(np.int64)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order, and for each entry the place of its hash."""
    found, place = np.unique(h, return_inverse=True)
    return found, place


def _sum(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(np.add.reduce(h)) if len(h) else 0


def answers(folder: str, number: int, h: np.ndarray, width: int = 1) -> np.ndarray:
    """Answers (booleans, or codes of ``width`` bits) to the questions ``h`` of a
    unit, in the order in which they were asked."""
    n = len(h)
    if not n:
        return np.zeros(0, bool if width == 1 else np.uint8)
    place, root = fs.FileSystem.from_uri(folder)
    with place.open_input_file(f"{root}/{number % 997:03d}/{number}") as f:
        blob = f.read()
    if int.from_bytes(blob[:8], "little") != n or int.from_bytes(blob[8:16], "little") != _sum(h):
        raise RuntimeError("SCAN_NOT_REPEATABLE")
    flat = np.unpackbits(np.frombuffer(blob, np.uint8, offset=16), count=n * width).reshape(n, width)
    out = np.packbits(flat, axis=1, bitorder="little")[:, 0]
    return out.astype(bool) if width == 1 else out


def exchange(rows: Frozen, folder: str, parts: int, ask: Callable[[Unit], tuple], answer: Callable, *, hash_bytes: int = 8, side: tuple[str, ...] = (), width: int = 1) -> str:
    """``ask(unit)`` gives distinct ascending hashes and the side arrays (by dtype,
    ``side``), one entry for each question; ``answer(hashes, *side)`` gives a code of
    ``width`` bits for each question of a part, whose entries come in the order of the
    units. ``hash_bytes`` of a hash are sent: 4 are enough where a clash only costs
    work. Returns the folder of the answers."""
    types = [np.dtype(t) for t in side]

    def send(units):
        for u in units:
            h, *more = ask(u)
            if not len(h):
                continue
            part, total = part_of(h, parts), _sum(h)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(at[1:], len(part))
            sent = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :hash_bytes])
            more = [np.ascontiguousarray(m.astype(t)) for m, t in zip(more, types, strict=True)]
            blobs = [pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for x in (sent, *more)]
            sums = pa.array([total - (1 << 64 if total >> 63 else 0)] * len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array([u.number] * len(at), pa.int64()), sums, *blobs], ["part", "unit", "total", "h", *[f"s{i}" for i in range(len(types))]])

    def settle(part: int, asked: list):
        asked.sort(key=lambda x: x[0])
        raw = np.frombuffer(b"".join(x[2] for x in asked), np.uint8).reshape(-1, hash_bytes)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :hash_bytes] = raw
        more = [np.frombuffer(b"".join(x[3 + i] for x in asked), t) for i, t in enumerate(types)]
        ends = np.cumsum([0, *[len(x[2]) // hash_bytes for x in asked]])
        codes = np.asarray(answer(wide.view("<u8").ravel(), *more)).astype(np.uint8)
        bits = np.unpackbits(codes[:, None], axis=1, bitorder="little")[:, :width]
        packed = pa.array([np.packbits(bits[a:b].ravel()).tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in asked], pa.int64()), pa.array([part] * len(asked), pa.int32()), pa.array([x[1] for x in asked], pa.int64()), pa.array(np.diff(ends), pa.int64()), packed], ["unit", "part", "total", "n", "bits"])

    def own(batches):
        held: dict[int, list] = {}
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for part, *rest in zip(*cols, strict=True):
                held.setdefault(part, []).append(rest)
        for part in list(held):
            yield settle(part, held.pop(part))

    wire = ", ".join(["part int, unit long, total long, h binary", *[f"s{i} binary" for i in range(len(types))]])
    replies = rows.scan(send, wire).repartitionById(parts, "part").mapInArrow(lean(own), "unit long, part int, total long, n long, bits binary")

    def store(batches):
        place, root = fs.FileSystem.from_uri(folder)
        number, total, held, made = None, 0, {}, set()

        def close():
            where = f"{root}/{number % 997:03d}"
            if where not in made:
                place.create_dir(where, recursive=True)
                made.add(where)
            n = sum(k for k, _ in held.values())
            flat = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k * width) for _, (k, b) in sorted(held.items())])
            name = f"{where}/.{number}-{TaskContext.get().taskAttemptId()}"
            with place.open_output_stream(name) as f:
                f.write(n.to_bytes(8, "little") + (total % (1 << 64)).to_bytes(8, "little") + np.packbits(flat).tobytes())
            place.move(name, f"{where}/{number}")

        for b in batches:
            for u, part, t, n, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number is not None and u != number:
                    close()
                    held = {}
                number, total = u, t
                held[part] = (n, bits)
        if number is not None:
            close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    replies.repartition(max(1, parts // 4), "unit").sortWithinPartitions("unit", "part").mapInArrow(store, "done int").count()
    return folder
