"""Benchmark decontamination by the pigeonhole principle.

An item of n normalised characters may be met with up to ``budget = floor(rate *
n)`` edits. It is split into budget + 1 pieces: whatever the edits, one piece
survives. An automaton over all pieces finds the exact hits in every whole text;
the stretches around an item's hits are merged and verified with Myers'
bit-parallel edit distance (semi-global: the item anywhere in the stretch).

The items are a stated query set; they are handled in blocks of at most
``block_chars`` characters, which bounds what the driver and the workers hold; each
block is one scan of the documents.

Normalisation: lower case, white space runs become one space, none at the ends.
Defined cases: null and empty texts match nothing; items shorter than
``min_chars`` normalised characters (1: none is left out) match nothing; equal items
are reported each; a null item id is reported as null; repeated rows are judged
each; empty tables give empty results; other columns travel in ``row``.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import lean, packed, worker_cache


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece), budget + 1 of them, lengths within one of each other."""
    n = budget(len(item), rate) + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Myers:
    """Least edit distance of ``pattern`` to a substring of a text."""

    def __init__(self, pattern: str):
        self.m, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the first best substring."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, score, best, end, masks = full, 0, self.m, self.m, 0, self.masks
        for at, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            plus = down | (full & ~(xh | up))
            minus = up & xh
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full  # the text may begin anywhere: no 1 comes in
            up = minus | (full & ~(xv | plus))
            down = plus & xv
            if score < best:
                best, end = score, at
        return best, end


class Finder:
    """All items of one block."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items, held = items, {}
        for k, (_, text) in enumerate(items):
            for offset, piece in pieces(text, rate):
                held.setdefault(piece, []).append((k, offset))
        self.auto = ahocorasick.Automaton()
        for piece, where in held.items():
            self.auto.add_word(piece, (len(piece), where))
        if held:
            self.auto.make_automaton()
        self.any, self.rate, self.myers = bool(held), rate, {}

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text)."""
        if not text or not self.any:
            return []
        spots: dict[int, set[int]] = {}
        for last, (size, where) in self.auto.iter(text):
            for k, offset in where:
                spots.setdefault(k, set()).add(last + 1 - size - offset)
        out = []
        for k, starts in spots.items():
            item = self.items[k][1]
            most, merged = budget(len(item), self.rate), []
            for s in sorted(starts):
                a, b = max(0, s - most), s + len(item) + most
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            best = (most + 1, 0)
            matcher = self.myers.setdefault(k, Myers(item))
            for a, b in merged:
                if (at := text.find(item, a, b)) >= 0:
                    best = min(best, (0, at + len(item)))
                elif best[0]:
                    d, end = matcher.best(text[a:b])
                    best = min(best, (d, a + end))
            if best[0] <= most:
                out.append((k, *best))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, min_chars: int, block_chars: int):
    """The query set in blocks of bounded size, one after the other; one at least."""
    out, size, first = [], 0, True
    for r in items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).orderBy(*[f"`{id_col}`", f"`{text_col}`"]).toLocalIterator():
        text = normalise(r[1])
        if len(text) < max(1, min_chars):
            continue
        if size + len(text) > block_chars and out:
            yield out
            out, size, first = [], 0, False
        out.append((r[0], text))
        size += len(text)
    if out or first:
        yield out


def _scan(shared, rate: float, clean: bool):
    token = uuid.uuid4().hex  # names this block's automaton; a worker keeps the last one only

    def run(batches):
        held = worker_cache("finder", dict)
        if token not in held:
            held.clear()
            held[token] = Finder(shared.value, rate)
        finder = held[token]
        for b in batches:
            rows, texts = (b.column(b.schema.get_field_index(n)) for n in ("row", "text"))
            found = [finder.find(normalise(t)) for t in texts.to_pylist()]
            if clean:
                yield b.filter(pa.array([not x for x in found], pa.bool_()))
                continue
            at = [i for i, x in enumerate(found) for _ in x]
            hits = [h for x in found for h in x]
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(at, pa.int64())), *[pa.array([h[c] for h in hits], pa.int32()) for c in range(3)]], ["row", "k", "distance", "match_end"])

    return run


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, rate: float = 0.05, min_chars: int = 1, block_chars: int = 4 << 20) -> DataFrame:
    """row, item_id, distance, match_end for every document and item that meet
    within the item's budget."""
    spark, df = docs.sparkSession, packed(docs, text_col)
    wire = T.StructType([df.schema["row"], *[T.StructField(n, T.IntegerType()) for n in ("k", "distance", "match_end")]])
    kind, out = items.schema[id_col].dataType, None
    for block in blocks(items, id_col, text_col, min_chars, block_chars):
        hits = df.mapInArrow(lean(_scan(spark.sparkContext.broadcast(block), rate, False)), wire)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField(id_col, kind)]))
        part = hits.join(F.broadcast(names), "k").select("row", id_col, "distance", "match_end")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, rate: float = 0.05, min_chars: int = 1, block_chars: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that meet no item, with its columns."""
    spark, df = docs.sparkSession, packed(docs, text_col)
    for block in blocks(items, id_col, text_col, min_chars, block_chars):
        df = df.mapInArrow(lean(_scan(spark.sparkContext.broadcast(block), rate, True)), df.schema)
    return df.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
