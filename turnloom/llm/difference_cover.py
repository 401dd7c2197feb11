"""Repeats of ``length`` bytes (400) by a distributed difference cover.

A difference cover of v is a set of residues such that any two positions of the
corpus can be shifted by one amount below v onto sampled positions both. As in
suffix sorting by difference covers, sampled positions are named and sorted, triples
of names are named and sorted in turn (the recursion), the other positions are then
ordered through the sampled ones they reach, and neighbours in the order are
compared. Only prefixes of ``length`` bytes matter, so the recursion ends when names
cover them, and any total order in which equal prefixes are neighbours will do:
names are fingerprints, and an order is one of fingerprints, in ranges of which the
parts of an exchange sort (see ``exchange``).

With ``first = length - 3 v + 1`` bytes:

0. sampled positions are named by ``first`` bytes and sorted; a name of its own
   drops out, for it can be in no repeat (4 bytes of a name are sent: a clash costs
   work only);
1. recursion: the names at p, p + v and p + 2 v, all of them sampled and not alone,
   make a triple, which names ``length - v + 1`` bytes; triples are sorted, and those
   alone drop out;
2. recursion: a triple of those names covers ``length + v + 1`` bytes. A position
   whose triple is not alone *decides* the v positions from it on: each of their
   prefixes also starts elsewhere. The first of equals stands for all;
3. what remains are positions near the ends of repeats, undecided, which reach a
   name of step 1 that is not alone. The classes of that step that an undecided
   position reaches are marked, so that decided positions whose prefix could be
   equal to an undecided one's take part in the merge, but only where they stand
   for all their equals;
4. these remaining positions are merged: sorted by their whole prefix, neighbours
   that agree are repeats.

Where a name decides (2, 4) it has 96 bits: a polynomial modulo 2**64 over parts of
at most 192 bytes, mixed, and 31 bits of one modulo the prime 2**31 - 1.

Strings are judged on the input and never cross documents. Rows are frozen first
and texts are not shuffled; a name is asked once for each unit, so a passage in a
third of all documents costs an entry for each unit, and one place stands for it in
step 4.

Defined cases: null counts as empty; texts shorter than ``length`` keep all;
repeated rows are repeats of each other; an empty table gives an empty result;
cut points may split a UTF-8 character, so kept bytes are binary; other columns
travel in ``row``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnloom.llm.common import U64, mix, new_folder, powers, worker_cache
from turnloom.llm.common import _byte_codes as byte_codes
from turnloom.llm.exchange import answers, distinct, exchange, parts_for
from turnloom.llm.frozen import Unit, freeze

# Perfect difference sets of q + 1 residues modulo q * q + q + 1 (projective planes of orders 9 and 11).
PERFECT = {91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81), 133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)}
BASE = 0xD1342543DE82EF95
PRIME, PRIME_BASE = (1 << 31) - 1, 48271
PART = 192


def cover(v: int) -> tuple[int, ...]:
    """A difference cover of v: a perfect one where known, else all residues below a
    step and the multiples of it."""
    if v in PERFECT:
        return PERFECT[v]
    step = max(1, math.isqrt(v))
    return tuple(sorted({*range(min(step, v)), *range(0, v, step)}))


def _prime_powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME."""
    held = worker_cache(f"prime_{base}", lambda: [np.ones(1, U64)])
    while len(held[0]) < n:
        step = U64(pow(base, len(held[0]), PRIME))
        held[0] = np.concatenate([held[0], held[0] * step % U64(PRIME)])
    return held[0][:n]


class Scan:
    """One unit under one setting."""

    def __init__(self, u: Unit, length: int, v: int):
        self.u, self.length, self.v, self.first_bytes = u, length, v, length - 3 * v + 1
        n = len(u.data)
        with np.errstate(over="ignore"):
            value = byte_codes(5)[u.data] * powers(n, BASE)
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(value, dtype=U64)])
        sizes = np.diff(u.offsets)
        self.first = np.repeat(u.offsets[:-1], sizes).astype(np.int32 if n < 2**31 else np.int64)
        self.left = np.repeat(u.offsets[1:], sizes) - np.arange(n)
        sampled = np.zeros(v, bool)
        sampled[list(cover(v))] = True
        self.at = np.flatnonzero(sampled[(np.arange(n) - self.first) % v] & (self.left >= self.first_bytes))

    def raw(self, at: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + n] - self.sums[at]) * powers(len(self.u.data), pow(BASE, -1, 1 << 64))[at]

    def name(self, at: np.ndarray, n: int) -> np.ndarray:
        """Name of the n bytes from each place, made of parts' names."""
        count, out = -(-n // PART), np.zeros(len(at), U64)
        edges = [n * i // count for i in range(count + 1)]
        with np.errstate(over="ignore"):
            for a, b in zip(edges, edges[1:], strict=False):
                out = mix(out * U64(0x9E3779B97F4A7C15) + self.raw(at + a, b - a) + U64(b - a))
        return out

    def check(self, at: np.ndarray, n: int) -> np.ndarray:
        """31 more bits of the n bytes from each place."""
        if not len(at):
            return np.zeros(0, np.uint32)
        size, p = len(self.u.data), U64(PRIME)
        if not hasattr(self, "prime_sums"):
            codes = byte_codes(9) % p
            self.prime_sums = np.concatenate([np.zeros(1, U64), np.cumsum(codes[self.u.data] * _prime_powers(size, PRIME_BASE) % p, dtype=U64)])
        back = _prime_powers(size, pow(PRIME_BASE, -1, PRIME))[at]
        return ((self.prime_sums[at + n] - self.prime_sums[at]) % p * back % p).astype(np.uint32)

    def triples(self, at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places p of ``at`` (ascending) with p + v and p + 2 v in it and in the same
        document, and the names of the three names."""
        if not len(at):
            return at, names
        one, two = (np.minimum(np.searchsorted(at, at + k * self.v), len(at) - 1) for k in (1, 2))
        fine = (at[one] == at + self.v) & (at[two] == at + 2 * self.v) & (self.first[at[two]] == self.first[at])
        with np.errstate(over="ignore"):
            made = mix(mix(mix(names[fine]) * U64(BASE) + names[one[fine]]) * U64(BASE) + names[two[fine]])
        return at[fine], made

    def reach(self, flags: np.ndarray) -> np.ndarray:
        """Positions with room for a whole string that reach a flagged place within v."""
        total = np.concatenate([[0], np.cumsum(flags)])
        n = len(flags)
        return (self.left >= self.length) & (total[np.minimum(np.arange(n) + self.v, n)] > total[:-1])

    def spread(self, at: np.ndarray, size: int) -> np.ndarray:
        """Positions within ``size`` from one of ``at`` on."""
        edge = np.zeros(len(self.u.data) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + size, len(edge) - 1), -1)
        return np.cumsum(edge[:-1]) > 0


def _several(names: np.ndarray):
    """Distinct names of a unit, whether each is there several times, and the place
    of each entry's name."""
    found, place = distinct(names)
    return found, (np.bincount(place, minlength=len(found)) > 1).astype(np.uint8), place


def _grouped(*keys: np.ndarray):
    """Order by the keys (the first is the leading one), starts and sizes of the runs
    of equal ones."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return order, at, np.diff(at, append=len(order))


def _again(h: np.ndarray, several: np.ndarray) -> np.ndarray:
    order, at, size = _grouped(h)
    out = np.zeros(len(h), bool)
    out[order] = np.repeat((size > 1) | (np.maximum.reduceat(several[order], at) > 0), size)
    return out


def _again_checked(h: np.ndarray, several: np.ndarray, check: np.ndarray) -> np.ndarray:
    order, at, size = _grouped(h, check)
    out = np.zeros(len(h), bool)
    out[order] = np.repeat((size > 1) | (np.maximum.reduceat(several[order], at) > 0), size)
    return out


def _first_of(h: np.ndarray, several: np.ndarray, check: np.ndarray) -> np.ndarray:
    """1 for a name that occurs again, 2 in the first unit that has it, else 0."""
    order, at, size = _grouped(h, check)
    repeated = (size > 1) | (np.maximum.reduceat(several[order], at) > 0)
    out = np.zeros(len(h), np.uint8)
    out[order] = np.repeat(repeated, size)
    out[order[at[repeated]]] = 2
    return out


def _marked(h: np.ndarray, flag: np.ndarray) -> np.ndarray:
    order, at, size = _grouped(h)
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(np.maximum.reduceat(flag[order], at) > 0, size)
    return out


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 400, v: int = 91, part_names: int = 1_500_000, unit_bytes: int | None = None) -> DataFrame:
    """row, n_bytes, n_removed, n_spans, kept (binary), spans (removed runs as pairs
    of first byte and end), kept_sha256 for every row of ``docs``. A string must hold
    four covers: ``4 v - 1 <= length``."""
    if v < 1 or 4 * v - 1 > length:
        raise ValueError("COVER_LONGER_THAN_THE_STRINGS")
    path = new_folder(docs.sparkSession, "cover")
    rows = freeze(docs, f"{path}/rows", text_col, unit_bytes=unit_bytes)
    parts = parts_for(rows, rows.n_bytes * len(cover(v)) / v, part_names)
    folder = [f"{path}/{i}" for i in range(5)]

    def zero(u: Unit):
        s = Scan(u, length, v)
        return s, s.name(s.at, s.first_bytes)

    def one(u: Unit):
        s, names = zero(u)
        found, _, place = _several(names)
        alive = answers(folder[0], u.number, found)[place]
        return s, *s.triples(s.at[alive], names[alive])

    def two(u: Unit):
        s, at, names = one(u)
        found, _, place = _several(names)
        alive = answers(folder[1], u.number, found)[place]
        at, names = at[alive], names[alive]
        return s, at, names, *s.triples(at, names)

    def ask_two(u: Unit):
        s, _, _, long, names = two(u)
        found, several, place = _several(names)
        some = np.zeros(len(found), np.int64)
        some[place] = long
        return found, several, s.check(some, length + v + 1)

    def three(u: Unit):
        s, at, names, long, triples = two(u)
        found, several, place = _several(triples)
        code = answers(folder[2], u.number, found, 2)
        lead = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(lead, place, long)  # of a unit's own equals the first stands for all
        hides = (code[place] == 1) | ((code[place] == 2) & (long > lead[place]))
        flags = np.zeros(len(u.data), bool)
        flags[at] = True
        decided = s.spread(long[code[place] > 0], v)
        hidden = s.spread(long[hides], v)  # another place stands for these
        open_ = s.reach(flags) & ~decided
        total = np.concatenate([[0], np.cumsum(open_)])
        return s, at, names, decided, hidden, open_, total[at + 1] > total[np.maximum(at - v + 1, s.first[at])]

    def ask_three(u: Unit):
        _, _, names, _, _, _, mark = three(u)
        found, place = distinct(names)
        flag = np.zeros(len(found), np.uint8)
        flag[place[mark]] = 1
        return found, flag

    def four(u: Unit):
        s, at, names, decided, hidden, open_, _ = three(u)
        found, place = distinct(names)
        flags = np.zeros(len(u.data), bool)
        flags[at[answers(folder[3], u.number, found)[place]]] = True
        where = np.flatnonzero(open_ | (decided & ~hidden & s.reach(flags)))
        return s, decided, where, _several(s.name(where, length))

    def ask_four(u: Unit):
        s, _, where, (found, several, place) = four(u)
        some = np.zeros(len(found), np.int64)
        some[place] = where
        return found, several, s.check(some, length)

    ask = lambda i, f, answer, **k: exchange(rows, folder[i], parts, f, answer, **k)
    ask(0, lambda u: _several(zero(u)[1])[:2], _again, hash_bytes=4, side=("u1",))
    ask(1, lambda u: _several(one(u)[2])[:2], _again, hash_bytes=4, side=("u1",))
    ask(2, ask_two, _first_of, side=("u1", "<u4"), width=2)
    ask(3, ask_three, _marked, hash_bytes=4, side=("u1",))
    ask(4, ask_four, _again_checked, side=("u1", "<u4"))

    def keep(some_units):
        for u in some_units:
            s, decided, where, (found, _, place) = four(u)
            starts = np.zeros(len(u.data), bool)
            starts[where[answers(folder[4], u.number, found)[place]]] = True
            gone = s.spread(np.flatnonzero(starts | (decided & (s.left >= length))), length)
            stay, texts, spans, hashes = ~gone, [], [], []
            for a, b in zip(u.offsets, u.offsets[1:], strict=False):
                texts.append(u.data[a:b][stay[a:b]].tobytes() if gone[a:b].any() else u.data[a:b].tobytes())
                hashes.append(hashlib.sha256(texts[-1]).hexdigest())
                step = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                spans.append([{"first": int(x), "end": int(y)} for x, y in zip(step[::2], step[1::2], strict=True)])
            removed = np.concatenate([[0], np.cumsum(gone)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            counts = [pa.array(np.diff(u.offsets)), pa.array(removed[u.offsets[1:]] - removed[u.offsets[:-1]]), pa.array([len(x) for x in spans], pa.int64())]
            yield pa.RecordBatch.from_arrays([u.rows, *counts, pa.array(texts, pa.binary()), pa.array(spans, kind), pa.array(hashes)], ["row", "n_bytes", "n_removed", "n_spans", "kept", "spans", "kept_sha256"])

    f = T.StructField
    span = T.ArrayType(T.StructType([f("first", T.LongType()), f("end", T.LongType())]))
    wire = T.StructType([f("row", rows.row_type), *[f(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], f("kept", T.BinaryType()), f("spans", span), f("kept_sha256", T.StringType())])
    return rows.scan(keep, wire)
