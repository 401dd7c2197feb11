"""Substring dedup on words by fixed-block anchors.

A repeat is a run of ``window`` words (20) that also starts earlier: in a document
with a smaller id, or in the same one before. Every reference document is cut into
non-overlapping blocks of window / 2 words; whatever its place, a window holds one
whole block of each document it occurs in. So:

1. blocks are indexed by hash, and every rolling window of a block's length probes
   the index (4 bytes of a hash each; a clash costs work, never a result);
2. only windows that hold a probe hit are extended: a hit block grows to the whole
   windows around it, and equal windows are brought together by a 96-bit hash of
   their words, of which every occurrence but the first is marked;
3. marked windows that touch join to maximal repeats, whose words are removed.

Windows are judged on the input. The rows are frozen first (see ``frozen``), so a
window is known by its place. Questions and answers travel as packed arrays (see
``exchange``), each hash once for each unit, so a passage that fills a third of the
table costs an entry for each unit, and parts grow in number with the input.

Defined cases: null texts and texts without words have nothing to remove; a text
of fewer words than a window keeps all; of repeated rows (same id) the one read
first counts as earlier; null ids come before all others; an empty table gives an
empty result; other columns travel in ``row``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import new_folder, window_hashes, word_hashes, word_spans
from turnloom.llm.exchange import answers, distinct, exchange, parts_for
from turnloom.llm.frozen import Unit, freeze


def _probes(u: Unit, block: int):
    """Words of a unit and the probes that lie within one document: hashes, places
    in the unit's words, and which of them are blocks of the index."""
    starts, ends, at = word_spans(u.data, u.offsets)
    words = word_hashes(u.data, starts, ends)
    n = np.diff(at)
    place = np.arange(len(words)) - np.repeat(at[:-1], n)
    left = np.repeat(n, n) - place
    where = np.flatnonzero(left[: max(0, len(words) - block + 1)] >= block)
    return (starts, ends, at, words, place, left), window_hashes(words, block)[where], where, place[where] % block == 0


def _asked(h: np.ndarray, is_block: np.ndarray):
    """Distinct probes of a unit, whether one is a block and whether there are several
    (as a code), and the place of each probe among them."""
    found, place = distinct(h)
    code = (np.bincount(place, minlength=len(found)) > 1).astype(np.uint8) * 2
    code[place[is_block]] |= 1
    return found, code, place


def _candidates(u: Unit, window: int, folder: str):
    """Windows that hold a hit: hashes and places."""
    block = window // 2
    shape, h, where, _ = _probes(u, block)
    starts, ends, at, words, place, left = shape
    hit = np.zeros(len(words) + 1, np.int64)
    found, back = distinct(h)
    hit[where] = answers(folder, u.number, found)[back]
    total = np.concatenate([[0], np.cumsum(hit)])
    where = np.flatnonzero(left[: max(0, len(words) - window + 1)] >= window)
    where = where[total[where + window - block + 1] > total[where]]
    return shape, window_hashes(words, window, seed=19)[where], where


def _firsts(h: np.ndarray, doc: np.ndarray, where: np.ndarray):
    """Order of a unit's windows by hash, document and place, and which of them, in
    that order, are the unit's first with their hash."""
    order = np.lexsort((where, doc, h))
    first = np.ones(len(h), bool)
    first[1:] = h[order][1:] != h[order][:-1]
    return order, first


def _hits(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Probes of a hash that the index holds and that occurs twice or more."""
    order = np.argsort(h)
    s, code = h[order], code[order]
    at = np.flatnonzero(np.diff(s, prepend=s[:1] + np.uint64(1)))
    n = np.diff(at, append=len(s))
    several = (n > 1) | (np.maximum.reduceat(code & 2, at) > 0)
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(several & (np.maximum.reduceat(code & 1, at) > 0), n)
    return out


def _later(h: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """All occurrences of a window but the earliest; the entries come by unit."""
    order = np.lexsort((np.arange(len(h)), doc, check, h))
    s, c = h[order], check[order]
    out = np.zeros(len(h), bool)
    out[order[1:]] = (s[1:] == s[:-1]) & (c[1:] == c[:-1])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, part_probes: int = 1_500_000, unit_bytes: int | None = None) -> DataFrame:
    """row, n_words, n_removed, kept_text (words joined by a space), spans (the
    maximal repeats as pairs of first word and end) for every row of ``docs``."""
    if window % 2 or window < 2:
        raise ValueError("WINDOW_NOT_EVEN")
    path, block = new_folder(docs.sparkSession, "repeats"), window // 2
    rows = freeze(docs, f"{path}/rows", text_col, unit_bytes=unit_bytes)
    parts = parts_for(rows, rows.n_bytes / 6, part_probes)

    def ask(u: Unit):
        _, h, _, is_block = _probes(u, block)
        return _asked(h, is_block)[:2]

    hits = exchange(rows, f"{path}/hits", parts, ask, _hits, hash_bytes=4, side=("u1",))

    def windows(u: Unit):
        shape, h, where = _candidates(u, window, hits)
        ids = u.rows.field(id_col).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        doc = np.repeat(ids, np.diff(shape[2]))[where]
        return shape, h, where, doc, *_firsts(h, doc, where)

    def ask_windows(u: Unit):
        shape, h, where, doc, order, first = windows(u)
        own = order[first]
        check = window_hashes(shape[3], window, seed=23)[where[own]] >> np.uint64(32)
        return h[own], check, doc[own]

    later = exchange(rows, f"{path}/later", parts, ask_windows, _later, side=("<u4", "<i8"))

    def keep(some_units):
        for u in some_units:
            (starts, ends, at, words, _, _), h, where, _, order, first = windows(u)
            gone_on = ~first  # in order: what the unit itself has earlier
            gone_on[first] = answers(later, u.number, h[order[first]])
            marked = where[order[gone_on]]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, marked, 1)
            np.add.at(edge, marked + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            view, texts, spans = u.data.tobytes(), [], []
            for d in range(len(at) - 1):
                a, b = at[d], at[d + 1]
                stay = np.flatnonzero(~gone[a:b]) + a
                texts.append(b" ".join([view[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
                step = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                spans.append([{"first": int(x), "end": int(y)} for x, y in zip(step[::2], step[1::2], strict=True)])
            removed = np.concatenate([[0], np.cumsum(gone)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([u.rows, pa.array(np.diff(at)), pa.array(removed[at[1:]] - removed[at[:-1]]), pa.array(texts, pa.binary()), pa.array(spans, kind), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["row", "n_words", "n_removed", "kept_text", "spans", "kept_sha256"])

    f = T.StructField
    span = T.ArrayType(T.StructType([f("first", T.LongType()), f("end", T.LongType())]))
    wire = T.StructType([f("row", rows.row_type), f("n_words", T.LongType()), f("n_removed", T.LongType()), f("kept_text", T.BinaryType()), f("spans", span), f("kept_sha256", T.StringType())])
    return rows.scan(keep, wire).withColumn("kept_text", F.col("kept_text").cast("string"))
