"""Quality by importance resampling.

Two bags of hashed n-grams (tokens are runs of letters, digits or other signs;
unigrams and bigrams, ``2**bits`` buckets) are counted: one over all documents,
one over a bounded sample of labelled target documents. With both smoothed by the
same mass, the log of their ratio is a document's log weight. Gumbel noise, a
function of seed and id, is added, and the documents with the largest ``share`` of
keys stay: a draw without replacement in proportion to the weights.

The share defaults to the share of targets among the sampled labels. The key of
rank k is found by a radix search over histograms of bounded size. Log ratios are
fixed-point integers, so a document's weight does not depend on how rows are dealt.

Defined cases: null and empty texts have weight 0 (log); a null id draws the noise
of id 0; equal rows have equal keys and stay or go together, also at the end of
the share; labels without a document, with nulls, or several for one document (a
target only if all agree) are fine; without a target every weight is 0 and the
share is 1; empty tables give empty results; other columns travel in ``row``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import U64, cut, lean, mix, new_folder, packed, steps, text_buffers, word_hashes

CLASSES = np.full(256, 3, np.uint8)  # 0 white space, 1 letters and bytes above ASCII, 2 digits, 3 other signs
CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASSES[48:58] = 2
FIXED = 1 << 20


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens and n + 1 offsets into them for the documents."""
    kind = CLASSES[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    edge = offsets[1:-1]
    new[edge[edge < len(kind)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(kind))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return word_hashes(data, starts, ends, seed=3), np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every unigram and bigram."""
    h, at = tokens(data, offsets)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    same = doc[1:] == doc[:-1]
    shift = U64(64 - bits)
    return np.concatenate([h >> shift, pair[same] >> shift]).astype(np.int64), np.concatenate([doc, doc[1:][same]])


def _count(bits: int, targets, id_name: str):
    def run(batches):
        want = np.frombuffer(targets.value, np.int64)
        total = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            ids = b.column(b.schema.get_field_index("row")).field(id_name)
            known = np.isin(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), want) & ids.is_valid().to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(b.column(b.schema.get_field_index("text")))
            for i, j in steps(offsets):
                bucket, doc = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                total[0] += np.bincount(bucket, minlength=1 << bits)
                total[1] += np.bincount(bucket[known[i:j][doc]], minlength=1 << bits)
        flat = total.reshape(16, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(16), pa.int32()), "blob": pa.array([x.tobytes() for x in flat], pa.binary())})

    return run


def _sum(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(blob, np.int64)
            total[part] = total[part] + x if part in total else x
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "blob": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def log_ratios(raw: np.ndarray, target: np.ndarray, mass: float) -> np.ndarray:
    """Fixed-point log of the smoothed models' ratio for every bucket. ``mass``:
    counts of the target model that each bucket has beforehand; the raw model gets
    the same probability, so what is seldom seen says little."""
    r, t = raw.sum(), target.sum()
    if not r or not t:
        return np.zeros(len(raw), np.int64)
    ratio = np.log((target + mass) / (raw * (t / r) + mass))
    return np.round(ratio * FIXED).astype(np.int64)


def _score(bits: int, table, id_name: str, seed: int, least: float | None):
    """row, log_weight, key; with ``least``, the rows whose key reaches it."""

    def run(batches):
        ratio = np.frombuffer(table.value, np.int64)
        for b in batches:
            rows = b.column(b.schema.get_field_index("row"))
            data, offsets = text_buffers(b.column(b.schema.get_field_index("text")))
            weight = np.zeros(len(rows))
            for i, j in steps(offsets):
                bucket, doc = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                sums = np.zeros(j - i, np.int64)
                np.add.at(sums, doc, ratio[bucket])
                weight[i:j] = sums / FIXED
            ids = rows.field(id_name).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                u = ((mix(ids.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) >> U64(12)).astype(float) + 0.5) / 2.0**52
            key = weight - np.log(-np.log(u))
            if least is not None:
                yield b.filter(pa.array(key >= least))
            else:
                yield pa.RecordBatch.from_arrays([rows, pa.array(weight), pa.array(key)], ["row", "log_weight", "key"])

    return run


def kth_largest(keys: DataFrame, col: str, k: int) -> float:
    """The k-th largest value, digit by digit: four histograms of at most 65,536
    cells reach the driver, whatever the number of rows."""

    def ordered(x: float) -> int:
        i = int(np.float64(x).view(np.int64))
        return i if i >= 0 else i ^ 0x7FFFFFFFFFFFFFFF

    def code(batches):
        for b in batches:
            i = (b.column(0).to_numpy() + 0.0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(i >= 0, i, i ^ 0x7FFFFFFFFFFFFFFF))], ["code"])

    codes, low, above = keys.select(col).mapInArrow(code, "code long"), None, k
    for shift in (48, 32, 16, 0):
        part = codes if low is None else codes.where(F.shiftright("code", shift + 16) == low)
        cells = sorted(((r.cell, r.n) for r in part.groupBy(F.shiftright("code", shift).alias("cell")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for cell, n in cells:
            low = cell
            if above <= n:
                break
            above -= n
    assert ordered(0.0) == 0
    return float(np.int64(low if low >= 0 else low ^ 0x7FFFFFFFFFFFFFFF).view(np.float64))


class Resampler:
    """Models of one corpus. ``fit_rows`` bounds the labelled rows that are used:
    those with the lowest hash of their id."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, target: str = "quality = 1", bits: int = 18, mass: float = 20.0, fit_rows: int = 50_000, share: float | None = None, seed: int = 2045):
        spark = docs.sparkSession
        self.docs, self.df, self.id_col, self.text_col, self.bits, self.seed = docs, packed(docs, text_col), id_col, text_col, bits, seed
        one = labels.where(f"`{id_col}` IS NOT NULL").groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.coalesce(F.expr(target), F.lit(False))).alias("good"))
        sample = one.orderBy(F.xxhash64("id")).limit(fit_rows).collect()  # at most fit_rows ids
        good = np.sort(np.array([r.id for r in sample if r.good], np.int64))
        self.share = share if share is not None else (len(good) / len(sample) if len(good) else 1.0)
        targets = spark.sparkContext.broadcast(good.tobytes())
        blobs = self.df.mapInArrow(lean(_count(bits, targets, id_col)), "part int, blob binary").repartition(16, "part").mapInArrow(_sum, "part int, blob binary").collect()
        flat = b"".join(bytes(r.blob) for r in sorted(blobs, key=lambda r: r.part)) or bytes(16 << bits)
        raw, goal = np.frombuffer(flat, np.int64).reshape(2, -1)
        self.table = spark.sparkContext.broadcast(log_ratios(raw, goal, mass).tobytes())

    def scores(self) -> DataFrame:
        """row, log_weight, key for every document."""
        return self.df.mapInArrow(lean(_score(self.bits, self.table, self.id_col, self.seed, None)), T.StructType([self.df.schema["row"], T.StructField("log_weight", T.DoubleType()), T.StructField("key", T.DoubleType())]))

    def draw(self) -> DataFrame:
        """scores() with kept."""
        held = cut(self.scores(), new_folder(self.docs.sparkSession, "importance"))
        return held.withColumn("kept", F.col("key") >= F.lit(self.least(held)))

    def least(self, scores: DataFrame) -> float:
        n = scores.count()
        k = math.ceil(self.share * n)
        return math.inf if k < 1 else kth_largest(scores, "key", k)

    def kept_rows(self) -> DataFrame:
        """The documents that stay, with their columns (null texts empty)."""
        held = cut(self.scores().select("key"), new_folder(self.docs.sparkSession, "importance"))
        df = self.df.mapInArrow(lean(_score(self.bits, self.table, self.id_col, self.seed, self.least(held))), self.df.schema)
        return df.select(*[F.col("text").alias(c) if c == self.text_col else F.col("row").getField(c).alias(c) for c in self.docs.columns])
