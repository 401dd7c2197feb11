"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to ``chunk_chars`` are one piece. A longer text is cut into chunks that
overlap; tasks pre-tokenise the chunks in parallel, each from its own start. The
pattern never looks behind, so two runs that share one boundary agree on all
later ones: a chunk's piece begins at the first boundary in the overlap on which
it and its predecessor agree. A boundary within ``TAIL`` characters of a chunk's
end is not trusted, since what follows may change it. A chunk that finds no
common boundary joins its predecessor, and the joined stretch is cut as one.
Pieces are encoded in parallel and their ids put together in order; decoding
concatenates the bytes of the ids.

Defined cases: null text counts as empty; an empty text has no ids; equal long
texts are encoded once; an empty table gives an empty result; other columns
travel in the struct ``row``.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import lean, packed, sliced, worker_cache

#: Characters before a chunk's end in which a boundary may depend on what follows.
TAIL = 8


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoding(path: str, pattern: str):
    """A tiktoken encoding without special tokens, one for each worker."""
    import tiktoken

    return worker_cache(f"bpe_{path}_{hash(pattern)}", lambda: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}))


def boundaries(pattern: str, text: str) -> np.ndarray:
    """Ends of the matches; the pattern covers every character."""
    own = worker_cache(f"pattern_{hash(pattern)}", lambda: regex.compile(pattern))
    return np.fromiter((m.end() for m in own.finditer(text)), np.int64)


def _encode(path: str, pattern: str):
    def run(batches):
        enc = encoding(path, pattern)
        for b in sliced(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            ids = [enc.encode_to_numpy(t).astype("<u4").tobytes() for t in texts]
            keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(ids, pa.binary())], [*[b.schema.names[i] for i in keep], "ids"])

    return run


def _encode_rows(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``df`` with ids (little-endian unsigned 32-bit) in place of text."""
    schema = df.drop("text").withColumn("ids", F.lit(b"")).schema
    return df.mapInArrow(lean(_encode(path, pattern)), schema)


def _chunks(chunk: int, overlap: int):
    def run(batches):
        done = set()  # keys of this task: copies leave a task once
        for b in sliced(batches, 50):
            keys, texts = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("key", "text"))
            for key, text in zip(keys, texts, strict=True):
                if key in done:
                    continue
                done.add(key)
                at = list(range(0, max(1, len(text) - overlap), chunk))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(range(len(at)), pa.int32()), pa.array(at, pa.int64()), pa.array([text[s : s + chunk + overlap] if s != at[-1] else text[s:] for s in at], pa.string()), pa.array([s == at[-1] for s in at])], ["key", "k", "at", "part", "last"])

    return run


def _cuts(pattern: str, chunk: int, overlap: int):
    """Trusted boundaries in the two overlaps of every chunk, as text offsets."""

    def run(batches):
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            left, right = [], []
            for at, part, last in zip(c["at"], c["part"], c["last"], strict=True):
                ends = boundaries(pattern, part)
                if not last:
                    ends = ends[ends <= len(part) - TAIL]
                left.append((ends[ends <= overlap] + at).tolist())
                right.append([] if last else (ends[ends >= chunk] + at).tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(left, kind), pa.array(right, kind)], [*b.schema.names, "left", "right"])

    return run


def _long_ids(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """key, ids for distinct long texts (key, text)."""
    parts = texts.mapInArrow(_chunks(chunk, overlap), "key string, k int, at long, part string, last boolean")
    parts = parts.groupBy("key", "k").agg(*[F.first(c).alias(c) for c in ("at", "part", "last")])
    run = parts.mapInArrow(_cuts(pattern, chunk, overlap), "key string, k int, at long, part string, last boolean, left array<long>, right array<long>")
    order = Window.partitionBy("key").orderBy("k")
    common = F.array_min(F.array_intersect("left", F.lag("right").over(order)))
    run = run.withColumn("cut", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(common))
    # chunks without a cut join the stretch before them
    run = run.withColumn("stretch", F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("until", F.lead("cut").over(order))
    # each chunk adds what begins at its cut (or where its predecessor's own part ended) and stops at the next one's
    begin = F.coalesce("cut", F.lag("at").over(order) + chunk + overlap)
    own = run.withColumn("begin", begin - F.col("at")).withColumn("stop", F.coalesce(F.col("until") - F.col("at"), F.when(F.col("last"), F.length("part")).otherwise(F.lit(chunk + overlap))))
    own = own.withColumn("part", F.expr("substring(part, int(begin) + 1, int(stop - begin))"))
    pieces = own.groupBy("key", "stretch").agg(F.expr("array_join(transform(array_sort(collect_list(struct(k, part))), x -> x.part), '')").alias("text"))
    ids = _encode_rows(pieces, path, pattern)
    # binary columns are joined as hexadecimal text, for which Spark has array_join
    return ids.groupBy("key").agg(F.expr("unhex(array_join(transform(array_sort(collect_list(struct(stretch, hex(ids) AS h))), x -> x.h), ''))").alias("ids"))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", *, chunk_chars: int = 1 << 16, overlap_chars: int = 512) -> DataFrame:
    """row, n_tokens, ids (binary, little-endian unsigned 32-bit): one row per
    row of ``docs``. Files are read where the work is done, so ``ranks_path``
    must exist on every worker."""
    df = packed(docs, text_col)
    short = _encode_rows(df.where(F.length("text") <= chunk_chars), ranks_path, pattern)
    rest = df.where(F.length("text") > chunk_chars).withColumn("key", F.sha2("text", 256))
    coded = _long_ids(rest.select("key", "text"), ranks_path, pattern, chunk_chars, overlap_chars)
    long = rest.select("row", "key").join(coded, "key").select("row", "ids")
    return short.unionByName(long).select("row", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def _decode(path: str):
    def run(batches):
        def make():
            parts = sorted((r, t) for t, r in load_ranks(path).items())
            sizes = np.zeros(parts[-1][0] + 2, np.int64)
            sizes[[r + 1 for r, _ in parts]] = [len(t) for _, t in parts]
            return np.frombuffer(b"".join(t for _, t in parts), np.uint8), np.cumsum(sizes)

        blob, at = worker_cache(f"bytes_{path}", make)
        for b in sliced(batches):
            out = []
            for ids in b.column(b.schema.get_field_index("ids")).to_pylist():
                ids = np.frombuffer(ids, "<u4")
                sizes = at[ids + 1] - at[ids]
                ends = np.cumsum(sizes)
                out.append(blob[np.arange(ends[-1]) + np.repeat(at[ids] - ends + sizes, sizes)].tobytes() if len(ids) else b"")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return run


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (with ids as bpe_encode makes them) and ``decoded``: the
    bytes of the ids, one after the other."""
    return encoded.mapInArrow(lean(_decode(ranks_path)), encoded.withColumn("decoded", F.lit(b"")).schema)
