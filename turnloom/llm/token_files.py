"""Token ids in binary shard files with a shared zstandard dictionary.

A shard is: the magic bytes, one zstandard frame for each document (its ids as
little-endian unsigned integers of ``width`` bytes, compressed alone against the
shared dictionary), then the index (id, null flag, frame offset, number of ids
for each document) and a footer with the index's offset, the width and the
SHA-256 of the dictionary. One document is read by the index and one frame.
``manifest.json`` names the shards in ascending order of id with the number of
ids before each; ``dictionary.zstd`` is kept beside it.

The dictionary is trained on a bounded sample (``sample_docs`` documents with the
lowest hash of their id, of each ``8 * sample_ids`` characters and ``sample_ids`` ids
at most); it changes sizes only, and every document is encoded and written whole.

Ids are the library's for the whole text, without special tokens added. Letters that
spell a special token of the vocabulary become its id, as the library has it.

Files are written and read through pyarrow's file systems, so the folder may be
any store that both driver and executors reach. A shard is written under another
name and moved into place: a task that is run again replaces it with the same.

Defined cases: null text counts as empty, an empty text holds the end id only;
null ids come first; rows with the same id stand side by side, in order of their frame's
hash; an empty table gives an empty folder; further columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import lean, sliced, steps, text_buffers, worker_cache

MAGIC = b"TLTOKEN1"
FOOTER = "<QQQ32s8s"  # index offset, documents, width, dictionary hash, magic
#: Text bytes that are cut and encoded at once.
SLICE_BYTES = 5 << 20
LEVEL = 3


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return worker_cache(f"hf_{path}", lambda: Tokenizer.from_file(path))


#: Text in which a space has other white space beside it or stands at an end, text with
#: white space that not all pattern engines take for such, and openings of special tokens.
_BLANK = r"\t-\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000} "
MIXED = rf"[{_BLANK}] | [{_BLANK}]|[\x{{1c}}-\x{{1f}}\x{{85}}]|^ | $|<\|"

class PieceEncoder:
    """The library's ids of whole texts, with each distinct piece encoded once.

    A single space between two characters that are not white space always begins a
    match of the byte-level pattern, and no match looks beyond its end there: ids of the
    pieces that such spaces begin follow each other unchanged, in any order. So Arrow
    cuts a slice of texts at these spaces and finds the distinct pieces, the library
    encodes them as one text, in which a token that begins with a space begins a piece,
    and ids are gathered from there. Other texts (MIXED) go to the library whole, as do
    the pieces at the start of a text. The first ``keep`` pieces of at most ``longest``
    bytes stay, as packed arrays, for later slices."""

    def __init__(self, path: str, keep: int = 600_000, longest: int = 64):
        self.tokenizer, self.keep, self.longest = _tokenizer(path), keep, longest
        self.words, self.pool, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t[:1] == "\u0120"]] = True  # how the vocabulary writes a space

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + word for all words, one after the other, and their numbers."""
        ids = self._whole([" " + " ".join(words)])[0]
        at = np.flatnonzero(self.opens[ids])
        if len(at) == len(words) and at[0] == 0:
            return ids, np.diff(at, append=len(ids))
        each = self._whole([" " + w for w in words])
        return np.concatenate(each), np.array([len(x) for x in each])

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words the places of their ids in a pool, the pool, and the sizes
        of its entries; new words join what is kept while there is room."""
        known = pc.index_in(words, value_set=self.words)
        lost = pc.is_null(known)
        place = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = words.filter(lost)
        if not len(new):
            return place, self.pool, self.sizes
        place[lost.to_numpy(zero_copy_only=False)] = len(self.sizes) + np.arange(len(new))
        ids, sizes = self._pieces([w or "x" for w in new.to_pylist()])  # "" is an empty text's, and not used
        out = place, np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes])
        stay = (pc.binary_length(new).to_numpy() <= self.longest) & (pc.binary_length(new).to_numpy() > 0)
        if len(self.words) + int(stay.sum()) <= self.keep:
            self.words = pa.concat_arrays([self.words, new.filter(pa.array(stay))])
            self.pool, self.sizes = np.concatenate([self.pool, ids[np.repeat(stay, sizes)]]), np.concatenate([self.sizes, sizes[stay]])
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        mixed = pc.match_substring_regex(texts, MIXED).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        hard = np.flatnonzero(mixed)
        for i, ids in zip(hard.tolist(), self._whole(texts.take(pa.array(hard)).to_pylist()), strict=True):
            out[i] = ids
        if len(hard) == len(texts):
            return out
        lists = pc.split_pattern(texts.filter(pa.array(~mixed)), " ")
        at = lists.offsets.to_numpy()
        at, words = at - at[0], lists.flatten()
        coded = words.dictionary_encode()
        place, pool, sizes = self._places(coded.dictionary)
        index = place[coded.indices.to_numpy()]
        heads = words.take(pa.array(at[:-1])).dictionary_encode()
        first = self._whole(heads.dictionary.to_pylist())
        index[at[:-1]] = len(sizes) + heads.indices.to_numpy()
        pool, sizes = np.concatenate([pool, *first]), np.concatenate([sizes, [len(x) for x in first]])
        begin, count = np.cumsum(sizes) - sizes, sizes[index]
        edge = np.concatenate([[0], np.cumsum(count)])[at]
        ids, done = np.empty(edge[-1], "<u4"), 0
        for a in range(0, len(index), 200_000):  # a part at a time: these arrays are ten times their text
            n = count[a : a + 200_000]
            ends = np.cumsum(n)
            stop = done + int(ends[-1])
            ids[done:stop] = pool[np.repeat(begin[index[a : a + 200_000]] - ends + n, n) + np.arange(ends[-1])]
            done = stop
        for i, a, b in zip(np.flatnonzero(~mixed).tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        return out


def _encode_texts(path: str, texts: pa.Array, end: int):
    """Ids of every whole text, as the library gives them, and the end id."""
    enc, tail = worker_cache(f"pieces_{path}", lambda: PieceEncoder(path)), np.array([end], "<u4")
    for i, j in steps(text_buffers(texts)[1], SLICE_BYTES):
        for ids in enc.encode(texts.slice(i, j - i)):
            yield np.concatenate([ids, tail])


def id_width(path: str, end_id: int) -> int:
    """Bytes that hold every id of the vocabulary and the end id."""
    most = max(end_id, _tokenizer(path).get_vocab_size(with_added_tokens=True) - 1, *_tokenizer(path).get_vocab().values())
    return 2 if most < 1 << 16 else 4


def _compress(path: str, end: int, width: int, dictionary: bytes):
    def run(batches):
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if zdict:
            zdict.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict, write_checksum=False, write_dict_id=False)
        for b in batches:
            frames, counts = [], []
            for ids in _encode_texts(path, b.column(b.schema.get_field_index("text")), end):
                counts.append(len(ids))
                frames.append(packer.compress(ids.astype(f"<u{width}").tobytes()))
            at = b.schema.get_field_index("id")
            yield pa.RecordBatch.from_arrays([b.column(at), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["id", "n_tokens", "frame"])

    return run


def _train(df: DataFrame, path: str, end: int, width: int, size: int, docs: int, ids: int) -> bytes:
    sample = df.orderBy(F.xxhash64("id")).select("id").limit(docs).where("id IS NOT NULL").distinct()
    rows = df.join(F.broadcast(sample), "id").orderBy("id").limit(2 * docs)

    def run(batches):
        for b in sliced(batches):
            out = [x[:ids].astype(f"<u{width}").tobytes() for x in _encode_texts(path, pc.utf8_slice_codeunits(b.column(b.schema.get_field_index("text")), 0, 8 * ids), end)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["sample"])

    samples = [bytes(r.sample) for r in rows.mapInArrow(run, "sample binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _write_shards(folder: str, width: int, digest: bytes):
    def run(batches):
        place, root = fs.FileSystem.from_uri(folder)
        out, index, offset, shard = None, [], len(MAGIC), None
        for b in batches:
            ids, counts, frames, shards = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("id", "n_tokens", "frame", "shard"))
            for i, n, frame, s in zip(ids, counts, frames, shards, strict=True):
                if s != shard:
                    if out is not None:
                        yield _close(place, out, name, final, index, offset, width, digest, shard)
                    shard, index, offset = s, [], len(MAGIC)
                    final = f"{root}/shard-{s:06d}.tok"
                    name = f"{root}/.{s:06d}-{uuid.uuid4().hex}"
                    out = place.open_output_stream(name)
                    out.write(MAGIC)
                out.write(frame)
                index.append((i or 0, i is None, offset, n))
                offset += len(frame)
        if out is not None:
            yield _close(place, out, name, final, index, offset, width, digest, shard)

    return run


INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n", "<u8")])


def _close(place, out, name, final, index, offset, width, digest, shard):
    rows = np.array(index, INDEX)
    out.write(rows.tobytes())
    out.write(struct.pack(FOOTER, offset, len(rows), width, digest, MAGIC))
    out.close()
    place.move(name, final)
    return pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(rows)], "tokens": [int(rows["n"].sum())]})


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 2, width: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 48 << 20, dictionary_bytes: int = 64 << 10, sample_docs: int = 1000, sample_ids: int = 2048) -> dict:
    """Write ``docs`` under ``folder`` (a URI) and return the manifest. ``width``:
    bytes of an id in the files, 2 or 4; by default what the vocabulary needs."""
    needed = id_width(tokenizer_path, end_id)
    width = width or needed
    if width not in (2, 4) or width < needed:
        raise ValueError("WIDTH_TOO_SMALL_FOR_THE_VOCABULARY")
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    dictionary = _train(df, tokenizer_path, end_id, width, dictionary_bytes, sample_docs, sample_ids)
    digest = hashlib.sha256(dictionary).digest()
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    bounds = [int(x) for x in df.approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n)] if n > 1 else []
    place, root = fs.FileSystem.from_uri(folder)
    place.create_dir(root, recursive=True)
    with place.open_output_stream(f"{root}/dictionary.zstd") as f:
        f.write(dictionary)

    def shards(batches):
        for b in batches:
            at = np.searchsorted(np.array(bounds, np.int64), b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "shard"])

    code, wire = _compress(tokenizer_path, end_id, width, dictionary), "id long, n_tokens long, frame binary, shard int"
    # one Python pass: compress, then look up the shard
    frames = df.mapInArrow(lean(lambda batches: shards(code(batches))), wire)
    sorted_ = frames.repartitionById(n, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), F.xxhash64("frame"))
    made = sorted_.mapInArrow(lean(_write_shards(folder, width, digest)), "shard long, docs long, tokens long").collect()
    start, files = 0, []
    for r in sorted(made):
        files.append({"file": f"shard-{r.shard:06d}.tok", "start": start, "docs": r.docs, "tokens": r.tokens})
        start += r.tokens
    manifest = {"width": width, "end_id": end_id, "dictionary_sha256": digest.hex(), "tokens": start, "shards": files}
    with place.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _open(folder: str):
    place, root = fs.FileSystem.from_uri(folder)
    with place.open_input_stream(f"{root}/dictionary.zstd") as f:
        dictionary = f.read()
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return place, root, hashlib.sha256(dictionary).digest(), unpacker


def _index(file, digest: bytes) -> tuple[np.ndarray, int, int]:
    end = file.size()
    file.seek(end - struct.calcsize(FOOTER))
    at, n, width, seen, magic = struct.unpack(FOOTER, file.read(struct.calcsize(FOOTER)))
    if magic != MAGIC or seen != digest:
        raise ValueError("TOKEN_FILE_DICTIONARY_MISMATCH" if magic == MAGIC else "NOT_A_TOKEN_FILE")
    file.seek(at)
    return np.frombuffer(file.read(n * INDEX.itemsize), INDEX), width, at


def read_document(folder: str, doc_id: int) -> list[int] | None:
    """Ids of one document, by the manifest's shards and one frame; None where
    there is none."""
    place, root, digest, unpacker = _open(folder)
    with place.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    for shard in manifest["shards"]:
        with place.open_input_file(f"{root}/{shard['file']}") as f:
            index, width, end = _index(f, digest)
            at = np.flatnonzero((index["id"] == doc_id) & (index["null"] == 0))
            if len(at):
                i = int(at[0])
                stop = int(index["offset"][i + 1]) if i + 1 < len(index) else end
                f.seek(int(index["offset"][i]))
                return np.frombuffer(unpacker.decompress(f.read(stop - int(index["offset"][i]))), f"<u{width}").tolist()
    return None


def read_token_files(spark: SparkSession, folder: str, *, digest_only: bool = False) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids
    as little-endian unsigned 32-bit integers) and, unless ``digest_only``, ids."""
    place, root = fs.FileSystem.from_uri(folder)
    with place.open_input_stream(f"{root}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]

    def run(batches):
        place, root, digest, unpacker = _open(folder)
        for b in batches:
            for name, start in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("file", "start")), strict=True):
                with place.open_input_file(f"{root}/{name}") as f:
                    index, width, end = _index(f, digest)
                    starts = start + np.concatenate([[0], np.cumsum(index["n"])[:-1]]).astype(np.int64)
                    stops = np.append(index["offset"][1:], end)
                    for i in range(0, len(index), 1000):
                        crc, held, part = [], [], slice(i, i + 1000)
                        f.seek(int(index["offset"][i]))
                        for size in (stops[part] - index["offset"][part]).tolist():
                            ids = np.frombuffer(unpacker.decompress(f.read(int(size))), f"<u{width}").astype("<u4")
                            crc.append(zlib.crc32(ids.tobytes()))
                            held.append(ids)
                        own = index[part]
                        cols = [pa.array(own["id"], mask=own["null"].astype(bool)), pa.array(starts[part]), pa.array(own["n"].astype(np.int64)), pa.array(crc, pa.int64())]
                        if not digest_only:
                            cols.append(pa.array([x.astype(np.int64) for x in held], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(cols, ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    names = spark.createDataFrame([(s["file"], s["start"]) for s in shards], "file string, start long").repartition(max(1, len(shards)))
    return names.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>"))
