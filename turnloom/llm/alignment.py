"""Links between the tokens of two tokenizers over the same bytes.

Two tokenizers cut a text's bytes at different places. Where both end a token the bytes
are cut into *groups*; the tokens of a group belong together, and each pair of an A and a
B token in it is a link. For a slice of texts the byte ends of all tokens are cumulative
sums, the common cuts are an ``intersect1d`` of the ends, group labels come from
``searchsorted``, and links are made by repeating each A token once for every B token of
its group. How many documents hold an id pair linked is counted over the corpus by a
shuffle of two stages: sums within slices go to (pair, salt) first, so that a pair of
every slice does not meet in one task, then to the pair. Slices then ask for the counts
of the pairs that they hold, and documents are sums over them.

What makes it cheap: neither tokenizer joins bytes across a single space between two
characters that are not white space. So a text is cut there, both tokenizers and the
alignment see each distinct piece of a slice once, and a document is a list of pieces.
Texts without such spaces are one piece. Whether this holds is read from the vocabularies
(``Pair``), and otherwise every text is one piece.

Memory: a worker holds one slice of ``slice_bytes`` (a longer text is a slice of its own)
and what it makes of it. The products of very large groups are made in blocks and from
their distinct ids, of which there are no more than the vocabularies have. Sums of an A
id's pairs meet in one task; they are at most as many as B has ids. What a scan has found
stays in files of the shared folder and is not shuffled; a task that is run again writes
other files, and those of its lost attempt are named nowhere.

Defined cases: a null or empty text, and one whose tokens do not give its bytes back, has
no tokens: zeros and an empty digest, and it adds nothing to the counts. Rows with equal
ids and equal texts are documents of their own. Other columns travel in the struct
``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import U64, cut, lean, mix, new_folder, packed, steps, text_buffers, worker_cache
from turnloom.llm.exchange import part_of

#: Text bytes of a slice; questions in a part; links of a block; salts of a pair.
SLICE_BYTES, EACH, LINKS, SALTS = 4 << 20, 2_000_000, 2_000_000, 16
#: Pieces whose groups are written out at once.
PIECES = 200_000
#: Bytes of a piece from which the library encodes it, whose time does not grow with the square.
LONG = 2000
# First two bytes of white space beyond ASCII.
_WIDE = (0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380)


def _wide() -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[list(_WIDE)] = True
    return out


WIDE = _wide()


def byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte, reversed:
    printable Latin-1 stands for itself, the other bytes for signs from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_table(tokens: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(tokens, pa.large_binary()), np.array([len(t) for t in tokens], np.int64)


class Pair:
    """Both tokenizers: ids of pieces, bytes of ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        signs, vocab = byte_signs(), self.a.get_vocab(with_added_tokens=True)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        spelled = {i: (t.encode() if t in special else bytes(signs[c] for c in t)) for t, i in vocab.items()}
        a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        (self.a_bytes, self.a_len), (self.b_bytes, self.b_len) = _byte_table(a_bytes), _byte_table(b_bytes)
        self.a_opens = np.array([t[:1] == b" " for t in a_bytes])
        self.b_opens = np.array([p[:1] == "▁" for p in pieces])
        # do both leave a single space between other signs alone?
        before = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        self.cuts = bool(before) and not any("▁" in p.lstrip("▁") for p in pieces) and self.b.encode("x ") != self.b.encode("x")
        self.fast = self._ranks(spec, spelled, special) if before else None
        self.signs = pa.array([f"{i}{c}".encode() for i in range(len(a_bytes)) for c in ",|"] + [f"{i}{c}".encode() for i in range(len(b_bytes)) for c in ",;"], pa.large_binary())

    @staticmethod
    def _ranks(spec: dict, spelled: dict[int, bytes], special: dict[str, int]):
        """The same encoding by ranks, where every merge makes the next id."""
        import public_tokenizers
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab, ranks = spec["model"]["vocab"], {t: i for i, t in spelled.items() if i not in special.values()}
        if spec["model"].get("type") != "BPE" or any(vocab[x + y] != 256 + i for i, (x, y) in enumerate(merges)) or len(ranks) != 256 + len(merges):
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole_a(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) < LONG:
            return self.fast.encode_to_numpy(text).astype(np.int64)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def ids(self, pieces: pa.Array, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids and their number by piece, B ids and their number, in the order of the
        pieces (each begins with a space; ``data`` and ``edges`` are their bytes)."""
        n, size = len(pieces), np.diff(edges)
        spaces = np.concatenate([[0], np.cumsum(data == 0x20)])
        pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        last = edges[1:] - 1
        plain = (spaces[edges[1:]] - spaces[edges[:-1]] == 1) & (size > 1) & (size < LONG) & self.cuts
        plain &= (pad[last] > 0x20) & (pad[edges[:-1] + 1] > 0x20)
        plain &= ~WIDE[pad[edges[:-1] + 1] << 8 | pad[edges[:-1] + 2]] & ~WIDE[pad[last - 1] << 8 | pad[last]] & ~WIDE[pad[np.maximum(last - 2, 0)] << 8 | pad[last - 1]]
        texts = pieces.cast(pa.binary() if len(data) < 1 << 31 else pa.large_binary()).cast(pa.string() if len(data) < 1 << 31 else pa.large_string()).to_pylist()
        easy, hard = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        sides = []
        for block, opens, join, each in ((20_000, self.a_opens, self._joined_a, self._whole_a), (256, self.b_opens, self._joined_b, lambda t: np.array(self.b.encode(t[1:]), np.int64))):
            out, count = [None] * len(hard), np.zeros(n, np.int64)
            for k, i in enumerate(hard):
                out[k] = each(texts[i])
                count[i] = len(out[k])
            runs = []
            for k in range(0, len(easy), block):
                some = easy[k : k + block]
                ids = join("".join([texts[i] for i in some]))
                at = np.flatnonzero(opens[ids])
                if len(at) != len(some) or at[0] != 0:  # a sign that looks like a space
                    got = [each(texts[i]) for i in some]
                    ids, sizes = np.concatenate(got), np.array([len(x) for x in got])
                else:
                    sizes = np.diff(at, append=len(ids))
                count[some] = sizes
                runs.append(ids)
            flat = np.concatenate([*runs, *out]) if runs or out else np.zeros(0, np.int64)
            order = np.concatenate([easy, hard]).astype(np.int64)
            begin = np.empty(n, np.int64)
            begin[order] = np.cumsum(count[order]) - count[order]
            sides += [flat[_spans(begin, count)], count]
        return tuple(sides)

    def _joined_a(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text).astype(np.int64) if self.fast is not None else np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def _joined_b(self, text: str) -> np.ndarray:
        return np.array(self.b.encode(text[1:]), np.int64)


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, and so on for every entry."""
    total = int(count.sum())
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(total)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


def _pieces(texts: pa.Array, cuts: bool) -> tuple[pa.Array, np.ndarray]:
    """Pieces of " " + text, and n + 1 offsets into them for the texts."""
    data, offsets = text_buffers(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string())))
    starts = offsets[:-1]
    if cuts:
        pad = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])
        p = np.flatnonzero(data == 0x20) + 3
        p = p[(pad[p - 1] > 0x20) & (pad[p + 1] > 0x20)]
        pair = lambda i: pad[i].astype(np.int64) << 8 | pad[i + 1]
        p = p[~WIDE[pair(p + 1)] & ~WIDE[pair(p - 2)] & ~WIDE[pair(p - 3)]]
        starts = np.union1d(starts, p - 3)
    edges = np.append(starts, len(data))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(edges)), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.append(np.searchsorted(starts, offsets[:-1]), len(starts))


def _same(table: pa.Array, length: np.ndarray, ids: np.ndarray, count: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Pieces whose bytes the ids give back."""
    at = np.concatenate([[0], np.cumsum(count)])
    fine = _sums(length[ids], at) == np.diff(edges)
    own = np.repeat(fine, count)
    got = text_buffers(table.take(pa.array(ids[own])))[0]
    want = data[_spans(edges[:-1][fine], np.diff(edges)[fine])]
    differ = np.zeros(int(fine.sum()), bool)
    wrong = np.flatnonzero(got != want)
    if len(wrong):
        differ[np.searchsorted(np.cumsum(np.diff(edges)[fine]), wrong, "right")] = True
    fine[np.flatnonzero(fine)[differ]] = False
    return fine


def _links(a: np.ndarray, b: np.ndarray, first_b: np.ndarray, group_a: np.ndarray, n_b: np.ndarray, first_a: np.ndarray, n_a: np.ndarray, piece: np.ndarray):
    """(piece, a << 32 | b, number) of all links, block by block: every A token is
    repeated for each B token of its group. A group of more than a block goes by its
    distinct ids."""
    size = n_a * n_b
    large = size > LINKS
    todo = np.flatnonzero(~large[group_a])
    each = n_b[group_a[todo]]
    ends = np.cumsum(each)
    i = 0
    while i < len(todo):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LINKS, "right")))
        own, count = todo[i:j], each[i:j]
        g = group_a[own]
        partner = b[_spans(first_b[g], count)]
        yield np.repeat(piece[g], count), np.repeat(a[own], count) << 32 | partner, None
        i = j
    for g in np.flatnonzero(large).tolist():
        ids, times = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        to, more = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        step = max(1, LINKS // len(to))
        for k in range(0, len(ids), step):
            code = (ids[k : k + step, None] << 32 | to).ravel()
            yield np.full(len(code), piece[g]), code, (times[k : k + step, None] * more).ravel()


class Aligned:
    """What the distinct pieces of a slice are: counts, the text of their groups, and
    their pairs as (first, entries, pair, times)."""

    def __init__(self, pair: Pair, pieces: pa.Array):
        data, edges = text_buffers(pieces)
        a, count_a, b, count_b = pair.ids(pieces, data, edges)
        self.fine = _same(pair.a_bytes, pair.a_len, a, count_a, data, edges) & _same(pair.b_bytes, pair.b_len, b, count_b, data, edges)
        a, b = a[np.repeat(self.fine, count_a)], b[np.repeat(self.fine, count_b)]
        self.n_a, self.n_b = np.where(self.fine, count_a, 0), np.where(self.fine, count_b, 0)
        ends_a, ends_b = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        piece_ends = np.cumsum(np.where(self.fine, np.diff(edges), 0))
        piece = np.searchsorted(piece_ends, cuts)  # pieces without bytes here come after their predecessor's end
        n = len(pieces)
        self.n_groups, self.n_links = np.bincount(piece, minlength=n), np.bincount(piece, weights=in_a * in_b, minlength=n).astype(np.int64)
        # the text of groups: A tokens of a group, then its B tokens
        seq = np.empty(len(a) + len(b), np.int64)
        i, j = np.arange(len(a)), np.arange(len(b))
        seq[i + first_b[group_a]] = 2 * a + (i + 1 == (first_a + in_a)[group_a])
        seq[j + (first_a + in_a)[group_b]] = 2 * (len(pair.a_len) + b) + (j + 1 == (first_b + in_b)[group_b])
        text, at = text_buffers(pair.signs.take(pa.array(seq)))
        where = at[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        self.text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(where)), pa.py_buffer(np.ascontiguousarray(text))])
        found = [_counted(*x) for x in _links(a, b, first_b, group_a, in_b, first_a, in_a, piece)]
        own, code, times = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        if len(found) > 1:
            own, code, times = _counted(own, code, times)
        # pairs of the slice in the order of their hash, whose ranges are the parts
        mixed = mix(code.astype(U64))
        self.pairs, self.pair = np.unique(mixed, return_inverse=True)
        self.ids = np.zeros(len(self.pairs), np.int64)
        self.ids[self.pair] = code >> 32
        self.times, self.entries = times, np.bincount(own, minlength=n)
        self.first = np.cumsum(self.entries) - self.entries


def _counted(piece: np.ndarray, code: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (piece, code) in ascending order of the piece, and their numbers."""
    order = np.lexsort((code, piece))
    piece, code = piece[order], code[order]
    new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (code[1:] != code[:-1])]) if len(piece) else np.zeros(0, bool))
    if times is None:
        return piece[new], code[new], np.diff(new, append=len(piece))
    return piece[new], code[new], np.add.reduceat(times[order], new) if len(new) else times


def _blob(x: np.ndarray, kind: str = "<u4") -> bytes:
    return np.ascontiguousarray(x.astype(kind)).tobytes()


def _slice(pair: Pair, rows: pa.Array, texts: pa.Array) -> tuple[pa.Table, pa.Table, Aligned, np.ndarray]:
    """Documents and pieces of a slice as they are kept, and the number of documents
    of each pair."""
    n = len(texts)
    real = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    words, at = _pieces(texts.take(pa.array(real)), pair.cuts)
    coded = words.dictionary_encode()
    got, index = Aligned(pair, coded.dictionary), coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(real)), np.diff(at))
    bad = _sums(~got.fine[index], at) > 0
    whole = _sums(got.n_a[index], at), _sums(got.n_b[index], at), _sums(got.n_groups[index], at), _sums(got.n_links[index], at)
    sha, cols = [""] * n, [np.zeros(n, np.int64) for _ in whole]
    place = real.tolist()
    for x, y in steps(at, PIECES):  # documents of so many pieces: their groups' text is several times theirs
        text, where = text_buffers(got.text.take(pa.array(index[at[x] : at[y]])))
        view, ends = memoryview(np.ascontiguousarray(text)), where[at[x : y + 1] - at[x]].tolist()
        for k in range(x, y):
            if not bad[k]:
                sha[place[k]] = hashlib.sha256(view[ends[k - x] : ends[k - x + 1] - 1]).hexdigest()
    for col, x in zip(cols, whole, strict=True):
        col[real] = np.where(bad, 0, x)
    # distinct pieces of a document, with their number
    stay = ~bad[doc]
    seen, times = np.unique(doc[stay] * len(got.fine) + index[stay], return_counts=True)
    owner, kind = seen // max(1, len(got.fine)), seen % max(1, len(got.fine))
    edge = np.searchsorted(owner, np.arange(len(real) + 1))
    idx, num = [b""] * n, [b""] * n
    for k, i in enumerate(real.tolist()):
        idx[i], num[i] = _blob(kind[edge[k] : edge[k + 1]]), _blob(times[edge[k] : edge[k + 1]])
    # documents of each pair, some documents at a time
    docs = np.zeros(len(got.pairs), np.int64)
    weight, k = np.concatenate([[0], np.cumsum(got.entries[kind])]), 0
    while k < len(real):
        z = max(k + 1, int(np.searchsorted(weight[edge], weight[edge[k]] + LINKS, "right")) - 1)
        s = slice(edge[k], edge[min(z, len(real))])
        own = np.repeat(owner[s], got.entries[kind[s]]) * max(1, len(got.pairs)) + got.pair[_spans(got.first[kind[s]], got.entries[kind[s]])]
        docs += np.bincount(np.unique(own) % max(1, len(got.pairs)), minlength=len(got.pairs))
        k = z
    held = pa.table({"row": rows, "n_a": cols[0], "n_b": cols[1], "n_groups": cols[2], "n_links": cols[3], "groups_sha256": sha, "idx": pa.array(idx, pa.binary()), "num": pa.array(num, pa.binary())})
    pieces = pa.table({"entries": pa.array([_blob(got.entries)], pa.binary()), "pair": pa.array([_blob(got.pair)], pa.binary()), "times": pa.array([_blob(got.times)], pa.binary())})
    return held, pieces, got, docs


def _slices(batches, limit: int):
    """(rows, texts) of about ``limit`` text bytes."""
    held, size = [], 0
    for b in batches:
        offsets = text_buffers(b.column(b.schema.get_field_index("text")))[1]
        for i, j in steps(offsets, limit):
            if held and size + int(offsets[j] - offsets[i]) > limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(b.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _align(folder: str, a_path: str, b_path: str, limit: int):
    """Write what the slices of a task hold to one file; a row for each slice."""

    def run(batches):
        pair = worker_cache(f"pair_{a_path}_{b_path}", lambda: Pair(a_path, b_path))
        place, root = fs.FileSystem.from_uri(folder)
        name, out, at = f"{uuid.uuid4().hex}.arrows", None, 0
        for t in _slices(batches, limit):
            if not t.num_rows:
                continue
            held, pieces, got, docs = _slice(pair, _one(t.column("row")), _one(t.column("text")))
            sink = pa.BufferOutputStream()
            for table in (pieces, held):
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(table)
            blob = sink.getvalue()
            if out is None:
                place.create_dir(root, recursive=True)
                out = place.open_output_stream(f"{root}/{name}")
            out.write(blob)
            key = int.from_bytes(uuid.uuid4().bytes[:8], "little") >> 1
            yield pa.RecordBatch.from_pydict({"slice": pa.array([key], pa.int64()), "file": [name], "at": pa.array([at], pa.int64()), "n": pa.array([len(got.pairs)], pa.int64()), "pairs": pa.array([_blob(got.pairs, "<u8")], pa.binary()), "ids": pa.array([_blob(got.ids)], pa.binary()), "docs": pa.array([_blob(docs)], pa.binary())})
            at += len(blob)
        if out is not None:
            out.close()

    return run


def _exploded(batches):
    """pair, a, docs, salt: a row for each pair of a slice."""
    for b in batches:
        for key, pairs, ids, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cols = [np.frombuffer(pairs, "<i8"), np.frombuffer(ids, "<u4").astype(np.int32), np.frombuffer(docs, "<u4").astype(np.int64)]
            for i in range(0, len(cols[0]), 50_000):
                some = [pa.array(c[i : i + 50_000]) for c in cols]
                yield pa.RecordBatch.from_arrays([*some, pa.array(np.full(len(some[0]), key % SALTS, np.int32))], ["pair", "a", "docs", "salt"])


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is the highest of its A id)."""
    rows = slices.select("slice", "pairs", "ids", "docs").mapInArrow(_exploded, "pair long, a int, docs long, salt int")
    salted = rows.groupBy("pair", "a", "salt").agg(F.sum("docs").alias("docs"))
    n = salted.groupBy("pair", "a").agg(F.sum("docs").alias("n"))
    n = cut(n, new_folder(slices.sparkSession, "pairs"))
    most = n.groupBy("a").agg(F.max("n").alias("most"))  # no more rows than A has ids
    return n.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _asked(parts: int):
    def run(batches):
        for b in batches:
            for key, pairs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = np.frombuffer(pairs, "<u8")
                part = part_of(h, parts)
                at = np.flatnonzero(np.diff(part, prepend=-1))
                blobs = [h[x:y].tobytes() for x, y in zip(at, np.append(at[1:], len(h)), strict=True)]
                n = len(at)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array([key] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(blobs, pa.binary())], ["part", "slice", "pair", "n", "best", "asked"])

    return run


def _parted(parts: int):
    def run(batches):
        for b in batches:
            part = part_of(b.column(0).to_numpy().view(U64), parts).astype(np.int32)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(n, pa.int64()), *b.columns, pa.nulls(n, pa.binary())], ["part", "slice", "pair", "n", "best", "asked"])

    return run


def _answered(batches):
    """Rows of a part: its counts first, then the slices' questions."""
    part, held, table = None, [], None
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        own = col["part"].to_numpy()
        for x, y in itertools.pairwise([*np.flatnonzero(np.diff(own, prepend=-1)).tolist(), len(own)]):
            if own[x] != part:
                part, held, table = own[x], [], None
            told = col["asked"].slice(x, y - x).is_null().to_numpy(zero_copy_only=False)
            k = int(told.sum())
            if k:  # counts come before questions
                held.append((col["pair"].slice(x, k).to_numpy().view(U64), col["n"].slice(x, k).to_numpy(), col["best"].slice(x, k).to_numpy(zero_copy_only=False)))
            if k == y - x:
                continue
            if table is None:
                pair, n, best = (np.concatenate([h[i] for h in held]) for i in range(3))
                order = np.argsort(pair)
                table, held = (pair[order], n[order], best[order]), []
            for key, asked in zip(col["slice"].slice(x + k).to_pylist()[: y - x - k], col["asked"].slice(x + k).to_pylist()[: y - x - k], strict=True):
                at = np.searchsorted(table[0], np.frombuffer(asked, "<u8"))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([part], pa.int32()), pa.array([None], pa.string()), pa.nulls(1, pa.int64()), pa.array([_blob(table[1][at], "<i8")], pa.binary()), pa.array([np.packbits(table[2][at]).tobytes()], pa.binary())], ["slice", "part", "file", "at", "counts", "best"])


#: Columns of a document beside ``row``.
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _settle(folder: str):
    """Rows of a slice: where it lies, then the answers of all parts in their order."""

    def finish(where, counts, bests):
        place, root = fs.FileSystem.from_uri(folder)
        with place.open_input_file(f"{root}/{where[0]}") as f:
            f.seek(where[1])
            pieces, held = (pa.ipc.open_stream(f).read_all() for _ in range(2))
        n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(c, "<i8") for c in counts]])
        best = np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(x, np.uint8), count=len(c) // 8) for c, x in zip(counts, bests, strict=True)]]).astype(np.int64)
        entries, pair, times = (np.frombuffer(pieces.column(k)[0].as_py(), "<u4").astype(np.int64) for k in ("entries", "pair", "times"))
        edges = np.concatenate([[0], np.cumsum(entries)])
        total, tops = _sums(times * n[pair], edges), _sums(times * best[pair], edges)
        idx, at = text_buffers(_one(held.column("idx")))
        idx, num = idx.view("<u4"), text_buffers(_one(held.column("num")))[0].view("<u4").astype(np.int64)
        n_best, count_sum = _sums(num * tops[idx], at // 4), _sums(num * total[idx], at // 4)
        out = held.drop_columns(["idx", "num"]).add_column(5, "n_best", pa.array(n_best)).add_column(6, "count_sum", pa.array(count_sum))
        yield from out.combine_chunks().to_batches(max_chunksize=5000)

    def run(batches):
        key, where, counts, bests = None, None, [], []
        for b in batches:
            for k, _, file, at, count, best in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if where:
                        yield from finish(where, counts, bests)
                    key, where, counts, bests = k, (file, at), [], []
                else:
                    counts.append(count)
                    bests.append(best)
        if where:
            yield from finish(where, counts, bests)

    return run


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", *, slice_bytes: int = SLICE_BYTES, part_pairs: int = EACH) -> DataFrame:
    """row, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair's count is
    the highest of its A id), count_sum (over links) and groups_sha256 (of the ids by
    group, ``a1,a2|b1;a3|b2,b3``): one row for each of ``docs``. The tokenizers' files
    must exist on every worker."""
    spark, df = docs.sparkSession, packed(docs, text_col)
    folder = new_folder(spark, "aligned")
    wire = "slice long, file string, at long, n long, pairs binary, ids binary, docs binary"
    slices = cut(df.mapInArrow(lean(_align(f"{folder}/found", a_path, b_path, slice_bytes)), wire), f"{folder}/slices")
    asked = slices.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-asked // part_pairs))
    cells = "part int, slice long, pair long, n long, best boolean, asked binary"
    told = pair_counts(slices).mapInArrow(_parted(parts), cells)
    questions = slices.select("slice", "pairs").mapInArrow(_asked(parts), cells)
    met = told.union(questions).repartitionById(parts, "part").sortWithinPartitions("part", F.col("slice").asc_nulls_first())
    answers = met.mapInArrow(lean(_answered), "slice long, part int, file string, at long, counts binary, best binary")
    lies = slices.select("slice", F.lit(-1).alias("part"), "file", "at", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"))
    back = lies.union(answers).repartition("slice").sortWithinPartitions("slice", "part")
    types = {"groups_sha256": T.StringType()}
    schema = T.StructType([T.StructField("row", df.schema["row"].dataType), *[T.StructField(c, types.get(c, T.LongType())) for c in COLUMNS]])
    return back.mapInArrow(lean(_settle(f"{folder}/found")), schema)
