"""Token links against the libraries on whole texts and loops over groups."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import sentencepiece
from tokenizers import Tokenizer

from turnloom.llm import alignment
from turnloom.llm.queries import QUERIES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "  a  b ", "a b c", "▁ x", "x ▁y z", "<|endoftext|> a <s> <0x41> b", "\n\nfoo\n bar \n", "日本語 テスト　全角", "x" * 5000, "a" * 100 + " " * 50 + "b" * 33, "😀 😀😀 é́ ñ", "a\u00a0b \u3000c \u2003d",
    "tab\t x \t y", "it 's don't I'll", "\x00 \x1c a b", "a b", "a b", " lead", "trail ", "1 2 33 4,5 67", " ".join(chr(i) for i in range(33, 3000)),
]


def brute(rows):
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in own]
    signs = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    found, held = {}, Counter()
    for n, (d, t) in enumerate(rows):
        found[n] = d, None
        if not t:
            continue
        a, b = a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)
        x = [bytes(signs[c] for c in a_lib.id_to_token(i)) for i in a]
        y = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(x) == b"".join(y) == f" {t}".encode():
            continue
        groups, i, j, at_a, at_b, left, right = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                left.append(a[i])
                at_a, i = at_a + len(x[i]), i + 1
            else:
                right.append(b[j])
                at_b, j = at_b + len(y[j]), j + 1
            if at_a == at_b and left and right:
                groups.append((left, right))
                left, right = [], []
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        held.update(set(links))
        found[n] = d, (len(a), len(b), groups, links)
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    for d, f in found.values():
        if f is None:
            yield d, 0, 0, 0, 0, 0, 0, ""
        else:
            text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in f[2])
            yield d, f[0], f[1], len(f[2]), len(f[3]), sum(held[x] == best[x[0]] for x in f[3]), sum(held[x] for x in f[3]), hashlib.sha256(text.encode()).hexdigest()


def test_odd_texts_in_small_slices(spark):
    rows = [*enumerate(ODD), (3, "a b c"), (3, "a b c"), (None, "x y")]
    df = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, slice string, at int").repartition(3)
    got = alignment.align(df, A, B, slice_bytes=300, part_pairs=100).select("row.doc_id", *alignment.COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_large_groups_go_by_distinct_ids(spark, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 3)
    a, b = np.array([5, 5, 7, 9]), np.array([1, 2, 1, 4])
    got = [alignment._counted(*x) for x in alignment._links(a, b, np.array([0, 3]), np.array([0, 0, 0, 1]), np.array([3, 1]), np.array([0, 3]), np.array([3, 1]), np.array([0, 1]))]
    flat = {(int(p), int(c) >> 32, int(c) & 0xFFFFFFFF): int(n) for x in got for p, c, n in zip(*x, strict=True)}
    assert flat == {(0, 5, 1): 4, (0, 5, 2): 2, (0, 7, 1): 2, (0, 7, 2): 1, (1, 9, 4): 1}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, row string")
    assert alignment.align(df, A, B).collect() == []


def test_whole_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert sorted(tuple(r) for r in QUERIES["op13_token_alignment"](spark, SF).collect()) == sorted(brute(rows))
