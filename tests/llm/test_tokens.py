"""BPE and token files against the libraries on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from turnloom.llm import bpe, token_files

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, "a", " ", "  x", "x  ", "a\n b", "\n\n  a\t\tb ", "don't we'll 12ab!? ..", "é\u0085x   y  z", "日本 語", "<|endoftext|> x", "\x1c a\x1f b", "x" * 700, " " * 900]


def noisy(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(["word", " ", "  ", "\n", "'re", "'", "12", "é", "!?", "\t ", " the", "日本"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    return [*ODD, *[noisy(i, 300) for i in range(8)], noisy(1, 300), "z" * 3000 + noisy(99, 500)]


def test_encoding_equals_whole_text(spark, texts):
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in enumerate(texts)], "doc_id long, text string, key string, ids int")
    got = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, P.PATTERN, chunk_chars=200, overlap_chars=40), RANKS).select("row.doc_id", "n_tokens", "ids", "decoded").collect()
    assert len(got) == len(texts)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for r in got:
        want = enc.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_encode(docs, RANKS, P.PATTERN).count() == 0


def test_token_files_round_trip(spark, texts, tmp_path):
    path = P.path("byte_bpe_50k.json")
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_token_files(docs, folder, path, shard_bytes=2000)
    assert len(manifest["shards"]) > 1
    got = token_files.read_token_files(spark, folder).collect()
    tok = Tokenizer.from_file(path)
    want = sorted(((-1 if i is None else i), [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows)
    got.sort(key=lambda r: r.start)
    assert sorted((-1 if r.id is None else r.id, r.ids) for r in got) == want
    assert [-1 if r.id is None else r.id for r in got] == [i for i, _ in want]
    start = 0
    for r in got:
        assert r.start == start and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert token_files.read_document(folder, 8) == dict(want)[8] and token_files.read_document(folder, 10**6) is None


def test_no_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, P.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, folder).count() == 0


def test_dictionary_is_bound_to_the_shards(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    token_files.write_token_files(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), folder, P.path("byte_bpe_50k.json"))
    (tmp_path / "d" / "dictionary.zstd").write_bytes(b"")
    assert token_files.read_document(folder, 1)
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_ids_are_the_librarys_on_any_text():
    """The ids of whole texts, on 10,000 random strings rich in what could tell them apart."""
    r = random.Random(5)
    texts = ["One two.\n\n\nThree four.", "a\n\n\nb", "\n\n", "", "a\r\n\r\nb c", "<|endoftext|>", "x<|endoftext|> y", "  ", "\u0085\x1c"]
    signs = ["word", " word", ".", "'s", "12", "\n", "\n\n", "\t\n", "  ", "é,", "\u00a0", "<|endoftext|>", "\x1c", "\u2028", "漢", "🙂", "\u0301", "A" * 70]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(9000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randint(1, 30))) for _ in range(1000)]
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts += [" ".join(r.choice(["one", "two.", "three,\nfour", "(x)", "é", "naïve.", "a\n\nb", "x's", "5.", "Q?!", "w" * 80, "z\u00a0y", "\ta"]) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    want = [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in token_files._encode_texts(path, pa.array(texts), 2)] == want
    some = token_files.PieceEncoder(path)
    for i in range(0, len(texts), 997):
        assert [[*x.tolist(), 2] for x in some.encode(pa.array(texts[i : i + 997]))] == want[i : i + 997]


def test_width_holds_every_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    folder, path = f"file://{tmp_path}/w", P.path("byte_bpe_50k.json")
    assert token_files.write_token_files(docs, folder, path, end_id=70_000)["width"] == 4
    assert token_files.read_document(folder, 1)[-1] == 70_000
    with pytest.raises(ValueError):
        token_files.write_token_files(docs, f"file://{tmp_path}/v", path, end_id=70_000, width=2)


def test_a_long_text_without_white_space(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab" * 300_000), (2, "x y " * 250_000)], "doc_id long, text string")
    folder, path = f"file://{tmp_path}/l", P.path("byte_bpe_50k.json")
    token_files.write_token_files(docs, folder, path)
    tok = Tokenizer.from_file(path)
    for i, t in ((1, "ab" * 300_000), (2, "x y " * 250_000)):
        assert token_files.read_document(folder, i) == [*tok.encode(t, add_special_tokens=False).ids, 2]
