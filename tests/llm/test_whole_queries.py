"""The registered queries and the pipeline against plain versions, on a small table."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from turnloom.llm import bpe
from turnloom.llm.decontaminate import Myers, budget, normalise
from turnloom.llm.importance import Resampler
from turnloom.llm.queries import LOST, ORACLES, QUERIES, WRONG
from turnloom.llm.transcripts import NONE, OUTSIDE, ROLES, STATES, fit, observe, with_lost_markers

sys.path.insert(0, os.path.dirname(__file__))
import test_block_anchors  # noqa: E402
import test_difference_cover  # noqa: E402
import test_jaccard_join  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def got(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF).collect()]


def encode(rows):
    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        yield i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def test_op2(spark, rows):
    same(got(spark, "op2_jaccard_join"), test_jaccard_join.brute(rows))


def test_op3(spark, rows):
    same(got(spark, "op3_block_anchors"), test_block_anchors.brute(rows, 20))


def test_op6(spark, rows):
    same(got(spark, "op6_bpe"), encode(rows))


def test_op7(spark, rows):
    same(got(spark, "op7_difference_cover"), test_difference_cover.brute(rows, 400))


def test_op10(spark, rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    want, start = [], 0
    for (i, _), e in zip(sorted(rows), Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch([t or "" for _, t in sorted(rows)], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(got(spark, "op10_token_files"), want)


M64 = (1 << 64) - 1


def mixed(x):
    """SplitMix64's finaliser on a plain integer."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_hash(word, seed):
    total = sum(mixed(mixed(i + (seed * 0x9E3779B97F4A7C15 & M64) & M64) + b * 0xD1342543DE82EF95 & M64) for i, b in enumerate(word))
    return mixed(total + len(word) * 0x9E3779B97F4A7C15 & M64)


def plain_features(text, bits):
    """Buckets of all unigrams and bigrams, from whole bytes."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x20\x09-\x0d]+", text.encode())
    h = [plain_hash(w, 3) for w in words]
    return [x >> 64 - bits for x in h] + [mixed(a * 0x9E3779B97F4A7C15 + b & M64) >> 64 - bits for a, b in zip(h, h[1:])]


def test_op8(spark, rows):
    """Weights, keys and the draw, made again without numpy or Spark."""
    good, labels = {}, pq.read_table(f"{SF}/labels.parquet").to_pylist()
    for r in labels:
        good[r["doc_id"]] = good.get(r["doc_id"], True) and r["quality"] == 1
    seen = {i: plain_features(t or "", 18) for i, t in rows}
    raw, target = Counter(), Counter()
    for i, f in seen.items():
        raw.update(f)
        if good.get(i):
            target.update(f)
    scale = sum(target.values()) / sum(raw.values())
    weight = {i: sum(round(math.log((target[b] + 20.0) / (raw[b] * scale + 20.0)) * 2**20) for b in f) / 2**20 for i, f in seen.items()}
    key = {}
    for i, w in weight.items():
        u = ((mixed(i * 0x9E3779B97F4A7C15 + 2045 & M64) >> 12) + 0.5) / 2.0**52
        key[i] = w - math.log(-math.log(u))
    share = sum(good.values()) / len(good)
    least = sorted(key.values(), reverse=True)[math.ceil(share * len(rows)) - 1]
    result = {r[0]: r[1:] for r in got(spark, "op8_importance")}
    assert len(result) == len(rows) and 0 < sum(r[2] for r in result.values()) < len(rows)
    for i in seen:
        assert result[i][0] == pytest.approx(weight[i], abs=1e-4) and result[i][1] == pytest.approx(key[i], abs=1e-4)
        assert result[i][2] == (key[i] >= least) or abs(key[i] - least) < 1e-4


def plain_viterbi(model, seen):
    """Best path, by a plain table of scores; of equal ones the lowest states from the end on."""
    best, back = [(0 if s == OUTSIDE else NONE) for s in range(STATES + 1)], []
    for marker, shape, _ in seen:
        come = [max(range(STATES + 1), key=lambda s: (best[s] + int(model.move[s, to]), -s)) for to in range(STATES + 1)]
        best = [max(best[come[to]] + int(model.move[come[to], to]), NONE) if to == STATES else max(best[come[to]] + int(model.move[come[to], to]), NONE) + int(model.marker[to, marker]) + int(model.shape[to, shape]) for to in range(STATES + 1)]
        best[STATES] = NONE
        back.append(come)
    path = [max(range(STATES + 1), key=lambda s: (best[s], -s))]
    for come in back[:0:-1]:
        path.append(come[path[-1]])
    return path[::-1]


def test_op1(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    flawed = with_lost_markers(turns, LOST, WRONG)
    want = {}
    for side in (0, 1):
        model, held = fit(turns.where(f"conv_id % 2 = {1 - side}")), {}
        for r in flawed.where(f"conv_id % 2 = {side}").collect():
            held.setdefault(r.conv_id, []).append(r)
        for conv, some in held.items():
            some.sort(key=lambda r: r.turn)
            lines = [(r, line) for r in some for line in ((r.role + ": " if r.role else "") + (r.text or "")).split("\n")]
            seen = [observe(line) for _, line in lines]
            rendered, begun = {r.turn: "" for r in some}, False
            for (r, line), (marker, _, size), state in zip(lines, seen, plain_viterbi(model, seen), strict=True):
                if state % 2 == 0:
                    rendered[r.turn] += ("<|im_end|>\n" if begun else "") + f"<|im_start|>{ROLES[state // 2]}\n{line[size:] if marker else line}"
                else:
                    rendered[r.turn] += ("\n" if begun else "") + line
                begun = True
            rendered[some[-1].turn] += "<|im_end|>\n"
            want |= {(conv, r.turn, r.truth, r.role, hashlib.sha256(rendered[r.turn].encode()).hexdigest()): 1 for r in some}
    result = got(spark, "op1_chat_format")
    assert len(result) == turns.count()
    same([(*r[:4], r[5]) for r in result], list(want))
    lost = [r[2] == r[4].split(",")[0] for r in result if r[3] is None]  # models of a handful of conversations
    assert sum(lost) >= len(lost) / 2 > 0


def test_op9(spark, rows):
    items = [(r["item_id"], normalise(r["text"])) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = []
    for item, s in items:
        m, most = Myers(s), budget(len(s), 0.05)
        want += [(i, item, d) for i, t in rows if (d := m.best(normalise(t))[0]) <= most]
    same(got(spark, "op9_decontamination"), want)
    assert want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    same(map(tuple, df.collect()), con.sql(f"SELECT {cols} FROM ({ORACLES[name]})").fetchall())


def test_pipeline(spark, rows):
    """Every stage's decision made again without Spark, but for the draw's keys."""
    scores = Resampler(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).draw()
    stay = {r.row.doc_id for r in scores.where("kept").collect()}
    last = {}
    for i, t in sorted(x for x in rows if x[0] in stay):
        last[t] = i
    docs = sorted((i, t) for t, i in last.items())
    docs = [(i, t) for (i, t), (_, _, c) in zip(docs, sorted(test_jaccard_join.brute(docs)), strict=True) if c == i]
    items = [(Myers(s), budget(len(s), 0.05)) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if (s := normalise(r["text"]))]
    clean = [(i, t) for i, t in docs if all(m.best(normalise(t))[0] > most for m, most in items)]
    assert len(clean) < len(docs) < len(rows)
    same([tuple(r) for r in corpus_pipeline.run(spark, SF).collect()], encode(clean))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, SF).columns) == sorted(docs.columns)
