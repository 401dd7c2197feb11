"""The trie against dictionaries of whole prefixes."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from turnloom.llm import prefix_trie as trie
from turnloom.llm.queries import ORACLES, QUERIES
from turnloom.operators.digests import ordered_sha256

SF = "/root/testdata/sf0.001"


def brute(rows, graft=True):
    by, own = defaultdict(list), {}
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    by = {c: [v[2:] for v in sorted(turns)] for c, turns in by.items()}
    for c, v in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        own[c] = tuple(by.get(c - c % 20, [])[:h] + v[h:]) if graft else tuple(v)
    members, kids, total = defaultdict(list), defaultdict(list), {}
    for c, v in own.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    for s in sorted(members, key=len, reverse=True):
        saved = (len(members[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        total[s] = (0 if kids[s] else 1) + sum(total[k][0] for k in kids[s]), saved + sum(total[k][1] for k in kids[s])
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(own[c]) == len(s))))
        yield min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), *total[s], hashlib.sha256(ends.encode()).hexdigest()


def nodes(spark, rows, graft=True):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, owner int").repartition(5)
    turns = trie.ordered_turns(df)
    if graft:
        both, convs = trie.grafted(turns)
        return trie.prefix_trie(both, convs, [F.col("kind"), F.col("at")])
    return trie.prefix_trie(turns.withColumnRenamed("k", "at"), turns.where("k = 1").select("conv"), [F.col("at")])


def flawed():
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["u", None]), rnd.choice(["a b", "", "c", None])) for c in range(200) for t in range(rnd.randint(1, 6))]
    rows += [(1000 + c, t, "u", f"t{t % 3}") for c in range(2) for t in range(700 - 200 * c)] + [(None, 1, "u", "x"), (1, None, "u", "first")]
    return rows + [(2000 + i, t, "u", f"spine {t}" if t < i else f"leaf {i}") for i in range(30) for t in range(i + 1)] + [(3000 + i, t, "u", "same") for i in range(150) for t in range(3)]


def test_trie_of_any_shape(spark):
    for graft in (False, True):
        assert sorted(map(str, map(tuple, nodes(spark, flawed(), graft).collect()))) == sorted(map(str, brute(flawed(), graft)))


def test_hot_parents_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(trie, "LEAST", 3)
    rows = [(c, t, "u", "top" if not t else str(c)) for c in range(60) for t in range(2)]
    assert sorted(map(str, map(tuple, nodes(spark, rows, False).collect()))) == sorted(map(str, brute(rows, False)))


def test_no_conversations(spark):
    assert nodes(spark, []).collect() == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{os.path.join(SF, 'conversations.parquet')}'")
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES['op12_prefix_trie']})").fetchall()
    assert sorted(map(str, map(tuple, QUERIES["op12_prefix_trie"](spark, SF).select(*cols).collect()))) == sorted(map(str, want))


def test_digests_of_groups_across_partitions(spark):
    rows = [(g, i) for g, n in ((1, 500), (None, 3), (2, 1), (3, 200)) for i in range(n)]
    got = ordered_sha256(spark.createDataFrame(rows, "g int, i int").repartition(7), ["g"], [F.col("i")], "i", "|", chunk_chars=40).collect()
    assert {r.g: (r.n, r.sha256) for r in got} == {g: (n, hashlib.sha256("|".join(map(str, range(n))).encode()).hexdigest()) for g, n in ((1, 500), (None, 3), (2, 1), (3, 200))}
