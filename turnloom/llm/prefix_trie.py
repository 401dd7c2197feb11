"""A trie of conversations by their turns, with totals of every subtree.

A node is a distinct sequence of first turns. It is known by its depth and a hash of the
sequence; hashes of all prefixes of a conversation are running sums, made where the rows
lie in order, so a conversation of any length may span partitions: what comes before a
partition is one row for each (``carried``).

Totals go up by leaf-peeling message passing. The unit that peels is a *path*: each node
is owned by the member with the least random priority, and the nodes of an owner lie one
below the other. Along any way from the root the owner changes where the least priority
drops out, which happens about ln(members) times, so a few rounds end it, whatever the
depth: a chain of a million turns is one path. A path holds the number of paths that hang
from it and have not answered. Paths with none left send their totals to the path above,
whose counter goes down, until only the root's path is left. Each round is written to the
shared folder. Then a node's totals are the sums over its path from its bottom up to it,
of what its nodes have and what has been sent to them.

Hot nodes: members of a node are counted by partial aggregates; children find their
parent's row by a join, but for the parents of more than a thousandth of all nodes, of
which there are less than a thousand and which are broadcast; ends of conversations are
hashed by ``ordered_sha256``, without a list.

Defined cases: null role or text counts as empty; turns of a conversation are ordered by
turn (null first), equal turns by a hash of role and text; rows that are equal are turns
of their own; rows without a conversation's id belong to none and are left out; further
columns are ignored; no conversations, no nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import cut, lean, new_folder, worker_cache
from turnloom.operators.digests import ordered_sha256

# The largest primes below 2**31, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1284865837, 1779033703, 1013904242, 1359893119)
H, Q, G, W = ([f"{c}{i}" for i in range(4)] for c in "hqgw")
#: A parent of more nodes than this share of all is met by broadcast; so there are at
#: most 1 / SHARE of them. Below LEAST children nothing is hot.
SHARE, LEAST = 1e-3, 1000
WORDS = r"[^\x20\x09-\x0D]+"


def _powers(i: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, kept for the worker's life."""
    held = worker_cache(f"trie_powers_{i}", lambda: [np.ones(1, np.int64)])
    while len(held[0]) < n:
        held[0] = np.concatenate([held[0], held[0] * pow(BASES[i], len(held[0]), PRIMES[i]) % PRIMES[i]])
    return held[0][:n]


def _within(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before) -> np.ndarray:
    """Running sums that begin anew at each start; ``before`` is added to the first."""
    total = np.cumsum(values)
    base = total[starts] - values[starts]
    base[0] -= before
    return total - np.repeat(base, sizes)


def _carry(sums: list[str], hashed: bool):
    """Rows of a sorted partition with running sums by ``key``; ``edge`` marks the last row
    of the partition's first and last key, by which partitions are chained."""

    def run(batches):
        part, current, first, held = TaskContext.get().partitionId(), None, True, None
        before = dict.fromkeys([*sums, *H, "k"], 0)

        def mark(b):
            return b.set_column(b.schema.get_field_index("edge"), "edge", pa.array([True]))

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key = b.column(b.schema.get_field_index("key")).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(starts, append=n)
            if current is None or key[0] != current:
                if held is not None and first:
                    held, first = mark(held), False
                before = dict.fromkeys(before, 0)
            k = _within(np.ones(n, np.int64), starts, sizes, before["k"])
            cols = {"k": k} | {s: _within(b.column(b.schema.get_field_index(s)).to_numpy(), starts, sizes, before[s]) for s in sums}
            if hashed:
                x = np.frombuffer(b"".join(b.column(b.schema.get_field_index("x")).to_pylist()), "<u4").reshape(n, 4).astype(np.int64)
                for i, p in enumerate(PRIMES):
                    y = x[:, i] % p * _powers(i, int(k.max()) + 1)[k] % p
                    h = _within(y, starts, sizes, before[H[i]]) % p
                    cols |= {H[i]: h, Q[i]: (h - y) % p}
            edge = np.zeros(n, bool)
            if first and len(starts) > 1:
                edge[starts[1] - 1], first = True, False
            before = {c: int(cols[c][-1]) if c in cols else 0 for c in before}
            current = key[-1]
            out = pa.RecordBatch.from_arrays([*[c for m, c in zip(b.schema.names, b.columns, strict=True) if m not in sums], *[pa.array(c) for c in cols.values()], pa.array(np.full(n, part, np.int32)), pa.array(edge)], [*[m for m in b.schema.names if m not in sums], *cols, "part", "edge"])
            if held is not None:
                yield held
            if n > 1:
                yield out.slice(0, n - 1)
            held = out.slice(n - 1)
        if held is not None:
            yield mark(held)

    return run


def _bases(sums: list[str], hashed: bool):
    """From the edges in order of (key, part): what comes before a key's rows in a part."""
    names = ["k", *sums, *(H if hashed else [])]
    wire = pa.schema([("part", pa.int32()), ("key", pa.int64()), *[(f"b_{c}", pa.int64()) for c in names], *[(w, pa.int64()) for w in W if hashed]])

    def run(batches):
        current, total = None, {}
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["key"] != current:
                    current, total = row["key"], dict.fromkeys(names, 0)
                else:
                    out.append({"part": row["part"], "key": current} | {f"b_{c}": total[c] for c in names} | ({w: pow(BASES[i], total["k"], PRIMES[i]) for i, w in enumerate(W)} if hashed else {}))
                if hashed:
                    for i, p in enumerate(PRIMES):
                        total[H[i]] = (total[H[i]] + pow(BASES[i], total["k"], p) * row[H[i]]) % p
                for c in ["k", *sums]:
                    total[c] += row[c]
            if out:
                yield pa.RecordBatch.from_pylist(out, wire)

    return run


def carried(rows: DataFrame, key: str, order: list[Column], sums: list[str] = (), digest: str | None = None, *, name: str = "carried") -> DataFrame:
    """``rows`` with ``k`` (1, 2, ... within ``key``, in ``order``), the inclusive running
    sums of the long columns ``sums`` in their place and, for a 16-byte ``digest``, hashes
    of the sequence so far (h0 .. h3) and before this row (q0 .. q3). Keys are long and
    not null. A key may span partitions."""
    sums, spark = list(sums), rows.sparkSession
    df = rows.withColumnsRenamed({key: "key"} | ({digest: "x"} if digest else {}))
    sorted_ = df.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    schema = T.StructType([f for f in df.schema.fields if f.name not in sums])
    for c in ["k", *sums, *[c for pair in zip(H, Q, strict=True) for c in pair if digest]]:
        schema = schema.add(c, T.LongType())
    schema = schema.add("part", T.IntegerType()).add("edge", T.BooleanType())
    placed = cut(sorted_.mapInArrow(lean(_carry(sums, bool(digest))), schema), new_folder(spark, name))
    names = ["k", *sums, *(H if digest else [])]
    wire = ", ".join(["part int, key long", *[f"b_{c} long" for c in names], *[f"{w} long" for w in W if digest]])
    edges = placed.where("edge").select("key", "part", *names).repartition("key").sortWithinPartitions("key", "part")
    base = edges.mapInArrow(_bases(sums, bool(digest)), wire)  # a row for each partition at most
    out = placed.join(F.broadcast(base), ["part", "key"], "left")
    lifted = {c: F.col(c) + F.coalesce(f"b_{c}", F.lit(0)) for c in ("k", *sums)}
    if digest:
        for i, p in enumerate(PRIMES):
            for c in (H[i], Q[i]):
                lifted[c] = F.when(F.col("b_k").isNull(), F.col(c)).otherwise((F.col(f"b_{H[i]}") + F.col(W[i]) * F.col(c) % p) % p)
    out = out.withColumns(lifted).drop("part", "edge", *[f"b_{c}" for c in names], *(W if digest else []))
    return out.withColumnsRenamed({"key": key} | ({"x": digest} if digest else {}))


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, k (1 for the first turn), x (16 bytes of the turn's hash), words."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    x = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), x.alias("x"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    return carried(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("x")], name="turns").drop("turn")


def grafted(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared beginnings: the first h turns of conversation
    c - c % every, then the own turns after the first h, h = crc32(c) % most. From and to
    rows as ``ordered_turns`` makes them; the second result has every conversation's id."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = rows.where("k = 1").select("conv")
    heads = rows.where((F.col("k") < most) & (F.col("conv") % every == 0)).select(F.col("conv").alias("base"), "k", "x", "words")
    # a base has fewer than ``most`` heads and ``every`` conversations
    lead = convs.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % every).join(heads, "base").where("k <= h")
    own = rows.where(F.col("k") > h).select("conv", F.lit(1).alias("kind"), "k", "x", "words")
    both = lead.select("conv", F.lit(0).alias("kind"), "k", "x", "words").unionByName(own).withColumnRenamed("k", "at")
    return both, convs


def _priority(conv: str) -> Column:
    return F.struct(F.xxhash64(conv).alias("p"), F.col(conv).alias("c"))


def _parents(nodes: DataFrame, total: int) -> DataFrame:
    """``nodes`` of a depth above 1, with conv and owner of their parent."""
    kids = nodes.select("depth", *H, "conv", "owner", "n_children")
    up = kids.withColumn("depth", F.col("depth") + 1).withColumnsRenamed(dict(zip(H, Q, strict=True)) | {"conv": "parent_conv", "owner": "parent_owner"})
    key, hot = ["depth", *Q], max(LEAST, int(total * SHARE))
    found = nodes.where("depth > 1").join(F.broadcast(up.where(F.col("n_children") > hot).drop("n_children")), key, "left")
    cold = found.where("parent_owner IS NULL").drop("parent_conv", "parent_owner")
    return found.where("parent_owner IS NOT NULL").unionByName(cold.join(up.where((F.col("n_children") > 0) & (F.col("n_children") <= hot)).drop("n_children"), key))


def peel(paths: DataFrame, folder: str) -> DataFrame:
    """Messages (up, at, saved, leaves) of all paths but the root's. ``paths``: owner, up
    and at (the node above, by owner and depth; null for the root), remaining, saved,
    leaves. A round settles every path whose counter is 0."""
    state, n = cut(paths, f"{folder}/round-0"), 0
    sent = state.limit(0).select("up", "at", "saved", "leaves")
    while not state.isEmpty():
        done = state.where("remaining = 0").select("up", "at", "saved", "leaves")
        if done.isEmpty():
            raise RuntimeError("PEELING_STOPPED")
        sent = sent.union(done)
        told = done.where("up IS NOT NULL").groupBy(F.col("up").alias("owner")).agg(F.count("*").alias("n"), F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        open_ = state.where("remaining > 0").join(told, "owner", "left").na.fill(0, ["n", "s", "l"])
        n += 1
        state = cut(open_.withColumns({"remaining": F.expr("remaining - n"), "saved": F.expr("saved + s"), "leaves": F.expr("leaves + l")}).drop("n", "s", "l"), f"{folder}/round-{n}")
    return sent.where("up IS NOT NULL")


def prefix_trie(rows: DataFrame, convs: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id (null for
    the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1)
    times the words of each node's last turn) and ends_sha256 (of the ids, ascending, of
    conversations that end here). ``rows``: conv, x, words of every turn; ``order``: the
    order within a conversation; ``convs``: all ids, those without turns too."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "trie")
    turns = carried(rows.select("conv", "x", "words", *order), "conv", order, digest="x", name="prefixes").withColumnRenamed("k", "depth")
    made = turns.groupBy("depth", *H).agg(F.min("conv").alias("conv"), F.min(_priority("conv")).alias("owner"), F.count("*").alias("n_convs"), F.min("words").alias("words"), *[F.min(q).alias(q) for q in Q])
    made = cut(made.withColumn("owner", F.col("owner.c")), f"{folder}/made")
    kids = made.groupBy((F.col("depth") - 1).alias("depth"), *[F.col(q).alias(h) for q, h in zip(Q, H, strict=True)]).agg(F.count("*").alias("n_children"))
    nodes = cut(made.join(kids, ["depth", *H], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), f"{folder}/nodes")
    root = convs.agg(F.min("conv").alias("conv"), F.min(_priority("conv")).alias("owner"), F.count("*").alias("n_convs")).first()
    top = nodes.where("depth = 1").select(F.count("*").alias("n")).first().n
    ids = ["conv", "owner", "depth", *H, "n_convs", "n_children", "words", "parent_conv", "parent_owner"]
    conv, owner = root.conv, root.owner.c if root.owner else None
    first = nodes.where("depth = 1").withColumns({"parent_conv": F.lit(conv).cast("long"), "parent_owner": F.lit(owner).cast("long")})
    zero = spark.createDataFrame([(conv, owner, 0, 0, 0, 0, 0, root.n_convs, top, 0, None, None)] if root.n_convs else [], "conv long, owner long, depth long, h0 long, h1 long, h2 long, h3 long, n_convs long, n_children long, words long, parent_conv long, parent_owner long")
    full = zero.unionByName(first.select(*ids)).unionByName(_parents(nodes, nodes.count()).select(*ids))
    full = cut(full.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaves", (F.col("n_children") == 0).cast("long")), f"{folder}/full")
    tops = F.min(F.struct("depth", "parent_owner"))
    paths = full.groupBy("owner").agg(tops.alias("top"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), (F.sum("n_children") - F.count("*") + 1).alias("remaining"))
    sent = peel(paths.select("owner", F.col("top.parent_owner").alias("up"), (F.col("top.depth") - 1).alias("at"), "remaining", "saved", "leaves"), folder)
    inbound = sent.groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    summed = full.join(inbound, ["owner", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("s", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("l", F.lit(0))}).drop("s", "l")
    totals = carried(summed, "owner", [F.col("depth").desc()], ["saved", "leaves"], name="totals")
    last = turns.groupBy("conv").agg(F.max(F.struct("depth", *H)).alias("end"))
    ends = convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col(f"end.{c}"), F.lit(0).cast("long")).alias(c) for c in ("depth", *H)])
    hashed = ordered_sha256(ends, ["depth", *H], [F.col("conv")], "conv").drop("n")
    out = totals.join(hashed, ["depth", *H], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
