"""Near-duplicate join on word shingles with adaptive multi-match prefixes.

Documents with the same set of shingles form a *class* at once (by two 64-bit set
fingerprints), so copies never meet each other as pairs. Rows are frozen first (see
``frozen``); a class is found again by the place of one of its rows. For the classes:

1. An exchange (see ``exchange``) tells how many documents hold each shingle, on a
   scale of powers of two; a set is ordered from rare to common. A shingle that only
   one document holds can meet nobody and is never posted.
2. A set of n shingles that must share ``ceil(t * n)`` with any partner has a
   prefix of ``n - ceil(t * n) + L`` shingles, of which a partner must hold at
   least ``L``. Each set takes the L in 1..``max_match`` with the least estimated
   cost: the postings read, and the candidates left to verify when L matches are
   demanded (their estimated number falls with L). Two sets meet with the smaller
   of their Ls; every posting carries the L from which it counts.
3. Postings are dealt by shingle into buckets. All members of a bucket meet its
   central one, the member whose shingles are the most common (linear, whatever the
   bucket's size). Pairs with enough matches are verified on the full sets, and
   links are contracted to components.
4. Links inside a component would change nothing; what is left are members of one
   bucket in different components. In buckets of up to ``SMALL`` members they all
   meet, and again all matches of a pair, those in buckets of two included, are
   counted before verification. Members of larger
   buckets are compared inside one task as a product of incidence matrices, in
   blocks, and the task returns only the links that join components, one for each
   at most. A second contraction ends it.

So the pairs of a group are never listed, and no bucket is capped: the result is
the exact transitive closure of ``J >= threshold``.

Defined cases: null texts and texts without words have no shingle, link with
nothing and are their own component; a text with fewer than k words has its whole
word sequence as its shingle; repeated rows are linked by equal sets; a null id
is never a component's name unless all ids of the component are null.
Shingles are compared by 64-bit hashes of their words' hashes, and by 48 bits of
them where two given sets are verified.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import U64, cut, lean, mix, new_folder, steps, window_hashes, word_hashes, word_spans
from turnloom.llm.exchange import answers, exchange, parts_for
from turnloom.llm.frozen import Frozen, Unit, freeze, unpacked
from turnloom.operators.components import connected_components

#: Cost of verifying a candidate, in shingles of its set, against reading a posting.
VERIFY_COST = 0.05
#: Members of a bucket that may all meet as pairs.
SMALL = 24
#: Members of a larger bucket that one task compares with as many others.
BLOCK = 1500
#: Bits of the answer that tells how many documents hold a shingle: powers of two up to 2 ** 31.
SCALE_BITS = 5


@dataclass(frozen=True)
class Rule:
    k: int = 5
    num: int = 3  # threshold num / den
    den: int = 4
    max_match: int = 4
    min_match: int = 1
    class_bits: int = 64  # fewer force clashes of class numbers (tests)

    def need(self, n):
        return -(-self.num * n // self.den)


def shingle_sets(u: Unit, k: int):
    """Sorted distinct 64-bit shingles of every document of a unit."""
    for i, j in steps(u.offsets):
        part, at = u.data[u.offsets[i] : u.offsets[j]], u.offsets[i : j + 1] - u.offsets[i]
        starts, ends, word_at = word_spans(part, at)
        words = word_hashes(part, starts, ends, lower=True)
        shingles = window_hashes(words, k)
        for d in range(j - i):
            a, b = word_at[d], word_at[d + 1]
            if b - a >= k:
                yield np.unique(shingles[a : b - k + 1])
            elif b > a:
                yield mix(window_hashes(words[a:b], b - a) + U64(b - a))
            else:
                yield np.zeros(0, U64)


def _unit_shingles(u: Unit, k: int):
    """The sets of a unit, its distinct shingles, and how many of the unit's sets hold each."""
    sets = list(shingle_sets(u, k))
    flat = np.concatenate([np.zeros(0, U64), *sets])
    found, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    return sets, found, place, count


def _holders(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Scale of the number of documents that hold each shingle: 0 for one, s for 2**s up
    to twice as many."""
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.diff(h[order], prepend=h[order][:1] + U64(1)))
    total = np.add.reduceat(count[order].astype(np.int64), at)
    out = np.zeros(len(h), np.uint8)
    out[order] = np.repeat(np.minimum(np.log2(total), (1 << SCALE_BITS) - 1).astype(np.uint8), np.diff(at, append=len(h)))
    return out


def class_of(s: np.ndarray, rule: Rule, renamed: dict) -> tuple[int, int]:
    """Class number and check of a set; ``renamed`` holds numbers of their own for sets
    whose numbers clash."""
    a, b = fingerprints(s)
    a >>= 64 - rule.class_bits
    return renamed.get((a, b), a), b


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set, as signed 64-bit integers."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a = mix(np.add.reduce(mix(s + U64(11)), keepdims=True) + U64(len(s)))
        b = mix(np.add.reduce(mix(s ^ U64(0x5DEECE66D)), keepdims=True))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def choose_match(counts: np.ndarray, rule: Rule) -> int:
    """L for a set whose estimated counts, rare to common, are given."""
    n = len(counts)
    base = n - rule.need(n) + 1
    seen = np.cumsum(counts[: base + rule.max_match - 1] - 1.0)
    best, least = min(rule.min_match, n - base + 1), math.inf
    for m in range(rule.min_match, rule.max_match + 1):
        if base + m - 1 > n:
            break
        read = seen[base + m - 2]
        cost = read + VERIFY_COST * n * read / m
        if cost < least:
            best, least = m, cost
    return best


def _posting(s: np.ndarray, scale: np.ndarray, rule: Rule):
    """Shingles of a set's prefix that others hold too, and for each level + 16 L,
    grade of the set's size and grade of its commonness."""
    order = np.lexsort((s, scale))
    est = np.exp2(scale[order].astype(float))
    match = choose_match(est, rule)
    base = len(s) - rule.need(len(s)) + 1
    take = order[: base + match - 1]
    level = np.maximum(np.arange(len(take)) - base + 2, 1)
    shared = scale[take] > 0
    take, level = take[shared], level[shared]
    grade = min(255, int(8 * math.log2(len(s))))
    centre = min(255, int(8 * math.log2(1 + float(est.mean()))))
    return s[take], np.stack([(level + 16 * match).astype(np.uint8), np.full(len(take), grade, np.uint8), np.full(len(take), centre, np.uint8)], axis=1)


def _survey(rule: Rule, scales: str, parts: int, renamed: dict, schema: pa.Schema, flush: int = 1_000_000):
    """Rows of sets (kind 0) and blobs of (shingle, class, level + L, size) by part of
    the shingle space (kind 1)."""

    def block(count: int, **cols):
        return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(count, f.type) for f in schema], schema=schema)

    def emit(held):
        s, c, m = (np.concatenate([h[i] for h in held]) for i in range(3))
        part = (s % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        s, c, m, part = s[order], c[order], m[order], part[order]
        at = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(at[1:], len(part))
        # 40 bits of a shingle are enough here: a clash makes a candidate, never a link
        five = (mix(s) >> U64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
        blobs = {k: pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for k, x in (("s", five), ("c", c), ("m", m))}
        return block(len(at), kind=pa.array([1] * len(at), pa.int32()), part=pa.array(part[at].astype(np.int32)), **blobs)

    def run(units):
        seen, held, size = set(), [], 0
        for u in units:
            sets, found, place, _ = _unit_shingles(u, rule.k)
            scale = answers(scales, u.number, found, SCALE_BITS)[place]
            n, cls, chk, at = [len(s) for s in sets], [], [], 0
            for s in sets:
                a, b = class_of(s, rule, renamed)
                cls.append(a)
                chk.append(b)
                own = scale[at : at + len(s)]
                at += len(s)
                if not len(s) or (a, b) in seen:
                    continue
                seen.add((a, b))
                take, meta = _posting(s, own, rule)
                if len(take):
                    held.append((take, np.full(len(take), a, np.int64), meta))
                    size += len(take)
                if size >= flush:
                    yield emit(held)
                    held, size = [], 0
            k = len(n)
            at = {"unit": pa.array([u.number] * k, pa.int64()), "pos": pa.array(range(k), pa.int32()), "row": u.rows.cast(schema.field("row").type)}
            own = {c: pa.array(x, pa.int64()) for c, x in (("n", n), ("cls", cls), ("chk", chk))}
            yield block(k, kind=pa.array([0] * k, pa.int32()), **at, **own)
        if held:
            yield emit(held)

    return run


def _buckets(batches):
    """Shingles with two classes or more: members (the central one first), level,
    match, grade."""
    groups: dict[int, list] = {}
    for b in batches:
        for part, s, c, m in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("part", "s", "c", "m")), strict=True):
            groups.setdefault(part, []).append((s, c, m))
    for part in list(groups):
        blobs = groups.pop(part)
        five = np.frombuffer(b"".join(x[0] for x in blobs), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(five), 8), np.uint8)
        wide[:, :5] = five
        s, c = wide.view(U64).ravel(), np.frombuffer(b"".join(x[1] for x in blobs), np.int64)
        m = np.frombuffer(b"".join(x[2] for x in blobs), np.uint8).reshape(-1, 3)
        order = np.lexsort((c, s))
        s, c, m = s[order], c[order], m[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        s, c, m = s[new], c[new], m[new]
        order = np.lexsort((c, -m[:, 2].astype(np.int16), s))  # the central member first
        s, c, m = s[order], c[order], m[order]
        at = np.flatnonzero(np.diff(s, prepend=s[:1] + U64(1)))
        sizes = np.diff(at, append=len(s))
        keep = np.repeat(sizes > 1, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
        lists = lambda v: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v))
        m = m[keep].astype(np.int16)
        out = pa.RecordBatch.from_arrays([lists(c[keep]), lists(m[:, 0] % 16), lists(m[:, 0] // 16), lists(m[:, 1])], ["c", "level", "match", "grade"])
        for i in range(0, len(out), 20_000):
            yield out.slice(i, 20_000)


BUCKET = "c array<long>, level array<short>, match array<short>, grade array<short>"
PAIRS = "a long, b long, n long, need short"


def _counted(a, b, need):
    """Pair counts of one batch."""
    if not len(a):
        return
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi, need = lo[order], hi[order], need[order]
    at = np.flatnonzero((np.diff(lo, prepend=lo[0] - 1 if lo[0] > np.iinfo(np.int64).min else lo[0] + 1) != 0) | (np.diff(hi, prepend=hi[0] + 1) != 0))
    yield pa.RecordBatch.from_arrays([pa.array(lo[at]), pa.array(hi[at]), pa.array(np.diff(at, append=len(lo))), pa.array(need[at].astype(np.int16))], ["a", "b", "n", "need"])


def _meet(rule: Rule, all_pairs: bool):
    """Pairs of a bucket's first member with the others or, where components are
    known (``comp``), of all members in different components."""
    reach = 8 * math.log2(rule.den / rule.num) + 1

    def meet(lists, lead):
        """lists: c, level, match, grade[, comp], one row for each leading member."""
        at = lists[0].offsets.to_numpy()
        c, level, match, grade, *comp = [x.flatten().to_numpy() for x in lists]
        first, sizes = at[:-1] - at[0], np.diff(at)
        place = np.arange(len(c)) - np.repeat(first, sizes)
        own = np.repeat(lead, sizes)
        lead = np.repeat(first + lead, sizes)
        need = np.minimum(match, match[lead])
        fine = (place > own) & (np.maximum(level, level[lead]) <= need) & (np.abs(grade - grade[lead]) <= reach)
        if comp:
            fine &= comp[0] != comp[0][lead]
        yield from _counted(c[fine], c[lead][fine], need[fine])

    def run(batches):
        for b in batches:
            names = b.schema.names
            lists = [b.column(names.index(n)) for n in ("c", "level", "match", "grade", "comp") if n in names]
            sizes = np.diff(lists[0].offsets.to_numpy())
            bucket = np.repeat(np.arange(len(sizes)), sizes) if all_pairs else np.arange(len(sizes))
            lead = np.arange(len(bucket)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if all_pairs else np.zeros(len(sizes), np.int64)
            work = np.cumsum(sizes[bucket])
            i = 0
            while i < len(bucket):
                j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + 1_000_000)))
                some = pa.array(bucket[i:j])
                yield from meet([x.take(some) for x in lists], lead[i:j])
                i = j

    return run


def _compare(rule: Rule):
    """Links between components found by comparing the two sides of a task's block
    pair: rows (task, side, c, n, comp, s) in order of task."""

    def links(rows):
        side, c, comp, sets = (np.array([r[i] for r in rows]) for i in (0, 1, 2, 3))
        n = np.array([len(x) // 6 for x in sets])
        raw = np.frombuffer(b"".join(sets.tolist()), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        _, token, count = np.unique(wide.view(U64).ravel(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(n)), n)
        keep = count[token] > 1  # what one member holds alone is in no intersection
        column = np.cumsum(count > 1) - 1
        token, owner = column[token[keep]], owner[keep]
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        common = np.zeros((len(n), len(n)), np.float32)
        width = 4096
        for a in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            i, j = np.searchsorted(token, [a, a + width])
            m = np.zeros((len(n), width), np.float32)
            m[owner[i:j], token[i:j] - a] = 1
            common += m @ m.T
        total = n[:, None] + n[None, :] - common
        hit = (rule.den * common >= rule.num * total) & (comp[:, None] != comp[None, :])
        if (side == 1).any():
            hit &= side[:, None] != side[None, :]
        x, y = np.nonzero(np.triu(hit, 1))
        if not len(x):
            return []
        # one link for each pair of components, then a forest over them
        _, first = np.unique(np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])]), axis=1, return_index=True)
        parent: dict = {}

        def root(v):
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        out = []
        for k in first.tolist():
            p, q = root(comp[x[k]]), root(comp[y[k]])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(c[x[k]]), int(c[y[k]])))
        return out

    def run(batches):
        task, rows = None, []
        for b in batches:
            names, found = b.schema.names, []
            for t, *r in zip(*(b.column(names.index(n)).to_pylist() for n in ("task", "side", "c", "comp", "s")), strict=True):
                if t != task:
                    found += links(rows) if len(rows) > 1 else []
                    task, rows = t, []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["src", "dst"])
        found = links(rows) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["src", "dst"])

    return run


def _large(buckets: DataFrame) -> DataFrame:
    """task, side, c, comp: every pair of blocks of every large bucket; buckets
    with the same members once."""
    one = buckets.dropDuplicates(["members"])
    block = F.floor(F.col("pos") / BLOCK).cast("int")
    cells = one.select("members", F.ceil(F.size("c") / BLOCK).cast("int").alias("blocks"), F.posexplode(F.arrays_zip("c", "comp")).alias("pos", "x")).withColumn("block", block)
    # a block meets itself and each other one: task (i, j), i <= j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = cells.select("members", "block", other.alias("other"), "x.c", "x.comp")
    pair = F.concat_ws("-", "members", F.least("block", "other"), F.greatest("block", "other"))
    return cells.select(F.xxhash64(pair).alias("task"), (F.col("block") > F.col("other")).cast("int").alias("side"), "c", "comp")


def _sets_of(k: int):
    """c, sorted shingles (48 bits of each hash) of the rows asked for."""

    def run(picked):
        for u, pos, batch in picked:
            sizes = np.diff(u.offsets)[pos]
            data = np.concatenate([np.zeros(0, np.uint8), *[u.data[u.offsets[p] : u.offsets[p + 1]] for p in pos]])
            some = Unit(u.number, u.rows, data, np.concatenate([[0], np.cumsum(sizes)]))
            out = [np.sort(mix(s) >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in shingle_sets(some, k)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("c")), pa.array(out, pa.binary())], ["c", "s"])

    return run


def _sets(rows: Frozen, places: DataFrame, wanted: DataFrame, rule: Rule, path: str) -> DataFrame:
    """c, s: the sets of ``wanted`` classes (c), read at their ``places`` (c, unit, pos)."""
    return cut(rows.pick(wanted.join(places, "c").select("unit", "pos", "c"), _sets_of(rule.k), "c long, s binary"), path)


def _verify(rule: Rule):
    def run(batches):
        for b in batches:
            a, c, x, y = (b.column(b.schema.get_field_index(n)) for n in ("a", "b", "sa", "sb"))
            fine = []
            for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
                n = len(p) // 6
                both = np.zeros((n + len(q) // 6, 8), np.uint8)
                both[:n, :6], both[n:, :6] = np.frombuffer(p, np.uint8).reshape(-1, 6), np.frombuffer(q, np.uint8).reshape(-1, 6)
                both = both.view(U64).ravel()
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                fine.append(rule.den * common >= rule.num * (len(both) - common))
            yield pa.RecordBatch.from_arrays([a, c, pa.array(fine, pa.bool_())], ["src", "dst", "linked"])

    return run


def _linked(sets: DataFrame, pairs: DataFrame, rule: Rule, path: str) -> DataFrame:
    """Pairs (a, b) that link, verified on whole sets."""
    rows = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    return cut(rows.mapInArrow(lean(_verify(rule)), "src long, dst long, linked boolean").where("linked").select("src", "dst"), path)


@dataclass(frozen=True)
class Near:
    """``named``: unit, pos, row, n, cls, comp (class that names the component; null
    for a set of its own), component_id."""

    frozen: Frozen
    named: DataFrame


def find_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rule: Rule | None = None, part_postings: int = 400_000, unit_bytes: int | None = None) -> Near:
    from pyspark.sql.pandas.types import to_arrow_schema

    rule, path = rule or Rule(), new_folder(docs.sparkSession, "jaccard")
    rows = freeze(docs, f"{path}/rows", text_col, unit_bytes=unit_bytes)
    shingles = rows.n_bytes / 6

    def ask(u: Unit):
        _, found, _, count = _unit_shingles(u, rule.k)
        return found, np.minimum(count, 255)

    scales = exchange(rows, f"{path}/scales", parts_for(rows, shingles, 1_500_000), ask, _holders, hash_bytes=4, side=("u1",), width=SCALE_BITS)
    f, long, blob = T.StructField, T.LongType(), T.BinaryType()
    wire = T.StructType([f("kind", T.IntegerType()), f("unit", long), f("pos", T.IntegerType()), f("row", rows.row_type), f("n", long), f("cls", long), f("chk", long), f("part", T.IntegerType()), f("s", blob), f("c", blob), f("m", blob)])
    parts = parts_for(rows, shingles * (1 - rule.num / rule.den), part_postings)

    def survey_of(renamed: dict, name: str) -> tuple[DataFrame, DataFrame]:
        survey = cut(rows.scan(_survey(rule, scales, parts, renamed, to_arrow_schema(wire)), wire), f"{path}/survey-{name}")
        held = survey.where("kind = 0 AND n > 0").groupBy(F.col("cls").alias("c")).agg(F.min(F.struct("unit", "pos")).alias("at"), F.min("chk").alias("lo"), F.max("chk").alias("hi"))
        return survey, cut(held.select("c", "at.unit", "at.pos", (F.col("lo") != F.col("hi")).alias("clash")), f"{path}/places-{name}")

    survey, places = survey_of({}, "0")
    clash = places.where("clash").select(F.col("c").alias("cls"))
    if not clash.isEmpty():  # as rare as clashes of 64 bits: these sets get numbers of their own
        found = survey.where("kind = 0 AND n > 0").join(clash, "cls", "left_semi").select("cls", "chk", F.xxhash64("cls", "chk").alias("own")).distinct()
        survey, places = survey_of({(r.cls, r.chk): r.own for r in found.toLocalIterator()}, "1")
    places = places.drop("clash")
    sets = survey.where("kind = 0").select("unit", "pos", "row", "n", "cls")
    post = survey.where("kind = 1").select("part", "s", "c", "m").repartitionById(parts, "part")
    buckets = cut(post.mapInArrow(lean(_buckets), BUCKET), f"{path}/buckets")

    def candidates(source: DataFrame, all_pairs: bool) -> DataFrame:
        pairs = source.mapInArrow(lean(_meet(rule, all_pairs)), PAIRS)
        return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")

    def classes(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c")))

    met = cut(candidates(buckets, False), f"{path}/met-0")
    tokens = _sets(rows, places, classes(met).distinct(), rule, f"{path}/sets-0")
    links = _linked(tokens, met, rule, f"{path}/links-0")
    comps = connected_components(links, path=f"{path}/comp-0")
    open_ = cut(_still_open(buckets, comps), f"{path}/open")
    if not open_.isEmpty():
        small, large = open_.where(F.size("c") <= SMALL), open_.where(F.size("c") > SMALL)
        fresh = cut(candidates(small, True).join(met, ["a", "b"], "left_anti"), f"{path}/met-1")
        cells = cut(_large(large), f"{path}/cells")
        more = classes(fresh).union(cells.select("c")).distinct().join(tokens.select("c"), "c", "left_anti")
        tokens = tokens.union(_sets(rows, places, more, rule, f"{path}/sets-1"))
        links = links.union(_linked(tokens, fresh, rule, f"{path}/links-1"))
        if not cells.isEmpty():
            tasks = cells.join(tokens, "c").repartition("task").sortWithinPartitions("task")
            links = links.union(cut(tasks.mapInArrow(lean(_compare(rule)), "src long, dst long"), f"{path}/links-2"))
        comps = connected_components(links, path=f"{path}/comp-1")
    named = sets.join(comps.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.where("n > 0").groupBy("comp").agg(F.min(F.col("row").getField(id_col)).alias("component_id"))
    return Near(rows, named.join(least, "comp", "left"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: row (its other columns), n_shingles,
    class_id (fingerprint of the set) and component_id (smallest id linked)."""
    out = find_near(docs, id_col, text_col, **options).named
    return out.select("row", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("row").getField(id_col)).alias("component_id"))


def _still_open(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """Buckets with members of two components or more: their members with ``comp``,
    and a hash of the members. Those of two members are settled only where one match
    is enough: else theirs adds to the matches of the same pair in other buckets."""
    wide = buckets.where("size(c) > 2 OR array_min(match) > 1").withColumn("bucket", F.monotonically_increasing_id())
    wide = cut(wide, new_folder(buckets.sparkSession, "jaccard-wide"))  # so that the numbers stay
    cells = wide.select("bucket", F.posexplode("c").alias("pos", "v"))
    cells = cells.join(comps.toDF("v", "comp"), "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    lists = cells.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.expr("transform(array_sort(collect_list(struct(pos, comp))), x -> x.comp)").alias("comp")).where("lo < hi").drop("lo", "hi")
    members = F.concat_ws("-", F.xxhash64(F.array_sort("c")), F.hash(F.array_sort("c")), F.size("c"))
    return wide.join(lists, "bucket").withColumn("members", members)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each component of ``docs`` the row with the smallest id (null ids last; of
    equal ids the row read first), and every row without a shingle; null texts come
    back as empty ones. Decided by row, whatever the ids."""
    near = find_near(docs, id_col, text_col, **options)
    held = near.named.where("n > 0").select("comp", F.struct(F.col("row").getField(id_col).isNull().alias("lost"), F.col("row").getField(id_col).alias("id"), "unit", "pos").alias("at"))
    first = held.groupBy("comp").agg(F.min("at").alias("first"))
    gone = held.join(first, "comp").where("NOT at <=> first").select("at.unit", "at.pos")
    return unpacked(near.frozen.without(gone), docs, text_col)
