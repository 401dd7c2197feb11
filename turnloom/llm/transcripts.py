"""Chat transcripts: roles are recovered by a hidden Markov model, then turns are
rendered in one canonical form.

States are (role, begins a turn or goes on in it). A line shows a speaker marker
(none or a role's) and a shape (blank; how long; ends as a question; begins in
lower case). Moves between states and shapes are counted on a bounded sample of
labelled conversations; how often a marker is missing or wrong is a parameter. The
best path (Viterbi) is exact for conversations of any length:

1. lines are sorted into range partitions by conversation and place, so that a
   conversation of a third of all rows spans many of them; places are stored;
2. each partition reduces its first and last conversation to a max-plus product of
   their lines' matrices; products are chained for the few conversations that cross
   an edge (two rows at most for each partition), which fixes the score at the start
   and the state at the end of each stretch;
3. each partition traces its lines back from there.

Scores are integers, so products do not depend on where the edges are, and of
equal paths the one with the lowest states from the end on is taken.

Rendering: ``<|im_start|>role``, a line end, the lines, ``<|im_end|>``. A row's
piece holds what belongs to its lines, so a conversation is the concatenation of
its pieces in order, and no conversation is ever gathered in one place.

Defined cases: null or empty text is one blank line; a null role column is a line
without a marker; null conversation ids are one conversation; ties in turn are
ordered by marker and text; repeated rows are rendered each; empty tables give empty
results; further columns, whatever their names, travel in ``row``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import cut, new_folder

ROLES = ["system", "user", "assistant"]
# Names that transcripts use for the roles.
NAMES = {"system": 0, "sys": 0, "user": 1, "human": 1, "customer": 1, "student": 1, "question": 1, "q": 1, "assistant": 2, "ai": 2, "bot": 2, "model": 2, "teacher": 2, "answer": 2, "a": 2}
MARKER = r"^\s*(?:#+\s*|<\|?|\*\*|\[)?\s*(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")\s*(?:\|?>|\*\*\s*[:：]|\]\s*[:：]?|[:：])[ \t]*"
SHAPES = 16
STATES = 2 * len(ROLES)  # role * 2 + (0 begins, 1 goes on)
OUTSIDE = STATES  # the state before a conversation's first line
FIXED = 1 << 20
NONE = -(1 << 52)


def observe(line: str) -> tuple[int, int, int]:
    """(marker: 0 none, else role + 1; shape; length of the marker)."""
    m = re.match(MARKER, line, re.I)
    role, cut_at = (NAMES[m[1].lower()] + 1, m.end()) if m else (0, 0)
    body = line[cut_at:].strip()
    size = 0 if not body else 1 if len(body) < 40 else 2 if len(body) < 160 else 3
    return role, size * 4 + 2 * (body[-1:] in ("?", "？")) + body[:1].islower(), cut_at


class Model:
    """Integer log scores: move[from, to] with OUTSIDE last, marker[state, marker], shape[state, shape]."""

    def __init__(self, sequences: list[list[tuple[int, str]]], missing: float = 0.1, wrong: float = 0.02):
        """``sequences``: (role, text without marker) turns of labelled conversations."""
        start, move, shape = np.full(STATES, 0.1), np.full((STATES, STATES), 0.1), np.full((STATES, SHAPES), 0.5)
        start[1::2] = 1e-6  # nothing goes on before it has begun
        for turns in sequences:
            before = None
            for role, text in turns:
                for i, line in enumerate(text.split("\n")):
                    state = 2 * role + (i > 0)
                    if before is None:
                        start[state] += 1
                    else:
                        move[before, state] += 1
                    shape[state, observe(line)[1]] += 1
                    before = state
        for s in range(STATES):
            for to in range(1, STATES, 2):
                if s // 2 != to // 2:
                    move[s, to] = 1e-9  # a turn goes on with its own role
        marker = np.full((STATES, len(ROLES) + 1), wrong / len(ROLES))
        for s in range(STATES):
            if s % 2:
                marker[s, 0] = 1 - wrong
            else:
                marker[s, 0], marker[s, s // 2 + 1] = missing, 1 - missing - wrong
        fix = lambda p: np.round(np.log(p / p.sum(axis=-1, keepdims=True)) * FIXED).astype(np.int64)
        self.move = np.full((STATES + 1, STATES + 1), NONE)
        self.move[:STATES, :STATES], self.move[OUTSIDE, :STATES] = fix(move), fix(start)
        self.marker, self.shape = fix(marker), fix(shape)

    def emits(self, markers, shapes) -> np.ndarray:
        seen = self.marker[:, markers].T + self.shape[:, shapes].T
        return np.concatenate([seen, np.full((len(seen), 1), NONE)], axis=1)

    def product(self, emit: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each after them."""
        out = np.full((STATES + 1, STATES + 1), NONE)
        np.fill_diagonal(out, 0)
        for e in emit:
            out = np.maximum((out[:, :, None] + self.move[None]).max(axis=1) + e, NONE)
        return out

    def trace(self, emit: np.ndarray, before: np.ndarray | None = None, end: int | None = None) -> np.ndarray:
        """Best states of the lines; ``before``: scores of the line before the first
        (none at a conversation's start); ``end``: the last line's state, if fixed."""
        score = opening() if before is None else before
        back = np.zeros((len(emit), STATES + 1), np.int8)
        for i, e in enumerate(emit):
            way = score[:, None] + self.move
            back[i] = way.argmax(axis=0)
            score = np.maximum(way.max(axis=0) + e, NONE)
        out = np.zeros(len(emit), np.int8)
        out[-1] = int(score.argmax()) if end is None else end
        for i in range(len(emit) - 1, 0, -1):
            out[i - 1] = back[i][out[i]]
        return out


def opening() -> np.ndarray:
    out = np.full(STATES + 1, NONE)
    out[OUTSIDE] = 0
    return out


def fit(turns: DataFrame, *, fit_conversations: int = 500, fit_turns: int = 50, fit_chars: int | None = 10_000, **options) -> Model:
    """A model from labelled turns (conv_id, turn, role, text): of the
    ``fit_conversations`` with the lowest hash of their id, the turns below
    ``fit_turns``, each text up to ``fit_chars`` characters (None: whole). It bounds
    what the driver holds for the model only; decoding takes whole texts."""
    known = turns.where(F.lower("role").isin(*NAMES) & F.col("conv_id").isNotNull() & F.col("turn").between(0, fit_turns - 1))
    some = known.select("conv_id").distinct().orderBy(F.xxhash64("conv_id")).limit(fit_conversations)
    text = F.col("text") if fit_chars is None else F.substring("text", 1, fit_chars)
    rows = known.join(F.broadcast(some), "conv_id").select("conv_id", "turn", "role", text.alias("text")).dropDuplicates(["conv_id", "turn"]).orderBy("conv_id", "turn").collect()
    held: dict = {}
    for r in rows:
        held.setdefault(r.conv_id, []).append((NAMES[r.role.lower()], r.text or ""))
    return Model(list(held.values()), **options)


def with_lost_markers(turns: DataFrame, lost: float, wrong: float, seed: int = 2045) -> DataFrame:
    """``turns`` as transcripts with flaws: ``truth`` is the role as it was, and by a
    hash of seed, conversation and turn a share ``lost`` of the rows names no speaker
    and a share ``wrong`` names another one."""
    u = F.pmod(F.xxhash64(F.lit(seed), "conv_id", "turn"), F.lit(1_000_000)) / 1_000_000
    other = F.when(F.lower("role") == "user", "assistant").otherwise("user")
    return turns.withColumn("truth", F.col("role")).withColumn("role", F.when(u < lost, F.lit(None)).when(u < lost + wrong, other).otherwise(F.col("role")))


def _number(batches):
    pid, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([pid] * b.num_rows, pa.int32()), pa.array(range(seq, seq + b.num_rows), pa.int64()), *b.columns], ["pid", "seq", *b.schema.names])
        seq += b.num_rows


def _stretches(batches):
    """(pid, conversation key, whether it is the partition's first, rows, their
    lines) for each run of one conversation; rows keep their Arrow columns."""
    pid, key, first, rows, n = None, None, True, [], 0
    for b in batches:
        names = b.schema.names
        for p, k, row, text in zip(*(b.column(names.index(n)).to_pylist() for n in ("pid", "conv", "row", "raw")), strict=True):
            if rows and (p, k) != (pid, key):
                yield pid, key, first, p != pid, rows
                first, rows = p != pid, []
            pid, key = p, k
            rows.append((row, text.split("\n")))
    if rows:
        yield pid, key, first, True, rows


def _emit(model: Model, rows) -> tuple[np.ndarray, list]:
    seen = [observe(line) for _, lines in rows for line in lines]
    return model.emits([s[0] for s in seen], [s[1] for s in seen]), seen


def _edges(model: Model):
    def run(batches):
        out = []
        for pid, key, first, last, rows in _stretches(batches):
            if first or last:
                out.append((pid, key, first, last, model.product(_emit(model, rows)[0]).astype("<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.binary()))], ["pid", "conv", "first", "last", "m"])

    return run


def chain(products: list[np.ndarray]) -> list[tuple[np.ndarray, int, bool]]:
    """For the stretches of one conversation: scores before, state at the end,
    whether it is the last."""
    before, scores = opening(), []
    for p in products:
        scores.append(before)
        before = np.maximum((before[:, None] + p).max(axis=0), NONE)
    out, end = [], int(before.argmax())
    for i in range(len(products) - 1, -1, -1):
        out.append((scores[i], end, i == len(products) - 1))
        end = int((scores[i] + products[i][:, end]).argmax())
    return out[::-1]


def _decode(model: Model, fixed):
    def run(batches):
        known, kind = fixed.value, []

        def block(out):
            strings = pa.list_(pa.string())
            types = (kind[0], strings, strings, pa.list_(pa.bool_()), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["row", "roles", "texts", "starts", "rendered"])

        def noted():
            for b in batches:
                kind[:] = [b.schema.field("row").type]
                yield b

        for pid, key, _, _, rows in _stretches(noted()):
            before, end, last, begun = known.get((pid, key), (None, None, True, False))
            emit, seen = _emit(model, rows)
            states = model.trace(emit, None if before is None else np.array(before), end)
            at, out = 0, []
            for i, (row, lines) in enumerate(rows):
                piece, roles, bodies, starts = [], [], [], []
                for line in lines:
                    state, marker = int(states[at]), seen[at]
                    opens = state % 2 == 0
                    body = line[marker[2] :] if opens and marker[0] else line
                    if opens or not roles:
                        roles.append(ROLES[state // 2])
                        bodies.append(body)
                        starts.append(opens)
                    else:
                        bodies[-1] += "\n" + body
                    if opens:
                        piece.append(("<|im_end|>\n" if begun else "") + f"<|im_start|>{ROLES[state // 2]}\n{body}")
                    else:
                        piece.append(("\n" if begun else "") + body)
                    begun, at = True, at + 1
                if last and i == len(rows) - 1:
                    piece.append("<|im_end|>\n")
                out.append((row, roles, bodies, starts, "".join(piece)))
                if len(out) >= 5000:
                    yield block(out)
                    out = []
            if out:
                yield block(out)

    return run


def recover_turns(rows: DataFrame, model: Model, *, partition_rows: int = 20_000) -> DataFrame:
    """``rows``: conv_id, turn, role (what the transcript names as speaker, or
    null), text. One row for each: row (all columns but text), roles, texts and
    starts of the turn pieces in it, and its rendered piece."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "chat")
    raw = F.concat(F.coalesce(F.concat(F.col("role"), F.lit(": ")), F.lit("")), F.coalesce("text", F.lit("")))
    keyed = rows.select(F.col("conv_id").alias("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").alias("t"), F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "text"]).alias("row"), raw.alias("raw"))
    n = max(1, -(-keyed.count() // partition_rows))
    # a hash of the text breaks ties: a range bound should not carry a text
    keyed = keyed.withColumn("tie", F.xxhash64("raw"))
    placed = keyed.repartitionByRange(n, "c", "t", "tie").sortWithinPartitions("c", "t", "tie", "raw").select("conv", "row", "raw")
    wire = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("seq", T.LongType()), *placed.schema])
    held = cut(placed.mapInArrow(_number, wire), f"{path}/placed")
    parts = 1 + (held.agg(F.max("pid")).first()[0] or 0)
    in_order = held.repartitionById(parts, "pid").sortWithinPartitions("pid", "seq").select("pid", "conv", "row", "raw")
    edges: dict = {}
    for r in sorted(in_order.mapInArrow(_edges(model), "pid int, conv string, first boolean, last boolean, m binary").collect(), key=lambda r: r.pid):
        edges.setdefault(r.conv, []).append((r.pid, np.frombuffer(bytes(r.m), "<i8").reshape(STATES + 1, STATES + 1)))
    fixed = {}
    for key, some in edges.items():
        if len(some) > 1:
            for i, ((pid, _), (before, end, last)) in enumerate(zip(some, chain([m for _, m in some]), strict=True)):
                fixed[pid, key] = (before.tolist(), end, last, i > 0)
    shared = spark.sparkContext.broadcast(fixed)
    strings = T.ArrayType(T.StringType())
    out = T.StructType([held.schema["row"], T.StructField("roles", strings), T.StructField("texts", strings), T.StructField("starts", T.ArrayType(T.BooleanType())), T.StructField("rendered", T.StringType())])
    return in_order.mapInArrow(_decode(model, shared), out)

