"""Conversation structure repair by a rank-convergence parallel Viterbi.

The cheapest edits (keep, rerole, delete, insert) that give a conversation the role initials `(s?(ua)+)?` are a shortest path
through four states: nothing yet, after s, after u, after a. All rows get a place in one global order; a chunk is CHUNK
consecutive places of one conversation, so a conversation that holds a third of all rows is many chunks in many tasks.

Backward costs: every chunk starts from a speculative vector of costs at its end (its true one if it is the last of its
conversation) and works backwards. A fix-up pass takes the vector that the next chunk found at its own start; where it
differs from the one used by more than a constant, the chunk runs again. When no chunk is left to run, all costs inside
chunks are right up to a constant, which no choice depends on. Passes are bounded by the chunks of a conversation; vectors
of these costs converge after a few rows, so one or two passes are the rule.

Least audit: with the stitched costs, a trace takes at each row the ASCII-least of the cheapest edits. A chunk is traced
from each state that it may be entered in; the maps from entry to exit are composed by doubling steps until each is constant,
which takes log2(chunks) joins at most.

Texts are shuffled twice, by order and by conversation: the digest of a repaired conversation is one SHA-256 over its whole
text, so a conversation's rows pass, streamed and in order, through one task, which holds its audit string only.

Nulls in role or text are one space (such a text is blank, such a role is never kept); null turns come first; rows
of a null conv_id are one conversation. Rows of one turn stand by role, then by a hash of the text. Repeated rows are
duplicates; a conversation without rows has zeros, an empty audit and the hash of nothing; extra columns are ignored; an
empty table gives no rows. Texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, each_batch, join_small, release, stage, table
from .order import numbered

CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State after one more row of a repaired conversation (by insertion or rerole), by state; 0 start, 1 after s, 2 after u, 3 after a.
NEXT = np.array([2, 2, 3, 2])
ROLES = ("", "", "user", "assistant")
#: What is to be paid at the end of a conversation: inserts up to the next whole exchange.
TERMINAL = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: A row's symbol: blank, duplicate, or its role's initial (x: none of s, u, a), a capital if it is truncated.
SYMBOLS = "bdsuaxSUAX"
_FAR = 1 << 60


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By symbol and state: cost and next state of keeping, cost of reroling (far if it can't be)."""
    keep = np.full((len(SYMBOLS), 4), _FAR, np.int64)
    after = np.zeros((len(SYMBOLS), 4), np.int64)
    rerole = np.full((len(SYMBOLS), 4), _FAR, np.int64)
    for i, sign in enumerate(SYMBOLS):
        if sign in "bd":
            continue
        extra = TRUNCATED if sign.isupper() else 0
        rerole[i] = REROLE + extra
        for state in range(4):
            to = {"s": 1 if state == 0 else 0, "u": 2 if state != 2 else 0, "a": 3 if state == 2 else 0}.get(sign.lower(), 0)
            if to:
                keep[i, state], after[i, state] = KEEP + extra, to
    return keep, after, rerole


_KEEP, _AFTER, _REROLE = _tables()
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))
_D, _I, _K, _R = range(4)
LETTERS = "DIKR"


def backward(chunks: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs to go before each row and at the end of each chunk, all chunks in lockstep from their ends -> (costs, codes,
    starts): rows starts[i] to starts[i] + len(chunks[i]) of costs belong to chunk i, the last one being ends[i]."""
    sizes = np.array([len(c) for c in chunks], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    codes = np.zeros(int((sizes + 1).sum()), np.int64)
    text = np.frombuffer(b"".join(c + b"b" for c in chunks), np.uint8)
    codes[:] = _CODE[text]
    costs = np.zeros((len(codes), 4), np.int64)
    costs[starts + sizes] = ends
    order = np.argsort(-sizes, kind="stable")
    deep = sizes[order]
    for step in range(1, int(deep[0]) + 1 if len(deep) else 0):
        own = order[: int(np.searchsorted(-deep, -step, "right"))]
        at = starts[own] + sizes[own] - step
        later, sign = costs[at + 1], codes[at]
        w = np.minimum(DELETE + later, _REROLE[sign] + later[:, NEXT])
        w = np.minimum(w, _KEEP[sign] + np.take_along_axis(later, _AFTER[sign], axis=1))
        costs[at] = np.minimum(np.minimum(w, INSERT + w[:, NEXT]), 2 * INSERT + w[:, NEXT[NEXT]])
    return costs, codes, starts


def _choices(costs: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The least letter among the cheapest edits before each row by state, and the state after it."""
    here, later, sign = costs[:-1], costs[1:], codes[:-1]
    kept = _KEEP[sign] + np.take_along_axis(later, _AFTER[sign], axis=1)
    op = np.full(here.shape, _R, np.uint8)
    op[kept == here] = _K
    op[INSERT + here[:, NEXT] == here] = _I
    op[DELETE + later == here] = _D
    to = np.where(op == _D, np.arange(4), np.where(op == _K, _AFTER[sign], NEXT)).astype(np.uint8)
    return op.tobytes(), to.tobytes()


def trace(costs: np.ndarray, codes: np.ndarray, last: bool, entries: Iterable[int]) -> list[tuple[int, int, str]]:
    """(entry, exit, audit) of a chunk for each entry state."""
    op, to = _choices(costs, codes)
    out = []
    for entry in entries:
        state, letters = entry, []
        for k in range(0, len(op), 4):
            while op[k + state] == _I:
                letters.append("I")
                state = to[k + state]
            letters.append(LETTERS[op[k + state]])
            state = to[k + state]
        while last and TERMINAL[state]:
            letters.append("I")
            state = int(NEXT[state])
        out.append((entry, state, "".join(letters)))
    return out


def symbols(blank: Column, duplicate: Column, truncated: Column, role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    kept = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(blank, F.lit("b")).when(duplicate, F.lit("d")).otherwise(F.when(truncated, F.upper(kept)).otherwise(kept))


def _vectors(chunks: DataFrame, kind: str) -> DataFrame:
    """chunks (conv_id, chunk, last, symbols, ends: null for the end of a conversation) -> (conv_id, chunk, last, ends,
    starts): cost vectors, less their least cost."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 2000, 1 << 19):
            given = [TERMINAL.tolist() if x is None else x for x in b.column("ends").to_pylist()]
            parts = [s.encode() for s in b.column("symbols").to_pylist()]
            costs, _, at = backward(parts, np.array(given, np.int64).reshape(-1, 4))
            found = costs[at] - costs[at].min(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("chunk"), b.column("last"), pa.array(given, pa.list_(pa.int64())), pa.array(found.tolist(), pa.list_(pa.int64()))], ["conv_id", "chunk", "last", "ends", "starts"])

    return chunks.select("conv_id", "chunk", "last", "symbols", "ends").mapInArrow(run, f"conv_id {kind}, chunk long, last boolean, ends array<long>, starts array<long>")


def _traces(chunks: DataFrame, kind: str) -> DataFrame:
    """chunks (conv_id, chunk, first, last, symbols, ends) -> (conv_id, chunk, entry, exit, audit): of state 0 for a first chunk,
    of each state otherwise."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 2000, 1 << 19):
            ends = np.array([TERMINAL.tolist() if x is None else x for x in b.column("ends").to_pylist()], np.int64).reshape(-1, 4)
            costs, codes, at = backward(parts := [s.encode() for s in b.column("symbols").to_pylist()], ends)
            rows, found = [], []
            for i, (first, last) in enumerate(zip(b.column("first").to_pylist(), b.column("last").to_pylist(), strict=True)):
                own = slice(int(at[i]), int(at[i]) + len(parts[i]) + 1)
                each = trace(costs[own], codes[own], last, (0,) if first else range(4))
                rows += [i] * len(each)
                found += each
            entry, exits, audit = zip(*found, strict=True) if found else ((), (), ())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id").take(take), b.column("chunk").take(take), pa.array(entry, pa.int32()), pa.array(exits, pa.int32()), pa.array(audit, pa.string())], ["conv_id", "chunk", "entry", "exit", "audit"])

    return chunks.select("conv_id", "chunk", "first", "last", "symbols", "ends").mapInArrow(run, f"conv_id {kind}, chunk long, entry int, exit int, audit string")


def stitched(chunks: DataFrame) -> DataFrame:
    """chunks (conv_id, chunk, last, symbols), a table of conversations of several chunks -> (conv_id, chunk, ends): the costs
    at the end of each chunk up to a constant, null for the last one; as a table. Each pass runs the chunks again whose
    vector was wrong."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    guess = F.when(F.col("last"), F.lit(None)).otherwise(F.array(*[F.lit(int(x)).cast("long") for x in TERMINAL]))
    now = stage(_vectors(chunks.withColumn("ends", guess.cast("array<long>")), kind), "vectors")
    while True:
        after = now.select(F.col("conv_id").alias("__conv"), (F.col("chunk") - 1).alias("__chunk"), F.col("starts").alias("wanted"))
        paired = now.join(after, now.conv_id.eqNullSafe(after["__conv"]) & (now.chunk == after["__chunk"]), "left").drop("__conv", "__chunk")
        low = F.array_min("ends")
        wrong = ~F.col("last") & (F.transform("ends", lambda x: x - low) != F.col("wanted"))
        todo = stage(paired.where(wrong).select("conv_id", "chunk", F.col("wanted").alias("ends")), "fix-up")
        if todo.isEmpty():
            release(todo)
            break
        key = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["chunk"] == b["chunk"])
        again = _vectors(chunks.join(todo, key(chunks, todo)).select(chunks.conv_id, chunks.chunk, "last", "symbols", "ends"), kind)
        last, now = now, stage(now.join(todo, key(now, todo), "left_anti").unionByName(again), "vectors")
        release(last)
        release(todo)
    return now


def _entered(traces: DataFrame) -> DataFrame:
    """traces (conv_id, chunk, entry, exit, audit), a table -> (conv_id, chunk, entry): the state each chunk is entered in."""
    maps = traces.groupBy("conv_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("entry", "exit"))).alias("m"))
    constant = F.size("m") == 1  # a first chunk
    now = stage(maps.select("conv_id", "chunk", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.when(constant, F.element_at("m", F.lit(0))).otherwise(F.element_at("m", s))).alias("exits")), "exits")
    step = 1
    while not now.where(F.size(F.array_distinct("exits")) > 1).isEmpty():
        before = now.select(F.col("conv_id").alias("__conv"), (F.col("chunk") + step).alias("__chunk"), F.col("exits").alias("earlier"))
        paired = now.join(before, now.conv_id.eqNullSafe(before["__conv"]) & (now.chunk == before["__chunk"]), "left")
        both = F.when(F.col("earlier").isNull(), F.col("exits")).otherwise(F.transform("earlier", lambda s: F.get("exits", s)))
        last, now = now, stage(paired.select("conv_id", "chunk", both.alias("exits")), "exits")
        release(last)
        step *= 2
    return now.select("conv_id", (F.col("chunk") + 1).alias("chunk"), F.get("exits", F.lit(0)).alias("entry"))


def _audits(chunks: DataFrame) -> DataFrame:
    """chunks (conv_id, chunk, first, last, symbols), a table -> (conv_id, chunk, entry, audit) of the cheapest edits."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    whole, parts = F.col("first") & F.col("last"), chunks.where(~(F.col("first") & F.col("last")))
    none = F.lit(None).cast("array<long>").alias("ends")
    short = _traces(chunks.where(whole).select("*", none), kind).select("conv_id", "chunk", "entry", "audit")
    if parts.isEmpty():
        return short
    ends = stitched(parts)
    at = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["chunk"] == b["chunk"])
    known = ends.select("conv_id", "chunk", F.when(~F.col("last"), F.col("ends")).alias("ends"))
    traces = stage(_traces(parts.join(known, at(parts, known)).select(*[parts[c] for c in parts.columns], "ends"), kind), "traces")
    release(ends)
    entered = _entered(traces)
    right = traces.join(entered, at(traces, entered) & (traces.entry == entered.entry), "left_semi")
    first = parts.where("first")
    begun = traces.join(first, at(traces, first), "left_semi")
    return short.unionByName(right.unionByName(begun).select("conv_id", "chunk", "entry", "audit"))


_STREAM = "conv_id {}, at long, turn long, role string, text string, entry int, audit string, symbols string"


def _ordered(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """rows (conv_id, turn, role, text) -> all that a repair needs, each conversation in one partition and in order: a mark
    for the conversation (at -1), before each chunk its audit, and the rows."""
    spaced = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = numbered(spaced, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")], "placed")
    same = [F.xxhash64("conv_id", "role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role", "conv_id").alias("h2"), F.col("conv_id").isNull().alias("h3")]
    body = F.btrim("text", F.lit(SPACES))
    marked = placed.select("conv_id", "at", "role", (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"), *same)
    repeats = stage(marked.groupBy("h1", "h2", "h3").agg(F.min("at").alias("seen"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeats")
    told = join_small(marked, repeats, ["h1", "h2", "h3"])
    sign = symbols(F.col("blank"), F.coalesce(F.col("at") > F.col("seen"), F.lit(False)), F.col("truncated"), F.col("role"))
    signs = told.select("conv_id", "at", F.call_function("div", F.col("at"), F.lit(CHUNK).cast("long")).alias("chunk"), sign.alias("sign"))
    chunks = signs.groupBy("conv_id", "chunk").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "sign"))).alias("signs"))
    chunks = stage(chunks.select("conv_id", "chunk", "at", F.array_join(F.transform("signs", lambda x: x["sign"]), "").alias("symbols")), "chunks")
    release(repeats)
    long = stage(chunks.groupBy("conv_id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low < high").withColumnRenamed("conv_id", "__conv"), "long-conversations")
    ends = join_small(chunks, long, chunks.conv_id.eqNullSafe(long["__conv"])).drop("__conv")
    ends = stage(ends.select("conv_id", "chunk", "at", "symbols", F.coalesce(F.col("chunk") == F.col("low"), F.lit(True)).alias("first"), F.coalesce(F.col("chunk") == F.col("high"), F.lit(True)).alias("last")), "ends-of-chunks")
    for used in (chunks, long):
        release(used)
    audits = _audits(ends).withColumnRenamed("conv_id", "__conv").withColumnRenamed("chunk", "__chunk")
    nothing = lambda kind: F.lit(None).cast(kind)
    heads = ends.join(audits, ends.conv_id.eqNullSafe(audits["__conv"]) & (ends.chunk == audits["__chunk"])).select("conv_id", "at", nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), "entry", "audit", "symbols")
    lines = placed.select("conv_id", "at", "turn", "role", "text", nothing("int").alias("entry"), nothing("string").alias("audit"), nothing("string").alias("symbols"))
    found = lines.unionByName(heads)
    if ids is not None:
        found = found.unionByName(ids.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("at"), *[nothing(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("entry", "int"), ("audit", "string"), ("symbols", "string"))]))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "conv_id").sortWithinPartitions("conv_id", "at", F.col("audit").asc_nulls_last())


class _Conversation:
    """What a task holds of the conversation that it is in: counts, the audit so far, and a running hash."""

    def __init__(self, conv: object):
        self.conv, self.counts, self.audit, self.cost, self.hash = conv, {"b": 0, "d": 0, "t": 0}, [], 0, hashlib.sha256()
        self.illegal = self.turns = self.lines = 0
        self.initial = self.least = self.most = None
        self.plan: Iterator[str] = iter("")
        self.state = 0

    def begin(self, entry: int, audit: str, symbols: str) -> None:
        self.audit.append(audit)
        self.plan, self.state = iter(audit), entry
        cut = sum(symbols.count(x) for x in "SUAX")
        for sign in "bd":
            self.counts[sign] += symbols.count(sign)
        self.counts["t"] += cut
        self.cost += REROLE * audit.count("R") + DELETE * audit.count("D") + INSERT * audit.count("I")
        if cut:
            rows = audit.replace("I", "")
            self.cost += TRUNCATED * sum(1 for sign, op in zip(symbols, rows, strict=True) if op != "D" and sign in "SUAX")

    def row(self, turn: int | None, role: str, text: str, ends: bool) -> list[tuple[str, str]]:
        """Takes a row; the rows of the repaired conversation that are known by then. ends: it is the last one of its chunk."""
        if turn is not None:
            if turn != self.most:
                self.turns += 1
            self.least, self.most = (turn if self.least is None else self.least), turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        out = []
        for op in self.plan:
            if op in "IR":
                self.state = int(NEXT[self.state])
                out.append((ROLES[self.state], "" if op == "I" else text))
            elif op == "K":
                self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
                out.append((role, text))
            if op != "I":
                break
        if ends:
            for _ in self.plan:  # inserts at the end
                self.state = int(NEXT[self.state])
                out.append((ROLES[self.state], ""))
        for name, said in out:
            self.hash.update((b"\n" if self.lines else b"") + f"{name}:{said}".encode())
            self.lines += 1
        return out

    def result(self) -> list:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return [self.conv, gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


def _conversations(batches: Iterable[pa.RecordBatch], said: Callable[[_Conversation, list[tuple[str, str]]], None]) -> Iterator[_Conversation | None]:
    """Conversations one after the other, when their last row is done, and None after each batch."""
    now: _Conversation | None = None
    left = 0
    for b in each_batch(batches, 5000):
        for conv, at, turn, role, text, entry, audit, signs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now
                now = _Conversation(conv)
            if audit is not None:
                now.begin(entry, audit, signs)
                left = len(signs)
            elif at >= 0:
                left -= 1
                said(now, now.row(turn, role, text, left == 0))
        yield None
    if now is not None:
        yield now


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """rows (conv_id, turn, role, text) -> a row per conversation: conv_id, REPORT, audit, repaired_sha256. ids (conv_id):
    conversations that are reported even if they have no rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        names = ["conv_id", *REPORT, "audit", "repaired_sha256"]
        ordered = iter(batches)
        first = next(ordered, None)
        if first is None:
            return
        type_of = first.schema.field("conv_id").type

        def out() -> pa.RecordBatch:
            kinds = [type_of, *[pa.int64()] * len(REPORT), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from ordered

        for c in _conversations(all_batches(), lambda conversation, lines: None):
            if c is not None:
                held.append(c.result())
            if len(held) >= 1000 or held and len(held[-1][7]) > 1 << 20:
                yield out()
                held = []
        if held:
            yield out()

    counts = ", ".join(f"{c} long" for c in REPORT)
    return _ordered(rows, ids).mapInArrow(run, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> the repaired conversations: (conv_id, position from 0, role, text)."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lines in _streamed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in lines], b), pa.array([x[1] for x in lines], pa.int64()), pa.array([x[2] for x in lines], pa.string()), pa.array([x[3] for x in lines], pa.string())], ["conv_id", "position", "role", "text"])

    return _ordered(rows, None).mapInArrow(run, f"conv_id {kind}, position long, role string, text string")


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[tuple]]]:
    held: list[tuple] = []
    kinds: list[pa.DataType] = []

    def seen() -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds.append(b.schema.field("conv_id").type)
            yield b

    def said(c: _Conversation, lines: list[tuple[str, str]]) -> None:
        held.extend((c.conv, c.lines - len(lines) + i, role, text) for i, (role, text) in enumerate(lines))

    for _ in _conversations(seen(), said):
        if len(held) >= 2000:
            yield kinds[0], held
            held = []
    if held:
        yield kinds[0], held


def damage(rows: DataFrame) -> DataFrame:
    """Faults by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 sets
    its role to user. Nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damage(rows), rows.select("conv_id"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES: dict[str, str] = {}
