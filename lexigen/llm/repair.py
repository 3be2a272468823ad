"""Operator 12, conversation structure repair by a rank-convergence parallel Viterbi.

A conversation should read, by the initials of its roles, as ``(s?(ua)+)?``. Cheapest edits are a path through
four states (nothing yet, after s, u or a); the costs to go from a row to the end form a vector of four.
Rows are sorted by range over the cluster (conversation, turn, role, text), so a conversation of any length
is cut into chunks of at most ``CHUNK_ROWS`` rows. Conversations within one chunk are solved where they lie. For the others
all chunks start at once from a speculative vector at their end; fix-up passes then start each chunk from its
successor's vector and walk it beside the earlier one until both differ only by a constant, from where nothing changes but that
constant. Passes stop when every chunk has been started from a vector parallel to its successor's. Rows that have to go
leave vectors parallel and end no pass later. Sequences that never converge (roles that are all unknown) are finished exactly after
``MAX_PASSES``: each chunk is walked from the four unit vectors and the costs are stitched together chunk by chunk. The costs then drive
the trace, which takes the least letter that still reaches the cheapest total, so ties go to the ASCII-least audit.

What follows the order of a whole conversation (trace, hash of the result) streams over its chunks in one task, with one chunk in memory.

Nulls: a null role or text is one space; null turns come first and count for no gap; null ids form one conversation.
Rows of one turn are ordered by role, then text. Repeated rows are duplicates like any other. Empty texts are blank. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigen.llm.common import BLANKS
from lexigen.session import materialize

CHUNK_ROWS = 4096
CHUNK_CHARS = 4_000_000
MAX_PASSES = 6

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"s": 0, "u": 1, "a": 2}
OTHER, CUT, GONE = 3, 4, 8  # a row's code: its role, plus CUT if truncated; GONE if it has to be deleted
#: The state after the only role that may follow each state besides s, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("user", "user", "assistant", "user")
#: state -> role code -> state after a row that is kept.
KEEP = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
END = (0, 4, 2, 0)  # cost to go when no row is left
FAR = 1 << 40  # as good as unreachable


def with_inserts(vector: list[int]) -> list[int]:
    for _ in range(3):
        vector = [min(v, INSERT + vector[NEXT[q]]) for q, v in enumerate(vector)]
    return vector


@cache
def before(vector: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """The vector in front of a row, from the one behind it: its part above its least value, and that value."""
    if code >= GONE:
        out = [DELETE + v for v in vector]
    else:
        cut = TRUNCATED if code & CUT else 0
        out = []
        for q in range(4):
            kept = KEEP[q].get(code & 3)
            ways = [DELETE + vector[q], REROLE + cut + vector[NEXT[q]]] + ([] if kept is None else [cut + vector[kept]])
            out.append(min(ways))
    out = with_inserts(out)
    least = min(out)
    return tuple(min(v - least, FAR) for v in out), least


@cache
def step(behind: tuple[int, ...], code: int, state: int) -> tuple[str, int, int, tuple]:
    """The edits from a state in front of a row to behind it: letters, the state after it, their cost and the roles of
    what stands there now (None: the row's own)."""
    front, least = before(behind, code)
    todo, letters, cost, roles = front[state] + least, "", 0, []
    cut = TRUNCATED if code & CUT else 0
    while True:
        if DELETE + behind[state] == todo:
            return letters + "D", state, cost + DELETE, tuple(roles)
        if INSERT + front[NEXT[state]] + least == todo:
            letters, cost, todo = letters + "I", cost + INSERT, todo - INSERT
            roles.append((NAMES[state], False))
            state = NEXT[state]
            continue
        kept = KEEP[state].get(code & 3)
        if code < GONE and kept is not None and cut + behind[kept] == todo:
            return letters + "K", kept, cost + cut, (*roles, (None, True))
        return letters + "R", NEXT[state], cost + REROLE + cut, (*roles, (NAMES[state], True))


def split_least(vector: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(vector)
    return tuple(int(v - least) for v in vector), int(least)


def walk(codes: bytes, end: list[int]) -> list[int]:
    """The vector in front of a chunk, from the one behind it."""
    vector, least = split_least(end)
    for code in reversed(codes):
        vector, more = before(vector, code)
        least += more
    return [v + least for v in vector]


def fix_up(codes: bytes, old_end: list[int], old_front: list[int], end: list[int]) -> list[int]:
    """Like :func:`walk` from ``end``, but only as far as the vectors differ by more than a constant from those of
    the walk that led from ``old_end`` to ``old_front``."""
    (new, new_least), (old, old_least) = split_least(end), split_least(old_end)
    for code in reversed(codes):
        if new == old:
            break
        new, more = before(new, code)
        new_least += more
        old, more = before(old, code)
        old_least += more
    else:
        if new != old:
            return [v + new_least for v in new]
    return [v + new_least - old_least for v in old_front]


class Trace:
    """Letters, cost, counts and result of a conversation, chunk after chunk."""

    def __init__(self, as_text: bool):
        self.as_text, self.parts, self.hash = as_text, [], hashlib.sha256()
        self.state, self.cost, self.audit, self.first = START, 0, [], True
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.role = None
        self.turns = 0

    def put(self, role: str, text: str) -> None:
        line = ("" if self.first else "\n") + f"{role}:{text}"
        self.first = False
        if self.as_text:
            self.parts.append(line)
        self.hash.update(line.encode("utf-8", "surrogatepass"))

    def count(self, chunk: Chunk, faults: tuple[int, int, int], initials: str) -> None:
        self.blank, self.duplicate, self.truncated = (x + y for x, y in zip((self.blank, self.duplicate, self.truncated), faults, strict=True))
        pairs = ([] if self.role is None or not initials else [self.role + initials[0]]) + [a + b for a, b in zip(initials, initials[1:], strict=False)]
        self.illegal += sum(p not in ("su", "ua", "au") for p in pairs)
        self.role = initials[-1] if initials else self.role
        if chunk.low is not None:
            self.turns += chunk.turns - (self.high == chunk.low)
            self.low = chunk.low if self.low is None else self.low
            self.high = chunk.high

    def add(self, chunk: Chunk, codes: bytes, faults: tuple[int, int, int], end: list[int]) -> None:
        """``end``: costs to go behind the chunk, up to a constant."""
        self.count(chunk, faults, "".join(r[:1] or " " for r in chunk.roles))
        behind = [split_least(end)[0]]
        for code in reversed(codes[1:]):
            behind.append(before(behind[-1], code)[0])
        for i, code in enumerate(codes):
            letters, self.state, cost, roles = step(behind.pop(), code, self.state)
            self.audit.append(letters)
            self.cost += cost
            for role, own in roles:
                self.put(chunk.roles[i] if role is None else role, chunk.texts[i] if own else "")

    def row(self) -> tuple:
        while END[self.state]:
            self.put(NAMES[self.state], "")
            self.audit.append("I")
            self.cost += INSERT
            self.state = NEXT[self.state]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        repaired = "".join(self.parts) if self.as_text else self.hash.hexdigest()
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), repaired


class Chunk:
    """Consecutive rows of one conversation. Dropped rows are not among them."""

    def __init__(self, conv, number: int):
        self.conv, self.number = conv, number
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.chars, self.turns = 0, 0
        self.low = self.high = None

    def put(self, turn, role: str, text: str) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.chars >= CHUNK_CHARS

    def digests(self) -> list[bytes | None]:
        """Of role and text of every row; None where the text is blank."""
        return [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() if t.strip(BLANKS) else None for r, t in zip(self.roles, self.texts, strict=True)]

    def codes(self, digests: list[bytes | None], earlier: set[bytes]) -> tuple[bytes, tuple[int, int, int]]:
        """The rows' codes, and how many are blank, duplicate and truncated."""
        seen, out, faults = set(earlier), bytearray(), [0, 0, 0]
        for role, text, digest in zip(self.roles, self.texts, digests, strict=True):
            code = ROLES.get(role[:1], OTHER)
            if digest is None or digest in seen:
                faults[0 if digest is None else 1] += 1
                code |= GONE
            else:
                seen.add(digest)
                if text.rstrip(BLANKS)[-1] not in ".!?":
                    faults[2] += 1
                    code |= CUT
            out.append(code)
        return bytes(out), tuple(faults)


def _rows(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
_FIELDS = [f.split()[0] for f in RESULT.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
_OPEN = "key string, chunk long, roles array<string>, texts array<string>, low long, high long, turns long, digests array<binary>"
_OPEN_TYPES = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
_OPEN_NAMES = [f.split()[0] for f in _OPEN.split(", ")]


def _key(conv) -> str:
    return "-" if conv is None else f"={conv}"


def cut(rows: DataFrame, id_type: str, as_text: bool, chunk_rows: int) -> DataFrame:
    """From sorted rows: whole conversations with their result (``chunk`` is null), and the chunks of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, kind = TaskContext.get().partitionId() << 32, 0, pa.null()
        chunk, alone, done = None, False, []

        def solved(c: Chunk) -> list:
            trace = Trace(as_text)
            trace.add(c, *c.codes(c.digests(), set()), END)
            return [c.conv, *trace.row(), *[None] * len(_OPEN_NAMES)]

        def opened(c: Chunk) -> list:
            return [c.conv, *[None] * len(_FIELDS), _key(c.conv), c.number, c.roles, c.texts, c.low, c.high, c.turns, c.digests()]

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, [kind, *_TYPES, *_OPEN_TYPES], strict=True)], names=["conv", *_FIELDS, *_OPEN_NAMES])

        held = 0
        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, turn, role, text, live in _rows(batch, "conv", "turn", "role", "text", "live"):
                if chunk is None or conv != chunk.conv:
                    if chunk is not None:
                        # the first conversation of a partition may have begun in the one before
                        done.append(solved(chunk) if alone else opened(chunk))
                        held += chunk.chars
                    alone = chunk is not None
                    chunk, made = Chunk(conv, base + made), made + 1
                elif chunk.full(chunk_rows):
                    done.append(opened(chunk))
                    held, alone = held + chunk.chars, False
                    chunk, made = Chunk(conv, base + made), made + 1
                if live:
                    chunk.put(turn, role, text)
                if done and (len(done) >= 1000 or held >= CHUNK_CHARS):
                    yield out()
                    done, held = [], 0
        if chunk is not None:  # the last one may go on in the next partition
            done.append(opened(chunk))
        if done:
            yield out()

    return rows.mapInArrow(run, f"conv {id_type}, {RESULT}, {_OPEN}")


def with_codes(chunks: DataFrame) -> DataFrame:
    """Chunks with ``codes`` and ``faults``; rows seen in an earlier chunk of the conversation are duplicates."""
    of_rows = chunks.select("key", "chunk", F.explode("digests").alias("digest")).filter("digest IS NOT NULL").distinct()
    first = of_rows.groupBy("key", "digest").agg(F.min("chunk").alias("first"))
    again = of_rows.join(first, ["key", "digest"]).filter("chunk > first").groupBy("key", "chunk").agg(F.collect_list("digest").alias("earlier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (roles, texts, digests, earlier) in enumerate(_rows(batch, "roles", "texts", "digests", "earlier")):
                chunk = Chunk(None, 0)
                chunk.roles, chunk.texts = roles, texts
                codes, faults = chunk.codes(digests, set(earlier or ()))
                keep = [batch.column(c).slice(i, 1) for c in names]
                yield pa.RecordBatch.from_arrays([*keep, pa.array([codes], pa.binary()), pa.array([list(faults)], pa.list_(pa.int64()))], names=[*names, "codes", "faults"])

    names = [c for c in chunks.columns if c != "digests"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema if f.name in names)
    return chunks.join(again, ["key", "chunk"], "left").mapInArrow(run, f"{schema}, codes binary, faults array<long>")


_SPEC = "key string, chunk long, codes binary, end array<long>, front array<long>, moved boolean"


def _walked(codes: DataFrame, how) -> DataFrame:
    """(key, chunk, codes, end, front, moved) of every chunk; ``how`` gives end, front and moved of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [how(r) for r in batch.to_pylist()]
            new = [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "chunk", "codes")), *new], names=["key", "chunk", "codes", "end", "front", "moved"])

    return codes.mapInArrow(run, _SPEC)


def _parallel(a: list[int], b: list[int]) -> bool:
    return split_least(a)[0] == split_least(b)[0]


def _passed(r: dict) -> tuple[list[int], list[int], bool]:
    wanted = r["wanted"] or list(END)
    if _parallel(wanted, r["end"]):
        shift = wanted[0] - r["end"][0]
        return wanted, [v + shift for v in r["front"]], False
    return wanted, fix_up(r["codes"], r["end"], r["front"], wanted), True


def stitched(walked: DataFrame) -> DataFrame:
    """Exact vectors behind every chunk from its four unit vectors: one task a conversation streams over
    16 numbers a chunk, last chunk first."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[walk(c, [0 if q == p else FAR for p in range(4)]) for q in range(4)] for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(found, pa.list_(pa.list_(pa.int64())))], names=["key", "chunk", "units"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, end = None, END
        for batch in batches:
            ends = []
            for k, unit in _rows(batch, "key", "units"):
                key, end = k, END if k != key else end
                ends.append(list(end))
                end = [min(unit[q][p] + end[q] for q in range(4)) for p in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(ends, pa.list_(pa.int64()))], names=["key", "chunk", "end"])

    each = walked.select("key", "chunk", "codes").mapInArrow(units, "key string, chunk long, units array<array<long>>")
    return each.repartition("key").sortWithinPartitions("key", F.desc("chunk")).mapInArrow(run, "key string, chunk long, end array<long>")


def ends(codes: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """(key, chunk, end): the costs to go behind every chunk, up to a constant."""
    walked = materialize(_walked(codes.select("key", "chunk", "codes"), lambda r: (list(END), walk(r["codes"], list(END)), True)), "speculative")
    wanted = F.lead("front").over(Window.partitionBy("key").orderBy("chunk")).alias("wanted")
    for _ in range(max_passes):
        behind = walked.select("key", "chunk", wanted)  # four numbers a chunk
        walked = materialize(_walked(walked.join(behind, ["key", "chunk"]), _passed), "fix-up")
        if walked.filter("moved").isEmpty():
            return walked.select("key", "chunk", "end")
    return stitched(walked)


def traced(chunks: DataFrame, id_type: str, as_text: bool) -> DataFrame:
    """One result per conversation from its chunks in order, one chunk in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, trace, kind = None, None, None, pa.null()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, *trace.row()), [kind, *_TYPES], strict=True)], names=["conv", *_FIELDS])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["key"] != key:
                    if trace is not None:
                        yield out()
                    key, conv, trace = r["key"], r["conv"], Trace(as_text)
                chunk = Chunk(conv, 0)
                chunk.roles, chunk.texts, chunk.low, chunk.high, chunk.turns = r["roles"], r["texts"], r["low"], r["high"], r["turns"]
                trace.add(chunk, r["codes"], tuple(r["faults"]), r["end"])
        if trace is not None:
            yield out()

    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(run, f"conv {id_type}, {RESULT}")


def repair(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    live: Column | None = None,
    as_text: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    max_passes: int = MAX_PASSES,
) -> DataFrame:
    """Per conversation: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired``: the sha256 of the
    repaired ``role:text`` lines, or with ``as_text`` the lines. Rows that are not ``live`` only name their conversation."""
    id_type = df.schema[conv_col].dataType.simpleString()
    alive = F.lit(True) if live is None else F.coalesce(live, F.lit(False))
    cell = lambda c: F.when(alive, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")))
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.when(alive, F.col(f"`{turn_col}`").cast("long")).alias("turn"), cell(role_col).alias("role"), cell(text_col).alias("text"), alive.alias("live"))
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    # rows equal in all of this may be dealt to several ranges, by their place in the input
    sorted_rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("place")).sortWithinPartitions(*order)
    found = materialize(cut(sorted_rows.drop("place"), id_type, as_text, chunk_rows), "conversations")
    whole = found.filter("chunk IS NULL").select("conv", *_FIELDS)
    chunks = materialize(with_codes(found.filter("chunk IS NOT NULL").select("conv", *_OPEN_NAMES)), "conversation-chunks")
    parts = traced(chunks.join(ends(chunks, max_passes), ["key", "chunk"]), id_type, as_text)
    return whole.union(parts).withColumnRenamed("conv", conv_col)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, chosen by crc32(``conv:turn``) % 20, and ``dropped``: 0 drops a row (it stays, marked), 1
    empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(cell(conv_col), F.lit(":"), cell(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(cell(text_col), "[.!?]", "")).otherwise(cell(text_col))
    role = F.when(fault == 4, F.lit("user")).otherwise(cell(role_col))
    rows = df.select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), role.alias(role_col), text.alias(text_col), (fault == 0).alias("dropped"), F.when(fault == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")
