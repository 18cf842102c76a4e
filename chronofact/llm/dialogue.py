"""Repair of conversations by generalised LR parsing with edits.

A conversation is parsed over the initials of its roles. Each row may be kept,
given another role or deleted, and turns may be inserted; every edit has a
weight. All parses run at once on a graph-structured stack, and equal stack
tops are merged by the least (cost, audit). Rows come sorted, so a task holds
what is still open and no whole conversation: as soon as all live parses agree
on the edits of a beginning, it is written.
"""

from __future__ import annotations

import functools
import hashlib
import os.path
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .columns import BLANKS
from .role_grammar import END, Grammar, Stacks

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = ("user", "assistant")
#: Rows of a conversation that are parsed as a whole; longer ones are parsed as they come.
WHOLE = 64
#: Rows after which a longer conversation looks for a beginning that all parses agree on.
AGREE = 128
SUMMARY = T.StructType([T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                       + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
#: A parse that costs more than another by more than this can't win: from any place of the grammar two insertions,
#: or one and a deleted system turn, are enough to go on as from any other.
SPREAD = 2 * INSERT
#: (cost, initials of the edits, for each edit the initial of the role that results).
Path = tuple[int, str, str]


@functools.cache
def _shared_stacks() -> Stacks:
    return Stacks(Grammar())


def _with_inserts(front: dict[int, Path]) -> dict[int, Path]:
    """``front`` and what inserting turns makes of it, each node with its least path."""
    stacks, out, todo = _shared_stacks(), dict(front), list(front)
    while todo:
        node = todo.pop()
        cost, audit, roles = out[node]
        for role in ROLES:
            for reached in stacks.advance(node, role[0]):
                path = cost + INSERT, audit + "I", roles + role[0]
                if reached not in out or path < out[reached]:
                    out[reached] = path
                    todo.append(reached)
    return out


def _step(front: dict[int, Path], initial: str, fault: str) -> dict[int, Path]:
    """``front`` after one row with this initial and first fault (``b``, ``d``, ``t`` or none)."""
    stacks, out = _shared_stacks(), {}

    def offer(node: int, path: Path) -> None:
        if node not in out or path < out[node]:
            out[node] = path

    for node, (cost, audit, roles) in _with_inserts(front).items():
        offer(node, (cost + DELETE, audit + "D", roles + "-"))
        if fault in ("b", "d"):
            continue
        extra = TRUNCATED if fault == "t" else 0
        for reached in stacks.advance(node, initial) if initial and initial != END else ():
            offer(reached, (cost + KEEP + extra, audit + "K", roles + initial))
        for role in ROLES:
            for reached in stacks.advance(node, role[0]):
                offer(reached, (cost + REROLE + extra, audit + "R", roles + role[0]))
    return out


def _best_end(front: dict[int, Path]) -> Path:
    stacks = _shared_stacks()
    return min(path for node, path in _with_inserts(front).items() if stacks.advance(node, END))


@functools.lru_cache(100_000)
def whole_path(rows: tuple[tuple[str, str], ...]) -> Path:
    """The least path over rows of (initial, first fault)."""
    front: dict[int, Path] = {0: (0, "", "")}
    for initial, fault in rows:
        front = _step(front, initial, fault)
    return _best_end(front)


@dataclass
class Conversation:
    """One conversation as its rows come, in order."""

    key: object
    emit: list[tuple] | None
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys("bdt", 0))
    illegal: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    before: str | None = None
    rows: deque = field(default_factory=deque)
    front: dict[int, Path] | None = None
    since: int = 0
    settled: list[str] = field(default_factory=list)
    cost: int = 0
    places: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def add(self, turn: int | None, role: str, text: str, initial: str, fault: str) -> None:
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        # the text of a row that must go is not needed
        self.rows.append((turn, role, None if fault in ("b", "d") else text, initial, fault))
        if self.front is not None:
            self.front = _step(self.front, initial, fault)
            self.since += 1
            if self.since >= AGREE:
                self.settle()
        elif len(self.rows) > WHOLE:
            self.front = {0: (0, "", "")}
            for _, _, _, first, known in self.rows:
                self.front = _step(self.front, first, known)

    def settle(self) -> None:
        """Write the edits that all live parses share, and forget them."""
        self.since = 0
        least = min(self.front.values())[0]
        self.front = {n: p for n, p in self.front.items() if p[0] <= least + SPREAD}
        agreed = min(len(os.path.commonprefix([p[at] for p in self.front.values()])) for at in (1, 2))
        if agreed:
            _, audit, roles = next(iter(self.front.values()))
            self.write(audit[:agreed], roles[:agreed])
            self.front = {n: (c, a[agreed:], r[agreed:]) for n, (c, a, r) in self.front.items()}

    def write(self, audit: str, roles: str) -> None:
        self.settled.append(audit)
        for edit, initial in zip(audit, roles, strict=True):
            turn, role, text = (None, "", "") if edit == "I" else self.rows.popleft()[:3]
            if edit == "D":
                continue
            if edit != "K":
                role = next(r for r in ROLES if r[0] == initial)
            if self.places:
                self.digest.update(b"\n")
            self.digest.update(f"{role}:{text}".encode())
            if self.emit is not None:
                self.emit.append((self.key, self.places, turn, edit, role, text))
            self.places += 1

    def finish(self) -> tuple:
        """Key, gaps, faults, illegal pairs, cost, audit and digest of the whole conversation."""
        path = whole_path(tuple(r[3:] for r in self.rows)) if self.front is None else _best_end(self.front)
        self.write(*path[1:])
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (self.key, gaps, *self.counts.values(), self.illegal, path[0], "".join(self.settled), self.digest.hexdigest())


def with_faults(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                times: Column | None = None) -> DataFrame:
    """Rows ``_conv, _turn, _role, _text, _initial, _fault`` of each conversation, together and in order.

    ``times`` says how often a row stands there (once if not given); 0 leaves
    a row without role that only keeps the conversation known. ``_fault`` is
    the first of ``b`` (blank), ``d`` (role and text seen earlier) and ``t``
    (truncated). Repeats are found by conversation, role and text, so no task
    needs all texts of a conversation for it.
    """
    shown = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).cast("bigint").alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("_text"),
        (F.lit(1) if times is None else times).cast("int").alias("_times"))
    # a dropped row has no text to carry
    copies = F.when(F.col("_times") > 0, F.sequence(F.lit(1), F.greatest(F.col("_times"), F.lit(1)))).otherwise(F.array(F.lit(0)))
    stand = shown.withColumn("_copy", F.explode(copies)).withColumns({
        "_role": F.when(F.col("_copy") > 0, F.col("_role")), "_text": F.when(F.col("_copy") > 0, F.col("_text")),
        "_turn": F.when(F.col("_copy") > 0, F.col("_turn"))})
    alike = W.partitionBy("_conv", "_role", "_text").orderBy(F.col("_turn").asc_nulls_first(), "_copy")
    solid = F.rtrim(F.col("_text"), F.lit(BLANKS))
    fault = (F.when(solid == "", "b").when(F.col("_seen") > 1, "d").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "t").otherwise(""))
    return (stand.withColumn("_seen", F.row_number().over(alike))
            .select("_conv", "_turn", "_role", "_text", F.substring("_role", 1, 1).alias("_initial"), fault.alias("_fault"), "_seen")
            .repartition("_conv").sortWithinPartitions("_conv", F.col("_turn").asc_nulls_first(), "_role", "_text", "_seen"))


def _conversations(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in ("_conv", "_turn", "_role", "_text", "_initial", "_fault")], strict=True)


def _run(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Repaired turns, if wanted, and finished conversations, as batches allow."""
    now, emitted, done = None, [] if turns else None, []
    for batch in batches:
        for key, turn, role, text, initial, fault in _conversations(batch):
            if now is None or key != now.key:
                if now is not None:
                    done.append(now.finish())
                now = Conversation(key, emitted)
            if role is not None:
                now.add(turn, role, text, initial, fault)
        yield emitted or [], done
        emitted, done = [] if turns else None, []
        if now is not None:
            now.emit = emitted
    if now is not None:
        done.append(now.finish())
    yield emitted or [], done


def _filled(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def summarise(turns: DataFrame, conv: str = "conv_id", *, times: Column | None = None, **names: str) -> DataFrame:
    """One row per conversation: ``conv``, gaps, faults, illegal pairs, and cost, audit and digest of the cheapest repair.

    Rows are ordered by turn, nulls first, then role and text. Null roles and
    texts count as one space; null ``conv`` is a conversation. Of a row its
    first fault counts, so repeated rows are duplicates. Conversations without
    rows (``times`` 0) have zeros, an empty audit and the digest of an empty
    string. Columns that are not named are not looked at. The digest runs over
    ``role:text`` of the repaired turns, joined by line feeds: texts of one
    conversation pass one after the other through one task, which holds none
    of those that are settled.
    """
    schema = T.StructType([T.StructField(conv, turns.schema[conv].dataType), *SUMMARY.fields])
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, done in _run(batches, False):
            yield _filled(done, shape)

    return with_faults(turns, conv, times=times, **names).mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, conv: str = "conv_id", *, times: Column | None = None, **names: str) -> DataFrame:
    """The turns of the repaired conversations: ``conv, place, turn, edit, role, text``.

    ``edit`` is K (kept), R (given another role) or I (inserted, without turn
    and text); places count from 0. Conversations that lose all turns have no row.
    """
    schema = T.StructType([
        T.StructField(conv, turns.schema[conv].dataType), T.StructField("place", T.LongType()), T.StructField("turn", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]])
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for emitted, _ in _run(batches, True):
            yield _filled(emitted, shape)

    return with_faults(turns, conv, times=times, **names).mapInArrow(run, schema)


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` damaged by a checksum of conversation and turn, and ``times``, how often a row stands there.

    Of twenty remainders 0 drops a row, 1 empties its text, 2 removes its
    marks of an end, 3 repeats it and 4 makes it the user's. Nulls count as one space in the checksum.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    return turns.select(F.col(conv), F.col(turn), F.col(role), F.col(text), kind.alias("_kind")).select(
        conv, turn, F.when(F.col("_kind") == 4, "user").otherwise(shown(role)).alias(role),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(shown(text), ".!?", "")).otherwise(shown(text)).alias(text),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("times"))
