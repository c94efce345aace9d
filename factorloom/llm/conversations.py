"""Conversation structure repair: the least edits that make a conversation's roles alternate.

The roles of a conversation, by their initials, should read ``(s?(ua)+)?``: an optional
system message, then pairs of a user's and an assistant's.  A conversation is an acceptor
of its initials, edits are a transducer, the wanted form is a grammar, and the edits chosen
are the shortest path of the three composed (:mod:`transducers`): least cost, then least
letters of the edits in ASCII order.  Keeping (K) is free, another role (R) costs 1,
deletion (D) 2, an inserted empty message (I) 5.  Blank messages and ones whose role and
text came earlier have to be deleted; a message that doesn't end in ``.``, ``!`` or ``?``
costs 5 more unless it is deleted.

:func:`damaged` makes the faults that the operator is tried on, :func:`repaired_messages`
gives the repaired conversations, :func:`repair_digests` a line for each.

Defined results
* null conv_id, turn, role and text count as one space in the damage; rows without a conv_id
  are one conversation, whose conv_id is null; rows without a turn come first;
* rows of one conversation and turn are ordered by role and digest of the text, so repeated
  rows are neighbours, and all but the first of them duplicates;
* other roles than system, user and assistant count by their initial; an empty role fits nowhere;
* a conversation without rows after damage has zeros, no edits and the hash of the empty string;
* an empty table gives an empty result; extra columns are never read.

Scale: equal rows are counted before they are shuffled.  First appearances are minima by
(conversation, role, digest) that are joined back, so no message's copies meet in one task.
A conversation's rows then stream through one task in order, without their texts, at eight
bytes a row; its texts do the same behind its edits, at one byte a row, since its hash needs
them in order.  Nothing else of a conversation is held, so a very long one is bounded by the
length of its row of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .transducers import INSERT, Composition, Edits, Follower, Grammar, Symbol

#: The wanted form (s?(ua)+)? and what its initials stand for.
GRAMMAR = Grammar(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), frozenset((0, 3)))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
_WHITE = " \t\n\x0b\f\r"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ROW = 1
#: Rows of a batch that a task gives back.
BATCH = 4096


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: by the checksum of conv_id and turn, a row in twenty each is dropped (0), emptied (1), loses its full stops (2), is repeated (3) or gets the role user (4)."""
    fault = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(_spaced("text"), "[.!?]", "")).otherwise(_spaced("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(_spaced("role"))
    copies = F.when(fault == 3, F.lit(2)).otherwise(F.lit(1)).cast("long")
    return conversations.where(fault != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def as_given(conversations: DataFrame) -> DataFrame:
    """The same columns without damage."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"), F.lit(1).cast("long").alias("copies"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Conversations one after another in each partition, each after its heading (kind 0)."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text_md5")


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without texts, equal ones as one: whether they are blank, the first of their kind, truncated."""
    text = F.col("text")
    ending = F.right(F.rtrim(text, F.lit(_WHITE)), F.lit(1))
    marked = rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "copies", (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~ending.isin(".", "!", "?")).alias("truncated"))
    counted = marked.groupBy("conv_id", "turn", "role", "text_md5", "blank", "truncated").agg(F.sum("copies").alias("copies")).withColumn("at", F.struct(F.col("turn").isNotNull().alias("given"), "turn"))
    first = counted.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text_md5").alias("m")).agg(F.min("at").alias("first_at"))
    joined = counted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text_md5") == F.col("m")))
    return joined.select("conv_id", "turn", "role", "text_md5", "copies", "blank", "truncated", F.col("at").eqNullSafe(F.col("first_at")).alias("first"))


class _Conversation:
    """What a task holds of the conversation that streams through it."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols = conv_id, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = self.initial = None

    def add(self, turn, role: str, copies: int, blank: bool, truncated: bool, first: bool) -> None:
        if turn is not None and turn != self.last:
            self.least, self.last, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.illegal += copies - 1
        self.initial = initial
        kept = not blank and first
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies - kept
        self.truncated += kept and truncated
        if kept:
            self.symbols.append(_SYMBOLS.setdefault((initial, truncated), Symbol(initial, faulty=truncated)))
        self.symbols.extend([_GONE] * (copies - kept))

    def report(self, machine: Composition) -> tuple:
        cost, audit = machine.shortest(self.symbols)
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


_SYMBOLS: dict = {}
_GONE = Symbol("", must_go=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + sum(len(x) for x in row if isinstance(x, str)) // 1024
        if size >= BATCH:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _arrow(schema: str, id_type: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([pa.field("conv_id", id_type), *[pa.field(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]])


_REPORT = ", ".join([*(f"{c} long" for c in _COUNTS), "audit string"])
_MESSAGE = "kind int, " + _REPORT + ", place long, edit string, turn long, role string, text string"
_DIGEST = _REPORT + ", repaired_sha256 string"


def _reports(edits: Edits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Composition(GRAMMAR, edits)

        def reports(first: pa.RecordBatch) -> Iterator[tuple]:
            held = None
            for conv_id, kind, turn, role, _, copies, blank, truncated, is_first in _rows(_chained(first, batches)):
                if kind == _ROW:
                    held.add(turn, role, copies, blank, truncated, is_first)
                    continue
                if held is not None:
                    yield held.report(machine)
                held = _Conversation(conv_id)
            if held is not None:
                yield held.report(machine)

        seen = next(batches, None)
        if seen is not None:
            yield from _batches(reports(seen), _arrow(_REPORT, seen.schema.field(0).type))

    return run


def _chained(first, rest):
    yield first
    yield from rest


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's report as a row of kind 0, and behind it the messages that its edits leave."""

    def edited(first: pa.RecordBatch) -> Iterator[tuple]:
        nothing = (None,) * (len(_COUNTS) + 1)
        conv_id, audit, at, place, follower = None, "", 0, 0, None

        def inserted():
            nonlocal at, place
            while at < len(audit) and audit[at] == INSERT:
                place, at = place + 1, at + 1
                yield conv_id, _ROW, *nothing, place, INSERT, None, ROLES[follower.give(INSERT)], ""

        for one, kind, turn, role, _, text, copies, *report in _rows(_chained(first, batches)):
            if kind != _ROW:
                yield from inserted()
                conv_id, audit, at, place, follower = one, report[-1], 0, 0, Follower(GRAMMAR)
                yield conv_id, kind, *report, *(None,) * 5
                continue
            for _ in range(copies):
                yield from inserted()
                letter, at = audit[at], at + 1
                given = follower.give(letter, role[:1])
                if given is not None:
                    place += 1
                    yield conv_id, _ROW, *nothing, place, letter, turn, role if letter == "K" else ROLES[given], text
        yield from inserted()

    seen = next(batches, None)
    if seen is not None:
        yield from _batches(edited(seen), _arrow(_MESSAGE, seen.schema.field(0).type))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests(first: pa.RecordBatch) -> Iterator[tuple]:
        report, digest = None, None
        for conv_id, kind, *rest in _rows(_chained(first, batches)):
            if kind != _ROW:
                if report is not None:
                    yield *report, digest.hexdigest()
                report, digest = (conv_id, *rest[: len(_COUNTS) + 1]), sha256()
                continue
            place, _, _, role, text = rest[len(_COUNTS) + 1 :]
            digest.update(b"\n" * (place > 1))
            digest.update(f"{role}:".encode())
            digest.update(text.encode())
        if report is not None:
            yield *report, digest.hexdigest()

    seen = next(batches, None)
    if seen is not None:
        yield from _batches(digests(seen), _arrow(_DIGEST, seen.schema.field(0).type))


def _ddl(conversations: DataFrame, schema: str) -> str:
    return f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, {schema}"


def reports(conversations: DataFrame, rows: DataFrame, edits: Edits = Edits()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation, whose rows are ``rows``."""
    ship_package(conversations.sparkSession)
    headings = conversations.select("conv_id").distinct().withColumn("kind", F.lit(0))
    faults = _faults(rows).withColumn("kind", F.lit(_ROW))
    columns = ("conv_id", "kind", "turn", "role", "text_md5", "copies", "blank", "truncated", "first")
    stream = _in_order(headings.unionByName(faults, allowMissingColumns=True).select(*columns))
    return stream.mapInArrow(_reports(edits), _ddl(conversations, _REPORT))


def _edited(conversations: DataFrame, rows: DataFrame, edits: Edits) -> DataFrame:
    headings = reports(conversations, rows, edits).withColumn("kind", F.lit(0))
    messages = rows.withColumns({"kind": F.lit(_ROW), "text_md5": F.md5("text")})
    columns = ("conv_id", "kind", "turn", "role", "text_md5", "text", "copies", *_COUNTS, "audit")
    stream = _in_order(headings.unionByName(messages, allowMissingColumns=True).select(*columns))
    return stream.mapInArrow(_messages, _ddl(conversations, _MESSAGE))


def repaired_messages(conversations: DataFrame, rows: DataFrame | None = None, edits: Edits = Edits()) -> DataFrame:
    """conv_id, place, edit, turn, role, text of the repaired conversations; ``rows``: what to repair, by default the conversations as they are."""
    rows = as_given(conversations) if rows is None else rows
    return _edited(conversations, rows, edits).where(F.col("kind") == _ROW).select("conv_id", "place", "edit", "turn", "role", "text")


def repair_digests(conversations: DataFrame, rows: DataFrame | None = None, edits: Edits = Edits()) -> DataFrame:
    """The reports, with the SHA-256 of the repaired conversation: ``role:text`` of its messages, joined by line ends."""
    rows = as_given(conversations) if rows is None else rows
    return _edited(conversations, rows, edits).mapInArrow(_digested, _ddl(conversations, _DIGEST))
