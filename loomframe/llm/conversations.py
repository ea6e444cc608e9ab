"""Conversation structure repair: the cheapest edits that make each conversation follow the grammar of turns."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import arrow_rows, materialize, release, table

SPACES = r"[\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
NAMES = {"s": "system", "u": "user", "a": "assistant"}
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
# States: nothing yet, a system turn, a user turn, an assistant turn; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
#: (from, to, most): whatever follows state ``from`` can follow state ``to`` at ``most`` more, by an insertion or by deleting a system turn.
DETOURS = [(START, ASSISTANT, 3), (START, USER, 5), (SYSTEM, ASSISTANT, 0), (SYSTEM, USER, 2), (USER, ASSISTANT, 2), (ASSISTANT, USER, 2)]
SETTLE = 256
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""


class Repair:
    """Forward dynamic program over a conversation's turns: for each state the least (cost, audit) that reaches it.

    Audits of equal cost differ before either ends, as both have a letter for each turn and a cost for each letter; so the
    lesser one stays the lesser one whatever follows. States that a detour makes needlessly dear are dropped (never one that
    could still win or tie), after which the audits that are left soon agree in all but their last letters: what they agree
    in is set aside every SETTLE turns, so that comparing them costs the same in a long conversation.
    """

    def __init__(self) -> None:
        self.settled: list[str] = []
        self.live: dict[int, tuple[int, str]] = {START: (0, "")}
        self.turns = 0
        self._insert()

    def _offer(self, live: dict[int, tuple[int, str]], state: int, cost: int, audit: str) -> None:
        if state not in live or (cost, audit) < live[state]:
            live[state] = cost, audit

    def _insert(self) -> None:
        """Close a layer with insertions: two at most can be of use, as a third would lead back."""
        for _ in range(2):
            for state, (cost, audit) in list(self.live.items()):
                for role, then in NEXT[state].items():
                    if role != "s":
                        self._offer(self.live, then, cost + COSTS[INSERT], audit + INSERT)

    def add(self, role: str, fault: str) -> None:
        """A turn: the first letter of its role, and its fault."""
        after: dict[int, tuple[int, str]] = {}
        more = TRUNCATED_COST if fault == CUT else 0
        for state, (cost, audit) in self.live.items():
            self._offer(after, state, cost + COSTS[DELETE], audit + DELETE)
            if fault in (BLANK, DUPLICATE):
                continue
            for to, then in NEXT[state].items():
                if to == role:
                    self._offer(after, then, cost + COSTS[KEEP] + more, audit + KEEP)
                if to != "s":
                    self._offer(after, then, cost + COSTS[REROLE] + more, audit + REROLE)
        self.live = after
        self._insert()
        for dear, other, most in DETOURS:
            if dear in self.live and other in self.live and self.live[dear][0] > self.live[other][0] + most:
                del self.live[dear]
        self.turns += 1
        if self.turns % SETTLE == 0:
            common = os.path.commonprefix([audit for _, audit in self.live.values()])
            self.settled.append(common)
            self.live = {s: (c, a[len(common) :]) for s, (c, a) in self.live.items()}

    def best(self) -> tuple[int, str]:
        cost, audit = min(self.live[s] for s in ENDS if s in self.live)
        return cost, "".join(self.settled) + audit


def roles_of(audit: str) -> str:
    """The role letters that an audit ends in: an odd number of turns begins with a system turn."""
    n = len(audit) - audit.count(DELETE)
    return "s" * (n % 2) + "ua" * (n // 2)


FOUND = "kind string, key string, place long, sub int, edit string, role string, cost long, audit string, illegal long"
_FOUND_ARROW = pa.schema(
    [("kind", pa.string()), ("key", pa.string()), ("place", pa.int64()), ("sub", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("cost", pa.int64()),
     ("audit", pa.string()), ("illegal", pa.int64())]
)
LEGAL = {"su", "ua", "au"}
ROWS_OUT = 20_000


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (key, place, role, fault, n), conversations one after the other in order of turns.

    Gives an ``edit`` row for each turn that is left or inserted (sub: 0 for the turn itself, above for what is inserted
    after it; place -1: before all), and a ``total`` row for each conversation. Holds a few bytes a turn, no texts.
    """
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND_ARROW)], schema=_FOUND_ARROW)
        out.clear()
        return made

    def closed(key, repair: Repair, places: list[tuple[int, int]], illegal: int) -> Iterator[pa.RecordBatch]:
        cost, audit = repair.best()
        roles = iter(roles_of(audit))
        turns = (place for place, n in places for _ in range(n))
        place, sub = -1, 0
        for edit in audit:
            if edit == INSERT:
                sub += 1
            else:
                place, sub = next(turns), 0
            if edit != DELETE:
                out.append(("edit", key, place, sub, edit, NAMES[next(roles)], None, None, None))
                if len(out) >= ROWS_OUT:
                    yield batch()
        out.append(("total", key, None, None, None, None, cost, audit, illegal))
        if len(out) >= ROWS_OUT:
            yield batch()

    key, repair, places, illegal, last = None, None, [], 0, None
    for rows in batches:
        for k, place, role, fault, n in zip(*(c.to_pylist() for c in rows.columns)):
            if repair is None or k != key:
                if repair is not None:
                    yield from closed(key, repair, places, illegal)
                key, repair, places, illegal, last = k, Repair(), [], 0, None
            places.append((place, n))
            for i in range(n):
                repair.add(role, fault if i == 0 else fault if fault == BLANK else DUPLICATE)
                illegal += last is not None and last + role not in LEGAL
                last = role
    if repair is not None:
        yield from closed(key, repair, places, illegal)
    if out:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (key, line) in order: the SHA-256 of each key's lines, joined by line feeds, as they go by."""
    key, sha = None, None
    keys, told = [], []
    for rows in batches:
        for k, line in zip(*(c.to_pylist() for c in rows.columns)):
            if sha is None or k != key:
                if sha is not None:
                    keys.append(key)
                    told.append(sha.hexdigest())
                key, sha = k, hashlib.sha256(line.encode())
            else:
                sha.update(b"\n" + line.encode())
        if len(keys) >= ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(told, pa.string())], ["key", "digest"])
            keys, told = [], []
    if sha is not None:
        keys.append(key)
        told.append(sha.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(told, pa.string())], ["key", "digest"])


def key_of(conv: Column) -> Column:
    """A conversation's id as text that tells null from all others."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def ordered_turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(key, turn, role, text, n, fault, place): the distinct turns of all conversations in order, as a written table.

    Equal rows of a turn are one with their number ``n``. The order is turn (nulls first), then role and text where a turn has several rows. It
    comes from a range partitioning, which may cut a conversation anywhere: no conversation has to fit in a task.
    fault: the first of blank, duplicate (role and text stood in an earlier turn), truncated that holds of the first of the n.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = rows.select(key_of(F.col(conv_col)).alias("key"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns = turns.withColumn("h", F.xxhash64("text")).groupBy("key", "turn", "role", "h", "text").agg(F.count(F.lit(1)).cast("int").alias("n"))
    merged = materialize(turns, "turns")
    # The first turn of each role and text; nulls come before all turns.
    first = merged.groupBy("key", "role", "h", "text").agg(F.min("turn").alias("first"), F.bool_or(F.isnull("turn")).alias("null_first"), F.count(F.lit(1)).alias("stands"))
    again = first.where("stands > 1").select("key", "role", "h", "text", "first", "null_first")
    seen = merged.join(again, ["key", "role", "h", "text"], "left")
    duplicate = F.coalesce(F.when(F.col("null_first"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), F.lit(False))
    bare = F.regexp_replace("text", SPACES, "")
    sound = F.substring(bare, -1, 1).isin(".", "!", "?")
    fault = F.when(bare == "", BLANK).when(duplicate, DUPLICATE).when(~sound, CUT).otherwise(SOUND)
    faulty = seen.select("key", "turn", "role", "text", "n", fault.alias("fault"))
    by = ["key", F.asc_nulls_first("turn"), "role"]
    ordered = faulty.repartitionByRange(*by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "turns-ordered")
    release(merged)
    return placed


class Repaired(NamedTuple):
    turns: DataFrame
    reports: DataFrame
    tables: tuple[DataFrame, ...]  # what both read: to be released when they have been read


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repaired:
    """Repaired turns and reports of all conversations, both over ``key`` (see ``key_of``).

    Repaired turns: (key, place, sub, edit, role, text), in order of place and sub: what the cheapest edits keep, give another
    role or insert (empty text), so that the roles read ``(s?(ua)+)?``. Reports: a row for each conversation, with gaps,
    the faults counted, illegal neighbours, cost and audit. Blank and repeated turns are always deleted. Null roles and texts
    are one space. A null id is a conversation, a null turn comes first; an empty role is none, and is never kept as it is.
    The dynamic program runs over letters, conversation by conversation; texts are joined to its edits by place afterwards.
    """
    placed = ordered_turns(rows, conv_col, turn_col, role_col, text_col)
    letters = placed.select("key", "place", F.substring("role", 1, 1).alias("role"), "fault", "n")
    found = materialize(letters.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_repaired, FOUND), "turns-repaired")
    extra = lambda fault: F.sum(F.when(F.col("fault") == fault, F.col("n")).otherwise(0))
    once = lambda fault: F.sum(F.when(F.col("fault") == fault, 1).otherwise(0))
    repeats = F.sum(F.when(F.col("fault").isin(BLANK, DUPLICATE), 0).otherwise(F.col("n") - 1))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counted = placed.groupBy("key").agg(
        span.alias("gaps"), extra(BLANK).alias("blank"), (extra(DUPLICATE) + repeats).alias("duplicate"), once(CUT).cast("long").alias("truncated")
    )
    reports = counted.join(found.where("kind = 'total'").select("key", "illegal", "cost", "audit"), "key")
    edits = found.where("kind = 'edit'").select("key", "place", "sub", "edit", F.col("role").alias("to"))
    own = placed.select("place", F.col("role").alias("was"), "text").join(edits.where("sub = 0"), "place")
    kept = own.select("key", "place", "sub", "edit", F.when(F.col("edit") == KEEP, F.col("was")).otherwise(F.col("to")).alias("role"), "text")
    inserted = edits.where("edit = 'I'").select("key", "place", "sub", "edit", F.col("to").alias("role"), F.lit("").alias("text"))
    return Repaired(kept.unionByName(inserted), reports, (placed, found))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with the faults that crc32 of ``conv_id:turn`` deals out: dropped, emptied, unpunctuated, repeated, of role user."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    given = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), dealt.alias("dealt")).where("dealt <> 0")
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("dealt") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("dealt") == 3, 2).otherwise(1)))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of every conversation after damage, with the digest of its repaired turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, reports, tables = repair_conversations(damaged(rows))
    lines = turns.select("key", "place", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    in_order = lines.repartition("key").sortWithinPartitions("key", "place", "sub").select("key", "line")
    digests = in_order.mapInArrow(_digests, "key string, digest string")
    whole = rows.select(key_of(F.col("conv_id")).alias("key"), "conv_id").distinct().join(reports, "key", "left").join(digests, "key", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    told = whole.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(nothing)).alias("repaired_sha256"))
    with arrow_rows(spark, 2000):
        found = materialize(told, "conversations-repaired")
    release(*tables)
    return found
