"""Repair of damaged conversations as a lightest derivation.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``. Its repair is a derivation from weighted rules: an
item says that the first rows of a stretch are repaired and which state of that pattern they end in, a row's
edits (keep, rerole, delete) and insertions derive further items, and a goal item is derived from a stretch's last row.
An item's weight is (cost, audit), the audit being the edits' initials; rules add costs and append audits, so no conclusion is
lighter than a premise, and equal costs of one item never come with audits of which one begins the other: Knuth's
agenda pops items lightest first and each popped weight is final, until the goal is. A second kind of rule joins two
stretches that meet in a state, with two premises.

Conversations are stretches of at most ``STRETCH`` rows, cut where rows are dealt by range of (conversation, turn), so a conversation
that holds a large part of all rows is repaired by many tasks; each stretch gives the lightest items from each state that it
can begin in. What is joined for a conversation is its stretches' audits, a byte or two a row and state. Repeated rows
are counted before they are shuffled, the first row of a (role, text) is found by an aggregation, and hot keys
are dealt in parts. Hashing the repaired rows is sequential by nature: they are streamed, sorted, never held.

Defined results: null roles and texts are one space and so is a null id or turn in the damage's key; a null id is a
conversation of its own; rows of one turn are in the order of role, then a digest of id, role and text; a role that is empty or
begins with another letter can't be kept; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import saved, spread_join, table

STRETCH = 1024
#: States of the pattern: nothing yet, behind s, behind u, behind a; those in which a conversation may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
#: Where an initial leads from a state; what isn't there breaks the pattern.
NEXT = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
#: From each state the role that may be inserted or given.
GIVEN = {state: "a" if state == AFTER_U else "u" for state in NEXT}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES, STOPS = r"[\x20\x09-\x0D]", ".!?"

#: A row as the agenda sees it: (initial, whether it must go, whether it is truncated).
Fact = tuple[str, bool, bool]
Weight = tuple[int, str]


def lightest(facts: list[Fact], begin: int, goals: Iterable[int]) -> dict[int, Weight]:
    """The least (cost, audit) with which ``facts``, begun in state ``begin``, end in each of ``goals``; stops when all that
    can be are final."""
    n, wanted, found = len(facts), set(goals), {}
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, begin)]
    final: set[tuple[int, int]] = set()
    while agenda and wanted:
        cost, audit, row, state = heapq.heappop(agenda)
        if (row, state) in final:
            continue
        final.add((row, state))
        if row == n and state in wanted:
            wanted.remove(state)
            found[state] = (cost, audit)
        after = NEXT[state][GIVEN[state]]
        heapq.heappush(agenda, (cost + INSERT, audit + "I", row, after))
        if row < n:
            initial, goes, truncated = facts[row]
            heapq.heappush(agenda, (cost + DELETE, audit + "D", row + 1, state))
            if not goes:
                more = TRUNCATED * truncated
                if initial in NEXT[state]:
                    heapq.heappush(agenda, (cost + more, audit + "K", row + 1, NEXT[state][initial]))
                heapq.heappush(agenda, (cost + REROLE + more, audit + "R", row + 1, after))
    return found


def joined(left: dict[int, Weight], right: dict[int, dict[int, Weight]]) -> dict[int, Weight]:
    """The lightest items of two stretches together: ``left`` by the state it ends in, ``right`` by those it begins and ends in."""
    out: dict[int, Weight] = {}
    for state, (cost, audit) in left.items():
        for end, (more, rest) in right.get(state, {}).items():
            weight = (cost + more, audit + rest)
            if end not in out or weight < out[end]:
                out[end] = weight
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: ``conversations`` (conv_id, turn, role, text) with rows dropped, emptied, stripped of
    stops, doubled or given the role user, by a hash of conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), code.alias("__code"))
    text = F.when(F.col("__code") == 1, F.lit("")).when(F.col("__code") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__code") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.where("__code != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("__code") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"))


def _last(text: Column) -> Column:
    """The last character that isn't white space; empty if there is none."""
    return F.right(F.regexp_replace(text, rf"{SPACES}+\z", ""), F.lit(1))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copies, first, blank, truncated of ``rows`` as ``damaged`` gives them: a row for each turn, role
    and text with how many there are; ``first`` tells whether the first of them is the first of its role and text."""
    digest = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), "role", "text").cast("binary")))
    last = _last(F.col("text"))
    facts = rows.select("conv_id", "turn", "role", digest.alias("digest"), "copies", (last == "").alias("blank"), (~F.instr(F.lit(STOPS), last).cast("boolean")).alias("truncated"))
    told = facts.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    told = saved(told, "repair-facts")
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = saved(told.groupBy("digest").agg(F.min(at).alias("least"), F.count(F.lit(1)).alias("n")), "repair-firsts")
    return spread_join(told, firsts, "digest").withColumn("first", F.col("least") == at).drop("least")


#: A stretch: whose, its rows' numbers, what its ends look like and its lightest items.
_STRETCH = "conv_id {id}, part long, n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, begins array<int>, ends array<int>, costs array<long>, audits array<string>, plans array<string>"
LEGAL = ("su", "ua", "au")


def _plan(audit: str, facts: list[Fact]) -> str:
    """``audit`` without the edits of rows that had to go."""
    out, row = [], 0
    for edit in audit:
        if edit == "I":
            out.append(edit)
            continue
        if not facts[row][1]:
            out.append(edit)
        row += 1
    return "".join(out)


class _Open:
    """The stretch that is being read."""

    def __init__(self, conv_id):
        self.conv_id, self.facts, self.turns, self.counts = conv_id, [], [], [0, 0, 0]
        self.illegal, self.n_turns = 0, 0

    def add(self, turn, role: str, first: bool, blank: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.facts and self.facts[-1][0] + initial not in LEGAL:
            self.illegal += 1
        if turn is not None and (not self.turns or self.turns[1] != turn):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.n_turns += 1
        fault = 0 if blank else 1 if not first else 2 if truncated else None
        if fault is not None:
            self.counts[fault] += 1
        self.facts.append((initial, fault in (0, 1), fault == 2))

    def row(self, part: int, whole: bool) -> dict:
        items = []
        for begin in (START,) if whole else NEXT:
            for end, (cost, audit) in sorted(lightest(self.facts, begin, ENDS if whole else NEXT).items()):
                items.append((begin, end, cost, audit, _plan(audit, self.facts)))
        blank, duplicate, truncated = self.counts
        low, high = self.turns or (None, None)
        out = {"conv_id": self.conv_id, "part": part, "n": len(self.facts), "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": self.illegal, "turns": self.n_turns, "low": low, "high": high, "first": self.facts[0][0], "last": self.facts[-1][0]}
        return out | {name: [i[k] for i in items] for k, name in enumerate(("begins", "ends", "costs", "audits", "plans"))}


def stretches(facts: DataFrame, shares: int | None = None) -> DataFrame:
    """Stretches of the conversations whose rows ``faults`` told. Rows are dealt by range and sorted; those of a conversation that a
    task neither begins nor ends with are its whole."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    ranged = facts.repartitionByRange(shares, *order) if shares else facts.repartitionByRange(*order)
    sorted_rows = ranged.sortWithinPartitions(*order).withColumn("share", F.spark_partition_id())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, part, begun = None, 0, False
        names, schema, done = ("conv_id", "turn", "role", "copies", "first", "blank", "truncated", "share"), None, []

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            schema = schema or _stretch_schema(batch.schema.field("conv_id").type)
            for conv_id, turn, role, copies, first, blank, truncated, share in zip(*(batch[c].to_pylist() for c in names), strict=True):
                for copy in range(copies):
                    if open_ is None or open_.conv_id != conv_id or len(open_.facts) == STRETCH:
                        if open_ is not None:
                            goes_on = open_.conv_id == conv_id
                            done.append(open_.row(part, begun and not goes_on and part % (1 << 32) == 0))
                            begun = True if not goes_on else begun
                            part = part + 1 if goes_on else share << 32
                        else:
                            part = share << 32
                        open_ = _Open(conv_id)
                    open_.add(turn, role, first and copy == 0, blank, truncated)
            if len(done) >= 256:
                yield made(done)
                done = []
        if open_ is not None:
            yield made([*done, open_.row(part, False)])

    return sorted_rows.mapInArrow(read, _STRETCH.format(id=facts.schema["conv_id"].dataType.simpleString()))


def _stretch_schema(id_type: pa.DataType) -> pa.Schema:
    whole, text = pa.int64(), pa.string()
    kinds = {"conv_id": id_type, **dict.fromkeys(("part", "n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high"), whole), "first": text, "last": text}
    return pa.schema({**kinds, "begins": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "costs": pa.list_(whole), "audits": pa.list_(text), "plans": pa.list_(text)})


class _Whole:
    """A conversation: its stretches so far, then the hash of its repaired rows."""

    def __init__(self, conv_id):
        self.conv_id, self.sums, self.last, self.low, self.high, self.turns = conv_id, [0] * 4, None, None, None, 0
        self.items: dict[int, tuple[int, str]] = {START: (0, "")}
        self.plans = {START: ""}
        self.hash, self.any, self.plan, self.at, self.state = hashlib.sha256(), False, None, 0, START

    def stretch(self, row: dict) -> None:
        meets = self.last is not None and self.last + row["first"] not in LEGAL
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.sums[k] += row[name]
        self.sums[3] += meets
        if row["turns"]:
            self.turns += row["turns"] - (self.high == row["low"])
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        self.last = row["last"]
        right: dict[int, dict[int, Weight]] = {}
        plans = {}
        for begin, end, cost, audit, plan in zip(*(row[c] for c in ("begins", "ends", "costs", "audits", "plans")), strict=True):
            right.setdefault(begin, {})[end] = (cost, audit)
            plans[begin, end] = plan
        new = joined(self.items, right)
        parts = {}
        for end, weight in new.items():
            for begin, (cost, audit) in self.items.items():
                more = right.get(begin, {}).get(end)
                if more and (cost + more[0], audit + more[1]) == weight:
                    parts[end] = self.plans[begin] + plans[begin, end]
                    break
        self.items, self.plans = new, parts

    def settle(self) -> None:
        if self.plan is None:
            end = min((e for e in ENDS if e in self.items), key=lambda e: self.items[e])
            self.cost, self.audit = self.items[end]
            self.plan, self.items, self.plans = self.plans[end], {}, {}

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
        self.any = True
        self.state = NEXT[self.state][role[:1]]

    def _inserted(self) -> None:
        while self.at < len(self.plan) and self.plan[self.at] == "I":
            self._line(ROLES[GIVEN[self.state]], "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        self.settle()
        self._inserted()
        edit = self.plan[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else ROLES[GIVEN[self.state]], text)

    def result(self) -> dict:
        self.settle()
        self._inserted()
        blank, duplicate, truncated, illegal = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


def repaired(conversations: DataFrame, rows: DataFrame, shares: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conv_id of ``conversations``, for
    ``rows`` (conv_id, turn, role, text, copies)."""
    found = stretches(faults(rows), shares)
    digest = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), "role", "text").cast("binary")))
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    texts = rows.where(_last(F.col("text")) != "").groupBy("conv_id", digest.alias("digest")).agg(F.min(at).alias("at"), F.first("role").alias("role"), F.first("text").alias("text"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c not in ("conv_id", "part")]
    numbers = [c for c, _ in found.dtypes if c not in ("conv_id", "part")]
    empty_text = [F.lit(None).cast("struct<some:boolean,turn:bigint>").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text")]
    ids = conversations.groupBy("conv_id").count().select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), *nothing, *empty_text)
    middle = found.select("conv_id", F.lit(1).alias("kind"), "part", *numbers, *empty_text)
    ends = texts.select("conv_id", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("part"), *nothing, F.struct(F.col("at.some"), F.col("at.turn")).alias("at"), "role", "digest", "text")
    told = ids.unionByName(middle).unionByName(ends).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", "part", "at", "role", "digest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, schema = None, [], None
        whole = pa.int64()
        for batch in batches:
            schema = schema or pa.schema({"conv_id": batch.schema.field("conv_id").type, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), whole), "audit": pa.string(), "repaired_sha256": pa.string()})
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if now is not None:
                        done.append(now.result())
                    now = _Whole(row["conv_id"])
                elif row["kind"] == 1:
                    now.stretch(row)
                else:
                    now.text(row["role"], row["text"])
            if len(done) >= 1024:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([*done, now.result()], schema)

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return told.mapInArrow(read, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired at least cost."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(conversations, damaged(conversations))
