"""Conversation structure repair: the cheapest edits that make roles alternate and faulty turns go.

Method: each conversation is a signature, a character per turn for role and fault. Signatures share their
suffixes in an automaton that is built from the end: sorted by their reversal, each one continues the path
of the one before as far as both end alike. A node's cost to go and best audit suffix, for each state of
the grammar `(s?(ua)+)?`, are computed once, whatever number of conversations pass it.

Distribution: signatures are cut into segments, so that a long conversation is many rows. Costs over a
segment make a small matrix; a conversation's matrices, folded from its end, give what each segment
is followed by, and equal segments with equal continuations are solved together. Texts travel once, to
the task that writes the repaired conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from tidemark.functions.joins import lookup_join
from tidemark.llm.common import positioned, text_of
from tidemark.session import stored

SEGMENT = 256  # turns of a segment
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 40

BLANK = "[^ \\t\\n\\x0B\\f\\r]"
#: States: nothing yet, after the system turn, after a user's turn, after an assistant's. Each one's next role.
EXPECTED = "uuau"
AFTER = {"s": 1, "u": 2, "a": 3}
#: Cost to go at the end of a conversation: what is still to be inserted.
END = (0, 2 * INSERT, INSERT, 0)
LAST = "end"  # stands for it where costs are keys


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults planted by crc32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes its role
    user. A missing cell reads as one space, but for the columns conv_id and turn themselves.
    """
    space = F.lit(" ")
    cells = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(cells[0], F.lit(":"), cells[1]).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", cells[2].alias("role"), cells[3].alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    )


def clean(rows: DataFrame) -> DataFrame:
    """The four columns, missing roles and texts as one space."""
    return rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, position, initial, fault) in order of turns; fault is blank, duplicate, truncated or null.

    Turns that are missing come first; rows of one turn go by the digest of role and text. No task
    gathers a conversation: rows are dealt by ranges of the order.
    """
    role = F.substring("role", 1, 1)
    last = F.regexp_extract("text", f"({BLANK})[ \\t\\n\\x0B\\f\\r]*\\z", 1)
    light = rows.select(
        "conv_id",
        "turn",
        F.xxhash64("role", "text").alias("tie"),
        F.when(role.isin("s", "u", "a"), role).otherwise("o").alias("initial"),
        F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("own"),
    )
    ordered = positioned(light, ["conv_id", "turn", "tie"], "turns", within="conv_id")
    again = ordered.groupBy("conv_id", "tie").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first")).where("n > 1")
    again = again.select(F.col("conv_id").alias("its_id"), F.col("tie").alias("its_tie"), "first")
    joined = ordered.join(again, F.col("conv_id").eqNullSafe(F.col("its_id")) & (F.col("tie") == F.col("its_tie")), "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("position") > F.col("first"), "duplicate").otherwise(F.col("own"))
    return joined.select("conv_id", "turn", "position", "total", "initial", fault.alias("fault"))


def segments(found: DataFrame) -> DataFrame:
    """Rows (conv_id, segment, last, signature, initials) and the segment's counts of faults."""
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    )

    def in_order(column: str) -> Column:
        return F.array_join(F.transform(F.array_sort("turns"), lambda t: t[column]), "")

    def number(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault).alias(fault)

    return (
        found.withColumn("segment", F.floor(F.col("position") / SEGMENT))
        .groupBy("conv_id", "segment")
        .agg(
            F.collect_list(F.struct("position", symbol.alias("symbol"), "initial")).alias("turns"),
            F.max("total").alias("total"),
            *map(number, ("blank", "duplicate", "truncated")),
        )
        .select(
            "conv_id",
            "segment",
            (F.col("segment") == F.floor((F.col("total") - 1) / SEGMENT)).alias("last"),
            in_order("symbol").alias("signature"),
            in_order("initial").alias("initials"),
            *("blank", "duplicate", "truncated"),
        )
    )


class Node:
    """What follows from one place on: for each state the cost, the audit, and the state behind it."""

    __slots__ = ("audit", "cost", "then")

    def __init__(self, cost: tuple[int, ...], audit: tuple[str, ...], then: tuple[int, ...]):
        self.cost, self.audit, self.then = cost, audit, then


def before(symbol: str, node: Node) -> Node:
    """The node for one more turn in front."""
    options: list[list[tuple[int, str, int]]] = []  # of each state: (cost, edit, state after it)
    extra = TRUNCATED if symbol.isupper() else 0
    for state, expected in enumerate(EXPECTED):
        own = [(DELETE + node.cost[state], "D", state)]
        if symbol != "x":
            role = symbol.lower()
            if role == expected or (role == "s" and state == 0):
                own.append((extra + node.cost[AFTER[role]], "K", AFTER[role]))
            own.append((REROLE + extra + node.cost[AFTER[expected]], "R", AFTER[expected]))
        options.append(own)
    least = [min(own)[0] for own in options]
    # Insertions go round between the states 2 and 3; twice is never of use.
    user, assistant = min(least[2], INSERT + least[3]), min(least[3], INSERT + least[2])
    cost = (min(least[0], INSERT + user), min(least[1], INSERT + user), user, assistant)
    audit: list[str] = [""] * 4
    then = [0] * 4

    def edit(state: int) -> tuple[str, int]:
        """The cheapest edit, of equal ones the least in ASCII."""
        inserted = (INSERT + cost[AFTER[EXPECTED[state]]], "I", AFTER[EXPECTED[state]])
        return min((e, s) for c, e, s in [*options[state], inserted] if c == cost[state])

    chosen = [edit(state) for state in range(4)]
    # States whose edit is an insertion rest on another state of this node, so they come behind it.
    for state in sorted(range(4), key=lambda s: chosen[s][0] == "I" and 1 + (chosen[chosen[s][1]][0] == "I")):
        e, s = chosen[state]
        if e == "I":
            audit[state], then[state] = "I" + audit[s], then[s]
        else:
            audit[state], then[state] = e + node.audit[s], node.then[s]
    return Node(cost, tuple(audit), tuple(then))


def at_end(after: str) -> Node:
    """The node behind the last turn. At the end of a conversation what is missing is inserted there."""
    if after == LAST:
        return Node(END, ("", "II", "I", ""), (0, 3, 3, 3))
    return Node(tuple(map(int, after.split(","))), ("",) * 4, (0, 1, 2, 3))


def key_of(costs: tuple[int, ...]) -> str:
    return ",".join(map(str, costs))


def solved(signatures: DataFrame) -> DataFrame:
    """Distinct (signature, after) with `cost`, `audit` and `then` for each state before the signature.

    Tasks hold ranges of reversed signatures and only the nodes of the current one: those of the suffix
    that it shares with the one before are taken over, so each node of the automaton is computed once.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[Node] = []
        previous, previous_after = "", None
        for batch in batches:
            out: list[Node] = []
            for after, signature in zip(batch["after"].to_pylist(), batch["reversed"].to_pylist()):
                if after != previous_after:
                    path, previous = [at_end(after)], ""
                shared = 0
                while shared < min(len(previous), len(signature)) and previous[shared] == signature[shared]:
                    shared += 1
                del path[shared + 1 :]
                for symbol in signature[shared:]:
                    path.append(before(symbol, path[-1]))
                previous, previous_after = signature, after
                out.append(path[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s[::-1] for s in batch["reversed"].to_pylist()], pa.string()),
                    batch["after"],
                    pa.array([n.cost for n in out], pa.list_(pa.int64())),
                    pa.array([n.audit for n in out], pa.list_(pa.string())),
                    pa.array([n.then for n in out], pa.list_(pa.int32())),
                ],
                names=["signature", "after", "cost", "audit", "then"],
            )

    distinct = signatures.select("after", F.reverse("signature").alias("reversed")).distinct()
    ranged = distinct.repartitionByRange("after", "reversed").sortWithinPartitions("after", "reversed")
    return ranged.mapInArrow(solve, "signature string, after string, cost array<bigint>, audit array<string>, then array<int>")


def continued(parts: DataFrame) -> DataFrame:
    """Segments with `base` and `after`: the costs of what follows each one, for each state behind it."""
    long = parts.where(~F.col("last") | (F.col("segment") > 0))
    units = [key_of(tuple(0 if k == j else NEVER for k in range(4))) for j in range(4)]
    columns = solved(long.select("signature", F.explode(F.array(*map(F.lit, units))).alias("after")))
    place = F.array_position(F.array(*map(F.lit, units)), F.col("after"))
    matrix = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("j"), "cost"))), lambda c: c["cost"])
    matrices = stored(columns.groupBy("signature").agg(matrix.alias("matrix")), "segment-costs")

    def vector(costs: Column, after: Column) -> Column:
        """Costs before a segment from its matrix, a column for each state behind it."""
        return F.array(*[F.least(*[costs[j][s] + after[j] for j in range(4)]) for s in range(4)])

    def behind(segment: Column, after: Column) -> Column:
        base = F.array_min(after)
        rest = F.transform(after, lambda c: (c - base).cast("string"))
        return F.struct(segment.alias("segment"), base.alias("base"), F.array_join(rest, ",").alias("after"))

    # From the last segment to the first, at each one the costs behind it.
    # Without their least, which is kept beside them, so that equal ones meet.
    kind = "struct<after:array<bigint>,found:array<struct<segment:bigint,base:bigint,after:string>>>"
    start = F.struct(F.array(*[F.lit(c).cast("long") for c in END]).alias("after"), F.array().alias("found")).cast(kind)
    fold = F.aggregate(
        F.reverse(F.array_sort(F.collect_list(F.struct("segment", "matrix")))),
        start,
        lambda acc, x: F.struct(
            vector(x["matrix"], acc["after"]).alias("after"),
            F.concat(acc["found"], F.array(behind(x["segment"], acc["after"]))).alias("found"),
        ),
    )
    chains = lookup_join(long, matrices, ["signature"]).groupBy("conv_id").agg(fold["found"].alias("found"))
    afters = chains.select(F.col("conv_id").alias("its_id"), F.inline("found").alias("its_segment", "base", "after"))
    same = F.col("conv_id").eqNullSafe(F.col("its_id")) & (F.col("segment") == F.col("its_segment"))
    followed = long.join(afters, same).drop("its_id", "its_segment").withColumn("after", F.when(F.col("last"), LAST).otherwise(F.col("after")))
    single = parts.where(F.col("last") & (F.col("segment") == 0))
    return single.withColumns({"base": F.lit(0).cast("long"), "after": F.lit(LAST)}).unionByName(followed)


def audited(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit) of all conversations with rows."""
    found = stored(faults(clean(rows)), "faults")
    parts = stored(segments(found), "segments")
    followed = stored(continued(parts), "continued")
    chains = stored(solved(followed), "automaton")
    joined = lookup_join(followed, chains, ["signature", "after"])
    # From the first segment to the last: the state before each one picks its audit.
    walked = F.aggregate(
        F.array_sort(F.collect_list(F.struct("segment", "cost", "audit", "then"))),
        F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("audits")),
        lambda acc, x: F.struct(x["then"][acc["state"]].alias("state"), F.concat(acc["audits"], F.array(x["audit"][acc["state"]])).alias("audits")),
    )
    cost = F.min_by(F.col("base") + F.col("cost")[0], F.col("segment"))
    audits = joined.groupBy("conv_id").agg(cost.alias("cost"), F.array_join(walked["audits"], "").alias("audit"))

    pairs = F.transform(F.sequence(F.lit(1), F.char_length("joint") - 1), lambda i: F.substring(F.col("joint"), i, F.lit(2)))
    wrong = F.when(F.char_length("joint") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    # With the last initial of the segment before.
    previous = F.lag(F.right("initials", F.lit(1)), 1, "").over(Window.partitionBy("conv_id").orderBy("segment"))
    counts = (
        parts.withColumn("joint", F.concat(previous, "initials"))
        .groupBy("conv_id")
        .agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(wrong.cast("long")).alias("illegal"))
    )
    turns = found.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").count()
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    names = ("blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit")
    union = counts.unionByName(gaps, allowMissingColumns=True).unionByName(audits, allowMissingColumns=True)
    merged = union.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in names])
    return merged.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))


def edited(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, place, role, text), each conversation's in order within one task.

    A conversation passes its task row by row behind its audit; texts are never gathered.
    """
    head = audits.select("conv_id", F.lit(0).alias("kind"), "audit")
    body = clean(rows).select("conv_id", F.lit(1).alias("kind"), "turn", F.xxhash64("role", "text").alias("tie"), "role", "text")
    dealt = head.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "tie")
    roles = {"u": "user", "a": "assistant"}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, state, own = "", 0, 0, 0, None
        for batch in batches:
            out: list[tuple] = []

            def put(role: str, text: str) -> None:
                nonlocal place, state
                out.append((own, place, role, text))
                place, state = place + 1, AFTER[role[0]]

            def insertions() -> None:
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put(roles[EXPECTED[state]], "")
                    at += 1

            for conv, kind, its_audit, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "kind", "audit", "role", "text"))):
                if kind == 0:
                    audit, at, place, state, own = its_audit, 0, 0, 0, conv
                    insertions()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(role, text)
                elif edit == "R":
                    put(roles[EXPECTED[state]], text)
                insertions()
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field("conv_id").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                names=["conv_id", "place", "role", "text"],
            )

    conv_type = rows.schema["conv_id"].dataType.simpleString()
    return dealt.select("conv_id", "kind", "audit", "role", "text").mapInArrow(apply, f"conv_id {conv_type}, place bigint, role string, text string")


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns as `edited` gives them: SHA-256 over `role:text`, newline-joined."""
    conv_type = turns.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, running, arrow_type = None, None, pa.int64()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], arrow_type), pa.array([running.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            arrow_type = batch.schema.field("conv_id").type
            for conv, place, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if running:
                        yield row()
                    own, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
        if running:
            yield row()

    return turns.mapInArrow(digest, f"conv_id {conv_type}, repaired_sha256 string")


def repaired(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row per conversation: gaps, counts of faults, illegal neighbours, cost, audit, digest of the repair.

    Rows are (conv_id, turn, role, text); further columns are left out. Missing roles and texts are one
    space, a missing turn comes first, a missing conv_id is a conversation of its own. Equal rows of a
    conversation are duplicates but for the first. `ids` (conv_id) names further conversations, which
    have no rows: zeros, an empty audit, the digest of the empty text. So has one that loses all rows,
    but for its audit. An empty table gives an empty one. `edited` gives the repaired turns themselves.
    """
    audits = stored(audited(rows), "audits")
    digests = digested(edited(rows, audits.select("conv_id", "audit")))
    every = audits.unionByName(digests, allowMissingColumns=True)
    if ids is not None:
        every = every.unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    merged = every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*numbers, "audit", "repaired_sha256")])
    return merged.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        text_of(F.col("audit")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
