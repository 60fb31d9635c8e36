"""Repair of conversation structure: cheapest edits that give the role pattern ``(s?(ua)+)?``.

The edit lattice of a conversation has a node for every row boundary and state of the pattern; its edges keep,
rerole or delete the next row or insert a turn.  Dijkstra runs from both ends at once.  The heaps have met when
their least costs together pass the best total found; by then every crossing of equal cost is finished, and of
their audits (edit initials in order) the least is taken.

Audits of equal cost to one node are never prefixes of each other: the longer one would hold the same edits and
insertions besides, which cost.  So the least of joined audits is made of least parts, and a long conversation
is cut into blocks of rows: each is solved on its own for every pair of states at its ends, and neighbouring
blocks are joined, ``FAN`` at a time, until one is left.  Texts stay out of this; they are read once, in order, as
a stream, to apply the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.common import bounded_batches, partitions, stage

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs; keeping is free, an undeleted truncated row adds the last
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)  # states of the pattern; the first and last may end it
STEP = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)  # state behind the next user or assistant turn
KEEP = {"s": {START: AFTER_SYSTEM}, "u": {q: AFTER_USER for q in (START, AFTER_SYSTEM, AFTER_ASSISTANT)}, "a": {AFTER_USER: AFTER_ASSISTANT}}
LEGAL = {"su", "ua", "au"}
BLOCK = 1_024  # rows of a conversation that are solved at a time
FAN = 16
LONG = (1 << 63) - 1

# One letter for a row: its role's initial (s, u, a, any other) and its fault (none, blank, duplicate, truncated).
INITIALS, FAULTS = "suao", ("", "blank", "duplicate", "truncated")
CODES = "ABCDEFGHIJKLMNOP"


def row_edits(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that take one row."""
    initial, fault = INITIALS[CODES.index(letter) // 4], FAULTS[CODES.index(letter) % 4]
    out = [("D", DELETE, state)]
    if fault in ("blank", "duplicate"):
        return out
    extra = TRUNCATED if fault == "truncated" else 0
    if (kept := KEEP.get(initial, {}).get(state)) is not None:
        out.append(("K", extra, kept))
    return [*out, ("R", REROLE + extra, STEP[state])]


@lru_cache(1)
def _edges() -> tuple[dict, dict]:
    """Edges that take a row, by its letter: leaving a state and entering one."""
    ahead = {c: [row_edits(c, q) for q in range(4)] for c in CODES}
    behind: dict = {c: [[] for _ in range(4)] for c in CODES}
    for c in CODES:
        for q in range(4):
            for edit, cost, to in ahead[c][q]:
                behind[c][to].append((edit, cost, q))
    return ahead, behind


def solve(rows: str, first: int, last: int) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest way through ``rows`` from state ``first`` to ``last``; None without one.

    Both searches settle nodes by cost and, within a cost, along their direction; only keeping is free and it
    moves by a row, so a label is final when it is settled.
    """
    ahead, behind = _edges()
    n = len(rows)

    def leaving(node):
        i, q = node
        yield "I", INSERT, (i, STEP[q])
        if i < n:
            for edit, cost, to in ahead[rows[i]][q]:
                yield edit, cost, (i + 1, to)

    def entering(node):
        i, q = node
        for p in range(4):
            if STEP[p] == q:
                yield "I", INSERT, (i, p)
        if i:
            for edit, cost, p in behind[rows[i - 1]][q]:
                yield edit, cost, (i - 1, p)

    labels = ({(0, first): (0, "")}, {(n, last): (0, "")})
    settled: tuple[dict, dict] = ({}, {})
    heaps = ([(0, 0, (0, first))], [(0, -n, (n, last))])
    best: tuple[int, str] | None = None

    def offer(cost: int, before: str, after: str) -> None:
        nonlocal best
        if best is None or cost < best[0] or (cost == best[0] and before + after < best[1]):
            best = (cost, before + after)

    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, node = heappop(heaps[side])
        if node in settled[side] or cost > labels[side][node][0]:
            continue
        audit = settled[side][node] = labels[side][node][1]
        if node in settled[1 - side]:
            other = labels[1 - side][node]
            offer(cost + other[0], *((audit, other[1]) if side == 0 else (other[1], audit)))
        for edit, extra, to in leaving(node) if side == 0 else entering(node):
            longer = audit + edit if side == 0 else edit + audit
            if to in settled[1 - side]:
                other = labels[1 - side][to]
                offer(cost + extra + other[0], *((longer, other[1]) if side == 0 else (other[1], longer)))
            if to not in settled[side]:
                known = labels[side].get(to)
                if known is None or (cost + extra, longer) < known:
                    labels[side][to] = (cost + extra, longer)
                    heappush(heaps[side], (cost + extra, to[0] if side == 0 else -to[0], to))
    return best


@lru_cache(50_000)
def _solved(rows: str, whole: bool) -> list[tuple[int, str] | None]:
    """Best ways for each pair of states at the ends; of a whole conversation only those that count."""
    wanted = {(START, START), (START, AFTER_ASSISTANT)} if whole else {(p, q) for p in range(4) for q in range(4)}
    return [solve(rows, p, q) if (p, q) in wanted else None for p in range(4) for q in range(4)]


def joined(left: list, right: list) -> list[tuple[int, str] | None]:
    """Best ways through two neighbouring blocks."""
    out: list = []
    for p in range(4):
        for q in range(4):
            ways = [
                (a[0] + b[0], a[1] + b[1])
                for m in range(4)
                if (a := left[4 * p + m]) is not None and (b := right[4 * m + q]) is not None
            ]
            out.append(min(ways) if ways else None)
    return out


_WAYS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_WAYS_DDL = "array<struct<cost: bigint, audit: string>>"


def _as_structs(ways: list) -> list:
    return [None if w is None else {"cost": w[0], "audit": w[1]} for w in ways]


def _solve_blocks(rows: pa.Array, whole: pa.Array) -> pa.Array:
    found = zip(rows.to_pylist(), whole.to_pylist(), strict=True)
    return pa.array([_as_structs(_solved(r, w)) for r, w in found], _WAYS)


def _join_blocks(groups: pa.Array) -> pa.Array:
    out = []
    for group in groups.to_pylist():
        ways = [[w and (w["cost"], w["audit"]) for w in block] for block in group]
        total = ways[0]
        for block in ways[1:]:
            total = joined(total, block)
        out.append(_as_structs(total))
    return pa.array(out, _WAYS)


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after damage by ``crc32(conv_id:turn) % 20``; nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    kind = F.col("__kind")
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("__kind"))
    rows = rows.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    )
    return rows.drop("__copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with nulls as one space and a digest of conversation, role and text; their order is that of ORDER."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    named = F.concat(conv, F.lit(":"), F.length(role).cast("string"), F.lit(":"), role, text)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.unhex(F.sha2(named.cast("binary"), 256)).alias("digest"),
    )


ORDER = ("conv_id", "turn", "role", "digest")


def _letters() -> Column:
    initial = F.substring("role", 1, 1)
    at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), 1).when(F.col("duplicate"), 2).when(F.col("truncated"), 3).otherwise(0)
    return F.substring(F.lit(CODES), at * 4 + fault + 1, F.lit(1))


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, k, letters, n_blocks)``: rows of each conversation in order, ``block`` at most to a row, written.

    Positions come from a range partitioning by conversation and order, which cuts a conversation of any size.  A
    duplicate is what stands behind the first of its digest; firsts are written, so copies of one turn, however
    many, are on the side of that join that can be split.
    """
    n = partitions(rows.sparkSession)
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    narrow = _ordered(rows).select(
        *ORDER,
        (F.length(F.trim(F.col("text"), F.lit(SPACES))) == 0).alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
        F.monotonically_increasing_id().alias("spread"),
    )
    placed = narrow.repartitionByRange(n, *ORDER, "spread").sortWithinPartitions(*ORDER, "spread")
    placed = stage(placed.withColumn("at", F.monotonically_increasing_id()).drop("spread", "turn"), "turns")
    firsts = placed.groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stage(firsts.select("digest", "first"), "first-turns")
    told = placed.join(firsts, "digest", "left").withColumn("duplicate", F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    coded = told.select("conv_id", "at", F.floor(F.col("at") / block).alias("block"), _letters().alias("letter"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "letter")))
    cut = coded.groupBy("conv_id", "block").agg(F.array_join(F.transform(in_order, lambda r: r["letter"]), "").alias("letters"))
    own = Window.partitionBy("conv_id")
    numbered = cut.withColumn("k", F.row_number().over(own.orderBy("block")) - 1).withColumn("n_blocks", F.count(F.lit(1)).over(own))
    return stage(numbered.select("conv_id", F.col("k").cast("long").alias("k"), "letters", "n_blocks"), "turn-blocks")


def _illegal(letters: Column) -> Column:
    """Neighbouring rows within a block whose initials do not follow each other."""
    roles = F.translate(letters, CODES, "".join(INITIALS[i // 4] for i in range(16)))
    pairs = F.transform(F.sequence(F.lit(1), F.length(letters)), lambda i: F.substring(roles, i, F.lit(2)))
    return F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin(*LEGAL))).cast("long")


def _fault(letters: Column, fault: str) -> Column:
    own = "".join(c for i, c in enumerate(CODES) if FAULTS[i % 4] == fault)
    return F.length(F.regexp_replace(letters, f"[^{own}]", "")).cast("long")


def repair(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation, written.

    ``rows`` has (conv_id, turn, role, text); null roles and texts count as one space, rows without conv_id are one
    conversation.  Rows stand by turn, nulls first, then by role and by a digest of role and text; repeated
    rows are duplicates.  Conversations of ``ids`` that have no row get zeros and an empty audit.  ``gaps``
    ends at the largest long.
    """
    cut = blocks(rows, block)
    initials = F.translate(F.col("letters"), CODES, "".join(INITIALS[i // 4] for i in range(16)))
    seam = F.concat(F.lag(F.right(initials, F.lit(1))).over(Window.partitionBy("conv_id").orderBy("k")), F.substring(initials, 1, 1))
    counted = cut.select(
        "conv_id",
        *[_fault(F.col("letters"), f).alias(f) for f in FAULTS[1:]],
        (_illegal(F.col("letters")) + F.when(seam.isNotNull() & ~seam.isin(*LEGAL), 1).otherwise(0)).alias("illegal"),
    )
    whole = F.col("n_blocks") == 1
    ways = cut.select("conv_id", "k", "n_blocks", F.arrow_udf(_solve_blocks, _WAYS_DDL)("letters", whole).alias("ways"))
    most = cut.agg(F.max("n_blocks")).first()[0] or 0
    if most > 1:
        ways = stage(ways, "ways")
        long = ways.where(~whole).select("conv_id", "k", "ways")
        while most > 1:
            group = long.groupBy("conv_id", F.floor(F.col("k") / fan).alias("k"))
            listed = group.agg(F.array_sort(F.collect_list(F.struct("k", "ways"))).alias("parts"))
            parts = F.transform("parts", lambda p: p["ways"])
            long = stage(listed.select("conv_id", "k", F.arrow_udf(_join_blocks, _WAYS_DDL)(parts).alias("ways")), "ways")
            most = -(-most // fan)
        ways = ways.where(whole).select("conv_id", "k", "ways").unionByName(long)
    ends = F.array_compact(F.array(F.col("ways")[4 * START + START], F.col("ways")[4 * START + AFTER_ASSISTANT]))
    best = ways.select("conv_id", F.array_min(ends).alias("best")).select("conv_id", "best.cost", "best.audit")

    # Turns between the first and the last that no row has; repeated turns are folded before conversations are.
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("decimal(38,0)").alias("turn"))
    span = turns.distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    span = span.select("conv_id", F.least(F.coalesce("gaps", F.lit(0)), F.lit(LONG)).cast("long").alias("gaps"))
    every = span if ids is None else span.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")), allowMissingColumns=True)
    merged = every.unionByName(counted, allowMissingColumns=True).unionByName(best, allowMissingColumns=True)
    totals = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS[1:], "illegal", "cost")]
    out = merged.groupBy("conv_id").agg(*totals, F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    return stage(out, "repairs")


_TURNS = "conv_id long, position long, edit string, role string, text string"
ROWS = 4_096


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk along each conversation's audit, which stands in front of its rows."""
    out: list[tuple] = []
    held = 0
    audit, at, state, made, conv = "", 0, START, 0, None

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal made, held
        out.append((conv, made, edit, role, text))
        made += 1
        held += len(text)

    def spoken() -> str:
        nonlocal state
        state = STEP[state]
        return "user" if state == AFTER_USER else "assistant"

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            emit("I", spoken(), "")
            at += 1

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal out, held
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "position", "edit", "role", "text"])
            out, held = [], 0

    for batch in batches:
        for is_row, own, role, text, edits in zip(*(batch.column(i) for i in range(5)), strict=True):
            if not is_row.as_py():
                audit, at, state, made, conv = edits.as_py(), 0, START, 0, own.as_py()
                inserts()
                continue
            edit, at = audit[at], at + 1
            if edit == "K":
                state = KEEP[role.as_py()[0]][state]
                emit("K", role.as_py(), text.as_py())
            elif edit == "R":
                emit("R", spoken(), text.as_py())
            inserts()
            if len(out) >= ROWS or held > 1 << 22:
                yield from flush()
    yield from flush()


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """``(conv_id, position, edit, role, text)`` of the repaired conversations, each whole and in order in one partition.

    Rows are streamed; a task holds an audit and a batch of rows, whatever a conversation's size.
    """
    body = _ordered(rows).select(F.lit(True).alias("is_row"), *ORDER, "text", F.lit(None).cast("string").alias("audit"))
    head = repairs.select(F.lit(False).alias("is_row"), "conv_id", "audit")
    both = body.unionByName(head, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *ORDER[1:])
    return bounded_batches(both).select("is_row", "conv_id", "role", "text", "audit").mapInArrow(_apply, _TURNS)


def _hash_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, found = None, None, []
    for batch in batches:
        for own, position, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            if position == 0:
                if state is not None:
                    found.append((conv, state.hexdigest()))
                conv, state = own, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if len(found) >= ROWS:
            yield _digests(found)
            found = []
    if state is not None:
        found.append((conv, state.hexdigest()))
    if found:
        yield _digests(found)


def _digests(found: list[tuple]) -> pa.RecordBatch:
    cols = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string()), strict=True)], ["conv_id", "sha256"])


def turn_digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, sha256)`` of ``role:text`` joined by newlines, of turns as :func:`repaired_turns` deals them."""
    return turns.mapInArrow(_hash_turns, "conv_id long, sha256 string")
