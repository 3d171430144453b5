"""Repair of conversation structure by iterative-deepening A*.

A conversation should read `(s?(ua)+)?` by the initials of its roles, without
blank, repeated or cut off rows. Edits: Keep (K) costs nothing, Rerole to user or
assistant (R) 3, Delete (D) 4 and has to be used for blank and repeated rows, Insert (I) of an
empty user or assistant row 3; a cut off row that stays adds 3. Which role a
rerole or an insertion takes follows from the rows before it, so the letters of
the edits say all.

The search goes depth first through the edits in ASCII order (D, I, K, R) under
a cost bound that rises to the least cost it had to leave out. A table keeps
what every failed state needs at least, so no state is entered twice with
a remaining budget that is known to be too small. The first accepting path is the
cheapest, and of the cheapest the least one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches
from gridloom.session import materialise

KEEP_TRUNCATED, REROLE, INSERT, DELETE = 3, 3, 3, 4
#: Where a repaired conversation stands: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The fault of a row as a number; 4 times the role's class (s, u, a, other) plus the fault is the mark of a row.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
_AFTER = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 60


def _needs(marks: bytes) -> tuple[list[int], list[int], int]:
    """Lower bounds of the rest's cost, by the next row of a repaired conversation (user, assistant), and the last system row that may stay.

    They hold for a looser grammar: any stretch of an alternation of user and
    assistant rows, wherever it begins and ends.
    """
    user, assistant, last_system = [0] * (len(marks) + 1), [0] * (len(marks) + 1), -1
    u = a = 0
    for i in range(len(marks) - 1, -1, -1):
        role, fault = divmod(marks[i], 4)
        if fault >= BLANK:
            u, a = u + DELETE, a + DELETE
        else:
            if role == SYSTEM - 1 and last_system < 0:
                last_system = i
            stay = KEEP_TRUNCATED if fault == TRUNCATED else 0
            u, a = (min(u + DELETE, a + stay + (0 if role == 1 else REROLE)), min(a + DELETE, u + stay + (0 if role == 2 else REROLE)))
        u, a = min(u, a + INSERT), min(a, u + INSERT)
        user[i], assistant[i] = u, a
    return user, assistant, last_system


def _moves(marks: bytes, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, next row, next state) in ASCII order."""
    then = _AFTER[state]
    if i < len(marks):
        yield "D", DELETE, i + 1, state
    yield "I", INSERT, i, then
    if i < len(marks):
        role, fault = divmod(marks[i], 4)
        if fault < BLANK:
            stay = KEEP_TRUNCATED if fault == TRUNCATED else 0
            if role + 1 == then:
                yield "K", stay, i + 1, then
            elif role + 1 == SYSTEM and state == START:
                yield "K", stay, i + 1, SYSTEM
            yield "R", REROLE + stay, i + 1, then


def search(marks: bytes) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair, the ASCII-least among equals."""
    n = len(marks)
    if not n:
        return 0, ""
    user, assistant, last_system = _needs(marks)
    failed: dict[tuple[int, int], int] = {}

    def need(i: int, state: int) -> int:
        known = failed.get((i, state))
        if known is not None:
            return known
        if state == USER:
            return assistant[i]
        # a system row that stays first saves its deletion
        return max(0, user[i] - DELETE) if state == START and i <= last_system else user[i]

    bound = need(0, START)
    while True:
        path: list[str] = []
        # a frame: row, state, cost so far, cost of the edit that led here, moves left, least cost left out
        stack = [[0, START, 0, 0, _moves(marks, 0, START), _FAR]]
        while stack:
            frame = stack[-1]
            i, state, spent = frame[0], frame[1], frame[2]
            for edit, cost, j, then in frame[4]:
                least = cost + need(j, then)
                if spent + least > bound:
                    frame[5] = min(frame[5], least)
                    continue
                path.append(edit)
                if j == n and then in (START, ASSISTANT):
                    return spent + cost, "".join(path)
                stack.append([j, then, spent + cost, cost, _moves(marks, j, then), _FAR])
                break
            else:
                stack.pop()
                failed[i, state] = frame[5]
                if stack:
                    path.pop()
                    stack[-1][5] = min(stack[-1][5], frame[3] + frame[5])
        bound = failed[0, START]


@lru_cache(maxsize=1 << 12)
def _search_short(marks: bytes) -> tuple[int, str]:
    return search(marks)


def with_faults(rows: DataFrame) -> DataFrame:
    """Add `digest` (of role and text) and `mark` (role class and fault, repeats not yet seen)."""
    visible = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~visible, BLANK).when(ends, SOUND).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))).withColumn(
        "mark", (role * 4 + fault).cast("int"))


def _repeats(marked: DataFrame) -> DataFrame:
    """The rows without texts; `later` says which come after an equal one of a lower turn (null is the lowest).

    The earliest turn is a grouped minimum, combined before the shuffle, so no
    group of copies has to fit into one task.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    light = marked.select("conv", "turn", "role", "digest", "mark")
    firsts = light.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min(turn).alias("first"))
    later = ~F.struct(F.col("turn").isNotNull(), F.col("turn")).eqNullSafe(F.col("first"))
    return light.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).select("conv", "turn", "role", "digest", "mark", later.alias("later"))


def _ordered(df: DataFrame, *more: str) -> DataFrame:
    """All rows of a conversation after one another, by turn (nulls first), role and digest of the text; sorting spills, nothing is collected."""
    return df.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *[F.col(c) for c in more], F.col("turn").asc_nulls_first(), "role", "digest")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its marks in order."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def judged(conv: int | None, marks: bytes, low: int | None, high: int | None, distinct: int) -> tuple:
        cost, audit = _search_short(marks) if len(marks) <= 64 else search(marks)
        roles, faults = [m // 4 for m in marks], [m % 4 for m in marks]
        fine = sum(pair in ((0, 1), (1, 2), (2, 1)) for pair in pairwise(roles))
        return conv, high - low + 1 - distinct if distinct else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), len(marks) - 1 - fine, cost, audit

    def rows() -> Iterator[tuple]:
        conv, marks, low, high, distinct, before = None, bytearray(), None, None, 0, None
        for batch in batches:
            for c, turn, digest, mark, later in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    if marks:
                        yield judged(conv, bytes(marks), low, high, distinct)
                    conv, marks, low, high, distinct, before = c, bytearray(), None, None, 0, None
                if mark % 4 != BLANK and (later or before == (turn, digest)):
                    mark = mark // 4 * 4 + DUPLICATE
                before = turn, digest
                marks.append(mark)
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
        if marks:
            yield judged(conv, bytes(marks), low, high, distinct)

    return _record_batches(rows(), names, [pa.int64()] * 7 + [pa.string()])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The repaired rows (conversation, role, text, edit) of ordered rows, after a row without edit for each conversation.

    A conversation's edits come first, then its rows; none of them is held.
    """
    conv, audit, at, state = None, "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = _AFTER[state], at + 1
            yield conv, _ROLE[state], "", "I"

    for batch in batches:
        for c, edits, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            yield from inserted()
            if edits is not None:
                conv, audit, at, state = c, edits, 0, START
                yield conv, None, None, None
                continue
            edit, at = audit[at], at + 1
            if edit == "K":
                state = SYSTEM if role[:1] == "s" else _AFTER[state]
                yield conv, role, text, edit
            elif edit == "R":
                state = _AFTER[state]
                yield conv, _ROLE[state], text, edit
    yield from inserted()


def _record_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], at_once: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, at_once)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every repaired conversation, taken row by row."""
    def digests() -> Iterator[tuple]:
        conv, sha, lead = None, None, ""
        for c, role, text, edit in _walk(batches):
            if edit is None:
                if sha:
                    yield conv, sha.hexdigest()
                conv, sha, lead = c, hashlib.sha256(), ""
            else:
                sha.update(f"{lead}{role}:{text}".encode())
                lead = "\n"
        if sha:
            yield conv, sha.hexdigest()

    return _record_batches(digests(), ["conv", "repaired_sha256"], [pa.int64(), pa.string()])


def _write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        place = 0
        for c, role, text, edit in _walk(batches):
            if edit is None:
                place = 0
            else:
                yield c, place, role, text, edit
                place += 1

    return _record_batches(rows(), ["conv", "place", "role", "text", "edit"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])


def _plain(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation that has rows.

    Rows come by turn, null turns first, ties by role and then by a digest of
    the text. Null role or text counts as one blank, rows with a null
    conversation are a conversation of their own, equal rows are kept (all but the first are
    duplicates), other columns are not looked at, an empty table gives an empty
    table. Each row's first fault counts: blank, duplicate, truncated.

    The marks of a conversation (one number a row) are searched by one task; its
    texts only stream past the digest, so their size does not matter.
    """
    rows = with_faults(_plain(conversations, conv_col, turn_col, role_col, text_col))
    found = _audits(rows)
    spelled = map_batches(_told(rows, found), _spell, "conv long, repaired_sha256 string").withColumnRenamed("conv", "c")
    return found.join(spelled, F.col("conv").eqNullSafe(F.col("c"))).drop("c").withColumnRenamed("conv", conv_col)


def repaired(conversations: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows that remain: (conversation, place from 0, role, text, edit), by the audits that `repair` found for the same rows."""
    rows = with_faults(_plain(conversations, conv_col, turn_col, role_col, text_col))
    told = _told(rows, found.select(F.col(conv_col).alias("conv"), "audit"))
    return map_batches(told, _write_out, "conv long, place long, role string, text string, edit string").withColumnRenamed("conv", conv_col)


def _told(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows."""
    heads = found.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(b"").alias("digest"), "audit")
    body = rows.select("conv", "turn", "role", "text", "digest", F.lit(None).cast("string").alias("audit"))
    return _ordered(heads.unionByName(body).withColumn("is_row", F.col("audit").isNull()), "is_row").select("conv", "audit", "role", "text")


def _audits(rows: DataFrame) -> DataFrame:
    marks = _ordered(_repeats(rows)).select("conv", "turn", "digest", "mark", "later")
    kinds = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return materialise(map_batches(marks, _judge, kinds), "audits")  # read twice


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A reproducible trial: by CRC-32 of `conversation:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes it the user's."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    kind: Column = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(F.col(conv_col), F.col(turn_col), F.coalesce(F.col(role_col), blank).alias(role_col), F.coalesce(F.col(text_col), blank).alias(text_col), kind.alias("_kind"))
    rows = rows.where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text_col, ".!?", "")).otherwise(F.col(text_col))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col(role_col))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), times.alias("_time")).drop("_time")
