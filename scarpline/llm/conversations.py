"""Repair of conversations: faults are found, each distinct pattern of faults is solved once, and the edits are replayed.

A conversation's rows become a signature of one character a row: the role's initial (s, u, a, else o), in upper case if the
text is cut off, or x if the row has to go. The cheapest edits depend on the signature alone, so the distinct ones are
solved by a memoised recursion and the audits are joined back. Rows are streamed in order of conversation and turn, so a
conversation of any length is never held whole but for its signature and audit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import discard, rows_of, stored

SPACES = " \t\n\x0b\x0c\r"
EMPTY_SHA256 = hashlib.sha256().hexdigest()
#: Costs of the edits; a row that is cut off costs one more unless it is deleted.
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FAR = 1 << 60
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
REPAIRED = "conv string, position long, edit string, role string, text string"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that the hash of conversation and turn calls for.

    Nulls in role and text become one space, those in conv_id and turn count as one in the hash. Of twenty remainders 0 drops
    the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats it, and 4 gives it the role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(part("role"))
    rows = conversations.select("conv_id", F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"), kind.alias("kind")).filter("kind <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def _conv(column: Column) -> Column:
    """A key that tells a null conv_id from all others."""
    return F.when(column.isNull(), "").otherwise(F.concat(F.lit("="), column.cast("string")))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their conversation's key, nulls as one space, and their order: turn, nulls first, then two hashes of role and text."""
    filled = rows.select(_conv(F.col("conv_id")).alias("conv"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return filled.select("conv", F.col("turn").isNotNull().alias("timed"), "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "role", "text").alias("h2"), "role", "text")


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its rows in order."""
    names = ("conv", "signature", *COUNTS)
    conv, before, turns, marks, counts = None, None, None, bytearray(), {}

    def ended():
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return (conv, marks.decode(), gaps, *(counts[c] for c in COUNTS[1:]))

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(zip(*out))], list(names))

    for rows in rows_of(batches):
        out = []
        for own, turn, h1, h2, initial, blank, cut, again in zip(*(rows[c] for c in ("conv", "turn", "h1", "h2", "initial", "blank", "cut", "again"))):
            if own != conv:
                if conv is not None:
                    out.append(ended())
                conv, before, turns, marks, counts = own, None, None, bytearray(), dict.fromkeys(COUNTS[1:], 0)
            if before and before[0] + initial not in ("su", "ua", "au"):
                counts["illegal"] += 1
            again = again or before is not None and before[1:] == (turn, h1, h2)
            fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
            if fault:
                counts[fault] += 1
            mark = initial if initial in ("s", "u", "a") else "o"
            marks += (mark if not fault else mark.upper() if fault == "truncated" else "x").encode()
            if turn is not None:
                turns = (turns[0], turn, turns[2] + (turn != turns[1])) if turns else (turn, turn, 1)
            before = (initial, turn, h1, h2)
        if out:
            yield batch_of(out)
    if conv is not None:
        yield batch_of([ended()])


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): conv (its key), signature, gaps, blank, duplicate, truncated, illegal.

    Each row's first fault counts: blank (no visible character), duplicate (role and text met earlier in the conversation), truncated
    (the last visible character is none of `.!?`). gaps counts the turns missing between the least and the largest, illegal the
    adjacent pairs of roles other than system-user, user-assistant and assistant-user. Only hashes of the texts are shuffled.
    """
    seen = F.rtrim(F.col("text"), F.lit(SPACES))
    flags = _keyed(rows).select("conv", "timed", "turn", "h1", "h2", F.left("role", F.lit(1)).alias("initial"), (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    flags = stored(flags)
    # of each role and text the first turn; equal rows of one turn follow one another
    first = flags.groupBy("conv", "h1", "h2").agg(F.min(F.struct("timed", "turn")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = flags.join(first, ["conv", "h1", "h2"], "left").withColumn("again", F.coalesce(F.struct("timed", "turn") > F.col("first"), F.lit(False))).drop("first")
    ordered = told.repartition("conv").sortWithinPartitions("conv", "timed", "turn", "h1", "h2")
    out = stored(ordered.mapInArrow(_signatures, "conv string, signature string, " + ", ".join(f"{c} long" for c in COUNTS)))
    discard(flags)
    return out


def _edits(mark: str | None, state: int, room: int) -> list[tuple[str, int, int, int, int]]:
    """Edits (initial, cost, rows used, state behind it, room for inserts) at a row, or at the end, in the order of their initials."""
    out, behind = [], AFTER_A if state == AFTER_U else AFTER_U
    if mark is not None:
        out.append(("D", COST["D"], 1, state, 2))
    if room:
        out.append(("I", COST["I"], 0, behind, room - 1))
    if mark is not None and mark != "x":
        kept = {"s": AFTER_S if state == START else None, "u": AFTER_U if state != AFTER_U else None, "a": AFTER_A if state == AFTER_U else None}.get(mark.lower())
        extra = mark.isupper()
        if kept is not None:
            out.append(("K", COST["K"] + extra, 1, kept, 2))
        out.append(("R", COST["R"] + extra, 1, behind, 2))
    return out


def solve(signature: str) -> tuple[int, str]:
    """The least cost and its audit, the ASCII-least one of equals.

    best(row, state, room) is the cost of what follows. More than two inserts at one place only lead back to an earlier
    state, so room for two is enough. Costs are asked for from the last row on, so that the recursion stays flat.
    """
    n = len(signature)
    memo = array("q", [-1]) * (12 * (n + 1))

    def best(row: int, state: int, room: int) -> int:
        at = 12 * row + 3 * state + room
        if memo[at] < 0:
            done = 0 if row == n and state in (START, AFTER_A) else FAR
            mark = signature[row] if row < n else None
            memo[at] = min([done, *(cost + best(row + used, behind, left) for _, cost, used, behind, left in _edits(mark, state, room))])
        return memo[at]

    for row in range(n, -1, -1):
        for state in range(4):
            best(row, state, 2)
    row, state, room, audit = 0, START, 2, []
    while row < n or state not in (START, AFTER_A):
        mark = signature[row] if row < n else None
        left = best(row, state, room)
        edit, _, used, state, room = next(e for e in _edits(mark, state, room) if e[1] + best(row + e[2], e[3], e[4]) == left)
        row += used
        audit.append(edit)
    return best(0, START, 2), "".join(audit)


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        found = [solve(s) for s in rows["signature"]]
        yield pa.RecordBatch.from_arrays([pa.array(rows["signature"], pa.string()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])


def audits(signed: DataFrame) -> DataFrame:
    """The rows of signatures() with cost and audit, both solved once for each distinct signature."""
    distinct = stored(signed.select("signature").distinct())
    solved = stored(distinct.repartition("signature").mapInArrow(_solved, "signature string, cost long, audit string"))
    out = stored(signed.join(solved, "signature"))
    discard(distinct, solved)
    return out


class _Replay:
    """Applies an audit to rows that come one at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _placed(self, edit: str, role: str, text: str):
        self.last = role[:1]
        return edit, role, text

    def _due(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._placed("I", self._due(), "")

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._placed(edit, role if edit == "K" else self._due(), text)


def _replayed(batches: Iterable[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Repaired rows, or one digest a conversation, from its audit and then its rows in order."""
    conv, replay, made, sha = None, None, 0, None
    out: list[tuple] = []

    def put(rows):
        nonlocal made
        for edit, role, text in rows:
            if digest:
                sha.update(f"{chr(10) if made else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            else:
                out.append((conv, made, edit, role, text))
            made += 1

    def end():
        if conv is not None:
            put(replay.inserted())
            if digest:
                out.append((conv, sha.hexdigest()))

    def sent():
        names = ["conv", "repaired_sha256"] if digest else ["conv", "position", "edit", "role", "text"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "position" else pa.string()) for n, c in zip(names, zip(*out))], names)
        out.clear()
        return batch

    for rows in rows_of(batches):
        for own, audit, role, text in zip(rows["conv"], rows["audit"], rows["role"], rows["text"]):
            if audit is not None:
                end()
                conv, replay, made, sha = own, _Replay(audit), 0, hashlib.sha256()
            else:
                put(replay.row(role, text))
        if out:
            yield sent()
    end()
    if out:
        yield sent()


def replay(rows: DataFrame, audited: DataFrame, digest: bool = False) -> DataFrame:
    """The repaired rows (conv, position from 0, edit, role, text), or with digest (conv, repaired_sha256) of their lines `role:text`.

    Each conversation's audit is sorted in before its rows, so both stream through one task in order and nothing is gathered.
    The digest of a conversation depends on its rows one after the other, so one conversation is one task's stream.
    """
    none = lambda kind: F.lit(None).cast(kind)
    order = ("conv", "is_row", "timed", "turn", "h1", "h2")
    lines = _keyed(rows).select("conv", F.lit(True).alias("is_row"), "timed", "turn", "h1", "h2", none("string").alias("audit"), "role", "text")
    heads = audited.select("conv", F.lit(False).alias("is_row"), F.lit(False).alias("timed"), none("long").alias("turn"), none("long").alias("h1"), none("long").alias("h2"), "audit", none("string").alias("role"), none("string").alias("text"))
    ordered = heads.unionByName(lines).repartition("conv").sortWithinPartitions(*order).select("conv", "audit", "role", "text")
    return ordered.mapInArrow(lambda it: _replayed(it, digest), "conv string, repaired_sha256 string" if digest else REPAIRED)


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired rows (conv_id, position from 0, edit, role, text) of rows (conv_id, turn, role, text).

    Edits are K (kept), R (given the role user or assistant) and I (inserted, with an empty text); deleted rows are left out. The roles
    of a conversation then alternate from user to assistant, behind a system row if it began with one. Null roles and texts count as one
    space, rows of a null conv_id are one conversation, null turns come first, and rows of one turn are ordered by hashes of role and
    text. Conversations of which nothing is left have no row. Other columns are ignored and an empty table gives an empty one.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    names = rows.select("conv_id", _conv(F.col("conv_id")).alias("conv")).distinct()
    return replay(rows, audits(signatures(rows))).join(names, "conv").select("conv_id", "position", "edit", "role", "text")


def op13_rows(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the given rows, damaged first: its counts of faults, least cost, audit and the digest of its repaired lines.

    A conversation that damage leaves without rows has zeros, an empty audit and the digest of no bytes. For nulls, ties and repeated
    rows see repair().
    """
    rows = damage(conversations)
    audited = audits(signatures(rows))
    digests = replay(rows, audited, digest=True)
    names = conversations.select("conv_id", _conv(F.col("conv_id")).alias("conv")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "cost")]
    found = names.join(audited.drop("signature"), "conv", "left").join(digests, "conv", "left")
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
