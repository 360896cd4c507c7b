"""Best-fit packing of tokenised documents into fixed-size sequences.

A piece is described by its length alone, so the packing problem is a table of at most `capacity` lengths with
counts, whatever the corpus holds. The plan is made on that table: dominance reduction (Martello and Toth) fixes
sets that no other set can beat, best-fit decreasing packs the rest. The plan is a list of patterns with numbers
of copies; the pieces of each length are numbered by salted windows and joined to their slots.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scarpline.llm.common import rows_of, stored

CAPACITY, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k"


#: Pieces of one length are numbered in groups of about this many.
GROUP_ROWS = 1 << 18


class _Encoder:
    """Ids of the named vocabulary as tokenizers gives them with <name>.json and add_special_tokens=False.

    The ranks file of the same vocabulary is read because that encoder takes a quarter of the time; added tokens, whose
    strings in a text are one id, come from the json file. Runs of white space too long for its pattern go to tokenizers.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path(f"{name}.json")
        with open(self.json, "rb") as file:
            added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.plain = None

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            if self.plain is None:
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.json)
            return self.plain.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY) -> _Encoder:
    return _Encoder(name)


def _pieces(batches: Iterable[pa.RecordBatch], capacity: int, name: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(name).ids
    for rows in rows_of(batches):
        out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            ids = np.array([*encode(text or ""), END_ID], np.uint32)
            cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                for column, value in zip(out.values(), (doc_id, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()))):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *[pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")]], list(out))


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document; a null text is one end token."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _pieces(it, capacity, name), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Counts by length, with the largest and smallest lengths that are left."""

    def __init__(self, counts: dict[int, int]):
        self.count = Counter({k: n for k, n in counts.items() if n > 0})
        self.lengths = sorted(self.count)

    def at_most(self, room: int) -> int:
        i = bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else 0

    def least(self, n: int) -> int | None:
        """The sum of the n smallest items, None if there are fewer."""
        total = 0
        for k in self.lengths:
            m = min(n, self.count[k])
            total, n = total + k * m, n - m
            if not n:
                return total
        return None


def _dominant(stock: _Stock, largest: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the largest item that dominates every other set with it, if one of up to three items is known to."""
    stock.count[largest] -= 1
    gone = not stock.count[largest]
    if gone:
        stock.lengths.pop()
    try:
        room = capacity - largest
        best = stock.at_most(room)
        if not best:
            return (largest,)
        two = stock.least(2)
        if best == room or two is None or two > room:
            return (largest, best)
        three = stock.least(3)
        if three is not None and three <= room:
            return None
        # sets have two more items at most: (best, second) dominates if every such pair fits under it item by item
        stock.count[best] -= 1
        left = [k for k in stock.lengths if stock.count[k] and k <= room - best]
        stock.count[best] += 1
        if not left:
            return None
        second = left[-1]
        for k in stock.lengths:
            if k > best:
                break
            other = min(room - k, k if stock.count[k] > 1 else k - 1)
            other = stock.at_most(other)
            if other > second and k + other > best:
                return None
        return (largest, best, second)
    finally:
        stock.count[largest] += 1
        if gone:
            stock.lengths.append(largest)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and their numbers of copies that use up all pieces.

    counts has the number of pieces of each length from 1 to capacity. The work depends on the number of
    lengths, not on the number of pieces: equal choices are made in one step.
    """
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    stock, plan = _Stock(counts), []
    while stock.lengths:
        largest = stock.lengths[-1]
        items = _dominant(stock, largest, capacity)
        if items is None:
            break
        need = Counter(items)
        copies = max(1, min(stock.count[k] // n for k, n in need.items()))
        if len(items) > 2:
            copies = 1
        for k, n in need.items():
            stock.count[k] -= copies * n
            if not stock.count[k]:
                stock.lengths.remove(k)
        plan.append((tuple(sorted(items, reverse=True)), copies))
    # best fit, largest first: open sequences are kept by the room they have left, and those of equal contents together
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for k in reversed(stock.lengths):
        left = stock.count[k]
        while left:
            room = next((r for r in range(k, capacity) if rooms[r]), None)
            if room is None:
                each = capacity // k
                full, rest = divmod(left, each)
                for items, copies in (((k,) * each, full), ((k,) * rest, 1 if rest else 0)):
                    if copies:
                        to = rooms[capacity - k * len(items)]
                        to[items] = to.get(items, 0) + copies
                left = 0
                continue
            items, copies = next(iter(rooms[room].items()))
            more = min(room // k, left)
            n = max(1, min(copies, left // more))
            if n == copies:
                del rooms[room][items]
            else:
                rooms[room][items] -= n
            to = rooms[room - more * k]
            grown = items + (k,) * more
            to[grown] = to.get(grown, 0) + n
            left -= more * n
    return plan + [(items, n) for room in rooms for items, n in room.items()]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, items of that length in a sequence, offset of the first)."""
    rows, used, sequence = [], Counter(), 0
    for items, copies in plan:
        offset = 0
        for k, n in sorted(Counter(items).items(), reverse=True):
            rows.append((k, used[k], n * copies, sequence, n, offset))
            used[k] += n * copies
            offset += n * k
        sequence += copies
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The pieces with sequence_id and offset. Needs the columns of token_pieces; others pass through.

    pieces is read more than once and must give the same rows each time, as a stored table does.
    The plan has some thousands of rows at most (bounded by capacity), so it is built on the driver.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(_slots(plan_packing(counts, capacity)), "length long, first long, ranks long, sequence long, each long, at long")
    # a length with many pieces is dealt into groups of about group_rows, so no window holds more, however common a length is
    dealt = {k: -(-n // group_rows) for k, n in counts.items() if n > group_rows}
    salts = F.coalesce(F.create_map(*[F.lit(x) for pair in dealt.items() for x in pair])[F.col("length")], F.lit(1)) if dealt else F.lit(1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), salts))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    # joined on the columns by which the windows have dealt the pieces already
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # slots of one length are few and cover its ranks without gaps
    table = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "ranks", "sequence", "each", "at"))).alias("slots"))
    hit = F.expr("element_at(filter(slots, s -> rank >= s.first AND rank < s.first + s.ranks), 1)")
    placed = ranked.join(F.broadcast(table), "length").withColumn("slot", hit)
    within = F.col("rank") - F.col("slot.first")
    sequence = F.col("slot.sequence") + F.floor(within / F.col("slot.each"))
    offset = F.col("slot.at") + F.col("length") * F.pmod(within, F.col("slot.each"))
    return placed.select(*[c for c in pieces.columns], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY) -> DataFrame:
    """Every document's tokens in sequences of at most capacity: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is packed as an empty one (the end token alone), repeated rows are packed each, an empty table gives
    an empty one and columns besides doc_id and text are ignored. Pieces are never split further.
    """
    return pack(stored(token_pieces(docs, capacity, name)), capacity)
