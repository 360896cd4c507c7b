"""Links between 64-bit fingerprints that differ in few bits, by a Gray-ordered hierarchical index.

The distinct fingerprints are cut into bit blocks, one more than the bits that may differ, so two that are linked agree on
one block at least and a shuffle by (block, value) brings every linked pair together. Groups too large for one task are cut
again over their other bits, by the same rule, and what stays large is dealt into tiles of which each two meet. In a group
the fingerprints are sorted by Gray rank, runs of them become leaves that factor out the bits they share, runs of leaves
become upper nodes, and a search adds up differences on shared bits from the top and drops a whole node once they exceed
the bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import shuffles_released, stored

MAX_BITS = 4
LEAF, FAN = 16, 8


def gray_rank(column):
    """The place of a fingerprint in Gray order: the prefix parity of its bits, as an unsigned number shifted to sort as a signed one."""
    for k in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, k))
    return column.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """A tree over fingerprints in Gray order; each level keeps only the shared bits that no level above has."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        own, levels, step = fps, [], LEAF
        masks = np.full(len(fps), ones)
        while True:
            at = np.arange(0, len(own), step)
            same_1 = np.bitwise_and.reduceat(own & masks, at)
            same_0 = np.bitwise_and.reduceat(~own & masks, at)
            shared, pattern = same_1 | same_0, same_1
            levels.append((pattern, shared, at))
            if len(at) <= FAN:
                break
            own, masks, step = pattern, shared, FAN
        self.levels = levels[::-1]

    def search(self, queries: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, member index) that differ in at most bound bits."""
        top = self.levels[0][0]
        q = np.repeat(np.arange(len(queries)), len(top))
        node = np.tile(np.arange(len(top)), len(queries))
        above = np.zeros(len(q), np.uint64)
        spent = np.zeros(len(q), np.int16)
        for depth, (pattern, shared, _) in enumerate(self.levels):
            own = shared[node] & ~above
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & own)
            live = spent <= bound
            q, node, spent, above = q[live], node[live], spent[live], (above | shared[node])[live]
            last = depth + 1 == len(self.levels)
            size, step = (len(self.fps), LEAF) if last else (len(self.levels[depth + 1][0]), FAN)
            n = np.minimum(step, size - node * step)
            first = np.repeat(node * step, n)
            within = np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            q, spent, above, node = np.repeat(q, n), np.repeat(spent, n), np.repeat(above, n), first + within
        live = spent + np.bitwise_count((queries[q] ^ self.fps[node]) & ~above) <= bound
        return q[live], node[live]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the trees of each pair; every node then points at the least member of its tree."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def _stars(fps: np.ndarray, bound: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint of a group to the first one of its component in the group."""
    n, root = len(fps), np.arange(len(fps))
    if n <= 2 * LEAF:
        root = _merge(root, *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bound))
    else:
        index = GrayIndex(fps)
        for at in range(0, n, block):
            a, b = index.search(fps[at : at + block], bound)
            root = _merge(root, a + at, b)
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def _group_links(batches: Iterable[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    held_key, held = None, []
    out_u, out_v = [], []

    def flush():
        if held_key is not None and (n := sum(map(len, held))) > 1:
            u, v = _stars(np.concatenate(held).view(np.uint64), bound)
            out_u.append(u)
            out_v.append(v)

    def sent():
        u, v = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (out_u, out_v))
        out_u.clear()
        out_v.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for part_key, part in zip(key[np.r_[0, cuts]], np.split(fp, cuts)):
            if part_key != held_key:
                flush()
                held_key, held = part_key, []
            held.append(part)
        yield sent()
    flush()
    yield sent()


def _pieces(free: int, n: int) -> list[int]:
    """n masks of near-equal numbers of bits that cover the bits of free, the lowest bits first."""
    bits = [i for i in range(64) if free >> i & 1]
    cut = [round(len(bits) * k / n) for k in range(n + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:]) if a < b]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(rows: DataFrame, free: int, bound: int) -> DataFrame:
    """Each row once for every block of the free bits, in the group of its bits there."""
    blocks = [F.struct(F.lit(_signed(free & ~m)).alias("free"), F.xxhash64(F.col("group"), F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("group")) for i, m in enumerate(_pieces(free, bound + 1))]
    return rows.select(F.explode(F.array(*blocks)).alias("block"), "fp").select("block.group", "block.free", "fp")


def hamming_links(fps: DataFrame, bound: int = MAX_BITS, group_rows: int = 2048, cuts: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp (long) that keep all connections of pairs within bound bits.

    Groups of more than group_rows are cut again, `cuts` times in all. What is still larger is a dense cloud, which
    shorter blocks don't part: it is dealt into tiles by hash, and each two tiles meet in a task of their own.
    So no task holds more than about twice group_rows fingerprints at a time.
    """
    rows = _cut(fps.select("fp").distinct().withColumn("group", F.lit(0).cast("long")), (1 << 64) - 1, bound)
    done = []
    for left in range(cuts - 1, -1, -1):
        rows = stored(rows)
        sizes = stored(rows.groupBy("group").agg(F.count("*").alias("n"), F.min("free").alias("free")).filter(F.col("n") > group_rows))
        with shuffles_released(sizes.sparkSession):
            kinds = [r[0] for r in sizes.select("free").distinct().collect()]  # one per way of cutting the 64 bits
        done.append(rows.join(sizes.select("group"), "group", "left_anti").select("group", "fp"))
        large = rows.join(sizes.select("group", "n"), "group")
        if not kinds or not left:
            break
        parts = [_cut(large.filter(F.col("free") == k), k & ((1 << 64) - 1), bound) for k in kinds]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.union(more)
    tiles = F.ceil(F.col("n") / group_rows).cast("int")
    tiled = large.select("group", "fp", tiles.alias("tiles"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("own"))
    tiled = tiled.select("group", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    done.append(tiled.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "fp"))
    everything = done[0]
    for more in done[1:]:
        everything = everything.union(more)
    ordered = everything.select("group", "fp", gray_rank(F.col("fp")).alias("rank")).repartition("group").sortWithinPartitions("group", "rank").select("group", "fp")
    return ordered.mapInArrow(lambda it: _group_links(it, bound), "u long, v long")
