"""Groups of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from prefixes: under any common order of the shingles, with rare ones first, two such sets share one of the first
n - ceil(0.8 n) + 1 of theirs. Rare shingles are indexed one by one. Common ones come last, in classes, and are indexed by
combinations of two, very common ones of three, while the prefix is extended by what a combination can hide (see signature).
Sets that share a key first meet one set of it. Then those still apart are all compared where a key has at most SMALL sets; in larger ones each
meets a few sets more. What still shares a key with more than SMALL sets, but not their group, is dealt into tiles of a bounded
number of shingles, and each tile of it meets the others, so no link between two groups is missed. Every candidate is compared by a
bitmap first, with a bound that only drops pairs that can't be alike enough; what that leaves is compared by the texts' own shingles.
Where fingerprints are asked for, SimHash fingerprints of the sets are linked by the Gray-ordered index before all else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import bounded_broadcast, discard, rows_of, shuffles_released, stored
from scarpline.llm.components import connected_components
from scarpline.llm.hamming import MAX_BITS, hamming_links

SEED, WIDTH = 42, 5
#: Sets of a key that are all compared; seeds of the sets that stand for a key of more, by round.
SMALL, ROUNDS = 32, ((1, 2), (3, 4, 5))
#: Shingles that open more sets than COMMON are indexed by twos, those of more than VERY_COMMON by threes, the most common ones up to a bounded list; any value gives the same groups.
COMMON, VERY_COMMON, MAX_COMMON = 32, 1024, 200_000
CHUNK = 1 << 15
#: Shingles of the sets of one tile; any number gives the same groups.
TILE = 1 << 19
#: Sets smaller than this are alike enough to equal ones only.
LEAST = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of a word that are hashed in arrays; longer words are hashed one by one.
LONG_WORD = 64
#: Bytes that are hashed at a time.
SLICE_BYTES = 1 << 16
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RANDOM = np.random.default_rng(SEED)
#: A random number for every byte, the same for A-Z as for a-z and zero for white space, and one for each place in a word.
_OF_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_OF_BYTE[_SPACE] = 0
_OF_PLACE = _RANDOM.integers(0, 1 << 64, LONG_WORD, np.uint64, endpoint=False) | np.uint64(1)


def _mixed(parts: Iterable[np.ndarray], start: np.ndarray) -> np.ndarray:
    """One hash of several, in their order."""
    h = start
    for part in parts:
        h = (h ^ part) * MIX
        h ^= h >> np.uint64(29)
    return h


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other in data, and where each text's words end; ends: where the texts end."""
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, space[:-1]
    before[ends[ends < len(data)]] = True
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    out, sizes = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_BYTES)))
        low, high = starts[at], starts[to] if to < len(starts) else len(data)
        own = starts[at:to] - low
        place = np.arange(high - low, dtype=np.int32)
        place -= np.repeat(own.astype(np.int32), np.diff(own, append=high - low))
        np.minimum(place, LONG_WORD - 1, out=place)
        value = _OF_BYTE.take(data[low:high])
        value *= _OF_PLACE.take(place)
        out[at:to] = np.add.reduceat(value, own)
        sizes[at:to] = np.add.reduceat(~space[low:high], own, dtype=np.int64)
        at = to
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes().lower(), SEED)
    return out, np.searchsorted(starts, ends)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its lower-cased (A-Z) word shingles; a shorter text is one shingle, one without words or a null has none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    hashes, ends = _word_hashes(data, offsets[1:] - offsets[0])
    rows = len(hashes) - width + 1
    whole = _mixed((hashes[k : k + rows] for k in range(width)), np.full(rows, width, np.uint64)).view(np.int64) if rows > 0 else np.empty(0, np.int64)
    out, start = [], 0
    for end in ends.tolist():
        n = end - start
        if n >= width:
            own = np.sort(whole[start : end - width + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            own = own[new]
        elif n:
            own = _mixed((hashes[k : k + 1] for k in range(start, end)), np.full(1, n, np.uint64)).view(np.int64)
        else:
            own = np.empty(0, np.int64)
        out.append(own)
        start = end
    return out


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The set of one text, see shingle_sets."""
    return shingle_sets(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.large_binary()), width)[0]


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Frequent:
    """The common and the very common shingles; a table of their first bits spares most others the search."""

    BITS = 22

    def __init__(self, common: np.ndarray, very_common: np.ndarray):
        self.known = np.concatenate([common, very_common])
        order = np.argsort(self.known)
        self.known, self.kinds = self.known[order], np.repeat([1, 2], [len(common), len(very_common)])[order]
        self.first = np.zeros(1 << self.BITS, bool)
        self.first[self._bits(self.known)] = True

    def _bits(self, found: np.ndarray) -> np.ndarray:
        return found.view(np.uint64) >> np.uint64(64 - self.BITS)

    def kinds_of(self, found: np.ndarray) -> np.ndarray:
        """0 for a rare shingle, 1 for a common one, 2 for a very common one."""
        out = np.zeros(len(found), np.int64)
        maybe = np.flatnonzero(self.first[self._bits(found)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, found[maybe]), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == found[maybe], self.kinds[at], 0)
        return out


def _needed(n: int) -> int:
    """How many shingles of a set of n are certain to hold one of any set alike enough."""
    return n - -(-4 * n // 5) + 1


def _subclasses(size_class: int) -> tuple[int, int, int]:
    """Parts of the classes of shingles for sets of 2 ** size_class and more: combinations stay within a part, which keeps them few."""
    n = 1 << size_class
    return 1, max(1, n // 20), max(1, n // 10)


def signature(found: np.ndarray, frequent: Frequent) -> np.ndarray:
    """Keys of a set of shingles; any two sets alike enough have one in common.

    The order is: rare shingles, common ones, very common ones, each by hash. Keys are single shingles of the first class, twos of
    a part of the second, threes of a part of the third. The prefix is extended until all but k - 1 shingles of each part with keys of k,
    added up, are as many as are needed. Of two sets that share no key, the one whose prefix ends first shares at most k - 1 shingles of
    each part with the other one, so that many of its shingles are missing there, and the two aren't alike enough. The parts are chosen by
    the power of two in the smaller set's size, so a set has the keys of each power that a smaller set alike enough can have.
    """
    n = len(found)
    if n < LEAST:
        return np.empty(0, np.int64)
    need = _needed(n)
    if not frequent.kinds_of(found[:need]).any():
        return found[:need]
    kind = frequent.kinds_of(found)
    order = np.argsort(kind, kind="stable")
    found, kind = found[order], kind[order]
    keys = []
    for size_class in {n.bit_length() - 1, (-(-4 * n // 5)).bit_length() - 1}:
        parts = np.array(_subclasses(size_class), np.uint64)
        part = kind * (1 << 40) + (_mixed([found.view(np.uint64)], np.full(n, 5, np.uint64)) % parts[kind]).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(part[by_part]) != 0])
        seen = np.empty(n, np.int64)
        seen[by_part] = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        end = int(np.searchsorted(np.cumsum((kind == 0) | (seen >= kind)), need)) + 1
        keys.append(found[:end][kind[:end] == 0])
        for k in (1, 2):
            some = np.flatnonzero(kind[:end] == k)
            some = some[np.argsort(part[some], kind="stable")]
            for own in np.split(found[some], np.flatnonzero(np.diff(part[some])) + 1):
                if len(own) > k:
                    keys.append(_combined(own, k + 1))
    return np.unique(np.concatenate(keys))


def _combined(own: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all combinations of two or three values in their order."""
    a, b = np.triu_indices(len(own), 1)
    if size == 3:
        n = len(own) - 1 - b
        c = np.repeat(b + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, b = np.repeat(a, n), np.repeat(b, n)
        picked = (a, b, c)
    else:
        picked = (a, b)
    own = own.view(np.uint64)
    return _mixed((own[x] for x in picked), np.full(len(a), 100 + size, np.uint64)).view(np.int64)


def _fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        ones += np.unpackbits(found[at : at + CHUNK].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found)).view(np.int64)[0])


def _opening(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _slices(batches):
        found = [x[: _needed(len(x))] for x in shingle_sets(rows.column("text")) if len(x) >= LEAST]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["gram"])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))


def _sets(batches: Iterable[pa.RecordBatch], names: list[str], frequent, fingerprints: bool) -> Iterator[pa.RecordBatch]:
    known = Frequent(*frequent.value)
    for rows in _slices(batches):
        found = shingle_sets(rows.column("text"))
        digest = lambda seed: pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes(), seed) for x in found], np.uint64).view(np.int64))
        fps = pa.array([_fingerprint(x) if fingerprints else 0 for x in found], pa.int64())
        own = [rows.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*own, digest(SEED), digest(7), pa.array([len(x) for x in found], pa.int64()), fps, _lists([signature(x, known) for x in found])], [*names, "h1", "h2", "n", "fp", "keys"])


def _frequent(keyed: DataFrame, common: int, very_common: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted common and very common shingles among those that open a set in the order of their hashes, counted over all rows."""
    opened = keyed.select("text").mapInArrow(_opening, "gram long").groupBy("gram").agg(F.count("*").alias("c")).filter(F.col("c") > common)
    often = stored(opened)
    with shuffles_released(keyed.sparkSession):
        late = often.orderBy(F.desc("c"), "gram").limit(MAX_COMMON).toArrow()
    discard(often)
    gram, c = (late.column(x).to_numpy() for x in ("gram", "c"))
    return np.sort(gram[c <= very_common]), np.sort(gram[c > very_common])


def _near_size(n: str, m: str) -> Column:
    return (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n))


def _bitmap(found: np.ndarray) -> bytes:
    """A bitmap of at least four bits a shingle, its width a power of two; each bit is the parity of the shingles that fall on it."""
    width = max(64, 1 << int(4 * len(found) - 1).bit_length())
    return np.packbits((np.bincount(found & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, bits, text), of each node the first that a task meets."""
    seen: set[int] = set()
    for rows in _slices(batches):
        rows = rows.take(pa.array([i for i, node in enumerate(rows.column("node").to_pylist()) if node not in seen and not seen.add(node)], pa.int64()))
        found = shingle_sets(rows.column("text"))
        yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array([len(x) for x in found], pa.int64()), pa.array([_bitmap(x) for x in found], pa.binary()), rows.column("text")], ["node", "n", "bits", "text"])


def _folded(wide: np.ndarray, width: int) -> np.ndarray:
    while len(wide) > width:
        wide = wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]
    return wide


def _maybe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) that their bitmaps leave."""
    for batch in batches:
        u, v, n, m = (batch.column(c).to_numpy() for c in ("u", "v", "n", "m"))
        live = np.zeros(len(u), bool)
        for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"))):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            width = min(len(x), len(y))
            live[i] = 9 * int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(dtype=np.int64)) <= n[i] + m[i]
        yield pa.RecordBatch.from_arrays([pa.array(u[live]), pa.array(v[live])], ["u", "v"])


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose texts' sets are alike enough; a set is made once for a few hundred pairs."""
    for rows in _slices(batches, 256):
        nodes = np.concatenate([rows.column(c).to_numpy() for c in ("u", "v")])
        own, first, index = np.unique(nodes, return_index=True, return_inverse=True)
        texts = pa.concat_arrays([rows.column("a"), rows.column("b")]).take(pa.array(first))
        found = shingle_sets(texts)
        live = [9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)) for p, q in ((found[x], found[y]) for x, y in zip(index[: rows.num_rows], index[rows.num_rows :]))]
        keep = pa.array(live, pa.bool_())
        yield pa.RecordBatch.from_arrays([rows.column("u").filter(keep), rows.column("v").filter(keep)], ["u", "v"])


def _checked(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have a Jaccard similarity of at least 4/5, stored.

    Every bit in which two bitmaps differ stands for a shingle that only one of the sets has, so the sets share no more than
    (n + m - differing bits) / 2 shingles. Only the texts of pairs that this bound leaves are shuffled.
    """
    side = lambda node, *more: full.select(F.col("node").alias(node), *[F.col(c).alias(a) for c, a in more])
    sketches = pairs.join(side("u", ("n", "n"), ("bits", "a")), "u").join(side("v", ("n", "m"), ("bits", "b")), "v").select("u", "v", "n", "m", "a", "b")
    left = stored(sketches.mapInArrow(_maybe, "u long, v long"))
    both = left.join(side("u", ("text", "a")), "u").join(side("v", ("text", "b")), "v").select("u", "v", "a", "b")
    out = stored(both.mapInArrow(_alike, "u long, v long"))
    discard(left)
    return out


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs of rows (node, n, other, m) that their sizes allow."""
    return found.filter((F.col("node") != F.col("other")) & _near_size("n", "m")).select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def _rooted(places: DataFrame, links: DataFrame) -> DataFrame:
    """Places (gram, c, node, n) with the root of their node, of the keys that still meet different roots, stored."""
    named = places.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = named.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("gram")
    return stored(named.join(apart, "gram").select("gram", "c", "node", "n", "root"))


def _by_fingerprint(distinct: DataFrame) -> DataFrame:
    """Candidates (node, n, other, m) that the Gray-ordered index links, each with the first one of its fingerprint, and of equal fingerprints, stored."""
    of = lambda x, p: F.struct(F.col("node").alias(x), F.col("n").alias(p))
    first = stored(distinct.groupBy("fp").agg(F.min(of("other", "m")).alias("first")).select("fp", "first.other", "first.m"))
    same = distinct.join(first, "fp").filter("node <> other").select("node", "n", "other", "m")
    links = hamming_links(first, MAX_BITS).filter("u <> v").distinct()
    end = lambda fp, x, p: first.select(F.col("fp").alias(fp), F.col("other").alias(x), F.col("m").alias(p))
    out = stored(same.union(links.join(end("u", "node", "n"), "u").join(end("v", "other", "m"), "v").select("node", "n", "other", "m")).distinct())
    discard(first)
    return out


def similar(keyed: DataFrame, common: int = COMMON, small: int = SMALL, tile: int = TILE, fingerprints: bool = False, very_common: int = VERY_COMMON) -> tuple[DataFrame, DataFrame]:
    """(rows (key columns, node, n), rows (node, root) of the nodes with a link) of rows (key columns, text), by chains of pairs of similarity 4/5 or more.

    node stands for one set of shingles, n is its size. Null texts and texts without words have one node, n is 0 there. The groups are
    those of all links, also in clouds that share a key with more than `small` sets. The key columns (long) must differ for different texts.
    """
    names = [c for c in keyed.columns if c != "text"]
    spark = keyed.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(keyed, common, very_common))
    kinds = "".join(f"{c} long, " for c in names)
    found = stored(keyed.select(*names, "text").mapInArrow(lambda it: _sets(it, names, frequent, fingerprints), kinds + "h1 long, h2 long, n long, fp long, keys array<long>"))
    distinct = stored(found.dropDuplicates(["h1", "h2"]).withColumn("node", F.monotonically_increasing_id()))
    rows = stored(found.select(*names, "h1", "h2").distinct().join(distinct.select("h1", "h2", "node", "n"), ["h1", "h2"]).select(*names, "node", "n"))
    discard(found)
    opened = distinct.select("node", F.col("n").cast("int").alias("n"), F.explode("keys").alias("gram"))
    # most keys have one set only: they go before anything is joined
    pivot = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("other"), F.col("n").alias("m")))
    met = stored(opened.groupBy("gram").agg(F.count("*").alias("c"), pivot.alias("p")).filter("c > 1").select("gram", "c", "p.other", "p.m"))
    places = stored(opened.join(met, "gram"))
    first = places.select("node", "n", "other", "m")
    if fingerprints:
        linked = _by_fingerprint(distinct.filter(F.col("n") >= LEAST))
        first = first.union(linked)
    pairs = stored(_pairs(first))
    nodes = stored(places.select("node").union(pairs.select("u")).union(pairs.select("v")).distinct())
    wanted = stored(distinct.select("node", *names).join(nodes, "node"))
    discard(distinct, met, *([linked] if fingerprints else []))
    size = 8 * (len(names) + 1) * wanted.count()
    held = keyed.select(*names, "text").join(bounded_broadcast(wanted, size), names).select("node", "text")
    full = stored(held.mapInArrow(_whole, "node long, n long, bits binary, text string").dropDuplicates(["node"]))
    links = _checked(pairs, full)
    left = _rooted(places.select("gram", "c", "node", "n"), links)
    discard(places, pairs, nodes, wanted)
    for k, seeds in enumerate(ROUNDS):
        many = left.filter(F.col("c") > small)
        more = _by_pivots(many, seeds).union(_by_degree(many, links))
        links = _more(links, more if k else more.union(_small(left, small)), full)
        before, left = left, _rooted(many.drop("root"), links)
        discard(before)
    rest = stored(_rest(left, small, tile))
    more = _in_tiles(rest, full)
    out = stored(connected_components(links.union(more)))
    discard(left, full, links, rest, more)
    return rows, out


def _by_pivots(left: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """Candidates (node, n, other, m): each set of a shingle with a few of its sets, by hash, that have another root."""
    pick = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("at")))
    pivots = left.groupBy("gram").agg(F.array(*map(pick, seeds)).alias("pivots"))
    apart = F.filter("pivots", lambda p: p["at"] != F.col("root"))  # before they are rows: most of a cloud has one root
    return left.join(pivots, "gram").select("node", "n", F.explode(apart).alias("p")).select("node", "n", "p.other", "p.m")


def _by_degree(left: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates: each set of a shingle with the best linked one, which the copies of one text have in common."""
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    best = left.join(degree, "node", "left").groupBy("gram").agg(F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("at"))).alias("p")).select("gram", "p.other", "p.m", "p.at")
    return left.join(best, "gram").filter("root <> at").select("node", "n", "other", "m")


def _small(left: DataFrame, small: int) -> DataFrame:
    """Candidates: all pairs of different roots of the shingles with at most `small` sets, so no more than that for a set and shingle."""
    few = left.filter(F.col("c") <= small)
    other = few.select("gram", F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("at"))
    return few.join(other, "gram").filter("node < other AND root <> at").select("node", "n", "other", "m")


def _rest(left: DataFrame, small: int, tile: int) -> DataFrame:
    """Rows (key, node, root, asks) of the shingles with more than `small` sets: tiles of sets, of which those with asks meet the others of their key.

    The sets of a shingle's largest root need not meet one another; all else meets them and itself, tile by tile.
    """
    roots = left.groupBy("gram", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    stats = roots.groupBy("gram").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("w", "root")).alias("main")).filter(F.col("c") > small)
    deal = lambda w: F.ceil(w / F.lit(tile)).cast("int")
    stats = stats.select("gram", F.col("main.root").alias("main"), deal(F.col("main.w")).alias("mains"), deal(F.col("w") - F.col("main.w")).alias("others"))
    dealt = left.join(stats, "gram").withColumn("asks", F.col("root") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("others")).otherwise(F.col("mains"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    inner = F.transform(upto("others"), lambda i: pair(0, F.least(i, F.col("own")), F.greatest(i, F.col("own"))))
    outer = F.transform(upto("mains"), lambda i: pair(1, F.col("own"), i))
    met = F.when(F.col("asks"), F.concat(inner, outer)).otherwise(F.transform(upto("others"), lambda i: pair(1, i, F.col("own"))))
    return dealt.withColumn("own", own).select("gram", "node", "root", "asks", F.explode(met).alias("at")).select(F.xxhash64("gram", "at").alias("key"), "node", "root", "asks")


def _tile_links(table: pa.Table) -> pa.Table:
    """Links between sets of different roots in one key: each that joins two roots not joined there yet."""
    node, root, asks = (table.column(c).to_numpy() for c in ("node", "root", "asks"))
    grams = table.column("grams").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())])
    values = grams.flatten().to_numpy()
    size, (_, group) = np.diff(ends), np.unique(root, return_inverse=True)
    if not asks.any():
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    open_ = np.flatnonzero(~asks if not asks.all() else asks)  # a tile of the largest root is asked by the others only
    held = np.concatenate([values[ends[i] : ends[i + 1]] for i in open_])
    owner = np.repeat(open_, size[open_])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    u, v = [], []
    for i in np.flatnonzero(asks):
        mine = values[ends[i] : ends[i + 1]]
        a, b = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(node))
        alike = np.flatnonzero((9 * shared >= 4 * (size + size[i])) & (shared > 0) & (group != group[i]))
        joined, first = np.unique(group[alike], return_index=True)
        u += [node[i]] * len(first)
        v += node[alike[first]].tolist()
        if len(first):
            group[np.isin(group, joined)] = group[i]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _wide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, bits) of rows (node, grams)."""
    for rows in rows_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array(rows["node"], pa.int64()), pa.array([len(x) for x in rows["grams"]], pa.int64()), pa.array([_bitmap(np.array(x, np.int64)) for x in rows["grams"]], pa.binary())], ["node", "n", "bits"])


def _tile_left(table: pa.Table) -> pa.Table:
    """The rows of one key that the bitmaps leave a pair of different roots."""
    node, root, asks, n = (table.column(c).to_numpy() for c in ("node", "root", "asks", "n"))
    bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
    width = np.array([len(x) for x in bits])
    answers = ~asks if not asks.all() else asks
    left = np.zeros(len(node), bool)
    for w in np.unique(width[asks]):
        # sets so alike differ by one step of width at most; the wider one is folded
        near = [(v, np.flatnonzero(answers & (width == v))) for v in (w // 2, w, 2 * w)]
        held = [(v, at, np.stack([bits[i] if v <= w else bits[i][:w] ^ bits[i][w:] for i in at])) for v, at in near if len(at)]
        for i in np.flatnonzero(asks & (width == w)):
            for v, at, others in held:
                mine = bits[i] if v >= w else bits[i][:v] ^ bits[i][v:]
                live = at[(9 * np.bitwise_count(others ^ mine).sum(1, dtype=np.int64) <= n[at] + n[i]) & (root[at] != root[i])]
                left[live] = True
                left[i] |= len(live) > 0
    return table.select(["key", "node", "root", "asks"]).filter(pa.array(left))


def _text_links(table: pa.Table) -> pa.Table:
    """The links of one key's tile, from texts."""
    grams = _lists(shingle_sets(table.column("text").combine_chunks()))
    return _tile_links(table.drop(["text"]).append_column("grams", pa.chunked_array([grams])))


def _in_tiles(rest: DataFrame, full: DataFrame) -> DataFrame:
    """The links (u, v) that hold between the sets of each key and different roots, stored."""
    left = stored(rest.join(full.select("node", "n", "bits"), "node").select("key", "node", "root", "asks", "n", "bits").groupBy("key").applyInArrow(_tile_left, "key long, node long, root long, asks boolean"))
    out = stored(left.join(full.select("node", "text"), "node").select("key", "node", "root", "asks", "text").groupBy("key").applyInArrow(_text_links, "u long, v long"))
    discard(left)
    return out


def _more(links: DataFrame, found: DataFrame, full: DataFrame) -> DataFrame:
    """The links with those of the candidates (node, n, other, m) that hold."""
    more = _checked(_pairs(found), full)
    out = stored(links.union(more))
    discard(links, more)
    return out
