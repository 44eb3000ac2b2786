"""Self-join of 64-bit fingerprints under a Hamming budget, by a binary trie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import group_starts, materialize, merged, whole_groups

#: Levels by which an over-full trie node is split at once.
STEP = 8
#: Node pairs with at most this many members are compared directly.
LEAF = 256
#: Comparisons, and node pairs, held in memory at once.
CHUNK, FRONT = 500_000, 100_000


def hamming_links(fingerprints: DataFrame, max_bits: int, capacity: int = 16_384) -> DataFrame:
    """src, dst links that connect distinct fingerprints(fp long) as all pairs within max_bits do.

    Collapse copies first. Each task returns a spanning forest of its links,
    never all pairs. An empty table gives no links. See _trie_rows for how the
    trie is dealt out.
    """

    def links(node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(label != np.arange(len(label)))
        src, dst = node[child], node[label[child]]
        keep = src != dst
        return src[keep], dst[keep]

    return _joined(_trie_rows(fingerprints, max_bits, capacity), max_bits, links, ("src", "dst"))


def hamming_groups(fingerprints: DataFrame, max_bits: int, capacity: int = 16_384) -> DataFrame:
    """root, node: small groups of distinct fingerprints(fp long); every pair within max_bits is together in one of them.

    A group is what one task has linked, so there are several of the same
    nodes; equal groups have equal roots.
    """

    def groups(node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(label, kind="stable")
        size = np.bincount(label, minlength=len(label))[label[order]]
        order = order[size > 1]
        if not len(order):
            return node[:0], node[:0]
        starts = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
        sums = np.add.reduceat(node[order].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (node[order].view(np.uint64) >> np.uint64(29)), starts)
        return np.repeat(sums.view(np.int64), np.diff(np.append(starts, len(order)))), node[order]

    return _joined(_trie_rows(fingerprints, max_bits, capacity), max_bits, groups, ("root", "node"))


def _trie_rows(fingerprints: DataFrame, max_bits: int, capacity: int) -> DataFrame:
    """rot, depth, prefix, home, word: the members of trie nodes (the first three) that are joined in one task each.

    A word is a fingerprint turned left by _shifts[rot].

    Two words within max_bits agree on one of max_bits + 1 blocks, so the trie
    is built once per block with that block rotated to the top and no error
    spent on it: the first levels are then an equality that a shuffle can
    serve. Below them the trie is joined with itself, node pair by node pair,
    adding up differing bits and dropping a pair of nodes once the budget is
    exceeded. A subtree of more than `capacity` words is split over tasks by
    STEP more levels: its words stay at home under their own longer prefix and
    probe all prefixes within the budget left, as often as needed; probes of
    prefixes at which no word lives are dropped.
    """
    shift = F.array(*[F.lit(x) for x in _shifts(max_bits)])
    depth = F.array(*[F.lit(width) for _, width in _blocks(max_bits + 1)])
    turn = F.col("rot")
    ready = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(max_bits))).alias("rot"))
    ready = ready.select("rot", _rotated(F.col("fp"), F.get(shift, turn)).alias("word"), F.get(depth, turn).alias("depth"))
    ready = ready.select("rot", "depth", "word", _prefix("word", F.col("depth")).alias("prefix"), F.lit(0).alias("errors"), F.lit(True).alias("home"))
    parts, key = [], ["rot", "depth", "prefix"]
    full = materialize(_over(ready, key, capacity), "trie-full")
    while not full.isEmpty():
        parts.append(ready.join(full, key, "left_anti"))
        ready = materialize(_split(ready.join(full, key, "left_semi"), max_bits), "trie-split")
        met = ready.where("home").select(*key).distinct()
        ready = materialize(ready.join(met, key, "left_semi"), "trie-met")
        full = materialize(_over(ready.where(f"depth <= {64 - STEP}"), key, capacity), "trie-full")
    parts.append(ready)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.select(*key, "home", "word")


def _joined(rows: DataFrame, max_bits: int, told: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], names: tuple[str, str]) -> DataFrame:
    """What told(fingerprints, smallest linked index of each) says of each task's tries."""
    key, shifts = ["rot", "depth", "prefix"], np.array(_shifts(max_bits), dtype=np.uint64)
    # the short parts of the key pack well, their hash would not: it is made after the shuffle
    rows = rows.repartition(*key).select(F.xxhash64(*key).alias("key"), "rot", "home", "word")
    # one long is sorted by its digits; the order within a node is made where the rows are used
    rows = rows.sortWithinPartitions("key")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key"]):
            starts = group_starts(table, ["key"])
            word, home = table.column("word").to_numpy().view(np.uint64), table.column("home").to_numpy()
            order = np.lexsort((word, ~home, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(word))))))
            word, home = word[order], home[order]
            back = shifts[table.column("rot").to_numpy()[order]]
            node = ((word >> back) | (word << (np.uint64(64) - back & np.uint64(63)))).view(np.int64)
            label = np.arange(len(word))
            for a, b in trie_join(word, home, starts, max_bits):
                label = merged(label, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in told(node, label)], names=list(names))

    return rows.mapInArrow(joined, f"{names[0]} long, {names[1]} long")


def _blocks(count: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each block of a 64-bit word."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _shifts(max_bits: int) -> list[int]:
    """How far left a word is turned to bring each block to the top."""
    return [64 - low - width for low, width in _blocks(max_bits + 1)]


def _rotated(word, shift):
    """word turned left by shift bits; the JVM takes shifts modulo 64, so none is a special case."""
    return F.call_function("shiftleft", word, shift).bitwiseOR(F.call_function("shiftrightunsigned", word, F.lit(64) - shift))


def _prefix(word: str, depth):
    return F.call_function("shiftrightunsigned", F.col(word), F.lit(64) - depth)


def _over(rows: DataFrame, key: list[str], capacity: int) -> DataFrame:
    return rows.groupBy(*key).count().where(F.col("count") > capacity).select(*key)


def _split(rows: DataFrame, max_bits: int) -> DataFrame:
    """Rows of over-full nodes, STEP levels further down.

    A word that is at home stays so below its own next bits and probes smaller
    neighbours (the larger side of a pair finds the smaller); a probe keeps
    probing every neighbour that its errors allow.
    """
    masks = F.array(*[F.lit(m) for m in range(1 << STEP) if m.bit_count() <= max_bits])
    out = rows.withColumn("mask", F.explode(masks)).withColumn("errors", F.col("errors") + F.bit_count("mask")).where(F.col("errors") <= max_bits)
    out = out.withColumn("depth", F.col("depth") + STEP).withColumn("own", _prefix("word", F.col("depth")).bitwiseAND(F.lit((1 << STEP) - 1)))
    out = out.where(F.expr("not home or mask = 0 or (own ^ mask) < own"))
    prefix = F.call_function("shiftleft", F.col("prefix"), F.lit(STEP)).bitwiseOR(F.col("own").bitwiseXOR(F.col("mask")))
    return out.select("rot", "depth", "word", prefix.alias("prefix"), "errors", (F.col("home") & (F.col("mask") == 0)).alias("home"))


def trie_join(word: np.ndarray, home: np.ndarray, starts: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within max_bits: home with home, and probe with home, in each group; a chunk at a time.

    word is sorted in each group, home ones first. A trie node is a range of
    rows. Node pairs of all groups go down together, a bounded front of them
    at a time, so memory follows the rows, not the pairs.
    """
    ends = np.append(starts[1:], len(word))
    homes = np.concatenate([[0], np.cumsum(home)])
    split = starts + homes[ends] - homes[starts]
    ones: dict[int, np.ndarray] = {}
    first = (np.concatenate([starts, split]), np.concatenate([split, ends]), np.tile(starts, 2), np.tile(split, 2), np.zeros(2 * len(starts), dtype=np.int64))
    fronts = [(63, first)]
    while fronts:
        bit, (lo, hi, lo2, hi2, err) = fronts.pop()
        small = ((hi - lo) * (hi2 - lo2) <= LEAF) | (bit < 0)
        yield from _compared(word, lo[small], hi[small], lo2[small], hi2[small], max_bits)
        lo, hi, lo2, hi2, err = (x[~small] for x in (lo, hi, lo2, hi2, err))
        if not len(lo):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((word >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)])
        seen = ones[bit]
        mid, mid2 = hi - (seen[hi] - seen[lo]), hi2 - (seen[hi2] - seen[lo2])
        same = (lo == lo2) & (hi == hi2)
        pieces = [(lo, mid, lo2, mid2, err), (mid, hi, mid2, hi2, err), (lo, mid, mid2, hi2, err + 1)]
        pieces.append(tuple(x[~same] for x in (mid, hi, lo2, mid2, err + 1)))
        below = [np.concatenate(x) for x in zip(*pieces)]
        live = (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= max_bits)
        below = [x[live] for x in below]
        for at in range(0, len(below[0]), FRONT):
            fronts.append((bit - 1, tuple(x[at : at + FRONT] for x in below)))


def _compared(word, lo, hi, lo2, hi2, max_bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within max_bits of each two ranges, a chunk of comparisons at a time."""
    n, m = hi - lo, hi2 - lo2
    live = (n * m > 0) & ~((lo == lo2) & (n == 1) & (m == 1))
    lo, lo2, n, m = lo[live], lo2[live], n[live], m[live]
    total = np.cumsum(n * m)
    at = 0
    while at < len(lo):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + CHUNK, side="right")))
        size = (n * m)[at:to]
        which = np.repeat(np.arange(at, to), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a, b = lo[which] + inside // m[which], lo2[which] + inside % m[which]
        near = (np.bitwise_count(word[a] ^ word[b]) <= max_bits) & ~((lo[which] == lo2[which]) & (a >= b))
        yield a[near], b[near]
        at = to
