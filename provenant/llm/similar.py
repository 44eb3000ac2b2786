"""Candidate groups of similar texts: SimHash fingerprints of byte grams, MinHash bands, and what joins on them.

Texts are not moved here: an item is a hash, a fingerprint and the roots (64-bit
keys) under which it may meet others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import group_starts, materialize, split_by_key, whole_groups
from provenant.llm.hamming import hamming_groups

#: Byte grams; MinHashes to a band, and bands.
GRAM, ROWS, BANDS = 5, 4, 6
#: Counters that the grams of a text are added up in before they meet the 64 hyperplanes.
COUNTERS = 512
#: The band of groups that the trie self-join has found; it comes after all others.
SIMHASH = 99
#: Groups of more items are not thinned by their fingerprints.
THINNED = 512  # the pairs to be compared are the same
#: Sizes are told up to LARGEST; bands are below SIZED.
LARGEST, SIZED = (1 << 24) - 1, 128
#: Texts whose counters are held at once.
SLICE = 1024
_TURNS = (np.random.default_rng(11).integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
#: As many counters on either side of each plane: bits lean to no side as texts grow longer.
_PLANES = np.random.default_rng(12).permuted(np.repeat(np.float32([1, -1])[:, None], COUNTERS // 2, axis=0).repeat(64, axis=1), axis=0)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit words, well mixed."""
    x = x.astype(np.uint64) + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & (2**64 - 1))
    for shift, turn in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(turn)
    return x ^ (x >> np.uint64(31))


def gram_marks(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n) SimHash fingerprints and (n, BANDS) roots of texts of at least GRAM bytes.

    A bit of the fingerprint is the side of a random hyperplane on which the
    counts of the grams lie; a root stands for ROWS smallest hashes of the set
    of grams. Equal texts have equal marks.
    """
    if not lines:
        return np.empty(0, dtype=np.uint64), np.empty((0, BANDS), dtype=np.uint64)
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    data = np.frombuffer(b"".join(lines), dtype=np.uint8).astype(np.uint32)
    end = np.cumsum(size)
    gram = np.zeros(len(data), dtype=np.uint32)
    full = len(data) - GRAM + 1
    for k in range(GRAM):
        gram[:full] *= np.uint32(0x01000193)
        gram[:full] += data[k : full + k]
    for shift, turn in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        gram ^= gram >> np.uint32(shift)
        gram *= np.uint32(turn)
    # the last GRAM - 1 places of a text run into the next one: they repeat its last gram, which changes no minimum
    tails = end[:, None] - np.arange(1, GRAM)
    gram[tails] = gram[end - GRAM][:, None]
    roots, turned = np.zeros((len(lines), BANDS), dtype=np.uint64), np.empty_like(gram)
    for k, turn in enumerate(_TURNS):
        least = np.minimum.reduceat(np.multiply(gram, turn, out=turned), end - size)
        roots[:, k // ROWS] = mixed(roots[:, k // ROWS] ^ least, k)
    fp = np.empty(len(lines), dtype=np.uint64)
    counter = (gram >> np.uint32(23)).astype(np.int64)
    # and are counted in the first counter, from which they are taken again
    counter[tails] = 0
    for first in range(0, len(lines), SLICE):
        n = size[first : first + SLICE]
        a, b = int(end[first] - size[first]), int(end[first + len(n) - 1])
        row = np.repeat(np.arange(len(n), dtype=np.int64) * COUNTERS, n)
        row += counter[a:b]
        counts = np.bincount(row, minlength=len(n) * COUNTERS)
        counts[::COUNTERS] -= GRAM - 1
        bits = counts.reshape(len(n), COUNTERS).astype(np.float32) @ _PLANES > 0
        fp[first : first + SLICE] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return fp, roots


def candidate_groups(items: DataFrame, max_bits: int, max_far: int, least: float | None = None) -> DataFrame:
    """root, band, h: groups of items(h, fp, roots) that hold every pair to be compared.

    A pair is to be compared when its fingerprints differ in at most max_bits
    bits (pigeonhole blocks and the trie self-join find those), or when it
    shares a root and its fingerprints differ in at most max_far bits. band is
    the place of that root among an item's roots, or SIMHASH. A group of the
    same items is told once. h may repeat; an empty table gives none. With
    `least`, items have a size, and one that shares roots only with items that
    are smaller than `least` of it, or the other way about, need not be told.
    """
    size = F.least("size", F.lit(LARGEST)) if least else F.lit(0)
    shared = items.select("h", "fp", size.alias("size"), F.posexplode("roots").alias("band", "root"))
    # band and size ride in one number; one long is sorted by its digits, the order within a root is made below
    shared = shared.select("h", "fp", "root", (F.col("band") + F.col("size") * SIZED).cast("int").alias("band")).repartition("root").sortWithinPartitions("root")

    def near(word: np.ndarray, long: np.ndarray, word2: np.ndarray, long2: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(word ^ word2) <= max_far
        return out & (np.minimum(long, long2) >= least * np.maximum(long, long2) - 1e-6) if least else out

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["root"]):
            root, h, band = (table.column(x).to_numpy() for x in ("root", "h", "band"))
            word = table.column("fp").to_numpy().view(np.uint64)
            alone = np.concatenate([[True], root[1:] != root[:-1], [True]])
            some = np.flatnonzero(~(alone[1:] & alone[:-1]))
            some = some[np.lexsort((h[some], root[some]))]
            root, h, band, word = root[some], h[some], band[some], word[some]
            once = np.ones(len(h), dtype=bool)
            once[1:] = (root[1:] != root[:-1]) | (h[1:] != h[:-1])
            root, h, band, word = root[once], h[once], band[once], word[once]
            long, band = band // SIZED, band % SIZED
            starts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
            size = np.diff(np.append(starts, len(h)))
            keep = np.repeat(size > THINNED, size)
            two = starts[size == 2]
            close = two[near(word[two], long[two], word[two + 1], long[two + 1])]
            keep[close] = keep[close + 1] = True
            some = (size > 2) & (size <= THINNED)
            for a, b in zip(starts[some].tolist(), (starts + size)[some].tolist()):
                keep[a:b] = near(word[a:b, None], long[a:b, None], word[None, a:b], long[None, a:b]).sum(axis=1) > 1
            yield _told(np.repeat(np.arange(len(starts)), size)[keep], band[keep], h[keep])

    groups = shared.mapInArrow(met, "root long, band int, h long")
    words = materialize(items.groupBy("fp").agg((F.min("h") < F.max("h")).alias("several")), "candidate-words")
    near = hamming_groups(words.select("fp"), max_bits)
    # items of one and the same fingerprint are a group of their own
    near = materialize(near.unionByName(words.where("several").select(F.xxhash64("fp").alias("root"), F.col("fp").alias("node"))), "candidate-near")
    some = split_by_key(items.select("fp", "h"), near, "node", "fp")[0].distinct()
    near = near.join(some, F.col("node") == F.col("fp")).select("root", F.lit(SIMHASH).alias("band"), "h")
    return groups.unionByName(near).groupBy("root", "h").agg(F.min("band").alias("band"))


def to_compare(fp: np.ndarray, roots: np.ndarray, band: np.ndarray, max_bits: int, max_far: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which index pairs of a block are to be compared in it: near enough, and not together in an earlier band."""

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(fp[a] ^ fp[b]) <= np.where(band[a] == SIMHASH, max_bits, max_far)
        left = np.flatnonzero(out)
        for k in range(roots.shape[1]):
            out[left] &= (roots[a[left], k] != roots[b[left], k]) | (band[a[left]] <= k)
        return out

    return fit


def _told(group: np.ndarray, band: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """root, band, h of groups (numbers in order), named after their members."""
    root = np.empty(0, dtype=np.uint64)
    if len(h):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        name = mixed(np.add.reduceat(mixed(h.view(np.uint64)), starts))
        root = np.repeat(name, np.diff(np.append(starts, len(h))))
    return pa.RecordBatch.from_arrays([pa.array(root.view(np.int64)), pa.array(band), pa.array(h)], names=["root", "band", "h"])


def compared(rows: DataFrame, value: str, compare: Callable[[list, np.ndarray, Callable], np.ndarray], max_bits: int, max_far: int, capacity: int = 1024, least: int = 2000, items: DataFrame | None = None) -> DataFrame:
    """src, dst links between the h of rows(root, band, h, fp, roots, value), smaller values first.

    With items(h, fp, roots, value), one of each h, rows need only have root,
    band and h: values then travel to their h and to their blocks, and no further.

    compare(values, starts of groups, fit) gives each value the smallest index
    linked with it in its group; fit tells which index pairs are its to
    measure. Groups of more than `capacity` rows are cut into chunks, and each
    pair of chunks is a block of its own, so that no task holds a whole large
    group.
    """
    counts = rows.groupBy("root").agg(F.ceil(F.count("*") / capacity).cast("int").alias("m"))
    rows = rows.join(counts, "root").withColumn("chunk", F.pmod(F.xxhash64("h"), F.col("m")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(F.least(k, "chunk").alias("i"), F.greatest(k, "chunk").alias("j")))
    rows = rows.withColumn("b", F.explode(others)).select(F.xxhash64("root", "b.i", "b.j").alias("block"), "band", "h", *(("fp", "roots", value) if items is None else ()))
    if items is not None:
        rows = rows.join(items.select("h", "fp", "roots", value), "h")
    rows = rows.repartition("block").sortWithinPartitions("block", F.length(value), "h")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["block"], least):
            h, values = table.column("h").to_numpy(), table.column(value).to_pylist()
            fp, band = table.column("fp").to_numpy().view(np.uint64), table.column("band").to_numpy()
            roots = table.column("roots").combine_chunks().flatten().to_numpy().reshape(len(h), -1)
            label = compare(values, group_starts(table, ["block"]), to_compare(fp, roots, band, max_bits, max_far))
            child = np.flatnonzero(label != np.arange(len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[child]), pa.array(h[label[child]])], names=["src", "dst"])

    return rows.mapInArrow(of, "src long, dst long")

