"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import column, finished, free_name, materialize, split_by_key, text_bytes, told_apart
from provenant.llm.components import connected_components
from provenant.llm.hamming import hamming_links
from provenant.llm.similar import candidate_groups, compared

SEED = 42
#: Bands, and MinHashes to a band; at Jaccard 0.8 a pair shares a band with probability 0.997.
BANDS, BAND_ROWS = 8, 3
_TURNS = np.random.default_rng(13).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Unsigned XXH64 of each shingle, repeats included; the whole sequence if it is shorter than one."""
    words = text.translate(_LOWER).split()  # bytes.split() parts at space and 09-0D only
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 1) - size - 1
    count = max(1, len(words) - width + 1)
    end = (start + size)[-count:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(start[:count].tolist(), end)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The word whose bits are those set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little")
    # eight counters of one byte ride in each 64-bit word; none passes 255 rows
    packed = np.add.reduceat(bits.view(np.uint64).reshape(n, 8), np.arange(0, n, 255), axis=0)
    count = packed.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every whole text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((majority_bits(shingle_hashes(x, shingle_words)) for x in text_bytes(batch)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(of, "doc_id long, fp long")


def simhash_groups(documents: DataFrame, max_bits: int = 3, shingle_words: int = 3) -> DataFrame:
    """doc_id, fp, component_id of each row of documents(doc_id, text).

    A-Z are lower-cased; words are runs of other than space and U+0009-000D; a
    text of fewer words than a shingle is one shingle. A text without words
    (null, empty, white space) has fingerprint zero and is linked like any
    other. Rows whose fingerprints differ in at most max_bits bits are linked;
    component_id is the smallest doc_id reachable. Rows are kept as they come:
    repeated rows give repeated results, a null doc_id stays null and takes
    its group's component_id (null if no row of the group has an id). Extra
    columns are ignored. An empty table gives an empty result.
    """
    marks = materialize(fingerprints(documents, shingle_words), "simhash-fp")
    nodes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    # fingerprints are nodes; the smallest id of each is carried along
    links = hamming_links(nodes.select("fp"), max_bits)
    groups = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    member = nodes.join(groups, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    member = member.join(smallest, "root").select("fp", "component_id")
    return marks.join(member, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id; see simhash_groups."""
    mark = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash_groups(documents).select("doc_id", mark.alias("fingerprint"), "component_id")


def _marks(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, key, h (of the set of shingles), fp and roots of every row of documents(doc_id, key, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, fp, roots = [], [], []
            for text in text_bytes(batch):
                shingles = shingle_hashes(text, width)
                fp.append(majority_bits(shingles))
                shingles = np.unique(shingles)
                h.append(xxhash.xxh64_intdigest(shingles.tobytes()))
                # no two texts without words differ: they need not meet
                least = np.array([(shingles * t).min() for t in _TURNS] if len(shingles) else [], dtype=np.uint64).reshape(-1, BAND_ROWS)
                roots.append(np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least)], dtype=np.uint64).view(np.int64))
            h, fp = (np.array(x, dtype=np.uint64).view(np.int64) for x in (h, fp))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "key"), pa.array(h), pa.array(fp), pa.array(roots, pa.list_(pa.int64()))], names=["doc_id", "key", "h", "fp", "roots"])

    return documents.select("doc_id", "key", "text").mapInArrow(of, "doc_id long, key long, h long, fp long, roots array<long>")


def _sets(documents: DataFrame, width: int) -> DataFrame:
    """h, fp, roots and the sorted set of shingles (unsigned 64-bit) of documents(h, fp, roots, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text, width)).tobytes() for text in text_bytes(batch)]
            names = ["h", "fp", "roots", "shingles"]
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in names[:3]), pa.array(sets, pa.binary())], names=names)

    return documents.select("h", "fp", "roots", "text").mapInArrow(of, "h long, fp long, roots array<long>, shingles binary").dropDuplicates(["h"])


def similar_sets(similarity: float):
    """Compares sets of shingles, the smallest first: the smallest linked index of each."""

    def compare(values: list[bytes], starts: np.ndarray, fit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in values]
        label = np.arange(len(sets))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sets)]):
            for x in range(a, b - 1):
                y = np.arange(x + 1, b)
                for y in y[fit(np.full(len(y), x), y)].tolist():
                    p, q = sets[x], sets[y]
                    if len(p) < similarity * len(q):
                        break
                    if label[x] != label[y]:
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        if both >= similarity * (len(p) + len(q) - both):
                            part = label[a:b]
                            part[part == max(label[x], label[y])] = min(label[x], label[y])
        return label

    return compare


def simhash_dedup(documents: DataFrame, shingle_words: int = 5, similarity: float = 0.8, max_bits: int = 3, max_far: int = 20) -> DataFrame:
    """documents without near copies: of each group of similar texts the row with the smallest doc_id (null first) stays.

    Words are those of simhash_groups. Two texts are linked when their sets of
    word shingles have a Jaccard similarity of at least `similarity` and they
    are compared: when their SimHashes differ in at most max_bits bits (the
    trie self-join), or they share a band of MinHashes and differ in at most
    max_far bits. Texts without words are copies of each other. Of rows that
    repeat id and text, one stays. Other columns are carried along, whatever
    their names; an empty table gives an empty result.
    """
    key = free_name(documents, "copy_key")
    keyed = documents.withColumn(key, F.xxhash64("doc_id", "text"))
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), "text")

    def copies() -> DataFrame:
        marks = materialize(_marks(rows, shingle_words), "copy-marks")
        place = F.struct("doc_id", "key")
        nodes = materialize(marks.groupBy("h").agg(F.min(place).alias("place"), F.count("*").alias("n")), "copy-nodes")
        # texts without words are one set, and meet nobody else
        met = materialize(candidate_groups(marks.where("size(roots) > 0").select("h", "fp", "roots"), max_bits, max_far), "copy-met")
        asked = materialize(nodes.join(met.select("h").distinct(), "h").select("h", "place.key"), "copy-asked")
        asked = asked.join(marks.select("key", "fp", "roots").dropDuplicates(["key"]), "key")
        texts = split_by_key(rows.select("key", "text"), asked, "key", "key")[0].join(asked, "key")
        sets = materialize(_sets(texts, shingle_words), "copy-sets")
        links = materialize(compared(met, "shingles", similar_sets(similarity), max_bits, max_far, capacity=512, least=500, items=sets), "copy-links")
        groups = connected_components(links).select(F.col("node").alias("h"), F.col("component").alias("root"))
        known = nodes.join(groups, "h", "left").where("n > 1 or root is not null").select("h", F.coalesce("root", "h").alias("root"), "place")
        known = materialize(known, "copy-groups")
        stays = known.groupBy("root").agg(F.min("place").alias("stays"))
        known = known.join(stays, "root").select("h", "stays")
        found = split_by_key(marks.select("doc_id", "key", "h"), known, "h", "h")[0].join(known, "h")
        # of the rows of a group, those that are not its first, or are so more than once
        every = found.groupBy("key").agg(F.count("*").alias("n"), F.max(place.eqNullSafe(F.col("stays"))).alias("first"))
        return every.where("n > 1 or not first").select("key", "first")

    told = finished(copies, documents.sparkSession, "copies").withColumnRenamed("key", key)
    some, clean = split_by_key(keyed, told, key, key)
    alike = told.where("first").select(key)
    out = clean.unionByName(some.join(told, key, "left_anti"))
    if not alike.isEmpty():
        out = out.unionByName(told_apart(some.join(alike, key, "left_semi"), key, "copy-alike")[0])
    return out.drop(key)
