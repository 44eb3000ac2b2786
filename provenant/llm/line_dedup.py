"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, MinHash bands, verified edit similarity, one occurrence per group.

Texts travel only where they must: lines are known by hashes until a pair is
to be verified, and then only lines that have a candidate are fetched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import column, finished, free_name, materialize, merged, split_by_key, told_apart
from provenant.llm.components import connected_components
from provenant.llm.edit import edit_within, points
from provenant.llm.similar import GRAM, candidate_groups, compared, gram_marks

#: ASCII marks are left out of lines; digits count as 0 where candidates are sought, as themselves where lines are compared.
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_AS_ZERO = bytes(48 if 48 <= x <= 57 else x for x in range(256))
#: White space inside a line.
_AS_SPACE = bytes(32 if x in b"\t\r\v\f" else x for x in range(256))
#: Shorter lines (bytes) also meet under their halves: grams tell little of them.
HALVED = 72
#: Pairs held at once, and pairs of a line measured in a round.
PAIRS, MEASURED = 100_000, 6
#: Characters from which runs of three letters are counted before a distance is measured.
PROFILED = 500
#: Bytes of lines marked at once, lines that a task remembers, rows that come back from Python at once.
CHUNK, SEEN, ROWS_OUT = 1 << 18, 300_000, 500


def normalized_lines(text: str) -> list[bytes]:
    """Each line in lower case, without ASCII marks, words one space apart (UTF-8)."""
    raw = text.lower().encode().translate(_AS_SPACE, _MARKS)
    # each turn halves the widest gap
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return [line.strip(b" ") for line in raw.split(b"\n")]


def least_length(similarity: float) -> int:
    """Characters below which no line can have another one of that edit similarity: one edit must be allowed to the longer line."""
    return max(GRAM, math.ceil(1 / (1 - similarity) - 1e-9) - 1) if similarity < 1 else 1 << 62


def half_roots(line: str) -> list[int]:
    """Keys of a line's halves: two lines that are one edit apart share one, wherever the edit is.

    The shorter of the two, of n characters, is parted at n // 2; what an
    edit leaves alone is its head or its tail. A line may be the shorter or,
    with n + 1 characters, the longer.
    """
    out = set()
    for n in (len(line), len(line) - 1):
        at = n // 2
        out.add((0, line[:at]))
        out.add((1, line[len(line) - (n - at) :]))
    return [xxhash.xxh64_intdigest(x.encode(), side) for side, x in out]


def line_table(documents: DataFrame, similarity: float) -> DataFrame:
    """doc_id, key, line_no, first, h, fp, size (characters), roots of every line with words of documents(doc_id, key, text).

    key stands for the row's id and text, first tells a row's first line.
    Lines that can be similar to others have a fingerprint and roots; one that
    the task has lately seen is not marked again.
    """
    least = least_length(similarity)
    names = ["doc_id", "key", "line_no", "first", "h", "fp", "size", "roots"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, keys, texts = (column(batch, x) for x in names[:2] + ["text"])
            row, number, first, h, marked, lines, size = [], [], [], [], [], [], 0

            def made() -> pa.RecordBatch:
                fp, bands = gram_marks(lines)
                roots = [[*b, *half_roots(x.decode())] if len(x) < HALVED else b for b, x in zip(bands.tolist(), lines)]
                at, place = np.flatnonzero(marked), pa.array(row, pa.int64())
                words, count = np.zeros(len(h), dtype=np.uint64), np.zeros(len(h) + 1, dtype=np.int32)
                long = np.zeros(len(h), dtype=np.int32)
                words[at], count[at + 1] = fp, [len(x) for x in roots]
                flat = np.array([x for r in roots for x in r], dtype=np.uint64).view(np.int64)
                hashes = pa.array(np.array(h, dtype=np.uint64).view(np.int64))
                long[at] = [len(x) if x.isascii() else len(x.decode()) for x in lines]
                none = ~np.array(marked, dtype=bool)
                marks = pa.array(words.view(np.int64), mask=none), pa.array(long, mask=none), pa.ListArray.from_arrays(np.cumsum(count, dtype=np.int32), pa.array(flat))
                return pa.RecordBatch.from_arrays([ids.take(place), keys.take(place), pa.array(number, pa.int32()), pa.array(first, pa.bool_()), hashes, *marks], names=names)

            for k in range(batch.num_rows):
                begun = False
                for n, line in enumerate(normalized_lines(texts[k].as_py() or "")):
                    if not line:
                        continue
                    value = xxhash.xxh64_intdigest(line)
                    new = len(line) >= least and value not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(value)
                        lines.append(line.translate(_AS_ZERO))
                        size += len(line)
                    row.append(k)
                    number.append(n)
                    first.append(not begun)
                    h.append(value)
                    marked.append(new)
                    begun = True
                    if size >= CHUNK or len(h) >= 50_000:
                        yield made()
                        row, number, first, h, marked, lines, size = [], [], [], [], [], [], 0
            yield made()

    rows = documents.select("doc_id", "key", "text")
    return rows.mapInArrow(of, "doc_id long, key long, line_no int, first boolean, h long, fp long, size int, roots array<long>")


def similar_lines(similarity: float):
    """Compares lines, the shortest first in each group: the smallest linked index of each.

    One edit changes at most q runs of q letters, so lengths and counts of
    letters, and of runs of three in long lines, rule pairs out that are too
    far apart. The others are measured in rounds, a few for each line; a pair that is
    connected by then needs no distance.
    """

    def compare(lines: list[str], starts: np.ndarray, fit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        text = [points(x) for x in lines]
        size = np.fromiter(map(len, text), dtype=np.int64, count=len(text))
        letters = np.concatenate(text).astype(np.int64) & 63
        letters = np.bincount(np.repeat(np.arange(len(text)) * 64, size) + letters, minlength=64 * len(text)).reshape(-1, 64).astype(np.int32)
        found, grams = [], {}
        for a, b in _pairs(starts, len(text)):
            near = (size[b] <= size[a] / similarity + 1e-6) & fit(a, b)
            a, b = a[near], b[near]
            near = np.abs(letters[a] - letters[b]).sum(axis=1) <= 2 * _allowed(similarity, size[b])
            a, b = a[near], b[near]
            long = np.flatnonzero(size[b] >= PROFILED)
            grams.update({k: _profile(text[k]) for k in np.union1d(a[long], b[long]).tolist() if k not in grams})
            far = [np.abs(grams[x] - grams[y]).sum(dtype=np.int64) for x, y in zip(a[long].tolist(), b[long].tolist())]
            near = np.ones(len(a), dtype=bool)
            near[long] = np.array(far, dtype=np.int64) <= 6 * _allowed(similarity, size[b[long]])
            found.append((a[near], b[near]))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (starts[:0], starts[:0])
        # the nearest in length first
        order = np.lexsort((-a, b))
        a, b = a[order], b[order]
        label = np.arange(len(text))
        while len(a):
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
            now = rank < MEASURED
            p, q = a[now], b[now]
            linked = edit_within([text[k] for k in q], [text[k] for k in p], _allowed(similarity, size[q]))
            label = merged(label, p[linked], q[linked])
            a, b = a[~now], b[~now]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
        return label

    return compare


def _profile(text: np.ndarray) -> np.ndarray:
    """Counts of the runs of three letters, some to a counter."""
    run = (text[:-2] * np.uint32(0x01000193) + text[1:-1]) * np.uint32(0x01000193) + text[2:]
    return np.bincount((run * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=2048).astype(np.int32)


def _allowed(similarity: float, size: np.ndarray) -> np.ndarray:
    return ((1 - similarity) * size + 1e-9).astype(np.int64)


def _pairs(starts: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs a < b inside each group, at most about PAIRS at a time."""
    ends = np.repeat(np.append(starts[1:], rows), np.diff(np.append(starts, rows)))
    after = ends - np.arange(rows) - 1
    total = np.cumsum(after)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        many = after[at:to]
        a = np.repeat(np.arange(at, to), many)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        at = to


def _fetched(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, line, fp and the roots of the bands of the lines that wanted(h, key, line_no) asks for, once for each row of a key."""
    wanted = materialize(wanted.groupBy("key").agg(F.collect_list(F.struct("line_no", "h")).alias("want")), "line-wanted")
    texts = split_by_key(documents.select("key", "text"), wanted, "key", "key")[0].join(wanted, "key")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, line = [], []
            for text, want in zip(column(batch, "text"), column(batch, "want")):
                raw = text.as_py().split("\n")
                for x in want.as_py():
                    h.append(x["h"])
                    line.append(normalized_lines(raw[x["line_no"]])[0].decode())
            fp, roots = gram_marks([x.encode().translate(_AS_ZERO) for x in line])
            roots = pa.array(list(roots.view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(line, pa.string()), pa.array(fp.view(np.int64)), roots], names=["h", "line", "fp", "roots"])

    return texts.select("text", "want").mapInArrow(of, "h long, line string, fp long, roots array<long>")


def dropped_lines(rows: DataFrame, similarity: float, max_bits: int, max_far: int) -> DataFrame:
    """key, lines, repeated of rows(doc_id, key, text): the line numbers that a row loses, and whether there are more rows like it.

    Rows that lose nothing and stand alone are not told.
    """
    lines = materialize(line_table(rows, similarity), "lines")
    place = F.struct("doc_id", "key", "line_no")
    nodes = materialize(lines.groupBy("h").agg(F.min(place).alias("place"), F.count("*").alias("n")), "line-nodes")
    met = materialize(candidate_groups(lines.where("fp is not null").select("h", "fp", "size", "roots"), max_bits, max_far, similarity), "line-met")
    asked = nodes.join(met.select("h").distinct(), "h").select("h", "place.key", "place.line_no")
    # written so that the texts' shuffle can go before the lines' begins
    found = materialize(_fetched(rows, asked), "line-found").dropDuplicates(["h"])
    links = materialize(compared(met, "line", similar_lines(similarity), max_bits, max_far, least=20_000, items=found), "line-links")
    groups = connected_components(links).select(F.col("node").alias("h"), F.col("component").alias("group"))
    # of a group, the first occurrence stays
    known = nodes.join(groups, "h", "left").where("n > 1 or group is not null").select("h", F.coalesce("group", "h").alias("group"), "place")
    known = materialize(known, "line-groups")
    first = known.groupBy("group").agg(F.min("place").alias("first"))
    known = known.join(first, "group").select("h", F.col("first").alias("stays"))
    drop = split_by_key(lines.select("h", "doc_id", "key", "line_no"), known, "h", "h")[0].join(known, "h").where(~place.eqNullSafe(F.col("stays")))
    drop = drop.groupBy("key").agg(F.collect_set("line_no").alias("lines"))
    again = lines.where("first").groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("repeated"))
    return drop.join(again, "key", "full")


def dedup_lines(documents: DataFrame, similarity: float = 0.9, max_bits: int = 3, max_far: int = 15, counts: tuple[str, str] | None = None) -> DataFrame:
    """documents with repeated lines taken out of their text; `counts` names columns for how many lines there were and stay.

    Lines are parted at line feeds and compared without case, ASCII marks and
    spacing; they link when equal so, or when 1 - edit distance / longer length
    is at least `similarity` and they are compared: when their SimHashes differ
    in at most max_bits bits, or they share a band of MinHashes or (short ones)
    a half, digits counted alike, and their SimHashes differ in at most max_far
    bits. Of each connected group the occurrence with the smallest doc_id
    (null first), then line, stays; of rows that repeat both id and text, one
    keeps it. Lines without words stay. A text whose lines all go becomes
    empty; null stays null. Other columns are carried along, whatever their
    names; an empty table gives an empty result.
    """
    spark, names = documents.sparkSession, documents.columns
    if counts and {c.lower() for c in counts} & {c.lower() for c in names}:
        raise ValueError(f"documents already have a column of {counts}")
    key, drop, again = (free_name(documents, x) for x in ("line_key", "line_drop", "line_again"))
    keyed = documents.withColumn(key, F.xxhash64("doc_id", "text"))
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), "text")
    told = finished(lambda: dropped_lines(rows, similarity, max_bits, max_far), spark, "line-drops")
    told = told.select(F.col("key").alias(key), F.col("lines").alias(drop), F.col("repeated").alias(again))
    losing, intact = split_by_key(keyed, told, key, key)
    losing = losing.join(told, key, "left")
    if not told.where(F.col(again)).isEmpty():
        keeps, others = told_apart(losing.where(F.col(again)), key, "line-alike")
        losing = losing.where(F.col(again).isNull()).unionByName(keeps.withColumn(again, F.lit(False))).unionByName(others)
    quoted = [F.col(f"`{n}`") for n in names]
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    intact = intact.select(*quoted, *[size.alias(c) for c in counts or ()])
    return intact.unionByName(_without(losing, names, drop, again, counts))


def _without(losing: DataFrame, names: list[str], drop: str, again: str, counts: tuple[str, str] | None) -> DataFrame:
    """The rows without the lines in `drop`, or without any line that has words where `again` is true."""

    def shorter(text: str, gone: list[int] | None, every: bool | None) -> tuple[str, int, int]:
        lines = text.split("\n")
        left = [x for x, words in zip(lines, normalized_lines(text)) if not words] if every else [x for k, x in enumerate(lines) if k not in set(gone or ())]
        return "\n".join(left), len(lines), len(left)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                new = [(None, 0, 0) if t.as_py() is None else shorter(t.as_py(), g.as_py(), e.as_py()) for t, g, e in zip(*(column(part, c) for c in ("text", drop, again)))]
                arrays = [pa.array([x[0] for x in new], pa.string()) if c == "text" else column(part, c) for c in names]
                told = [pa.array([x[k] for x in new], pa.int64()) for k in (1, 2)] if counts else []
                yield pa.RecordBatch.from_arrays(arrays + told, names=[*names, *(counts or ())])

    kept = losing.select(*[F.col(f"`{n}`") for n in names], drop, again)
    schema = kept.select(*[F.col(f"`{n}`") for n in names]).schema
    for c in counts or ():
        schema = schema.add(c, "long")
    return kept.mapInArrow(of, schema)


def op2_line_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_kept of every row of documents(doc_id, text); see dedup_lines."""
    return dedup_lines(documents.select("doc_id", "text"), counts=("n_lines", "n_kept"))
