"""Best-fit packing of documents into sequences by bin completion, on counts of lengths.

Pieces of one length are interchangeable, so the packing problem is its
histogram: at most `capacity` counts, however many documents there are. The
driver solves that; the pieces then take their places by rank within their
length.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import column, materialize

#: Rows that one window may put in order.
RANKED_ROWS = 10_000


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """Byte-level BPE from a rank file: the same ids as the tokenizer of that vocabulary, several times as fast.

    The tokenizer's added tokens, which its own file lists, are found in a text
    before the rest is split.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def pieces_of(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """start, length of a document's pieces: whole capacities, what is over first."""
    over = tokens % capacity
    cuts = ([0] if over else []) + list(range(over, tokens, capacity))
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], tokens])]


def tokenized_pieces(documents: DataFrame, capacity: int, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every document's ids, closed by id 0."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode
        for batch in batches:
            doc, text = column(batch, "doc_id"), column(batch, "text")
            at, rows, ids = [], [], []
            for i in range(batch.num_rows):
                tokens = np.array([*encode(text[i].as_py() or "", allowed_special="all"), 0], dtype="<u4")
                for k, (start, length) in enumerate(pieces_of(len(tokens), capacity)):
                    piece = tokens[start : start + length]
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(piece.tobytes())))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            k, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows))
            out = [doc.take(pa.array(at)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(ids, type=pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    filled = lambda batches: of(b for b in batches if b.num_rows)
    return rows.mapInArrow(filled, schema + (", ids array<int>" if with_ids else ""))


# --- the packing problem on counts -------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without: total length, and items that cannot share (Martello and Toth's L2)."""
    size = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for a in range(half + 1):
        alone = int(n[-1] - n[capacity - a])
        large = int(n[capacity - a] - n[half])
        room = large * capacity - int(total[capacity - a] - total[half])
        small = int(total[half] - (total[a - 1] if a else 0))
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths of a bin, number of such bins)."""
    open_: dict[int, Counter] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        room = length
        while left and room <= capacity:
            bins = open_.get(room)
            if not bins:
                room += 1
                continue
            pattern, many = next(iter(bins.items()))
            used = min(many, left)
            left -= used
            bins[pattern] -= used
            if not bins[pattern]:
                del bins[pattern]
            open_.setdefault(room - length, Counter())[(*pattern, length)] += used
        while left:
            fit = capacity // length
            full, left_over = divmod(left, fit)
            if full:
                open_.setdefault(capacity - fit * length, Counter())[(length,) * fit] += full
            if left_over:
                open_.setdefault(capacity - left_over * length, Counter())[(length,) * left_over] += 1
            left = 0
    return [(p, n) for bins in open_.values() for p, n in bins.items() if n]


def completions(counts: np.ndarray, room: int, most: int) -> list[tuple[int, ...]]:
    """Undominated fillings of a bin with `room` left, the least waste first, at most `most`.

    A filling is dominated if another holds its items in the places of larger
    ones: so the last item of each is the largest that fits, and of two items
    that fit where one does only the one is kept. Fillings of up to three
    items are enumerated; what a fuller bin needs is left to the next levels
    of the same rule, which continue a filling greedily.
    """
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return [()]
    fit = np.zeros(room + 1, dtype=np.int64)
    fit[have] = have
    fit = np.maximum.accumulate(fit)
    single = int(fit[room])
    found = [(room - single, (single,))]
    if single != room:
        for first, rest in ((x, room - x) for x in _spread(have[::-1], 96)):
            pair = _best_pair(counts, have, fit, first, rest)
            found += [(room - first - sum(p), (first, *p)) for p in pair]
            if len(found) > 4 * most and found[-1][0] == 0:
                break
        y = fit[room - have]
        good = (y > 0) & ((y != have) | (counts[have] > 1)) & (have + y > single)
        order = np.lexsort((-have[good], (room - have - y)[good]))[: 4 * most]
        found += [(int(room - a - b), (int(max(a, b)), int(min(a, b)))) for a, b in zip(have[good][order], y[good][order])]
    done, seen = [], set()
    for waste, items in sorted(found, key=lambda x: (x[0], len(x[1]), tuple(-i for i in sorted(x[1], reverse=True)))):
        items = _greedy(counts, items, waste, fit)
        if items not in seen:
            seen.add(items)
            done.append(items)
        if len(done) >= 4 * most:
            break
    return sorted(done, key=lambda x: (room - sum(x), len(x), tuple(-i for i in x)))[:most]


def _spread(values: np.ndarray, most: int) -> list[int]:
    step = max(1, len(values) // most)
    return [int(x) for x in values[::step]]


def _best_pair(counts: np.ndarray, have: np.ndarray, fit: np.ndarray, first: int, rest: int) -> list[tuple[int, int]]:
    """The two items that fill `rest` best beside `first`."""
    x = have[(have <= first) & (have < rest)]
    if not len(x):
        return []
    y = fit[rest - x]
    taken = (x == first).astype(int) + 1
    good = (y > 0) & (counts[x] >= taken) & (counts[y] >= 1 + (y == x) + (y == first))
    if not good.any():
        return []
    x, y = x[good], y[good]
    k = int(np.argmax(x + y))
    return [(int(x[k]), int(y[k]))]


def _greedy(counts: np.ndarray, items: tuple[int, ...], waste: int, fit: np.ndarray) -> tuple[int, ...]:
    used = Counter(items)
    while waste > 0:
        nxt = int(fit[waste])
        while nxt and used[nxt] >= counts[nxt]:
            nxt = int(fit[nxt - 1])
        if not nxt:
            break
        used[nxt] += 1
        waste -= nxt
    return tuple(sorted(used.elements(), reverse=True))


def bin_completion(counts: np.ndarray, capacity: int, branches: int = 4, nodes: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins) that hold all counts in as few bins as the search finds.

    Branch and bound: the largest item left opens a bin; its undominated
    fillings are tried, the least waste first, each for as many bins as the
    counts allow; a branch ends where the waste so far passes what the best
    solution known could spare. Best-fit decreasing gives the first such
    solution, the lower bound the end. `nodes` bounds the search, after which
    the best solution known is returned; that bounds time, not what is packed.
    """
    best = best_fit(counts, capacity)
    best_bins = sum(n for _, n in best)
    bound = lower_bound(counts, capacity)
    total = int((counts * np.arange(capacity + 1)).sum())
    if best_bins == bound:
        return best
    path: list[tuple[tuple[int, ...], int]] = []
    state = [counts.copy()]
    todo: list[Iterator[tuple[int, ...]]] = []
    wasted = [0]

    def enter() -> None:
        """Prepare the fillings of the current state's largest item."""
        now = state[-1]
        left = np.flatnonzero(now)
        if not len(left):
            todo.append(iter(()))
            return
        largest = int(left[-1])
        rest = now.copy()
        rest[largest] -= 1
        todo.append((largest, *c) for c in completions(rest, capacity - largest, branches))

    enter()
    while todo and nodes and best_bins > bound:
        nodes -= 1
        if not state[-1].any():
            bins = sum(n for _, n in path)
            if bins < best_bins:
                best, best_bins = list(path), bins
        items = next(todo[-1], None)
        if items is None:
            todo.pop()
            state.pop()
            wasted.pop()
            if path:
                path.pop()
            continue
        need = Counter(items)
        times = min(int(state[-1][k]) // n for k, n in need.items())
        waste = wasted[-1] + times * (capacity - sum(items))
        if waste > (best_bins - 1) * capacity - total:
            continue
        after = state[-1].copy()
        for k, n in need.items():
            after[k] -= n * times
        state.append(after)
        wasted.append(waste)
        path.append((items, times))
        enter()
    return best


def slots(packing: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """For each length, which ranks go to which bins, and where in them: length, first, after, base, offsets."""
    rows, taken, base = [], Counter(), 0
    for items, times in packing:
        places: dict[int, list[int]] = {}
        at = 0
        for length in items:
            places.setdefault(length, []).append(at)
            at += length
        for length, offsets in places.items():
            first = taken[length]
            taken[length] += times * len(offsets)
            rows.append((length, first, taken[length], base, offsets))
        base += times
    return rows


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces(doc_id, piece, start, length, ...) with sequence_id and offset; pieces must be a written table."""
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in histogram:
        counts[row["length"]] = row["count"]
    plan = slots(bin_completion(counts, capacity))
    schema = "slot_length long, first long, after long, base long, offsets array<long>"
    table = spark.createDataFrame(plan, schema)
    buckets = 1 + int(counts.sum()) // RANKED_ROWS
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("in_bucket", F.row_number().over(order) - 1)
    sums = salted.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rank_base"))
    ranked = ranked.join(base, ["length", "bucket"]).withColumn("rank", F.col("in_bucket") + F.col("rank_base"))
    # a row for each length and pattern, bounded by the capacity and not by the data
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    step, many = F.col("rank") - F.col("first"), F.size("offsets")
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor(step / many)).withColumn("offset", F.get("offsets", (step % many).cast("int")))
    return placed.select(*pieces.columns, F.col("sequence_id").cast("long").alias("sequence_id"), "offset")


def op4_packing(documents: DataFrame, capacity: int = 2048, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of documents(doc_id, text).

    A null or empty text is one piece of one id, the closing 0. Only documents
    of more than `capacity` ids are cut. Each row is a document: repeated rows
    and null ids are packed like any other. Extra columns are ignored. An
    empty table gives an empty result.
    """
    return pack_pieces(materialize(tokenized_pieces(documents, capacity, ranks), "pack-pieces"), capacity)


def packed_sequences(documents: DataFrame, capacity: int = 2048, ranks: str | None = None) -> DataFrame:
    """sequence_id, ids (at most `capacity`): the sequences themselves."""
    placed = pack_pieces(materialize(tokenized_pieces(documents, capacity, ranks, with_ids=True), "pack-ids"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
