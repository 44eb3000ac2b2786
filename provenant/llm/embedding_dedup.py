"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import column, group_starts, materialize, merged, whole_groups
from provenant.llm.components import connected_components

#: Cosines held in memory at once.
CHUNK = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


@dataclass(frozen=True)
class CrossPolytope:
    """`tables` hash tables, each of `parts` cross-polytope hashes; a vector lives in one bucket of a table and probes `probes` more."""

    tables: int = 6
    parts: int = 3
    probes: int = 5
    nearest: int = 3
    seed: int = 17

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bucket codes (n, tables, 1 + probes) of unit rows; the first of each table is the vector's own bucket.

        A hash is the nearest of the 2d signed axes after three sign flips and
        Hadamard transforms. Probes take the next-nearest axes, the smallest
        sum of squared gaps first.
        """
        n, d = x.shape
        wide = 1 << max(1, (d - 1).bit_length())
        x = np.pad(x, ((0, 0), (0, wide - d)))
        rng = np.random.default_rng(self.seed)
        ways = list(itertools.product(range(min(self.nearest, wide)), repeat=self.parts))
        out = np.empty((n, self.tables, min(1 + self.probes, len(ways))), dtype=np.int64)
        for t in range(self.tables):
            axes, gaps = [], []
            for _ in range(self.parts):
                y = x
                for _ in range(3):
                    y = hadamard(y * rng.choice([-1.0, 1.0], wide))
                order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : self.nearest]
                value = np.take_along_axis(y, order, axis=1)
                axes.append(2 * order + (value > 0))
                gaps.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
            code = np.stack([sum(a[:, w] * (2 * wide) ** k for k, (a, w) in enumerate(zip(axes, way))) for way in ways], axis=1)
            loss = np.stack([sum(g[:, w] for g, w in zip(gaps, way)) for way in ways], axis=1)
            best = np.argsort(loss, axis=1, kind="stable")[:, : out.shape[2]]
            out[:, t] = np.take_along_axis(code, best, axis=1)
        return out


def unit_rows(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit rows (double precision) of an array<float> column, by dimension."""
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = flat[starts[at][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _buckets(nodes: DataFrame, hashing: CrossPolytope) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, label = column(batch, "node").to_numpy(), column(batch, "label").to_numpy()
            for at, x in unit_rows(column(batch, "embedding")):
                codes = hashing.codes(x)
                n, tables, ways = codes.shape
                arrays = [
                    np.repeat(node[at], tables * ways),
                    np.repeat(label[at], tables * ways),
                    np.full(codes.size, x.shape[1], dtype=np.int32),
                    np.tile(np.repeat(np.arange(tables, dtype=np.int32), ways), n),
                    codes.reshape(-1),
                    np.tile(np.arange(ways) == 0, n * tables),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["node", "label", "dim", "slot", "code", "home"])

    return nodes.select("node", "label", "embedding").mapInArrow(of, "node long, label long, dim int, slot int, code long, home boolean")


#: Roles of a row in its block: compared as member, as target, or as both.
MEMBER, TARGET, BOTH = 0, 1, 2


def _blocks(rows: DataFrame, capacity: int) -> DataFrame:
    """Rows of buckets that can hold a pair, with block numbers i, j and role.

    Pairs are home with home and probe with home. A bucket of more than
    `capacity` rows is cut into m chunks by node; each pair of chunks is a
    block, so every pair meets in one block and no task holds a whole bucket.
    """
    key = ["label", "dim", "slot", "code"]
    live = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
    live = live.where("n > 1 and homes > 0").withColumn("m", F.ceil(F.col("n") / capacity).cast("int")).drop("n", "homes")
    rows = rows.join(live, key).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("home"), BOTH).otherwise(MEMBER).alias("role")))
    every = F.sequence(F.lit(0), F.col("m") - 1)
    member = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j"), F.lit(MEMBER).alias("role")))
    target = F.transform(every, lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"), F.lit(TARGET).alias("role")))
    block = F.when(F.col("m") == 1, one).when(F.col("home"), F.concat(member, target)).otherwise(member)
    return rows.withColumn("b", F.explode(block)).select(*key, "b.i", "b.j", "b.role", "home", "node")


def _pairs(role: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (target, member) of each block, CHUNK at a time."""
    for a, b in zip(starts, np.append(starts[1:], len(role))):
        target = np.flatnonzero(role[a:b] != MEMBER) + a
        member = np.flatnonzero(role[a:b] != TARGET) + a
        if not len(target) or not len(member):
            continue
        step = max(1, CHUNK // len(member))
        for k in range(0, len(target), step):
            part = target[k : k + step]
            yield np.repeat(part, len(member)), np.tile(member, len(part))


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= CHUNK:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _first_meeting(codes_a: np.ndarray, codes_b: np.ndarray) -> np.ndarray:
    """Of pairs of code rows, the number of the first (table, side) at which they meet: 3t home-home, 3t+1 and 3t+2 one probing the other."""
    home = codes_a[:, :, 0] == codes_b[:, :, 0]
    a_probes = (codes_a[:, :, 1:] == codes_b[:, :, :1]).any(axis=2)
    b_probes = (codes_b[:, :, 1:] == codes_a[:, :, :1]).any(axis=2)
    return np.argmax(np.stack([home, a_probes, b_probes], axis=2).reshape(len(home), -1), axis=1)


def vector_links(nodes: DataFrame, threshold: float, hashing: CrossPolytope, capacity: int) -> DataFrame:
    """node, links, root of nodes(node, label, embedding, copies): how many vectors each links with, and links to a root that connect what is linked.

    A pair that meets in several buckets counts at its first meeting only, so
    counts add up without the pairs ever being written. Rows per block and
    node, so no more than the bucket rows.
    """
    key = ["label", "dim", "slot", "code", "i", "j"]
    rows = materialize(_buckets(nodes, hashing), "polytope-buckets")
    blocks = _blocks(rows, capacity).join(nodes.select("node", "embedding", "copies"), "node")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(n, *key).sortWithinPartitions(*key, "node")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key, 20_000):
            node, slot = table.column("node").to_numpy(), table.column("slot").to_numpy()
            role, home = table.column("role").to_numpy(), table.column("home").to_numpy()
            copies = table.column("copies").to_numpy()
            vectors = table.column("embedding").combine_chunks()
            dim, place, units, codes = np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=np.int64), {}, {}
            for at, x in unit_rows(vectors):
                dim[at], place[at], units[x.shape[1]] = x.shape[1], np.arange(len(at)), x
            links, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
            for a, b in _gathered(_pairs(role, group_starts(table, key))):
                # home with home counts once, the smaller as target
                fit = (node[a] != node[b]) & (~home[b] | (node[a] < node[b]))
                a, b = a[fit], b[fit]
                if not len(a):
                    continue
                cosine = np.empty(len(a))
                for d in np.unique(dim[a]):
                    at = np.flatnonzero(dim[a] == d)
                    x = units[d]
                    cosine[at] = np.einsum("ij,ij->i", x[place[a[at]]], x[place[b[at]]])
                near = cosine >= threshold
                a, b = a[near], b[near]
                if not len(a):
                    continue
                label = merged(label, a, b)
                for d in np.unique(dim[a]):
                    if d not in codes:
                        codes[d] = hashing.codes(units[d])
                    at = np.flatnonzero(dim[a] == d)
                    p, q = a[at], b[at]
                    # the first meeting seen from the smaller node
                    swap = node[p] > node[q]
                    low, high = np.where(swap, q, p), np.where(swap, p, q)
                    here = 3 * slot[p] + np.where(home[q], 0, np.where(swap, 1, 2))
                    first = _first_meeting(codes[d][place[low]], codes[d][place[high]]) == here
                    np.add.at(links, p[first], copies[q[first]])
                    np.add.at(links, q[first], copies[p[first]])
            told = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
            yield pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(links[told]), pa.array(node[label[told]])], names=["node", "links", "root"])

    return blocks.select(*key, "role", "home", "node", "copies", "embedding").mapInArrow(verified, "node long, links long, root long")


def op1_embedding_dedup(embeddings: DataFrame, threshold: float = 0.98, hashing: CrossPolytope = CrossPolytope(), capacity: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings(vec_id, embedding, label).

    Vectors of one label (null: none) link at cosine >= threshold, in double
    precision. A vector that is null, empty, zero or has a null or non-finite
    component, or no id, links with nothing: n_links 0, its own component.
    Vectors of different dimensions do not link. Equal vectors of a label are
    collapsed first and count as links of each other, so repeated rows are
    rows. Rows that share an id with different vectors take the id's links
    together. Extra columns are ignored; an empty table gives an empty result.
    """
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # labels of any type are known by a hash; components keep their precision
    exact = "array<double>" if "double" in embeddings.schema["embedding"].dataType.simpleString() else "array<float>"
    label = F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"))).alias("label")
    rows = embeddings.select("vec_id", F.col("embedding").cast(exact).alias("embedding"), label)
    nodes = rows.where(ok & sound).groupBy("label", "embedding").agg(F.min("vec_id").cast("long").alias("node"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "polytope-nodes")
    links = materialize(vector_links(nodes, threshold, hashing, capacity), "polytope-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst"))).select("node", F.col("component"))
    known = nodes.join(counts, "node", "left").join(groups, "node", "left")
    known = known.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.withColumn("sound", ok & sound)
    found = out.where("sound").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = out.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    every = found.unionByName(alone)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
