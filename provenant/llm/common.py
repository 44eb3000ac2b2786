"""What the operators share: written intermediate tables and streams of sorted groups."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Rows that go to Python at once, and that come back.
ARROW_ROWS, SLICE = 1000, 500


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Where it is unset, a local run (one machine, as in tests) gets a folder of
    its own, and a cluster an error. Whole texts are wide rows: batches for
    Python are kept small, so that long ones fit beside each other in an
    executor's memory.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return path


#: Seconds from one collection of the driver's garbage to the next.
TIDY_S = 2.0
_tidied = [0.0]


def tidied(spark: SparkSession) -> None:
    """Have the driver's garbage collected, unless that was lately done.

    Broadcasts and shuffles of finished jobs are given back only then. Many
    small jobs leave little each, so by itself that comes late, and the heap
    has grown by then.
    """
    if time.monotonic() - _tidied[0] < TIDY_S:
        return
    gc.collect()  # frames that Python no longer uses keep their plans alive
    spark._jvm.System.gc()
    _tidied[0] = time.monotonic()


#: Paths of the tables written inside the finished() that is under way in this thread.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage like checkpoint() does, survives lost executors, keeps
    columns compressed, and leaves the planner with true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    tidied(spark)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], spark: SparkSession, tag: str) -> DataFrame:
    """The rows of make(), written; the tables that make() wrote on the way are deleted, as nothing needs them any more."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        df = make()
    finally:
        _written.reset(token)
    out = materialize(df, tag)
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out


def free_name(df: DataFrame, wish: str) -> str:
    """A name for a helper column that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while wish in taken:
        wish += "_"
    return wish


def told_apart(rows: DataFrame, key: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """One row of each key, and the other rows; they are told apart by a number that is written with them."""
    number = free_name(rows, "number")
    numbered = materialize(rows.withColumn(number, F.monotonically_increasing_id()), tag)
    one = numbered.groupBy(key).agg(F.min(number).alias(number))
    return numbered.join(one, [key, number], "left_semi").drop(number), numbered.join(one, [key, number], "left_anti").drop(number)


def rewritten(df: DataFrame, helper: str, new_text: Callable[[str | None, object], str | None], keep: bool = False) -> DataFrame:
    """df with text = new_text(text, helper column); the helper column goes unless kept."""
    names = [c for c in df.columns if keep or c != helper]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                texts = [new_text(t.as_py(), h.as_py()) for t, h in zip(column(part, "text"), column(part, helper))]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else column(part, c) for c in names], names=names)

    return df.mapInArrow(of, df.select(*[f"`{c}`" for c in names]).schema)


def word_count(text):
    """Number of words of a text column, 0 for null; built-in functions only."""
    parts = F.split(F.regexp_replace(text, rf"^{WORD_GAP}|{WORD_GAP}\z", ""), WORD_GAP)
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(parts)).otherwise(0).cast("long")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 of a string column row by row; null counts as empty."""
    for value in column(batch, name).cast(pa.binary()):
        yield value.as_py() or b""


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 100_000) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by keys into tables that hold whole groups only."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        cut = group_starts(table, keys)[-1]
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers where a new group begins; null-free numeric keys."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of n nodes under links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (smallest reachable index of each node) after more links a[i] - b[i]."""
    a, b = label[a], label[b]
    new = a != b
    if not new.any():
        return label
    return local_components(a[new], b[new], len(label))[label]


#: Spots of a key filter: its size is fixed, whatever it is built from.
SPOTS = 1 << 20


def split_by_key(df: DataFrame, keys: DataFrame, key: str, own: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose column `own` may be among the keys, and rows for which it surely is not.

    Keys are known by a hash below SPOTS, so what is broadcast has at most
    that many rows. It spares a wide table the shuffle of rows that cannot
    join; with very many keys more rows pass, never fewer, so a join of the
    first part stays exact.
    """
    name = free_name(df, "spot")
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(SPOTS)).cast("int")
    spots = F.broadcast(keys.select(spot(key).alias(name)).distinct())
    marked = df.withColumn(name, spot(own))
    return marked.join(spots, name, "left_semi").drop(name), marked.join(spots, name, "left_anti").drop(name)
