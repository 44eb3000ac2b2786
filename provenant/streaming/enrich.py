"""Streams of log events, resolved and enriched as batches are.

The graph is the static side. Exact and relaxed lookups are stream-static
joins; templates of a function are kept in one array per function and the
first that fits is taken, so nothing is aggregated and no state is kept.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provenant.operators.enrich import enrich
from provenant.operators.resolve import exact_index, relaxed_index, template_index


def template_lists(nodes: DataFrame) -> DataFrame:
    """function, templates: its patterns in the order of the nodes."""
    each = F.struct("ord", "prefix", "pattern", "node_id")
    return template_index(nodes).groupBy("function").agg(F.array_sort(F.collect_list(each)).alias("templates"))


def resolve_stream(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """events(module, function, message, ...) with node_id and tier, by stateless steps only; equal to resolve() on a batch."""
    looked = events.join(exact_index(nodes), ["module", "function", "message"], "left").join(relaxed_index(nodes), ["function", "message"], "left")
    looked = looked.join(template_lists(nodes), "function", "left")
    open_ = F.col("exact_id").isNull() & F.col("relaxed_id").isNull()
    first = F.expr("get(filter(templates, t -> startswith(message, t.prefix) and message rlike t.pattern), 0).node_id")
    out = looked.withColumn("template_id", F.when(open_, first))
    tier = F.when(F.col("exact_id").isNotNull(), 1).when(F.col("relaxed_id").isNotNull(), 2).when(F.col("template_id").isNotNull(), 3)
    return out.select(*[F.col(c) for c in events.columns], F.coalesce("exact_id", "relaxed_id", "template_id").alias("node_id"), tier.alias("tier"))


def enrich_stream(events: DataFrame, nodes: DataFrame | None, dimension: DataFrame | None, profile: str = "processor") -> DataFrame:
    """The stream with provenance; without a graph it passes unchanged."""
    if nodes is None or dimension is None:
        return events
    return enrich(resolve_stream(events, nodes), dimension, profile)


def error_rates(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Error rate per module and tumbling window of a stream with event time `ts`; rows later than `late` are left out. An extension."""
    errors = F.sum(F.when(F.col("level") == "error", 1).otherwise(0)).cast("long")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window), "module").agg(F.count("*").alias("total"), errors.alias("errors"))
    share = F.round(F.lit(100.0) * F.col("errors") / F.col("total"), 2)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "module", "total", "errors", share.alias("error_pct"))


def json_events(spark: SparkSession, path: str, schema: str, text: str = "line") -> DataFrame:
    """A stream of JSON lines: their fields at the root; a line that does not begin with a brace, or is no JSON, passes in column `text`."""
    fields = F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.from_json("value", schema))
    lines = spark.readStream.format("text").load(path).select("value", fields.alias("e"))
    return lines.select("e.*", F.when(F.col("e").isNull(), F.col("value")).alias(text))


def start(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as Parquet, each input once, until the input at hand is used up."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(events: DataFrame, nodes: DataFrame, dimension: DataFrame) -> DataFrame:
    """All events through the streaming plan and its sink, in the shared folder; the graph is written first and so read as it stood."""
    spark = events.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    base = f"{base}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{base}/in")
    nodes.select("node_id", "ord", "module", "function", "message_template").write.parquet(f"{base}/nodes")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    enriched = enrich_stream(stream, spark.read.parquet(f"{base}/nodes"), dimension)
    start(enriched, f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.schema(enriched.schema).parquet(f"{base}/out")
