"""Code context on log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each way of enriching attaches to an event.
PROFILES = {
    "logger": ("node_id", "traversal", "call_parents", "call_children", "call_parent_names", "call_child_names", "signature"),
    "processor": (
        "node_id", "module", "function", "file", "line", "tags", "graph_version", "traversal", "call_parents", "call_children",
        "call_parent_names", "call_child_names", "signature", "commit_sha",
    ),
    "handler": ("node_id", "module", "function", "tags", "file", "line", "call_parents", "call_children", "call_parent_names", "call_child_names", "signature"),
}
LISTS = ("traversal", "call_parents", "call_children", "call_parent_names", "call_child_names")


def present(column: Column) -> Column:
    """A list, or null where it is empty."""
    return F.when(F.size(column) > 0, column)


def enrichment(nodes: DataFrame, built_at: str | None = None, commit_sha: str | None = None, branch: str | None = None) -> DataFrame:
    """The dimension that enriches logs: a row for each node, columns as they are attached."""
    empty = F.expr("cast(array() as array<string>)")
    have = set(nodes.columns)
    lists = {"tags": "semantic_tags", "traversal": "lexical_parents", **{k: k for k in LISTS[1:]}}
    columns = ["node_id", "module", "function", "file", "line", "level", "message_template"]
    return nodes.select(
        *columns,
        *[(F.col(source) if source in have else empty).alias(name) for name, source in lists.items()],
        (F.col("signature") if "signature" in have else F.lit(None).cast("string")).alias("signature"),
        F.lit(built_at).cast("string").alias("graph_version"),
        F.lit(commit_sha).cast("string").alias("commit_sha"),
        F.lit(branch).cast("string").alias("branch"),
    )


def enrich(events: DataFrame, dimension: DataFrame, profile: str = "processor") -> DataFrame:
    """events(node_id, ...) with a struct `provenance`: null where no node is known, lists null where empty.

    Events without a node, or with one that the graph lacks, pass unchanged.
    Spark broadcasts the dimension while it is small enough.
    """
    fields = PROFILES[profile]
    right = dimension.dropDuplicates(["node_id"]).select(F.col("node_id").alias("__id"), F.struct(*[(present(F.col(f)) if f in LISTS else F.col(f)).alias(f) for f in fields]).alias("provenance"))
    return events.join(right, F.col("node_id") == F.col("__id"), "left").drop("__id")


def renamed_node_id(events: DataFrame) -> DataFrame:
    """node_id from `provenance.node_id` as dotted transports write it, or from provenance_node_id as others do; neither is needed."""
    dotted = F.col("provenance.node_id") if "provenance" in events.columns else F.lit(None).cast("string")
    flat = F.col("provenance_node_id") if "provenance_node_id" in events.columns else F.lit(None).cast("string")
    return events.withColumn("node_id", F.coalesce(dotted, flat)).drop("provenance", "provenance_node_id")


def resource_attributes(nodes: DataFrame, project: str, schema_version: str, built_at: str, commit_sha: str | None = None, branch: str | None = None) -> DataFrame:
    """One row that describes the graph as a telemetry resource."""
    return nodes.groupBy().agg(
        F.lit(project).alias("project"), F.lit(schema_version).alias("schema_version"), F.lit(built_at).alias("graph_built_at"),
        F.count("*").alias("node_count"), F.lit(commit_sha).cast("string").alias("commit_sha"), F.lit(branch).cast("string").alias("branch"),
    )
