"""Differences between graphs, sources and caches: full outer, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = ("added", "removed", "moved", "modified")


def diff_graphs(old: DataFrame, new: DataFrame) -> DataFrame:
    """node_id, change_type, old_file, old_line, new_file, new_line, changed of nodes that differ.

    A node that moved (file or line) is not also told as modified (template,
    level or tags); `changed` names the first of those that differs.
    """
    columns = ("file", "line", "message_template", "level", "semantic_tags")
    a = old.select("node_id", F.struct(*columns).alias("o"))
    b = new.select("node_id", F.struct(*columns).alias("n"))
    both = a.join(b, "node_id", "full_outer")
    same = lambda c: F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    differs = F.coalesce(*[F.when(~same(c), F.lit(c)) for c in ("message_template", "level", "semantic_tags")])
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~same("file") | ~same("line"), "moved").when(differs.isNotNull(), "modified")
    rows = both.withColumn("change_type", kind).where("change_type is not null")
    return rows.select(
        "node_id", "change_type", F.col("o.file").alias("old_file"), F.col("o.line").alias("old_line"), F.col("n.file").alias("new_file"),
        F.col("n.line").alias("new_line"), F.when(F.col("change_type") == "modified", differs).alias("changed"),
    )


def diff_summary(changes: DataFrame) -> DataFrame:
    """One row: how many nodes were added, removed, moved and modified, and all together."""
    counts = [F.sum(F.when(F.col("change_type") == c, 1).otherwise(0)).cast("long") for c in CHANGES]
    return changes.groupBy().agg(*[F.coalesce(n, F.lit(0)).cast("long").alias(c) for n, c in zip(counts, CHANGES)], F.count("*").alias("total"))


def lint_untracked(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Log sites in the source that the graph does not have."""
    return sites.join(nodes.select("file", "line").distinct(), ["file", "line"], "left_anti").select("file", "line").distinct()


def lint_stale(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """file, line, node_id (the first) of places in the graph where the source has no log site."""
    gone = nodes.join(sites.select("file", "line").distinct(), ["file", "line"], "left_anti")
    return gone.groupBy("file", "line").agg(F.min_by("node_id", "ord").alias("node_id"))


def _instrumented(nodes: DataFrame) -> DataFrame:
    return nodes.where("function <> '<module>'").select(F.concat("module", F.lit(":"), "function").alias("key")).distinct()


def coverage_metrics(defined: DataFrame, nodes: DataFrame) -> DataFrame:
    """total_functions, instrumented_functions, coverage_pct of defined(key) functions, written module:function."""
    rows = defined.select("key").distinct().join(_instrumented(nodes).withColumn("has", F.lit(1)), "key", "left")
    out = rows.groupBy().agg(F.count("*").alias("total_functions"), F.coalesce(F.sum("has"), F.lit(0)).cast("long").alias("instrumented_functions"))
    share = F.round(F.lit(100.0) * F.col("instrumented_functions") / F.greatest("total_functions", F.lit(1)), 2)
    return out.withColumn("coverage_pct", share)


def uninstrumented(defined: DataFrame, nodes: DataFrame) -> DataFrame:
    return defined.select("key").distinct().join(_instrumented(nodes), "key", "left_anti")


def coverage_gate(metrics: DataFrame, least: float) -> bool:
    """Whether coverage reaches the given percentage."""
    return metrics.first()["coverage_pct"] >= least


def incremental_delta(files: DataFrame, cache: DataFrame) -> DataFrame:
    """path, sha256, status of files(path, content) against cache(path, sha256): hit, miss, or evicted (no longer there)."""
    now = files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"))
    then = cache.select(F.col("path").alias("p"), F.col("sha256").alias("s"))
    both = now.join(then, F.col("path") == F.col("p"), "full_outer")
    status = F.when(F.col("path").isNull(), "evicted").when(F.col("sha256").eqNullSafe(F.col("s")), "hit").otherwise("miss")
    return both.select(F.coalesce("path", "p").alias("path"), F.coalesce("sha256", "s").alias("sha256"), status.alias("status"))


def orphan_node_ids(logs: DataFrame, dimension: DataFrame) -> DataFrame:
    """node_id, n of log events whose node the dimension lacks."""
    known = dimension.select("node_id").distinct()
    return logs.where("node_id is not null").join(known, "node_id", "left_anti").groupBy("node_id").agg(F.count("*").alias("n"))
