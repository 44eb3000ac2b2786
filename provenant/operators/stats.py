"""Statistics, listings and analytics over graphs and enriched logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as T


def graph_overview(nodes: DataFrame) -> DataFrame:
    names = (("n_nodes", F.count("*")), ("n_modules", F.countDistinct("module")), ("n_functions", F.countDistinct("function")), ("n_files", F.countDistinct("file")))
    return nodes.groupBy().agg(*[c.alias(n) for n, c in names])


def tag_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("semantic_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def level_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level")


def _ends(nodes: DataFrame) -> Column:
    """How many parents and children a node has, counted or listed."""
    if {"n_parents", "n_children"} <= set(nodes.columns):
        return F.col("n_parents") + F.col("n_children")
    return F.size("call_parents") + F.size("call_children")


def edge_totals(nodes: DataFrame) -> DataFrame:
    """half_edges: parents and children halved; all_edges: not halved; edge_coverage_pct: nodes with any edge."""
    ends = _ends(nodes)
    total = F.coalesce(F.sum(ends), F.lit(0)).cast("long")
    share = F.round(F.lit(100.0) * F.sum(F.when(ends > 0, 1).otherwise(0)) / F.greatest(F.count("*"), F.lit(1)), 2)
    return nodes.groupBy().agg(F.floor(total / 2).cast("long").alias("half_edges"), total.alias("all_edges"), share.alias("edge_coverage_pct"))


def build_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy().agg(F.count("*").alias("n_nodes"), F.sum(F.size("semantic_tags")).cast("long").alias("n_tags"), F.countDistinct("module").alias("n_modules"))


def module_tree(nodes: DataFrame) -> DataFrame:
    """module, function and its nodes (line, level, node_id) in the order of their lines."""
    each = F.struct("line", "level", "node_id")
    return nodes.groupBy("module", "function").agg(F.array_sort(F.collect_list(each)).alias("nodes")).orderBy("module", "function")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def flat_listing(nodes: DataFrame) -> DataFrame:
    place = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    return nodes.select("file", "line", place.alias("place"), "level", "function", shortened(F.col("message_template"), 60).alias("message"), "node_id").orderBy("file", "line", "node_id")


def find_nodes(nodes: DataFrame, query: str) -> DataFrame:
    hit = T.found_in(query, F.col("message_template"), F.col("function"), F.col("module"))
    return nodes.where(hit).select("node_id", "module", "function", "level", shortened(F.col("message_template"), 50).alias("message"))


def models_listing(models: DataFrame) -> DataFrame:
    """key, bases, fields of models; a field is written name: type, with ? after the name if it has a default."""
    field = lambda f: F.concat(f["name"], F.when(f["default"].isNotNull(), "?").otherwise(""), F.lit(": "), f["type_hint"])
    return models.select("key", F.array_join("base_classes", ", ").alias("bases"), F.array_join(F.transform("fields", field), ", ").alias("fields")).orderBy("key")


def viz_links(nodes: DataFrame) -> DataFrame:
    """source, target of call edges whose ends are both nodes."""
    edges = nodes.select(F.col("node_id").alias("source"), F.explode("call_children").alias("target"))
    known = nodes.select(F.col("node_id").alias("target")).distinct()
    return edges.join(known.hint("merge"), "target", "left_semi").select("source", "target")


def node_degree(nodes: DataFrame) -> DataFrame:
    degree = _ends(nodes)
    return nodes.select("node_id", degree.alias("degree"), (F.lit(8.0) + F.lit(1.5) * degree).alias("radius"))


def top_terms(df: DataFrame, field: str, most: int = 10) -> DataFrame:
    """The values of a field that occur most; equal counts by value."""
    return df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field).limit(most)


def error_hotspots(logs: DataFrame, most: int = 5) -> DataFrame:
    return top_terms(logs.where("level = 'error'"), "function", most)


def module_error_rate(logs: DataFrame) -> DataFrame:
    errors = F.sum(F.when(F.col("level") == "error", 1).otherwise(0)).cast("long")
    out = logs.where("module is not null").groupBy("module").agg(F.count("*").alias("total"), errors.alias("errors"))
    return out.withColumn("error_pct", F.round(F.lit(100.0) * F.col("errors") / F.col("total"), 2))


def filtered_counts(logs: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """name, n: how many rows each filter keeps, in one pass."""
    row = logs.groupBy().agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, c in filters.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in filters])
    return row.select(F.explode(pairs).alias("x")).select("x.name", "x.n")


def tagged(logs: DataFrame, tag: str, level: str) -> DataFrame:
    return logs.where(F.array_contains("tags", tag) & (F.col("level") == level))


def drill_down(logs: DataFrame, field: str = "function") -> DataFrame:
    """The rows of the field's most frequent value."""
    return logs.join(top_terms(logs, field, 1).select(field), field, "left_semi")


def trace(logs: DataFrame, tag: str, order: Sequence[str], most: int = 20) -> DataFrame:
    """The earliest rows that carry a tag, in order of time."""
    return logs.where(F.array_contains("tags", tag)).orderBy(*order).limit(most)
