"""From log call sites to graph nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import text as T


def first_per(df: DataFrame, key: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order. A partial aggregate, so a hot key is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in key]
    pick = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    return df.groupBy(*key).agg(pick.alias("__row")).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def last_per(df: DataFrame, key: Sequence[str], *order: Column | str) -> DataFrame:
    """The last row of each key: what overwriting in order leaves."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    return df.groupBy(*key).agg(pick.alias("__row")).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def dedup_sites(sites: DataFrame) -> DataFrame:
    """One site of each file and line: parsed ones (source_rank 0) before those of the text fallback, then the first."""
    return first_per(sites, ["file", "line"], "source_rank", "ord")


def go_line_candidates(calls: DataFrame) -> DataFrame:
    """The log call that stands for a line: the first that ends a chain, else the last of the others."""
    rank = F.struct(F.when(F.col("terminal"), 0).otherwise(1).alias("a"), F.when(F.col("terminal"), F.col("ord")).otherwise(-F.col("ord")).alias("b"))
    return first_per(calls, ["file", "line"], rank)


def node_ids(sites: DataFrame) -> DataFrame:
    """sites with node_id: the base id, and from the second site of one base id on a suffix of file and scope."""
    base = T.node_base_id(F.col("module"), F.col("class_name"), F.col("function"), F.col("message_template"))
    nth = F.row_number().over(Window.partitionBy("base_id").orderBy("ord"))
    sites = sites.withColumn("base_id", base).withColumn("nth", nth)
    later = F.concat("base_id", F.lit(":"), T.scope_suffix(F.col("file"), F.col("scope")))
    return sites.withColumn("node_id", F.when(F.col("nth") == 1, F.col("base_id")).otherwise(later)).drop("nth", "base_id")


def build_nodes(sites: DataFrame, redact: Sequence[str] = ()) -> DataFrame:
    """Nodes of deduplicated sites(ord, file, line, module, class_name, function, level, message_template, scope).

    Ids come from the text as written, redaction follows, tags come last.
    Sites that share an id overwrite each other; the last stays, in the
    place of the first.
    """
    with_ids = node_ids(sites)
    first = with_ids.groupBy("node_id").agg(F.min("ord").alias("position"))
    nodes = last_per(with_ids, ["node_id"], "ord").join(first, "node_id")
    nodes = nodes.withColumn("message_template", T.redacted(F.col("message_template"), redact))
    base = F.when(F.col("level").isin("error", "critical", "exception"), F.array(F.lit("error"))).otherwise(F.expr("cast(array() as array<string>)"))
    parents = F.when(F.col("scope").isNotNull(), F.array("scope")).otherwise(F.expr("cast(array() as array<string>)"))
    nodes = nodes.withColumn("lexical_parents", parents)
    tags = T.all_tags(base, F.col("function"), F.col("module"), F.col("lexical_parents"), F.col("message_template"), F.col("level"))
    return nodes.withColumn("semantic_tags", tags).drop("ord").withColumnRenamed("position", "ord")
