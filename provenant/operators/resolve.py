"""Log events to graph nodes: exact, relaxed and template matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as T

#: Lengths by which templates are looked up: by the longest that their literal prefix has.
PREFIXES = (32, 16, 8, 4, 0)


def exact_index(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("module", "function", F.col("message_template").alias("message")).agg(F.max_by("node_id", "ord").alias("exact_id"))


def relaxed_index(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("function", F.col("message_template").alias("message")).agg(F.max_by("node_id", "ord").alias("relaxed_id"))


def template_index(nodes: DataFrame) -> DataFrame:
    """function, size, prefix, pattern, first ord and node_id of each template pattern; equal patterns of a function once."""
    rows = nodes.select("function", "ord", "node_id", T.template_pattern(F.col("message_template")).alias("pattern"), T.literal_prefix(F.col("message_template")).alias("head"))
    rows = rows.where("pattern is not null")
    size = F.coalesce(*[F.when(F.length("head") >= n, F.lit(n)) for n in PREFIXES])
    rows = rows.withColumn("size", size).withColumn("prefix", F.expr("substring(head, 1, size)"))
    return rows.groupBy("function", "size", "prefix", "pattern").agg(F.min_by("node_id", "ord").alias("node_id"), F.min("ord").alias("ord"))


def _probes(messages: DataFrame) -> DataFrame:
    """messages with each prefix under which a template of theirs may stand."""
    probes = messages.withColumn("size", F.explode(F.array(*[F.lit(n) for n in PREFIXES]))).where(F.length("message") >= F.col("size"))
    return probes.withColumn("prefix", F.expr("substring(message, 1, size)"))


def resolve(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """events(module, function, message, ...) with node_id and tier (1, 2, 3 or null).

    Tier 1 is module, function and message, tier 2 function and message; of
    equal nodes the last wins. Tier 3 takes the first template of the
    function that fits; it sees each open (function, message) once and looks
    templates up by the longest literal prefix they share with the message,
    so most patterns are never tried.
    """
    looked = events.join(exact_index(nodes), ["module", "function", "message"], "left").join(relaxed_index(nodes), ["function", "message"], "left")
    open_ = looked.where("exact_id is null and relaxed_id is null and function is not null and message is not null").select("function", "message").distinct()
    hits = _probes(open_).join(template_index(nodes), ["function", "size", "prefix"]).where(F.expr("message rlike pattern"))
    fitting = hits.groupBy("function", "message").agg(F.min_by("node_id", "ord").alias("template_id"))
    out = looked.join(fitting, ["function", "message"], "left")
    tier = F.when(F.col("exact_id").isNotNull(), 1).when(F.col("relaxed_id").isNotNull(), 2).when(F.col("template_id").isNotNull(), 3)
    found = F.coalesce("exact_id", "relaxed_id", "template_id")
    return out.select(*[F.col(c) for c in events.columns], found.alias("node_id"), tier.alias("tier"))


def unique_templates(nodes: DataFrame) -> DataFrame:
    """message, node_id of templates that one node alone has."""
    return nodes.groupBy(F.col("message_template").alias("message")).agg(F.count("*").alias("n"), F.min("node_id").alias("unique_id")).where("n = 1").drop("n")


def template_collisions(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("message_template").agg(F.count("*").alias("n_nodes")).withColumn("collides", F.col("n_nodes") > 1)


def resolve_go(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """events(go_function, message, ...) with node_id and tier: a template unique in the graph, else the longest of the function that begins the message.

    Of equally long templates the node with the smallest id is taken.
    """
    named = events.withColumn("__fn", T.go_function_name(F.col("go_function")))
    looked = named.join(unique_templates(nodes), "message", "left")
    open_ = looked.where("unique_id is null and message is not null").select("__fn", "message").distinct()
    heads = nodes.where("function is not null and message_template is not null").groupBy(F.col("function").alias("__fn"), F.col("message_template").alias("head")).agg(F.min("node_id").alias("node_id"))
    # met by the longest prefix that a template has, so most templates of a function are never compared
    size = F.coalesce(*[F.when(F.length("head") >= n, F.lit(n)) for n in PREFIXES])
    heads = heads.withColumn("size", size).withColumn("prefix", F.expr("substring(head, 1, size)"))
    hits = _probes(open_).join(heads, ["__fn", "size", "prefix"]).where(F.startswith("message", "head"))
    best = hits.groupBy("__fn", "message").agg(F.max_by("node_id", F.length("head")).alias("prefix_id"))
    out = looked.join(best, ["__fn", "message"], "left")
    tier = F.when(F.col("unique_id").isNotNull(), 1).when(F.col("prefix_id").isNotNull(), 2)
    return out.select(*[F.col(c) for c in events.columns], F.coalesce("unique_id", "prefix_id").alias("node_id"), tier.alias("tier"))
