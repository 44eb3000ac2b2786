"""Call edges between instrumented functions.

nodes(node_id, module, function, file, ord), calls(caller, callee) distinct,
imports(module, import). A qualified name is module.function.

Spark takes the ends and names derived here for as small as the columns that
they come from, and would broadcast, through the driver, tables that outgrow
it with the graph; so all joins are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as T
from provenant.operators.stored import Stored


def qualified(module: Column, function: Column) -> Column:
    return F.when(F.coalesce(module, F.lit("")) == "", function).otherwise(F.concat(module, F.lit("."), function))


def _merge(df: DataFrame) -> DataFrame:
    return df.hint("merge")


def _pairs(calls: DataFrame) -> DataFrame:
    return calls.select("caller", "callee").distinct()


def functions_of(nodes: DataFrame) -> DataFrame:
    """qname, tail, plain, bare, ext, n_nodes of each instrumented function; ext is its first node's."""
    q = nodes.withColumn("qname", qualified(F.col("module"), F.col("function"))).withColumn("bare", T.bare_name(F.col("function")))
    out = q.groupBy("qname", "bare").agg(F.count("*").alias("n_nodes"), T.suffix_of(F.min_by("file", "ord")).alias("ext"))
    return out.withColumn("tail", T.bare_name(F.col("qname"))).withColumn("plain", T.plain_name(F.col("tail")))


def caller_modules(callers: DataFrame, nodes: DataFrame) -> DataFrame:
    """caller, caller_module: the longest dotted prefix that is a module of the graph, else all before the last dot, else empty.

    Prefixes are generated, so the known modules are met by equality.
    """
    known = nodes.where("module <> ''").select("module").distinct()
    names = callers.select("caller").distinct()
    parts = F.split("caller", r"\.")
    prefixes = names.select("caller", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("module"))
    best = prefixes.join(_merge(known), "module").groupBy("caller").agg(F.max_by("module", F.length("module")).alias("known"))
    before = F.regexp_extract("caller", r"(?s)^(.*)\.[^.]*$", 1)
    return names.join(_merge(best), "caller", "left").select("caller", F.coalesce("known", before).alias("caller_module"))


def _with_names(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(_merge(caller_modules(pairs, nodes)), "caller")


def _ends(functions: DataFrame) -> DataFrame:
    """qname with every dotted end of it under every module that it may lie in, so that module and callee are met by equality."""
    parts = F.split("qname", r"\.")
    each = F.sequence(F.lit(1), F.size(parts))
    ends = F.transform(each, lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    heads = F.transform(F.slice(each, 1, F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return functions.select("qname", ends.alias("ends"), F.explode(heads).alias("head")).select("qname", "head", F.explode("ends").alias("end"))


def local_targets(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """caller, callee, target in the caller's own module."""
    return _local(_pairs(calls), nodes)


def _local(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = _with_names(pairs, nodes).where("caller_module <> ''")
    hit = rows.join(_merge(_ends(functions_of(nodes))), (F.col("caller_module") == F.col("head")) & (F.col("callee") == F.col("end")))
    return hit.select("caller", "callee", F.col("qname").alias("target")).distinct()


def imported_targets(calls: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """caller, callee, target in a module that the caller's module imports."""
    return _imported(_pairs(calls), nodes, imports)


def _imported(pairs: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    rows = _with_names(pairs, nodes).where("caller_module <> ''")
    there = imports.select(F.col("module").alias("caller_module"), T.resolved_import(F.col("module"), F.col("import")).alias("from_module")).distinct()
    hit = rows.join(_merge(there), "caller_module").join(_merge(_ends(functions_of(nodes))), (F.col("from_module") == F.col("head")) & (F.col("callee") == F.col("end")))
    return hit.select("caller", "callee", F.col("qname").alias("target")).distinct()


def global_candidates(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """caller, callee, n, target: nodes of that bare name, and its only function if the count is one.

    Counted are nodes, so a function with two log sites is as ambiguous as two
    functions. A dotted callee is looked up by its last part if need be.
    """
    return _global(_pairs(calls), nodes)


def _global(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(_merge(_by_name(pairs, nodes)), "callee", "left").select("caller", "callee", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "target")


def _by_name(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """callee, n, target of each callee; who calls it does not matter here."""
    bare = functions_of(nodes).groupBy("bare").agg(F.sum("n_nodes").alias("n"), F.min("qname").alias("target"))
    rows = pairs.select("callee").distinct().withColumn("end", T.bare_name(F.col("callee")))
    whole = bare.select(F.col("bare").alias("callee"), F.col("n").alias("n1"), F.col("target").alias("t1"))
    last = bare.select(F.col("bare").alias("end"), F.col("n").alias("n2"), F.col("target").alias("t2"))
    out = rows.join(_merge(whole), "callee", "left").join(_merge(last), "end", "left")
    return out.select("callee", F.coalesce("n1", "n2", F.lit(0)).cast("long").alias("n"), F.coalesce("t1", "t2").alias("target"))


def unique_targets(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    return global_candidates(calls, nodes).where("n = 1").select("caller", "callee", "target")


def cross_language_targets(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """caller, callee, target of the same plain name in a file of another kind; the caller's kind is its first node's."""
    return _cross_language(_pairs(calls), nodes)


def _cross_language(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    kinds = nodes.select(F.concat("module", F.lit("."), "function").alias("caller"), "file", "ord").union(nodes.select("function", "file", "ord"))
    kinds = kinds.groupBy("caller").agg(T.suffix_of(F.min_by("file", "ord")).alias("caller_ext"))
    rows = pairs.join(_merge(kinds), "caller", "left").withColumn("plain", T.plain_name(F.col("callee")))
    there = functions_of(nodes).select("qname", "plain", "ext")
    return rows.join(_merge(there), "plain").where("ext <> coalesce(caller_ext, '')").select("caller", "callee", F.col("qname").alias("target")).distinct()


def call_targets(calls: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """caller, callee, target, step: local, else imported, else globally unique, else of another language.

    A name that is ambiguous in the graph ends at step 3 without a target.
    Builds pass no imports: they come later than the edges.
    """
    return _targets(_pairs(calls), nodes, imports)


def _targets(pairs: DataFrame, nodes: DataFrame, imports: DataFrame | None) -> DataFrame:
    local = _local(pairs, nodes).withColumn("step", F.lit(1))
    # most names are ambiguous or nobody's: only calls that steps 3 and 4 may lead somewhere are carried there
    plain = functions_of(nodes).select("plain").distinct()
    names = _by_name(pairs, nodes).where("n <= 1").withColumn("plain", T.plain_name(F.col("callee"))).join(_merge(plain.withColumn("met", F.lit(True))), "plain", "left")
    open_ = pairs.join(_merge(names.where("n = 1 or met").select("callee", "n", "target")), "callee").join(_merge(local), ["caller", "callee"], "left_anti")
    parts = [local]
    if imports is not None:
        left = pairs.join(_merge(local), ["caller", "callee"], "left_anti")
        near = _imported(left, nodes, imports).withColumn("step", F.lit(2))
        parts.append(near)
        open_ = open_.join(_merge(near), ["caller", "callee"], "left_anti")
    parts.append(open_.where("n = 1").select("caller", "callee", "target", F.lit(3).alias("step")))
    parts.append(_cross_language(open_.where("n = 0").select("caller", "callee"), nodes).withColumn("step", F.lit(4)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def caller_bridge(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """qname, caller: the callers (module.Class.function) that a graph function (module.function) may be.

    The bare names are equal, and the caller's module part begins or ends with
    the graph's module, / and . alike; there is no boundary at that place.
    """
    graph = nodes.select(qualified(F.col("module"), F.col("function")).alias("qname"), "module", T.bare_name(F.col("function")).alias("bare")).distinct()
    last = F.when(F.contains("caller", F.lit(".")), F.substring_index("caller", ".", -1)).otherwise(F.substring_index("caller", "/", -1))
    callers = calls.select("caller").distinct().withColumn("bare", last)
    rows = graph.join(_merge(callers), "bare")
    head = F.expr("case when contains(caller, concat('.', bare)) then substring(caller, 1, length(caller) - length(bare) - 1) when contains(caller, '/') then regexp_extract(caller, '(?s)^(.*)/[^/]*$', 1) end")
    rows = rows.withColumn("head", F.replace(head, F.lit("/"), F.lit("."))).withColumn("mod", F.replace(F.coalesce("module", F.lit("")), F.lit("/"), F.lit(".")))
    near = (F.col("mod") != "") & (F.startswith("head", "mod") | F.endswith("head", "mod") | F.startswith("caller", "module"))
    return rows.where((F.col("caller") == F.col("qname")) | (F.col("head").isNotNull() & (F.col("head") != "") & near)).select("qname", "caller").distinct()


def call_edges(calls: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """node_id with call_parents, call_children, call_parent_names, call_child_names, sorted and distinct.

    Parents may be callers without log sites (then by name only); a caller
    known only by its class is bridged to the first of its graph functions.
    Parents leave out the caller itself by its own name, children by the
    graph's, so a recursive method is its own parent, not its own child.
    The edges are written to the shared folder and read from there.
    """
    store, keep = Stored(nodes.sparkSession), Stored(nodes.sparkSession)
    try:
        return keep(_edges(calls, nodes, imports, store), "call-edges")
    finally:
        store.drop()


def edge_counts(calls: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """node_id with n_parents, n_children: how many call_parents and call_children call_edges lists, without the lists.

    An id belongs to one qualified name, so ids are counted by name, once. The
    counts are written to the shared folder and read from there.
    """
    store, keep = Stored(nodes.sparkSession), Stored(nodes.sparkSession)
    try:
        return keep(_counts(calls, nodes, imports, store), "call-edges-counted")
    finally:
        store.drop()


def _sides(calls: DataFrame, nodes: DataFrame, imports: DataFrame | None, store: Stored) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes by qname; target, caller, from_q: who calls a function, and its name in the graph; qname, target: whom it calls."""
    calls = store(_pairs(calls), "call-pairs")
    nodes = store(nodes.select("node_id", "module", "function", "file", "ord"), "call-nodes")
    targets = store(_targets(calls, nodes, imports).select("caller", "target").distinct(), "call-targets")
    q = nodes.select("node_id", qualified(F.col("module"), F.col("function")).alias("qname"), "ord")
    bridge = store(caller_bridge(calls, nodes), "call-bridge")
    place = q.groupBy("qname").agg(F.min("ord").alias("place"))
    first = bridge.join(_merge(place), "qname").groupBy("caller").agg(F.min_by("qname", "place").alias("bridged"))
    up = targets.where("target <> caller")
    own = q.select("qname").distinct().withColumn("direct", F.col("qname")).withColumnRenamed("qname", "caller")
    via = up.join(_merge(own), "caller", "left").join(_merge(first), "caller", "left").withColumn("from_q", F.coalesce("direct", "bridged"))
    callers = bridge.union(q.select("qname", F.col("qname").alias("caller"))).distinct()
    down = callers.join(_merge(targets), "caller").where("target <> qname").select("qname", "target").distinct()
    return q, via, down


def _edges(calls: DataFrame, nodes: DataFrame, imports: DataFrame | None, store: Stored) -> DataFrame:
    q, via, down = _sides(calls, nodes, imports, store)
    parents = via.join(_merge(q.select(F.col("qname").alias("from_q"), F.col("node_id").alias("parent"))), "from_q", "left")
    parents = parents.groupBy("target").agg(F.array_sort(F.collect_set("parent")).alias("call_parents"), F.array_sort(F.collect_set("caller")).alias("call_parent_names"))
    children = down.join(_merge(q.select(F.col("qname").alias("target"), F.col("node_id").alias("child"))), "target")
    children = children.groupBy("qname").agg(F.array_sort(F.collect_set("child")).alias("call_children"), F.array_sort(F.collect_set("target")).alias("call_child_names"))
    empty = F.expr("cast(array() as array<string>)")
    out = q.join(_merge(parents), F.col("qname") == F.col("target"), "left").join(_merge(children), "qname", "left")
    lists = ("call_parents", "call_children", "call_parent_names", "call_child_names")
    return out.select("node_id", *[F.coalesce(c, empty).alias(c) for c in lists])


def _counts(calls: DataFrame, nodes: DataFrame, imports: DataFrame | None, store: Stored) -> DataFrame:
    q, via, down = _sides(calls, nodes, imports, store)
    ids = store(q.select("qname", "node_id").distinct().groupBy("qname").agg(F.count("node_id").alias("n")), "call-ids")
    # a caller known by its class and the graph's own name for it are one parent
    parents = via.where("from_q is not null").select("target", "from_q").distinct().join(_merge(ids.withColumnRenamed("qname", "from_q")), "from_q")
    parents = parents.groupBy("target").agg(F.sum("n").alias("n_parents"))
    children = down.join(_merge(ids.withColumnRenamed("qname", "target")), "target").groupBy("qname").agg(F.sum("n").alias("n_children"))
    out = q.join(_merge(parents), F.col("qname") == F.col("target"), "left").join(_merge(children), "qname", "left")
    return out.select("node_id", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("n_parents", "n_children")])
