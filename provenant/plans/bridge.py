"""Graph tables derived from the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> SQL over test tables and earlier derived tables, which stand in braces.
DERIVED = {
    "sites": """
        select ord, module, class_name, function, level, message_template,
               'src/' || replace(module, '.', '/') || '.py' as file, cast(ord as int) as line, function as scope
        from (
          select p_partkey as ord, 'app.' || lower(replace(p_brand, '#', '')) as module,
                 case when p_partkey % 7 = 0 then 'Service' end as class_name,
                 case p_size % 4 when 0 then 'get_' when 1 then 'process_payment_' when 2 then 'retry_' else 'login_' end || lower(p_type) as function,
                 case p_size % 5 when 0 then 'error' when 1 then 'warning' when 2 then 'info' when 3 then 'debug' else 'critical' end as level,
                 case when p_partkey % 3 = 0 then p_name else p_name || ' {{}} took %d ms' end as message_template
          from {part}) x""",
    "logs": """
        select l_orderkey, l_linenumber, cast(l_shipdate as timestamp) as ts,
               case when l_linenumber % 2 = 1 then 'other.' || module else module end as module,
               case when l_quantity > 45 then 'nope' else function end as function,
               case l_returnflag when 'A' then 'error' when 'N' then 'info' else 'warning' end as level,
               case when ord % 3 = 0 then p_name else p_name || ' order ' || cast(l_orderkey as string) || ' took ' || cast(l_linenumber as string) || ' ms' end as message
        from {lineitem} join {part} on l_partkey = p_partkey join {sites} on p_partkey = ord""",
    "call_nodes": """
        select 'n' || cast(k as string) as node_id, 'app.m' || cast(m as string) as module,
               case when k % 5 = 0 then 'run_task_' || cast(k as string) when k % 5 = 1 then 'Svc.get_item_' || cast(g as string) else 'load_' || cast(g as string) end as function,
               'src/app/m' || cast(m as string) || case m % 3 when 0 then '.py' when 1 then '.go' else '.ts' end as file,
               k as ord
        from (select p_partkey as k, cast(floor(p_partkey / 12) as bigint) as m, cast(floor(p_partkey / 30) as bigint) as g from {part}) x""",
    "calls": """
        select distinct
               'app.m' || cast(cast(floor(a / 12) as bigint) as string) || case when l_linenumber % 3 = 0 then '.Svc' else '' end || '.' ||
               case when a % 5 = 0 then 'run_task_' || cast(a as string) when a % 5 = 1 then 'get_item_' || cast(ag as string) else 'load_' || cast(ag as string) end as caller,
               case l_linenumber % 4 when 0 then case when b % 5 = 0 then 'run_task_' || cast(b as string) when b % 5 = 1 then 'get_item_' || cast(bg as string) else 'load_' || cast(bg as string) end
                 when 1 then 'Svc.get_item_' || cast(bg as string) when 2 then 'runTask' || cast(b as string) else 'helper' end as callee
        from (select l_partkey as a, cast(floor(l_partkey / 30) as bigint) as ag, l_partkey + l_suppkey % 40 as b,
                     cast(floor((l_partkey + l_suppkey % 40) / 30) as bigint) as bg, l_linenumber from {lineitem}) x""",
    "imports": """
        select distinct 'app.m' || cast(m as string) as module,
               case l_linenumber % 4 when 0 then 'app.m' || cast(m + l_suppkey % 5 as string) when 1 then '.m' || cast(m + l_suppkey % 5 as string)
                 when 2 then 'vendor.app.m' || cast(m + l_suppkey % 20 as string) else 'os.path' end as import
        from (select cast(floor(l_partkey / 12) as bigint) as m, l_suppkey, l_linenumber from {lineitem}) x""",
    "defined": """
        select distinct 'app.brand' || cast(1 + s_suppkey % 25 as string) || ':' || prefix || lower(p_type) as key
        from {supplier} cross join (select distinct p_type from {part}) t
        cross join (select 'get_' as prefix union all select 'login_' union all select 'save_') p""",
    "models": """
        select 'app.' || lower(replace(p_brand, '#', '')) || '.' || p_type as key, p_partkey as ord, p_brand as name, p_size as n, p_name as hint
        from {part}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or one derived from it."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name]
    used = {n: table(spark, sf_dir, n) for n in (*TABLES, *DERIVED) if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


def duck_with(*names: str) -> str:
    """A WITH clause that defines derived tables, and what they need, for DuckDB."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in DERIVED:
            if "{" + other + "}" in DERIVED[name]:
                add(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    plain = {n: n for n in (*TABLES, *DERIVED)}
    return "with " + ",\n".join(f"{n} as ({DERIVED[n].format(**plain)})" for n in wanted)
