"""DuckDB SQL for the queries of this package, written apart from the operators."""

from __future__ import annotations

from provenant.functions import constants as C
from provenant.plans import corpus
from provenant.plans.bridge import duck_with

NODES = """
  based as (select *, 'll:' || substr(sha256(module || ':' || coalesce(class_name, '') || '.' || function || ':' || message_template), 1, 12) as base from sites),
  numbered as (select *, row_number() over (partition by base order by ord) as nth from based),
  named as (select *, case when nth = 1 then base else base || ':' || substr(sha256(file || ':' || coalesce(scope, 'None')), 1, 4) end as node_id from numbered),
  kept as (select node_id, max(ord) as last, min(ord) as first from named group by node_id),
  nodes as (select n.node_id, n.module, n.class_name, n.function, n.level, n.message_template, n.file, n.line, n.scope, k.first as ord
            from named n join kept k on n.node_id = k.node_id and n.ord = k.last)"""


def _with(*derived: str) -> str:
    return duck_with(*derived) + "\n"


def _with_nodes(*derived: str) -> str:
    return duck_with("sites", *derived) + ",\n" + NODES + "\n"


def _like(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _tag_sql(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when {hit} then '{tag}' end" for tag, hit in rules.items()) + "], lambda x: x is not null)"


FUNCTION_TAGS = _tag_sql({t: _like("function", w) for t, w in C.FUNCTION_TAGS.items()})
MODULE_TAGS = _tag_sql({t: _like("module", w) for t, w in C.MODULE_TAGS.items()})
LEXICAL_TAGS = _tag_sql({t: _like("scope", w) for t, w in C.LEXICAL_TAGS.items()})
MESSAGE_TAGS = _tag_sql({t: f"regexp_matches(message_template, '(?i)({p})')" for t, p in C.MESSAGE_TAGS.items()})
LEVEL_TAGS = _tag_sql({"error": "lower(level) in ('error', 'critical', 'exception', 'fatal')", "debug": "lower(level) = 'debug'", "warning": "lower(level) = 'warning'"})
JOINED = "array_to_string(list_sort(list_distinct({})), ',')"
ALL_TAGS = JOINED.format(f"list_concat({FUNCTION_TAGS}, {MODULE_TAGS}, {LEXICAL_TAGS}, {MESSAGE_TAGS}, {LEVEL_TAGS})")

WILD = "regexp_replace(regexp_replace(message_template, '\\{[^}]*\\}', '.*?', 'g'), '%[-+0 #]*[0-9]*\\.?[0-9]*[diouxXeEfFgGcrsab%]', '.*?', 'g')"
HAS_FIELD = "(regexp_matches(message_template, '\\{[^}]*\\}') or regexp_matches(message_template, '%[-+0 #]*[0-9]*\\.?[0-9]*[diouxXeEfFgGcrsab%]'))"
PATTERN = f"'(?s)^' || array_to_string(list_transform(string_split({WILD}, '.*?'), lambda p: regexp_escape(p)), '.*?') || '$'"

RESOLVED = f"""
  exact as (select module, function, message_template as message, arg_max(node_id, ord) as exact_id from nodes group by all),
  relaxed as (select function, message_template as message, arg_max(node_id, ord) as relaxed_id from nodes group by all),
  looked as (select l.*, exact_id, relaxed_id from logs l left join exact using (module, function, message) left join relaxed using (function, message)),
  open_ as (select distinct function, message from looked where exact_id is null and relaxed_id is null),
  patterns as (select function, pattern, arg_min(node_id, ord) as node_id, min(ord) as ord from (select *, {PATTERN} as pattern from nodes where {HAS_FIELD}) x group by all),
  fitting as (select o.function, o.message, arg_min(p.node_id, p.ord) as template_id from open_ o join patterns p on o.function = p.function and regexp_matches(o.message, p.pattern) group by all),
  resolved as (select k.l_orderkey, k.l_linenumber, k.ts, k.module, k.function, k.level, k.message, coalesce(exact_id, relaxed_id, template_id) as node_id,
                      case when exact_id is not null then 1 when relaxed_id is not null then 2 when template_id is not null then 3 end as tier
               from looked k left join fitting f on k.function = f.function and k.message = f.message)"""


def _resolved() -> str:
    return _with_nodes("logs").rstrip() + "," + RESOLVED + "\n"


TAGGED_NODES = f"tagged as (select *, {ALL_TAGS} as tags from nodes)"

FUNCTIONS = """
  fns as (select module || '.' || function as qname, string_split(function, '.')[-1] as bare, count(*) as n_nodes, '.' || string_split(arg_min(file, ord), '.')[-1] as ext from call_nodes group by all),
  known as (select distinct module from call_nodes),
  cm as (select caller, coalesce((select arg_max(module, length(module)) from known where starts_with(caller || '.', module || '.')), regexp_extract(caller, '^(.*)\\.[^.]*$', 1)) as caller_module
         from (select distinct caller from calls) x),
  pairs as (select c.caller, c.callee, cm.caller_module from calls c join cm using (caller)),
  local_ as (select distinct caller, callee, qname as target from pairs join fns on starts_with(qname, caller_module || '.') and (ends_with(qname, '.' || callee) or string_split(qname, '.')[-1] = callee) where caller_module <> ''),
  resolved_imports as (select distinct module, case when not starts_with(import, '.') then import else 'app' || '.' || substr(import, 2) end as from_module from imports),
  imported_ as (select distinct caller, callee, qname as target from pairs join resolved_imports r on r.module = caller_module join fns on starts_with(qname, from_module || '.') and (ends_with(qname, '.' || callee) or string_split(qname, '.')[-1] = callee)),
  bare_counts as (select bare, sum(n_nodes) as n, min(qname) as target from fns group by bare),
  global_ as (select c.caller, c.callee, cast(coalesce(a.n, b.n, 0) as bigint) as n, coalesce(a.target, b.target) as target
              from calls c left join bare_counts a on a.bare = c.callee left join bare_counts b on b.bare = string_split(c.callee, '.')[-1]),
  kinds as (select caller, '.' || string_split(arg_min(file, ord), '.')[-1] as ext from (select module || '.' || function as caller, file, ord from call_nodes union all select function, file, ord from call_nodes) x group by caller),
  cross_ as (select distinct c.caller, c.callee, f.qname as target from calls c left join kinds k using (caller)
             join fns f on lower(replace(replace(string_split(c.callee, '.')[-1], '_', ''), '-', '')) = lower(replace(replace(string_split(f.qname, '.')[-1], '_', ''), '-', '')) and f.ext <> coalesce(k.ext, '')),
  targets as (
    select caller, callee, target, 1 as step from local_
    union all
    select g.caller, g.callee, g.target, 3 from global_ g anti join local_ l on g.caller = l.caller and g.callee = l.callee where g.n = 1
    union all
    select x.caller, x.callee, x.target, 4 from cross_ x anti join local_ l on x.caller = l.caller and x.callee = l.callee join global_ g on g.caller = x.caller and g.callee = x.callee where g.n = 0),
  heads as (select distinct n.module || '.' || n.function as qname, c.caller, n.module, string_split(n.function, '.')[-1] as bare, substr(c.caller, 1, length(c.caller) - length(string_split(n.function, '.')[-1]) - 1) as head
            from call_nodes n join (select distinct caller from calls) c on string_split(c.caller, '.')[-1] = string_split(n.function, '.')[-1]),
  bridge as (select distinct qname, caller from heads where caller = qname or starts_with(head, module) or ends_with(head, module))"""

EDGES = """
  own as (select node_id, module || '.' || function as qname, ord from call_nodes),
  place as (select qname, min(ord) as place from own group by qname),
  first_of as (select caller, arg_min(qname, place) as bridged from bridge join place using (qname) group by caller),
  up as (select distinct caller, target from targets where target <> caller),
  via as (select u.caller, u.target, coalesce(d.qname, f.bridged) as from_q from up u left join (select distinct qname from own) d on d.qname = u.caller left join first_of f on f.caller = u.caller),
  parents as (select v.target, array_to_string(list_sort(list(distinct o.node_id)), ',') as call_parents, array_to_string(list_sort(list(distinct v.caller)), ',') as call_parent_names from via v left join own o on o.qname = v.from_q group by v.target),
  callers as (select qname, caller from bridge union select qname, qname from own),
  down as (select distinct k.qname, t.target from callers k join targets t on t.caller = k.caller where t.target <> k.qname),
  children as (select d.qname, array_to_string(list_sort(list(distinct o.node_id)), ',') as call_children, array_to_string(list_sort(list(distinct d.target)), ',') as call_child_names from down d join own o on o.qname = d.target group by d.qname),
  edges as (select o.node_id, coalesce(call_parents, '') as call_parents, coalesce(call_children, '') as call_children, coalesce(call_parent_names, '') as call_parent_names, coalesce(call_child_names, '') as call_child_names
            from own o left join parents p on p.target = o.qname left join children c on c.qname = o.qname)"""


def _calls() -> str:
    return _with("call_nodes", "calls", "imports").rstrip() + "," + FUNCTIONS + "\n"


def _edges() -> str:
    return _calls().rstrip() + "," + EDGES + "\n"


OLD_NEW = f"""
  old_ as (select node_id, file, line, message_template, level from nodes where ord % 11 <> 0),
  new_ as (select node_id, file, case when ord % 13 = 0 then line + 5 else line end as line, message_template, case when ord % 17 = 0 then 'fatal' else level end as level from nodes where ord % 7 <> 0),
  changes as (
    select coalesce(o.node_id, n.node_id) as node_id,
           case when o.node_id is null then 'added' when n.node_id is null then 'removed' when o.file <> n.file or o.line <> n.line then 'moved' when o.level <> n.level then 'modified' end as change_type,
           o.file as old_file, o.line as old_line, n.file as new_file, n.line as new_line,
           case when o.node_id is not null and n.node_id is not null and o.file = n.file and o.line = n.line and o.level <> n.level then 'level' end as changed
    from old_ o full outer join new_ n on o.node_id = n.node_id)"""


def _values(columns: str, rows: tuple) -> str:
    """A query whose rows are written out."""

    def literal(x: object) -> str:
        return "cast(null as varchar)" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


def _source_sql() -> dict[str, str]:
    out = {}
    for language, module in corpus.MODULES.items():
        out |= {
            f"{language}_sites": _values("line, level, function, class_name, message_template", tuple((a, b, c, d, e) for a, b, c, d, e in corpus.SITES[language])),
            f"{language}_signatures": _values("line, flags, parameters, result", corpus.CONTEXTS[language]),
            f"{language}_models": _values("name, line, bases, fields", corpus.MODELS[language]),
            f"{language}_imports": _values("import", tuple((x,) for x in corpus.IMPORTS[language])),
            f"{language}_functions": _values("function", tuple((x,) for x in corpus.FUNCTIONS[language])),
            f"{language}_calls": _values("caller, callee", tuple((f"{module}.{a}", b) for a, b in corpus.CALLS[language])),
        }
    out["regex_fallback_sites"] = _values("line, level, message_template", corpus.TEXT_SITES)
    out["module_paths"] = _values("path, module", tuple((path, corpus.MODULES[language]) for path, language, _ in corpus.FILES))
    path = {language: p for p, language, _ in corpus.FILES}
    out["source_nodes"] = _values("file, line, module, function, level, message_template", tuple((path[lang], line, corpus.MODULES[lang], fn, level, text) for lang, rows in corpus.SITES.items() for line, level, fn, _, text in rows))
    return out


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL."""
    sql = {
        "error_rate_by_origin": _resolved() + """select n.module, count(*) as total, sum(case when r.level = 'error' then 1 else 0 end)::bigint as errors,
            round(cast(100 as double) * sum(case when r.level = 'error' then 1 else 0 end) / count(*), 2) as error_pct from resolved r join nodes n using (node_id) group by n.module""",
        "node_ids": _with_nodes() + "select node_id, ord, module, function, message_template, line from nodes",
        "redact_messages": """select doc_id, case when contains(lower(text), 'token') or contains(lower(text), 'mail3') then '[REDACTED]' else text end as message from documents""",
        "tags_function": _with("sites") + f"select ord, {JOINED.format(FUNCTION_TAGS)} as tags from sites",
        "tags_module": _with("sites") + f"select ord, {JOINED.format(MODULE_TAGS)} as tags from sites",
        "tags_lexical": _with("sites") + f"select ord, {JOINED.format(LEXICAL_TAGS)} as tags from sites",
        "tags_message": f"select conv_id, turn, {JOINED.format(MESSAGE_TAGS)} as tags from (select conv_id, turn, text as message_template from conversations) x",
        "tags_level": _with("sites") + f"select ord, {JOINED.format(LEVEL_TAGS)} as tags from sites",
        "tags_all": _with_nodes() + f"select node_id, {ALL_TAGS} as tags from nodes",
        "template_heads": _with_nodes() + f"select node_id, string_split({WILD}, '.*?')[1] as head, {HAS_FIELD} as has_field from nodes",
        "resolve_exact": _resolved() + "select l_orderkey, l_linenumber, message, node_id from resolved where tier = 1",
        "resolve_relaxed": _resolved() + "select l_orderkey, l_linenumber, message, node_id from resolved where tier = 2",
        "resolve_template": _resolved() + "select l_orderkey, l_linenumber, message, node_id from resolved where tier = 3",
        "resolve_cascade": _resolved() + "select l_orderkey, l_linenumber, message, node_id, cast(tier as int) as tier from resolved",
        "resolve_go": _with_nodes("logs").rstrip() + """,
            uniq as (select message_template as message, min(node_id) as unique_id from nodes group by all having count(*) = 1),
            best as (select l.function, l.message, arg_max(n.node_id, length(n.message_template)) as prefix_id
                     from (select distinct function, message from logs) l join (select function, message_template, min(node_id) as node_id from nodes group by all) n on n.function = l.function and starts_with(l.message, n.message_template) group by all)
            select l.l_orderkey, l.l_linenumber, l.message, coalesce(unique_id, prefix_id) as node_id, cast(case when unique_id is not null then 1 when prefix_id is not null then 2 end as int) as tier
            from logs l left join uniq on uniq.message = l.message left join best b on b.function = l.function and b.message = l.message""",
        "template_collisions": _with_nodes() + "select message_template, count(*) as n_nodes, count(*) > 1 as collides from nodes group by all",
        "enrich_logs": _resolved().rstrip() + f""", {TAGGED_NODES}
            select r.l_orderkey, r.l_linenumber, r.message, r.node_id, t.module as node_module, t.function as node_function, t.file, t.line, t.tags from resolved r left join tagged t using (node_id)""",
        "enrich_profiles": _resolved().rstrip() + f""", {TAGGED_NODES}
            select r.l_orderkey, r.l_linenumber, r.message, t.scope as logger_traversal, t.tags as handler_tags, t.line as processor_line, cast(null as varchar) as processor_parents from resolved r left join tagged t using (node_id)""",
        "rename_then_enrich": _with_nodes() + """select e.event_id, i.node_id, n.module from events e
            left join (select event_id, case when event_id % 3 = 0 then 'll:none' when event_id % 3 = 1 then (select min(node_id) from nodes) end as node_id from events) i using (event_id) left join nodes n on n.node_id = i.node_id""",
        "caller_module": _calls() + "select caller, caller_module from cm",
        "call_targets_local": _calls() + "select * from local_",
        "call_targets_imported": _calls() + "select * from imported_",
        "call_targets_unique": _calls() + "select caller, callee, target from global_ where n = 1",
        "call_targets_cross_language": _calls() + "select * from cross_",
        "call_targets": _calls() + "select caller, callee, target, cast(step as int) as step from targets",
        "caller_bridge": _calls() + "select * from bridge",
        "call_edges": _edges() + "select * from edges",
        "imports_internal": _with("imports") + """, mods as (select distinct module as internal from imports),
            names as (select distinct module, case when starts_with(import, '.') then 'app.' || substr(import, 2) else import end as name from imports),
            found as (select n.module, n.name, coalesce(max(case when internal = name then internal end), min(internal)) as internal from names n
                      join mods m on internal = name or ends_with(internal, '/' || name) or ends_with(internal, '.' || name) or ends_with(name, '/' || internal) or ends_with(name, '.' || internal) group by n.module, n.name)
            select distinct module, internal as import from found where internal <> module""",
        "imports_relative": _with("imports") + "select module, import, 'app.' || substr(import, 2) as resolved from imports where starts_with(import, '.')",
        "coverage_metrics": _with_nodes("defined") + """, have as (select distinct module || ':' || function as key from nodes)
            select count(*) as total_functions, count(h.key) as instrumented_functions, round(cast(100 as double) * count(h.key) / greatest(count(*), 1), 2) as coverage_pct from defined d left join have h using (key)""",
        "coverage_missing_top20": _with_nodes("defined") + "select key from defined where key not in (select module || ':' || function from nodes) order by key limit 20",
        "graph_diff": _with_nodes().rstrip() + "," + OLD_NEW + " select * from changes where change_type is not null",
        "graph_diff_summary": _with_nodes().rstrip() + "," + OLD_NEW + " select " + ", ".join(f"count(*) filter (change_type = '{c}') as {c}" for c in ("added", "removed", "moved", "modified")) + ", count(change_type) as total from changes",
        "lint_untracked": _with_nodes() + "select distinct file, line from sites where line % 5 <> 0 and (file, line) not in (select (file, line) from nodes where ord % 3 <> 0)",
        "lint_stale": _with_nodes() + "select file, line, arg_min(node_id, ord) as node_id from nodes where ord % 3 <> 0 and (file, line) not in (select (file, line) from sites where line % 5 <> 0) group by all",
        "graph_overview": _with_nodes() + "select count(*) as n_nodes, count(distinct module) as n_modules, count(distinct function) as n_functions, count(distinct file) as n_files from nodes",
        "tag_histogram": _with_nodes().rstrip() + f", {TAGGED_NODES} select tag, count(*) as n from (select unnest(string_split(tags, ',')) as tag from tagged where tags <> '') x group by tag",
        "level_histogram": _with_nodes() + "select level, count(*) as n from nodes group by level",
        "edge_totals": _edges() + """, c as (select case when call_parents = '' then 0 else len(string_split(call_parents, ',')) end + case when call_children = '' then 0 else len(string_split(call_children, ',')) end as ends from edges)
            select cast(sum(ends) // 2 as bigint) as half_edges, cast(sum(ends) as bigint) as all_edges, round(cast(100 as double) * sum(case when ends > 0 then 1 else 0 end) / greatest(count(*), 1), 2) as edge_coverage_pct from c""",
        "build_summary": _with_nodes().rstrip() + f", {TAGGED_NODES} select count(*) as n_nodes, cast(sum(case when tags = '' then 0 else len(string_split(tags, ',')) end) as bigint) as n_tags, count(distinct module) as n_modules from tagged",
        "module_tree": _with_nodes() + "select module, function, array_to_string(list(cast(line as varchar) || ':' || node_id order by line, node_id), ',') as nodes from nodes group by all",
        "flat_listing": _with_nodes() + "select file, line, file || ':' || cast(line as varchar) as place, level, function, case when length(message_template) > 60 then substr(message_template, 1, 60) || '...' else message_template end as message, node_id from nodes",
        "find_nodes": _with_nodes() + "select node_id, module, function, level, case when length(message_template) > 50 then substr(message_template, 1, 50) || '...' else message_template end as message from nodes where contains(lower(message_template), 'bolt') or contains(lower(function), 'bolt') or contains(lower(module), 'bolt')",
        "models_listing": _with("models") + """, last as (select key, arg_max(name, ord) as name, arg_max(n, ord) as n, arg_max(hint, ord) as hint from models group by key)
            select key, 'Base' as bases, 'id: int, ' || name || '?: ' || hint || '[' || cast(n as varchar) || ']' as fields from last""",
        "viz_links": _edges() + ", l as (select node_id as source, unnest(string_split(call_children, ',')) as target from edges where call_children <> '') select source, target from l where target in (select node_id from edges)",
        "node_degree": _edges() + ", c as (select node_id, case when call_parents = '' then 0 else len(string_split(call_parents, ',')) end + case when call_children = '' then 0 else len(string_split(call_children, ',')) end as degree from edges) select node_id, cast(degree as int) as degree, 8.0::double + 1.5::double * degree as radius from c",
        "error_hotspots": _with("logs") + "select function, count(*) as n from logs where level = 'error' and function is not null group by function order by n desc, function limit 5",
        "module_error_rate": _with("logs") + "select module, count(*) as total, sum(case when level = 'error' then 1 else 0 end)::bigint as errors, round(cast(100 as double) * sum(case when level = 'error' then 1 else 0 end) / count(*), 2) as error_pct from logs group by module",
        "event_error_rate": "select 'user.' || cast(user_id % 50 as varchar) as module, count(*) as total, sum(case when event_type = 'error' then 1 else 0 end)::bigint as errors, round(cast(100 as double) * sum(case when event_type = 'error' then 1 else 0 end) / count(*), 2) as error_pct from events group by all",
        "filtered_counts": _with("logs") + """select unnest(['errors', 'exists', 'prefix', 'all']) as name, unnest([sum(case when level = 'error' then 1 else 0 end)::bigint, count(message), sum(case when starts_with(module, 'app.brand1') then 1 else 0 end)::bigint, count(*)]) as n from logs""",
        "tagged_errors": _resolved().rstrip() + f", {TAGGED_NODES} select r.l_orderkey, r.l_linenumber, r.message, r.node_id from resolved r join tagged t using (node_id) where r.level = 'error' and list_contains(string_split(t.tags, ','), 'payment')",
        "top_function_drilldown": _with("logs") + "select l_orderkey, l_linenumber, message from logs where function = (select function from logs group by function order by count(*) desc, function limit 1)",
        "lifecycle_trace": _resolved().rstrip() + f", {TAGGED_NODES} select r.ts, r.l_orderkey, r.l_linenumber, r.message from resolved r join tagged t using (node_id) where list_contains(string_split(t.tags, ','), 'retry') order by r.ts, r.l_orderkey, r.l_linenumber, r.message limit 20",
        "orphan_node_ids": _resolved() + "select node_id, count(*) as n from resolved where node_id is not null and node_id not in (select node_id from nodes where ord % 10 <> 0) group by node_id",
        "enrichment_docs": _with_nodes().rstrip() + f", {TAGGED_NODES} select node_id, module, function, file, line, level, tags, message_template, '2024-01-01T00:00:00' as graph_version, 'abc' as commit_sha, cast(null as varchar) as branch from tagged",
        "resource_attributes": _with_nodes() + "select 'demo' as project, '2.0' as schema_version, '2024-01-01T00:00:00' as graph_built_at, count(*) as node_count, 'abc' as commit_sha, cast(null as varchar) as branch from nodes",
        "incremental_delta": """with f as (select 'd' || cast(doc_id as varchar) as path, sha256(coalesce(text, '')) as sha256 from documents where doc_id % 5 <> 0),
            c as (select 'd' || cast(doc_id as varchar) as path, case when doc_id % 3 = 0 then 'stale' else sha256(coalesce(text, '')) end as sha256 from documents where doc_id % 7 <> 0)
            select coalesce(f.path, c.path) as path, coalesce(f.sha256, c.sha256) as sha256, case when f.path is null then 'evicted' when f.sha256 = c.sha256 then 'hit' else 'miss' end as status from f full outer join c on f.path = c.path""",
        "dedup_sites_first_wins": """with s as (select p_brand as file, p_size as line, p_partkey as ord, p_partkey % 2 as source_rank, p_name as message from part)
            select file, line, message from (select *, row_number() over (partition by file, line order by source_rank, ord) as r from s) x where r = 1""",
        "go_line_candidates": """with s as (select p_brand as file, p_size as line, p_partkey as ord, p_partkey % 4 = 0 as terminal, p_name as method from part)
            select file, line, ord, method from (select *, row_number() over (partition by file, line order by case when terminal then 0 else 1 end, case when terminal then ord else -ord end) as r from s) x where r = 1""",
        "page_links": """select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ',') as links from pages""",
        "level_normalize_go": "select event_id, case event_type when 'error' then 'error' when 'view' then 'debug' when 'click' then 'info' end as level from events",
    }
    sql |= {
        "level_normalize_ts": "select event_id, case event_type when 'error' then 'error' when 'view' then 'debug' when 'click' then 'info' when 'purchase' then 'critical' end as level from events",
        "go_function_names": "select p_partkey, case when p_partkey % 2 = 1 then 'Store' || cast(p_size as varchar) || '.Load' else 'Run' end as function from part",
        "plain_names": _with("call_nodes") + "select node_id, lower(replace(string_split(function, '.')[-1], '_', '')) as plain from call_nodes",
        "kql_filters": _with_nodes().rstrip() + f", {TAGGED_NODES} select node_id, module, function from tagged where level = 'error' and list_contains(string_split(tags, ','), 'retry') and starts_with(module, 'app.brand1')",
        "json_events_decoded": "select event_id, case when event_id % 4 <> 0 then cast(json_extract_string(props, '$.k') as bigint) end as k from events",
        "ndjson_bulk": _with_nodes().rstrip() + f""", {TAGGED_NODES} select node_id,
            cast(to_json({{'index': {{'_index': 'provenance-enrichment', '_id': node_id}}}}) as varchar) || chr(10) ||
            cast(to_json({{'provenance': {{'node_id': node_id, 'module': module, 'function': function, 'file': file, 'line': line, 'level': level, 'tags': case when tags = '' then [] else string_split(tags, ',') end,
              'message_template': message_template, 'call_parents': [], 'call_children': [], 'call_parent_names': [], 'call_child_names': [], 'graph_version': '2024-01-01T00:00:00', 'commit_sha': 'abc', 'branch': null}}}}) as varchar) as value from tagged""",
    }
    for q in ("stream_enrich_equals_batch",):
        sql[q] = sql["enrich_logs"]
    return sql | _source_sql()
