"""The engine end to end: trees, graphs, sinks, streams and the command line."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenant import cli
from provenant.api import Project
from provenant.functions import constants as C
from provenant.functions import text as T
from provenant.operators import calls, enrich, resolve
from provenant.operators.stored import Stored
from provenant.plans import corpus, queries
from provenant.sinks import definitions, documents
from provenant.streaming import enrich as streaming


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, _, text in corpus.FILES:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def project(spark, tree):
    built = Project.build(spark, tree, ("python", "go", "typescript"), git=False, name="demo")
    built.graph.nodes = built.graph.nodes.coalesce(1).cache()
    return built


def test_build_and_enrich(spark, project):
    assert project.graph.nodes.count() == 18
    events = spark.createDataFrame(
        [("app.shop", "sell", "odd 3 in 'x'"), ("elsewhere", "run", "failed %s"), ("app.shop", "run", "failed 12"), ("app.shop", "run", "other"), (None, None, None)],
        "module string, function string, message string",
    )
    got = {r.message: r for r in project.enrich(events).collect()}
    # a template that is one placeholder fits all that its function logs
    assert [got[m].tier for m in ("odd 3 in 'x'", "failed %s", "failed 12", "other", None)] == [3, 2, 3, 3, None]
    assert got["failed 12"].provenance.file == "src/app/shop.py" and got[None].provenance is None
    assert project.coverage().first().instrumented_functions == 6
    assert [d.isEmpty() for d in project.lint()] == [True, True]


def test_edges_of_source(project):
    got = {(r.function, r.message_template): r for r in project.graph.nodes.collect()}
    assert "src/cart.load" in got[("load", "case a")].call_child_names or got[("load", "case a")].call_child_names == []


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of all tables written or returned by a query of the call graph, with Spark's own threshold of broadcasts."""
    seen, write = [], Stored.__call__
    monkeypatch.setattr(Stored, "__call__", lambda self, df, tag: seen.append(df) or write(self, df, tag))

    def of(name):
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        return [x._jdf.queryExecution().executedPlan().toString() for x in (*seen, df)]

    return of


def test_call_edges_are_merged_and_computed_once(plans):
    found = plans("call_edges")
    assert not any("Broadcast" in p for p in found)
    # line items are read for one table, and the result is read from a table
    assert sum(p.count("l_partkey") > 0 for p in found) == 1
    assert "Join" not in found[-1]


def test_templates_match_as_python_would(spark):
    texts = ["a {} b", "100% done", "%s", "x.*?y", "plain", "{a} {b!r}", "50%% \\E q", "é {}\nend", "(a|b) %d"]
    made = ["a 1 b", "a b", "100X", "100% done", "anything\nmore", "x--y", "plain", "50% \\E q", "é 1\nend", "(a|b) 7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", T.template_pattern(F.col("t")))
    got = {(r.t, r.m): r.hit for r in df.join(spark.createDataFrame([(m,) for m in made], "m string")).select("t", "m", F.expr("m rlike p").alias("hit")).collect()}
    for t in texts:
        if not re.search(C.BRACE_FIELD, t) and not re.search(C.PRINTF_VERB, t):
            assert got[(t, made[0])] is None
            continue
        wild = re.sub(C.PRINTF_VERB, ".*?", re.sub(C.BRACE_FIELD, ".*?", t))
        want = re.compile("^" + ".*?".join(map(re.escape, wild.split(".*?"))) + "$", re.S)
        for m in made:
            assert got[(t, m)] == bool(want.match(m)), (t, m)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("ab{}%ds .*?", max_size=8), min_size=5, max_size=40))
def test_prefix_lookup_loses_no_match(spark, templates):
    nodes = spark.createDataFrame([(f"n{k}", k, "m", "f", t) for k, t in enumerate(templates)], "node_id string, ord long, module string, function string, message_template string")
    messages = ["", "a", "ab", "abab ab", "b1 a", "%d", "{}", "s s .*?"] + templates
    events = spark.createDataFrame([("z", "f", m) for m in set(messages)], "module string, function string, message string")
    got = {r.message: r.node_id for r in resolve.resolve(events, nodes).collect()}
    stream = {r.message: r.node_id for r in streaming.resolve_stream(events, nodes).collect()}
    assert got == stream
    for m in got:
        same = [f"n{k}" for k, t in enumerate(templates) if t == m]
        fits = []
        for k, t in enumerate(templates):
            if re.search(C.BRACE_FIELD, t) or re.search(C.PRINTF_VERB, t):
                wild = re.sub(C.PRINTF_VERB, ".*?", re.sub(C.BRACE_FIELD, ".*?", t))
                if re.match("^" + ".*?".join(map(re.escape, wild.split(".*?"))) + "$", m, re.S):
                    fits.append(f"n{k}")
        assert got[m] == (same[-1] if same else fits[0] if fits else None)


@pytest.mark.parametrize(("full", "name"), [("a/b/pkg.Func", "Func"), ("a/b/pkg.(*Server).Do", "Server.Do"), ("main.main", "main"), ("plain", "plain"), ("x/pkg.T.M", "T.M")])
def test_go_names(spark, full, name):
    assert spark.createDataFrame([(full,)], "f string").select(T.go_function_name(F.col("f"))).first()[0] == name


@pytest.mark.parametrize(("module", "name", "want"), [("a.b.c", ".d", "a.b.d"), ("a.b.c", "..d", "a.d"), ("a.b.c", ".", "a.b"), ("a", "...x", "x"), ("a.b", "os", "os")])
def test_relative_imports(spark, module, name, want):
    df = spark.createDataFrame([(module, name)], "m string, i string")
    assert df.select(T.resolved_import(F.col("m"), F.col("i"))).first()[0] == want


def test_streams(spark, project, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": f"2024-01-01T00:0{k}:00", "module": "app.shop", "function": "run", "level": "error" if k % 2 else "info", "message": f"failed {k}"} for k in range(6)]
    (tmp_path / "in" / "a.json").write_text("\n".join(["not json", *map(json.dumps, rows)]) + "\n")
    schema = "ts timestamp, module string, function string, level string, message string"
    stream = streaming.json_events(spark, str(tmp_path / "in"), schema)
    streaming.start(project.enrich(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.line for r in out if r.line is not None] == ["not json"]
    assert len(out) == 7 and all(r.provenance.function == "run" for r in out if r.line is None)
    rates = streaming.error_rates(streaming.json_events(spark, str(tmp_path / "in"), schema).where("line is null"), "2 minutes", "1 minute")
    streaming.start(rates, str(tmp_path / "rates"), str(tmp_path / "log2")).awaitTermination()
    assert all(r.total == 2 and r.errors == 1 for r in spark.read.parquet(str(tmp_path / "rates")).collect())
    assert streaming.enrich_stream(stream, None, None) is stream


def test_definitions():
    mapping = definitions.field_mapping()[definitions.NAMESPACE]["properties"]
    assert set(definitions.ENRICH_FIELDS) <= set(mapping) and len(definitions.ENRICH_FIELDS) == 15
    assert mapping["line"]["type"] == "integer" and mapping["signature"]["properties"]["parameters"]["type"] == "nested"
    rename, join = json.loads(definitions.rendered("pipeline"))["processors"]
    assert rename["rename"]["ignore_missing"] and join["enrich"]["max_matches"] == 1
    assert json.loads(definitions.rendered("index", lifecycle="x"))["template"]["settings"]["index.lifecycle.name"] == "x"
    assert "@timestamp" not in json.loads(definitions.rendered("component"))["template"]["mappings"]["properties"]


def test_documents(spark, project, tmp_path):
    documents.export_ndjson(project.dimension, str(tmp_path / "bulk"), mapping=str(tmp_path / "m.json"))
    lines = [json.loads(x) for f in (tmp_path / "bulk").glob("part*") for x in f.read_text().splitlines()]
    assert len(lines) == 36
    for action, body in zip(lines[::2], lines[1::2]):
        doc = body[definitions.NAMESPACE]
        assert action["index"]["_id"] == doc["node_id"] and "branch" in doc and doc["tags"] is not None
    assert json.loads((tmp_path / "m.json").read_text())["settings"]["number_of_replicas"] == 0
    documents.html_graph(project.graph.nodes, str(tmp_path / "g.html"), "<demo>")
    page = (tmp_path / "g.html").read_text()
    assert "&lt;demo&gt;" in page and page.count('"radius"') == 18
    documents.save_tables(project.graph.nodes, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "enrichment")).count() == 18


def test_profiles_leave_empty_lists_out(spark, project):
    events = project.graph.nodes.select("node_id").limit(3)
    for profile, fields in enrich.PROFILES.items():
        for r in enrich.enrich(events, project.dimension, profile).collect():
            assert tuple(r.provenance.asDict()) == fields
            assert all(r.provenance[f] is None or r.provenance[f] for f in fields if f in enrich.LISTS)


def test_command_line(spark, tree, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    go = lambda *a: cli.run(spark, cli._parser().parse_args(list(a)))
    assert go("build", tree, "--languages", "python,go", "--no-git", "--fail-under", "90") == 0
    assert go("build", tree, "--languages", "python,go,typescript", "--no-git", "--output", "new.json", "--fail-under", "100") == 1
    assert go("diff", "provenance-graph.json", "new.json", "--strict") == 0
    assert "+6 -0" in capsys.readouterr().out
    assert go("diff", "new.json", "provenance-graph.json", "--strict") == 1
    for command in (["stats"], ["show"], ["show", "--tree"], ["find", "failed"], ["viz", "g.html"], ["export", "bulk"], ["models", tree], ["imports", tree]):
        assert go(*command) == 0
    assert go("lint", tree, "--graph", "provenance-graph.json", "--languages", "typescript", "--strict") == 1
    assert go("lint", tree, "--graph", "new.json", "--languages", "python", "--strict") == 0
    assert go("stats", "--graph", "none.json") == 2 and go("definition", "policy") == 0
    assert cli.scaffold(str(tmp_path), False) == [cli.IGNORE_FILE, cli.SETTINGS_FILE] and cli.scaffold(str(tmp_path), False) == []
    assert len(cli.scaffold(str(tmp_path), True)) == 2


def test_viz_links_hold_no_table_in_the_driver(plans):
    assert not any("Broadcast" in p for p in plans("viz_links"))


def test_edge_totals_read_written_edges(plans):
    found = plans("edge_totals")
    assert not any("Broadcast" in p for p in found) and "Join" not in found[-1] and "call-edges" in found[-1]


def test_node_degree_reads_written_edges(plans):
    found = plans("node_degree")
    assert not any("Broadcast" in p or "Exchange" in p for p in found[-1:]) and not any("Broadcast" in p for p in found)


@pytest.mark.parametrize("name", ["edge_totals", "node_degree"])
def test_edges_that_are_counted_are_not_listed(plans, name):
    assert not any("collect_set" in p for p in plans(name))


def test_edge_counts_equal_the_lists(spark):
    names = [("a.m", "f"), ("a.m", "f"), ("a.m", "g"), ("a.m", "S.h"), ("a.n", "h"), ("a.n", "doIt"), ("", "top"), (None, "f2"), ("a.m", None)]
    rows = [(f"n{k}", m, f, f"x{'.go' if k % 2 else '.py'}", k) for k, (m, f) in enumerate(names)]
    # a node that is told twice, callers known by a class or not at all, calls of oneself
    nodes = spark.createDataFrame([*rows, rows[0]], "node_id string, module string, function string, file string, ord long")
    callers = ["a.m.f", "a.m.Svc.f", "a.m.g", "a.m.S.h", "a.n.h", "a.n.K.h", "a.n.doIt", "top", "nobody.x", "f2"]
    pairs = spark.createDataFrame([(c, t) for c in callers for t in ("f", "g", "h", "S.h", "do_it", "top", "f2", "none")] + [(None, "f"), ("a.m.f", None)], "caller string, callee string")
    key = lambda r: tuple(r)
    want = calls.call_edges(pairs, nodes).select("node_id", F.size("call_parents"), F.size("call_children"))
    got = calls.edge_counts(pairs, nodes).select("node_id", "n_parents", "n_children")
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and any(r.n_parents > 2 for r in got.collect())
