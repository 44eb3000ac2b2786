import os
import subprocess

import pytest

from provenant.sources import clike, go_source, graph, python_source, scan, ts_source


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ('log.info("a" + x + "b")', "a{}b"),
        ("log.info('x %s', 1)", "x %s"),
        ('log.info("a" "b")', "{}"),
        ('log.info(f"{a!r:>{w}} {{z}}")', "{} {{z}}"),
        ("log.info(x)", "{}"),
        ("log.info(msg='x')", "{}"),
        ('log.info(r"\\d")', "\\d"),
        ("math.log(2)", "{}"),
        ('warning("bare")', "bare"),
    ],
)
def test_python_templates(call, want):
    assert python_source.extract(call).sites[0]["message_template"] == want


def test_python_that_does_not_parse_keeps_text_sites():
    out = python_source.extract("def f(:\n  logger.info('still here')\n")
    assert out.error and [s["message_template"] for s in out.sites] == ["still here"]


def test_python_nesting():
    src = "class A:\n def f(self):\n  def g():\n   log.debug('x')\n  g()\n"
    out = python_source.extract(src)
    assert out.sites[0]["function"] == "g" and out.sites[0]["class_name"] == "A"
    assert out.calls == [("A.f", "g")]


@pytest.mark.parametrize(
    ("body", "level", "want"),
    [
        ('log.Printf("a %d", 1)', "info", "a {}"),
        ("logger.Warnw(`raw %+v`)", "warning", "raw {}"),
        ('l.DPanic("x " + y)', "critical", "x {}"),
        ('log.Warn().Str("k", "v").Msgf("m %s", a)', "warning", "m {}"),
        ("log.Debug(err)", "debug", "{}"),
        ("logger.Error(fmt.Errorf(\"e %w\", err))", "error", "e {}"),
    ],
)
def test_go_sites(body, level, want):
    (site,) = go_source.extract("package p\nfunc f() {\n\t" + body + "\n}\n").sites
    assert (site["level"], site["message_template"], site["function"]) == (level, want, "f")


@pytest.mark.parametrize("body", ['http.Error(w, "x", 500)', 'errors.New("x")', 'x := fmt.Errorf("x")', "foo(zap.Error(err))", "// log.Info(1)"])
def test_go_no_sites(body):
    assert go_source.extract("package p\nfunc f() {\n\t" + body + "\n}\n").sites == []


def test_go_closure_takes_variable_name():
    out = go_source.extract("package p\nfunc main() {\n\th := func() {\n\t\tlog.Info(\"x\")\n\t}\n\th()\n}\n")
    assert out.sites[0]["function"] == "h" and out.sites[0]["in_closure"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("const f = () => log.info(`a ${b.c} d`);", ("f", "info", "a {} d")),
        ("const o = { run: async () => { logger.warn('x' + y) } }", ("run", "warning", "x{}")),
        ("class K { static go<T>(a: T): void { console.error(msg) } }", ("K.go", "error", "{}")),
        ("function* g() { if (/a\"(/.test(x)) { winston.silly(\"s\") } }", ("g", "debug", "s")),
        ("pino.fatal('end')", ("<module>", "critical", "end")),
    ],
)
def test_ts_sites(source, want):
    (site,) = ts_source.extract(source).sites
    assert (site["function"], site["level"], site["message_template"]) == want


def test_broken_sources_end():
    for text in ("", "{{{((", "func f(", "class {", "`${`", "if else => => (", "import", "interface X {", "type A struct {"):
        go_source.extract(text)
        ts_source.extract(text)
    assert clike.tokens('a /* x', True)[0].text == "a"


def test_tree_scan_and_cache(spark, tmp_path):
    for name, text in {
        "src/app/a.py": "def f():\n    logger.info('hello')\n", "venv/b.py": "logger.info('no')\n", ".hid/c.py": "logger.info('no')\n",
        "svc/d.go": "package p\nfunc g() { log.Info(\"hi\") }\n", "svc/d_test.go": "package p\nfunc g() { log.Info(\"no\") }\n", "e.txt": "x",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = scan.source_files(spark, str(tmp_path), ("python", "go"))
    assert sorted(r.path for r in files.collect()) == ["src/app/a.py", "svc/d.go"]
    rows = scan.extracted(files)
    nodes = {r.message_template: r for r in scan.scan_nodes(scan.source_tables(rows)).collect()}
    assert set(nodes) == {"hello", "hi"} and nodes["hello"].module == "app.a" and nodes["hello"].node_id.startswith("ll:")
    cache = rows.join(files.select("path", "sha256"), "path").select("path", "sha256", "module", "kind", "row").cache()
    assert cache.count() > 0
    (tmp_path / "src/app/a.py").write_text("def f():\n    logger.info('changed')\n")
    (tmp_path / "svc/d.go").unlink()
    again = scan.rescanned(scan.source_files(spark, str(tmp_path), ("python", "go")), cache)
    assert {r.message_template for r in scan.scan_nodes(scan.source_tables(again)).collect()} == {"changed"}


def test_graph_files(spark, tmp_path, monkeypatch):
    from provenant.plans.queries import _nodes

    nodes = _nodes(spark, "/root/testdata/sf0.001").where("ord < 20")
    path = tmp_path / "a" / "b"
    path.mkdir(parents=True)
    file = tmp_path / graph.FILE_NAME
    graph.save_graph(graph.Graph(nodes, "demo", "2024-01-01T00:00:00", commit_sha="abc"), str(file))
    assert graph.find_graph(start=str(path)) == str(file)
    got = graph.load_graph(spark, str(file))
    assert (got.project, got.commit_sha, got.nodes.count()) == ("demo", "abc", nodes.count())
    assert sorted(r.node_id for r in got.nodes.collect()) == sorted(r.node_id for r in nodes.collect())
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    assert graph.load_graph(spark, str(bad)) is None and graph.load_graph(spark, str(tmp_path / "none")) is None
    monkeypatch.setenv(graph.VARIABLE, str(file))
    assert graph.find_graph(start="/") == str(file)


def test_project_and_git(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "shop"\n')
    (tmp_path / "x").mkdir()
    assert graph.project_name(str(tmp_path / "x")) == "shop"
    assert graph.git_metadata(str(tmp_path))["commit_sha"] is None
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    head = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    assert (graph.git_metadata(root)["commit_sha"] or "") == head
