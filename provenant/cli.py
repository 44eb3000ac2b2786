"""Command line: python -m provenant.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from provenant.api import Project
from provenant.operators import compare, imports, stats
from provenant.sinks import definitions, documents
from provenant.sources import scan

IGNORE_FILE, SETTINGS_FILE = ".provenantignore", ".provenantrc"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="provenant", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **more) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **more)
        for names, options in arguments:
            c.add_argument(*names, **options)
        return c

    graph = (("--graph",), {"default": None, "help": "saved graph; found from here upwards if left out"})
    languages = (("--languages",), {"default": "python", "help": "comma-separated: python, go, typescript"})
    command("init", (("--force",), {"action": "store_true"}))
    command("build", (("source",), {}), (("--output",), {"default": "provenance-graph.json"}), languages, (("--redact",), {"default": ""}), (("--project",), {"default": None}), (("--no-git",), {"action": "store_true"}), (("--fail-under",), {"type": float, "default": None}))
    for name in ("stats", "models", "imports"):
        command(name, graph if name == "stats" else (("source",), {}), *([] if name == "stats" else [languages]))
    command("show", graph, (("--tree",), {"action": "store_true"}))
    command("find", (("query",), {}), graph)
    command("viz", (("output",), {}), graph)
    command("lint", (("source",), {}), graph, languages, (("--strict",), {"action": "store_true"}))
    command("diff", (("old",), {}), (("new",), {}), (("--strict",), {"action": "store_true"}))
    command("export", (("output",), {}), graph, (("--index",), {"default": "provenance-enrichment"}))
    command("definition", (("kind",), {"choices": ("component", "index", "policy", "pipeline", "body")}))
    return p


def scaffold(folder: str, force: bool) -> list[str]:
    """Write the ignore and settings files; those that are there stay unless forced. Returns what was written."""
    written = []
    for name, text in ((IGNORE_FILE, "node_modules/\nvenv/\n__pycache__/\n"), (SETTINGS_FILE, "[project]\nname = \n")):
        path = Path(folder) / name
        if force or not path.exists():
            path.write_text(text, encoding="utf-8")
            written.append(name)
    return written


def _shown(df: DataFrame, most: int = 1000) -> None:
    for row in df.limit(most).collect():
        print("\t".join("" if v is None else str(v) for v in row))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Do a command; the result is the exit code, 1 where a gate fails."""
    if args.command == "definition":
        print(definitions.rendered(args.kind))
        return 0
    if args.command == "init":
        print("\n".join(scaffold(".", args.force)))
        return 0
    langs = args.languages.split(",") if "languages" in args else []
    if args.command == "build":
        project = Project.build(spark, args.source, langs, [x for x in args.redact.split(",") if x], args.project, not args.no_git)
        project.save(args.output)
        _shown(stats.build_summary(project.graph.nodes))
        cover = project.coverage()
        _shown(cover)
        return 0 if args.fail_under is None or compare.coverage_gate(cover, args.fail_under) else 1
    if args.command in ("models", "imports"):
        tables = scan.source_tables(scan.extracted(scan.source_files(spark, args.source, langs)))
        _shown(stats.models_listing(tables.models) if args.command == "models" else imports.internal_imports(tables.imports).orderBy("module", "import"))
        return 0
    if args.command == "diff":
        old, new = Project.load(spark, args.old), Project.load(spark, args.new)
        if old is None or new is None:
            print("no such graph", file=sys.stderr)
            return 2
        changes = new.diff(old)
        _shown(changes.orderBy("change_type", "node_id"))
        summary = compare.diff_summary(changes).first()
        print(f"+{summary['added']} -{summary['removed']} ~{summary['moved']} *{summary['modified']}")
        return int(args.strict and summary["removed"] > 0)
    project = Project.load(spark, args.graph)
    if project is None:
        print("no graph found", file=sys.stderr)
        return 2
    nodes = project.graph.nodes
    if args.command == "stats":
        for part in (stats.graph_overview(nodes), stats.edge_totals(nodes), stats.level_histogram(nodes), stats.tag_histogram(nodes)):
            _shown(part)
    elif args.command == "show":
        _shown(stats.module_tree(nodes) if args.tree else stats.flat_listing(nodes))
    elif args.command == "find":
        _shown(stats.find_nodes(nodes, args.query))
    elif args.command == "viz":
        documents.html_graph(nodes, args.output, project.graph.project)
    elif args.command == "export":
        # the JVM has a working folder of its own
        target = args.output if "://" in args.output else f"file://{Path(args.output).resolve()}"
        documents.export_ndjson(project.dimension, target, args.index, f"{args.output}-mapping.json")
    elif args.command == "lint":
        sites = scan.source_tables(scan.extracted(scan.source_files(spark, args.source, langs))).sites.select("file", "line")
        new, stale = compare.lint_untracked(sites, nodes), compare.lint_stale(sites, nodes)
        _shown(new.orderBy("file", "line"))
        _shown(stale.orderBy("file", "line"))
        return int(args.strict and not new.isEmpty())
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("provenant").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
