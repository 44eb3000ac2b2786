"""Saved graphs, and what is known about a project: its name and its version."""

from __future__ import annotations

import json
import os
import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.sources.scan import SIGNATURE

SCHEMA_VERSION = "2.0"
FILE_NAME, VARIABLE = "provenance-graph.json", "PROVENANCE_GRAPH"
LISTS = ("semantic_tags", "lexical_parents", "call_parents", "call_children", "call_parent_names", "call_child_names")
NODE = "node_id string, file string, module string, function string, level string, message_template string, line int, " + ", ".join(f"{x} array<string>" for x in LISTS) + f", signature {SIGNATURE}"


@dataclass
class Graph:
    """Nodes with their call edges, and the project they are of."""

    nodes: DataFrame
    project: str
    built_at: str
    schema_version: str = SCHEMA_VERSION
    commit_sha: str | None = None
    branch: str | None = None


def save_graph(graph: Graph, path: str) -> None:
    """One JSON document, indented by two; a graph is as small as the code it is of."""
    have = set(graph.nodes.columns)
    columns = [x.strip().split(" ")[0] for x in re.split(r", (?=\w+ (?:string|int|array<string>|struct))", NODE)]
    rows = graph.nodes.orderBy("ord").select(*[c for c in columns if c in have]).toJSON().collect()
    nodes = {n["node_id"]: n for n in map(json.loads, rows)}
    head = {"schema_version": graph.schema_version, "project": graph.project, "built_at": graph.built_at, "commit_sha": graph.commit_sha, "branch": graph.branch}
    Path(path).write_text(json.dumps(head | {"nodes": nodes}, indent=2, ensure_ascii=False), encoding="utf-8")


def load_graph(spark: SparkSession, path: str | None = None) -> Graph | None:
    """The graph at a path or the one found (see find_graph); None if there is none or it cannot be read. Older files lack columns; these are null, lists empty."""
    found = find_graph(path)
    if found is None:
        return None
    schema = f"schema_version string, project string, built_at string, commit_sha string, branch string, nodes map<string, struct<{NODE.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array').replace(' struct', ':struct')}>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(found)
    head = whole.first()
    if head is None or head["nodes"] is None:
        return None
    nodes = whole.select(F.posexplode(F.map_values("nodes")).alias("ord", "n")).select("ord", "n.*")
    empty = F.expr("cast(array() as array<string>)")
    for c in LISTS:
        nodes = nodes.withColumn(c, F.coalesce(c, empty))
    return Graph(nodes, head["project"], head["built_at"], head["schema_version"] or SCHEMA_VERSION, head["commit_sha"], head["branch"])


def find_graph(path: str | None = None, start: str | None = None, levels: int = 20) -> str | None:
    """A given path, else the one an environment variable names, else the first found from a folder upwards."""
    if path is not None:
        return os.path.abspath(path) if os.path.isfile(path) else None
    named = os.environ.get(VARIABLE)
    if named and os.path.isfile(named):
        return named
    here = Path(start or os.getcwd()).resolve()
    for folder in [here, *here.parents][:levels]:
        if (folder / FILE_NAME).is_file():
            return str(folder / FILE_NAME)
    return None


def project_name(root: str, levels: int = 10) -> str:
    """name in the nearest pyproject.toml, else in setup.cfg, from a folder upwards; else the folder's own name."""
    here = Path(root).resolve()
    here = here.parent if here.is_file() else here
    for folder in [here, *here.parents][:levels]:
        for file, quote in (("pyproject.toml", "[\"']"), ("setup.cfg", "")):
            if (folder / file).is_file() and (m := re.search(rf"(?m)^\s*name\s*=\s*{quote}([^\"'\s]+)", (folder / file).read_text(encoding="utf-8"))):
                return m[1]
    return here.name


def git_metadata(root: str = ".", timeout: float = 5) -> dict[str, str | bool | None]:
    """commit_sha, branch, author, dirty of a working tree; null where git does not tell."""

    def ask(*words: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    status = ask("status", "--porcelain")
    return {"commit_sha": ask("rev-parse", "HEAD"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "author": ask("log", "-1", "--format=%an"), "dirty": None if status is None else bool(status)}
