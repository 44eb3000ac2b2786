"""The engine's front door: build a graph from source, load one, and use it on logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators import calls, compare, enrich, imports, resolve
from provenant.sources import graph as saved
from provenant.sources import scan
from provenant.streaming.enrich import enrich_stream


@dataclass
class Project:
    """A graph together with what else its source tells."""

    graph: saved.Graph
    tables: scan.SourceTables | None = None

    @classmethod
    def build(cls, spark: SparkSession, root: str, languages: Sequence[str] = ("python",), redact: Sequence[str] = (), name: str | None = None, git: bool = True, keep: str | None = None) -> Project:
        """Scan a tree, make nodes and call edges. keep: where to write what was extracted, so that files are parsed once."""
        rows = scan.extracted(scan.source_files(spark, root, languages))
        if keep:
            rows.write.mode("overwrite").parquet(keep)
            rows = spark.read.parquet(keep)
        else:
            rows = rows.persist()
        tables = scan.source_tables(rows)
        nodes = scan.scan_nodes(tables, redact)
        nodes = nodes.join(calls.call_edges(tables.calls, nodes), "node_id")
        meta = saved.git_metadata(root) if git else {}
        now = datetime.now(timezone.utc).isoformat()
        return cls(saved.Graph(nodes, name or saved.project_name(root), now, commit_sha=meta.get("commit_sha"), branch=meta.get("branch")), tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str | None = None) -> Project | None:
        found = saved.load_graph(spark, path)
        return cls(found) if found else None

    def save(self, path: str) -> None:
        saved.save_graph(self.graph, path)

    @property
    def dimension(self) -> DataFrame:
        g = self.graph
        return enrich.enrichment(g.nodes, g.built_at, g.commit_sha, g.branch)

    def enrich(self, events: DataFrame, profile: str = "processor") -> DataFrame:
        """Resolve and enrich events(module, function, message, ...), batch or stream."""
        if events.isStreaming:
            return enrich_stream(events, self.graph.nodes, self.dimension, profile)
        return enrich.enrich(resolve.resolve(events, self.graph.nodes), self.dimension, profile)

    def coverage(self) -> DataFrame:
        return compare.coverage_metrics(self.tables.functions, self.graph.nodes)

    def internal_imports(self) -> DataFrame:
        return imports.internal_imports(self.tables.imports)

    def diff(self, older: Project) -> DataFrame:
        return compare.diff_graphs(older.graph.nodes, self.graph.nodes)

    def lint(self) -> tuple[DataFrame, DataFrame]:
        """Untracked and stale places of this graph against the tree it was built from, or another's."""
        sites = self.tables.sites.select(F.col("file"), "line")
        return compare.lint_untracked(sites, self.graph.nodes), compare.lint_stale(sites, self.graph.nodes)
