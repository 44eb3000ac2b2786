"""Graphs as documents: bulk NDJSON, Parquet, and an interactive page."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators.enrich import enrichment
from provenant.operators.stats import node_degree, viz_links
from provenant.sinks.definitions import NAMESPACE, index_body

FIELDS = (
    "node_id", "module", "function", "file", "line", "level", "tags", "message_template", "call_parents", "call_children",
    "call_parent_names", "call_child_names", "graph_version", "commit_sha", "branch",
)


def bulk_lines(dimension: DataFrame, index: str = f"{NAMESPACE}-enrichment") -> DataFrame:
    """node_id, value: an action line and a body line for each node, nulls written out; a missing signature is left out."""
    keep = {"ignoreNullFields": "false"}
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("node_id").alias("_id")).alias("index")))
    plain = F.to_json(F.struct(F.struct(*FIELDS).alias(NAMESPACE)), keep)
    signed = F.to_json(F.struct(F.struct(*FIELDS, "signature").alias(NAMESPACE)), keep)
    body = F.when(F.col("signature").isNull(), plain).otherwise(signed)
    return dimension.select("node_id", F.concat_ws("\n", action, body).alias("value"))


def export_ndjson(dimension: DataFrame, path: str, index: str = f"{NAMESPACE}-enrichment", mapping: str | None = None) -> None:
    """Write the bulk lines as text files below path, each ending in a line feed, and the index body beside them if asked for."""
    bulk_lines(dimension, index).select("value").write.mode("overwrite").text(path)
    if mapping:
        Path(mapping).write_text(json.dumps(index_body(), indent=2), encoding="utf-8")


def save_tables(nodes: DataFrame, path: str) -> None:
    """Nodes and their enrichment dimension as Parquet."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    enrichment(nodes).write.mode("overwrite").parquet(f"{path}/enrichment")


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>__TITLE__</title><style>body{margin:0;font:13px sans-serif}
#q{position:fixed;top:8px;left:8px;padding:4px}line{stroke:#bbb}circle{fill:#47a}circle.hit{fill:#e50}</style></head>
<body><input id="q" placeholder="search"><svg id="s" width="1200" height="900"></svg><script>
const data=__DATA__,svg=document.getElementById("s"),ns="http://www.w3.org/2000/svg",at={};
data.nodes.forEach((n,i)=>{const a=i*2.4,r=14*Math.sqrt(i);at[n.id]=[600+r*Math.cos(a),450+r*Math.sin(a)];});
const add=(tag,attrs)=>{const e=document.createElementNS(ns,tag);for(const k in attrs)e.setAttribute(k,attrs[k]);svg.appendChild(e);return e;};
data.links.forEach(l=>{const[a,b]=[at[l.source],at[l.target]];add("line",{x1:a[0],y1:a[1],x2:b[0],y2:b[1]});});
const dots=data.nodes.map(n=>{const c=add("circle",{cx:at[n.id][0],cy:at[n.id][1],r:n.radius});const t=document.createElementNS(ns,"title");
t.textContent=n.label;c.appendChild(t);return[n,c];});
document.getElementById("q").oninput=e=>{const q=e.target.value.toLowerCase();dots.forEach(([n,c])=>c.classList.toggle("hit",q&&n.label.toLowerCase().includes(q)));};
</script></body></html>"""


def html_graph(nodes: DataFrame, path: str, title: str = "Call graph") -> None:
    """A page with nodes sized by degree, call edges and a search field; for graphs that a browser can show."""
    sized = nodes.join(node_degree(nodes), "node_id").select("node_id", "radius", F.concat("function", F.lit(": "), "message_template").alias("label"))
    data = {
        "nodes": [{"id": r["node_id"], "radius": r["radius"], "label": r["label"]} for r in sized.collect()],
        "links": [r.asDict() for r in viz_links(nodes).collect()],
    }
    text = json.dumps(data).replace("</", "<\\/")
    Path(path).write_text(_PAGE.replace("__TITLE__", html.escape(title)).replace("__DATA__", text), encoding="utf-8")
