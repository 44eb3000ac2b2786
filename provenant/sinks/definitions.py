"""Definitions for a search cluster that stores enriched logs: templates, enrich policy, ingest pipeline. Metadata only, made on the driver."""

from __future__ import annotations

import json
from typing import Any

NAMESPACE = "provenance"


def _keyword(**more: Any) -> dict[str, Any]:
    return {"type": "keyword", **more}


def field_mapping() -> dict[str, Any]:
    """How the fields of the namespace are indexed: exact words, whole numbers, and a text form of the template."""
    words = ("traversal", "module", "function", "file", "tags", "level", "call_parents", "call_children", "call_parent_names", "call_child_names", "graph_version", "commit_sha", "branch")
    fields: dict[str, Any] = {w: _keyword() for w in words}
    fields["node_id"] = _keyword(ignore_above=64)
    fields["line"] = {"type": "integer"}
    fields["message_template"] = _keyword(fields={"text": {"type": "text", "analyzer": "standard"}})
    parameters = {"type": "nested", "properties": {n: _keyword() for n in ("name", "type_hint", "default")}}
    fields["signature"] = {"properties": {"parameters": parameters, "return_type": _keyword(), "is_async": {"type": "boolean"}, "decorators": _keyword()}}
    return {NAMESPACE: {"properties": fields}}


def _about(what: str) -> dict[str, str]:
    return {"description": what, "managed_by": NAMESPACE}


def component_template() -> dict[str, Any]:
    return {"template": {"mappings": {"properties": field_mapping()}}, "version": 1, "_meta": _about("Code context of log events")}


def index_template(name: str = f"{NAMESPACE}-logs", patterns: list[str] | None = None, priority: int = 200, shards: int = 1, replicas: int = 1, lifecycle: str | None = None) -> dict[str, Any]:
    settings: dict[str, Any] = {"number_of_shards": shards, "number_of_replicas": replicas}
    if lifecycle:
        settings["index.lifecycle.name"] = lifecycle
    base = {"@timestamp": {"type": "date"}, "message": {"type": "text"}, "log.level": _keyword(), "log.logger": _keyword()}
    return {
        "index_patterns": patterns or [f"{NAMESPACE}-*", f"logs-{NAMESPACE}-*"],
        "priority": priority,
        "template": {"settings": settings, "mappings": {"properties": base | field_mapping()}},
        "version": 1,
        "_meta": _about(f"Index template {name}"),
    }


def index_body() -> dict[str, Any]:
    """What creates the index of enrichment documents."""
    return {"settings": {"number_of_shards": 1, "number_of_replicas": 0}, "mappings": {"properties": field_mapping()}}


ENRICH_FIELDS = (
    "module", "function", "file", "line", "level", "tags", "message_template", "call_parents", "call_children", "call_parent_names",
    "call_child_names", "signature", "graph_version", "commit_sha", "branch",
)


def enrich_policy(index: str = f"{NAMESPACE}-enrichment") -> dict[str, Any]:
    return {"match": {"indices": index, "match_field": f"{NAMESPACE}.node_id", "enrich_fields": [f"{NAMESPACE}.{f}" for f in ENRICH_FIELDS]}}


def ingest_pipeline(policy: str = f"{NAMESPACE}-enrich") -> dict[str, Any]:
    """Rename the flat id to the dotted one, then join the graph where there is an id; others pass unchanged."""
    rename = {"field": f"{NAMESPACE}_node_id", "target_field": f"{NAMESPACE}.node_id", "ignore_missing": True}
    join = {
        "policy_name": policy, "field": f"{NAMESPACE}.node_id", "target_field": NAMESPACE, "max_matches": 1, "override": True,
        "ignore_missing": True, "if": f"ctx?.{NAMESPACE}?.node_id != null",
    }
    return {"description": "Adds code context to log events", "processors": [{"rename": rename}, {"enrich": join}]}


def rendered(kind: str = "component", **options: Any) -> str:
    makers = {"component": component_template, "index": index_template, "policy": enrich_policy, "pipeline": ingest_pipeline, "body": index_body}
    return json.dumps(makers[kind](**options), indent=2)
