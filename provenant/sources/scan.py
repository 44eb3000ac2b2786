"""Source trees as tables: files, and what each file tells, in one pass over each."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import constants as C
from provenant.functions import text as T
from provenant.operators.nodes import build_nodes, dedup_sites, last_per
from provenant.sources import go_source, python_source, ts_source

EXTRACTORS = {"python": python_source.extract, "go": go_source.extract, "typescript": ts_source.extract}

SIGNATURE = "struct<parameters:array<struct<name:string,type_hint:string,default:string>>,return_type:string,is_async:boolean,decorators:array<string>>"
SITE = (
    "class_name string, function string, level string, message_template string, line int, column int, source_rank int, scope string, "
    "in_try_except boolean, in_catch boolean, in_if_block boolean, in_loop boolean, in_switch boolean, in_select boolean, in_defer boolean, "
    "in_goroutine boolean, in_closure boolean, is_async boolean, receiver_type string, signature " + SIGNATURE
)
MODEL = "name string, line int, base_classes array<string>, fields array<struct<name:string,type_hint:string,default:string>>"


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for language, suffixes in C.LANGUAGE_SUFFIXES.items():
        out = F.when(T.suffix_of(path).isin(*suffixes), F.lit(language)).otherwise(out)
    return out


def visible(relative: Column) -> Column:
    """Whether no part of a path is hidden or an ignored folder."""
    bad = lambda p: F.startswith(p, F.lit(".")) | p.isin(*C.IGNORED_FOLDERS)
    return ~F.exists(F.split(relative, "/"), bad)


def source_files(spark: SparkSession, root: str, languages: Sequence[str] = ("python",)) -> DataFrame:
    """path (below root), language, content, sha256 of the files of a tree; Go tests, hidden and vendored ones are left out.

    Names are tested before contents are decoded, so files of other kinds are
    listed, not parsed.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.split(":", 1)[-1].replace("//", "/", 1).rstrip("/") + "/")
    relative = F.call_function("substring_index", F.col("path"), base, F.lit(-1))
    rows = raw.select(relative.alias("path"), "content").withColumn("language", language_of(F.col("path")))
    rows = rows.where(F.col("language").isin(*languages) & visible(F.col("path")) & ~F.endswith("path", F.lit("_test.go")))
    return rows.select("path", "language", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"))


def extracted(files: DataFrame) -> DataFrame:
    """path, module, kind (site, model, import, function, call, error), row (JSON) of files(path, language, content)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str, str]] = []
            for path, language, module, content in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found = EXTRACTORS[language](content or "")
                add = lambda kind, row: out.append((path, module, kind, json.dumps(row)))  # noqa: E731, B023
                for site in found.sites:
                    add("site", site)
                for model in found.models:
                    add("model", model)
                for name in found.imports:
                    add("import", {"name": name})
                for name in found.functions:
                    add("function", {"name": name})
                for caller, callee in found.calls:
                    add("call", {"caller": caller, "callee": callee})
                if found.error:
                    add("error", {"name": found.error})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["path", "module", "kind", "row"])

    rows = files.select("path", "language", T.module_path(F.col("path"), F.col("language")).alias("module"), "content")
    return rows.mapInArrow(of, "path string, module string, kind string, row string")


@dataclass
class SourceTables:
    """What a source tree tells. sites are not deduplicated yet."""

    sites: DataFrame
    models: DataFrame
    imports: DataFrame
    functions: DataFrame
    calls: DataFrame
    errors: DataFrame


def source_tables(rows: DataFrame) -> SourceTables:
    """Tables of extracted(); keep or write rows first, as each table reads them."""

    def part(kind: str, schema: str) -> DataFrame:
        return rows.where(F.col("kind") == kind).select("path", "module", F.from_json("row", schema).alias("r")).select("path", "module", "r.*")

    sites = part("site", SITE).withColumnRenamed("path", "file")
    order = F.concat_ws("\x00", "file", F.lpad(F.col("source_rank").cast("string"), 1, "0"), F.lpad(F.col("line").cast("string"), 9, "0"), F.lpad(F.col("column").cast("string"), 9, "0"))
    models = part("model", MODEL).withColumn("key", F.concat("module", F.lit("."), "name"))
    calls = part("call", "caller string, callee string").select(F.concat("module", F.lit("."), "caller").alias("caller"), "callee").distinct()
    return SourceTables(
        sites.withColumn("ord", order),
        last_per(models, ["key"], "path", "line"),
        part("import", "name string").select("module", F.col("name").alias("import")).distinct(),
        part("function", "name string").select("module", F.col("name").alias("function"), F.concat("module", F.lit(":"), "name").alias("key")),
        calls,
        part("error", "name string").select("path", F.col("name").alias("error")),
    )


def scan_nodes(tables: SourceTables, redact: Sequence[str] = ()) -> DataFrame:
    """Graph nodes of a source tree, in the order of path, line and column."""
    return build_nodes(dedup_sites(tables.sites), redact)


def rescanned(files: DataFrame, cache: DataFrame) -> DataFrame:
    """extracted() of files, taken from cache(path, sha256, module, kind, row) where path and hash are those of a file, parsed anew elsewhere.

    The result, with sha256, is the next cache: what is no longer there is left out.
    """
    known = cache.join(files.select("path", "sha256"), ["path", "sha256"], "left_semi")
    fresh = files.join(cache.select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")
    parsed = extracted(fresh).join(fresh.select("path", "sha256"), "path")
    return known.select("path", "sha256", "module", "kind", "row").unionByName(parsed.select("path", "sha256", "module", "kind", "row"))
