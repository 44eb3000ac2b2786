"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provenant.llm import mixing
from provenant.llm.embedding_dedup import op1_embedding_dedup
from provenant.llm.html import op8_html
from provenant.llm.line_dedup import op2_line_dedup
from provenant.llm.lm_score import op5_lm_score
from provenant.llm.media import op6_media
from provenant.llm.mixing import op7_mix
from provenant.llm.packing import op4_packing
from provenant.llm.pii import op9_pii
from provenant.llm.quality import op10_quality
from provenant.llm.simhash import op3_simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_line_dedup(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_simhash(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_packing(_table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_lm_score(_table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_media(_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mix(_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_html(_table(spark, sf_dir, "pages"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key of the test tables, which hold nothing real; whoever has real data passes a secret one
    return op9_pii(_table(spark, sf_dir, "documents"), b"test tables")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1,
        "op2_line_dedup": op2,
        "op3_simhash": op3,
        "op4_packing": op4,
        "op5_lm_score": op5,
        "op6_media": op6,
        "op7_mix": op7,
        "op8_html": op8,
        "op9_pii": op9,
        "op10_quality": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mix": mixing.ORACLE_SQL}
