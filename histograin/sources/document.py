"""The exported JSON document as a source, and ad-hoc SQL over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import SourceError

#: The version of the document that is read and written.
SCHEMA_VERSION = 1

DOCUMENT = (
    "meta struct<schema_version: int, engine_version: string, config_hash: string, head_sha: string, anchor_ts: bigint, total_commits: bigint, total_authors: bigint, anonymized: boolean>, "
    "files array<struct<path: string, churn_total: bigint, churn_30d: bigint, churn_90d: bigint, churn_365d: bigint, complexity: double, complexity_per_loc: double, hotspot_rank: bigint, is_alive: boolean>>, "
    "coupling array<struct<a: string, b: string, support: bigint, ratio: double>>, "
    "knowledge array<struct<path: string, bus_factor: bigint, top_owner: string, top_owner_ratio: double>>, "
    "file_age array<struct<path: string, lines: bigint, newest_age_days: bigint, median_age_days: bigint, p90_age_days: bigint, oldest_age_days: bigint>>, "
    "blame_skips array<struct<path: string, reason: string, cost: bigint, budget: bigint>>, "
    "events array<struct<sha: string, ts: bigint, author: string, mechanical: boolean, changes: array<struct<path: string, type: string, old_path: string, added: bigint, deleted: bigint>>>>"
)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row; an error unless it is a document of this version."""
    df = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    rows = df.select("meta").take(2)
    if len(rows) != 1 or rows[0].meta is None:
        raise SourceError(f"{path} is no exported document")
    if rows[0].meta.schema_version != SCHEMA_VERSION:
        raise SourceError(f"{path} has schema version {rows[0].meta.schema_version}, not {SCHEMA_VERSION}")
    return df


def part(document: DataFrame, name: str) -> DataFrame:
    """A list of the document as rows."""
    return document.selectExpr(f"inline({name})")


def query(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """SQL over the named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
