"""Readers and writers of artifacts; keyed writes are plans of ``operators.reconcile``, written to a new folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_artifacts(spark: SparkSession, path: str, schema: T.StructType | str, version: str) -> DataFrame:
    """JSON artifacts with ``accepted``: their schema_version is the asked one and the row could be read."""
    base = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    full = T.StructType([*base.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("accepted", F.col("schema_version").eqNullSafe(version) & F.col("_corrupt").isNull()).drop("_corrupt")


def read_curated(spark: SparkSession, path: str, schema: T.StructType | str, statuses: Sequence[str] | None = None) -> DataFrame:
    """A curated JSON list, of the given statuses only."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.where(F.col("status").isin(*statuses)) if statuses else rows


def read_review_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Review rows as trimmed strings; a byte order mark is dropped, empty cells are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"', enforceSchema=True)
    return rows.select(*(F.nullif(F.trim(F.replace(F.col(c), F.lit("﻿"))), F.lit("")).alias(c) for c in columns))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A whole table to a new folder; an existing one is refused."""
    df.write.mode("error").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """S16."""
    df.write.mode("error").option("ignoreNullFields", False).json(path)
