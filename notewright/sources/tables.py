"""Tabular files: JSON lines, CSV, token-id rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _is_list(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.ArrayType)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header and no index; lists become ``", "``-joined text."""
    flat = [F.array_join(f.name, ", ").alias(f.name) if _is_list(f) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV by explicit schema; list columns are split again."""
    fields = T.StructType.fromDDL(schema).fields
    flat = T.StructType([T.StructField(f.name, T.StringType() if _is_list(f) else f.dataType) for f in fields])
    rows = spark.read.schema(flat).option("header", True).csv(path)
    return rows.select(*[F.split(f.name, ", ").alias(f.name) if _is_list(f) else F.col(f.name) for f in fields])


def write_token_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").parquet(path)


def read_token_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
