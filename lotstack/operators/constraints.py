"""What a relational store would enforce: unique keys, foreign keys, membership. Also insert-if-absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(table: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once, with their counts."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key is set but not found."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def members(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows with `is_valid`: whether the column is one of the names, whatever its case."""
    return rows.withColumn("is_valid", F.coalesce(F.upper(F.col(column)).isin(*(a.upper() for a in allowed)), F.lit(False)))


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`table` with those of `rows` whose key it lacks; of rows with equal keys, one."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))
