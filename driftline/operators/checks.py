"""Assertions on tables. Each returns the offending rows or a figure; ``require`` turns a finding into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    pass


def require(found: DataFrame, message: str) -> None:
    """Fail if there is any offending row."""
    row = found.limit(1).collect()
    if row:
        raise CheckFailed(f"{message}: e.g. {row[0].asDict()}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def wrong_lengths(df: DataFrame, arrays: list[str], n: int | None = None) -> DataFrame:
    """Rows whose arrays are missing, unequal, or not ``n`` long."""
    want = F.lit(n) if n is not None else F.size(arrays[0])
    bad = F.lit(False)
    for a in arrays:
        bad = bad | F.col(a).isNull() | (F.size(a) != want)
    return df.filter(F.coalesce(bad, F.lit(True)))


def rows_with_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    bad = F.lit(False)
    for c in cols or df.columns:
        bad = bad | F.col(f"`{c}`").isNull()
    return df.filter(bad)


def join_size(left: DataFrame, joined: DataFrame, per_row: int = 50) -> DataFrame:
    """Expected and actual rows of a join that must give ``per_row`` rows per left row; empty when they agree."""
    want = left.agg((F.count(F.lit(1)) * per_row).alias("n"))
    have = joined.agg(F.count(F.lit(1)).alias("n"))
    tagged = want.withColumn("side", F.lit("expected")).unionByName(have.withColumn("side", F.lit("actual")))
    per = lambda s: F.max(F.when(F.col("side") == s, F.col("n")))
    return tagged.agg(per("expected").alias("expected"), per("actual").alias("actual")).filter(
        F.col("expected") != F.col("actual"))


def largest_difference(a: DataFrame, b: DataFrame, keys: list[str], col: str) -> DataFrame:
    j = a.select(*keys, F.col(col).alias("_a")).join(b.select(*keys, F.col(col).alias("_b")), keys)
    return j.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))


def exemplar_faults(labelled: DataFrame, cluster: str = "cluster", noise: int = -1) -> DataFrame:
    """Clusters of two or more rows without exactly one typical and one extreme row, and noise that has any."""
    per = labelled.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_most_typical").alias("typical"),
        F.count_if("is_most_extreme").alias("extreme"))
    want = F.when((F.col(cluster) == noise) | (F.col("n") < 2), 0).otherwise(1)
    return per.filter((F.col("typical") != want) | (F.col("extreme") != want))


def require_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise CheckFailed(f"missing columns: {missing}")
