"""Tables in and out: parquet, catalog, JDBC, JSON reports, and layouts partitioned by id prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.clean import keep_last
from driftline.session import materialise


def read_table(spark: SparkSession, name: str, jdbc: dict[str, str] | None = None,
               split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A catalog table, a parquet path, or with ``jdbc`` options a database table.

    ``split`` (column, lower, upper, partitions) reads the database in parallel ranges.
    """
    if jdbc is not None:
        options = {"dbtable": name, "fetchsize": "10000", **jdbc}
        if split:
            col, low, high, n = split
            options |= {"partitionColumn": col, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
        return spark.read.format("jdbc").options(**options).load()
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def write_parquet(df: DataFrame, path: str, max_records: int = 0) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", max_records).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report has one row per table column, so it is written as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_partitioned(df: DataFrame, path: str, id_col: str, ts_col: str, digits: int = 2,
                      prefix_col: str = "hex_prefix", mode: str = "overwrite",
                      max_records: int = 5_000_000, partitions: int | None = None) -> DataFrame:
    """Write a table in folders by id prefix, ordered by id and time inside files; returns rows per prefix.

    Rows are placed by ranges of (prefix, id, time), so a prefix or id that holds a large part of the rows is spread
    over several tasks and files, while a small prefix still ends in one. Without ``partitions`` Spark sizes the
    ranges itself.
    """
    keyed = df.withColumn(prefix_col, F.substring(id_col, 1, digits))
    order = [prefix_col, id_col, ts_col]
    ranges = [partitions, *order] if partitions else order
    (keyed.repartitionByRange(*ranges).sortWithinPartitions(*order)
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records)
     .partitionBy(prefix_col).parquet(path))
    return keyed.groupBy(prefix_col).agg(F.count(F.lit(1)).alias("rows"))


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], order: list[str],
                      prefix_col: str = "hex_prefix") -> None:
    """Upsert into a partitioned table, reading and rewriting only the folders the incoming rows belong to.

    The table keeps its columns: one that the incoming rows lack stays as stored, NULL on new keys; one that only they
    have is added, NULL on old rows. The merged rows are written to the shared scratch folder before they replace the
    folders they were read from, so a failed run can be repeated from there and never reads what it overwrites.
    """
    latest = keep_last(incoming, keys, order)
    touched = [r[0] for r in latest.select(prefix_col).distinct().collect()]  # at most one per folder
    stored = spark.read.option("mergeSchema", "true").parquet(path).schema
    named = set(stored.names)
    old = (spark.read.schema(stored).parquet(path).withColumn(prefix_col, F.col(prefix_col).cast(incoming.schema[prefix_col].dataType))
           .filter(F.col(prefix_col).isin(touched)))
    lacking = [f.name for f in stored if f.name not in incoming.columns]
    if lacking:
        latest = latest.join(old.select(*keys, *lacking), keys, "left")
    added = [f for f in incoming.schema if f.name not in named]
    untouched = old.join(latest.select(*keys), keys, "left_anti").withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    columns = [c for c in (*stored.names, *[f.name for f in added]) if c != prefix_col] + [prefix_col]
    merged = materialise(untouched.select(*columns).unionByName(latest.select(*columns)))
    (merged.repartitionByRange(prefix_col, *keys).sortWithinPartitions(prefix_col, *keys)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(prefix_col).parquet(path))


def write_jdbc(df: DataFrame, name: str, jdbc: dict[str, str], mode: str = "append") -> None:
    df.write.format("jdbc").options(dbtable=name, batchsize="10000", **jdbc).mode(mode).save()
