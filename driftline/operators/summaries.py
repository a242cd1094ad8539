"""Scalar summaries of traces and of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.arrays import mean_of
from driftline.operators.profile import quantiles
from driftline.operators.traces import GapRule, locate, traces

MEDIAN_IN_TASK = 1_000_000


def trace_summary(df: DataFrame, rule: GapRule, measures: dict[str, str], min_duration_us: int = 0,
                  in_task: int = MEDIAN_IN_TASK) -> DataFrame:
    """Mean, standard deviation, extremes and exact median of each measure per trace.

    ``measures`` maps a point column to the prefix of its summary columns. The median of a trace up to ``in_task``
    points is an ordinary aggregate; longer traces get theirs from ranged order statistics.
    """
    pts = locate(df.select(*dict.fromkeys([rule.entity, rule.ts, *rule.tiebreak, *measures])), rule, min_duration_us)
    key = [rule.entity, "trace_no"]

    def stats(d: DataFrame, median: bool) -> DataFrame:
        e = []
        for c, p in measures.items():
            v = F.col(c).cast("double")
            e += [F.avg(v).alias(f"{p}_mean"), F.stddev(v).alias(f"{p}_std"), F.min(c).alias(f"{p}_min"),
                  F.max(c).alias(f"{p}_max")]
            if median:
                e.append(F.percentile(v, F.lit(0.5)).alias(f"{p}_median"))
        return d.groupBy(*key).agg(
            F.first("start_us").alias("start_us"), F.first("end_us").alias("end_us"),
            F.first("point_count").alias("point_count"), *e)

    out = stats(pts.filter(F.col("point_count") <= in_task), True)
    # counted on trace rows; the second branch is planned only where a trace is that long
    if not traces(df, rule).filter(F.col("point_count") > in_task).isEmpty():
        long = pts.filter(F.col("point_count") > in_task)
        med = quantiles(long, key, list(measures), [0.5]).groupBy(*key).agg(
            *[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(f"{p}_median")
              for c, p in measures.items()])
        out = out.unionByName(stats(long, False).join(med, key, "left").select(*out.columns))
    return out.withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def cluster_sizes(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def cluster_overview(labelled: DataFrame, cluster: str = "cluster", noise: int = -1) -> DataFrame:
    """Number of clusters, noise rows and noise share."""
    sizes = cluster_sizes(labelled, cluster)
    noisy = F.coalesce(F.sum(F.when(F.col(cluster) == noise, F.col("n"))), F.lit(0))
    return sizes.agg(F.count_if(F.col(cluster) != noise).alias("clusters"), noisy.alias("noise_rows"),
                     F.round(F.try_divide(F.lit(100.0) * noisy, F.sum("n")), 2).alias("noise_percentage"))


def cluster_characteristics(wins: DataFrame, labels: DataFrame, id_col: str, arrays: dict[str, str],
                            duration: str | None = "duration_us", cluster: str = "cluster",
                            noise: int = -1) -> DataFrame:
    """Mean of the per-window means of each array column, and mean duration, per cluster without noise."""
    per = wins.select(id_col, *([F.col(duration)] if duration else []),
                      *[mean_of(F.col(a)).alias(f"_{a}") for a in arrays])
    j = labels.select(id_col, cluster).filter(F.col(cluster) != noise).join(per, id_col)
    return j.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"_{a}").alias(name) for a, name in arrays.items()],
        *([F.avg(duration).alias("mean_duration_us")] if duration else []))
