"""The most typical and the most extreme member of each cluster, by mean distance to all members.

A cluster that fits one task is compared there. In a larger one, members are first sorted out by exact bounds from the
cluster's moments: the mean distance of x to all members is at least |x - mean| and at most
sqrt(|x - mean|^2 + variance). Only members that can still be smallest or largest are compared with every member,
block against block; just one sum per candidate and block leaves a task. Which clusters are large and how large a block
is are two things: a block holds as many rows as a task's memory allows, since each row is sent once per block facing it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.vectors import distances, stack
from driftline.session import broadcast_if_small

TIE_DIGITS = 9  # mean distances that agree to this many digits count as equal; the lower id then wins
BLOCK_NUMBERS = 1 << 20  # components held in a block of rows
BLOCK_ROWS = 16384
SLICE = 256  # rows of a block compared with the other block at once


def _means_in_task(metric: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = stack(pdf["v"])
        mean = np.empty(len(x))
        for i in range(0, len(x), 1024):
            d = distances(x[i:i + 1024], x, metric)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = 0.0
            mean[i:i + 1024] = d.mean(axis=1)
        mean = mean.round(TIE_DIGITS)
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[[0]].to_numpy(),
                             "typical": [pdf["id"].iloc[int(mean.argmin())]],
                             "extreme": [pdf["id"].iloc[int(mean.argmax())]]})
    return run


def _sums_by_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the Manhattan distances from each row of ``x`` to all rows of ``y``, a dimension at a time: of the sorted values
    those below x_j add x_j less their sum, those above it their sum less x_j."""
    out, n = np.zeros(len(x)), len(y)
    for j in range(x.shape[1]):
        centre = y[:, j].mean()  # smaller numbers lose less in the running sums
        a, b = x[:, j] - centre, np.sort(y[:, j] - centre)
        upto = np.r_[0.0, np.cumsum(b)]
        order = np.argsort(a)
        below = np.empty(len(a), dtype=np.int64)
        below[order] = np.searchsorted(b, a[order])
        out += a * (2 * below - n) + upto[-1] - 2.0 * upto[below]
    return out


def _block_sums(metric: str):
    def run(cand: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if cand.empty or block.empty:
            return pd.DataFrame({"cluster": [], "id": [], "total": []})
        x, y = stack(cand["v"]), stack(block["v"])
        if metric == "manhattan" and np.isfinite(y).all():
            total = _sums_by_order(x, y)
        else:
            total, own, other = np.empty(len(x)), cand["id"].to_numpy(), block["id"].to_numpy()
            for i in range(0, len(x), SLICE):
                d = distances(x[i:i + SLICE], y, metric)
                d[own[i:i + SLICE, None] == other[None, :]] = 0.0
                total[i:i + SLICE] = d.sum(axis=1)
        return pd.DataFrame({"cluster": cand["cluster"], "id": cand["id"], "total": total})
    return run


def _bounds(metric: str) -> tuple[Column, Column]:
    """(lower, upper) bound of the mean distance from the columns v, centre and spread."""
    if metric == "euclidean":
        sq = F.aggregate(F.zip_with("v", "centre", lambda a, c: (a - c) * (a - c)), F.lit(0.0), lambda s, e: s + e)
        total = F.aggregate("spread", F.lit(0.0), lambda s, e: s + e)
        return F.sqrt(sq), F.sqrt(sq + total)
    off = F.zip_with("v", "centre", lambda a, c: F.abs(a - c))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, e: s + e)
    return add(off), add(F.zip_with(off, "spread", lambda o, s: F.sqrt(o * o + s)))


def _large(pts: DataFrame, sizes: DataFrame, n_large: int, metric: str, block_rows: int, dim: int,
           schema: str) -> DataFrame:
    vec = array_to_vector("v")
    moments = pts.groupBy("cluster").agg(
        Summarizer.metrics("mean", "variance", "count").summary(vec).alias("m"))
    n = F.col("m.count")
    moments = moments.select("cluster", vector_to_array("m.mean").alias("centre"), F.transform(
        vector_to_array("m.variance"), lambda s: s * (n - 1) / n).alias("spread"))
    low, high = _bounds(metric)
    bounded = (pts.join(broadcast_if_small(moments, n_large, 16 * dim), "cluster")
               .withColumns({"low": low, "high": high}).drop("centre", "spread"))
    limits = bounded.groupBy("cluster").agg(F.min("high").alias("least"), F.max("low").alias("most"))
    slack = 1.0 + 1e-9
    cand = (bounded.join(broadcast_if_small(limits, n_large, 24), "cluster")
            .filter((F.col("low") <= F.col("least") * slack) | (F.col("high") * slack >= F.col("most")))
            .select("cluster", "id", "v"))
    per = lambda c: F.ceil(F.col(c) / F.lit(block_rows)).cast("int")
    plan = (sizes.join(cand.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cand")), "cluster")
            .select("cluster", "n", per("n").alias("blocks"), per("n_cand").alias("chunks")))
    plan = broadcast_if_small(plan, n_large, 32)
    own = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = cand.join(plan, "cluster").select("cluster", "id", "v", own("chunks").alias("chunk"), every("blocks").alias("block"))
    right = pts.join(plan, "cluster").select("cluster", "id", "v", every("chunks").alias("chunk"), own("blocks").alias("block"))
    key = ["cluster", "chunk", "block"]
    cluster_t, id_t = schema.split(",")
    right = right.toDF("r_cluster", "id", "v", "r_chunk", "r_block")
    sums = left.groupBy(*key).cogroup(right.groupBy("r_cluster", "r_chunk", "r_block")).applyInPandas(
        _block_sums(metric), f"cluster {cluster_t}, id {id_t}, total double")
    mean = (sums.groupBy("cluster", "id").agg(F.sum("total").alias("total"))
            .join(broadcast_if_small(sizes, n_large, 16), "cluster")
            .withColumn("mean", F.round(F.col("total") / F.col("n"), TIE_DIGITS)))
    return mean.groupBy("cluster").agg(
        F.min_by("id", F.struct("mean", "id")).alias("typical"),
        F.min_by("id", F.struct((-F.col("mean")).alias("far"), F.col("id"))).alias("extreme"))


def find_exemplars(df: DataFrame, id_col: str, vec_col: str, cluster_col: str = "cluster", noise: int = -1,
                   metric: str = "euclidean", in_task: int = 4096, block_rows: int | None = None) -> DataFrame:
    """(cluster, typical id, extreme id) for clusters of two or more rows, without noise.

    A cluster of more than ``in_task`` rows is compared in blocks of ``block_rows``, or as many as hold ``BLOCK_NUMBERS``.
    """
    pts = df.filter(F.col(cluster_col) != noise).select(
        F.col(cluster_col).alias("cluster"), F.col(id_col).alias("id"),
        F.col(vec_col).cast("array<double>").alias("v"))
    schema = ",".join(pts.schema[c].dataType.simpleString() for c in ("cluster", "id"))
    cluster_t, id_t = schema.split(",")
    sizes = pts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    large = sizes.filter(F.col("n") > in_task)
    n_large = large.count()
    run = _means_in_task(metric)
    out_t = f"cluster {cluster_t}, typical {id_t}, extreme {id_t}"
    lone = lambda pdf: run(pdf) if len(pdf) > 1 else pd.DataFrame({"cluster": [], "typical": [], "extreme": []})
    if n_large == 0:
        return pts.groupBy("cluster").applyInPandas(lone, out_t)
    dim = pts.select(F.size("v")).first()[0]
    block_rows = block_rows or max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, dim)))
    hot = broadcast_if_small(large, n_large, 16)
    small = pts.join(hot, "cluster", "left_anti").groupBy("cluster").applyInPandas(lone, out_t)
    return small.unionByName(_large(pts.join(hot.select("cluster"), "cluster", "left_semi"), large, n_large, metric,
                                    block_rows, dim, schema))


def label_exemplars(labels: DataFrame, found: DataFrame, id_col: str, cluster_col: str = "cluster") -> DataFrame:
    """(id, cluster, is_most_typical, is_most_extreme) for every labelled row."""
    picks = found.select(F.explode(F.array(
        F.struct(F.col("typical").alias(id_col), F.lit(1).alias("t"), F.lit(0).alias("e")),
        F.struct(F.col("extreme").alias(id_col), F.lit(0).alias("t"), F.lit(1).alias("e")))).alias("p")).select("p.*")
    picks = picks.groupBy(id_col).agg(F.max("t").alias("t"), F.max("e").alias("e"))
    return labels.select(id_col, cluster_col).join(picks, id_col, "left").select(
        id_col, cluster_col, (F.coalesce("t", F.lit(0)) == 1).alias("is_most_typical"),
        (F.coalesce("e", F.lit(0)) == 1).alias("is_most_extreme"))
