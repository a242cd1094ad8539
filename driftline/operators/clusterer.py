"""A density clusterer that can be stored, and gives new vectors the cluster they fall into.

Stored are the distinct training vectors with their core distances and their lowest node of the condensed tree, and the tree
itself. A new vector reaches the hierarchy at the distance of its nearest training vector by mutual reachability,
``max(core of the new one, core of the other, distance)``; from that one's node it climbs past every node that has joined its
parent below this distance. The label that the node reached lies in is its cluster, or -1.

Of equally near ones the vector counts whose own ``max(core, distance)`` is least, then the lowest number. A vector equal to a
training vector is taken as that one, so training vectors get their own labels. Strength is the least core distance in the
cluster over the distance of entry, at most 1; 0 for noise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.vectors import distances
from driftline.operators import density
from driftline.operators.neighbours import SLACK, BlockIndex, exact_distance
from driftline.session import materialise


def _meet(k: int):
    """Kernel: per query the distances of its ``k`` nearest rows with their copies, and the best training vector. A query that
    equals a training vector is settled when it meets that one."""
    def start(q: dict, p: dict):
        size, limit = len(q["n"]), np.array(q["bound"], dtype=np.float64)
        d_of, m_of = np.full((size, k), np.inf), np.zeros((size, k), dtype=np.int64)
        best: dict[int, tuple] = {}
        light = np.full(size, np.inf)

        def compare(at: np.ndarray, rows: np.ndarray) -> None:
            n, m, core, node, v = (p[x][rows] for x in ("n", "m", "core", "node", "v"))
            d = distances(q["v"][at], v)
            reach = np.maximum(d, core[None, :])
            near, soon = d.min(axis=1), reach.min(axis=1)
            for i in np.flatnonzero((near <= np.minimum(limit[at], d_of[at, -1]) + SLACK) | (soon <= np.minimum(limit[at], light[at]) + SLACK)):
                a = at[i]
                c = np.flatnonzero(d[i] <= d_of[a, -1] + SLACK)
                if len(c) > k:
                    c = c[d[i, c] <= np.partition(d[i, c], k - 1)[k - 1] + 2 * SLACK]
                e, copies = np.r_[d_of[a], exact_distance(q["v"][a], v[c])], np.r_[m_of[a], m[c]]
                o = np.argsort(e, kind="stable")[:k]
                d_of[a], m_of[a] = e[o], copies[o]
                h = np.flatnonzero((reach[i] <= soon[i] + SLACK) | (d[i] <= SLACK))
                x = exact_distance(q["v"][a], v[h])
                g = np.maximum(x, core[h])
                b = np.lexsort((n[h], g, x > 0))[0]
                mine = (bool(x[b] > 0), float(g[b]), int(n[h[b]]), int(node[h[b]]), float(core[h[b]]))
                best[a] = min(best[a], mine) if a in best else mine
                light[a] = best[a][1]
                limit[a] = min(limit[a], max(d_of[a, -1], light[a])) if best[a][0] else -1.0

        def result() -> pa.Table:
            at = np.array(sorted(best), dtype=np.int64)
            there = np.isfinite(d_of[at])
            near = pa.StructArray.from_arrays([pa.array(d_of[at][there]), pa.array(m_of[at][there])], names=["d", "m"])
            ends = np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32)
            kinds = (pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
            found = pa.StructArray.from_arrays([pa.array([best[a][j] for a in at], t) for j, t in enumerate(kinds)], names=["other", "g", "n", "node", "core"])
            return pa.table({"n": pa.array(q["n"][at], pa.int64()), "near": pa.ListArray.from_arrays(pa.array(ends), near), "best": found})
        return (lambda at: limit[at]), compare, result
    return start


FOUND = "n long, near array<struct<d:double,m:bigint>>, best struct<other:boolean,g:double,n:bigint,node:bigint,core:double>"


@dataclass
class Clusterer:
    """``vertices`` and ``tree`` as in ``density.Clusters``; ``min_samples`` as it was fitted."""

    vertices: DataFrame
    tree: DataFrame
    min_samples: int

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, vec_col: str, min_cluster_size: int = 35, min_samples: int = 4, epsilon: float = 0.25,
            **how) -> Clusterer:
        found = density.find_clusters(df, id_col, vec_col, min_cluster_size, min_samples, epsilon, **how)
        return cls(found.vertices, materialise(found.tree), min_samples)

    def labels(self, df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        """(id, cluster) of the training rows."""
        return density.labels_of(df, id_col, vec_col, density.Clusters(self.vertices, self.tree, 0))

    def save(self, path: str) -> None:
        spark = self.vertices.sparkSession
        self.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
        self.tree.write.mode("overwrite").parquet(f"{path}/tree")
        spark.createDataFrame([(self.min_samples,)], "min_samples int").write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Clusterer:
        read = lambda part: spark.read.parquet(f"{path}/{part}")
        return cls(read("vertices"), read("tree"), spark.read.schema("min_samples int").json(f"{path}/settings").first()[0])

    def entries(self, queries: DataFrame, block_rows: int = 2048) -> DataFrame:
        """(n, node, reach): through which node, and at which distance, each query (n, v) enters the hierarchy.

        The cell with the nearest pivot gives first bounds, and it holds the training vector that a query equals. What is left
        open is searched in all blocks that may hold one of the nearest rows or a training vector that is reached sooner.
        """
        k = self.min_samples
        count = self.vertices.count()
        index = BlockIndex.build(self.vertices.select("n", "m", "v"), count, block_rows)
        points = materialise(index.points.join(self.vertices.select("n", "core", "node"), "n").select("n", "m", "v", "block", "core", "node"))
        first = index.search(index.targets(queries.withColumn("bound", F.lit(float("inf"))), nearest_only=True), points, _meet(k), FOUND,
                             lambda found: self._joined(found, k))  # a cell may lie in two groups
        rows = F.aggregate("near", F.lit(0).cast("long"), lambda a, x: a + x["m"])
        far = F.when(rows >= k, F.greatest(F.element_at("near", -1)["d"], F.col("best.g"))).otherwise(F.lit(float("inf")))
        first = first.withColumn("bound", far)
        equal = first.where(~F.col("best.other")).select("n", F.col("best.node").alias("node"), F.greatest("best.core", "best.g").alias("reach"))
        seen = materialise(queries.join(first.where("best.other").select("n", "bound"), "n"))
        # the first cell is searched once more with the others: it is one of many
        found = index.search(index.targets(seen), points, _meet(k), FOUND, lambda found: self._joined(found, k))
        if found is None:
            return equal
        own = F.aggregate("near", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("core")), lambda a, x: F.struct(
            (a["seen"] + x["m"]).alias("seen"), F.when(a["seen"] < k, x["d"]).otherwise(a["core"]).alias("core")), lambda a: a["core"])
        core = F.when(F.col("best.other"), own).otherwise(F.col("best.core"))
        return equal.unionByName(found.select("n", F.col("best.node").alias("node"), F.greatest(core, F.col("best.g")).alias("reach")))

    @staticmethod
    def _joined(found: DataFrame, k: int) -> DataFrame:
        """(n, near, best) of each query over all groups it was sent to."""
        return found.groupBy("n").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"),
                                      F.min(F.struct("best.other", "best.g", "best.n", "best.node", "best.core")).alias("best"))

    def climb(self, entered: DataFrame) -> DataFrame:
        """(n, node, reach) with the node that holds ``reach``, by doubling steps: births grow upwards, so a stretch of nodes
        is passed when its highest one is."""
        steps = [self.tree.select("node", F.col("parent").alias("up"), F.col("birth").alias("top"))]
        while True:
            last = steps[-1]
            above = last.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
            longer = materialise(last.join(above, "up").select("node", F.col("up2").alias("up"), F.col("top2").alias("top")))
            if longer.isEmpty():
                break
            steps.append(longer)
        at = entered
        for step in reversed(steps):
            passed = F.col("top").isNotNull() & (F.col("reach") > F.col("top"))
            at = at.join(step, "node", "left").select("n", F.when(passed, F.col("up")).otherwise(F.col("node")).alias("node"), "reach")
        return at

    def assign(self, new: DataFrame, id_col: str, vec_col: str, block_rows: int = 2048) -> DataFrame:
        """(id, cluster, strength) of new vectors; equal ones are looked up once. A null vector is noise."""
        rows = new.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        distinct = materialise(rows.where("v IS NOT NULL").select("v").distinct().withColumn("n", F.monotonically_increasing_id()))
        noise = F.lit(-1).alias("cluster"), F.lit(0.0).alias("strength")
        if distinct.isEmpty() or self.vertices.isEmpty():
            return rows.select(F.col("id").alias(id_col), *noise)
        at = self.climb(self.entries(distinct, block_rows))
        least = self.vertices.where("cluster >= 0").groupBy("cluster").agg(F.min("core").alias("least"))
        tiny = F.lit(density.LEAST_DISTANCE)
        strength = F.greatest("least", tiny) / F.greatest("reach", "least", tiny)
        given = (at.join(self.tree.select("node", "cluster"), "node", "left").join(least, "cluster", "left")
                 .select("n", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.when(F.col("least").isNotNull(), strength).otherwise(0.0).alias("strength")))
        found = distinct.join(given, "n").select("v", "cluster", "strength")
        return rows.join(found, "v", "left").select(
            F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
