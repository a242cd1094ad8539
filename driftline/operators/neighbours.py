"""Exact neighbour search over blocks of vectors.

Vectors are placed with their nearest pivot, and crowded cells are split at random, so a block never exceeds the row
limit however many vectors lie close together. A block is searched for a query only if the triangle inequality and, in few
dimensions, the box around it allow it to hold something closer than the query's current bound.

Blocks are sent in groups: a query goes once to each group that holds a block it needs. Pivots are numbered so that those of a
group lie side by side, and each vector meets its own group first: what it finds there bounds most of the others out. In a
task, queries that lie close together meet small leaves of the blocks, nearest box first, as long as a box lies within the
bound of one of them. Of a group only what a query has found in all of it leaves the task. So what moves grows with
queries times the groups around them, and not with queries times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.vectors import distances, stack
from driftline.session import discard, materialise

MAX_PIVOTS = 1024
SLICE = 256  # query rows for which blocks are chosen at once
LEAF = 128  # rows in a box inside a task
NEAR = 128  # queries that meet boxes together
MEET_ROWS = 2048  # rows of boxes compared at once
OUT_ROWS = 8192  # rows of a batch given back
BOX_DIMS = 16  # in more, boxes of whole blocks say little
GROUP_NUMBERS = 1 << 23  # components held in a group of blocks or a share of queries
SLACK = 1e-7  # distances in the product form are off by less


def arrays(table: pa.Table) -> dict[str, np.ndarray]:
    """Columns as arrays; a column of vectors of one length as a matrix, without a copy of each vector."""
    out = {}
    for name, col in zip(table.column_names, table.columns):
        col = col.combine_chunks()
        if pa.types.is_list(col.type):
            out[name] = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1 if len(col) else 0)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def leaves(v: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in parts of at most ``size`` that lie close together, neighbours side by side: halves along the widest axis."""
    out, left = [], [np.arange(len(v))]
    while left:
        rows = left.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        axis, half = int(v[rows].std(axis=0).argmax()), len(rows) // 2
        order = np.argpartition(v[rows, axis], half)
        left += [rows[order[half:]], rows[order[:half]]]
    return out


def gaps(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Distances between boxes [low, high] and [least, most], less than those of any rows in them."""
    return np.maximum(np.sqrt((np.maximum(np.maximum(low - most, least - high), 0.0) ** 2).sum(axis=-1)) - SLACK, 0.0)


def meet(q: dict, p: dict, functions: tuple, pivots: np.ndarray, cell: np.ndarray, radius: np.ndarray, allowed: Callable | None = None) -> pa.Table:
    """The result of a kernel over queries and points of whole blocks: queries that lie close together meet the leaves that may
    hold something within the bound of one of them, nearest first."""
    bound, compare, result = functions
    if not len(q["n"]) or not len(p["n"]):
        return result()
    order = np.argsort(p["block"], kind="stable")
    blocks, start = np.unique(p["block"][order], return_index=True)
    parts, of = [], []
    for b, rows in enumerate(np.split(order, start[1:])):
        boxes = [rows[x] for x in leaves(p["v"][rows], LEAF)]
        parts += boxes
        of += [b] * len(boxes)
    of = np.array(of)
    least, most = (np.array([f(p["v"][x]) for x in parts]) for f in (lambda v: v.min(axis=0), lambda v: v.max(axis=0)))
    of_cell = cell[blocks]
    for at in leaves(q["v"], NEAR):
        v = q["v"][at]
        far = (distances(v, pivots[of_cell]) - radius[blocks] - SLACK).min(axis=0)
        near = np.maximum(gaps(least, most, v.min(axis=0), v.max(axis=0)), far[of])
        use = (q["only"][at, None] < 0) | (q["only"][at, None] == of_cell)
        if allowed is not None:
            use &= allowed({c: x[at] for c, x in q.items() if c != "v"}, blocks)
        whole = use.all(axis=0)[of]
        near[~use.any(axis=0)[of]] = np.inf
        left = np.argsort(near, kind="stable")
        i, step = 0, 2
        while i < len(left):
            limit = bound(at)
            some = left[i:i + step]
            some = some[(near[some] <= limit.max()) & np.isfinite(near[some])]
            if not len(some):
                break
            i, step = i + step, min(2 * step, MEET_ROWS // LEAF)
            full = some[whole[some]]
            if len(full):
                compare(at[near[full].min() <= limit], np.concatenate([parts[j] for j in full]))
            some = some[~whole[some]]
            for b in np.unique(of[some]):
                mine = some[of[some] == b]
                hit = use[:, b] & (near[mine].min() <= limit)
                if hit.any():
                    compare(at[hit], np.concatenate([parts[j] for j in mine]))
    return result()


@dataclass
class BlockIndex:
    """``points`` (n, m, v, cell, block) on Spark; pivots and one entry per block on the driver: its cell, its radius, the
    group that it is sent with and, in few dimensions, its box. A group has about ``group_rows`` rows."""

    points: DataFrame
    pivots: Broadcast
    cell: np.ndarray
    radius: np.ndarray
    group: np.ndarray
    group_rows: int
    box: np.ndarray | None = None

    @classmethod
    def build(cls, pts: DataFrame, count: int, block_rows: int, group_rows: int | None = None) -> BlockIndex:
        spark = pts.sparkSession
        k = max(1, min(MAX_PIVOTS, -(-count // block_rows)))
        picked = pts.orderBy(F.xxhash64("n"), "n").limit(k).select("v").collect()  # at most MAX_PIVOTS vectors
        chosen = np.array([r["v"] for r in picked], dtype=np.float64)
        pivots = spark.sparkContext.broadcast(chosen[np.concatenate(leaves(chosen, 1))] if picked else chosen)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                d = distances(stack(pdf["v"]), pivots.value)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), r=d[np.arange(len(d)), cell])

        placed = materialise(pts.mapInPandas(place, "n long, m long, v array<double>, cell int, r double"))
        sizes = {r["cell"]: r["c"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).collect()}
        parts = [max(1, -(-sizes.get(i, 0) // block_rows)) for i in range(k)]
        first = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(int).tolist()
        block = F.get(F.lit(first), "cell") + F.pmod(F.xxhash64("n"), F.get(F.lit(parts), "cell"))
        points = materialise(placed.withColumn("block", block.cast("int")))
        discard(placed)
        radius, rows = np.full(sum(parts), -np.inf), np.zeros(sum(parts), dtype=np.int64)
        dim = len(picked[0]["v"]) if picked else 0
        axes = range(dim if dim <= BOX_DIMS else 0)
        box = np.full((2, len(rows), len(axes)), np.inf)  # no row lies in an empty block
        ends = [f(F.get("v", F.lit(i))).alias(f"{x}{i}") for x, f in (("l", F.min), ("h", F.max)) for i in axes]
        for r in points.groupBy("block").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("c"), *ends).collect():  # one row per block
            radius[r["block"]], rows[r["block"]] = r["r"], r["c"]
            box[:, r["block"]] = [[r[f"{x}{i}"] for i in axes] for x in "lh"]
        if group_rows is None:
            # four groups a core, more where memory asks for it
            side = 4 * spark.sparkContext.defaultParallelism
            group_rows = max(block_rows, min(-(-count // side), GROUP_NUMBERS // max(1, dim)))
        group = (np.cumsum(rows) - rows) // group_rows
        return cls(points.drop("r"), pivots, np.repeat(np.arange(k), parts), radius, group, group_rows, box if len(axes) else None)

    def targets(self, queries: DataFrame, allowed: Callable | None = None, nearest_only: bool = False) -> DataFrame:
        """Append ``targets``, the groups to search for each query (n, v, bound, ..), and ``only``, the one cell to search there
        or -1 for all.

        ``allowed(columns, blocks)`` may clear further entries of the query x block matrix. ``nearest_only`` keeps the
        blocks of the cell with the nearest pivot.
        """
        pivots, cell, radius, group, box = self.pivots, self.cell, self.radius, self.group, self.box
        blocks = np.arange(len(cell))

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for i in range(0, len(whole), SLICE):
                    pdf = whole.iloc[i:i + SLICE]
                    v = stack(pdf["v"])
                    far = distances(v, pivots.value)[:, cell]
                    near = np.maximum(far - radius - SLACK, 0.0)
                    if box is not None:
                        near = np.maximum(near, gaps(box[0], box[1], v[:, None], v[:, None]))
                    hits = (near <= pdf["bound"].to_numpy()[:, None]) & np.isfinite(radius)
                    if allowed is not None:
                        hits &= allowed({c: pdf[c].to_numpy() for c in pdf.columns if c != "v"}, blocks)
                    only = np.full(len(pdf), -1)
                    if nearest_only:
                        only = cell[np.where(hits, far, np.inf).argmin(axis=1)]
                        hits &= only[:, None] == cell
                    yield pdf.assign(targets=[np.unique(group[h]).astype(np.int32) for h in hits], only=only.astype(np.int32))

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        return queries.mapInPandas(choose, f"{schema}, targets array<int>, only int")

    def search(self, queries: DataFrame, points: DataFrame, kernel: Callable, schema: str, reduce: Callable, allowed: Callable | None = None) -> DataFrame | None:
        """Compare every query with the blocks of its groups that its bound and ``allowed`` leave, and write down ``reduce`` of
        what the groups give. None when no block is wanted.

        ``kernel(queries, points)`` has the columns of a share of queries and of a group as arrays and gives three functions:
        the present bounds of some queries, the comparison of some queries with the points of a block, and the result.
        A group with many queries serves them in shares of bounded size, so no task grows with the data.
        """
        queries = materialise(queries)
        wanted = {r["g"]: r["c"] for r in queries.select(F.explode("targets").alias("g"))
                  .groupBy("g").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row per group
        if not wanted:
            return None
        pivots, cell, radius, group = self.pivots, self.cell, self.radius, self.group

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            q, p = arrays(left), {c[2:]: x for c, x in arrays(right).items()}
            return meet(q, p, kernel(q, p), pivots.value, cell, radius, allowed)

        count = max(int(group.max()) + 1, 1)
        shares = F.lit([-(-wanted.get(g, 0) // self.group_rows) for g in range(count)])
        left = queries.withColumn("group", F.explode("targets")).drop("targets")
        left = left.withColumn("share", F.pmod(F.xxhash64("n"), F.get(shares, F.col("group"))).cast("int"))
        own = points.withColumn("group", F.get(F.lit([int(g) for g in group]), F.col("block")))
        right = own.filter(F.get(shares, F.col("group")) > 0).withColumn(
            "share", F.explode(F.sequence(F.lit(0), F.get(shares, F.col("group")) - 1)))
        right = right.toDF(*[f"p_{c}" for c in right.columns])
        found = materialise(reduce(left.groupBy("group", "share").cogroup(right.groupBy("p_group", "p_share")).applyInArrow(run, schema)))
        discard(queries)
        return found


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise distances, the same to the last bit wherever a pair is met."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


class Squares:
    """Squares of distances from queries to points, in floats where they can hold them, off by less than ``loss`` of the query: they
    choose the pairs whose distances are then taken exactly."""

    def __init__(self, q: np.ndarray, p: np.ndarray):
        centre = p.mean(axis=0) if len(p) else 0.0
        a, b = q - centre, p - centre
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        kind = np.float32 if 1e-20 < aa.max(initial=0.0) + bb.max(initial=0.0) < 1e30 else np.float64
        self.loss = (6e-7 * (a.shape[1] + 8) * (aa + bb.max(initial=0.0))).astype(kind)
        self.left = np.c_[-2.0 * a, aa, np.ones(len(a))].astype(kind)
        self.right = np.c_[b, np.ones(len(b)), bb].astype(kind)

    def __call__(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.left[at] @ self.right[rows].T

    def most(self, distance: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the squares of pairs within ``distance`` do not exceed."""
        return (distance ** 2).astype(self.loss.dtype) + self.loss[at]


NEIGHBOUR = "array<struct<d:double,n:bigint,m:bigint>>"


def _nearer(k: int, every: bool = False):
    """Kernel: per query the ``k`` nearest points within its bound, other than itself, nearest first, the lower number first
    among equals; with ``every`` also of the queries that found none."""
    def start(q: dict, p: dict):
        size, limit = len(q["n"]), np.array(q["bound"], dtype=np.float64)
        d_of, n_of, m_of = np.full((size, k), np.inf), np.full((size, k), -1), np.zeros((size, k), dtype=np.int64)
        squares = Squares(q["v"], p["v"])

        def compare(at: np.ndarray, rows: np.ndarray) -> None:
            sq = squares(at, rows)
            most = squares.most(limit[at], at)
            found = np.flatnonzero(sq <= most[:, None])
            if len(found) > 4 * k * len(at) and len(rows) > k:  # one more, as the query itself may be among them
                most = np.minimum(most, np.partition(sq, k, axis=1)[:, k] + squares.loss[at] * 2)
                found = np.flatnonzero(sq <= most[:, None])
            i, j = np.divmod(found, len(rows))
            of, to = at[i], rows[j]
            d = exact_distance(q["v"][of], p["v"][to])
            ok = (d <= limit[of]) & (q["n"][of] != p["n"][to])
            if not ok.any():
                return
            of, to, d = of[ok], to[ok], d[ok]
            touched = np.unique(of)
            key = np.r_[np.repeat(touched, k), of]
            d, n, m = (np.r_[x[touched].ravel(), y] for x, y in ((d_of, d), (n_of, p["n"][to]), (m_of, p["m"][to])))
            order = np.lexsort((n, d, key))
            best = order[np.searchsorted(key[order], touched)[:, None] + np.arange(k)]  # each key brings k places of its own
            d_of[touched], n_of[touched], m_of[touched] = d[best], n[best], m[best]
            limit[touched] = np.minimum(limit[touched], d_of[touched, -1])

        def result() -> pa.Table:
            there = np.isfinite(d_of)
            some = there.any(axis=1) | every
            near = pa.StructArray.from_arrays([pa.array(x[there]) for x in (d_of, n_of, m_of)], names=["d", "n", "m"])
            ends = np.r_[0, np.cumsum(there[some].sum(axis=1))].astype(np.int32)
            return pa.table({"n": pa.array(q["n"][some], pa.int64()), "m": pa.array(q["m"][some], pa.int64()), "near": pa.ListArray.from_arrays(pa.array(ends), near)})
        return (lambda at: limit[at]), compare, result
    return start


def nearest_neighbours(index: BlockIndex, k: int) -> DataFrame:
    """(n, m, near) with the exact k nearest other points of every point.

    The own group gives a first bound; other groups are searched only where they may beat it.
    """
    pivots, cell, radius, group = index.pivots, index.cell, index.radius, index.group

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = list(batches)  # a group
        if part:
            part = pa.Table.from_batches(part)
            x = arrays(part)
            x |= {"bound": np.full(len(part), np.inf), "only": np.full(len(part), -1)}
            found = meet(x, x, _nearer(k, True)(x, x), pivots.value, cell, radius)
            yield from found.append_column("v", part.column("v")).append_column("block", part.column("block")).to_batches(OUT_ROWS)

    number = F.get(F.lit([int(g) for g in group]), F.col("block")).cast("int")
    grouped = index.points.repartitionById(int(group.max(initial=0)) + 1, number).select("n", "m", "v", "block")
    first = materialise(grouped.mapInArrow(own, f"n long, m long, near {NEIGHBOUR}, v array<double>, block int").withColumn(
        "bound", F.when(F.size("near") == k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))))
    if len(np.unique(group)) == 1:
        return first.select("n", "m", "near")
    foreign = lambda q, blocks: group[q["block"]][:, None] != group[blocks]
    queries = index.targets(first.select("n", "m", "v", "block", "bound"), foreign)
    # per point at most k entries from each group searched
    best = lambda more: (first.select("n", "m", "near").unionByName(more).groupBy("n", "m")
                         .agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")))
    points = index.points.select("n", "m", "v", "block")
    found = index.search(queries, points, _nearer(k), f"n long, m long, near {NEIGHBOUR}", best, foreign)
    if found is None:
        return first.select("n", "m", "near")
    discard(first)
    return found
