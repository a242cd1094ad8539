"""Pairwise correlation of columns: Pearson, Spearman (average ranks) and Kendall tau-b."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.ordering import Blocks, block_count, value_blocks
from driftline.session import materialise

SCHEMA = "var_1 string, var_2 string, correlation double"


MOMENTS = "i int, j int, n double, mx double, my double, sxx double, syy double, sxy double, odd boolean"


def _moments(k: int):
    """Counts, means and centred sums of every pair of ``k`` columns over one task's rows where both are present."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, sums = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            here = np.column_stack([~np.asarray(c.is_null()) for c in batch.columns]).astype(float)
            nan = np.isnan(v) & (here > 0)
            v = np.where((here > 0) & ~nan, v, 0.0)
            if shift is None:  # sums of values near 0 keep their digits
                shift = v.sum(axis=0) / np.maximum(here.sum(axis=0), 1)
            v = (v - shift) * here
            part = np.stack([here.T @ here, v.T @ here, (v * v).T @ here, v.T @ v, nan.astype(float).T @ here])
            sums = part if sums is None else sums + part
        if sums is None:
            return
        n, sx, sxx, sxy, nan = sums
        rows = []
        for i in range(k):
            for j in range(i, k):
                c = n[i, j]
                if c:
                    mx, my = sx[i, j] / c, sx[j, i] / c
                    rows.append((i, j, c, mx + shift[i], my + shift[j], sxx[i, j] - c * mx * mx, sxx[j, i] - c * my * my,
                                 sxy[i, j] - c * mx * my, bool(nan[i, j] or nan[j, i])))
        if rows:
            names = [x.split()[0] for x in MOMENTS.split(", ")]
            kinds = [pa.int32()] * 2 + [pa.float64()] * 6 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
    return run


def pearson(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """Upper triangle with diagonal as rows, each pair over the rows where both are present.

    One pass without copying a row: each task reduces its rows to a few numbers per pair by matrix products, and these
    are merged. NaN gives NaN, a constant column NULL.
    """
    num = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # one small record per task and pair
    part = (num.mapInArrow(_moments(len(cols)), MOMENTS).groupBy("i", "j")
            .agg(F.collect_list(F.struct("n", "mx", "my", "sxx", "syy", "sxy")).alias("parts"), F.bool_or("odd").alias("odd")))
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda a, p: a + f(p))
    means = part.select("*", (total(lambda p: p.n * p.mx) / total(lambda p: p.n)).alias("_mx"), (total(lambda p: p.n * p.my) / total(lambda p: p.n)).alias("_my"))
    # around the common mean: inside each part, and of the parts' means
    around = lambda s, a, b: total(lambda p: p[s] + p.n * (p[f"m{a}"] - F.col(f"_m{a}")) * (p[f"m{b}"] - F.col(f"_m{b}")))
    one = means.select("i", "j", "odd", around("sxy", "x", "y").alias("sxy"), around("sxx", "x", "x").alias("sxx"), around("syy", "y", "y").alias("syy"))
    name = lambda c: F.get(F.lit(list(cols)), F.col(c))
    flat = lambda c: F.when(F.col(c) > 0, F.col(c))
    r = F.when(F.col("odd"), F.lit(float("nan"))).otherwise(F.col("sxy") / (F.sqrt(flat("sxx")) * F.sqrt(flat("syy"))))
    return one.select(name("i").alias("var_1"), name("j").alias("var_2"), F.round(r, digits).alias("correlation"))


def strong_pairs(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of different columns with |rounded correlation| at or above the threshold, strongest first."""
    return (corr.filter((F.col("var_1") != F.col("var_2")) & (F.abs("correlation") >= threshold))
            .orderBy(F.desc(F.abs("correlation")), "var_1", "var_2"))


def _weighted_pairs(df: DataFrame, cols: list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """(pair, x, y, w): distinct value pairs of each pair of columns with their row counts.

    Equal rows are combined before anything is ordered. ``extra`` maps a column to one carried along with it.
    """
    num = {c: F.col(c).cast("double") + 0.0 for c in cols}
    extra = extra or {}
    carried = lambda a, b: [F.col(extra[a]).alias("bx"), F.col(extra[b]).alias("by")] if extra else []
    spread = F.inline(F.array(*[F.struct(F.lit(i).alias("pair"), num[a].alias("x"), num[b].alias("y"), *carried(a, b))
                                for i, (a, b) in enumerate(combinations(cols, 2))]))
    rows = df.select(spread).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("w"))


def _average_rank(d: DataFrame, col: str, block: str, out: str) -> DataFrame:
    """Average rank of ``col`` per pair over weighted rows. Ranges are ordered on their own; a range that is one
    single value has one rank and is spread over tasks instead."""
    # one row per pair and range: bounded by the number of boundaries
    sizes = d.groupBy("pair", block).agg(F.sum("w").alias("_bw"))
    sizes = sizes.withColumn("_base", F.sum("_bw").over(Window.partitionBy("pair").orderBy(block)) - F.col("_bw"))
    single = Blocks.single_valued(F.col(block))
    d = (d.join(F.broadcast(sizes), ["pair", block])
         .withColumn("_salt", F.when(single, F.pmod(F.xxhash64("x", "y"), F.lit(1024))).otherwise(F.lit(-1))))
    upto = Window.partitionBy("pair", block, "_salt").orderBy(col).rangeBetween(Window.unboundedPreceding, 0)
    ties = upto.rangeBetween(0, 0)
    rank = F.sum("w").over(upto) - (F.sum("w").over(ties) - 1) / 2.0
    return d.withColumn(out, F.col("_base") + F.when(single, (F.col("_bw") + 1) / 2.0).otherwise(rank)).drop(
        "_bw", "_base", "_salt")


def spearman(df: DataFrame, cols: list[str], digits: int = 4, blocks: int | None = None) -> DataFrame:
    """Pairs of different columns; ranks are taken over the rows where both are present."""
    blocks = blocks or block_count(df.count())
    wide = df.select(*[(F.col(c).cast("double") + 0.0).alias(c) for c in cols])  # -0.0 is 0.0
    cuts = value_blocks(wide, cols, blocks)
    for c in cols:
        wide = cuts[c].assign(wide, f"_b_{c}")
    d = materialise(_weighted_pairs(wide, cols, {c: f"_b_{c}" for c in cols}))
    d = _average_rank(d, "x", "bx", "rx")
    d = _average_rank(d, "y", "by", "ry")
    s = lambda e: F.sum(F.col("w") * e)
    one = d.groupBy("pair").agg(
        F.sum("w").cast("double").alias("n"), s(F.col("rx")).alias("sx"), s(F.col("ry")).alias("sy"),
        s(F.col("rx") * F.col("ry")).alias("sxy"), s(F.col("rx") * F.col("rx")).alias("sxx"),
        s(F.col("ry") * F.col("ry")).alias("syy"))
    n = F.col("n")
    cov = F.col("sxy") / n - F.col("sx") / n * (F.col("sy") / n)
    vx = F.col("sxx") / n - F.pow(F.col("sx") / n, 2)
    vy = F.col("syy") / n - F.pow(F.col("sy") / n, 2)
    return one.select(*_pair_names(cols), F.round(F.try_divide(cov, F.sqrt(vx * vy)), digits).alias("correlation"))


def _pair_names(cols: list[str]) -> list[Column]:
    pairs = list(combinations(cols, 2))
    return [F.get(F.lit([p[i] for p in pairs]), F.col("pair")).alias(name) for i, name in enumerate(("var_1", "var_2"))]


# ---- Kendall -------------------------------------------------------------------------------------------------

GROUP_ROWS = 1_000_000


def pair_score(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted concordant minus discordant pairs, O(n log n).

    Two ranks of y differ first at exactly one bit. For each bit, rows that share all higher bits are compared in x
    order: a 1 after smaller-x zeros is concordant, a 0 after smaller-x ones discordant.
    """
    if len(x) < 2:
        return 0.0
    order = np.argsort(x, kind="stable")
    xr = np.unique(x[order], return_inverse=True)[1]
    yr = np.unique(y[order], return_inverse=True)[1]
    w = w[order].astype(np.float64)
    score = 0.0
    for k in range(int(yr.max()).bit_length()):
        high = yr >> (k + 1)
        o = np.argsort(high, kind="stable")
        h, xx, ww, bit = high[o], xr[o], w[o], ((yr[o] >> k) & 1).astype(np.float64)
        pos = np.arange(len(o))
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_x = new_h | np.r_[True, xx[1:] != xx[:-1]]
        h0 = np.maximum.accumulate(np.where(new_h, pos, 0))
        x0 = np.maximum.accumulate(np.where(new_x, pos, 0))
        ones = np.r_[0.0, np.cumsum(ww * bit)]
        zeros = np.r_[0.0, np.cumsum(ww * (1 - bit))]
        score += float(np.sum(ww * (bit * (zeros[x0] - zeros[h0]) - (1 - bit) * (ones[x0] - ones[h0]))))
    return score


def _score_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "score": [pair_score(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())]})


RANGES = 2048  # of each column at most
STRIP = 64  # ranges that are settled together, so that a task gets STRIP / RANGES of the counts of range pairs


def _score_parts(d: DataFrame) -> DataFrame:
    """(pair, kind, g, x, y, w): rows that are to be scored group by group; the sum over a pair's groups is its score.

    Two rows differ in the ranges of both columns, or share a range of x, or share a range of y alone. The first are settled
    by the counts of range pairs, with range numbers for values; the second among the rows of that range of x; the third
    among the rows of that range of y, with the range of x for x. A range that is one single value has only ties.

    The counts of range pairs are settled in the same three ways by strips of ranges, so no task gets all of them.
    """
    inside = lambda block: ~Blocks.single_valued(F.col(block))
    number = lambda c: F.col(c).cast("double")
    strip = lambda c: F.floor(F.col(c) / STRIP).cast("int")
    cells = d.groupBy("pair", "bx", "by").agg(F.sum("w").alias("w")).withColumns({"sx": strip("bx"), "sy": strip("by")})
    by_strips = (cells.groupBy("pair", "sx", "sy").agg(F.sum("w").alias("w"))
                 .select("pair", F.lit(0).alias("kind"), F.lit(0).alias("g"), number("sx").alias("x"), number("sy").alias("y"), "w"))
    in_sx = cells.select("pair", F.lit(3).alias("kind"), F.col("sx").alias("g"), number("bx").alias("x"), number("by").alias("y"), "w")
    in_sy = (cells.groupBy("pair", "sx", "sy", "by").agg(F.sum("w").alias("w"))
             .select("pair", F.lit(4).alias("kind"), F.col("sy").alias("g"), number("sx").alias("x"), number("by").alias("y"), "w"))
    by_counts = by_strips.unionByName(in_sx).unionByName(in_sy)
    in_x = d.filter(inside("bx")).select("pair", F.lit(1).alias("kind"), F.col("bx").alias("g"), "x", "y", "w")
    in_y = (d.filter(inside("by")).groupBy("pair", "bx", "by", "y").agg(F.sum("w").alias("w"))
            .select("pair", F.lit(2).alias("kind"), F.col("by").alias("g"), number("bx").alias("x"), "y", "w"))
    return by_counts.unionByName(in_x).unionByName(in_y)


def kendall(df: DataFrame, cols: list[str], digits: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """tau-b for pairs of different columns, NULL where one is constant or no row has both.

    Values are cut into ranges of about half ``group_rows`` rows, for all pairs at once; groups of ranges are scored in
    tasks of their own, all of them in one job whatever their number. Only the ranges' boundaries reach the driver.
    """
    wide = df.select(*[(F.col(c).cast("double") + 0.0).alias(c) for c in cols])  # -0.0 is 0.0
    cuts = value_blocks(wide, cols, block_count(df.count(), max(1, group_rows // 2), RANGES))
    for c in cols:
        wide = cuts[c].assign(wide, f"_b_{c}")
    d = materialise(_weighted_pairs(wide, cols, {c: f"_b_{c}" for c in cols}))
    score = _score_parts(d).groupBy("pair", "kind", "g").applyInPandas(_score_group, "pair int, score double").groupBy("pair").agg(F.sum("score").alias("score"))

    values = d.select("pair", F.inline(F.array(*[F.struct(F.lit(c == "x").alias("is_x"), F.col(c).alias("v"), "w") for c in "xy"])))
    per = values.groupBy("pair", "is_x", "v").agg(F.sum("w").cast("double").alias("t"))
    ties = F.col("t") * (F.col("t") - 1) / 2
    tied = per.groupBy("pair").agg(*[F.sum(F.when(F.col("is_x") == F.lit(c == "x"), ties)).alias(f"tied_{c}") for c in "xy"],
                                   F.sum(F.when(F.col("is_x"), F.col("t"))).alias("n"))
    pairs = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(combinations(cols, 2))], "pair int, var_1 string, var_2 string")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    untied = lambda key: F.sqrt(F.greatest(n0 - F.col(f"tied_{key}"), F.lit(0.0)))
    return (pairs.join(score, "pair", "left").join(tied, "pair", "left")
            .select("var_1", "var_2", F.round(F.try_divide(F.col("score"), untied("x") * untied("y")), digits).alias("correlation")))
