"""Total orders without a single-task window.

``dense_index`` numbers rows 0..n-1 in key order. ``Blocks`` cuts the values of one column into ranges of bounded
row count, with every frequent value in a range of its own, so that work per range stays bounded whatever the skew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialise

ROW_BITS = 33  # monotonically_increasing_id keeps the row-in-partition number in the low 33 bits


def dense_index(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Append ``name``: 0-based position of the row in the order of ``keys``, without gaps.

    One range shuffle, sorted inside partitions. The partition and row numbers are written out before they are used
    twice, so a lost executor cannot shift them; the offsets table has one row per partition.
    """
    placed = materialise(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", ROW_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per shuffle partition: a single-task running sum over it is bounded by the partition count
    offsets = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    return (placed.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_mid").bitwiseAND((1 << ROW_BITS) - 1))
            .drop("_part", "_offset", "_mid"))


@dataclass(frozen=True)
class Blocks:
    """Value ranges of ``column``: block 2k+1 is exactly boundary k, block 2k lies strictly below it.

    A value that holds more rows than a range should is met by a quantile and so becomes a boundary: its block needs
    no ordering inside. The boundaries only steer the work; results do not depend on how good they are.
    """

    column: str
    bounds: tuple[float, ...]

    def assign(self, df: DataFrame, name: str) -> DataFrame:
        """Append the block number; what it is for NULL or NaN is not defined."""
        if not self.bounds:
            return df.withColumn(name, F.lit(0))
        inf = float("inf")
        inner = [b for b in self.bounds if b not in (inf, -inf)]
        cut = Bucketizer(splits=[-inf, *inner, inf], inputCol=self.column, outputCol="_cut",
                         handleInvalid="keep")
        k = F.col("_cut").cast("int")
        table = F.lit([float("nan"), *inner])
        on_bound = F.col(self.column) == F.get(table, k)
        return (cut.transform(df)
                .withColumn(name, F.when((k > 0) & on_bound, 2 * k - 1).otherwise(2 * k))
                .drop("_cut"))

    @staticmethod
    def single_valued(block: Column) -> Column:
        return block % 2 == 1


def value_blocks(df: DataFrame, columns: list[str], count: int = 64) -> dict[str, Blocks]:
    """Boundaries near ``count`` equal shares for each column, from one pass of mergeable sketches."""
    probs = F.lit([i / count for i in range(1, count)])
    value = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(value(c), probs, 4 * count).alias(c) for c in columns]).first()
    return {c: Blocks(c, tuple(sorted({b + 0.0 for b in row[c] or []}))) for c in columns}


def block_count(rows: int, per_block: int = 1_000_000, most: int = 10_000) -> int:
    """How many ranges keep each near ``per_block`` rows."""
    return max(8, min(most, -(-rows // per_block)))
