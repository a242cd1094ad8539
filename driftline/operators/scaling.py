"""Standardisation and outlier removal of feature vectors held as array columns."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per dimension. Its size is that of one vector."""

    mean: list[float]
    std: list[float]

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> Scaler:
        """One pass with mergeable per-partition sums."""
        v = array_to_vector(F.col(col).cast("array<double>"))
        s = df.select(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).select("s.*").first()
        n = s["count"]
        shrink = (n - 1) / n if n > 1 else 0.0
        return cls([float(x) for x in s["mean"]], [math.sqrt(max(float(x) * shrink, 0.0)) for x in s["variance"]])

    def _inverse(self) -> list[float]:
        return [1.0 / s if s > 0 else 0.0 for s in self.std]

    def scaled(self, arr: Column) -> Column:
        """(x - mean) / std; a constant dimension gives 0."""
        centred = F.zip_with(arr, F.lit(self.mean), lambda x, m: x.cast("double") - m)
        return F.zip_with(centred, F.lit(self._inverse()), lambda x, k: x * k)

    def restored(self, arr: Column) -> Column:
        return F.zip_with(F.zip_with(arr, F.lit(self.std), lambda x, s: x * s), F.lit(self.mean), lambda x, m: x + m)

    def transform(self, df: DataFrame, col: str, out: str | None = None) -> DataFrame:
        return df.withColumn(out or col, self.scaled(F.col(col)))

    def inverse(self, df: DataFrame, col: str, out: str | None = None) -> DataFrame:
        return df.withColumn(out or col, self.restored(F.col(col)))

    def drop_outliers(self, df: DataFrame, col: str, threshold: float = 4.0) -> DataFrame:
        """Rows with |z| below the threshold in every dimension; a constant dimension counts as z = 0."""
        return df.filter(F.forall(self.scaled(F.col(col)), lambda z: F.abs(z) < threshold))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([asdict(self)], "mean array<double>, std array<double>").write.mode(
            "overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        r = spark.read.parquet(path).first()
        return cls(list(r["mean"]), list(r["std"]))
