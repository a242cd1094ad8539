"""Short linear codes for feature vectors: encode, decode, reconstruction error, report per code size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.scaling import Scaler


class Coder:
    """k principal components of standardised vectors. A linear autoencoder with squared loss finds the same space."""

    def __init__(self, scaler: Scaler, model: PCAModel):
        self.scaler, self.model = scaler, model

    @classmethod
    def fit(cls, df: DataFrame, col: str, k: int = 32) -> Coder:
        """Two passes; the driver sees one vector of means and one dimension x dimension matrix."""
        scaler = Scaler.fit(df, col)
        vec = df.select(array_to_vector(scaler.scaled(F.col(col))).alias("_v"))
        return cls(scaler, PCA(k=k, inputCol="_v", outputCol="_code").fit(vec))

    @property
    def components(self) -> np.ndarray:
        return self.model.pc.toArray()

    def encode(self, df: DataFrame, col: str, out: str = "code") -> DataFrame:
        v = df.withColumn("_v", array_to_vector(self.scaler.scaled(F.col(col))))
        return self.model.transform(v).withColumn(out, vector_to_array("_code")).drop("_v", "_code")

    def decode(self, df: DataFrame, code: str = "code", out: str = "reconstructed", rescale: bool = True) -> DataFrame:
        """Vectors from codes, in original units unless ``rescale`` is off. One matrix product per Arrow batch."""
        back = self.components.T

        @F.pandas_udf("array<double>")
        def expand(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for c in codes:
                yield pd.Series(list(np.stack(c.to_numpy()) @ back[: len(c.iloc[0])])) if len(c) else pd.Series([])

        df = df.withColumn(out, expand(F.col(code)))
        return self.scaler.inverse(df, out) if rescale else df

    def with_error(self, df: DataFrame, col: str, k: int | None = None, out: str = "error") -> DataFrame:
        """Mean squared error per standardised dimension using the first k components.

        The components are orthonormal, so what the code loses is the squared length it does not hold.
        """
        k = k or self.components.shape[1]
        sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
        coded = self.encode(df, col, "_code_k")
        lost = sq(self.scaler.scaled(F.col(col))) - sq(F.slice("_code_k", 1, k))
        return coded.withColumn(out, F.greatest(lost, F.lit(0.0)) / len(self.scaler.mean)).drop("_code_k")

    def most_anomalous(self, df: DataFrame, col: str, id_col: str, n: int) -> DataFrame:
        return self.with_error(df, col).orderBy(F.desc("error"), id_col).limit(n)

    def size_report(self, df: DataFrame, col: str, sizes: list[int]) -> DataFrame:
        """Per code size: compression, explained variance and mean reconstruction error, in one pass for all sizes."""
        d = len(self.scaler.mean)
        var = [float(v) for v in self.model.explainedVariance.toArray()]
        sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
        coded = self.encode(df, col, "_c").select(sq(self.scaler.scaled(F.col(col))).alias("_all"), "_c")
        one = coded.agg(*[F.avg(F.col("_all") - sq(F.slice("_c", 1, k))).alias(f"e{k}") for k in sizes])
        return one.select(F.inline(F.array(*[F.struct(
            F.lit(d).alias("input_size"), F.lit(k).alias("code_size"), F.lit(d / k).alias("compression_ratio"),
            F.lit(sum(var[:k])).alias("explained_variance"),
            (F.greatest(F.col(f"e{k}"), F.lit(0.0)) / d).alias("mean_error")) for k in sizes])))

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaler.save(spark, f"{path}/scaler")
        self.model.write().overwrite().save(f"{path}/components")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Coder:
        return cls(Scaler.load(spark, f"{path}/scaler"), PCAModel.load(f"{path}/components"))
