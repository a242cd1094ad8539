"""Fitted state that merges: count, means and centred cross-products of vectors, kept per part (say, per day).

A day's state is made once, in one pass, and stored; a coder over any days is made from their states alone, without reading a
vector again. Tasks reduce their rows to one state a part, states of a part are merged, and states of parts are merged in a
few tasks, then in one: a state is one vector and one matrix, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.coding import Coder
from driftline.operators.scaling import Scaler

_ARROW = pa.schema([("part", pa.string()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("cross", pa.list_(pa.float64()))])
STATE = "part string, n long, mean array<double>, cross array<double>"
State = tuple[int, np.ndarray, np.ndarray]


def merged(a: State | None, b: State) -> State:
    """The state of both sets of rows; exact but for rounding, in any order."""
    if a is None:
        return b
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _rows(states: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(states), pa.string()), pa.array([s[0] for s in states.values()], pa.int64()),
                                       pa.array([s[1].tolist() for s in states.values()], _ARROW.field("mean").type),
                                       pa.array([s[2].ravel().tolist() for s in states.values()], _ARROW.field("cross").type)], schema=_ARROW)


def _read(table) -> Iterator[tuple[str, State]]:
    for part, n, mean, cross in zip(*(table.column(c).to_pylist() for c in ("part", "n", "mean", "cross"))):
        yield part, (n, np.array(mean), np.array(cross).reshape(len(mean), len(mean)))


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = None
    for batch in batches:
        for _, state in _read(batch):
            whole = merged(whole, state)
    if whole is not None:
        yield _rows({"": whole})


def fit_parts(df: DataFrame, col: str, part) -> DataFrame:
    """(part, n, mean, cross) of the vectors of each part; vectors that are NULL or hold NULL or NaN are left out."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.array(batch.column("part").to_pylist(), object)
            vectors = np.array(batch.column("v").to_pylist(), float)
            for p in dict.fromkeys(parts):
                x = vectors[parts == p]
                mean = x.mean(axis=0)
                states[p] = merged(states.get(p), (len(x), mean, (x - mean).T @ (x - mean)))
        if states:
            yield _rows(states)

    def join(table: pa.Table) -> pa.Table:
        whole = None
        for name, state in _read(table):
            whole = merged(whole, state)
        return pa.Table.from_batches([_rows({name: whole})])

    v = F.col(col).cast("array<double>")
    rows = df.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), v.alias("v")).where("v IS NOT NULL").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    return rows.mapInArrow(reduce, STATE).groupBy("part").applyInArrow(join, STATE)


class Components:
    """Principal components as an array: what a coder needs of a model. Their sign makes the largest entry positive."""

    def __init__(self, pc: np.ndarray, explained: np.ndarray):
        self._pc, self._explained = pc, explained

    @property
    def pc(self):
        return _Array(self._pc)

    @property
    def explainedVariance(self):  # named as in the library's own model
        return _Array(self._explained)

    def transform(self, df: DataFrame) -> DataFrame:
        pc = self._pc

        @F.pandas_udf("array<double>")
        def project(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in vectors:
                yield pd.Series(list(np.stack(v.to_numpy()) @ pc) if len(v) else [])
        return df.withColumn("_code", array_to_vector(project(vector_to_array("_v"))))


class _Array:
    def __init__(self, values: np.ndarray):
        self.values = values

    def toArray(self) -> np.ndarray:
        return self.values


def coder_of(states: DataFrame, k: int = 32, tasks: int = 8) -> Coder:
    """The coder of all rows behind ``states``; the driver sees one vector and one matrix."""
    one = states.repartition(tasks).mapInArrow(_all, STATE).coalesce(1).mapInArrow(_all, STATE).first()
    if one is None:
        raise ValueError("no vectors to fit a coder to")
    n, mean, cross = one["n"], np.array(one["mean"]), np.array(one["cross"]).reshape(len(one["mean"]), -1)
    std = np.sqrt(np.maximum(np.diag(cross) / n, 0.0))
    scale = np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0)
    values, vectors = np.linalg.eigh(cross / n * np.outer(scale, scale))
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    total = values.sum()
    return Coder(Scaler(mean.tolist(), std.tolist()), Components(vectors[:, :k], values[:k] / total if total > 0 else values[:k]))


def save_states(states: DataFrame, path: str) -> None:
    """Add the states of new parts to those stored; a part that is fitted again replaces its state."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def load_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n long, mean array<double>, cross array<double>, part string").parquet(path).select("part", "n", "mean", "cross")


def error_by_split(coder: Coder, df: DataFrame, col: str, held_out, k: int | None = None) -> DataFrame:
    """(held_out, n, mean_error): the reconstruction error of training rows beside that of rows kept back."""
    scored = coder.with_error(df.withColumn("_held", held_out), col, k)
    return scored.groupBy(F.col("_held").alias("held_out")).agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"))
