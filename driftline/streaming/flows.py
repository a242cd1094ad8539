"""Incremental forms of the batch loops: ingest without repeats, traces as they close, and traces by session window."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline import schemas
from driftline.functions.scalars import as_micros
from driftline.operators.clean import keep_first
from driftline.operators.traces import GapRule, locate, pack_arrays
from driftline.sources.reports import explode_snapshots, snapshot_points


def snapshot_stream(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Table-form points of snapshot files as they arrive."""
    raw = (spark.readStream.schema(schemas.SNAPSHOT_JSON).option("multiLine", one_per_file)
           .option("recursiveFileLookup", True).json(path))
    return snapshot_points(explode_snapshots(raw))


def without_repeats(stream: DataFrame, event_time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First row per key within the watermark, for live streams whose lateness is bounded by ``delay``.

    Rows later than that are thrown away, on which ``run_available`` fails. Files in any order are merged by
    ``merge_available`` instead. Which of several copies in one batch survives is not determined.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def merge_available(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str],
                    bucket: Column | None = None) -> list[dict[str, int]]:
    """Insert-ignore everything that has arrived into a parquet table, whatever its order in time; then stop.

    A row whose key is stored is left out; among new ones of a key the first in ``order`` enters. Stored rows lie in folders
    by ``bucket``, a whole number that follows from the key (say, the hour of its time): a batch reads the stored keys of the
    buckets that it touches and no others, so its work follows its own size, not the table's. Without one all keys share a
    bucket. Each batch has folders of its own, overwritten if the batch is repeated after a failure, so no row is lost or
    written twice. Keys must not be NULL.

    Returns for each batch how many buckets it touched and how many stored rows it read for that.
    """
    spark = stream.sparkSession
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    log: list[dict[str, int]] = []

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_bucket", (F.lit(0) if bucket is None else F.coalesce(bucket, F.lit(0))).cast("long"))
        touched = [r[0] for r in batch.select("_bucket").distinct().collect()]  # one number a bucket of this batch
        stored = [f"{path}/_bucket={k}" for k in touched if exists(spark, f"{path}/_bucket={k}")]
        fresh, read = keep_first(batch, ["_bucket", *keys], order), 0
        if stored:
            old = spark.read.schema(plain + ", _bucket bigint, _batch bigint").option("basePath", path).parquet(*stored)
            old = old.where(F.col("_batch") < number).select("_bucket", *keys)
            read = old.count()  # from the footers of the files
            fresh = fresh.join(old, ["_bucket", *keys], "left_anti").select(*batch.columns)
        (fresh.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(path))
        log.append({"batch": number, "buckets": len(touched), "stored_read": read})

    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    w.trigger(availableNow=True).start().awaitTermination()
    return log


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# ---- traces as they come in ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class LiveTraces:
    """Traces in array form from points that arrive in any order, late by at most ``delay_us``.

    After each batch the horizon is the latest time seen less the delay. Points before the horizon that the batch found are
    late and go to a side table. A trace is closed, and written, when no point at or after the horizon can belong to it: the
    gap, or the clock cut of ``chunk_us``, lies between. The points of other traces wait in the open table for the next batch.
    So closed and open traces together are those of ``trace_arrays`` over all points that were not late.

    A batch reads its own rows and the open points; placing them is the batch operator, which splits an entity however many
    of the points are its own. Every batch has folders of its own: a batch that is repeated overwrites them and reads the
    state of the one before. NULL entities and times belong to no trace.
    """

    rule: GapRule
    arrays: tuple[str, ...]
    scalars: tuple[str, ...]
    delay_us: int
    path: str

    def run_available(self, stream: DataFrame, checkpoint: str) -> None:
        """Take in everything that has arrived, then stop; to be called again when more has."""
        w = stream.writeStream.foreachBatch(self._step).option("checkpointLocation", checkpoint)
        w.trigger(availableNow=True).start().awaitTermination()

    def _of(self, part: str, batch: int) -> str:
        return f"{self.path}/{part}/_batch={batch}"

    def _step(self, batch: DataFrame, number: int) -> None:
        spark, rule = batch.sparkSession, self.rule
        columns = list(dict.fromkeys([rule.entity, rule.ts, *rule.tiebreak, *self.arrays, *self.scalars]))
        us = as_micros(batch, rule.ts, rule.unit)
        rows = batch.select(*columns).withColumn("_at", us).where(F.col(rule.entity).isNotNull() & F.col("_at").isNotNull())
        before = None
        if number > 0:
            before = spark.read.schema("us long").parquet(self._of("horizon", number - 1)).first()[0]
        latest = rows.agg(F.max("_at")).first()[0]
        known = [t for t in (before, None if latest is None else latest - self.delay_us) if t is not None]
        horizon = max(known) if known else None
        late = F.lit(False) if before is None else F.col("_at") < before
        rows.where(late).drop("_at").write.mode("overwrite").parquet(self._of("late", number))
        points = rows.where(~late).drop("_at")
        if number > 0:
            points = points.unionByName(spark.read.schema(points.schema).parquet(self._of("open", number - 1)))
        locate(points, rule).write.mode("overwrite").parquet(self._of("placed", number))
        placed = spark.read.parquet(self._of("placed", number))
        closed = F.lit(False)
        if horizon is not None:
            closed = F.col("end_us") + F.lit(rule.gap_us) < F.lit(horizon)
            if rule.chunk_us:
                closed = closed | (F.floor((F.col("end_us") - rule.chunk_origin_us) / rule.chunk_us)
                                   < (horizon - rule.chunk_origin_us) // rule.chunk_us)
        self._packed(placed.where(closed)).write.mode("overwrite").parquet(self._of("closed", number))
        placed.where(~closed).select(*columns).write.mode("overwrite").parquet(self._of("open", number))
        spark.createDataFrame([(horizon,)], "us long").write.mode("overwrite").parquet(self._of("horizon", number))
        for part, old in (("placed", number), ("open", number - 2), ("horizon", number - 2)):  # the next batch may be repeated
            delete(spark, self._of(part, old))

    def _packed(self, placed: DataFrame) -> DataFrame:
        return pack_arrays(placed, self.rule, list(self.arrays), list(self.scalars)).drop("trace_no")

    def closed(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/closed").drop("_batch")

    def open(self, spark: SparkSession) -> DataFrame:
        """What is known of the traces that may go on, in the same form."""
        points = spark.read.parquet(f"{self.path}/open")
        last = points.agg(F.max("_batch")).first()[0]
        return self._packed(locate(points.where(F.col("_batch") == last).drop("_batch"), self.rule))

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/late").drop("_batch")


def session_traces(stream: DataFrame, entity: str, event_time: str, gap: str = "10 minutes",
                   delay: str = "10 minutes") -> DataFrame:
    """Closed traces. A point exactly ``gap`` after the last one still belongs to it, as in the batch form."""
    s = stream.withWatermark(event_time, delay)
    return s.groupBy(F.col(entity), F.session_window(event_time, gap).alias("session")).agg(
        F.unix_micros(F.min(event_time)).alias("start_us"), F.unix_micros(F.max(event_time)).alias("end_us"),
        F.count(F.lit(1)).alias("point_count")).drop("session")


def run_available(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] = ()) -> StreamingQuery:
    """Process everything that has arrived, append it to a parquet table, and stop. Safe to repeat.

    Fails if a watermark threw rows away: the table would then be incomplete without anyone knowing.
    """
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start(path)
    q.awaitTermination()
    dropped = sum(int(op.get("numRowsDroppedByWatermark", 0)) for progress in map(_as_dict, q.recentProgress)
                  for op in progress.get("stateOperators", []))
    if dropped:
        raise RuntimeError(f"{dropped} rows came later than the watermark allows and were dropped; "
                           f"allow a longer delay or use merge_available")
    return q


def _as_dict(progress) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)
