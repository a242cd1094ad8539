"""The whole way from trace points to labelled 3-D paths, each step a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline import schemas
from driftline.operators import density, exemplars, paths, profile, windows
from driftline.operators.clean import encode_arrays, keep_last, keep_richest
from driftline.operators.coding import Coder
from driftline.operators.summaries import trace_summary
from driftline.operators.traces import GapRule, trace_arrays
from driftline.session import materialise

TEN_MINUTES = 600_000_000
FIFTEEN_MINUTES = 900_000_000


@dataclass
class Settings:
    entity: str = "icao"
    ts: str = "actual_timestamp"
    gap_us: int = TEN_MINUTES
    min_duration_us: int = FIFTEEN_MINUTES
    points: int = 50
    window_gap_us: int = 10_000_000
    code_size: int = 32
    cluster_on: str = "reconstructed"  # or "code"
    sample: int | None = None
    min_cluster_size: int = 35
    min_samples: int = 4
    epsilon: float = 0.25


def snapshot_traces(points: DataFrame, unit: str, gap_us: int = TEN_MINUTES, chunk_us: int | None = None) -> DataFrame:
    """Array rows per trace from snapshot points; ``unit`` is that of actual_timestamp. No least duration."""
    rule = GapRule("hex", "actual_timestamp", gap_us, unit=unit, tiebreak=("snapshot_timestamp",), chunk_us=chunk_us)
    t = trace_arrays(points, rule, schemas.SNAPSHOT_TRACE_ARRAYS, schemas.SNAPSHOT_TRACE_SCALARS)
    return t.select(
        F.col("start_us").alias("time_stamp_start"), F.col("end_us").alias("time_stamp_end"), "hex", "part",
        F.col("point_count").cast("int").alias("point_count"),
        F.floor(F.col("duration_us") / 1_000_000).cast("int").alias("duration"),
        F.lit(None).cast("boolean").alias("quality_passed"), F.lit(None).cast("array<string>").alias("quality_flags"),
        *schemas.SNAPSHOT_TRACE_SCALARS,
        F.transform("time_offsets", lambda o: o + F.col("start_us")).alias("timestamp"), *schemas.SNAPSHOT_TRACE_ARRAYS)


def distinct_points(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One point per (entity, time): repeated files repeat points, and the fullest copy stays."""
    order = [c for c in ("source_file_path",) if c in points.columns] or [s.ts]
    return keep_richest(points, [s.entity, s.ts], order)


def point_traces(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Typed array rows per trace from trace points, traces of at least the least duration."""
    rule = GapRule(s.entity, s.ts, s.gap_us)
    t = trace_arrays(distinct_points(points, s), rule, list(schemas.TRACE_ARRAYS), schemas.TRACE_SCALARS, s.min_duration_us)
    t = t.withColumn("start_timestamp", F.timestamp_micros("start_us")).drop("trace_no", "end_us")
    return encode_arrays(t, schemas.TRACE_ARRAYS)


def trace_features(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Mean, deviation, extremes and median of the main measures per trace."""
    rule = GapRule(s.entity, s.ts, s.gap_us)
    return trace_summary(distinct_points(points, s), rule, schemas.SUMMARY_MEASURES, s.min_duration_us)


def day_report(points: DataFrame, s: Settings = Settings(), minutes: int = 15, top: int = 10) -> dict[str, DataFrame]:
    """The parts of a profile of one table of points."""
    return {
        "total_rows": profile.row_count(points),
        "mean_point_count": profile.mean_points_per_entity(points, s.entity),
        "mean_duration": profile.mean_span_minutes(points, s.entity, s.ts),
        "over_duration": profile.entities_over_span(points, s.entity, s.ts, minutes),
        "top_entities": profile.top_values(points, s.entity, top),
        "null_counts": profile.null_profile(points),
        "distinct_counts": profile.distinct_profile(points),
        "distinct_values": profile.low_cardinality_values(points),
    }


def training_windows(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Numbered windows with rates of change, one per (entity, start), of points made distinct first."""
    rule = GapRule(s.entity, s.ts, s.gap_us)
    w = windows.windows(distinct_points(points, s), rule, schemas.WINDOW_MEASURES, n=s.points, window_gap_us=s.window_gap_us,
                        min_duration_us=s.min_duration_us)
    w = keep_last(w, [s.entity, "start_us"], ["duration_us"])
    return windows.assign_segment_id(windows.derive_rates(w), [s.entity, "start_us"])


def cluster_windows(wins: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(segment_id, cluster, is_most_typical, is_most_extreme)."""
    flat = materialise(windows.flatten_features(wins, "segment_id", n=s.points))
    coder = Coder.fit(flat, "features", s.code_size)
    coded = coder.decode(coder.encode(flat, "features")).select("segment_id", "code", "reconstructed")
    if s.sample:
        coded = profile.reproducible_rows(coded, "segment_id", s.sample)
    coded = materialise(coded)
    labels = density.hdbscan(coded, "segment_id", s.cluster_on, s.min_cluster_size, s.min_samples, s.epsilon)
    labelled = materialise(coded.join(labels, "segment_id"))
    found = exemplars.find_exemplars(labelled, "segment_id", s.cluster_on)
    return exemplars.label_exemplars(labelled, found, "segment_id")


def labelled_trajectories(wins: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    keys = ["segment_id", s.entity, "start_us"]
    chosen = wins.join(labels.select("segment_id"), "segment_id", "left_semi")
    rotated = paths.rotate_to_y(paths.dead_reckon(chosen, keys), keys)
    return paths.label_paths(labels, rotated, "segment_id").withColumn("start_timestamp", F.timestamp_micros("start_us"))
