"""Traces to fixed-length windows, rates of change, window numbers and flat feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import arrays as A
from driftline.functions.scalars import as_micros
from driftline.operators.ordering import dense_index
from driftline.operators.traces import GapRule, locate

BLOCK_POINTS = 4096

# Column order of the flat feature vector: fixed values.
FEATURES = ["time_offsets", "vertical_rates", "ground_speeds", "headings", "altitudes", "vertical_accels",
            "ground_accels", "turn_rates", "climb_descent_accels"]


def _starts(pts: Column, n: int, lead: int, half: int, gap_us: int, total: Column, base: Column, span: int) -> Column:
    """0-based positions in ``pts`` where a window begins.

    ``pts`` holds the block's own points, the n points after it and, with ``lead`` 1, the point before it. A window
    begins at every multiple of n and at every multiple plus half if no gap lies inside it, at the last n points of
    the trace if n does not divide its length and no gap lies inside, and directly before and after every gap.
    """
    def rule(gaps: Column) -> Column:
        # gaps[i]: the step from point i to point i+1 is a gap
        def keep(i: Column) -> Column:
            pos = base + i - lead
            fits = pos + n <= total
            smooth = ~F.exists(F.slice(gaps, i + 1, n - 1), lambda g: g)
            regular = (pos % n == 0) | (pos % n == half)
            final = (pos + n == total) & (total % n != 0)
            before_gap = F.coalesce(F.get(gaps, i + (n - 1)), F.lit(False))
            after_gap = F.when(i > 0, F.coalesce(F.get(gaps, i - 1), F.lit(False))).otherwise(F.lit(False))
            return fits & (before_gap | after_gap | ((regular | final) & smooth))

        own = F.sequence(F.lit(lead), F.least(F.lit(lead + span), F.size(pts)) - 1)
        return F.filter(own, keep)

    gaps = F.transform(A.indices(F.size(pts) - 1),
                       lambda i: F.get(pts, i + 1)["us"] - F.get(pts, i)["us"] > F.lit(gap_us))
    return A.bind(gaps, rule)


def windows(df: DataFrame, rule: GapRule, measures: dict[str, str], n: int = 50, half: int | None = None,
            window_gap_us: int = 10_000_000, min_duration_us: int = 0, null_policy: str = "reject_trace",
            block_points: int = BLOCK_POINTS) -> DataFrame:
    """Windows of ``n`` consecutive points of a trace; ``measures`` maps a point column to its window column.

    A trace with a NULL measure is rejected (``reject_trace``), or points with NULLs break the sequence (``break``):
    each run of complete points between them is then cut like a trace of its own.

    Points are grouped by (trace, block of positions) plus the few points a window may reach into the next block, so
    a group is bounded however long the trace is, and every window is built in exactly one block.
    """
    half = n // 2 if half is None else half
    cols = list(measures)
    present = F.lit(True)
    for c in cols:
        present = present & F.col(c).isNotNull()
    if null_policy == "break":
        df = df.withColumn("_hole", (~present).cast("int"))
        return _windows_with_holes(df, rule, measures, n, half, window_gap_us, min_duration_us, block_points)
    pts = locate(df.select(*dict.fromkeys([rule.entity, rule.ts, *rule.tiebreak, *cols])), rule,
                 min_duration_us, min_points=n, reject=~present)
    return _cut(pts, [rule.entity, "trace_no"], measures, n, half, window_gap_us, block_points)


def _windows_with_holes(df, rule, measures, n, half, gap_us, min_duration_us, block_points) -> DataFrame:
    """Each NULL point ends one run of points and the next run starts after it; runs are cut like traces."""
    cols = list(measures)
    pts = locate(df.select(*dict.fromkeys([rule.entity, rule.ts, *rule.tiebreak, *cols, "_hole"])), rule,
                 min_duration_us, min_points=n)
    # holes before a position: per position block first, so that no long trace is ordered in one task
    pts = pts.withColumn("_pb", F.floor(F.col("pos") / block_points).cast("long"))
    key = [rule.entity, "trace_no"]
    per = pts.groupBy(*key, "_pb").agg(F.sum("_hole").alias("_h"), F.count_if(F.col("_hole") == 0).alias("_ok"))
    w = Window.partitionBy(*key).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*key, "_pb", F.coalesce(F.sum("_h").over(w), F.lit(0)).alias("_h0"))
    local = Window.partitionBy(*key, "_pb").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    pts = (pts.withColumn("_hl", F.sum("_hole").over(local)).join(per, [*key, "_pb"])
           .withColumn("run_no", F.col("_h0") + F.col("_hl")).filter(F.col("_hole") == 0))
    run = [*key, "run_no"]
    # a run's start and length, again by way of its position blocks
    spans = pts.groupBy(*run, "_pb").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy(*run)
    spans = spans.select(*run, "_pb", F.min("_first").over(over).alias("_p0"), F.sum("_c").over(over).alias("_len"))
    pts = (pts.drop("point_count").join(spans.filter(F.col("_len") >= n), [*run, "_pb"])
           .withColumn("pos", F.col("pos") - F.col("_p0")).withColumn("point_count", F.col("_len")))
    return _cut(pts, run, measures, n, half, gap_us, block_points).drop("run_no")


def _cut(pts: DataFrame, key: list[str], measures: dict[str, str], n: int, half: int, gap_us: int,
         block_points: int) -> DataFrame:
    b = F.floor(F.col("pos") / block_points).cast("long")
    r = F.col("pos") % block_points
    # own block; also the previous one for points its windows reach; also the next one for the point before it
    homes = F.array_compact(F.array(
        b, F.when((r < n) & (b > 0), b - 1), F.when(r == block_points - 1, b + 1)))
    blocks = (pts.select(*key, "pos", "us", "point_count", *measures, F.explode(homes).alias("_b"))
              .groupBy(*key, "_b")
              .agg(F.first("point_count").alias("_n"),
                   F.array_sort(F.collect_list(F.struct("pos", "us", *measures))).alias("_pts")))
    base = F.col("_b") * block_points

    def cut(lead: int) -> Column:
        return A.bind(F.col("_pts"), lambda p: F.transform(
            _starts(p, n, lead, half, gap_us, F.col("_n"), base, block_points), lambda i: F.slice(p, i + 1, n)))

    found = F.when(F.col("_b") == 0, cut(0)).otherwise(cut(1))
    wins = blocks.select(*key, F.explode(found).alias("_w"))
    first = F.get(F.col("_w.us"), F.lit(0))
    return wins.select(
        *key, first.alias("start_us"),
        (F.get(F.col("_w.us"), F.lit(n - 1)) - first).alias("duration_us"),
        F.lit(n).alias("point_count"), A.rebase(F.col("_w.us")).alias("time_offsets"),
        *[F.col(f"_w.{c}").alias(name) for c, name in measures.items()])


def windows_from_arrays(traces: DataFrame, entity: str, start_us: str, offsets: str, measures: dict[str, str],
                        n: int = 50, half: int | None = None, window_gap_us: int = 10_000_000,
                        part_points: int = 200_000) -> DataFrame:
    """Windows of a table that holds the points of traces as arrays, one row each; no shuffle.

    Rows with missing, short or unequal arrays yield nothing. With a column ``part`` a trace may continue in further
    rows of ``part_points`` points each, at least ``n``, as ``trace_arrays`` makes them; windows then reach across its
    rows.
    """
    half = n // 2 if half is None else half
    if "part" in traces.columns:
        if part_points < n:
            raise ValueError("a row of a long trace must hold at least as many points as a window")
        return _windows_of_parts(traces, entity, start_us, offsets, measures, n, half, window_gap_us, part_points)
    cols = [F.col(offsets), *[F.col(c) for c in measures]]
    whole = F.lit(True)
    for c in measures:
        whole = whole & ~F.exists(F.col(c), lambda x: x.isNull())
    usable = traces.filter(A.same_length(cols) & (F.size(offsets) >= n)).filter(F.coalesce(whole, F.lit(False)))
    zipped = F.transform(F.col(offsets), lambda o, i: F.struct(
        (F.col(start_us) + o).alias("us"), *[F.get(F.col(c), i).alias(c) for c in measures]))
    # the block arithmetic of the point form with the whole trace as block 0
    size = F.size(offsets).cast("long")
    found = A.bind(zipped, lambda p: F.transform(
        _starts(p, n, 0, half, window_gap_us, size, F.lit(0).cast("long"), 2**31 - 2), lambda i: F.slice(p, i + 1, n)))
    wins = usable.select(F.col(entity), F.explode(found).alias("_w"))
    first = F.get(F.col("_w.us"), F.lit(0))
    return wins.select(
        entity, first.alias("start_us"), (F.get(F.col("_w.us"), F.lit(n - 1)) - first).alias("duration_us"),
        F.lit(n).alias("point_count"), A.rebase(F.col("_w.us")).alias("time_offsets"),
        *[F.col(f"_w.{c}").alias(name) for c, name in measures.items()])


def _windows_of_parts(traces, entity, start_us, offsets, measures, n, half, gap_us, part_points) -> DataFrame:
    """Each row is a block of positions: it borrows the point before it and the n points after it from its neighbours.

    Only these few points are shuffled to the neighbouring rows, not the histories.
    """
    cols = [F.col(offsets), *[F.col(c) for c in measures]]
    whole = F.lit(True)
    for c in measures:
        whole = whole & ~F.exists(F.col(c), lambda x: x.isNull())
    pts = F.transform(F.col(offsets), lambda o, i: F.struct(
        (F.col(start_us) + o).alias("us"), *[F.get(F.col(c), i).alias(c) for c in measures]))
    rows = traces.select(F.col(entity), F.col(start_us).alias("_start"), F.col("part").cast("long").alias("part"), pts.alias("_pts"),
                         (A.same_length(cols) & F.coalesce(whole, F.lit(False))).alias("_ok"))
    key = [entity, "_start"]
    # a trace goes as a whole, as in the point form: one bad row rejects it
    sizes = rows.groupBy(*key).agg(F.sum(F.size("_pts")).cast("long").alias("_n"), F.bool_and("_ok").alias("_all"))
    sizes = sizes.filter(F.col("_all") & (F.col("_n") >= n)).drop("_all")
    after = rows.filter("part > 0").select(*key, (F.col("part") - 1).alias("part"), F.slice("_pts", 1, n).alias("_after"))
    before = rows.select(*key, (F.col("part") + 1).alias("part"), F.slice("_pts", -1, 1).alias("_before"))
    none = F.slice("_pts", 1, 0)
    blocks = (rows.drop("_ok").join(sizes, key).join(after, [*key, "part"], "left").join(before, [*key, "part"], "left")
              .withColumn("_pts", F.concat(F.coalesce("_before", none), "_pts", F.coalesce("_after", none))))
    base = F.col("part") * part_points

    def cut(lead: int) -> Column:
        return A.bind(F.col("_pts"), lambda p: F.transform(
            _starts(p, n, lead, half, gap_us, F.col("_n"), base, part_points), lambda i: F.slice(p, i + 1, n)))

    wins = blocks.select(entity, F.explode(F.when(F.col("part") == 0, cut(0)).otherwise(cut(1))).alias("_w"))
    first = F.get(F.col("_w.us"), F.lit(0))
    return wins.select(
        entity, first.alias("start_us"), (F.get(F.col("_w.us"), F.lit(n - 1)) - first).alias("duration_us"),
        F.lit(n).alias("point_count"), A.rebase(F.col("_w.us")).alias("time_offsets"),
        *[F.col(f"_w.{c}").alias(name) for c, name in measures.items()])


def derive_rates(wins: DataFrame, offsets: str = "time_offsets", vertical_rates: str = "vertical_rates",
                 ground_speeds: str = "ground_speeds", headings: str = "headings",
                 altitudes: str = "altitudes") -> DataFrame:
    """Append rates of change per second; equal times give NULL. Missing tail values repeat the last known one.

    ``vertical_accels`` is feet per minute per second; the climb/descent rate is the change of slope over the
    first of the two steps.
    """
    dt = F.transform(A.steps(F.col(offsets)), lambda x: x / F.lit(1e6))
    as_double = lambda c: F.col(c).cast("array<double>")

    def bend(d: Column) -> Column:
        slope = A.ratio(A.steps(as_double(altitudes)), d)
        return A.repeat_last(A.bind(slope, lambda s: F.transform(
            A.indices(F.size(s) - 1), lambda i: F.try_divide(F.get(s, i + 1) - F.get(s, i), F.get(d, i)))), 2)

    return wins.withColumns({
        "vertical_accels": A.bind(dt, lambda d: A.repeat_last(A.ratio(A.steps(as_double(vertical_rates)), d))),
        "ground_accels": A.bind(dt, lambda d: A.repeat_last(A.ratio(A.steps(as_double(ground_speeds)), d))),
        "turn_rates": A.bind(dt, lambda d: A.repeat_last(A.ratio(A.turns(as_double(headings)), d))),
        "climb_descent_accels": A.bind(dt, bend),
    })


# Inclusive physical limits per window column: fixed values.
LIMITS = {
    "vertical_rates": (-12000, 12000),
    "ground_speeds": (0, 1000),
    "altitudes": (-1000, 82000),
    "headings": (0, 360),
}


def limit_violation(limits: dict[str, tuple[float, float]] = LIMITS) -> Column:
    """Name of the first column with a value outside its limits, else NULL."""
    reason = None
    for c, (low, high) in limits.items():
        bad = ~A.within(F.col(c), low, high)
        reason = F.when(bad, c) if reason is None else reason.when(bad, c)
    return reason


def physics_filter(wins: DataFrame, limits: dict[str, tuple[float, float]] = LIMITS) -> DataFrame:
    return wins.filter(limit_violation(limits).isNull())


def assign_segment_id(wins: DataFrame, keys: list[str], name: str = "segment_id", first: int = 1) -> DataFrame:
    """Dense numbers in key order starting at ``first``."""
    return dense_index(wins, keys, name).withColumn(name, F.col(name) + first)


def flatten_features(wins: DataFrame, id_col: str, columns: list[str] = FEATURES, n: int = 50) -> DataFrame:
    """One vector per window, all features of point 0 first. Rows with a NULL, NaN or infinite value are dropped."""
    flat = wins.select(id_col, A.interleave([F.col(c) for c in columns], n).alias("features"))
    return flat.filter(A.all_finite(F.col("features")))


def feature_names(columns: list[str] = FEATURES, n: int = 50) -> list[str]:
    """Names for the wide form: column without its plural s, underscore, point number."""
    return [f"{c.rstrip('s')}_{i}" for i in range(n) for c in columns]


def spread_features(flat: DataFrame, id_col: str, columns: list[str] = FEATURES, n: int = 50) -> DataFrame:
    """Wide export form with one column per feature and point."""
    return flat.select(id_col, *[F.get("features", F.lit(i)).alias(name)
                                 for i, name in enumerate(feature_names(columns, n))])


def gather_features(flat: DataFrame, id_col: str, columns: list[str] = FEATURES, n: int = 50) -> DataFrame:
    """Per-feature arrays from the flat vector."""
    k = len(columns)
    return flat.select(id_col, *[A.stride(F.col("features"), k, j, n).alias(c) for j, c in enumerate(columns)])


def unnest_lockstep(df: DataFrame, keys: list[str], arrays: list[str], index: str = "point_idx") -> DataFrame:
    """One row per array position, all arrays in step, with a 0-based index."""
    z = F.arrays_zip(*arrays)
    return (df.select(*keys, F.posexplode(z).alias(index, "_v"))
            .select(*keys, index, *[F.col(f"_v.{a}").alias(a) for a in arrays]))


def points_in_range(df: DataFrame, ts: str, begin_us: int, end_us: int, unit: str = "us") -> DataFrame:
    """begin <= time < end"""
    us = as_micros(df, ts, unit)
    return df.filter((us >= begin_us) & (us < end_us))
