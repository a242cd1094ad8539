"""Traces, windows and paths over ``events``: user = moving object, value = speed, event id mod 360 = heading.

Events are hours apart, so the gap is 24 hours, windows have 10 points, and 12 hours is a gap inside a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import arrays as A
from driftline.functions import scalars as S
from driftline.operators import checks, paths, summaries, windows
from driftline.operators.summaries import trace_summary
from driftline.operators.traces import GapRule, gap_flags, locate, trace_arrays, traces
from driftline.plans import chain
from driftline.plans.registry import query, table

HOUR = 3_600_000_000
RULE = GapRule("user_id", "ts", 24 * HOUR)
N = 10

# Traces as a sequence of common table expressions, used by the queries below.
POINTS_SQL = """
WITH p AS (SELECT user_id, event_id, value, (event_id % 360)::DOUBLE AS heading, epoch_us(ts) AS us FROM events),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS diff_us FROM p),
t AS (SELECT *, CAST(sum(CASE WHEN diff_us > 86400000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trace_no FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, trace_no ORDER BY us) - 1 AS pos,
        min(us) OVER (PARTITION BY user_id, trace_no) AS start_us,
        max(us) OVER (PARTITION BY user_id, trace_no) AS end_us,
        count(*) OVER (PARTITION BY user_id, trace_no) AS n FROM t)
"""

WINDOWS_SQL = POINTS_SQL + """,
x AS (SELECT *, CASE WHEN lead(us) OVER w - us > 43200000000 THEN 1 ELSE 0 END AS gap_after FROM l
      WINDOW w AS (PARTITION BY user_id, trace_no ORDER BY pos)),
c AS (
  SELECT user_id, trace_no, pos AS s, true AS smooth FROM x WHERE (pos % 10 = 0 OR pos % 10 = 5) AND pos + 10 <= n
  UNION SELECT user_id, trace_no, n - 10, true FROM x WHERE n >= 10 AND n % 10 <> 0
  UNION SELECT user_id, trace_no, pos - 9, false FROM x WHERE gap_after = 1 AND pos >= 9
  UNION SELECT user_id, trace_no, pos + 1, false FROM x WHERE gap_after = 1 AND pos + 10 < n),
m AS (SELECT c.user_id, c.trace_no, c.s, bool_or(NOT c.smooth) AS by_gap,
        sum(CASE WHEN x.pos < c.s + 9 THEN x.gap_after ELSE 0 END) / count(DISTINCT c.smooth) AS gaps,
        list(DISTINCT {'p': x.pos, 'us': x.us, 'v': x.value, 'h': x.heading}) AS raw
      FROM c JOIN x ON x.user_id = c.user_id AND x.trace_no = c.trace_no AND x.pos BETWEEN c.s AND c.s + 9
      GROUP BY ALL),
wn AS (SELECT user_id, trace_no, list_sort(raw) AS pts FROM m WHERE by_gap OR gaps = 0),
ww AS (SELECT user_id, trace_no, pts[1].us AS start_us, pts[10].us - pts[1].us AS duration_us,
        list_transform(pts, lambda q: q.us - pts[1].us) AS time_offsets,
        list_transform(pts, lambda q: q.v) AS ground_speeds, list_transform(pts, lambda q: q.h) AS headings FROM wn)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("heading", (F.col("event_id") % 360).cast("double"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windows(events(spark, sf_dir), RULE, {"value": "ground_speeds", "heading": "headings"},
                           n=N, window_gap_us=12 * HOUR)


def as_text(c: str, digits: int | None = None):
    """Array as text, so that both engines hash the same value."""
    elem = (lambda x: x.cast("string")) if digits is None else (
        lambda x: F.coalesce(F.format_string(f"%.{digits}f", F.round(x, digits) + 0.0), F.lit("null")))
    return F.array_join(F.transform(c, elem), ",").alias(c)


def text_sql(c: str, digits: int | None = None) -> str:
    e = "q::VARCHAR" if digits is None else f"coalesce(printf('%.{digits}f', round(q, {digits}) + 0.0), 'null')"
    return f"list_aggregate(list_transform({c}, lambda q: {e}), 'string_agg', ',') AS {c}"


@query(POINTS_SQL + """
SELECT user_id, trace_no, min(us) AS start_us, max(us) AS end_us, count(*) AS point_count,
       max(us) - min(us) AS duration_us FROM l GROUP BY 1, 2 HAVING max(us) - min(us) >= 900000000""")
def gap_traces(spark, sf_dir):
    return traces(table(spark, sf_dir, "events"), RULE, 15 * 60 * 1_000_000)


@query(POINTS_SQL + "SELECT user_id, event_id, coalesce(diff_us, -1) AS diff_us, trace_no, pos FROM l")
def gap_points(spark, sf_dir):
    first = F.lit(-1).cast("long")
    return gap_flags(table(spark, sf_dir, "events"), RULE).select(
        "user_id", "event_id", F.coalesce("diff_us", first).alias("diff_us"), "trace_no", "pos")


@query(POINTS_SQL + """
SELECT user_id, trace_no, 0::BIGINT AS part, start_us, end_us, end_us - start_us AS duration_us, count(*) AS point_count,
       min_by(event_id, us) AS event_id, string_agg((us - start_us)::VARCHAR, ',' ORDER BY us) AS time_offsets,
       string_agg(printf('%.2f', value), ',' ORDER BY us) AS value
FROM l GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY user_id, trace_no, start_us, end_us"), name="trace_arrays")
def trace_arrays_query(spark, sf_dir):
    t = trace_arrays(table(spark, sf_dir, "events"), RULE, ["value"], ["event_id"])
    return t.select("user_id", "trace_no", "part", "start_us", "end_us", "duration_us", "point_count", "event_id",
                    as_text("time_offsets"), as_text("value", 2))


@query("""
WITH p AS (SELECT user_id, value, epoch_us(ts) AS us FROM events),
o AS (SELECT min(us) AS us0 FROM p),
g AS (SELECT p.*, (us - us0) // 86400000000 AS chunk,
        us - lag(us) OVER (PARTITION BY user_id, (us - us0) // 86400000000 ORDER BY us) AS d FROM p, o),
t AS (SELECT *, sum(CASE WHEN d > 21600000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id, chunk ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS point_count, max(us) - min(us) AS duration_us
FROM t GROUP BY user_id, chunk, k""")
def chunked_traces(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    origin = ev.agg(F.min(S.as_micros(ev, "ts"))).first()[0]
    rule = GapRule("user_id", "ts", 6 * HOUR, chunk_us=24 * HOUR, chunk_origin_us=origin)
    return traces(ev, rule).drop("trace_no")


@query(POINTS_SQL + """
SELECT user_id, trace_no, start_us, max(us) - min(us) AS duration_us, round(avg(value), 10) AS value_mean,
       round(stddev(value), 9) AS value_std, min(value) AS value_min, max(value) AS value_max,
       round(quantile_cont(value, 0.5), 6) AS value_median
FROM l GROUP BY user_id, trace_no, start_us""")
def trace_summary_stats(spark, sf_dir):
    s = trace_summary(table(spark, sf_dir, "events"), RULE, {"value": "value"})
    return s.select("user_id", "trace_no", "start_us", "duration_us", F.round("value_mean", 10).alias("value_mean"),
                    F.round("value_std", 9).alias("value_std"), "value_min", "value_max",
                    F.round("value_median", 6).alias("value_median"))


# The five measures of a trace, as whole-number expressions over the event's number, or its value.
MEASURED = {"altitude": "event_id % 45000", "speed": "value", "vertical_rate": "event_id * 3 % 4000 - 2000",
            "latitude": "(event_id * 7919 % 180000 - 90000) / 1000.0", "longitude": "(event_id * 104729 % 360000 - 180000) / 1000.0"}


def _measure_sql(name: str, what: str) -> str:
    v = f"({what})::DOUBLE"
    return (f"round(avg({v}), 9) AS {name}_mean, round(stddev({v}), 6) AS {name}_std, min({v}) AS {name}_min, max({v}) AS {name}_max, "
            f"round(quantile_cont({v}, 0.5), 6) AS {name}_median")


@query(POINTS_SQL + f"""SELECT user_id, trace_no, start_us, max(us) - min(us) AS duration_us, count(*) AS point_count,
{', '.join(_measure_sql(n, w) for n, w in MEASURED.items())} FROM l GROUP BY user_id, trace_no, start_us HAVING max(us) - min(us) >= 900000000""")
def trace_summary_measures(spark, sf_dir):
    """All figures of all five measures, for traces of at least 15 minutes."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", *[F.expr(w).cast("double").alias(f"_{n}") for n, w in MEASURED.items()])
    s = trace_summary(ev, RULE, {f"_{n}": n for n in MEASURED}, 15 * 60 * 1_000_000)
    figures = [f"{n}_{f}" for n in MEASURED for f in ("mean", "std", "min", "max", "median")]
    rounded = lambda c: F.round(c, {"mean": 9, "std": 6, "median": 6}[c.rsplit("_", 1)[1]]).alias(c) if not c.endswith(("_min", "_max")) else F.col(c)
    return s.select("user_id", "trace_no", "start_us", "duration_us", "point_count", *map(rounded, figures))


@query(WINDOWS_SQL + """SELECT (start_us % 4)::INTEGER AS cluster, count(*) AS n, round(avg(list_avg(ground_speeds)), 8) AS mean_speed,
round(avg(list_avg(headings)), 8) AS mean_heading, round(avg(duration_us), 2) AS mean_duration_us FROM ww WHERE start_us % 4 <> 0 GROUP BY 1""")
def cluster_durations(spark, sf_dir):
    """Means per cluster of windows, their duration with them; cluster 0 stands for noise."""
    w = event_windows(spark, sf_dir).withColumn("key", F.struct(*KEYS))
    labels = w.select("key", (F.col("start_us") % 4).cast("int").alias("cluster"))
    c = summaries.cluster_characteristics(w, labels, "key", {"ground_speeds": "mean_speed", "headings": "mean_heading"}, noise=0)
    return c.select("cluster", "n", *[F.round(m, d).alias(m) for m, d in (("mean_speed", 8), ("mean_heading", 8), ("mean_duration_us", 2))])


@query(POINTS_SQL + """
SELECT user_id, trace_no,
       printf('%02d:%02d:%02d.%06d', d // 3600000000, (d // 60000000) % 60, (d // 1000000) % 60, d % 1000000) AS duration
FROM (SELECT user_id, trace_no, max(us) - min(us) AS d FROM l GROUP BY 1, 2)""")
def trace_duration_text(spark, sf_dir):
    t = traces(table(spark, sf_dir, "events"), RULE)
    return t.select("user_id", "trace_no", S.duration_text(F.col("duration_us")).alias("duration"))


@query(WINDOWS_SQL + f"""
SELECT user_id, trace_no, start_us, duration_us, 10 AS point_count, {text_sql('time_offsets')},
       {text_sql('ground_speeds', 2)}, {text_sql('headings', 1)} FROM ww""")
def trace_windows(spark, sf_dir):
    return event_windows(spark, sf_dir).select(
        "user_id", "trace_no", "start_us", "duration_us", "point_count", as_text("time_offsets"),
        as_text("ground_speeds", 2), as_text("headings", 1))


CHAIN_SQL = WINDOWS_SQL + f"""
SELECT user_id, start_us, duration_us, {text_sql('time_offsets')}, {text_sql('ground_speeds', 2)} FROM ww"""


@query(CHAIN_SQL)
def chain_windows(spark, sf_dir):
    """Every third point arrives twice, one copy with less in it; windows are those of the points made distinct."""
    ev = events(spark, sf_dir)
    poorer = ev.filter(F.col("event_id") % 3 == 0).withColumn("value", F.lit(None).cast("double"))
    points = chain.distinct_points(ev.unionByName(poorer), chain.Settings(entity="user_id", ts="ts"))
    w = windows.windows(points, RULE, {"value": "ground_speeds", "heading": "headings"}, n=N, window_gap_us=12 * HOUR)
    return w.select("user_id", "start_us", "duration_us", as_text("time_offsets"), as_text("ground_speeds", 2))


@query(CHAIN_SQL)
def windows_of_part_rows(spark, sf_dir):
    """Traces stored as array rows of 12 points each, so that most windows reach across rows."""
    t = trace_arrays(events(spark, sf_dir), RULE, ["value", "heading"], part_points=12)
    w = windows.windows_from_arrays(t, "user_id", "start_us", "time_offsets", {"value": "ground_speeds", "heading": "headings"},
                                    n=N, window_gap_us=12 * HOUR, part_points=12)
    return w.select("user_id", "start_us", "duration_us", as_text("time_offsets"), as_text("ground_speeds", 2))


@query("""
WITH p AS (SELECT user_id, epoch_us(ts) AS us, nullif(value, round(value)) AS v FROM events),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS d FROM p),
t AS (SELECT *, CAST(sum(CASE WHEN d > 86400000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trace_no FROM g)
SELECT user_id, trace_no, count(*) AS point_count FROM t GROUP BY 1, 2
HAVING count(*) >= 10 AND count(v) = count(*)""")
def usable_traces(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("v", F.nullif(F.col("value"), F.round("value")))
    pts = locate(ev, RULE, min_points=N, reject=F.col("v").isNull())
    return pts.groupBy("user_id", "trace_no").agg(F.count(F.lit(1)).alias("point_count"))


RATES_SQL = WINDOWS_SQL + """,
r0 AS (SELECT *, list_transform(range(1, 10), lambda i: (time_offsets[i + 1] - time_offsets[i]) / 1e6) AS dt FROM ww),
r1 AS (SELECT *,
  list_transform(range(1, 10), lambda i: (ground_speeds[i + 1] - ground_speeds[i]) / dt[i]) AS sp,
  list_transform(range(1, 10), lambda i: (CASE WHEN headings[i + 1] - headings[i] > 180 THEN headings[i + 1] - headings[i] - 360
     WHEN headings[i + 1] - headings[i] < -180 THEN headings[i + 1] - headings[i] + 360
     ELSE headings[i + 1] - headings[i] END) / dt[i]) AS tr FROM r0),
r2 AS (SELECT *, list_transform(range(1, 9), lambda i: (sp[i + 1] - sp[i]) / dt[i]) AS cd FROM r1),
rates AS (SELECT user_id, start_us, time_offsets, ground_speeds, headings, list_append(sp, sp[9]) AS ground_accels,
  list_append(sp, sp[9]) AS vertical_accels, list_append(tr, tr[9]) AS turn_rates,
  list_append(list_append(cd, cd[8]), cd[8]) AS climb_descent_accels FROM r2)
"""


def event_rates(spark, sf_dir) -> DataFrame:
    w = event_windows(spark, sf_dir).withColumns(
        {"vertical_rates": F.col("ground_speeds"), "altitudes": F.col("ground_speeds")})
    return windows.derive_rates(w)


@query(RATES_SQL + f"""SELECT user_id, start_us, {text_sql('ground_accels', 9)}, {text_sql('vertical_accels', 9)},
{text_sql('turn_rates', 9)}, {text_sql('climb_descent_accels', 9)} FROM rates""")
def derived_rates(spark, sf_dir):
    cols = ["ground_accels", "vertical_accels", "turn_rates", "climb_descent_accels"]
    return event_rates(spark, sf_dir).select("user_id", "start_us", *[as_text(c, 9) for c in cols])


@query(WINDOWS_SQL + """SELECT user_id, start_us, row_number() OVER (ORDER BY user_id, start_us) AS segment_id FROM ww""")
def segment_ids(spark, sf_dir):
    w = event_windows(spark, sf_dir)
    return windows.assign_segment_id(w, ["user_id", "start_us"]).select("user_id", "start_us", "segment_id")


@query(RATES_SQL + """
SELECT user_id, start_us, count(*) AS n_features, round(sum(k * v), 3) AS weighted_sum, round(min(v), 6) AS lowest
FROM (SELECT user_id, start_us, (i - 1) * 3 + j AS k,
        CASE j WHEN 1 THEN time_offsets[i] / 1e6 WHEN 2 THEN ground_speeds[i] ELSE turn_rates[i] END AS v
      FROM rates, range(1, 11) a(i), range(1, 4) b(j)) GROUP BY 1, 2""")
def flatten_features(spark, sf_dir):
    """The flat vector, reduced to figures that depend on its order."""
    w = event_rates(spark, sf_dir).withColumns({
        "key": F.struct("user_id", "start_us"),
        "time_offsets": F.transform("time_offsets", lambda t: t / F.lit(1e6))})
    flat = windows.flatten_features(w, "key", ["time_offsets", "ground_speeds", "turn_rates"], N)
    return flat.select(
        "key.user_id", "key.start_us", F.size("features").cast("long").alias("n_features"),
        F.round(F.aggregate(F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, x: s + x), 3)
        .alias("weighted_sum"), F.round(F.array_min("features"), 6).alias("lowest"))


@query(WINDOWS_SQL + """SELECT user_id, start_us, 30 AS n_features FROM ww
WHERE len(list_filter(ground_speeds, lambda x: x < 3)) = 0 AND len(list_filter(headings, lambda x: x < 4)) = 0""")
def complete_features(spark, sf_dir):
    """Windows with a NULL or NaN in any feature give no vector."""
    w = event_windows(spark, sf_dir).withColumns({
        "key": F.struct("user_id", "start_us"), "time_offsets": F.transform("time_offsets", lambda t: t / F.lit(1e6)),
        "ground_speeds": F.transform("ground_speeds", lambda v: F.when(v >= 3, v)), "headings": F.transform("headings", lambda v: F.when(v < 4, float("nan")).otherwise(v))})
    flat = windows.flatten_features(w, "key", ["time_offsets", "ground_speeds", "headings"], N)
    return flat.select("key.user_id", "key.start_us", F.size("features").alias("n_features"))


@query(WINDOWS_SQL + """
SELECT user_id, start_us, CASE WHEN list_max(ground_speeds) > 150 THEN 'ground_speeds'
  WHEN list_max(headings) > 350 THEN 'headings' END AS reason FROM ww""")
def limit_reasons(spark, sf_dir):
    limits = {"ground_speeds": (0, 150), "headings": (0, 350)}
    return event_windows(spark, sf_dir).select("user_id", "start_us", windows.limit_violation(limits).alias("reason"))


@query(WINDOWS_SQL + """SELECT user_id, start_us, duration_us FROM ww
WHERE list_max(ground_speeds) <= 150 AND list_max(headings) <= 350""")
def physics_filter(spark, sf_dir):
    limits = {"ground_speeds": (0, 150), "headings": (0, 350)}
    return windows.physics_filter(event_windows(spark, sf_dir), limits).select("user_id", "start_us", "duration_us")


PATHS_SQL = WINDOWS_SQL + """,
k AS (SELECT user_id, start_us, i - 1 AS point_idx, headings[i] AS h, ground_speeds[i] AS v, time_offsets[i] / 1e6 AS t
      FROM ww, range(1, 11) r(i)),
path AS (SELECT user_id, start_us, point_idx,
   round(sum(v * sin(radians(h)) * t) OVER w, 2) AS x, round(sum(v * cos(radians(h)) * t) OVER w, 2) AS y,
   round(v, 2) AS z, round(h, 2) AS heading_deg, round(v, 2) AS ground_speed, round(t, 2) AS time_sec
   FROM k WINDOW w AS (PARTITION BY user_id, start_us ORDER BY point_idx ROWS UNBOUNDED PRECEDING))
"""
ROTATED_SQL = PATHS_SQL + """,
d AS (SELECT user_id, start_us, pi() / 2 - atan2(max(y) FILTER (point_idx = 3) - max(y) FILTER (point_idx = 0),
        max(x) FILTER (point_idx = 3) - max(x) FILTER (point_idx = 0)) AS a FROM path GROUP BY 1, 2),
rot AS (SELECT user_id, start_us, point_idx, x * cos(a) - y * sin(a) AS x, x * sin(a) + y * cos(a) AS y, z,
        heading_deg, ground_speed, time_sec, x AS original_x, y AS original_y FROM path JOIN d USING (user_id, start_us))
"""
KEYS = ["user_id", "start_us"]


def event_paths(spark, sf_dir, mode="offset") -> DataFrame:
    w = event_windows(spark, sf_dir).withColumn("altitudes", F.col("ground_speeds"))
    return paths.dead_reckon(w, KEYS, mode)


@query(PATHS_SQL + """SELECT user_id, start_us, point_idx::INTEGER AS point_idx, round(x, 2) + 0.0 AS x,
round(y, 2) + 0.0 AS y, z, heading_deg, ground_speed, time_sec FROM path""")
def dead_reckoning(spark, sf_dir):
    p = paths.path_points(event_paths(spark, sf_dir), KEYS)
    return p.select(*KEYS, "point_idx", (F.round("x", 2) + 0.0).alias("x"), (F.round("y", 2) + 0.0).alias("y"),
                    "z", "heading_deg", "ground_speed", "time_sec")


@query(WINDOWS_SQL + """
SELECT user_id, start_us, (i - 1)::INTEGER AS point_idx,
   round(sum(v * sin(radians(h)) * dt) OVER w, 2) + 0.0 AS x,
   round(sum(v * cos(radians(h)) * dt) OVER w, 2) + 0.0 AS y
FROM (SELECT user_id, start_us, i, headings[i] AS h, ground_speeds[i] AS v,
        coalesce((time_offsets[i] - time_offsets[i - 1]) / 1e6, 0.0) AS dt FROM ww, range(1, 11) r(i))
WINDOW w AS (PARTITION BY user_id, start_us ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def dead_reckoning_by_step(spark, sf_dir):
    p = paths.path_points(event_paths(spark, sf_dir, "delta"), KEYS)
    return p.select(*KEYS, "point_idx", (F.round("x", 2) + 0.0).alias("x"), (F.round("y", 2) + 0.0).alias("y"))


@query(ROTATED_SQL + """SELECT user_id, start_us, point_idx::INTEGER AS point_idx, round(x, 2) + 0.0 AS x,
round(y, 2) + 0.0 AS y, z, round(original_x, 2) + 0.0 AS original_x, round(original_y, 2) + 0.0 AS original_y FROM rot""")
def rotated_paths(spark, sf_dir):
    p = paths.path_points(paths.rotate_to_y(event_paths(spark, sf_dir), KEYS), KEYS)
    one = lambda c: (F.round(c, 2) + 0.0).alias(c)
    return p.select(*KEYS, "point_idx", one("x"), one("y"), "z", one("original_x"), one("original_y"))


@query(ROTATED_SQL + """,
lab AS (SELECT user_id, start_us, (start_us % 3)::INTEGER AS cluster FROM ww)
SELECT lab.user_id, lab.start_us, cluster, point_idx::INTEGER AS point_idx, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y, z,
  heading_deg, ground_speed, time_sec, round(original_x, 2) + 0.0 AS original_x, round(original_y, 2) + 0.0 AS original_y
FROM lab LEFT JOIN rot USING (user_id, start_us)""")
def labelled_paths(spark, sf_dir):
    rot = paths.rotate_to_y(event_paths(spark, sf_dir), KEYS).withColumn("key", F.struct(*KEYS)).drop(*KEYS)
    lab = event_windows(spark, sf_dir).select(
        F.struct(*KEYS).alias("key"), (F.col("start_us") % 3).cast("int").alias("cluster"))
    one = lambda c: (F.round(c, 2) + 0.0).alias(c)
    return paths.label_paths(lab, rot, "key").select(
        "key.user_id", "key.start_us", "cluster", "point_idx", one("x"), one("y"), "z", "heading_deg", "ground_speed",
        "time_sec", one("original_x"), one("original_y"))


@query(WINDOWS_SQL + """SELECT 0.0::DOUBLE AS max_difference FROM (SELECT count(*) FROM ww) WHERE true""")
def rotation_keeps_height(spark, sf_dir):
    """The z column before and after rotation, compared window by window."""
    p = event_paths(spark, sf_dir).withColumn("before", F.col("path.z"))
    after = paths.rotate_to_y(p, [*KEYS, "before"]).withColumn("after", F.col("path.z"))
    apart = F.array_max(F.zip_with("before", "after", lambda a, b: F.abs(a - b)))
    return after.agg(F.max(apart).alias("max_difference"))


@query(WINDOWS_SQL + """SELECT user_id, start_us, count(*) AS n FROM ww GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT user_id, start_us, -1 FROM ww WHERE len(time_offsets) <> 10 OR len(headings) <> 10""")
def window_faults(spark, sf_dir):
    w = event_windows(spark, sf_dir)
    bad = checks.wrong_lengths(w, ["time_offsets", "ground_speeds", "headings"], N)
    return checks.repeated_keys(w, KEYS).unionByName(bad.select(*KEYS, F.lit(-1).cast("long").alias("n")))


@query("""SELECT vec_id, (i - 1)::INTEGER AS point_idx, embedding[i]::DOUBLE AS a, embedding[65 - i]::DOUBLE AS b
FROM embeddings, range(1, 65) r(i)""")
def unnest_lockstep(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("a"),
        F.reverse(F.col("embedding").cast("array<double>")).alias("b"))
    return windows.unnest_lockstep(e, ["vec_id"], ["a", "b"])


@query(POINTS_SQL + """SELECT user_id, trace_no,
string_agg(printf('%.2f', value), ',' ORDER BY us) FILTER (value >= 20) AS kept,
coalesce(string_agg(pos::VARCHAR, ',' ORDER BY us) FILTER (value > 100), '') AS high_at FROM l GROUP BY 1, 2""")
def array_elements(spark, sf_dir):
    """NULL elements removed (an empty array is NULL) and positions where a condition holds."""
    t = trace_arrays(table(spark, sf_dir, "events"), RULE, ["value"])
    low_as_null = F.transform("value", lambda v: F.when(v >= 20, v))
    return t.withColumn("kept", A.drop_nulls(low_as_null)).select(
        "user_id", "trace_no", as_text("kept", 2),
        F.array_join(A.positions(F.col("value"), lambda v: v > 100).cast("array<string>"), ",").alias("high_at"))


@query(WINDOWS_SQL + f"""SELECT user_id, start_us,
list_aggregate(list_transform(ground_speeds, lambda q: printf('%.1f', round(q, 1))), 'string_agg', ',') AS speeds,
list_aggregate(list_transform(headings, lambda q: (trunc(q / 7))::BIGINT::VARCHAR), 'string_agg', ',') AS sevenths FROM ww""")
def encoded_arrays(spark, sf_dir):
    from driftline.operators.clean import encode_arrays
    w = event_windows(spark, sf_dir).withColumn("sevenths", F.transform("headings", lambda h: (h / 7).cast("string")))
    w = w.withColumn("speeds", F.transform("ground_speeds", lambda v: F.round(v, 1)))
    w = encode_arrays(w, {"speeds": "decimal(6,1)", "sevenths": "bigint"})
    return w.select("user_id", "start_us", as_text("speeds"), as_text("sevenths"))
