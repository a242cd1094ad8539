import random

import pytest
from pyspark.sql import functions as F

import plain
from driftline.operators import traces as T
from driftline.operators import windows as W
from driftline.operators.summaries import trace_summary
from driftline.operators.traces import GapRule, gap_flags, trace_arrays, traces

S = 1_000_000


def points(spark, rows):
    return spark.createDataFrame([(i, t, float(v) if v is not None else None) for i, t, v in rows],
                                 "id string, us long, v double")


def rule(**kw):
    return GapRule("id", "us", 600 * S, **kw)


def test_gap_is_strict_and_duration_inclusive(spark):
    df = points(spark, [("a", 0, 1), ("a", 600 * S, 2), ("a", 1200 * S + 1, 3), ("b", 0, 1), ("b", 450 * S, 1), ("b", 900 * S, 1),
                        ("c", 0, 1), ("c", 450 * S, 1), ("c", 900 * S - 1, 1), ("d", 5, 1)])
    got = {(r.id, r.trace_no): (r.start_us, r.end_us, r.point_count) for r in traces(df, rule()).collect()}
    assert got == {("a", 0): (0, 600 * S, 2), ("a", 1): (1200 * S + 1, 1200 * S + 1, 1), ("b", 0): (0, 900 * S, 3),
                   ("c", 0): (0, 900 * S - 1, 3), ("d", 0): (5, 5, 1)}
    assert [r.id for r in traces(df, rule(), 900 * S).collect()] == ["b"]


@pytest.mark.parametrize("link_tiles", [4096, 3])
@pytest.mark.parametrize("kw", [{}, {"tile_us": 900 * S}, {"tile_rows": 3}, {"tile_us": 37 * S, "tile_rows": 2}])
def test_cells_do_not_change_traces(spark, monkeypatch, kw, link_tiles):
    """One entity holds most rows; small cells, split cells and small blocks of tiles give the same traces and positions."""
    monkeypatch.setattr(T, "LINK_TILES", link_tiles)
    rnd = random.Random(4)
    rows, want = [], {}
    for e, n in (("hot", 300), ("b", 40), ("c", 1)):
        t, ts = 10_000 * S, []
        for _ in range(n):
            t += rnd.choice([1, 30 * S, 599 * S, 600 * S, 600 * S + 1, 5000 * S])
            ts.append(t)
        rows += [(e, x, 1) for x in ts]
        for k, (a, b) in enumerate(plain.traces(ts, 600 * S)):
            want |= {(e, ts[i]): (k, i - a, ts[i] - ts[i - 1] if i else None) for i in range(a, b)}
    rnd.shuffle(rows)
    got = {(r.id, r.us): (r.trace_no, r.pos, r.diff_us) for r in gap_flags(points(spark, rows), rule(**kw)).collect()}
    assert got == want


def burst(spark, n):
    """Half of the points of one entity lie at one instant, the others a second apart around it."""
    at_once = spark.range(n).select(F.lit("a").alias("id"), F.lit(500 * S).alias("us"), F.col("id").alias("v"))
    return at_once.unionByName(spark.range(n // 10).select(F.lit("a").alias("id"), (F.col("id") * S).alias("us"), F.col("id").alias("v")))


def test_one_instant_does_not_make_one_cell(spark):
    df, r = burst(spark, 20_000), rule(tile_rows=1000)
    sizes = [c["count"] for c in T._cells(df, r).groupBy("id", "_tile", "_sub").count().collect()]
    assert sum(sizes) == 22_000 and max(sizes) < 1000
    got = T.locate(df, r).agg(F.count(F.lit(1)), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.max("trace_no"), F.min("point_count")).first()
    assert tuple(got) == (22_000, 22_000, 0, 21_999, 0, 22_000)
    order = T.locate(df, r).withColumn("late", F.col("us") > 500 * S).groupBy("late", F.col("us") == 500 * S).agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    assert sorted((o.low, o.high) for o in order.collect()) == [(0, 499), (500, 20_500), (20_501, 21_999)]
    tied = [r.v for r in T.locate(df, rule(tile_rows=1000, tiebreak=("v",))).where(F.col("us") == 500 * S).orderBy("pos").collect()]
    assert len(tied) == 20_001 and tied == sorted(tied)


def test_bursts_of_equal_points_and_null_times(spark):
    df = points(spark, [("a", 5, 1)] * 50 + [("a", None, 2), (None, 5, 2), ("b", 5, 1)])
    got = gap_flags(df, rule(tile_rows=10))
    assert got.count() == 51 and got.where("id = 'a'").agg(F.count_distinct("pos")).first()[0] == 50


def test_one_lazy_plan_one_shuffle_of_points(spark, tmp_path):
    """Nothing runs while the plan is made; points and summaries read the same shuffle, the input once."""
    burst(spark, 3000).write.parquet(f"{tmp_path}/points")
    df = spark.read.parquet(f"{tmp_path}/points")
    spark.sparkContext.setJobGroup("planning", "")
    got = T.locate(df, rule(), min_points=2)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == 0
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 2


def test_chunks_cut_at_clock_times(spark):
    df = points(spark, [("a", t * S, 1) for t in (0, 3599, 3600, 3700)])
    got = traces(df, rule(chunk_us=3600 * S)).orderBy("start_us").collect()
    # 3599 is more than 600 s after 0, 3600 starts a new hour
    assert [(r.start_us // S, r.point_count) for r in got] == [(0, 1), (3599, 1), (3600, 2)]


def test_arrays_keep_order_nulls_and_first_scalars(spark):
    df = spark.createDataFrame([("a", 3 * S, None, "x"), ("a", 1 * S, 1.0, None), ("a", 2 * S, 2.0, "y")],
                               "id string, us long, v double, flight string")
    r = trace_arrays(df, rule(), ["v"], ["flight"]).collect()
    assert len(r) == 1 and r[0].v == [1.0, 2.0, None] and r[0].time_offsets == [0, S, 2 * S] and r[0].flight is None
    parts = trace_arrays(df, rule(), ["v"], part_points=2).orderBy("part").collect()
    assert [(p.part, p.v, p.time_offsets, p.point_count) for p in parts] == [
        (0, [1.0, 2.0], [0, S], 3), (1, [None], [2 * S], 3)]


def series(sizes, seed=0, gap=10 * S):
    """One trace per size, steps of mostly seconds with some in-window gaps below the trace gap."""
    rnd = random.Random(seed)
    out = {}
    for k, n in enumerate(sizes):
        t, ts = 0, []
        for _ in range(n):
            t += rnd.choices([S, 10 * S, 10 * S + 1, 60 * S], [40, 5, 1, 1])[0]
            ts.append(t)
        out[f"e{k}"] = ts
    return out


def window_set(df):
    return sorted((r.id, r.start_us, r.duration_us, tuple(r.time_offsets), tuple(r.vs)) for r in df.collect())


def expected(data, n, half, gap):
    return sorted((e, ts[s], ts[s + n - 1] - ts[s], tuple(x - ts[s] for x in ts[s:s + n]), tuple(float(i) for i in range(s, s + n)))
                  for e, ts in data.items() for s in plain.window_starts(ts, n, half, gap))


@pytest.mark.parametrize("n,sizes", [(50, [49, 50, 51, 74, 75, 99, 100, 125, 400]), (10, [9, 10, 11, 24, 25, 37] + [60] * 10)])
@pytest.mark.parametrize("block", [4096, 60, 17])
def test_windows_match_plain_rules(spark, n, sizes, block):
    data = series(sizes, seed=n)
    df = points(spark, [(e, t, i) for e, ts in data.items() for i, t in enumerate(ts)])
    got = W.windows(df, rule(), {"v": "vs"}, n=n, block_points=max(block, n + 1))
    assert window_set(got) == expected(data, n, n // 2, 10 * S)


def test_windows_from_arrays_agree(spark):
    data = series([30, 45, 9, 100], seed=3)
    df = points(spark, [(e, t, i) for e, ts in data.items() for i, t in enumerate(ts)])
    arr = trace_arrays(df, rule(), ["v"])
    got = W.windows_from_arrays(arr, "id", "start_us", "time_offsets", {"v": "vs"}, n=10)
    assert window_set(got) == expected(data, 10, 5, 10 * S)


@pytest.mark.parametrize("gap_at", [24, 48, 49, 50, 149, 150])
def test_gap_positions(spark, gap_at):
    ts = [i * S + (30 * S if i > gap_at else 0) for i in range(200)]
    df = points(spark, [("a", t, i) for i, t in enumerate(ts)])
    assert window_set(W.windows(df, rule(), {"v": "vs"})) == expected({"a": ts}, 50, 25, 10 * S)


def test_null_policies(spark):
    ts = [i * S for i in range(40)]
    df = points(spark, [("a", t, None if i == 15 else i) for i, t in enumerate(ts)] + [("b", t, i) for i, t in enumerate(ts)])
    rejected = W.windows(df, rule(), {"v": "vs"}, n=10)
    assert {r.id for r in rejected.collect()} == {"b"}
    broken = W.windows(df, rule(), {"v": "vs"}, n=10, null_policy="break", block_points=11)
    starts = sorted(r.start_us // S for r in broken.filter("id = 'a'").collect())
    runs = {"a": ts[:15]}, {"a": ts[16:]}
    assert starts == sorted([r["a"][s] // S for r in runs for s in plain.window_starts(r["a"], 10, 5, 10 * S)])


def test_rates_wrap_and_tail(spark):
    df = spark.createDataFrame(
        [([0, S, 3 * S, 3 * S], [0.0, 60.0, 60.0, 0.0], [1.0, 2.0, 4.0, 5.0], [359.0, 1.0, 359.0, 10.0], [0.0, 10.0, 40.0, 50.0])],
        "time_offsets array<bigint>, vertical_rates array<double>, ground_speeds array<double>, headings array<double>, altitudes array<double>")
    r = W.derive_rates(df).first()
    assert r.turn_rates == [2.0, -1.0, None, None]
    assert r.ground_accels == [1.0, 1.0, None, None]
    assert r.vertical_accels == [60.0, 0.0, None, None]
    assert r.climb_descent_accels == [5.0, None, None, None]


def test_segment_ids_dense_and_features_round_trip(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    ids = {r.k: r.segment_id for r in W.assign_segment_id(df, ["k"]).collect()}
    assert ids == {k: k + 1 for k in range(1000)}
    one = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0]), (2, [None, 2.0], [3.0, 4.0])], "id int, as array<double>, bs array<double>")
    flat = W.flatten_features(one, "id", ["as", "bs"], 2)
    assert [tuple(r.features) for r in flat.collect()] == [(1.0, 3.0, 2.0, 4.0)]
    assert W.gather_features(flat, "id", ["as", "bs"], 2).first()["bs"] == [3.0, 4.0]
    assert W.spread_features(flat, "id", ["as", "bs"], 2).columns == ["id", "a_0", "b_0", "a_1", "b_1"]
    assert len(W.feature_names()) == 450


def test_physics_limits_are_inclusive(spark):
    df = spark.createDataFrame([(1, [12000.0], [0.0], [360.0], [-1000.0]), (2, [12000.5], [0.0], [360.0], [0.0]),
                                (3, [0.0], [-0.1], [0.0], [0.0])],
                               "id int, vertical_rates array<double>, ground_speeds array<double>, headings array<double>, altitudes array<double>")
    assert [r.id for r in W.physics_filter(df).collect()] == [1]
    assert [r.why for r in df.select(W.limit_violation().alias("why")).collect()] == [None, "vertical_rates", "ground_speeds"]


def test_medians_of_long_traces(spark):
    df = points(spark, [("a", i * S, (i * 37) % 101) for i in range(101)] + [("b", i * S, i) for i in range(4)])
    whole = {r.id: (r.m_median, r.m_mean, r.m_max) for r in trace_summary(df, rule(), {"v": "m"}).collect()}
    split = {r.id: (r.m_median, r.m_mean, r.m_max) for r in trace_summary(df, rule(), {"v": "m"}, in_task=10).collect()}
    assert whole == split == {"a": (50.0, 50.0, 100.0), "b": (1.5, 1.5, 3.0)}
