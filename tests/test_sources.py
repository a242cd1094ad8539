import gzip
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline import schemas
from driftline.functions import scalars as S
from driftline.operators import clean
from driftline.plans import chain
from driftline.session import broadcast_if_small
from driftline.sources import reports, tables, versions
from driftline.operators.traces import GapRule
from driftline.streaming import flows


def put(path, doc, packed=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    raw = doc if isinstance(doc, bytes) else json.dumps(doc).encode()
    with open(path, "wb") as f:
        f.write(gzip.compress(raw) if packed else raw)


def snapshot(now, *craft, **more):
    return {**({"now": now} if now is not None else {}), "messages": 9, "aircraft": list(craft), **more}


def test_snapshots(spark, tmp_path):
    base = f"{tmp_path}/snap"
    a = {"hex": "abc", "flight": " XY1 ", "alt_baro": "ground", "gs": 12.34, "seen": 2.0, "r": "N1", "t": "B738", "type": "adsb_icao"}
    put(f"{base}/2024/08/01/000000Z.json", snapshot(1722470400.0, a, {"hex": "def", "alt_baro": "Ground"}))
    put(f"{base}/2024/08/01/000500Z.json.gz", snapshot(1722470700.0, {"hex": "abc", "alt_baro": 3000}), packed=True)
    put(f"{base}/2024/08/01/001000Z.json", snapshot(None))
    put(f"{base}/2024/08/02/000000Z.json", snapshot(1722556800.0, {"hex": "zzz"}))
    pts = reports.snapshot_points(reports.read_snapshots(spark, base))
    assert dict(pts.dtypes) == schemas.SNAPSHOT_POINTS
    rows = {(r.snapshot_timestamp, r.hex): r for r in pts.collect()}
    assert len(rows) == 4
    r = rows[(1722470400, "abc")]
    assert (r.actual_timestamp, r.flight, r.registration, r.type, r.alt_baro, float(r.ground_speed)) == (
        1722470398, "XY1", "N1", "B738", 0, 12.3)
    d = rows[(1722470400, "def")]
    assert d.alt_baro is None and d.flight == "" and d.nav_modes == [] and d.messages == 0
    assert rows[(1722470700, "abc")].alt_baro == 3000
    picked = reports.read_snapshots(spark, base, datetime(2024, 8, 1), datetime(2024, 8, 1, 0, 5))
    assert picked.count() == 3  # both ends count
    late = reports.read_snapshots(spark, base, datetime(2024, 8, 1, 0, 5), datetime(2024, 8, 2))
    assert {r.hex for r in late.select("a.hex").collect()} == {"abc", "zzz"}


def point(t, alt=1000, n=14, meta=None):
    return [t, 1.5, -2.25, alt, 100.0, 90.0, 4, 64, meta, "adsb_icao", 1100, 65, 200, -1.25][:n]


def test_trace_files(spark, tmp_path):
    base = f"{tmp_path}/tr"
    put(f"{base}/aa/trace_full_a.json", {"icao": "aaaaaa", "timestamp": 1722470400.5, "trace": [
        point(0.25), point(1, "Ground"), point(2, meta={"flight": "F1", "nic": 8, "nav_qnh": 1013.6}), point(3, n=9),
        point(4, n=8), point(5, n=7), point(6, meta={}), ["x", 1]]}, packed=True)
    put(f"{base}/bb/trace_full_b.json", {"icao": "~bbbbb", "timestamp": 1722470400, "trace": [point(0)]})
    put(f"{base}/bb/trace_full_c.json", b'{"icao": "cccccc", "timestamp": 17224')
    put(f"{base}/bb/trace_full_d.json", b"\x1f\x8bbroken")
    files = reports.read_trace_files(spark, base)
    pts = reports.explode_trace_points(files)
    assert dict(pts.dtypes) == schemas.TRACE_POINTS
    rows = pts.filter("icao = 'aaaaaa'").orderBy("actual_timestamp").collect()
    assert [float(r.seconds_offset) for r in rows] == [0.25, 1, 2, 3, 4, 6]
    assert pts.filter("icao = 'aaaaaa'").select(F.min(F.unix_micros("actual_timestamp"))).first()[0] == 1722470400750000
    assert rows[1].altitude_baro == 0 and rows[2].flight == "F1" and float(rows[2].nav_qnh) == 1013.6
    assert rows[0].flight is None and rows[0].base_timestamp == 1722470400
    assert rows[3].source_type is None and rows[0].altitude_geom == 1100 and float(rows[0].roll_angle) == -1.25
    assert clean.registered_only(pts, "icao").count() == 6
    bad = {os.path.basename(r.path): r.rejected for r in reports.rejected(files).collect()}
    assert bad == {"trace_full_a.json": 2, "trace_full_c.json": 1, "trace_full_d.json": 1}


def test_links(spark):
    html = ('<a href="trace_full_abc123.json">x</a><A class=k HREF=\'trace_full_~def456.json\'>y</a>'
            '<a href="other.json">z</a><a href="trace_full_1.txt">w</a>')
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r.file_id for r in reports.extract_links(df, "html", "trace_full_", ".json").collect()] == ["abc123", "def456"]


def test_dedupe_rules(spark):
    df = spark.createDataFrame([("k", 1, "a", None, 3), ("k", 1, "b", "x", 1), ("k", 1, "c", "y", 2), ("k", 2, None, None, 4)],
                               "id string, t int, u string, v string, seq int")
    best = {(r.id, r.t): r.u for r in clean.keep_richest(df, ["id", "t"], ["seq"]).collect()}
    assert best == {("k", 1): "b", ("k", 2): None}
    assert {r.t: r.u for r in clean.keep_last(df, ["id", "t"], ["seq"]).collect()} == {1: "a", 2: None}
    assert clean.exact_dedupe(df.unionByName(df)).count() == 4


def test_prefixes():
    assert clean.prefix_bounds("A0", "ff") == ("a0", "ff")
    for bad in (("b0", "a0"), ("g0", "ff"), ("a", "ff")):
        with pytest.raises(ValueError):
            clean.prefix_bounds(*bad)


def test_scalars(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:59", "2024-01-01 00:01:01", 359.0, 1.0, 5430000001)],
                               "a string, b string, h1 double, h2 double, us bigint")
    df = df.withColumns({"a": F.col("a").cast("timestamp"), "b": F.col("b").cast("timestamp")})
    r = df.select(S.minutes_crossed(F.col("a"), F.col("b")), S.heading_change(F.col("h1"), F.col("h2")),
                  S.heading_change(F.col("h2"), F.col("h1")), S.duration_text(F.col("us")), S.as_micros(df, "us", "ms"),
                  S.percent(F.lit(1), F.lit(0)), S.minutes_since_midnight(F.col("b"))).first()
    assert tuple(r) == (1, 2.0, -2.0, "01:30:30.000001", 5430000001000, None, 1)


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, -70000, 0.5, 0.1, 2.0 ** 40), (2, -1, 5, 1.25, 0.2, 1.0)],
                               "a bigint, b bigint, c bigint, d double, e double, f double")
    # 0.1 as float would be 0.10000000149: exact by default, near enough only on request
    assert clean.narrowest_types(df) == {"a": "tinyint", "b": "smallint", "c": "int", "d": "float", "e": "double", "f": "bigint"}
    assert clean.narrowest_types(df, tolerance=1e-7)["e"] == "float"
    assert clean.narrow(df).orderBy("a").first().asDict()["b"] == 300


def test_narrow_keeps_what_fits_no_smaller_type(spark):
    df = spark.createDataFrame([(1e20, -1e20, 0.1, None, 5.0, float("nan"), 2.0 ** 63), (1.0, 2.0, 0.5, None, None, 1.0, 1.0)],
                               "a double, b double, c double, d double, e double, f double, g double").withColumns(
        {"m": F.lit("1.25").cast("decimal(10,2)"), "w": F.lit("7.00").cast("decimal(10,2)"), "big": F.lit(2 ** 62 + 1).cast("bigint")})
    got = clean.narrowest_types(df)
    assert got == {"a": "double", "b": "double", "c": "double", "e": "tinyint", "f": "float", "g": "float", "m": "decimal(10,2)", "w": "tinyint", "big": "bigint"}
    back = clean.narrow(df).select("a", "b", "c", "e", "g", "m", "big").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.select("a", "b", "c", "e", "g", "m", "big").collect()]
    assert clean.narrow(df.limit(0)).columns == df.columns


def test_partitioned_write_spreads_a_hot_prefix(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "aa0001").otherwise(F.md5(F.col("id").cast("string"))).alias("icao"),
                                   F.col("id").alias("t"))
    counts = {r.hex_prefix: r.rows for r in tables.write_partitioned(df, path, "icao", "t", partitions=8).collect()}
    read = lambda: spark.read.schema("icao string, t bigint, hex_prefix string").parquet(path)
    assert read().count() == 30000 == sum(counts.values()) and len(os.listdir(f"{path}/hex_prefix=aa")) > 2
    assert sum(n.endswith(".parquet") for n in os.listdir(f"{path}/hex_prefix=01")) <= 2
    new = spark.createDataFrame([("aa0001", 0, "aa"), ("aa9999", 99999, "aa")], "icao string, t bigint, hex_prefix string")
    tables.upsert_partitions(spark, path, new, ["icao", "t"], ["t"])
    assert read().count() == 30001
    plan = read().filter(F.col("hex_prefix").between("10", "1f"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hex_prefix" in plan


def test_report_and_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "column_name string, n bigint")
    tables.write_report(df, f"{tmp_path}/r")
    assert tables.read_report(spark, f"{tmp_path}/r").select("column_name", "n").collect() == df.collect()
    tables.write_parquet(df, f"{tmp_path}/p")
    assert tables.read_table(spark, f"{tmp_path}/p").collect() == df.collect()
    df.createOrReplaceTempView("some_table")
    assert tables.read_table(spark, "some_table").count() == 1
    hint = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hint(broadcast_if_small(df, 10, 10)).lower()
    assert "broadcast" not in hint(broadcast_if_small(df, 10**8, 10)).lower()


def test_streams(spark, tmp_path):
    base = f"{tmp_path}/in"
    put(f"{base}/1.json", snapshot(1722470400.0, {"hex": "a"}, {"hex": "b"}))
    run = lambda: flows.run_available(
        flows.without_repeats(flows.snapshot_stream(spark, base).withColumn("at", F.timestamp_seconds("snapshot_timestamp")),
                              "at", schemas.SNAPSHOT_KEY).drop("at"), f"{tmp_path}/out", f"{tmp_path}/ck")
    run()
    put(f"{base}/2.json", snapshot(1722470400.0, {"hex": "a"}))
    put(f"{base}/3.json", snapshot(1722470700.0, {"hex": "a"}))
    run()
    run()
    got = spark.read.parquet(f"{tmp_path}/out").select("snapshot_timestamp", "hex").collect()
    assert sorted(map(tuple, got)) == [(1722470400, "a"), (1722470400, "b"), (1722470700, "a")]


def test_whole_chain(spark):
    """Points of circling and climbing objects to labelled, rotated paths."""
    n, objects = 950, 6
    i = F.col("id") % n
    k = F.floor(F.col("id") / n)
    pts = spark.range(n * objects).select(
        F.concat(F.lit("ab000"), k.cast("string")).alias("icao"),
        F.timestamp_micros((1722470400 + i) * 1_000_000).alias("actual_timestamp"),
        F.when(k < 3, 0).otherwise((F.rand(1) * 5 + 1500).cast("int")).alias("vertical_rate_baro"),
        (F.lit(200.0) + F.rand(2)).alias("ground_speed"), ((i * k) % 360).cast("double").alias("track"),
        F.when(k < 3, 3000).otherwise(3000 + i * 25).cast("int").alias("altitude_baro"))
    s = chain.Settings(code_size=6, cluster_on="code", min_cluster_size=8, epsilon=0.0)
    wins = chain.training_windows(pts, s)
    assert wins.count() == objects * (19 + 18)
    labels = chain.cluster_windows(wins, s)
    assert labels.count() == objects * 37
    out = chain.labelled_trajectories(wins, labels, s)
    assert out.count() == objects * 37 * 50


def test_table_forms(spark, tmp_path):
    base = f"{tmp_path}/tr"
    put(f"{base}/trace_full_a.json", {"icao": "aaaaaa", "timestamp": 1722470400, "trace": [
        point(300 * i, 1000 + i, meta={"flight": "F1", "nav_heading": 12.345, "squawk": "7000"} if i else None) for i in range(5)]})
    pts = reports.read_traces(spark, base)
    r = chain.point_traces(pts).first()
    assert r.duration_us == 1_200_000_000 and r.altitude_baro == [1000, 1001, 1002, 1003, 1004]
    assert r.squawk == [None] + ["7000"] * 4 and r.flight is None and float(r.nav_heading[1]) == 12.35
    f = chain.trace_features(pts).first()
    assert (f.altitude_min, f.altitude_max, f.altitude_median, f.speed_std) == (1000, 1004, 1002.0, 0.0)
    rep = chain.day_report(pts)
    assert rep["total_rows"].first()[0] == 5 and rep["over_duration"].first()[0] == 1
    assert {x.column_name: x.null_count for x in rep["null_counts"].collect()}["flight"] == 1
    values = {x.column_name: x["values"] for x in rep["distinct_values"].collect()}
    assert values["flight"] == ["F1", None] and values["source_type"] == ["adsb_icao"]
    snaps = spark.createDataFrame([(1722470400 + 300 * i, "abc", 1722470400 + 300 * i - 2) for i in (0, 1, 2, 5)],
                                  "snapshot_timestamp bigint, hex string, actual_timestamp bigint")
    full = snaps.withColumns({c: F.lit(None).cast(t) for c, t in schemas.SNAPSHOT_POINTS.items() if c not in snaps.columns})
    got = chain.snapshot_traces(full, "s").orderBy("time_stamp_start").collect()
    assert [(x.point_count, x.duration, len(x.latitude)) for x in got] == [(3, 600, 3), (1, 0, 1)]


def test_streams_lose_no_row_silently(spark, tmp_path):
    """400 rows in four files out of time order."""
    rows = [(i, f"2024-01-0{d} 00:00:{i % 60:02d}") for k, d in enumerate((4, 1, 3, 2)) for i in range(100 * k, 100 * k + 100)]
    for k in range(4):
        part = spark.createDataFrame(rows[100 * k:100 * k + 100], "id long, t string").select("id", F.col("t").cast("timestamp").alias("t"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("id long, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    flows.merge_available(read(), f"{tmp_path}/merged", f"{tmp_path}/c1", ["id"], ["t"])
    assert spark.read.parquet(f"{tmp_path}/merged").count() == 400
    flows.merge_available(read(), f"{tmp_path}/merged", f"{tmp_path}/c1", ["id"], ["t"])  # nothing new
    assert spark.read.parquet(f"{tmp_path}/merged").count() == 400
    with pytest.raises(RuntimeError, match="dropped"):
        flows.run_available(flows.without_repeats(read(), "t", ["id"]), f"{tmp_path}/cut", f"{tmp_path}/c2")


def test_a_batch_reads_the_stored_keys_of_its_days(spark, tmp_path):
    """Six files, a day each, out of time order, then the first day once more with one new row."""
    for k in (3, 0, 5, 1, 4, 2, 3):
        rows = [(100 * k + i, f"2024-01-0{k + 1} 00:00:{i:02d}") for i in range(51 if os.path.exists(f"{tmp_path}/in") and k == 3 else 50)]
        spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema("id long, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    day = F.floor(F.unix_micros("t") / 86_400_000_000)
    log = flows.merge_available(arriving, f"{tmp_path}/out", f"{tmp_path}/ck", ["id"], ["t"], day)
    assert [(r["buckets"], r["stored_read"]) for r in log] == [(1, 0)] * 6 + [(1, 50)]
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("id").distinct().count() == 301


def test_live_traces_of_late_and_repeated_batches(spark, tmp_path):
    s = 1_000_000
    rule = GapRule("id", "us", 10 * s)
    live = flows.LiveTraces(rule, ("v",), (), 20 * s, f"{tmp_path}/live")
    batch = lambda *rows: spark.createDataFrame([(e, t * s, float(t)) for e, t in rows], "id string, us long, v double")
    spans = lambda df: sorted((r.id, r.start_us // s, r.end_us // s, r.point_count, r.v) for r in df.collect())
    live._step(batch(("a", 5), ("a", 0), ("b", 3), (None, 1)), 0)
    assert spans(live.closed(spark)) == [] and spans(live.open(spark)) == [("a", 0, 5, 2, [0, 5]), ("b", 3, 3, 1, [3])]
    for _ in range(2):  # a batch that is repeated gives the same
        live._step(batch(("a", 40), ("a", 12), ("b", 30)), 1)
        assert spans(live.closed(spark)) == [("b", 3, 3, 1, [3])]  # the horizon is 20: a might still go on at 22
    live._step(batch(("a", 19), ("b", 20), ("a", 22), ("b", 60)), 2)
    assert [(r.id, r.us // s) for r in live.late(spark).collect()] == [("a", 19)]
    live._step(batch(), 3)
    together = spans(live.closed(spark)) + spans(live.open(spark))
    assert sorted(together) == [("a", 0, 22, 4, [0, 5, 12, 22]), ("a", 40, 40, 1, [40]), ("b", 3, 3, 1, [3]), ("b", 20, 30, 2, [20, 30]), ("b", 60, 60, 1, [60])]


def test_versions(spark, tmp_path):
    t = versions.VersionedTable(spark, f"{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v int, hex_prefix string")
    got = lambda n=None: sorted(map(tuple, t.read(n).select("id", "v", "hex_prefix").collect()))
    assert t.create(rows(("a1", 1, "a"), ("a2", 2, "a"), ("b1", 3, "b")), ["id"]) == 0
    open_read = t.read()  # planned before, read after the next versions are made
    assert t.upsert(rows(("a1", 10, "a"), ("a1", 11, "a"), ("c1", 4, "c")), ["id"], ["v"]) == 1
    assert got(0) == [("a1", 1, "a"), ("a2", 2, "a"), ("b1", 3, "b")] and got() == [("a1", 11, "a"), ("a2", 2, "a"), ("b1", 3, "b"), ("c1", 4, "c")]
    assert sorted(map(tuple, open_read.select("id", "v", "hex_prefix").collect())) == got(0)
    first, second = t.manifest(0)["folders"], t.manifest(1)["folders"]
    assert first["b"] == second["b"] and first["a"] != second["a"]  # untouched folders are shared
    assert t.insert(rows(("b1", 9, "b"), ("b2", 8, "b"), ("b2", 7, "b")), ["id"], ["v"]) == 2
    assert got()[2:4] == [("b1", 3, "b"), ("b2", 7, "b")]
    t.upsert(rows(("a1", 99, "a")), ["id"], ["v"], swap=False)
    assert t.versions() == [0, 1, 2] and ("a1", 11, "a") in got()
    with pytest.raises(versions.Overtaken):
        t._swap(2, t.manifest(1))
    assert t.versions() == [0, 1, 2] and ("b2", 7, "b") in got()


def test_scratch_is_cleared(spark):
    from driftline.session import clear_scratch, materialise
    clear_scratch(spark)
    df = materialise(spark.range(5))
    assert df.count() == 5 and clear_scratch(spark) == 1 and clear_scratch(spark) == 0
    assert not os.path.exists(df.inputFiles()[0].removeprefix("file:"))
