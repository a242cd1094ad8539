"""The trace archive source: which files are opened, how they are packed and cut, and what is rejected."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from driftline import schemas
from driftline.sources import archive, reports

DAYS = [dt.date(2024, 8, d) for d in (1, 2, 3)]


def point(t, n=14):
    return [t, 1.5, -2.25, 1000, 100.0, 90.0, 4, 64, {"flight": "F1", "nic": 8, "nav_qnh": 1013.6}, "adsb_icao", 1100, None, 200, -1.25][:n]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive"))
    docs = [(icao, day, json.dumps({"icao": icao, "timestamp": 1722470400.5, "trace": [point(k) for k in range(3)]}), day.day == 2)
            for icao in ("a0b1c2", "a0b1d3", "ffffd3", "~0001e") for day in DAYS]
    index = archive.write_archive(spark.createDataFrame(docs, "icao string, day date, text string, packed boolean"), path)
    return path, index


def test_written_and_listed(spark, made):
    path, index = made
    rows = lambda df: sorted((r.path.removeprefix("file:"), r.day, r.prefix, r.icao, r.bytes) for r in df.select("path", "day", "prefix", "icao", "bytes").collect())
    listed = rows(archive.list_archive(spark, path))
    assert listed == rows(spark.read.schema(archive.INDEX).parquet(index)) and len(listed) == 12
    assert rows(spark.read.parquet(archive.index_archive(spark, path))) == listed
    assert open(f"{path}/2024/08/02/d3/trace_full_ffffd3.json", "rb").read(2) == b"\x1f\x8b"
    assert not [f for _, _, names in os.walk(path) for f in names if f.startswith(".") and not f.endswith(".crc")]


def test_only_chosen_files_are_opened(spark, made):
    """Index rows of files that are not there: a read that opened one would fail."""
    path, index = made
    ghosts = [(f"{path}/gone-{i}.json", day, prefix, icao, 10) for i, (day, prefix, icao) in enumerate(
        [(dt.date(2024, 8, 9), "d3", "a0b1d3"), (DAYS[1], "zz", "00zz"), (None, "d3", None)])]
    both = spark.read.schema(archive.INDEX).parquet(index).unionByName(spark.createDataFrame(ghosts, archive.INDEX))
    with_ghosts = f"{path}-ghosts"
    both.write.parquet(with_ghosts)
    parts = archive.read_parts(spark, with_ghosts)
    got = lambda cond: sorted((r.icao, r.day.day) for r in parts.where(cond).select("icao", "day").collect())
    assert got((F.col("day") == F.lit(DAYS[1])) & (F.col("prefix") == "d3")) == [("a0b1d3", 2), ("ffffd3", 2)]
    assert got(archive.between_days(*DAYS[::2]) & F.col("prefix").isin("c2", "1e")) == [("a0b1c2", d) for d in (1, 2, 3)] + [("~0001e", d) for d in (1, 2, 3)]
    assert got((F.col("day") < F.lit(DAYS[2])) & F.col("icao").startswith("a0") & (F.col("day") > F.lit(DAYS[0]))) == [("a0b1c2", 2), ("a0b1d3", 2)]
    assert got(F.col("icao").eqNullSafe("ffffd3") & (F.col("day") >= F.lit(DAYS[1])) & (F.col("day") <= F.lit(DAYS[2]))) == [("ffffd3", 2), ("ffffd3", 3)]
    with pytest.raises(Exception, match="gone-"):  # nor does an earlier filter stay behind
        parts.collect()
    plan = parts.where(F.col("prefix") == "d3")._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " not in plan and "trace_archive" in plan
    # what the index cannot answer stays with Spark
    mixed = parts.where((F.col("prefix") == "d3") & (F.col("day") == F.lit(DAYS[0])) & (F.length("icao") == 6) & (F.col("part") == 0))
    assert mixed.count() == 2 and parts.where(F.col("day") == F.lit(dt.date(1999, 1, 1))).count() == 0


def test_packing():
    files = [(f"f{i}", None, "", "", size) for i, size in enumerate([10, 20, 3_000_000, 5, 40_000_000, 7])]
    runs = archive.packed_by_bytes(files, 8 << 20)
    assert [f for run in runs for f in run.files] == files
    assert all(len(r.files) == 1 or sum(f[4] + archive.OPEN_BYTES for f in r.files) <= 8 << 20 for r in runs) and len(runs) == 3
    assert archive.packed_by_bytes([], 100) == []


def test_long_files_come_in_parts():
    doc = {"icao": "a", "timestamp": 5, "trace": [point(k) for k in range(2500)]}
    parts = list(archive.parts_of(json.dumps(doc).encode()))
    assert [(p[2], len(p[3])) for p in parts] == [(0, 1000), (1, 1000), (2, 500)]
    assert parts[1][3][0][:4] == ["1000", "1.5", "-2.25", "1000"] and json.loads(parts[1][3][0][8])["nic"] == 8


def test_rejects_and_columns(spark, tmp_path):
    """As the reader of whole texts finds them."""
    bad = {"ok": {"icao": "aaaaaa", "timestamp": 1722470400.5, "trace": [point(0.25), point(5, 7), ["x", 1], point(2), 7, None, [None] * 9]},
           "none": {"icao": "bbbbbb", "timestamp": 1722470400, "trace": []}, "cut": '{"icao": "c', "list": "[1, 2]", "noname": {"timestamp": 1, "trace": [point(1)]}, "gz": "\x1f"}
    docs = [(n, f"2024/08/01/aa/trace_full_{n}.json", v if isinstance(v, str) else json.dumps(v), False) for n, v in bad.items()]
    df = spark.createDataFrame(docs, "icao string, name string, text string, packed boolean")
    archive.write_files(df, str(tmp_path)).collect()
    points, rejects = archive.ingest(archive.read_parts(spark, archive.index_archive(spark, str(tmp_path))), f"{tmp_path}-out")
    assert dict(points.dtypes) == schemas.TRACE_POINTS and points.count() == 2
    lists = json.dumps({**bad["ok"], "trace": [p for p in bad["ok"]["trace"] if isinstance(p, list)]})
    old = reports.explode_trace_points(spark.createDataFrame([("x", lists)], "path string, text string")).drop("source_file_path")
    assert points.drop("source_file_path").exceptAll(old).count() == 0 and old.count() == 2
    per_file = {os.path.basename(r.path): r.rejected for r in archive.rejects_per_file(rejects).collect()}
    assert per_file == {"trace_full_ok.json": 5, "trace_full_cut.json": 1, "trace_full_list.json": 1, "trace_full_noname.json": 1, "trace_full_gz.json": 1}
    assert {r.fault for r in rejects.collect()} == {reports.UNREADABLE, reports.INCOMPLETE}


def test_plan_holds_places_and_few_tasks(spark, tmp_path):
    """3000 small files: a plan of few tasks that names no file; filters leave the same rows in plan and tasks."""
    docs = spark.range(3000).selectExpr("lower(hex(id + 4096)) AS icao", "date_add(DATE'2024-08-01', CAST(id % 3 AS INT)) AS day",
                                        "concat('{\"icao\":\"', id, '\",\"timestamp\":5,\"trace\":[]}') AS text", "false AS packed")
    index = archive.write_archive(docs, str(tmp_path / "files"), str(tmp_path / "index"))
    reader = archive.ArchiveReader({"index": index})
    plan = reader.partitions()
    assert len(plan) <= 8 and "trace_full" not in str([p.files for p in plan])
    assert sum(b - a for p in plan for _, _, a, b, _ in p.files) == 3000
    parts = archive.read_parts(spark, index, 1 << 20)
    assert parts.count() == 3000 == parts.select("path").distinct().count()
    assert parts.where(F.col("prefix") == "a1").count() == docs.where(F.col("icao").endswith("a1")).count() > 0


def test_long_texts_reach_the_writer_in_small_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    docs = spark.range(40, numPartitions=1).selectExpr("concat('d/', id) AS name", "repeat('x', 1000000) AS text", "false AS packed")
    written = archive.write_files(docs, str(tmp_path))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    assert written.agg(F.sum("bytes")).first()[0] == 40_000_000 and len(os.listdir(tmp_path / "d")) == 40
