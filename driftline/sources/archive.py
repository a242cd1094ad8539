"""An archive of trace files as a Spark data source: day and id pruning, tasks packed by bytes, long files cut into parts.

The files of an archive have an index, a table of (path, day, prefix, icao, bytes) that is written with them, or made by Spark
from the listing of an archive that comes without one. The source ``trace_archive`` plans from that index: filters on day, prefix and icao are taken over and read
from it only the files that hold them; the files left are packed into tasks of about equal bytes. The plan reads their sizes
alone: a task gets places in the index and reads its own rows there, so the driver holds no row a file. A task opens one file at a
time and hands its points on in parts of bounded size, so no row holds a whole trace. A file that cannot be read gives one
row that says so, and so does every point that lacks something: points and rejects come from the same pass.

Files are opened through pyarrow's file systems by their URI, in the tasks: no content passes the driver.
"""

from __future__ import annotations

import datetime as dt
import gzip
import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from driftline.session import scratch_path
from driftline.sources.reports import UNREADABLE, trace_rows

INDEX = "path string, day date, prefix string, icao string, bytes long"
PART = "path string, day date, prefix string, icao string, name string, base double, part int, points array<array<string>>, fault string"
PACKED_BYTES = 64 << 20
OPEN_BYTES = 1 << 14  # what opening a file costs, in bytes read: tasks of thousands of small files, not of dozens
BATCH_BYTES = 8 << 20
PART_POINTS = 1000
BATCH_POINTS = 4 * PART_POINTS  # handed on together; files without points are a few bytes each


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


# ---- writing and listing -------------------------------------------------------------------------------------

def write_files(rows: DataFrame, path: str) -> DataFrame:
    """Write (name, text, packed) rows as files below ``path``, one a row, from the tasks; ``packed`` ones are gzip content
    whatever the name says. Gives (name, path, bytes) rows; the files are written as these are read.

    A task that runs again writes the same files again: each is written beside its place, then moved there. Texts reach a
    task in batches of few bytes, whatever their length, and one at a time leaves its batch.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(path)
        made: set[str] = set()
        for batch in batches:
            out = []
            for name, text, packed in ((x.as_py() for x in row) for row in zip(*(batch.column(c) for c in ("name", "text", "packed")))):
                folder, _, last = name.rpartition("/")
                if folder not in made:
                    fs.create_dir(f"{top}/{folder}", recursive=True)
                    made.add(folder)
                data = gzip.compress(text.encode(), 1) if packed else text.encode()
                beside = f"{top}/{folder}/.{last}-{os.getpid()}"
                with fs.open_output_stream(beside, compression=None) as f:
                    f.write(data)
                fs.move(beside, f"{top}/{name}")
                out.append((name, f"{path}/{name}", len(data)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["name", "path", "bytes"])
    return rows.select("name", "text", "packed").mapInArrow(write, "name string, path string, bytes long")


NAMED = r"(\d{4}/\d{2}/\d{2})/([^/]+)/trace_full_([^/]+)\.json$"


def _index_rows(files: DataFrame) -> DataFrame:
    part = lambda n: F.regexp_extract("path", NAMED, n)
    return files.where(F.col("path").rlike(NAMED)).select(
        "path", F.to_date(part(1), "yyyy/MM/dd").alias("day"), part(2).alias("prefix"), part(3).alias("icao"), "bytes")


def write_archive(docs: DataFrame, path: str, index: str | None = None) -> str:
    """Write (icao, day, text, packed) rows as files yyyy/MM/dd/<last two of icao>/trace_full_<icao>.json and their index with
    them; returns where the index is."""
    index = index or scratch_path(docs.sparkSession, "archive-index")
    name = F.concat(F.date_format("day", "yyyy/MM/dd/"), F.right("icao", F.lit(2)), F.lit("/trace_full_"), "icao", F.lit(".json"))
    _index_rows(write_files(docs.select(name.alias("name"), "text", "packed"), path)).write.mode("overwrite").parquet(index)
    return index


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of an archive, from the listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return _index_rows(files.select("path", F.col("length").alias("bytes")))


def index_archive(spark: SparkSession, path: str, index: str | None = None) -> str:
    """Write the index of an archive, ordered so that a day and prefix lie together, and return where it is."""
    index = index or scratch_path(spark, "archive-index")
    list_archive(spark, path).repartitionByRange("day", "prefix").sortWithinPartitions("day", "prefix", "icao").write.mode("overwrite").parquet(index)
    return index


# ---- reading -------------------------------------------------------------------------------------------------

class Files(InputPartition):
    """Places in the index: (its file, row group, first and last row among those that the filters leave, bytes)."""

    def __init__(self, files: list[tuple]):
        self.files = files


def packed_by_bytes(files: list[tuple], most: int) -> list[Files]:
    """Rows in order, cut into runs of at most ``most`` bytes, which are the last of five fields (a larger row is a run of its own)."""
    out: list[Files] = []
    run, size = [], 0
    for row in files:
        cost = row[4] + OPEN_BYTES
        if run and size + cost > most:
            out.append(Files(run))
            run, size = [], 0
        run.append(row)
        size += cost
    return out + [Files(run)] if run else out


def plain_bytes(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parts_of(data: bytes) -> Iterator[tuple]:
    """(name, base, part, points, fault) of one file: its points in parts of ``PART_POINTS``, every value as its text."""
    try:
        doc = json.loads(plain_bytes(data))
        name, base, points = doc["icao"], float(doc["timestamp"]), doc["trace"]
        if not isinstance(name, str) or not isinstance(points, list):
            raise ValueError
    except (OSError, EOFError, zlib.error, ValueError, KeyError, TypeError):  # compressed, encoded or built wrongly
        yield None, None, 0, [], UNREADABLE
        return
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    for k in range(0, max(1, len(points)), PART_POINTS):
        # a point that is no list becomes a list too short to be used
        yield name, base, k // PART_POINTS, [[text(x) for x in p] if isinstance(p, list) else [] for p in points[k:k + PART_POINTS]], None


_NAMES = [("path", pa.string()), ("day", pa.date32()), ("prefix", pa.string()), ("icao", pa.string()), ("name", pa.string()),
          ("base", pa.float64()), ("part", pa.int32()), ("points", pa.list_(pa.list_(pa.string()))), ("fault", pa.string())]
_TESTS = {EqualTo: "__eq__", EqualNullSafe: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
_INDEXED = ("day", "prefix", "icao")


def _condition(f: Filter):
    """The filter on the index, or None if the index cannot answer it."""
    if isinstance(f, IsNotNull) and f.attribute[0] in (*_INDEXED, "path"):
        return ds.field(f.attribute[0]).is_valid()
    if getattr(f, "attribute", ("",))[0] not in _INDEXED or getattr(f, "value", None) is None:
        return None
    field = ds.field(f.attribute[0])
    if type(f) in _TESTS:
        return getattr(field, _TESTS[type(f)])(f.value)
    if isinstance(f, In):
        return field.isin([v for v in f.value if v is not None])
    if isinstance(f, StringStartsWith):
        import pyarrow.compute as pc
        return pc.starts_with(field, f.value)
    return None


class ArchiveReader(DataSourceReader):
    """Plans from the index with the filters taken over; a task reads its files one after the other."""

    def __init__(self, options: dict[str, str]):
        self.index = options["index"]
        self.most = int(options.get("packedBytes", PACKED_BYTES))
        self.conditions: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            condition = _condition(f)
            if condition is None:
                yield f
            else:
                self.conditions.append(condition)

    def _chosen(self):
        chosen = None
        for c in self.conditions:
            chosen = c if chosen is None else chosen & c
        return chosen

    def partitions(self) -> Sequence[InputPartition]:
        fs, at = file_system(self.index)
        chosen, places = self._chosen(), []
        for fragment in ds.dataset(at, filesystem=fs, format="parquet").get_fragments():
            for group in fragment.split_by_row_group():
                cost = group.to_table(filter=chosen, columns=["bytes"]).column(0).to_numpy() + OPEN_BYTES
                if len(cost):
                    run = (np.cumsum(cost) - cost) // self.most
                    first = np.r_[0, np.flatnonzero(np.diff(run)) + 1]
                    places += [(fragment.path, group.row_groups[0].id, int(a), int(b), int(n) - OPEN_BYTES)
                               for a, b, n in zip(first, np.r_[first[1:], len(cost)], np.add.reduceat(cost, first))]
        return packed_by_bytes(places, self.most) or [Files([])]

    def _files(self, partition: Files) -> Iterator[tuple]:
        fs, _ = file_system(self.index)
        for at, group, start, stop, _ in partition.files:
            fragment = ds.ParquetFileFormat().make_fragment(at, filesystem=fs, row_groups=[group])
            rows = fragment.to_table(filter=self._chosen(), columns=["path", "day", "prefix", "icao"]).slice(start, stop - start)
            yield from zip(*(rows.column(c).to_pylist() for c in rows.column_names))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_NAMES)
        rows, points = [], 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _NAMES)], schema=schema)
            rows.clear()
            return out

        for path, day, prefix, icao in self._files(partition):
            fs, at = file_system(path)
            with fs.open_input_stream(at, compression=None) as f:
                data = f.read()
            for part in parts_of(data):
                rows.append((path, day, prefix, icao, *part))
                points += len(part[3])
                if points >= BATCH_POINTS:
                    yield batch()
                    points = 0
        if rows:
            yield batch()


class TraceArchive(DataSource):
    """``spark.read.format("trace_archive").option("index", ...)``: a row per part of a file."""

    @classmethod
    def name(cls) -> str:
        return "trace_archive"

    def schema(self) -> str:
        return PART

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_parts(spark: SparkSession, index: str, packed_bytes: int = PACKED_BYTES) -> DataFrame:
    """Parts of the archive's files; filters on day, prefix and icao choose the files that are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceArchive)
    # every read states a condition: without one Spark would plan anew from the filters that the last read handed over
    return spark.read.format("trace_archive").option("index", index).option("packedBytes", packed_bytes).load().where("path IS NOT NULL")


def archive_rows(parts: DataFrame) -> DataFrame:
    """All columns of trace points, and fault: NULL on a usable point, else why the point or its file is left out."""
    el = parts.select("path", F.col("name").alias("icao"), "base", F.explode_outer("points").alias("p"), "fault", F.size("points").alias("_n"))
    # a file without any point gives neither points nor rejects
    return trace_rows(el.where((F.col("_n") > 0) | F.col("fault").isNotNull()).drop("_n"))


def ingest(parts: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """One pass over the files into two tables below ``path``: (points, rejects with their fault)."""
    spark = parts.sparkSession
    rows = archive_rows(parts)
    kind = F.when(F.col("fault").isNull(), "points").otherwise("rejects")
    rows.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(path)
    back = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("kind", T.StringType())])).parquet(path)
    return (back.where(F.col("kind") == "points").drop("kind", "fault"),
            back.where(F.col("kind") == "rejects").select("source_file_path", "fault"))


def rejects_per_file(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy(F.col("source_file_path").alias("path")).agg(F.count(F.lit(1)).alias("rejected"))


def between_days(begin: dt.date, end: dt.date):
    return F.col("day").between(F.lit(begin), F.lit(end))
