"""Position reports from JSON files: snapshots (all objects at one time) and traces (one object, one day)."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import schemas
from driftline.functions import scalars as S


def day_glob(base: str, begin: datetime, end: datetime) -> str:
    """Path pattern for the day folders (yyyy/MM/dd) from ``begin`` to ``end``; other days are never listed."""
    days, d = [], begin.date()
    while d <= end.date():
        days.append(f"{d:%Y/%m/%d}")
        d += timedelta(days=1)
    return f"{base}/{{{','.join(days)}}}"


def read_snapshots(spark: SparkSession, path: str, begin: datetime | None = None, end: datetime | None = None,
                   one_per_file: bool = True) -> DataFrame:
    """One row per object and snapshot file, with the file's ``now`` and ``messages`` (0 where missing).

    With ``begin`` and ``end`` (both inclusive) files are picked by the time in their path,
    .../yyyy/MM/dd/HHmmssZ.json[.gz].
    """
    where = day_glob(path, begin, end) if begin and end else path
    raw = (spark.read.schema(schemas.SNAPSHOT_JSON).option("multiLine", one_per_file)
           .option("recursiveFileLookup", begin is None).json(where))
    if begin and end:
        stamp = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}/\d{2}/\d{2}/\d{6})Z", 1)
        at = F.try_to_timestamp(stamp, F.lit("yyyy/MM/dd/HHmmss"))
        utc = lambda t: F.lit(t.replace(tzinfo=t.tzinfo or timezone.utc))
        raw = raw.filter(at.between(utc(begin), utc(end)))
    return explode_snapshots(raw)


def explode_snapshots(raw: DataFrame) -> DataFrame:
    return raw.select(F.coalesce("now", F.lit(0.0)).alias("now"),
                      F.coalesce("messages", F.lit(0)).cast("bigint").alias("snapshot_messages"),
                      F.explode("aircraft").alias("a"))


def snapshot_points(rows: DataFrame) -> DataFrame:
    """The table form: renamed fields, defaults for missing text and lists, 'ground' as altitude 0."""
    text = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(""))
    items = lambda c: F.coalesce(F.col(f"a.{c}"), F.array().cast("array<string>"))
    made = {
        "snapshot_timestamp": F.col("now").cast("bigint"),
        "hex": text("hex"),
        "actual_timestamp": S.seconds_before(F.col("now"), F.col("a.seen")).cast("bigint"),
        "snapshot_messages": F.col("snapshot_messages"),
        "flight": F.trim(text("flight")),
        "registration": text("r"), "type": text("t"), "aircraft_type": text("type"),
        "alt_baro": S.altitude_or_ground(F.col("a.alt_baro"), ignore_case=False),
        "ground_speed": F.col("a.gs"), "latitude": F.col("a.lat"), "longitude": F.col("a.lon"),
        "squawk": text("squawk"), "emergency": text("emergency"), "category": text("category"),
        "nav_modes": items("nav_modes"), "mlat": items("mlat"), "tisb": items("tisb"),
        "messages": F.coalesce(F.col("a.messages"), F.lit(0)),
    }
    return rows.select(*[(made[c] if c in made else F.col(f"a.{c}")).try_cast(t).alias(c)
                         for c, t in schemas.SNAPSHOT_POINTS.items()])


def _plain_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """File bytes to text; compressed content is recognised by its first two bytes, broken content gives no text."""
    def text(b: bytes) -> str | None:
        try:
            return (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8")
        except (OSError, EOFError, zlib.error, UnicodeDecodeError):
            return None
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "text": [text(bytes(b)) for b in pdf["content"]]})


def read_trace_files(spark: SparkSession, path: str, begin: datetime | None = None, end: datetime | None = None,
                     prefixes: list[str] | None = None) -> DataFrame:
    """(path, text) of trace files, compressed or not whatever their name says.

    With ``begin`` and ``end`` only the day folders between them, and with ``prefixes`` only the folders below a day
    (or below ``path``) that are named so, are listed and opened.
    """
    where = day_glob(path, begin, end) if begin and end else path
    if prefixes:
        where += f"/{{{','.join(prefixes)}}}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where).select("path", "content")
    return files.mapInPandas(_plain_text, "path string, text string")


UNREADABLE, INCOMPLETE = "file cannot be read", "point lacks a value"


def _trace_elements(files: DataFrame) -> DataFrame:
    doc = F.from_json("text", schemas.TRACE_JSON)
    docs = files.select("path", doc.alias("d"))
    return docs.select("path", "d.icao", F.col("d.timestamp").alias("base"), F.explode_outer("d.trace").alias("p"))


def _usable():
    return (F.col("icao").isNotNull() & F.col("base").isNotNull() & F.col("p").isNotNull()
            & (F.size("p") >= schemas.REQUIRED_POSITIONS)
            & F.get("p", F.lit(0)).try_cast("double").isNotNull())


def _point_columns(el: DataFrame, *also: str) -> DataFrame:
    """The columns of a trace point from (path, icao, base, p) rows."""
    at = {name: F.get("p", F.lit(i)) for i, (name, _) in enumerate(schemas.TRACE_POINT)}
    meta = F.from_json(at["metadata"], schemas.ddl(schemas.METADATA))
    number = lambda c, t: c.try_cast("double").try_cast(t) if t == "int" else c.try_cast(t)
    values = {name: number(at[name], t) for name, t in schemas.TRACE_POINT if name != "metadata"}
    values["altitude_baro"] = S.altitude_or_ground(at["altitude_baro"])
    values |= {
        "icao": F.col("icao"),
        "actual_timestamp": S.point_time(F.col("base"), at["seconds_offset"].try_cast("double")),
        "base_timestamp": F.col("base").cast("bigint"),
        "source_file_path": F.col("path"),
    }
    el = el.withColumn("m", meta)
    return el.select(*[(values[c] if c in values else F.col(f"m.{c}")).alias(c) for c in schemas.TRACE_POINTS], *also)


def explode_trace_points(files: DataFrame) -> DataFrame:
    """One row per trace point from (path, text). Unreadable files and incomplete points yield nothing."""
    return _point_columns(_trace_elements(files).filter(F.coalesce(_usable(), F.lit(False))))


def trace_rows(el: DataFrame) -> DataFrame:
    """Usable points and rejects together, from (path, icao, base, p, fault): the point's columns, and ``fault``."""
    why = F.coalesce("fault", F.when(~F.coalesce(_usable(), F.lit(False)), F.lit(INCOMPLETE)))
    return _point_columns(el.withColumn("fault", why), "fault")


def read_traces(spark: SparkSession, path: str, begin: datetime | None = None, end: datetime | None = None,
                prefixes: list[str] | None = None) -> DataFrame:
    return explode_trace_points(read_trace_files(spark, path, begin, end, prefixes))


def rejected(files: DataFrame) -> DataFrame:
    """Per file how many points were skipped; a file that could not be read counts as one."""
    el = _trace_elements(files)
    return (el.filter(~F.coalesce(_usable(), F.lit(False)))
            .groupBy("path").agg(F.count(F.lit(1)).alias("rejected")))


def extract_links(pages: DataFrame, html: str, prefix: str, suffix: str = "", strip: str = "~") -> DataFrame:
    """Ids in anchor targets that start with ``prefix`` and end with ``suffix``, without those and without ``strip``."""
    pattern = F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']")
    found = pages.withColumn("href", F.explode(F.regexp_extract_all(F.col(html), pattern, F.lit(1))))
    found = found.filter(F.col("href").startswith(prefix) & F.col("href").endswith(suffix)
                         & (F.length("href") >= len(prefix) + len(suffix)))
    bare = F.substring(F.col("href"), F.lit(len(prefix) + 1), F.length("href") - len(prefix) - len(suffix))
    return found.withColumn("file_id", F.replace(bare, F.lit(strip), F.lit("")) if strip else bare)
