"""An archive of trace files made from all events, one file a user and day, and what is read back from it."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import schemas
from driftline.functions import scalars as S
from driftline.plans.registry import query, table
from driftline.session import scratch_path
from driftline.sources import archive

DAY = 86_400_000_000

# Number fields of a point and of its metadata: whole-number expressions over the event's number e, digits after the point.
POINT = {"latitude": ("e * 7919 % 180000000 - 90000000", 6), "longitude": ("e * 104729 % 360000000 - 180000000", 6), "ground_speed": ("e * 13 % 60000", 2),
         "track": ("e * 37 % 36000", 2), "flags": ("e % 16", 0), "vertical_rate_baro": ("e * 3 % 4000 - 2000", 0), "altitude_geom": ("e * 11 % 50000", 0),
         "vertical_rate_geom": ("e * 5 % 4000 - 2000", 0), "indicated_airspeed": ("e % 600", 0), "roll_angle": ("e * 17 % 9000 - 4500", 2)}
META = {"nav_qnh": ("e % 500 + 9800", 1), "nav_altitude_mcp": ("e * 7 % 40000", 0), "nav_heading": ("e * 41 % 36000", 2), "nic": ("e % 12", 0), "rc": ("e % 1000", 0),
        "version": ("e % 3", 0), "nic_baro": ("e % 2", 0), "nac_p": ("e % 11", 0), "nac_v": ("e % 4", 0), "sil": ("e % 5", 0), "gva": ("e % 3 + 1", 0), "sda": ("e % 4", 0)}
WORDS = {"flight": "concat('FL', e % 1000)", "squawk": "lpad(CAST(e % 7777 AS STRING), 4, '0')", "category": "concat('A', e % 8)",
         "emergency": "CASE WHEN e % 4 = 0 THEN 'none' ELSE 'general' END", "sil_type": "CASE WHEN e % 2 = 0 THEN 'perhour' ELSE 'persample' END"}
SOURCE = "CASE e % 3 WHEN 0 THEN 'adsb_icao' WHEN 1 THEN 'mlat' ELSE 'tisb_other' END"
#: Parts of a point that are there: a short one ends before its source, metadata are null, empty, or lack the autopilot's fields.
FULL, HAS_META, HAS_NAV = "e % 10 > 2", "e % 10 >= 2 AND e % 3 = 2", "e % 5 <> 0"
TAIL = ["source_type", "altitude_geom", "vertical_rate_geom", "indicated_airspeed", "roll_angle"]
BROKEN = "user_id % 29 = 3 AND day_no % 7 = 2"


def _number(field: tuple[str, int]) -> Column:
    what, digits = field
    return F.expr(what).cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-digits))


def day_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(icao, day, text, packed): events as one trace document per user and day, points of 7, 8, 9 and 14 elements, the
    documents of some users and days cut off."""
    events = table(spark, sf_dir, "events")
    ev = events.select("user_id", F.col("event_id").alias("e"), "event_type", S.as_micros(events, "ts").alias("us")).withColumn("day_no", F.expr(f"us div {DAY}"))
    text = lambda c: _number(c).cast("string")
    offset = ((F.col("us") - F.col("day_no") * DAY).cast("decimal(18,0)") * F.lit(Decimal("0.000001"))).cast("string")
    altitude = F.when(F.col("event_type") == "error", F.lit('"Ground"')).otherwise(F.expr("CAST(e % 45000 AS STRING)"))
    head = [offset, text(POINT["latitude"]), text(POINT["longitude"]), altitude, text(POINT["ground_speed"]), text(POINT["track"]), text(POINT["flags"])]
    nav = lambda name, c: F.when(F.expr(HAS_NAV), c) if name.startswith("nav_") else c
    meta = F.to_json(F.struct(*[nav(n, _number(f)).alias(n) for n, f in META.items()], *[F.expr(w).alias(n) for n, w in WORDS.items()]))
    meta = F.when(F.expr("e % 3 = 0"), F.lit("null")).when(F.expr("e % 3 = 1"), F.lit("{}")).otherwise(meta)
    full = [F.concat(F.lit('"'), F.expr(SOURCE), F.lit('"')), F.when(F.expr("e % 3 = 0"), F.lit("null")).otherwise(text(POINT["altitude_geom"])),
            *[text(POINT[c]) for c in TAIL[2:]]]
    rate = text(POINT["vertical_rate_baro"])
    tail = (F.when(F.expr("e % 10 = 0"), F.array().cast("array<string>")).when(F.expr("e % 10 = 1"), F.array(rate))
            .when(F.expr("e % 10 = 2"), F.array(rate, meta)).otherwise(F.array(rate, meta, *full)))
    point = F.concat(F.lit("["), F.array_join(F.concat(F.array(*head), tail), ","), F.lit("]"))
    docs = ev.select("user_id", "day_no", F.struct("us", "e", point.alias("p")).alias("s")).groupBy("user_id", "day_no").agg(F.array_sort(F.collect_list("s")).alias("s"))
    whole = F.concat(F.lit('{"icao":"'), F.lower(F.hex("user_id")), F.lit('","timestamp":'), (F.col("day_no") * 86400).cast("string"),
                     F.lit(',"trace":['), F.array_join("s.p", ","), F.lit("]}"))
    broken = F.expr(BROKEN)
    return docs.select(F.lower(F.hex("user_id")).alias("icao"), F.date_from_unix_date(F.col("day_no").cast("int")).alias("day"),
                       F.when(broken, F.substring(whole, 1, 40)).otherwise(whole).alias("text"), (F.col("user_id") % 2 == 0).alias("packed"))


def event_archive(spark: SparkSession, sf_dir: str) -> str:
    """The archive, written; returns where its index is."""
    return archive.write_archive(day_documents(spark, sf_dir), scratch_path(spark, "archive"))


def _shown(points: DataFrame) -> DataFrame:
    """All columns of trace points: decimals as text, the file below the archive's folder."""
    made = {"actual_timestamp": F.unix_micros("actual_timestamp"), "source_file_path": F.regexp_extract("source_file_path", r"(\d{4}/\d{2}/\d{2}/.*)", 1)}
    as_text = lambda c: F.col(c).cast("string") if schemas.TRACE_POINTS[c].startswith("decimal") else F.col(c)
    return points.select(*[made.get(c, as_text(c)).alias(c) for c in schemas.TRACE_POINTS])


def _sql_number(name: str, field: tuple[str, int]) -> str:
    kind = schemas.TRACE_POINTS[name]
    value = f"(({field[0]}) * {Decimal(1).scaleb(-field[1])}::DECIMAL(18, {field[1]}))::DECIMAL(18, {field[1]})"
    return f"{value}::{kind}::VARCHAR" if kind.startswith("decimal") else f"{value}::INTEGER"


def _points_sql(where: str = "true") -> str:
    values = {
        "icao": "icao", "actual_timestamp": "us", "base_timestamp": "day_no * 86400", "altitude_baro": "CASE WHEN event_type = 'error' THEN 0 ELSE (e % 45000)::INTEGER END",
        "seconds_offset": f"((us - day_no * {DAY}) * 0.000001::DECIMAL(18, 6))::DECIMAL(18, 6)::DECIMAL(10, 2)::VARCHAR", "source_file_path": "file",
        "source_type": f"CASE WHEN {FULL} THEN {SOURCE} END"}
    for c, f in POINT.items():
        there = FULL + (" AND e % 3 <> 0" if c == "altitude_geom" else "") if c in TAIL else "true"
        values[c] = f"CASE WHEN {there} THEN {_sql_number(c, f)} END"
    for c, f in META.items():
        values[c] = f"CASE WHEN {HAS_META}{' AND ' + HAS_NAV if c.startswith('nav_') else ''} THEN {_sql_number(c, f)} END"
    for c, w in WORDS.items():
        values[c] = f"CASE WHEN {HAS_META} THEN {w} END"
    return f"{EVENTS_SQL} SELECT {', '.join(f'{values[c]} AS {c}' for c in schemas.TRACE_POINTS)} FROM e WHERE e % 10 <> 0 AND NOT ({BROKEN}) AND {where}"


EVENTS_SQL = f"""WITH e AS (SELECT *, strftime(make_timestamp(day_no * {DAY}), '%Y/%m/%d/') || right(icao, 2) || '/trace_full_' || icao || '.json' AS file
FROM (SELECT user_id, event_id AS e, event_type, epoch_us(ts) AS us, epoch_us(ts) // {DAY} AS day_no, printf('%x', user_id) AS icao FROM events))"""


@query(_points_sql())
def trace_files(spark, sf_dir):
    """Every point of every file, all columns; half of the files are packed under a plain name, some are cut off."""
    parts = archive.read_parts(spark, event_archive(spark, sf_dir))
    points, _ = archive.ingest(parts, scratch_path(spark, "ingested"))
    return _shown(points)


@query(f"""{EVENTS_SQL} SELECT file AS path, CASE WHEN {BROKEN} THEN 1 ELSE count(*) FILTER (e % 10 = 0) END::BIGINT AS rejected
FROM e GROUP BY file, user_id, day_no HAVING rejected > 0""")
def rejected_points(spark, sf_dir):
    """From the same pass over the whole archive: points left out, by file; a file that cannot be read counts as one."""
    parts = archive.read_parts(spark, event_archive(spark, sf_dir))
    _, rejects = archive.ingest(parts, scratch_path(spark, "ingested"))
    return archive.rejects_per_file(rejects).withColumn("path", F.regexp_extract("path", r"(\d{4}/\d{2}/\d{2}/.*)", 1))


PREFIXES = ("1", "5", "a", "2f", "6b")


@query(_points_sql(f"day_no BETWEEN (SELECT min(day_no) + 3 FROM e) AND (SELECT min(day_no) + 5 FROM e) AND right(icao, 2) IN {PREFIXES}"))
def trace_files_by_day(spark, sf_dir):
    """Three days and five folders of ids: other files are not opened."""
    index = event_archive(spark, sf_dir)
    first = spark.read.schema(archive.INDEX).parquet(index).agg(F.min("day")).first()[0] or date(1970, 1, 1)
    days = archive.between_days(first + timedelta(days=3), first + timedelta(days=5))
    parts = archive.read_parts(spark, index).where(days & F.col("prefix").isin(*PREFIXES))
    return _shown(archive.archive_rows(parts).where(F.col("fault").isNull()))
