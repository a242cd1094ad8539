"""Ingest, layout and streaming queries. Their JSON documents and folders are derived from the driver tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import schemas
from driftline.functions import scalars as S
from driftline.operators.clean import insert_ignore, keep_richest
from driftline.operators.traces import GapRule, traces
from driftline.plans.profile_queries import hex_ids
from driftline.plans.registry import query, table
from driftline.session import scratch_path
from driftline.sources import reports, tables, versions
from driftline.streaming import flows

MINUTE = 60_000_000


@query("SELECT page_id, substr(href, 2) AS file_id FROM (SELECT page_id, unnest(regexp_extract_all(html, "
       "'(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS href FROM pages) WHERE starts_with(href, '/')")
def page_links(spark, sf_dir):
    return reports.extract_links(table(spark, sf_dir, "pages"), "html", "/").select("page_id", "file_id")


# Fields of an aircraft in a snapshot: whole-number expressions over the event's number, digits after the point.
CRAFT = {"alt_geom": ("event_id * 11 % 50000", 0), "gs": ("event_id * 13 % 60000", 2), "track": ("event_id * 37 % 36000", 2), "baro_rate": ("event_id * 3 % 4000 - 2000", 0),
         "lat": ("event_id * 7919 % 180000000 - 90000000", 6), "lon": ("event_id * 104729 % 360000000 - 180000000", 6), "nic": ("event_id % 12", 0), "rc": ("event_id % 1000", 0),
         "seen_pos": ("event_id % 90000", 3), "version": ("event_id % 3", 0), "nav_qnh": ("event_id % 500 + 9800", 1), "nav_altitude_mcp": ("event_id * 7 % 40000", 0),
         "nav_heading": ("event_id * 41 % 36000", 2), "messages": ("event_id * 17", 0), "rssi": ("event_id % 400 - 490", 1)}
CRAFT_WORDS = {"r": "concat('N', event_id % 1000)", "t": "CASE WHEN event_id % 2 = 0 THEN 'B738' ELSE 'A320' END", "type": "'adsb_icao'", "squawk": "lpad(CAST(event_id % 7777 AS STRING), 4, '0')",
               "emergency": "CASE WHEN event_id % 4 = 0 THEN 'none' ELSE 'general' END", "category": "concat('A', event_id % 8)"}
CRAFT_LISTS = {"nav_modes": (3, ["autopilot", "althold"]), "mlat": (7, ["lat", "lon"]), "tisb": (11, ["gs"])}
CRAFT_GONE = {"alt_geom": 5, "track": 6, "nav_qnh": 4, "r": 9, "squawk": 8, "messages": 10}  # missing where the number is divisible
TABLE_NAME = {"gs": "ground_speed", "lat": "latitude", "lon": "longitude", "r": "registration", "t": "type", "type": "aircraft_type"}


def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one snapshot document per minute; some fields of some aircraft are missing."""
    ev = table(spark, sf_dir, "events")
    minute = F.floor(S.as_micros(ev, "ts") / MINUTE) * 60
    there = lambda name, c: (F.when(F.expr(f"event_id % {CRAFT_GONE[name]} <> 0"), c) if name in CRAFT_GONE else c).alias(name)
    craft = F.struct(
        F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("flight"),
        F.lower(F.hex("user_id")).alias("hex"),
        F.when(F.col("event_type") == "error", "ground").otherwise(F.col("event_id").cast("string")).alias("alt_baro"),
        F.when(F.col("event_type") != "view", F.lit(3.0)).alias("seen"),
        *[there(n, F.expr(e).cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-d))) for n, (e, d) in CRAFT.items()],
        *[there(n, F.expr(e)) for n, e in CRAFT_WORDS.items()],
        *[F.when(F.expr(f"event_id % {k} = 0"), F.array(*map(F.lit, words))).alias(n) for n, (k, words) in CRAFT_LISTS.items()])
    docs = ev.select(minute.cast("double").alias("now"), craft.alias("c"), "event_id").groupBy("now").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "c"))).alias("s"))
    return docs.select(F.to_json(F.struct("now", F.size("s").alias("messages"), F.col("s.c").alias("aircraft"))).alias("value"))


def _craft_sql() -> str:
    there = lambda name, value: f"CASE WHEN event_id % {CRAFT_GONE[name]} <> 0 THEN {value} END" if name in CRAFT_GONE else value
    out = []
    for n, (e, d) in CRAFT.items():
        name = TABLE_NAME.get(n, n)
        kind = schemas.SNAPSHOT_POINTS[name]
        value = there(n, f"(({e}) * {Decimal(1).scaleb(-d)}::DECIMAL(18, {d}))::DECIMAL(18, {d})::{kind}" + ("::VARCHAR" if kind.startswith("decimal") else ""))
        out.append(f"{'coalesce(' + value + ', 0)' if n == 'messages' else value} AS {name}")
    out += [f"coalesce({there(n, e)}, '') AS {TABLE_NAME.get(n, n)}" for n, e in CRAFT_WORDS.items()]
    out += [f"CASE WHEN event_id % {k} = 0 THEN '{'|'.join(words)}' ELSE '' END AS {n}" for n, (k, words) in CRAFT_LISTS.items()]
    return ", ".join(out)


SNAPSHOT_SQL = f"""
WITH e AS (SELECT event_id, epoch_us(ts) // 60000000 * 60 AS snapshot_timestamp, printf('%x', user_id) AS hex, event_type FROM events),
s AS (SELECT snapshot_timestamp, hex, snapshot_timestamp - CASE WHEN event_type <> 'view' THEN 3 ELSE 0 END AS actual_timestamp,
  count(*) OVER (PARTITION BY snapshot_timestamp) AS snapshot_messages, event_type AS flight,
  CASE WHEN event_type <> 'view' THEN '3.0' END AS seen,
  CASE WHEN event_type = 'error' THEN 0 ELSE event_id::INTEGER END AS alt_baro, {_craft_sql()} FROM e)
"""


def snapshot_shown(points: DataFrame) -> DataFrame:
    """All columns: decimals as text, lists joined."""
    kind = schemas.SNAPSHOT_POINTS
    show = lambda c: F.col(c).cast("string") if kind[c].startswith("decimal") else F.array_join(c, "|") if kind[c].startswith("array") else F.col(c)
    return points.select(*[show(c).alias(c) for c in kind])


@query(SNAPSHOT_SQL + f"SELECT {', '.join(schemas.SNAPSHOT_POINTS)} FROM s")
def snapshot_ingest(spark, sf_dir):
    """Snapshot documents written as JSON, read back and put in table form."""
    path = scratch_path(spark, "snapshots")
    snapshot_documents(spark, sf_dir).write.text(path)
    return snapshot_shown(reports.snapshot_points(reports.read_snapshots(spark, path, one_per_file=False)))


@query(SNAPSHOT_SQL + """SELECT snapshot_timestamp, hex, min(alt_baro) AS alt_baro FROM s GROUP BY 1, 2""")
def snapshot_insert_ignore(spark, sf_dir):
    """The same documents loaded twice: stored rows win, so the second load adds nothing."""
    path = scratch_path(spark, "snapshots")
    snapshot_documents(spark, sf_dir).write.text(path)
    pts = reports.snapshot_points(reports.read_snapshots(spark, path, one_per_file=False))
    empty = pts.filter(F.lit(False))
    once = insert_ignore(empty, pts, schemas.SNAPSHOT_KEY, ["alt_baro"])
    return insert_ignore(once, pts, schemas.SNAPSHOT_KEY, ["alt_baro"]).select("snapshot_timestamp", "hex", "alt_baro")


def trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): events as one trace document per user and hour, points of 7, 8, 9 and 14 elements."""
    ev = table(spark, sf_dir, "events").withColumn("us", S.as_micros(table(spark, sf_dir, "events"), "ts"))
    hour = F.floor(F.col("us") / (60 * MINUTE)) * 3600
    q = lambda c: F.to_json(F.struct(c.alias("x")))
    inner = lambda c: F.regexp_replace(q(c), r'^\{"x":|\}$', "")
    offset = F.format_string("%d.%06d", F.floor((F.col("us") - hour * 1_000_000) / 1_000_000),
                             (F.col("us") - hour * 1_000_000) % 1_000_000)
    head = [offset, F.format_string("%.2f", "value"), F.format_string("%.2f", -F.col("value")),
            F.when(F.col("event_type") == "error", F.lit('"Ground"')).otherwise(F.col("event_id").cast("string")),
            F.format_string("%.2f", "value"), (F.col("event_id") % 360).cast("string"), F.lit("4")]
    meta = F.when(F.col("event_id") % 3 == 0, F.lit("null")).when(F.col("event_id") % 3 == 1, F.lit("{}")).otherwise(
        F.concat(F.lit('{"flight":'), inner(F.col("event_type")), F.lit(',"nic":8}')))
    kind = F.col("event_id") % 10
    tail = (F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array(F.lit("-64")))
            .when(kind == 2, F.array(F.lit("-64"), meta))
            .otherwise(F.array(F.lit("-64"), meta, F.lit('"adsb"'), F.lit("100"), F.lit("null"), F.lit("250"), F.lit("1.5"))))
    point = F.concat(F.lit("["), F.array_join(F.concat(F.array(*head), tail), ","), F.lit("]"))
    docs = ev.select(F.lower(F.hex("user_id")).alias("icao"), hour.alias("base"), F.struct("us", point.alias("p")).alias("s")) \
        .groupBy("icao", "base").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = F.concat(F.lit('{"icao":"'), "icao", F.lit('","timestamp":'), F.col("base").cast("string"),
                    F.lit(',"trace":['), F.array_join("s.p", ","), F.lit("]}"))
    return docs.select(F.concat_ws("/", "icao", F.col("base").cast("string")).alias("path"), text.alias("text"))


@query("""SELECT printf('%x', user_id) AS icao, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 * 3600 AS base_timestamp,
CASE WHEN event_type = 'error' THEN 0 ELSE event_id::INTEGER END AS altitude_baro,
coalesce(CASE WHEN event_id % 10 > 1 AND event_id % 3 = 2 THEN event_type END, '') AS flight,
coalesce(CASE WHEN event_id % 10 > 2 THEN 'adsb' END, '') AS source_type,
CASE WHEN event_id % 10 > 2 THEN 250 ELSE 0 END AS indicated_airspeed FROM events WHERE event_id % 10 <> 0""")
def trace_ingest(spark, sf_dir):
    pts = reports.explode_trace_points(trace_documents(spark, sf_dir))
    return pts.select("icao", F.unix_micros("actual_timestamp").alias("us"), "base_timestamp", "altitude_baro",
                      F.coalesce("flight", F.lit("")).alias("flight"),
                      F.coalesce("source_type", F.lit("")).alias("source_type"),
                      F.coalesce("indicated_airspeed", F.lit(0)).alias("indicated_airspeed"))


@query("SELECT printf('%x', user_id) AS icao, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def trace_ingest_deduped(spark, sf_dir):
    """Documents read twice; the richest row per key is kept."""
    docs = trace_documents(spark, sf_dir)
    pts = reports.explode_trace_points(docs.unionByName(docs))
    best = keep_richest(pts, schemas.TRACE_KEY, ["source_file_path"])
    return best.groupBy("icao").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT hex_prefix, count(*) AS rows, min(c_custkey) AS lowest FROM (SELECT c_custkey,
substr(md5(c_custkey::VARCHAR), 1, 2) AS hex_prefix FROM customer WHERE c_custkey % 10 <> 0)
WHERE hex_prefix BETWEEN '20' AND '5f' GROUP BY 1""")
def partitioned_table(spark, sf_dir):
    """Written in folders by prefix, read back with folder pruning."""
    path = scratch_path(spark, "by-prefix")
    tables.write_partitioned(hex_ids(spark, sf_dir).filter(~F.col("id").startswith("~")), path, "id", "c_custkey")
    back = spark.read.schema("c_custkey bigint, id string, hex_prefix string").parquet(path)
    return (back.filter(F.col("hex_prefix").between("20", "5f")).groupBy("hex_prefix")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("c_custkey").alias("lowest")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS state, c_name AS note,
CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS balance FROM customer""")
def partition_upsert(spark, sf_dir):
    """A stored column the incoming rows lack stays; one that only they have is added."""
    path = scratch_path(spark, "upsert")
    ids = table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("id"), "c_name", "c_acctbal")
    old = ids.select("c_custkey", "id", F.lit("old").alias("state"), F.col("c_name").alias("note"))
    tables.write_partitioned(old, path, "id", "c_custkey")
    new = ids.filter(F.col("c_custkey") % 4 == 0).select("c_custkey", "id", F.lit("new").alias("state"), F.col("c_acctbal").alias("balance"),
                                                         F.substring("id", 1, 2).alias("hex_prefix"))
    tables.upsert_partitions(spark, path, new, ["c_custkey"], ["state"])
    return (spark.read.schema("c_custkey bigint, state string, note string, balance double, hex_prefix string").parquet(path)
            .select("c_custkey", "state", "note", "balance"))


VERSIONS_SQL = """
WITH c AS (SELECT c_custkey, c_name, c_acctbal, substr(md5(c_custkey::VARCHAR), 1, 2) AS hex_prefix FROM customer),
v0 AS (SELECT c_custkey, 'old' AS state, c_acctbal, hex_prefix FROM c WHERE c_custkey % 5 <> 0),
v1 AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN c_custkey % 4 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal, hex_prefix
  FROM c WHERE c_custkey % 5 <> 0 OR c_custkey % 4 = 0)"""


@query(VERSIONS_SQL + """
SELECT 'killed' AS at, * FROM v0 UNION ALL SELECT 'first', * FROM v0 UNION ALL SELECT 'second', * FROM v1
UNION ALL SELECT 'third', * FROM v1 UNION ALL SELECT 'third', c_custkey, 'extra', c_acctbal, hex_prefix FROM c WHERE c_custkey % 5 = 0 AND c_custkey % 4 <> 0""")
def versioned_table(spark, sf_dir):
    """An upsert that dies between write and swap leaves the old version whole; one that ends makes a new version beside it;
    an insert that meets stored keys adds the new ones only."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 2).alias("hex_prefix"))
    stored = versions.VersionedTable(spark, scratch_path(spark, "versions"))
    key = ["c_custkey"]
    stored.create(c.where("c_custkey % 5 <> 0").withColumn("state", F.lit("old")), key)
    new = c.where("c_custkey % 4 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal"), "hex_prefix", F.lit("new").alias("state"))
    stored.upsert(new, key, ["state"], swap=False)
    killed = stored.read()
    stored.upsert(new, key, ["state"])
    stored.insert(c.withColumn("state", F.lit("extra")), key, ["state"])
    at = lambda name, df: df.select(F.lit(name).alias("at"), "c_custkey", "state", "c_acctbal", "hex_prefix")
    return at("killed", killed).unionByName(at("first", stored.read(0))).unionByName(at("second", stored.read(1))).unionByName(at("third", stored.read()))


@query("SELECT 'l_returnflag' AS column_name, count(DISTINCT l_returnflag) AS distinct_count FROM lineitem "
       "UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem")
def report_file(spark, sf_dir):
    """A profile written as JSON and read back."""
    from driftline.operators.profile import distinct_profile
    path = scratch_path(spark, "report")
    tables.write_report(distinct_profile(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")), path)
    return tables.read_report(spark, path).select("column_name", "distinct_count")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
WITH p AS (SELECT user_id, epoch_us(ts) AS us FROM events),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS d FROM p),
t AS (SELECT *, sum(CASE WHEN d > 86400000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS point_count FROM t GROUP BY user_id, k
HAVING max(us) + 86400000000 <= (SELECT max(us) // 1000 * 1000 FROM p) - 600000000""")
def stream_sessions(spark, sf_dir):
    """Sessions closed by the watermark."""
    out = flows.session_traces(event_stream(spark, sf_dir), "user_id", "ts", "24 hours")
    path = scratch_path(spark, "sessions")
    flows.run_available(out, path, scratch_path(spark, "sessions-state"))
    return spark.read.schema(out.schema).parquet(path)


@query("SELECT event_id, user_id, value FROM events")
def stream_dedupe(spark, sf_dir):
    """Events arrive twice, in files out of time order, one or two a batch; repeats are left out and no row is lost. A batch
    reads the stored keys of the days that it touches."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    files = scratch_path(spark, "arrivals")
    day = F.floor(S.as_micros(ev, "ts") / (24 * 60 * MINUTE))
    mixed = F.pmod(F.xxhash64("event_id"), F.lit(1000))
    ev.unionByName(ev).repartitionByRange(6, F.pmod(day * 11, F.lit(31)), mixed).write.parquet(files)
    arriving = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(files)
    path = scratch_path(spark, "dedupe")
    flows.merge_available(arriving, path, scratch_path(spark, "dedupe-state"), ["event_id"], ["ts"], day)
    return spark.read.parquet(path).select("event_id", "user_id", "value")


ARRIVAL = (2, 0, 1, 4, 3)  # fifths of the time, in the order in which their files come
LIVE_DELAY = 8 * 24 * 60 * MINUTE


@query(f"""
WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 AS day_no FROM events),
a AS (SELECT e.*, list_position({list(ARRIVAL)}, least(4, (day_no - (SELECT min(day_no) FROM e)) // 6)::INTEGER) AS arrival FROM e),
w AS (SELECT a.*, (SELECT max(us) FROM a b WHERE b.arrival < c.arrival) - {LIVE_DELAY} AS horizon FROM a JOIN (SELECT DISTINCT arrival FROM a) c USING (arrival)),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS d FROM w WHERE horizon IS NULL OR us >= horizon),
k AS (SELECT *, CASE WHEN d > 86400000000 OR us // 604800000000 <> lag(us) OVER (PARTITION BY user_id ORDER BY us) // 604800000000 THEN 1 ELSE 0 END AS cut FROM g),
t AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM k),
s AS (SELECT *, min(us) OVER (PARTITION BY user_id, no) AS start_us FROM t)
SELECT 'trace' AS kind, user_id, start_us, max(us) AS end_us, count(*) AS point_count, min_by(event_id, us) AS event_id,
  string_agg((us - start_us)::VARCHAR, ',' ORDER BY us) AS time_offsets, string_agg(printf('%.2f', value), ',' ORDER BY us) AS value
FROM s GROUP BY user_id, no, start_us
UNION ALL SELECT 'late', user_id, us, us, 1, event_id, '0', printf('%.2f', value) FROM w WHERE us < horizon""")
def stream_traces(spark, sf_dir):
    """Traces from five files out of time order, cut at gaps and at weeks: closed ones, those still open at the end, and the
    rows that came later than the delay allows."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    day = F.floor(S.as_micros(ev, "ts") / (24 * 60 * MINUTE)).cast("long")
    first = ev.agg(F.min(day)).first()[0] or 0
    files = scratch_path(spark, "arrivals")
    for fifth in ARRIVAL:  # one after the other, so that they come in this order
        ev.where(F.least(F.lit(4), F.floor((day - first) / 6)) == fifth).coalesce(1).write.mode("append").parquet(files)
    rule = GapRule("user_id", "ts", 24 * 60 * MINUTE, chunk_us=7 * 24 * 60 * MINUTE)
    live = flows.LiveTraces(rule, ("value",), ("event_id",), LIVE_DELAY, scratch_path(spark, "live"))
    live.run_available(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(files), scratch_path(spark, "live-state"))
    as_text = lambda c, e: F.array_join(F.transform(c, e), ",").alias(c)
    found = live.closed(spark).unionByName(live.open(spark)).select(
        F.lit("trace").alias("kind"), "user_id", "start_us", "end_us", "point_count", "event_id", as_text("time_offsets", lambda x: x.cast("string")),
        as_text("value", lambda x: F.format_string("%.2f", x)))
    us = S.as_micros(live.late(spark), "ts")
    late = live.late(spark).select(F.lit("late").alias("kind"), "user_id", us.alias("start_us"), us.alias("end_us"), F.lit(1).cast("long").alias("point_count"),
                                   "event_id", F.lit("0").alias("time_offsets"), F.format_string("%.2f", "value").alias("value"))
    return found.unionByName(late)


@query("""
WITH e AS (SELECT DISTINCT epoch_us(ts) // 60000000 * 60 - CASE WHEN event_type <> 'view' THEN 3 ELSE 0 END AS sec,
  epoch_us(ts) // 60000000 * 60 AS snap, printf('%x', user_id) AS hex FROM events),
f AS (SELECT hex, snap, min(sec) AS sec FROM e GROUP BY 1, 2),
g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY hex ORDER BY sec) AS d FROM f),
t AS (SELECT *, sum(CASE WHEN d > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY hex ORDER BY sec ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT hex, min(sec) * 1000000 AS start_us, count(*) AS point_count FROM t GROUP BY hex, k""")
def traces_from_snapshots(spark, sf_dir):
    """Snapshot points, one per key, joined into traces by their epoch-second times."""
    pts = reports.snapshot_points(reports.explode_snapshots(
        snapshot_documents(spark, sf_dir).select(F.from_json("value", schemas.SNAPSHOT_JSON).alias("d")).select("d.*")))
    pts = pts.groupBy(*schemas.SNAPSHOT_KEY).agg(F.min("actual_timestamp").alias("actual_timestamp"))
    rule = GapRule("hex", "actual_timestamp", 24 * 60 * MINUTE, unit="s", tiebreak=("snapshot_timestamp",))
    return traces(pts, rule).select("hex", "start_us", "point_count")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def parquet_round_trip(spark, sf_dir):
    """Written by the sink, read back as a table."""
    path = scratch_path(spark, "sink")
    tables.write_parquet(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), path, 10_000)
    return tables.read_table(spark, path)
