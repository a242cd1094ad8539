"""Checks, samples, saved models, inverse forms and files picked by time, over the driver tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftline import schemas
from driftline.operators import checks, exemplars, profile, windows
from driftline.operators.coding import Coder
from driftline.operators.scaling import Scaler
from driftline.plans.feature_queries import STATS_SQL, noisy, vectors
from driftline.plans.io_queries import SNAPSHOT_SQL, snapshot_documents, snapshot_shown
from driftline.plans.registry import query, table
from driftline.plans.trace_queries import N, WINDOWS_SQL, as_text, event_windows, text_sql
from driftline.session import scratch_path
from driftline.sources import archive, reports


@query("SELECT event_id, user_id FROM events WHERE event_id % 7 = 0 OR value < 5")
def null_rows(spark, sf_dir):
    """Rows with a NULL in any checked column."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"), F.when(F.col("value") >= 5, F.col("value")).alias("value"))
    return checks.rows_with_null(ev, ["ts", "value"]).select("event_id", "user_id")


@query("SELECT (SELECT count(*) FROM orders) * 4 AS expected, (SELECT count(*) FROM lineitem) AS actual "
       "WHERE (SELECT count(*) FROM orders) * 4 <> (SELECT count(*) FROM lineitem)")
def join_size_fault(spark, sf_dir):
    return checks.join_size(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), 4)


@query("SELECT (SELECT count(*) FROM orders) * 5 AS expected, (SELECT count(*) FROM lineitem) AS actual")
def join_size_differs(spark, sf_dir):
    """A join that should have given five rows an order."""
    return checks.join_size(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), 5)


@query("""SELECT o_orderkey, 'repeated' AS fault FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, 'length' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'length' FROM orders WHERE o_orderkey % 77 = 0
UNION ALL SELECT o_orderkey, 'length' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 13 = 0
UNION ALL SELECT o_orderkey, 'length' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 13 = 0 AND o_orderkey % 11 = 0""")
def key_and_length_faults(spark, sf_dir):
    """Rows of which some come twice, some have an array too short and some a missing one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("a"),
                                              F.when(F.col("o_orderkey") % 13 != 0, F.array(F.lit(1), F.lit(2))).alias("b"))
    rows = o.unionByName(o.where("o_orderkey % 11 = 0"))
    twice = checks.repeated_keys(rows, ["o_orderkey"]).select("o_orderkey", F.lit("repeated").alias("fault"))
    return twice.unionByName(checks.wrong_lengths(rows, ["a", "b"], 2).select("o_orderkey", F.lit("length").alias("fault")))


@query("SELECT max(abs(o_totalprice - o_totalprice / (1 + o_orderkey % 7))) AS max_difference FROM orders")
def largest_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cut = o.withColumn("o_totalprice", F.col("o_totalprice") / (1 + F.col("o_orderkey") % 7))
    return checks.largest_difference(o, cut, ["o_orderkey"], "o_totalprice")


@query("""
WITH e AS (SELECT label - 1 AS cluster, vec_id % 50 = 0 AS typical, vec_id % 60 = 1 AS extreme FROM embeddings),
p AS (SELECT cluster, count(*) AS n, count(*) FILTER (typical) AS typical, count(*) FILTER (extreme) AS extreme FROM e GROUP BY 1)
SELECT * FROM p WHERE typical <> CASE WHEN cluster = -1 OR n < 2 THEN 0 ELSE 1 END OR extreme <> CASE WHEN cluster = -1 OR n < 2 THEN 0 ELSE 1 END""")
def exemplar_faults(spark, sf_dir):
    """Flags set by id, so most clusters have the wrong number of them."""
    e = noisy(spark, sf_dir).select("cluster", (F.col("vec_id") % 50 == 0).alias("is_most_typical"), (F.col("vec_id") % 60 == 1).alias("is_most_extreme"))
    return checks.exemplar_faults(e)


@query("SELECT 0::BIGINT AS faults, count(*) AS n FROM embeddings")
def exemplars_hold_the_rule(spark, sf_dir):
    e = noisy(spark, sf_dir)
    labelled = exemplars.label_exemplars(e, exemplars.find_exemplars(e, "vec_id", "embedding"), "vec_id")
    return checks.exemplar_faults(labelled).agg(F.count(F.lit(1)).alias("faults")).join(labelled.agg(F.count(F.lit(1)).alias("n")))


@query("SELECT least(count(*), 40) AS n, least(count(*), 40) AS distinct_keys, true AS stored FROM orders")
def random_rows(spark, sf_dir):
    """As many distinct rows as asked for, all of them rows of the table."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    some = profile.random_rows(rows, 40, seed=3)
    return some.join(rows.withColumn("stored", F.lit(True)), "o_orderkey", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys"), F.bool_and(F.coalesce("stored", F.lit(False))).alias("stored"))


@query("SELECT count(*) * 0.4 < count(*) * 0.5 AS plausible, true AS stored FROM orders")
def bernoulli_rows(spark, sf_dir):
    """Half of the rows, give or take, all of them rows of the table."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    n = rows.agg(F.count(F.lit(1)).alias("all"))
    some = profile.bernoulli_sample(rows, 0.5, seed=3).join(rows.withColumn("stored", F.lit(True)), "o_orderkey", "left").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("stored", F.lit(False))).alias("stored"))
    return some.join(n).select(F.col("n").between(0.4 * F.col("all"), 0.6 * F.col("all")).alias("plausible"), "stored")


@query(STATS_SQL + "SELECT vec_id, round(sum(z * dim), 5) + 0.0 AS checksum FROM z GROUP BY 1")
def saved_scaler(spark, sf_dir):
    """Scaled by a scaler written to storage and read again."""
    e = vectors(spark, sf_dir)
    path = scratch_path(spark, "scaler")
    Scaler.fit(e, "embedding").save(spark, path)
    z = Scaler.load(spark, path).transform(e, "embedding")
    return z.select("vec_id", (F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5) + 0.0).alias("checksum"))


@query(STATS_SQL + "SELECT vec_id, round(sum(x * dim), 6) AS checksum FROM v GROUP BY 1")
def full_code_round_trip(spark, sf_dir):
    """A code as long as the vector, saved, read again and decoded, gives the vector back."""
    e = vectors(spark, sf_dir)
    path = scratch_path(spark, "coder")
    Coder.fit(e, "embedding", 64).save(spark, path)
    coder = Coder.load(spark, path)
    back = coder.decode(coder.encode(e, "embedding"))
    return back.select("vec_id", F.round(F.aggregate(F.transform("reconstructed", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("checksum"))


@query(STATS_SQL + "SELECT vec_id, round(sqrt(sum(z * z)), 6) AS length FROM z GROUP BY 1")
def code_and_error_lengths(spark, sf_dir):
    """Squared code length plus what the error says is lost is the squared length of the scaled vector, for a short code."""
    e = vectors(spark, sf_dir)
    coder = Coder.fit(e, "embedding", 8)
    coded = coder.with_error(coder.encode(e, "embedding"), "embedding")
    square = F.aggregate("code", F.lit(0.0), lambda s, x: s + x * x)
    return coded.select("vec_id", F.round(F.sqrt(square + 64 * F.col("error")), 6).alias("length"))


@query(WINDOWS_SQL + f"""SELECT user_id, start_us, {text_sql('ground_speeds', 2)}, {text_sql('headings', 1)} FROM ww""")
def gathered_features(spark, sf_dir):
    """Flat vectors turned back into one array per feature."""
    w = event_windows(spark, sf_dir).withColumn("key", F.struct("user_id", "start_us"))
    cols = ["ground_speeds", "headings"]
    back = windows.gather_features(windows.flatten_features(w, "key", cols, N), "key", cols, N)
    return back.select("key.user_id", "key.start_us", as_text("ground_speeds", 2), as_text("headings", 1))


@query(SNAPSHOT_SQL + f"""SELECT {', '.join(schemas.SNAPSHOT_POINTS)} FROM s
WHERE snapshot_timestamp % 86400 BETWEEN 6 * 3600 AND 18 * 3600
  AND snapshot_timestamp // 86400 = (SELECT min(snapshot_timestamp) // 86400 + 1 FROM s)""")
def snapshot_files_by_time(spark, sf_dir):
    """All snapshots as files in day folders, named by their second, packed; those of one day between 6 and 18
    o'clock are read."""
    path = scratch_path(spark, "snapshot-files")
    docs = snapshot_documents(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.get_json_object("value", "$.now").cast("double").cast("long")))
    name = F.date_format("at", "yyyy/MM/dd/HHmmss'Z.json.gz'")
    archive.write_files(docs.select(name.alias("name"), F.col("value").alias("text"), F.lit(True).alias("packed")), path).agg(F.sum("bytes")).collect()
    first = docs.agg(F.min("at")).first()[0]
    day = datetime(first.year, first.month, first.day) + timedelta(days=1)
    rows = reports.read_snapshots(spark, path, day.replace(hour=6), day.replace(hour=18))
    return snapshot_shown(reports.snapshot_points(rows))
