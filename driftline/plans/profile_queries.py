"""Column and entity reports, filters, deduplication and merging over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import checks, clean, correlate, profile
from driftline.plans.registry import query, table


def with_nulls(spark, sf_dir):
    """orders with some values taken out."""
    return table(spark, sf_dir, "orders").withColumns({
        "o_orderstatus": F.nullif(F.col("o_orderstatus"), F.lit("P")),
        "o_orderpriority": F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")),
        "o_custkey": F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))})


NULLS_SQL = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey,
  nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderdate,
  nullif(o_orderpriority, '2-HIGH') AS o_orderpriority FROM orders)
"""
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_TYPES = dict(zip(ORDER_COLUMNS, ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]))


def per_column_sql(select: str, columns: list[str] = ORDER_COLUMNS) -> str:
    return "\nUNION ALL ".join(select.replace("{c}", c) for c in columns)


@query(NULLS_SQL + per_column_sql("""SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count,
round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_percentage FROM o"""))
def null_profile(spark, sf_dir):
    return profile.null_profile(with_nulls(spark, sf_dir))


@query(NULLS_SQL + "SELECT " + ", ".join(
    f"count(*) - count({c}) AS {c}_null_count, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS {c}_null_percentage"
    for c in ORDER_COLUMNS) + " FROM o")
def null_profile_wide(spark, sf_dir):
    return profile.null_profile_wide(with_nulls(spark, sf_dir))


@query(NULLS_SQL + per_column_sql("""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count,
round(100.0 * count(DISTINCT {c}) / count(*), 2)::DOUBLE AS distinct_percentage FROM o"""))
def distinct_profile(spark, sf_dir):
    return profile.distinct_profile(with_nulls(spark, sf_dir))


@query(NULLS_SQL + "\nUNION ALL ".join(f"""SELECT '{c}' AS column_name, '{ORDER_TYPES[c]}' AS data_type,
count(*) AS total_rows, count(DISTINCT {c}) AS distinct_count,
round(100.0 * count(DISTINCT {c}) / count(*), 2)::DOUBLE AS distinct_percentage, count(*) - count({c}) AS null_count,
round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_percentage FROM o""" for c in ORDER_COLUMNS))
def column_summary(spark, sf_dir):
    return profile.column_summary(with_nulls(spark, sf_dir))


@query(NULLS_SQL + """SELECT 'o_orderstatus' AS column_name,
  string_agg(coalesce(v, 'NULL'), ',' ORDER BY v NULLS LAST) AS vals FROM (SELECT DISTINCT o_orderstatus AS v FROM o)
UNION ALL SELECT 'o_orderpriority', string_agg(coalesce(v, 'NULL'), ',' ORDER BY v NULLS LAST)
FROM (SELECT DISTINCT o_orderpriority AS v FROM o)""")
def low_cardinality_values(spark, sf_dir):
    v = profile.low_cardinality_values(with_nulls(spark, sf_dir))
    return v.select("column_name", F.array_join("values", ",", "NULL").alias("vals"))


@query(per_column_sql("SELECT '{c}' AS column_name, count(DISTINCT {c}) <= 32 AS low FROM lineitem",
                      ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                       "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]))
def cardinality_split(spark, sf_dir):
    d = profile.distinct_profile(table(spark, sf_dir, "lineitem"))
    return d.select("column_name", (F.col("distinct_count") <= 32).alias("low"))


@query("SELECT round(avg(n), 6) AS mean_point_count FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def mean_points_per_entity(spark, sf_dir):
    m = profile.mean_points_per_entity(table(spark, sf_dir, "events"), "user_id")
    return m.select(F.round("mean_point_count", 6).alias("mean_point_count"))


@query("""SELECT round(CAST(avg(ms) AS BIGINT) / 1000.0 / 60.0, 6)::DOUBLE AS mean_duration_minutes
FROM (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM events GROUP BY user_id)""")
def mean_span(spark, sf_dir):
    m = profile.mean_span_minutes(table(spark, sf_dir, "events"), "user_id", "ts")
    return m.select(F.round("mean_duration_minutes", 6).alias("mean_duration_minutes"))


@query("""SELECT count(*) AS entity_count FROM (SELECT user_id FROM events GROUP BY user_id
HAVING datediff('minute', min(ts), max(ts)) > 41500)""")
def entities_over_span(spark, sf_dir):
    return profile.entities_over_span(table(spark, sf_dir, "events"), "user_id", "ts", 41500)


@query("SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events")
def time_range(spark, sf_dir):
    return profile.time_range(table(spark, sf_dir, "events"), "ts")


@query("SELECT count(*) AS groups FROM (SELECT DISTINCT user_id, event_type FROM events)")
def group_count(spark, sf_dir):
    return profile.group_count(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_entities(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "events"), "user_id", 10)


@query("SELECT p_brand, count(*) AS n_rows FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_categories(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), "p_brand", 10)


@query("""SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_brand IS NOT NULL
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)""")
def rows_in_top_categories(spark, sf_dir):
    return profile.rows_in_top_values(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 10)


NUMERIC = ["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("\nUNION ALL ".join(
    f"SELECT '{a}' AS var_1, '{b}' AS var_2, round(corr({a}, {b}), 4) AS correlation FROM lineitem"
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]))
def pearson_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return correlate.pearson(li, clean.numeric_columns(li, ("orderkey", "suppkey")))


@query("WITH l AS (SELECT *, l_extendedprice * (1 + l_tax) AS gross FROM lineitem), r AS (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS var_1, '{b}' AS var_2, round(corr({a}, {b}), 4) AS correlation FROM l"
    for i, a in enumerate(["l_quantity", "l_extendedprice", "gross"]) for b in ["l_quantity", "l_extendedprice", "gross"][i + 1:])
    + ") SELECT * FROM r WHERE abs(correlation) >= 0.5")
def strong_pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return correlate.strong_pairs(correlate.pearson(li, ["l_quantity", "l_extendedprice", "gross"]), 0.5)


RANKED = ["l_quantity", "l_extendedprice", "l_discount"]


def spearman_sql(a: str, b: str) -> str:
    rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    return (f"SELECT '{a}' AS var_1, '{b}' AS var_2, round(corr(x, y), 4) AS correlation "
            f"FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM l WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query("WITH l AS (SELECT nullif(l_quantity, 7) AS l_quantity, l_extendedprice, nullif(l_discount, 0.05) AS l_discount "
       "FROM lineitem)\n" + "\nUNION ALL ".join(
           spearman_sql(a, b) for i, a in enumerate(RANKED) for b in RANKED[i + 1:]))
def spearman_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("l_quantity"), "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.05)).alias("l_discount"))
    return correlate.spearman(li, RANKED)


def kendall_sql(a: str, b: str) -> str:
    """Pairs of distinct (x, y) cells with their row counts: feasible because both columns have few values."""
    cells = f"(SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)"
    ties = lambda c: f"(SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY {c}))"
    return (f"SELECT '{a}' AS var_1, '{b}' AS var_2, round(sum(p.w * q.w * sign(p.x - q.x) * sign(p.y - q.y)) / 2 / "
            f"sqrt((max(t.n0) - max(t.n1)) * (max(t.n0) - max(t.n2))), 4) AS correlation FROM {cells} p, {cells} q, "
            f"(SELECT (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 FROM lineitem) AS n0, {ties(a)} AS n1, {ties(b)} AS n2) t")


FEW = ["l_quantity", "l_discount", "l_tax"]


@query("\nUNION ALL ".join(kendall_sql(a, b) for i, a in enumerate(FEW) for b in FEW[i + 1:]))
def kendall_matrix(spark, sf_dir):
    return correlate.kendall(table(spark, sf_dir, "lineitem"), FEW)


@query("""
WITH p AS (SELECT sign(a.o_totalprice - b.o_totalprice) AS x, sign(a.o_custkey - b.o_custkey) AS y
           FROM orders a JOIN orders b ON a.o_orderkey < b.o_orderkey)
SELECT 'o_totalprice' AS var_1, 'o_custkey' AS var_2,
       round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)::DOUBLE), 4) AS correlation FROM p""")
def kendall_continuous(spark, sf_dir):
    """All pairs of orders; the small group limit makes the value ranges of the general method do the work."""
    return correlate.kendall(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], group_rows=500)


@query("""SELECT least(floor((l_quantity - 0) / (50.0 / 25)), 24)::INTEGER AS bin_x,
least(floor((l_extendedprice - 0) / (100000.0 / 25)), 24)::INTEGER AS bin_y, count(*) AS n FROM lineitem
WHERE l_quantity BETWEEN 0 AND 50 AND l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1, 2""")
def histogram_2d(spark, sf_dir):
    return profile.histogram_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", (0.0, 50.0),
                                (0.0, 100000.0), 25)


SUMMARISED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(per_column_sql("""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean,
round(stddev({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q1,
round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM lineitem""", SUMMARISED))
def distribution_summary(spark, sf_dir):
    d = profile.distribution_summary(table(spark, sf_dir, "lineitem"), SUMMARISED)
    r = lambda c: F.round(c, 6).alias(c)
    return d.select("column_name", "n", r("mean"), r("std"), "min", "max", r("q1"), r("median"), r("q3"))


@query("""SELECT least(floor((l_extendedprice - 900) / ((105000.0 - 900.0) / 50)), 49)::INTEGER AS bin, count(*) AS n
FROM lineitem WHERE l_extendedprice BETWEEN 900 AND 105000 GROUP BY 1""")
def histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 900.0, 105000.0)


@query("""SELECT hour(ts) * 60 + minute(ts) AS minute_of_day, count(*) AS n FROM events GROUP BY 1""")
def minutes_since_midnight(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(S.minutes_since_midnight(F.col("ts")).cast("long").alias("minute_of_day")).agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, user_id, value FROM events
WHERE epoch_us(ts) >= 1704672000000000 AND epoch_us(ts) < 1705276800000000""")
def half_open_range(spark, sf_dir):
    from driftline.operators.windows import points_in_range
    ev = points_in_range(table(spark, sf_dir, "events"), "ts", 1704672000000000, 1705276800000000)
    return ev.select("event_id", "user_id", "value")


# ---- deduplication and merging ---------------------------------------------------------------------------------

def degraded(spark, sf_dir):
    """Events, a poorer copy of every second, an equally rich later copy of every third, and an exact copy of some."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    full = ev.withColumn("seq", F.col("event_id") * 4)
    poor = ev.filter(F.col("event_id") % 2 == 0).withColumns(
        {"props": F.lit(None).cast("string"), "seq": F.col("event_id") * 4 - 1})
    later = ev.filter(F.col("event_id") % 3 == 0).withColumns(
        {"value": F.col("value") + 1000, "seq": F.col("event_id") * 4 + 1})
    exact = full.filter(F.col("event_id") % 5 == 0)
    return full.unionByName(poor).unionByName(later).unionByName(exact)


DEGRADED_SQL = """
WITH e AS (SELECT event_id, user_id, event_type, value, props FROM events),
d AS (SELECT *, event_id * 4 AS seq FROM e
  UNION ALL SELECT event_id, user_id, event_type, value, NULL, event_id * 4 - 1 FROM e WHERE event_id % 2 = 0
  UNION ALL SELECT event_id, user_id, event_type, value + 1000, props, event_id * 4 + 1 FROM e WHERE event_id % 3 = 0
  UNION ALL SELECT *, event_id * 4 FROM e WHERE event_id % 5 = 0)
"""


@query(DEGRADED_SQL + """SELECT event_id, user_id, event_type, value, props, seq FROM (SELECT *, row_number() OVER (
PARTITION BY event_id ORDER BY (props IS NOT NULL)::INT DESC, seq) AS k FROM d) WHERE k = 1""")
def richest_dedupe(spark, sf_dir):
    return clean.keep_richest(degraded(spark, sf_dir), ["event_id"], ["seq"])


@query(DEGRADED_SQL + "SELECT DISTINCT event_id, user_id, event_type, value, coalesce(props, '') AS props, seq FROM d")
def exact_dedupe(spark, sf_dir):
    return clean.exact_dedupe(degraded(spark, sf_dir)).withColumn("props", F.coalesce("props", F.lit("")))


@query(DEGRADED_SQL + """SELECT event_id, user_id, event_type, value, coalesce(props, '') AS props, seq FROM (
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS k FROM d) WHERE k = 1""")
def keep_last(spark, sf_dir):
    out = clean.keep_last(degraded(spark, sf_dir), ["event_id"], ["seq"])
    return out.withColumn("props", F.coalesce("props", F.lit("")))


@query(DEGRADED_SQL + """SELECT event_type, count(*) AS rows, count(*) - count(DISTINCT event_id) AS duplicates
FROM d GROUP BY 1""")
def duplicate_report(spark, sf_dir):
    r = clean.duplicate_report(degraded(spark, sf_dir), "event_type", ["event_id"])
    return r.select("event_type", "rows", "duplicates")


@query(DEGRADED_SQL + """SELECT event_id, (event_id IS NOT NULL)::INT + (user_id IS NOT NULL)::INT
+ (event_type IS NOT NULL)::INT + (value IS NOT NULL)::INT + (props IS NOT NULL)::INT AS filled, seq FROM d""")
def non_null_fields(spark, sf_dir):
    d = degraded(spark, sf_dir)
    return d.select("event_id", S.non_null_fields([c for c in d.columns if c != "seq"]).alias("filled"), "seq")


MERGE_SQL = """
WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
"""


def _merge_sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.filter(F.col("o_orderkey") % 3 != 0)
    new = o.filter(F.col("o_orderkey") % 2 == 0).withColumns(
        {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    return old, new


@query(MERGE_SQL + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_ignore(spark, sf_dir):
    return clean.insert_ignore(*_merge_sides(spark, sf_dir), ["o_orderkey"], ["o_totalprice"])


@query(MERGE_SQL + "SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def upsert(spark, sf_dir):
    return clean.upsert(*_merge_sides(spark, sf_dir), ["o_orderkey"], ["o_totalprice"])


HEX_SQL = """
WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '~' ELSE '' END || md5(c_custkey::VARCHAR) AS id
FROM customer)
"""


def hex_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    tilde = F.when(F.col("c_custkey") % 10 == 0, "~").otherwise("")
    return c.withColumn("id", F.concat(tilde, F.md5(F.col("c_custkey").cast("string"))))


@query(HEX_SQL + """SELECT substr(id, 1, 2) AS hex_prefix, count(*) AS n FROM h
WHERE id NOT LIKE '~%' AND substr(id, 1, 2) BETWEEN '10' AND '9f' GROUP BY 1""")
def prefix_partition_counts(spark, sf_dir):
    ids = clean.registered_only(hex_ids(spark, sf_dir), "id").withColumn("hex_prefix", F.substring("id", 1, 2))
    return clean.prefix_range(ids, "hex_prefix", "10", "9F").groupBy("hex_prefix").agg(F.count(F.lit(1)).alias("n"))


@query(HEX_SQL + "SELECT c_custkey, substr(id, 1, 6) AS short_id FROM h WHERE id NOT LIKE '~%'")
def short_ids(spark, sf_dir):
    return clean.registered_only(hex_ids(spark, sf_dir), "id").select("c_custkey", S.short_id(F.col("id")).alias("short_id"))


@query("SELECT event_id, user_id, value FROM events ORDER BY md5(event_id::VARCHAR || '|42'), event_id LIMIT 500")
def reproducible_sample(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return profile.reproducible_rows(ev, "event_id", 500)


@query("SELECT DISTINCT user_id FROM events ORDER BY 1")
def distinct_ids(spark, sf_dir):
    return profile.distinct_sorted(table(spark, sf_dir, "events"), "user_id")


@query("""SELECT count(*) AS matched FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def matched_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").filter(F.col("c_nationkey") == 3).select(F.col("c_custkey").alias("user_id"))
    return clean.keep_ids(table(spark, sf_dir, "events"), ids, "user_id").agg(F.count(F.lit(1)).alias("matched"))


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1""")
def repeated_keys(spark, sf_dir):
    return checks.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@query(NULLS_SQL + """SELECT o_orderkey FROM o
WHERE o_custkey IS NULL OR o_orderstatus IS NULL OR o_orderpriority IS NULL""")
def rows_with_null(spark, sf_dir):
    return checks.rows_with_null(with_nulls(spark, sf_dir)).select("o_orderkey")


@query("""SELECT event_id, CASE WHEN lower(alt) = 'ground' THEN 0 ELSE trunc(try_cast(alt AS DOUBLE))::INTEGER END AS altitude
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'ground' WHEN 'view' THEN 'Ground'
ELSE (value * 100)::VARCHAR END AS alt FROM events)""")
def ground_altitude(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    alt = (F.when(F.col("event_type") == "click", "ground").when(F.col("event_type") == "view", "Ground")
           .otherwise((F.col("value") * 100).cast("string")))
    return ev.select("event_id", S.altitude_or_ground(alt).alias("altitude"))


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def narrow_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, CASE WHEN bool_and({c} = round({c}) AND abs({c}) < 9e18) THEN
    CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
         WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END
  WHEN bool_and({c}::DOUBLE::FLOAT::DOUBLE = {c}::DOUBLE) THEN 'float' ELSE 'double' END AS data_type, sum({c}::DOUBLE) > 0 AS kept FROM lineitem"""


@query(" UNION ALL ".join(narrow_sql(c) for c in NUMBERS))
def narrowest_types(spark, sf_dir):
    """All numeric columns; ``kept``: the sum over the narrowed column equals that over the stored one."""
    li = table(spark, sf_dir, "lineitem").select(*NUMBERS)
    small = clean.narrow(li)
    sums = lambda df, tag: df.agg(*[F.sum(F.col(c).cast("decimal(38,4)")).alias(f"{tag}_{c}") for c in NUMBERS])
    both = sums(li, "a").crossJoin(sums(small, "b"))  # one row each
    names = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                               (F.col(f"a_{f.name}") == F.col(f"b_{f.name}")).alias("kept")) for f in small.schema])
    return both.select(F.inline(names))


@query("SELECT least(count(*), 100) AS n FROM lineitem")
def plain_limit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").limit(100).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, epoch_us(ts) // 1000 AS ms, typed FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts, "
       "try_cast(regexp_replace(o_orderpriority, '-.*', '') AS INTEGER) AS typed FROM orders)")
def typed_casts(spark, sf_dir):
    """Text cast to numbers where it fits, times to milliseconds."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.regexp_replace("o_orderpriority", "-.*", "").alias("typed"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return clean.cast_columns(o, {"typed": "int"}).select("o_orderkey", F.unix_millis("ts").alias("ms"), "typed")
