"""Column and entity reports. Every one is built from combinable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.scalars import as_micros, minutes_crossed, percent
from driftline.operators.ordering import block_count, value_blocks


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def _long(row: DataFrame, entries: list[Column]) -> DataFrame:
    """One-row aggregate to one row per column."""
    return row.select(F.inline(F.array(*entries)))


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count and share per column, all columns in one aggregate."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    return _long(one, [F.struct(
        F.lit(c).alias("column_name"), F.col("_rows").alias("total_rows"), F.col(f"_{i}").alias("null_count"),
        percent(F.col(f"_{i}"), F.col("_rows")).alias("null_percentage")) for i, c in enumerate(cols)])


def null_profile_wide(df: DataFrame) -> DataFrame:
    """The same as one row with two columns per column."""
    rows = F.count(F.lit(1))
    return df.agg(*[e for c in df.columns for e in (
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}_null_count"),
        percent(F.count_if(F.col(f"`{c}`").isNull()), rows).alias(f"{c}_null_percentage"))])


def _as_text(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # -0.0 and 0.0 are one value
    if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def _distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column number, value) pairs without repeats; NULLs excluded.

    Pairs are made distinct map-side first, so a value shared by a large part of the rows is sent once per task.
    """
    fields = [df.schema[c] for c in cols]
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), _as_text(f).alias("v")) for i, f in enumerate(fields)])
    return df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).distinct()


def distinct_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct count and share per column, NULLs not counted; ``approx`` trades exactness for a single sketch pass."""
    cols = df.columns
    if approx:
        one = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.approx_count_distinct(_as_text(df.schema[c])).alias(f"_{i}") for i, c in enumerate(cols)])
        return _long(one, [F.struct(
            F.lit(c).alias("column_name"), F.col(f"_{i}").alias("distinct_count"),
            percent(F.col(f"_{i}"), F.col("_rows")).alias("distinct_percentage")) for i, c in enumerate(cols)])
    counts = _distinct_values(df, cols).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    one = df.agg(F.count(F.lit(1)).alias("_rows"))
    names = _long(one, [F.struct(F.lit(i).alias("c"), F.lit(c).alias("column_name"), F.col("_rows"))
                        for i, c in enumerate(cols)])
    # both sides have one row per column of the table
    return (names.join(F.broadcast(counts), "c", "left")
            .select("column_name", F.coalesce("d", F.lit(0)).alias("distinct_count"),
                    percent(F.coalesce("d", F.lit(0)), F.col("_rows")).alias("distinct_percentage")))


def column_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, rows, distinct and NULL figures per column."""
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    # one row per column of the table on both sides
    return (null_profile(df).join(F.broadcast(distinct_profile(df, approx)), "column_name")
            .select("column_name", F.element_at(types, F.col("column_name")).alias("data_type"), "total_rows",
                    "distinct_count", "distinct_percentage", "null_count", "null_percentage"))


def low_cardinality_columns(df: DataFrame, limit: int = 32) -> tuple[list[str], list[str]]:
    """(columns with at most ``limit`` distinct values, the others)."""
    low = {r["column_name"] for r in
           distinct_profile(df).filter(F.col("distinct_count") <= limit).collect()}  # one row per column
    return [c for c in df.columns if c in low], [c for c in df.columns if c not in low]


def low_cardinality_values(df: DataFrame, limit: int = 32) -> DataFrame:
    """Distinct values of each low-cardinality column as sorted text, NULL last where it occurs.

    The first pass finds the columns; the second reads only those, so each list is bounded by ``limit``.
    """
    low, _ = low_cardinality_columns(df, limit)
    if not low:
        return df.sparkSession.createDataFrame([], "column_name string, values array<string>")
    values = _distinct_values(df, low).groupBy("c").agg(F.array_sort(F.collect_set("v")).alias("v"))
    nulls = df.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(low)])
    flags = _long(nulls, [F.struct(F.lit(i).alias("c"), F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n"))
                          for i, c in enumerate(low)])
    empty = F.array().cast("array<string>")
    return flags.join(F.broadcast(values), "c", "left").select(
        "column_name", F.concat(F.coalesce("v", empty), F.when(F.col("n"), F.array(F.lit(None).cast("string")))
                                .otherwise(empty)).alias("values"))


# ---- entities ------------------------------------------------------------------------------------------------

def mean_points_per_entity(df: DataFrame, entity: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_point_count"))


def _spans(df: DataFrame, entity: str, ts: str, unit: str) -> DataFrame:
    us = as_micros(df, ts, unit)
    return df.groupBy(entity).agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def mean_span_minutes(df: DataFrame, entity: str, ts: str, unit: str = "us") -> DataFrame:
    """Mean of last - first per entity, averaged in whole milliseconds (half to even), in minutes."""
    ms = F.floor((F.col("last_us") - F.col("first_us")) / 1000)
    return _spans(df, entity, ts, unit).agg(
        (F.bround(F.avg(ms), 0) / 1000.0 / 60.0).alias("mean_duration_minutes"))


def entities_over_span(df: DataFrame, entity: str, ts: str, minutes: int, unit: str = "us") -> DataFrame:
    """Entities whose span crosses more than ``minutes`` minute boundaries."""
    crossed = minutes_crossed(F.timestamp_micros("first_us"), F.timestamp_micros("last_us"))
    return (_spans(df, entity, ts, unit).filter(crossed > minutes)
            .agg(F.count(F.lit(1)).alias("entity_count")))


def time_range(df: DataFrame, ts: str, unit: str = "us") -> DataFrame:
    us = as_micros(df, ts, unit)
    return df.agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def group_count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("groups"))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n most frequent non-NULL values; ties in value order."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.desc("n_rows"), col).limit(n))


def rows_in_top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Rows whose value is among the n most frequent; the list has at most n rows."""
    return df.join(F.broadcast(top_values(df, col, n).select(col)), col, "left_semi")


# ---- order statistics ----------------------------------------------------------------------------------------

def quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: list[float],
              blocks: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per key and column as rows (keys, column_name, prob, value).

    Values are counted, placed in value ranges, and only the ranges that hold a wanted rank are ordered. No group is
    ordered as a whole, so neither the global case (no keys) nor one huge key becomes a single task. The number of
    ranges follows the row count unless given.
    """
    blocks = blocks or block_count(df.count())
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    for c, b in value_blocks(wide, cols, blocks).items():
        clean = wide.withColumn(c, F.when(~F.isnan(c), F.col(c)))
        wide = b.assign(clean, f"_b_{c}") if b.bounds else clean.withColumn(f"_b_{c}", F.lit(0))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_b_{c}").alias("block"),
                               F.col(c).alias("v")) for c in cols])
    group = [*keys, "column_name"]
    counted = (wide.select(*keys, F.inline(pairs)).filter(F.col("v").isNotNull())
               .groupBy(*group, "block", "v").agg(F.count(F.lit(1)).alias("n")))
    # at most 2 * blocks + 1 rows per group
    per_block = counted.groupBy(*group, "block").agg(F.sum("n").alias("bn"))
    ordered = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    per_block = (per_block.withColumn("before", F.sum("bn").over(ordered) - F.col("bn"))
                 .withColumn("total", F.sum("bn").over(Window.partitionBy(*group))))
    wanted = F.explode(F.lit([float(p) for p in probs])).alias("prob")
    rank = F.col("prob") * (F.col("total") - 1)
    hit = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("bn"))
    targets = (per_block.select("*", wanted).withColumn("lo", F.floor(rank))
               .withColumn("hi", F.ceil(rank)).withColumn("frac", rank - F.col("lo"))
               .filter(hit(F.col("lo")) | hit(F.col("hi")))
               .groupBy(*group, "block").agg(
                   F.first("before").alias("before"), F.collect_list(F.struct("prob", "lo", "hi", "frac")).alias("want")))
    if not keys:
        targets = F.broadcast(targets)  # at most two ranges per column and probability
    inside = Window.partitionBy(*group, "block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = (counted.join(targets, [*group, "block"])
             .withColumn("last", F.col("before") + F.sum("n").over(inside) - 1)
             .withColumn("first", F.col("last") - F.col("n") + 1))
    has = lambda r: (r >= F.col("first")) & (r <= F.col("last"))
    found = (found.withColumn("want", F.filter("want", lambda t: has(t["lo"]) | has(t["hi"])))
             .select(*group, "first", "last", "v", F.inline("want")))
    return found.groupBy(*group, "prob").agg(
        F.max(F.when(has(F.col("lo")), F.col("v"))).alias("_lo"),
        F.max(F.when(has(F.col("hi")), F.col("v"))).alias("_hi"), F.max("frac").alias("_f")).select(
        *group, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))


def distribution_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles per numeric column."""
    d = {c: F.col(c).cast("double") for c in cols}
    one = df.agg(*[e for i, v in enumerate(d.values()) for e in (
        F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev(v).alias(f"s{i}"),
        F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"))])
    base = _long(one, [F.struct(
        F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("mean"),
        F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"))
        for i, c in enumerate(cols)])
    q = quantiles(df, [], cols, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    q = q.groupBy("column_name").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    return base.join(F.broadcast(q), "column_name", "left")  # one row per column


def bin_of(c: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin number; the last bin includes ``high``; outside values give NULL."""
    width = (high - low) / bins
    return F.when(c.between(low, high), F.least(F.floor((c - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int = 50) -> DataFrame:
    return (df.select(bin_of(F.col(col).cast("double"), low, high, bins).alias("bin"))
            .filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


def histogram_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float] = (-180.0, 180.0),
                 y_range: tuple[float, float] = (-90.0, 90.0), bins: int = 150) -> DataFrame:
    return (df.select(bin_of(F.col(x).cast("double"), *x_range, bins).alias("bin_x"),
                      bin_of(F.col(y).cast("double"), *y_range, bins).alias("bin_y"))
            .filter(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
            .groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n")))


# ---- samples -------------------------------------------------------------------------------------------------

def bernoulli_sample(df: DataFrame, fraction: float = 0.005, seed: int | None = None) -> DataFrame:
    return df.sample(False, fraction, seed)


def random_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def reproducible_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The same n rows on every run and engine: order by a hash of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), key).limit(n)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)

