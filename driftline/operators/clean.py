"""Filters, deduplication and key-based merging of tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.scalars import non_null_fields


# ---- filters -------------------------------------------------------------------------------------------------

def prefix_bounds(first: str, last: str) -> tuple[str, str]:
    """Check and lower-case an inclusive range of two-digit hex prefixes."""
    a, b = first.lower(), last.lower()
    for p in (a, b):
        if not re.fullmatch(r"[0-9a-f]{2}", p):
            raise ValueError(f"prefix must be two hex digits: {p!r}")
    if a > b:
        raise ValueError(f"prefix range is reversed: {a} > {b}")
    return a, b


def prefix_range(df: DataFrame, prefix_col: str, first: str, last: str) -> DataFrame:
    """Ids in an inclusive prefix range. On a table partitioned by ``prefix_col`` only those folders are read."""
    a, b = prefix_bounds(first, last)
    return df.filter(F.col(prefix_col).between(a, b))


def registered_only(df: DataFrame, id_col: str) -> DataFrame:
    """Drop ids that are not official addresses (marked by a leading tilde)."""
    return df.filter(~F.col(id_col).startswith("~"))


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def match_count(df: DataFrame, ids: DataFrame, key: str) -> int:
    return keep_ids(df, ids, key).count()


def numeric_columns(df: DataFrame, except_like: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns whose lower-cased name contains none of the given patterns."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)
            and not any(p in f.name.lower() for p in except_like)]


# ---- deduplication -------------------------------------------------------------------------------------------
# All keyed forms are aggregates, not window ranks: rows of one key are combined before the shuffle, so a key that
# holds a large share of all rows costs one row per map task.

def exact_dedupe(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def _pick(df: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    return df.groupBy(*keys).agg(chosen.alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def keep_richest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row with most non-NULL fields; the first in ``order`` among equals."""
    rest = [c for c in df.columns if c not in order]
    rank = F.struct((-non_null_fields(rest)).alias("poor"), *order)
    return _pick(df, keys, F.min_by(F.struct(*df.columns), rank))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, F.min_by(F.struct(*df.columns), F.struct(*order)))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, F.max_by(F.struct(*df.columns), F.struct(*order)))


def duplicate_report(df: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Rows and surplus rows per group. Keys are counted first, so no group is gathered in one place."""
    per_key = df.groupBy(group, *keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(group).agg(
        F.sum("_n").alias("rows"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"))


# ---- merging -------------------------------------------------------------------------------------------------

def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add incoming rows whose key is new; the stored row wins, then the first incoming one."""
    fresh = keep_first(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows replace stored rows of the same key; the last incoming one wins."""
    latest = keep_last(incoming, keys, order)
    return existing.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*existing.columns))


# ---- types ---------------------------------------------------------------------------------------------------

def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast named columns; values that do not fit become NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def encode_arrays(df: DataFrame, elements: dict[str, str]) -> DataFrame:
    """Type array elements, e.g. ``decimal(9,6)``; whole-number types truncate; what does not fit becomes NULL."""
    def typed(c: str, t: str) -> Column:
        if t in ("int", "bigint"):
            return F.transform(c, lambda x: x.try_cast("double").try_cast(t))
        return F.transform(c, lambda x: x.try_cast(t))
    return df.withColumns({c: typed(c, t) for c, t in elements.items()})


def narrowest_types(df: DataFrame, tolerance: float = 0.0) -> dict[str, str]:
    """Smallest type per numeric column that holds every value, from one aggregate pass.

    Whole-valued columns take the narrowest signed integer, others float when every value survives the round trip;
    what fits neither keeps its type. With ``tolerance`` a relative error up to it counts as surviving. Decimals with a
    fraction keep their type, since no binary type holds them exactly.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    cols = numeric_columns(df)
    if not cols:
        return {}
    inf = F.lit(float("inf"))

    def facts(c: str) -> list[Column]:
        v = F.col(c)
        d = v.cast("double")
        if isinstance(kinds[c], (T.FloatType, T.DoubleType)):
            whole = (d == F.rint(d)) & (F.abs(d) < 2.0 ** 63) & ~F.isnan(d)
            back = d.cast("float").cast("double")
            near = F.isnan(d) | (back == d) | (F.abs(d - back) <= tolerance * F.abs(d)) & (F.abs(back) < inf)
        else:
            whole = v.try_cast("bigint").cast(kinds[c]) == v
            near = F.lit(False)
        fits = [F.bool_and(F.coalesce(v.try_cast(t).cast("decimal(38,0)") == v.try_cast("decimal(38,0)"), F.lit(False)) | v.isNull()).alias(f"{t}_{c}")
                for t in INTEGERS]
        return [F.count(v).alias(f"n_{c}"), F.bool_and(whole).alias(f"whole_{c}"), F.bool_and(near).alias(f"near_{c}"), *fits]

    row = df.agg(*[e for c in cols for e in facts(c)]).first()
    out = {}
    for c in cols:
        if not row[f"n_{c}"]:
            continue
        integer = next((t for t in INTEGERS if row[f"{t}_{c}"]), None) if row[f"whole_{c}"] else None
        same = kinds[c].simpleString()
        out[c] = integer or ("float" if row[f"near_{c}"] else same)
    return out


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def narrow(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Numeric columns in their narrowest types; see ``narrowest_types``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    types = {c: t for c, t in narrowest_types(df, tolerance).items() if t != kinds[c]}
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})
