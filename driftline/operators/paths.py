"""Windows to 3-D paths: dead reckoning, rotation to a common heading, labelled output.

A window is one bounded row, so everything up to the final join with labels is computed inside the row, without a
shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import arrays as A


def _running(values: Column) -> Column:
    """Cumulative sums of a short array, each from the one before."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))

    def add(so_far: Column, x: Column) -> Column:
        total = so_far["sum"] + x
        return F.struct(total.alias("sum"), F.array_append(so_far["all"], total).alias("all"))
    return F.aggregate(values, start, add, lambda done: done["all"])


def dead_reckon(wins: DataFrame, keys: list[str], mode: str = "offset", headings: str = "headings",
                ground_speeds: str = "ground_speeds", altitudes: str = "altitudes",
                time_offsets: str = "time_offsets", digits: int = 2) -> DataFrame:
    """Per window an array ``path`` of points (x, y, z, heading_deg, ground_speed, time_sec), rounded to ``digits``.

    Each step moves speed x time along the heading. ``offset`` takes the time since the window began, ``delta`` the
    time since the previous point.
    """
    if mode not in ("offset", "delta"):
        raise ValueError(f"mode must be 'offset' or 'delta': {mode!r}")
    secs = F.transform(time_offsets, lambda t: t / F.lit(1e6))
    if mode == "delta":
        secs = A.bind(secs, lambda t: F.transform(t, lambda x, i: x - F.coalesce(F.get(t, i - 1), x)))
    rad = F.transform(headings, lambda h: F.radians(h.cast("double")))
    move = lambda trig: A.bind(F.struct(rad.alias("r"), secs.alias("t")), lambda s: F.transform(
        ground_speeds, lambda v, i: v.cast("double") * trig(F.get(s["r"], i)) * F.get(s["t"], i)))
    both = F.struct(_running(move(F.sin)).alias("x"), _running(move(F.cos)).alias("y"))
    r = lambda c: F.round(c.cast("double"), digits)
    path = A.bind(both, lambda p: F.transform(A.indices(F.size(headings)), lambda i: F.struct(
        r(F.get(p["x"], i)).alias("x"), r(F.get(p["y"], i)).alias("y"),
        r(F.get(F.col(altitudes), i)).alias("z"), r(F.get(F.col(headings), i)).alias("heading_deg"),
        r(F.get(F.col(ground_speeds), i)).alias("ground_speed"),
        r(F.get(F.col(time_offsets), i) / F.lit(1e6)).alias("time_sec"))))
    return wins.select(*keys, path.alias("path"))


def rotate_to_y(paths: DataFrame, keys: list[str], lead: int = 4) -> DataFrame:
    """Turn each path so that the direction from its first to its ``lead``-th point (or the last, if shorter) is +Y.

    z is untouched; the unrotated coordinates stay as original_x and original_y.
    """
    a = F.get("path", F.lit(0))
    b = F.get("path", F.least(F.lit(lead), F.size("path")) - 1)
    turn = F.lit(math.pi / 2) - F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    angle = F.struct(F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    turned = A.bind(angle, lambda k: F.transform("path", lambda p: F.struct(
        (p["x"] * k["c"] - p["y"] * k["s"]).alias("x"), (p["x"] * k["s"] + p["y"] * k["c"]).alias("y"),
        p["z"].alias("z"), p["heading_deg"].alias("heading_deg"), p["ground_speed"].alias("ground_speed"),
        p["time_sec"].alias("time_sec"), p["x"].alias("original_x"), p["y"].alias("original_y"))))
    return paths.select(*keys, turned.alias("path"))


def _numbered(paths: DataFrame) -> Column:
    """Path points as structs that start with their 0-based position.

    Spread with ``inline``: taking single fields from an exploded struct makes the optimizer rebuild the path for each.
    """
    fields = paths.schema["path"].dataType.elementType.names
    return F.transform("path", lambda p, i: F.struct(i.alias("point_idx"), *[p[f].alias(f) for f in fields]))


def path_points(paths: DataFrame, keys: list[str]) -> DataFrame:
    """One row per path point with a 0-based ``point_idx``."""
    return paths.select(*keys, F.inline(_numbered(paths)))


def label_paths(labels: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """Every label with its path points. Joined while a path is still one row, then spread."""
    rest = [c for c in paths.columns if c not in (key, "path")]
    joined = labels.join(paths, key, "left")
    return joined.select(*labels.columns, *rest, F.inline_outer(_numbered(paths)))
