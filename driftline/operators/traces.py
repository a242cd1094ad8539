"""Points to traces: cut each entity's points where the time gap exceeds a limit.

One entity may hold a large share of all rows, and one instant too, so nothing here groups by entity alone. Points are first
placed in cells of an entity and a stretch of time; inside a cell they are numbered and cut into fragments without a gap. The
summaries of fragments form a monoid (first, last, rows, breaks), so they are linked by a prefix scan in two levels: within
blocks of tiles, then over one summary a block. Their number follows elapsed time, not rows.

Cells are bounded: a tile with more than ``tile_rows`` points is cut at times that leave at most so many in a cell, and an
instant that alone has more is dealt out by a hash of its rows, the parts following each other. (With a tie-break the order
inside the instant is given, so it stays one cell, which is sorted with spilling.) Which tiles are dense follows from a count
that reads the entity and time columns only; where none is, the cuts cost nothing further. All of it is one lazy plan, nothing
runs while it is made, and points are shuffled once: the summaries are taken from the same shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import as_micros

LINK_TILES = 4096  # tiles whose fragments are linked together before blocks are


@dataclass(frozen=True)
class GapRule:
    """How points form traces. ``gap_us`` is exceeded strictly; ``chunk_us`` also cuts at fixed clock times."""

    entity: str
    ts: str
    gap_us: int
    unit: str = "us"
    tiebreak: tuple[str, ...] = ()
    chunk_us: int | None = None
    chunk_origin_us: int = 0
    tile_us: int | None = None
    tile_rows: int = 2_000_000

    @property
    def width(self) -> int:
        return self.tile_us or 6 * self.gap_us


def _tiled(df: DataFrame, rule: GapRule) -> DataFrame:
    """Points in their time tiles. A point without an entity or a time belongs to no trace, in every form."""
    return (df.withColumn("_us", as_micros(df, rule.ts, rule.unit)).filter(F.col(rule.entity).isNotNull() & F.col("_us").isNotNull())
            .withColumn("_tile", _never_null(F.floor(F.col("_us") / F.lit(rule.width)).cast("long"))))


def _never_null(c: Column) -> Column:
    """Said of a key, so that joins on it add no filter to one reader of a shuffle that others of its readers lack."""
    return F.coalesce(c, F.lit(0))


def _cuts(df: DataFrame, rule: GapRule) -> DataFrame:
    """Per dense tile its cuts in order: from which time on a cell is ``sub``, and in how many parts it is dealt out.

    ``sub`` is the number of the tile's points before it, so it grows with time. At most two entries per ``tile_rows`` points.
    """
    tile = [rule.entity, "_tile"]
    narrow = _tiled(df.select(rule.entity, rule.ts), rule)
    dense = narrow.groupBy(*tile).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rule.tile_rows).select(*tile)
    instants = narrow.join(F.broadcast(dense), tile).groupBy(*tile, "_us").agg(F.count(F.lit(1)).alias("_n"))
    half = F.lit(max(1, rule.tile_rows // 2))
    before = F.sum("_n").over(Window.partitionBy(*tile).orderBy("_us")) - F.col("_n")
    burst = F.col("_n") > half
    placed = instants.withColumn("_before", before).select(
        *tile, "_us", F.when(burst, F.col("_before")).otherwise(F.floor(F.col("_before") / half).cast("long") * half).alias("sub"),
        F.when(burst & F.lit(not rule.tiebreak), F.ceil(F.col("_n") / half).cast("long")).otherwise(F.lit(1).cast("long")).alias("parts"))
    starts = placed.groupBy(*tile, "sub", "parts").agg(F.min("_us").alias("from_us"))
    return starts.groupBy(*tile).agg(F.array_sort(F.collect_list(F.struct("from_us", "sub", "parts"))).alias("_cuts"))


def _cells(df: DataFrame, rule: GapRule) -> DataFrame:
    """Points with their cell: entity, ``_tile`` and ``_sub``, which grows with time inside a tile."""
    # the cuts have at most 2 rows / tile_rows entries in all, and only dense tiles have any
    pts = _tiled(df, rule).join(F.broadcast(_cuts(df, rule)), [rule.entity, "_tile"], "left")
    cut = F.element_at(F.filter("_cuts", lambda c: c["from_us"] <= F.col("_us")), -1)
    part = F.when(F.col("_cut.parts") > 1, F.pmod(F.xxhash64(*df.columns), F.col("_cut.parts"))).otherwise(F.lit(0))
    return (pts.withColumn("_cut", F.when(F.col("_cuts").isNotNull(), cut))
            .withColumn("_sub", F.coalesce(F.col("_cut.sub") + part, F.lit(0)).cast("long")).drop("_cuts", "_cut"))


def _fragments(df: DataFrame, rule: GapRule) -> tuple[DataFrame, DataFrame]:
    """(points with cell-local numbers, one row per gap-free fragment inside a cell).

    A fragment also carries the greatest hash of its rows. Whoever joins both compares it with each row's own, which is
    always true, and makes both sides ask for the very same columns: so they read one shuffle, and the input is read once.
    """
    cell = [rule.entity, "_tile", "_sub"]
    w = Window.partitionBy(*cell).orderBy("_us", *rule.tiebreak)
    pts = (_cells(df, rule).withColumn("_prev", F.lag("_us").over(w))
           .withColumn("_row", F.row_number().over(w))
           .withColumn("_frag", F.sum(F.when(_breaks(rule, F.col("_prev"), F.col("_us")), 1).otherwise(0)).over(
               w.rowsBetween(Window.unboundedPreceding, 0))))
    frags = pts.groupBy(*cell, "_frag").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"),
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_row0"), F.max(F.xxhash64(*df.columns)).alias("_all"),
        (F.max("_bad") if "_bad" in df.columns else F.lit(0)).alias("_bad"))
    return pts, frags


def _breaks(rule: GapRule, before: Column, at: Column) -> Column:
    """A new trace starts at ``at``. NULL (so no break) on an entity's first point."""
    cut = at - before > F.lit(rule.gap_us)
    if rule.chunk_us:
        def chunk(c: Column) -> Column:
            return F.floor((c - F.lit(rule.chunk_origin_us)) / F.lit(rule.chunk_us))
        cut = cut | (chunk(at) != chunk(before))
    return cut


def _link(frags: DataFrame, rule: GapRule) -> DataFrame:
    """Join fragments of one entity into numbered traces, by a segmented prefix scan in two levels.

    Within a block of tiles, breaks between fragments cut it into segments. A block's summary is its first and last time, its
    number of breaks, and its first and last segment; only these are ordered per entity. Segments in between are whole traces.
    """
    entity = rule.entity
    block = [entity, "_block"]
    by = Window.partitionBy(*block).orderBy("_tile", "_sub", "_frag")
    seg = Window.partitionBy(*block, "_seg")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    ones = lambda c: F.when(c, 1).otherwise(0)
    local = (frags.withColumn("_block", _never_null(F.floor(F.col("_tile") / LINK_TILES).cast("long")))
             .withColumn("_lag", F.lag("_last").over(by))
             .withColumn("_seg", F.sum(ones(_breaks(rule, F.col("_lag"), F.col("_first")))).over(upto(by)))
             .withColumn("_s", F.struct("_seg", F.min("_first").over(seg).alias("start"), F.max("_last").over(seg).alias("end"),
                                        F.sum("_n").over(seg).alias("n"), F.max("_bad").over(seg).alias("bad")))
             .withColumn("_s_before", F.sum("_n").over(upto(seg.orderBy("_tile", "_sub", "_frag"))) - F.col("_n")))
    blocks = local.groupBy(*block).agg(F.min("_first").alias("first"), F.max("_last").alias("last"), F.max("_seg").alias("k"),
                                       F.min("_s").alias("head"), F.max("_s").alias("tail"), F.max(F.struct("_all", "_row0")).alias("_any"))
    chain = Window.partitionBy(entity).orderBy("_block")
    blocks = (blocks.withColumn("_prev_last", F.lag("last").over(chain))
              .withColumn("base", F.sum(ones(_breaks(rule, F.col("_prev_last"), F.col("first"))) + F.col("k")).over(upto(chain)) - F.col("k")))
    # the first and the last segment of a block may go on in others; a block without a break is one segment
    pieces = blocks.select(*block, "_prev_last", "base", "k", "_any", F.explode(F.when(F.col("k") > 0, F.array("head", "tail")).otherwise(F.array("head"))).alias("p"))
    pieces = pieces.withColumn("no", F.col("base") + F.col("p._seg"))
    whole = Window.partitionBy(entity, "no")
    ends = pieces.select(*block, "_prev_last", "base", "k", "_any", F.col("p._seg").alias("at"), F.struct(
        F.min("p.start").over(whole).alias("start"), F.max("p.end").over(whole).alias("end"), F.sum("p.n").over(whole).alias("n"),
        F.max("p.bad").over(whole).alias("bad"), (F.sum("p.n").over(upto(whole.orderBy("_block"))) - F.col("p.n")).alias("before")).alias("t"))
    known = ends.groupBy(*block).agg(
        F.first("_prev_last").alias("_prev_last"), F.first("base").alias("base"), F.first("k").alias("k"), F.first("_any").alias("_any"),
        F.max(F.when(F.col("at") == 0, F.col("t"))).alias("head"), F.max(F.when(F.col("at") == F.col("k"), F.col("t"))).alias("tail"))
    both = local.join(known, block).filter(F.col("_any") >= F.struct("_all", "_row0"))  # always true, as in locate
    linked = both.withColumn("_t", F.when(F.col("_seg") == 0, F.col("head")).when(F.col("_seg") == F.col("k"), F.col("tail")))
    of = lambda name: F.coalesce(F.col(f"_t.{name}"), F.col(f"_s.{name}"))
    return linked.select(
        entity, "_tile", "_sub", "_frag", "_first", "_last", "_n", "_row0", "_all", F.coalesce("_lag", "_prev_last").alias("_last_before"),
        (F.col("base") + F.col("_seg")).alias("trace_no"), of("start").alias("start_us"), of("end").alias("end_us"), of("n").alias("point_count"),
        (F.coalesce("_t.before", F.lit(0)) + F.col("_s_before")).alias("_before"), of("bad").alias("_bad"))


def gap_flags(df: DataFrame, rule: GapRule) -> DataFrame:
    """Every point with the time since the previous point of its entity (NULL on the first) and its trace number."""
    out = locate(df, rule)
    return out.select(*df.columns, "diff_us", "trace_no", "pos")


def traces(df: DataFrame, rule: GapRule, min_duration_us: int = 0) -> DataFrame:
    """One row per trace: start, end, duration and point count. Only entity and time columns are read."""
    narrow, rule = df.select(rule.entity, rule.ts), replace(rule, tiebreak=())
    _, frags = _fragments(narrow, rule)
    linked = _link(frags, rule)
    return (linked.groupBy(rule.entity, "trace_no")
            .agg(F.min("_first").alias("start_us"), F.max("_last").alias("end_us"),
                 F.sum("_n").alias("point_count"))
            .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
            .filter(F.col("duration_us") >= F.lit(min_duration_us)))


def locate(df: DataFrame, rule: GapRule, min_duration_us: int = 0, min_points: int = 1,
           reject: Column | None = None) -> DataFrame:
    """Every point with its trace (number, start, end, point count), 0-based position and step from the previous one.

    Traces that are too short, or hold a point for which ``reject`` is true, are dropped at summary level, before
    their points are joined. Both sides of that join come from one shuffle of the points into cells, whose partitioning
    the join keeps. All columns of ``df`` are read, so give it those that are wanted. Input columns named like an added one
    are replaced.
    """
    marked = df if reject is None else df.withColumn("_bad", reject.cast("int"))
    pts, frags = _fragments(marked, rule)
    linked = _link(frags, rule).filter(
        (F.col("end_us") - F.col("start_us") >= F.lit(min_duration_us)) & (F.col("point_count") >= min_points))
    if reject is not None:
        linked = linked.filter(F.col("_bad") == 0)
    cell = [rule.entity, "_tile", "_sub"]
    # at most tile width / gap + 1 fragments per cell
    packed = linked.groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("_frag"), F.struct("trace_no", "start_us", "end_us", "point_count", "_before", "_row0",
                                 "_last_before", "_all")))).alias("_of"))
    # the frame column is looked up once and only rows of kept traces survive
    got = (pts.join(packed, cell)
           .withColumn("_t", F.try_element_at("_of", F.col("_frag")))
           .filter(F.col("_t._all") >= F.xxhash64(*marked.columns)))  # true of every row: see _fragments
    first_in_cell = F.col("_prev").isNull()
    diff = F.when(first_in_cell, F.col("_us") - F.col("_t._last_before")).otherwise(F.col("_us") - F.col("_prev"))
    made = ("us", "trace_no", "start_us", "end_us", "point_count", "pos", "diff_us")
    return got.select(
        *[c for c in df.columns if c not in made], F.col("_us").alias("us"),
        F.col("_t.trace_no").alias("trace_no"), F.col("_t.start_us").alias("start_us"),
        F.col("_t.end_us").alias("end_us"), F.col("_t.point_count").alias("point_count"),
        (F.col("_t._before") + F.col("_row") - F.col("_t._row0")).alias("pos"),
        diff.alias("diff_us"))


def trace_arrays(df: DataFrame, rule: GapRule, arrays: list[str], scalars: list[str] = (),
                 min_duration_us: int = 0, part_points: int = 200_000) -> DataFrame:
    """One row per trace with its values as time-ordered arrays; scalar columns come from the first point.

    A trace longer than ``part_points`` continues in further rows (``part`` 1, 2, ..), so no row or task ever holds
    an unbounded history and no point is lost. Ordinary traces have the single row ``part`` 0.
    """
    return pack_arrays(locate(df, rule, min_duration_us), rule, arrays, scalars, part_points)


def pack_arrays(located: DataFrame, rule: GapRule, arrays: list[str], scalars: list[str] = (), part_points: int = 200_000) -> DataFrame:
    """The array rows of ``trace_arrays`` from points that ``locate`` has placed."""
    pts = located.withColumn("part", F.floor(F.col("pos") / part_points).cast("long"))
    packed = pts.groupBy(rule.entity, "trace_no", "part").agg(
        F.first("start_us").alias("start_us"), F.first("end_us").alias("end_us"),
        F.first("point_count").alias("point_count"),
        F.array_sort(F.collect_list(F.struct("pos", "us", *arrays))).alias("_p"),
        *[F.min_by(s, "pos").alias(s) for s in scalars])
    return packed.select(
        rule.entity, "trace_no", "part", "start_us", "end_us", "point_count",
        (F.col("end_us") - F.col("start_us")).alias("duration_us"), *scalars,
        F.transform("_p", lambda p: p["us"] - F.col("start_us")).alias("time_offsets"),
        *[F.col(f"_p.{a}").alias(a) for a in arrays])
