"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's size is its number of words. Sources share the sum of all sizes by weight; a target stops at ``cap`` times its
source's size and the excess is shared again by weight. A source gives whole epochs of all its documents while its target allows;
the rest of the target is filled in the order of exponential keys -ln(u) / weight, where u comes from a hash of the id and
the weight is the document's quality: its words over its words and symbols. Sizes are summed along that order up to the
budget, and the document at the boundary gives only the words still missing.

Keys are binned by a monotone function, so a running sum is one over bin totals and one inside a (source, bin) group:
no source, however large, is ordered in one task. A source has the square root of its documents in bins; their number
never changes a result.

Defined cases: a null text has size 0 and takes 0. A null source is a source of its own, after all others. Rows with equal keys
are ordered by id and size, so repeated rows share what is taken in one defined way. Without words every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.ordering import dense_index
from driftline.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
BIN_SHARE = 1.0  # bins of a source, in square roots of its documents: as many bins as rows in each


def uniform(seed: str, doc_id: Column) -> Column:
    """In (0, 1), from 52 bits of md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """One row per source: source, source_size, weight, target. Only sums of the whole come to the driver."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = dense_index(by_source.withColumn("no_source", F.col("source").isNull()), ["no_source", "source"], "rank").drop("no_source")
    sources = materialise(ranked.withColumn("weight", F.element_at(F.lit(weights), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = cap * F.col("source_size")
    level = 0.0
    while total:  # the level only rises; each round stops further sources at their limit
        capped = F.col("weight") * F.lit(level) > limit
        row = sources.agg(F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)).alias("given"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        higher = (total - row.given) / row.open
        if higher <= level:
            break
        level = higher
    share = F.col("weight") * F.lit(level)
    return sources.select("source", "source_size", "docs", F.when(share > limit, limit.cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", whole: bool = False,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), and columns to ``carry``.

    With ``whole`` the boundary document is taken whole if at least half of it fits the budget, else not at all.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words, symbols = F.regexp_count(body, F.lit(WORD)).cast("long"), F.regexp_count(body, F.lit(SYMBOL)).cast("long")
    sized = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), symbols.alias("symbols"), *carry))
    quality = (F.col("size") + 1).cast("double") / (F.col("size") + F.col("symbols") + 1).cast("double")
    sized = materialise(sized.select("doc_id", "source", "size", (-F.log(uniform(seed, F.col("doc_id"))) / quality).alias("key"), *carry))
    goals = targets(sized, list(weights), cap)

    bins = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("docs").cast("double")) * BIN_SHARE))
    placed = (sized.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
              .join(goals.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit(""))), ["no_source", "source"])
              .withColumn("bin", F.least(bins - 1, F.floor(bins * (1 - F.exp(-F.col("key")))))))
    group = ["no_source", "source", "bin"]
    totals = placed.groupBy(*group).agg(F.sum("size").alias("bin_size"))
    before = totals.select(*group, (F.sum("bin_size").over(Window.partitionBy("no_source", "source").orderBy("bin")) - F.col("bin_size")).alias("earlier"))
    inside = Window.partitionBy(*group).orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("running", F.sum("size").over(inside)).join(before, group)

    size, goal = F.col("size"), F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    budget = goal - epochs * F.col("source_size")
    room = budget - (F.col("earlier") + F.col("running") - size)  # what the budget still holds when this document comes
    part = F.when(2 * room >= size, size).otherwise(0) if whole else F.least(size, room)
    taken = epochs * size + F.when(room > 0, part).otherwise(0)
    return summed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document whole, as many times as taken, with the columns it came with.

    Documents are told apart by a row number written beside them, so repeated ids stay repeated rows.
    """
    # the document travels as one column, so that its own columns may have any names
    numbered = materialise(docs.select(F.struct("*").alias("doc")).withColumn("row", F.monotonically_increasing_id()))
    plain = numbered.select("doc.doc_id", "doc.source", "doc.text", "row")
    times = mix(plain, whole=True, carry=("row",), **options).where("size > 0").select("row", (F.col("taken") / F.col("size")).cast("int").alias("n")).where("n > 0")
    return numbered.join(times, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")


def mix_sql(table: str = "documents", seed: str = "mix") -> str:
    """DuckDB SQL for ``mix`` with weights 1, 2, 3 and a cap of 3."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS symbols FROM {table}),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / ((size + 1)::DOUBLE / (size + symbols + 1)::DOUBLE) AS k FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM keyed GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY 3 * source_size / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, CASE WHEN w * level > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE w * level END AS target
  FROM (SELECT source, source_size, w, (SELECT max(level) FROM levels l WHERE l.w * l.level <= 3 * l.source_size) AS level FROM sources)),
summed AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS goal,
         CASE WHEN g.source_size > 0 THEN floor(g.target + 0.5)::BIGINT // g.source_size ELSE 0 END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS earlier
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, goal - epochs * source_size - earlier)))::BIGINT AS taken FROM summed"""
