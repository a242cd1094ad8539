"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a long bit string: on which side of the median it falls along random directions. A tree is the sorted
array of these strings, cut by leading bits into leaves; a leaf with too many vectors is dealt out by a second hash,
all parts of which are searched.

A query first descends to its own leaf in some trees and takes the nearest there. How often their bits after the common prefix
agree with its own tells how likely a neighbour as near as these shares a prefix of a given length. From that follows the
longest prefix at which a share ``recall`` of such neighbours is met in at least one of the trees. All trees then ascend
together to that length, and everything below it is compared exactly. A query that has met too few candidates ascends
further, at last to the roots. So the work follows the data: close neighbours are found under long prefixes, vectors
without any structure need short ones and with them many comparisons.

Copies of a vector are one entry with its smallest ids; nothing is capped: the ids kept are more than a result can hold.

Defined cases: vectors that are null, zero, hold null or non-finite components or differ in length from the most frequent
length take no part. A repeated id counts once; fewer candidates than asked for are all returned; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialise

BITS = 48
SAMPLE = 4096

FOUND = pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("distance", pa.float64()), ("agree", pa.int64()), ("seen", pa.int64())])


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (array<double>) of the vectors that take part."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
            .where("vec IS NOT NULL AND vec_id IS NOT NULL").where(finite & F.exists("vec", lambda x: x != 0)))
    common = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("vec") == (common.n if common else 0))


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors: entry, vec, ids (its ``keep`` smallest).

    Ranks are limited per task before the shuffle and within parts of a vector's ids after it, so copies, however many,
    never meet in one task.
    """
    part = F.pmod(F.xxhash64("vec_id"), F.lit(16))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vec", part).orderBy("vec_id"))).where(F.col("rank") <= 2 * keep)
    second = first.withColumn("rank", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("rank") <= 2 * keep)
    return second.groupBy("vec").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids")).withColumn("entry", F.monotonically_increasing_id())


class Forest:
    """Directions and medians of every bit, from a bounded sample."""

    def __init__(self, sample: np.ndarray, trees: int, seed: int = 11):
        dim = sample.shape[1]
        self.trees = trees
        self.directions = np.random.default_rng(seed).normal(size=(dim, trees * BITS))
        self.middle = np.median(sample @ self.directions, axis=0) if len(sample) else np.zeros(trees * BITS)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        side = (vectors @ self.directions > self.middle).reshape(len(vectors), self.trees, BITS)
        return side @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _codes(rows: DataFrame, forest, *keep: str) -> DataFrame:
    """``rows`` with their codes, an array of one long per tree."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vec = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                codes = pa.array(list(forest.value.codes(vec)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], codes], names=[*keep, "codes"])
    return rows.select(*dict.fromkeys([*keep, "vec"])).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", codes array<long>")


def _search(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by leaf, its vectors in the order of their codes before its queries."""
        leaf = None
        parts: list[tuple] = []
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, bucket, part, kind, entry, code, depth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "bucket", "part", "kind", "entry", "code", "depth"))
            vec = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out: list[list] = [[], [], [], [], []]
            change = np.flatnonzero((np.diff(tree) != 0) | (np.diff(bucket) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if leaf != (tree[a], bucket[a], part[a]):
                    leaf, parts, held = (tree[a], bucket[a], part[a]), [], None
                if kind[a] == 0:
                    parts.append((code[a:b], entry[a:b], vec[a:b]))
                    held = None
                elif parts:
                    held = held or tuple(np.concatenate(x) for x in zip(*parts))
                    for i in range(a, b):
                        _nearest(held, int(entry[i]), int(code[i]), int(depth[i]), vec[i], keep, out)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=FOUND)
    return run


def _nearest(held: tuple, query: int, code: int, depth: int, vec: np.ndarray, keep: int, out: list[list]) -> None:
    codes, entry, vectors = held
    low = code >> (BITS - depth) << (BITS - depth)
    a, b = np.searchsorted(codes, [low, low + (1 << (BITS - depth))])
    if a == b:
        return
    d = np.sqrt(((vectors[a:b] - vec) ** 2).sum(axis=1))
    best = np.argpartition(d, keep - 1)[:keep] if len(d) > keep else np.arange(len(d))
    differ = np.bitwise_count((codes[a:b][best] ^ code) & ((1 << (BITS - depth)) - 1)).astype(np.int64)
    out[0].append(np.full(len(best), query))
    out[1].append(entry[a:b][best])
    out[2].append(d[best])
    out[3].append(BITS - depth - differ)
    out[4].append(np.full(len(best), BITS - depth))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.95, trees: int = 32, first_trees: int = 8,
            leaf: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``is_query`` (over vec_id) holds.

    The medians are taken from at most ``SAMPLE`` vectors chosen by hash; every vector is indexed.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    keep = k + 1  # a query's own id is left out at the end
    found = materialise(entries(rows, keep))
    n = found.count()
    sample = found.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < math.ceil(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))).orderBy(F.xxhash64("vec")).select("vec").limit(SAMPLE)
    body = np.array([r.vec for r in sample.collect()])
    forest = spark.sparkContext.broadcast(Forest(body if len(body) else np.zeros((1, 1)), trees))
    bits = max(0, int(math.log2(max(n, 1) / leaf))) if n > leaf else 0

    prefix = F.shiftright("code", BITS - bits) if bits else F.lit(0).cast("long")
    coded = materialise(_codes(found, forest, "entry", "vec"))
    points = coded.select("entry", "vec", F.posexplode("codes").alias("tree", "code")).withColumn("bucket", prefix)
    parts = points.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n")).select("tree", "bucket", F.ceil(F.col("n") / (2 * leaf)).cast("int").alias("parts"))
    parts = materialise(parts)
    dealt = points.join(parts, ["tree", "bucket"]).select("tree", "bucket", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int").alias("part"),
                                                          F.lit(0).alias("kind"), "entry", "code", F.lit(0).alias("depth"), "vec")
    # queries that share a vector are searched once
    asked = materialise(rows.where(is_query).select("vec_id", "vec").distinct().join(found.select("vec", "entry"), "vec").select("vec_id", "entry"))
    asking = materialise(coded.join(asked.select("entry").distinct(), "entry", "left_semi"))

    def search(queries: DataFrame) -> DataFrame:
        """``queries``: entry, vec, tree, code, depth."""
        shift = F.lit(bits) - F.least(F.col("depth"), F.lit(bits))
        base = F.shiftright("code", BITS - bits) if bits else F.lit(0).cast("long")
        step = F.pow(F.lit(2.0), shift).cast("long")
        low = F.floor(base / step) * step
        visits = (queries.withColumn("bucket", F.explode(F.sequence(low, low + step - 1))).join(parts, ["tree", "bucket"])
                  .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                  .select("tree", "bucket", "part", F.lit(1).alias("kind"), "entry", "code", "depth", "vec"))
        hits = (dealt.union(visits).repartition("tree", "bucket", "part").sortWithinPartitions("tree", "bucket", "part", "kind", "code", "entry")
                .mapInArrow(_search(keep), "query long, entry long, distance double, agree long, seen long"))
        return hits.groupBy("query", "entry").agg(F.min("distance").alias("distance"), F.sum("agree").alias("agree"), F.sum("seen").alias("seen"))

    ranked = lambda h: h.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "entry"))).where(F.col("rank") <= keep)
    spread = asking.select("entry", "vec", F.posexplode("codes").alias("tree", "code"))
    first = ranked(search(spread.where(F.col("tree") < first_trees).withColumn("depth", F.lit(bits))))
    # bits agree with probability p; a prefix of d bits in one of the trees with 1 - (1 - p^d)^trees
    p = F.least(F.lit(0.999999), F.greatest(F.lit(1e-6), (F.sum(F.when(F.col("distance") > 0, F.col("agree"))) / F.sum(F.when(F.col("distance") > 0, F.col("seen"))))))
    miss = math.log(1 - (1 - recall) ** (1 / trees))
    depth = F.least(F.lit(BITS), F.floor(F.lit(miss) / F.log(p))).cast("int")
    depths = first.groupBy("query").agg(F.coalesce(depth, F.lit(0)).alias("depth"))
    wanted = materialise(asking.select(F.col("entry").alias("query")).join(depths, "query", "left").select("query", F.coalesce("depth", F.lit(0)).alias("depth")))
    best = None
    while True:
        more = materialise(ranked(search(spread.join(wanted.withColumnRenamed("query", "entry"), "entry"))).select("query", "entry", "distance"))
        full = more.groupBy("query").agg(F.count(F.lit(1)).alias("got")).where(F.col("got") >= min(keep, n)).select("query")
        best = more.join(full, "query", "left_semi") if best is None else best.union(more.join(full, "query", "left_semi"))
        wanted = materialise(wanted.join(full, "query", "left_anti").where("depth > 0").withColumn("depth", F.floor(F.col("depth") / 2).cast("int")))
        if wanted.isEmpty():
            break  # at depth 0 everything has been compared

    named = best.join(found.select("entry", F.explode("ids").alias("vec_id")), "entry")
    listed = named.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))).where(F.col("rank") <= keep)
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).join(listed.select("query", "vec_id", "distance"), "query").where("vec_id <> query_id")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return answers.withColumn("rank", final).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("distance").alias("score"))
