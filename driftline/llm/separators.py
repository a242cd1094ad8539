"""Token counts by separator scan: document lengths in flat token streams that have no index.

A stream is read in blocks that cut documents anywhere. In each block the places of the end-of-document id are found by one
vectorised comparison. What a block cannot know, where its first document began and how many documents ended before,
follows from a prefix scan over block summaries: running sums of ids and separators, running maximum of the last
separator's place. The scan has two levels, inside groups of ``GROUP`` blocks and over groups, so a stream of any length is
never ordered in one task.

Defined cases: two separators in a row are an empty document of 0 ids; ids after the last separator form a last document
with ``closed`` false; an empty stream or table gives no row. Null texts are empty documents; repeated rows stay repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import small_batches, text_batches, texts, tidy
from driftline.llm.words import WordEndBpe, WordTokens, kept
from driftline.session import materialise

BLOCK_IDS = 1 << 19
GROUP = 4096
STREAM = "stream string, block long, ids binary, docs array<long>"


def _block(stream: str, block: int, ids: np.ndarray, docs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([docs], pa.list_(pa.int64()))],
                                      names=["stream", "block", "ids", "docs"])


def write_stream(docs: DataFrame, vocabulary_path: str, separator: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenised documents as flat streams of two-byte ids, one a task: stream, block, ids, and for comparison only the
    doc_id of every document that ends in the block."""
    with open(vocabulary_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            bpe = WordEndBpe(model.value)
            return bpe, WordTokens(bpe.ids_of)
        bpe, known = kept(("packing", zlib.crc32(model.value.encode())), make)
        name, block = f"part-{TaskContext.get().partitionId():05d}", 0
        held: list[np.ndarray] = []
        size, ended = 0, []  # ended: (place after which it ends, doc_id)
        for ids, bodies in text_batches(batches, "doc_id", "text"):
            for doc_id, numbers in zip(ids, known.numbered([bpe.split(t) for t in bodies])):
                t = np.append(known.tokens(numbers), np.uint32(separator)).astype("<u2")
                held.append(t)
                size += len(t)
                ended.append((size - 1, doc_id))
                while size >= block_ids:
                    flat = np.concatenate(held)
                    here = [d for at, d in ended if at < block_ids]
                    yield _block(name, block, flat[:block_ids], here)
                    held, size, block = [flat[block_ids:]], size - block_ids, block + 1
                    ended = [(at - block_ids, d) for at, d in ended[len(here):]]
        if size:
            yield _block(name, block, np.concatenate(held), [d for _, d in ended])
        tidy()
    return texts(docs).mapInArrow(run, STREAM)


def read_token_files(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, width: int = 2) -> DataFrame:
    """Flat token files as blocks. Spark's binary source hands a task one file at a time, of at most 2 GB."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                flat = np.frombuffer(body, f"<u{width}")
                for k, a in enumerate(range(0, len(flat), block_ids)):
                    yield _block(name, k, flat[a:a + block_ids], [])
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, STREAM)


def separator_scan(blocks: DataFrame, separator: int, width: int = 2, group: int = GROUP) -> DataFrame:
    """stream, ordinal (from 0), start, n_tokens (without the separator), closed, doc_id (null unless the blocks carry it)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, f"<u{width}") for x in batch.column("ids").to_pylist()]
            at = [np.flatnonzero(x == separator) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()), pa.array(at, pa.list_(pa.int64())), batch.column("docs")],
                                             names=["stream", "block", "n", "at", "docs"])
        tidy()
    small_batches(blocks.sparkSession)
    found = materialise(blocks.mapInArrow(find, "stream string, block long, n long, at array<long>, docs array<long>")
                        .withColumn("part", F.floor(F.col("block") / group)))
    inside = Window.partitionBy("stream", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # sums and last separators inside a group of blocks, places relative to the group
    seps = F.size("at").cast("long")
    local = (found.withColumn("n0", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("s0", F.coalesce(F.sum(seps).over(inside), F.lit(0)))
             .withColumn("last", F.when(seps > 0, F.col("n0") + F.element_at("at", -1))).withColumn("l0", F.max("last").over(inside)))
    groups = local.groupBy("stream", "part").agg(F.sum("n").alias("gn"), F.sum(seps).alias("gs"), F.max("last").alias("gl"))
    groups = (groups.withColumn("gn0", F.coalesce(F.sum("gn").over(over), F.lit(0))).withColumn("gs0", F.coalesce(F.sum("gs").over(over), F.lit(0)))
              .withColumn("gl0", F.coalesce(F.max(F.col("gn0") + F.col("gl")).over(over), F.lit(-1))))
    whole = local.join(groups.select("stream", "part", "gn0", "gs0", "gl0"), ["stream", "part"])
    base = F.col("gn0") + F.col("n0")
    carry = F.coalesce(F.col("gn0") + F.col("l0"), F.col("gl0"))  # the last separator before this block
    docs = whole.select("stream", (F.col("gs0") + F.col("s0")).alias("s"), base.alias("base"), carry.alias("carry"), "at", "docs", F.posexplode("at").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("carry") + 1).otherwise(F.col("base") + F.get("at", F.col("i") - 1) + 1)
    closed = docs.select("stream", (F.col("s") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"),
                         F.lit(True).alias("closed"), F.get("docs", F.col("i")).alias("doc_id"))
    ends = groups.groupBy("stream").agg(F.sum("gn").alias("n"), F.sum("gs").alias("s"), F.max(F.coalesce(F.col("gn0") + F.col("gl"), F.lit(-1))).alias("l"))
    rest = ends.where("n > l + 1").select("stream", F.col("s").alias("ordinal"), (F.col("l") + 1).alias("start"), (F.col("n") - F.col("l") - 1).alias("n_tokens"),
                                          F.lit(False).alias("closed"), F.lit(None).cast("long").alias("doc_id"))
    return closed.union(rest)
