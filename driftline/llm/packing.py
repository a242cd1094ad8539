"""Packing by lexical retrieval: each training window is filled with the documents most like its seed.

1. Documents are tokenised. Stretches of a full window stand alone; what is left of each document, less than a window, is a
   piece to be packed.
2. Pieces with common passages share a locality key (a min-hash of token pairs). They are sorted by it over the cluster
   and every task cuts its range into shards of at most ``shard`` pieces, so copies of one text spread over many shards.
3. A shard has a BM25 inverted index with document frequencies of the whole corpus. A seed, the next unused piece,
   asks it with its rarest terms; the unused pieces found fill the window in order of score. When none fits whole, the best is
   cut to fill the window exactly and its rest stays in the pool. A window the pool cannot fill passes to the next shard.
   At the end of a task the last window is cut into powers of two, so no sequence is padded.

Defined cases: a null text is empty and becomes one piece that holds the end id. Repeated rows are packed each by itself.
Ties in score go to the earlier piece in the sorted order. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import record_batch, text_batches, texts, tidy
from driftline.llm.words import WordEndBpe, WordTokens, kept
from driftline.session import materialise

END_ID = 1
K1, B = 1.2, 0.75
QUERY_TERMS = 24

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])
PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def stored(vocabulary_size: int) -> str:
    """How ids are written between the steps: in two bytes where they fit."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def place_of(ids: np.ndarray) -> int:
    """Least hash of two neighbouring ids: texts with much in common often share it."""
    x = ids.astype(np.uint64) + np.uint64(1)
    h = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F) if len(x) > 1 else x
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return int(h.min() >> np.uint64(1))


def tokenise(docs: DataFrame, vocabulary_path: str, window: int) -> DataFrame:
    """Pieces of documents: full windows without their ids, since nothing is left to decide, and rests with them."""
    with open(vocabulary_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            bpe = WordEndBpe(model.value)
            return bpe, WordTokens(bpe.ids_of)
        bpe, known = kept(("packing", zlib.crc32(model.value.encode())), make)
        for ids, bodies in text_batches(batches, "doc_id", "text"):
            rows = []
            for doc_id, numbers in zip(ids, known.numbered([bpe.split(t) for t in bodies])):
                t = np.append(known.tokens(numbers), np.uint32(END_ID))
                n = len(t)
                for a in range(0, n - window + 1, window):
                    rows.append((doc_id, a, window, crc(t[a:a + window]), n, place_of(t[a:a + window]), None))
                if n % window:
                    rest = t[n - n % window:]
                    rows.append((doc_id, n - n % window, len(rest), None, n, place_of(rest), rest.astype(stored(len(bpe.is_end))).tobytes()))
            yield record_batch(PIECES, list(map(list, zip(*rows))))
    return texts(docs).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long, ids binary")


def corpus_statistics(pieces: DataFrame, kind: str) -> tuple[np.ndarray, int, float]:
    """Document frequencies per id over all pieces, their number and mean length. One row per id at most: a vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        n = size = 0
        for batch in batches:
            bodies = batch.column("ids").to_pylist()
            for a in range(0, len(bodies), 1024):
                ids = np.frombuffer(b"".join(bodies[a:a + 1024]), kind)
                lengths = [len(x) // ids.itemsize for x in bodies[a:a + 1024]]
                key = ids.astype(np.uint64) | np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) << np.uint64(32)
                key.sort()
                seen = np.bincount((key[np.append(True, key[1:] != key[:-1])] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(df))
                df = seen + np.append(df, np.zeros(len(seen) - len(df), np.int64))
                n, size = n + len(lengths), size + len(ids)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, size]))], names=["id", "n"])
    rows = pieces.where("ids IS NOT NULL").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n, size = (int(rows.n[rows.id == k].sum()) for k in (-1, -2))
    real = rows[rows.id >= 0]
    df = np.zeros(int(real.id.max()) + 1 if len(real) else 1, np.int64)
    df[real.id.to_numpy()] = real.n.to_numpy()
    return df, n, size / max(n, 1)


class Shard:
    """Unused pieces under a BM25 inverted index."""

    def __init__(self, pieces: list[tuple], idf: np.ndarray, mean: float):
        self.pieces = pieces  # [doc_id, start, ids, doc_tokens]
        self.unused = np.ones(len(pieces), bool)
        self.next = 0
        lengths = np.array([len(p[2]) for p in pieces])
        key = np.concatenate([p[2] for p in pieces]).astype(np.int64) | np.repeat(np.arange(len(pieces)), lengths) << 32
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(first, len(key)))
        doc, term = key[first] >> 32, key[first] & 0xFFFFFFFF
        score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(mean, 1e-9)))
        self.bounds = np.searchsorted(doc, np.arange(len(pieces) + 1))
        self.terms, self.idf = term, idf
        by_term = np.argsort(term, kind="stable")
        self.doc, self.score = doc[by_term], score[by_term]
        self.term, at = np.unique(term[by_term], return_index=True)
        self.at = np.append(at, len(term))

    def seed(self) -> int | None:
        while self.next < len(self.unused) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.unused) else None

    def neighbours(self, i: int) -> np.ndarray:
        """Unused pieces that share one of the rarest terms of piece i, best first."""
        own = self.terms[self.bounds[i]:self.bounds[i + 1]]
        if len(own) > QUERY_TERMS:
            own = own[np.argpartition(-self.idf[own], QUERY_TERMS)[:QUERY_TERMS]]
        k = np.searchsorted(self.term, own)
        parts = [slice(self.at[j], self.at[j + 1]) for j in k]
        total = np.bincount(np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.score[p] for p in parts]), len(self.unused))
        found = np.flatnonzero((total > 0) & self.unused)
        return found[np.argsort(-total[found], kind="stable")]


def fill(shard: Shard, window: int) -> Iterator[tuple[list[tuple], int]]:
    """Windows as lists of (doc_id, start, ids, doc_tokens) with their size; only the last can be short."""
    while (i := shard.seed()) is not None:
        shard.unused[i] = False
        filled, room = [shard.pieces[i]], window - len(shard.pieces[i][2])
        if room > 0:
            near = shard.neighbours(i)
            cut = None
            for j in near[:256]:
                n = len(shard.pieces[j][2])
                if n <= room:
                    shard.unused[j] = False
                    filled.append(shard.pieces[j])
                    room -= n
                    if room == 0:
                        break
                elif cut is None:
                    cut = j
            while room > 0:  # fill up: the best neighbour that did not fit, else the next unused piece, whole or cut
                j = cut if cut is not None else shard.seed()
                cut = None
                if j is None:
                    break
                doc_id, start, ids, size = shard.pieces[j]
                filled.append((doc_id, start, ids[:room], size))
                if len(ids) <= room:
                    shard.unused[j] = False
                else:
                    shard.pieces[j] = (doc_id, start + room, ids[room:], size)
                room -= min(room, len(ids))
        yield filled, window - room


def powers(filled: list[tuple], size: int) -> Iterator[list[tuple]]:
    """A short window as sequences whose lengths are powers of two."""
    rest = list(filled)
    while size:
        room = 1 << (size.bit_length() - 1)
        size -= room
        out = []
        while room:
            doc_id, start, ids, total = rest.pop(0)
            out.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                rest.insert(0, (doc_id, start + room, ids[room:], total))
            room -= min(room, len(ids))
        yield out


def pack(docs: DataFrame, vocabulary_path: str, window: int = 2048, shard: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The corpus is tokenised once; the rests of documents go through one range shuffle. A task holds one shard at a time,
    at most ``shard * window`` ids.
    """
    pieces = materialise(tokenise(docs, vocabulary_path, window))
    with open(vocabulary_path, encoding="utf-8") as f:
        kind = stored(len(WordEndBpe(f.read()).is_end))
    df, n, mean = corpus_statistics(pieces, kind)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    placed = pieces.withColumn("salt", F.xxhash64("doc_id", "start"))
    order = ["place", "salt", "doc_id", "start", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def add(filled):
            nonlocal number
            at = 0
            for doc_id, start, ids, total in filled:
                rows.append((doc_id, start, len(ids), crc(ids), total, number, at))
                at += len(ids)
            number += 1

        def flush():
            out = record_batch(PACKED, list(map(list, zip(*rows)))) if rows else None
            rows.clear()
            return out

        pool: list[tuple] = []
        short: list[tuple] = []

        def work():
            nonlocal pool, short
            full = Shard(short + pool, shared.value, mean) if short or pool else None
            pool, short = [], []
            for filled, size in fill(full, window) if full else ():
                if size == window:
                    add(filled)
                else:
                    short = filled
        for batch in batches:
            for doc_id, start, length, check, total, ids in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")]):
                if ids is None:
                    rows.append((doc_id, start, length, check, total, number, 0))
                    number += 1
                else:
                    pool.append((doc_id, start, np.frombuffer(ids, kind), total))
                    if len(pool) >= shard:
                        work()
            if rows:
                yield flush()
        work()
        for filled in powers(short, sum(len(p[2]) for p in short)):
            add(filled)
        if rows:
            yield flush()
        tidy()

    return (placed.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).drop("place", "salt")
            .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
