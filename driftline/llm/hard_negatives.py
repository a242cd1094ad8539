"""Hard-negative mining by a vertical scan with branch and bound (BOND).

Components become whole numbers, and a score is an inner product, so every bound and score is exact. Rows lie in blocks by a
hash of their id, one column of numbers a dimension, ordered by label and id. An anchor reads a block's dimensions in the
order of its own largest components. What the dimensions not read yet can still add lies between sums of their least and
greatest contributions in the block, and is at most the length of the anchor's rest times that of the row; candidates that
these bounds exclude leave before the next dimensions are read:

* positives: the upper bound lies below the k-th best score met so far;
* negatives: the score cannot fall into any window ``[low, high] * positive score``, or only below the ``keep``-th best score
  met so far inside it. What is left after all dimensions resolves the windows exactly.

The first dimensions, of which no cut is worth its cost, are read for many anchors by one matrix product; the others only
for the candidates left.

Distribution: the stated anchors, in groups, meet every block once. Groups are dealt into shares and blocks into stacks; a task
holds a share and reads a stack block by block, so what moves is anchors times stacks and rows times shares, and nothing of it
is broadcast. A task yields at most ``positives`` rows an anchor, then ``keep`` rows a window, of which the global best are
taken by a ranked limit before the shuffle. The work is anchors times rows, as the task states it; nothing is sampled.
Blocks and groups are bounded by hashing ids, whatever the labels or copies of vectors. Blocks, groups and positives are
written out, so that lost tasks repeat only themselves.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; nor do vectors of
another than the most frequent length (ties: the smaller), or with a scaled component of 2^24 or more in size, whose scores
would not fit a long. A repeated id counts once, with its smallest label, then smallest vector. An anchor without a
positive, or a positive without a negative in its window, gives no row. Ties go to the smaller id. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import small_batches, tidy
from driftline.session import materialise

SCALE = 256
LARGEST = 1 << 24
BLOCK_ROWS = 8192
GROUP_ANCHORS = 512
STEP = 8  # dimensions read between two cuts of the bitmap
FIRST_ROWS = 512  # of a block, met before the others where nothing is known
PAIRS = 1 << 19  # anchors times columns begun together
NONE = 1 - (1 << 63)
ROUNDED = 1 + 1e-6  # more than lengths lose in floats
ROOM = 1 << 13  # more than a long loses in a double, thrice
TASKS_A_CORE = 4
SHARE_NUMBERS = 1 << 22  # components of the anchors that a task holds
STACK_NUMBERS = 1 << 24  # components of the blocks that a task reads

PACKED = "ids binary, labels binary, numbers binary, windows binary"
PACKED_ARROW = [("ids", pa.binary()), ("labels", pa.binary()), ("numbers", pa.binary()), ("windows", pa.binary())]


def whole_vectors(vectors: DataFrame, anchor: Column, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, q (array<int>) and anchor of the rows that take part, one an id."""
    scaled = F.transform("vec", lambda x: F.lit(SCALE) * x)
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST // SCALE))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(F.coalesce(usable, F.lit(False))))
    common = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    whole = rows.where(F.size("vec") == (common.n if common else 0)).select(
        "vec_id", F.struct("label", F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("q"), "anchor").alias("row"))
    return whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.q", "row.anchor")


def packed(rows: DataFrame, name: str, n: int, by_column: bool) -> DataFrame:
    """``rows`` (vec_id, label, q and maybe windows) dealt by a hash of the id into ``n`` parts of one row each."""
    schema = pa.schema([(name, pa.int64()), *PACKED_ARROW])
    has_windows = "windows" in rows.columns

    def pack(part: pa.Table) -> pa.Table:
        ids = part.column("vec_id").to_numpy()
        labels = part.column("label").to_numpy()
        q = part.column("q").combine_chunks()
        numbers = np.asarray(q.flatten()).reshape(len(ids), -1).astype(np.int32)
        order = np.lexsort((ids, labels))
        numbers = numbers[order]
        windows = b""
        if has_windows:  # as many as the most an anchor has, filled up with windows that nothing meets
            lists = [part.column("windows")[int(i)].as_py() for i in order]
            windows = np.array([w + [-1] * (max(map(len, lists)) - len(w)) for w in lists], np.int64).tobytes()
        number = part.column(name)[0].as_py()
        tidy()
        return pa.table([[number], [ids[order].tobytes()], [labels[order].tobytes()],
                         [np.ascontiguousarray(numbers.T if by_column else numbers).tobytes()], [windows]], schema=schema)

    keyed = rows.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(n)))
    return keyed.groupBy(name).applyInArrow(pack, f"{name} long, {PACKED}")


class Block:
    """Rows of a block as columns of numbers, with the least and greatest number of each dimension and a little more than the
    length of each row."""

    def __init__(self, ids: bytes, labels: bytes, numbers: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.wide = np.frombuffer(numbers, np.int32).reshape(-1, len(self.ids))
        self.largest = int(np.abs(self.wide).max(initial=0))
        self.least, self.most = self.wide.min(axis=1), self.wide.max(axis=1)
        self.kept: dict[type, tuple] = {}

    def columns(self, largest: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Numbers and lengths in floats or doubles as long as scores with components up to ``largest`` are exact in them, else
        longs without lengths."""
        most = self.largest * largest * max(1, len(self.wide))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        if kind not in self.kept:
            numbers = self.wide.astype(kind)
            lengths = None if kind is np.int64 else (np.sqrt((self.wide.astype(np.float64) ** 2).sum(axis=0)) * ROUNDED + 2).astype(kind)
            self.kept[kind] = numbers, lengths
        return self.kept[kind]


class Anchors:
    """Anchors of a group as rows of numbers, with the order of each one's components, largest first, and a little more than the
    length of what is left after the first of them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(-np.abs(vectors.astype(np.int64)), axis=1, kind="stable").astype(np.int32)
        squares = np.take_along_axis(vectors, self.order, 1).astype(np.float64) ** 2
        self.rest = (np.sqrt(from_here_on(squares)) * ROUNDED).astype(np.float32)

    def some(self, begin: int, end: int) -> Anchors:
        part = object.__new__(Anchors)
        part.vectors, part.order, part.rest = self.vectors[begin:end], self.order[begin:end], self.rest[begin:end]
        return part


def from_here_on(x: np.ndarray) -> np.ndarray:
    """Per row the sum from each position to the end, and 0 behind it."""
    return np.pad(np.cumsum(x[:, ::-1], axis=1)[:, ::-1], ((0, 0), (0, 1)))


class Scan:
    """Anchors over some columns of a block: partial scores of the candidates left, cut after every few dimensions. Of candidate i
    ``which[i]`` is the anchor and ``at[i]`` the column."""

    def __init__(self, block: Block, anchors: Anchors | np.ndarray, begin: int, end: int):
        self.anchors = anchors if isinstance(anchors, Anchors) else Anchors(np.atleast_2d(anchors))
        self.block, self.begin, self.end = block, begin, end
        self.numbers, self.lengths = block.columns(int(np.abs(self.anchors.vectors).max(initial=0)))
        kind, order = self.numbers.dtype.type, self.anchors.order
        vectors = np.take_along_axis(self.anchors.vectors, order, 1).astype(kind)
        ends = vectors * block.least[order].astype(kind), vectors * block.most[order].astype(kind)
        self.can_lose, self.can_gain = from_here_on(np.minimum(*ends)), from_here_on(np.maximum(*ends))
        # nothing is read behind the last dimension
        self.sorted, self.order = np.pad(vectors, ((0, 0), (0, STEP))), np.pad(order, ((0, 0), (0, STEP)))
        self.read = 0

    def first_cut(self, floor: np.ndarray) -> np.ndarray:
        """How many dimensions each anchor reads before its first cut: fewer would leave many candidates open."""
        rest = self.can_gain
        if self.lengths is not None:
            rest = np.minimum(rest, self.anchors.rest * self.lengths[self.begin])
        dims = rest.shape[1] - 1
        cuts = np.r_[np.arange(STEP, dims, STEP), dims]
        pays = rest[:, cuts] <= 0.3 * floor[:, None]
        pays[:, -1] = True
        return cuts[pays.argmax(axis=1)]

    def start(self, done: np.ndarray, floor: np.ndarray | None) -> np.ndarray:
        """Read the first ``done`` dimensions of each anchor for all columns by one matrix product, and cut below ``floor``."""
        size, dims = self.anchors.vectors.shape
        kind = self.numbers.dtype.type
        first = np.zeros((size, dims), kind)
        np.put_along_axis(first, self.anchors.order, np.where(np.arange(dims) < done[:, None], self.sorted[:, :dims], 0), 1)
        partial = first @ self.numbers[:, self.begin:self.end]
        self.read += int(done.sum()) * (self.end - self.begin)
        if floor is None:
            left = np.arange(partial.size)
        else:
            each = np.arange(size)
            gain, high = self.can_gain[each, done], partial
            if self.lengths is not None:
                rest = self.anchors.rest[each, done].astype(kind)
                nearer = rest * self.lengths[self.begin:self.end].max() < gain
                high = np.multiply.outer(np.where(nearer, rest, 0).astype(kind), self.lengths[self.begin:self.end])
                high += partial
                gain = np.where(nearer, 0, gain)
            least = (floor - gain).astype(kind) if self.lengths is not None else floor - gain.astype(np.float64) - ROOM
            left = np.flatnonzero(high >= least[:, None])
        self.which, self.at = np.divmod(left, self.end - self.begin)
        self.at += self.begin
        return partial.ravel()[left]

    def run(self, keep, floor: np.ndarray | None = None, first: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the candidates that ``keep(least scores, greatest scores)`` never excluded. ``floor`` has a score for
        each anchor below which it excludes all; without it, ``first`` dimensions are read before the first cut."""
        size, dims = self.anchors.vectors.shape
        kind = self.numbers.dtype.type
        done = np.full(size, min(first, dims)) if floor is None else self.first_cut(floor)
        partial = self.start(done, floor) if self.end > self.begin else np.zeros(0, kind)
        if self.end == self.begin:
            self.which, self.at = np.zeros((2, 0), np.int64)
        done = done[self.which]
        while len(partial):
            low, high = partial + self.can_lose[self.which, done], partial + self.can_gain[self.which, done]
            if self.lengths is not None:  # what is left of a row is no longer than the row
                reach = self.anchors.rest[self.which, done].astype(kind) * self.lengths[self.at]
                low, high = np.maximum(low, partial - reach), np.minimum(high, partial + reach)
            stays = keep(low, high)
            if not stays.all():
                self.which, self.at, partial, done = self.which[stays], self.at[stays], partial[stays], done[stays]
            if not len(done) or done.min() == dims:
                break
            some = done[:, None] + np.arange(STEP)
            some[done == dims] = dims
            numbers = self.numbers[self.order[self.which[:, None], some], self.at[:, None]]
            partial = partial + (self.sorted[self.which[:, None], some] * numbers).sum(axis=1, dtype=kind)
            self.read += numbers.size
            done = np.minimum(done + STEP, dims)
        return self.block.ids[self.at], partial.astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the ``k`` best, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(ids[order].tolist(), scores[order].tolist()))


class Best:
    """The ``k`` best (id, score) of each of ``size`` keys, best first, ties to the smaller id; places not filled have score NONE."""

    def __init__(self, size: int, k: int):
        self.ids, self.scores = np.zeros((size, k), np.int64), np.full((size, k), NONE)

    def add(self, key: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(key):
            return
        k, touched = self.ids.shape[1], np.unique(key)
        key = np.r_[np.repeat(touched, k), key]
        ids, scores = np.r_[self.ids[touched].ravel(), ids], np.r_[self.scores[touched].ravel(), scores]
        order = np.lexsort((ids, -scores, key))
        start = np.searchsorted(key[order], touched)
        order = order[start[:, None] + np.arange(k)]  # each key brings k places of its own
        self.ids[touched], self.scores[touched] = ids[order], scores[order]


class Group:
    """Anchors of a group that meet block after block: ``found`` holds the best of what they met, for each anchor a fixed number
    of keys; ``scores`` has the positive score that each key stands for."""

    def __init__(self, ids: bytes, labels: bytes, numbers: bytes, windows: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.anchors = Anchors(np.frombuffer(numbers, np.int32).reshape(len(self.ids), -1))
        self.scores = np.frombuffer(windows, np.int64).reshape(len(self.ids), -1)
        self.found: Best | None = None
        self.windows: tuple = ()

    def batches(self, begin: int, end: int, columns: int) -> Iterator[tuple[int, int]]:
        step = max(1, PAIRS // max(1, columns))
        return ((i, min(i + step, end)) for i in range(begin, end, step))


def in_parts(begin: int, end: int, known: bool) -> list[tuple[int, int]]:
    """Where nothing is known yet, a few columns come first, so that the others meet a floor."""
    cut = end if known else min(end, begin + FIRST_ROWS)
    return [(a, b) for a, b in ((begin, cut), (cut, end)) if a < b]


def best_positives(group: Group, block: Block, k: int) -> None:
    """The block's rows of an anchor's label, other than itself, join its ``k`` best."""
    if group.found is None:
        group.found, group.scores = Best(len(group.ids), k), np.zeros((len(group.ids), 1), np.int64)
    known, dims = group.found, group.anchors.vectors.shape[1]
    labels, starts = np.unique(group.labels, return_index=True)
    for label, start, stop in zip(labels, starts.tolist(), [*starts[1:].tolist(), len(group.ids)]):
        begin, end = np.searchsorted(block.labels, [label, label + 1]).tolist()
        for i, j in group.batches(start, stop, end - begin):
            for a, b in in_parts(begin, end, known.scores[i:j, -1].min() > NONE):
                floor = known.scores[i:j, -1]
                open_ = floor.max() == NONE
                scan = Scan(block, group.anchors.some(i, j), a, b)
                ids, scores = scan.run(lambda low, high: high >= floor[scan.which], None if open_ else floor, dims)
                other = ids != group.ids[i + scan.which]
                known.add(i + scan.which[other], ids[other], scores[other])


def best_negatives(group: Group, block: Block, k: int, low_share: int, high_share: int) -> None:
    """The block's rows of another label than an anchor's join the ``k`` best of each of its windows that their scores lie in."""
    size, width = group.scores.shape
    if group.found is None:
        group.found = Best(size * width, k)
        none = group.scores < 0  # below 0 no window holds a score
        ends = window(group.scores.astype(object), low_share, high_share)  # the products may not fit a long
        group.windows = none, *(np.where(none, x, end.astype(np.int64)) for x, end in zip((-NONE, NONE), ends))
    known, dims, (none, lowest, highest) = group.found, group.anchors.vectors.shape[1], group.windows
    for i, j in group.batches(0, size, len(block.ids)):
        last = known.scores[:, -1].reshape(size, width)[i:j]
        for a, b in in_parts(0, len(block.ids), last[~none[i:j]].min(initial=0) > NONE):
            floors = np.maximum(lowest[i:j], known.scores[:, -1].reshape(size, width)[i:j])
            least, most, tops = floors.min(axis=1, initial=-NONE), highest[i:j].max(axis=1, initial=NONE), highest[i:j]
            scan = Scan(block, group.anchors.some(i, j), a, b)

            def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
                which = scan.which
                stays = (high >= least[which]) & (low <= most[which]) & (block.labels[scan.at] != group.labels[i + which])
                here = np.flatnonzero(stays)
                low, high, which = low[here], high[here], which[here]
                some = np.zeros(len(here), bool)
                for w in range(width):
                    some |= (high >= floors[which, w]) & (low <= tops[which, w])
                stays[here] = some
                return stays

            ids, scores = scan.run(keep, least, dims)
            for w in range(width):
                inside = (scores >= lowest[i + scan.which, w]) & (scores <= highest[i + scan.which, w])
                known.add((i + scan.which[inside]) * width + w, ids[inside], scores[inside])


def window(score, low: int, high: int) -> tuple:
    """Whole scores s with low * score <= 100 * s <= high * score, as (lowest, highest)."""
    return -(-low * score // 100), high * score // 100


FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _meet(groups: DataFrame, blocks: DataFrame, n_groups: int, n_blocks: int, dims: int, search) -> DataFrame:
    """What the groups know after ``search(group, block)`` for each block."""
    cores = groups.sparkSession.sparkContext.defaultParallelism
    shares = max(-(-n_groups * GROUP_ANCHORS * dims // SHARE_NUMBERS), min(n_groups, -(-TASKS_A_CORE * cores // n_blocks)))
    stacks = min(n_blocks, max(-(-TASKS_A_CORE * cores // shares), -(-n_blocks * BLOCK_ROWS * dims // STACK_NUMBERS)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = groups.select(F.pmod("group", F.lit(shares)).alias("share"), every(stacks).alias("stack"), F.lit(0).alias("kind"),
                          F.col("group").alias("number"), "ids", "labels", "numbers", "windows")
    stored = blocks.select(every(shares).alias("share"), F.pmod("block", F.lit(stacks)).alias("stack"), F.lit(1).alias("kind"),
                           F.col("block").alias("number"), "ids", "labels", "numbers", "windows")
    cell = (F.col("share") * stacks + F.col("stack")).cast("int")
    dealt = (asked.unionByName(stored).withColumn("cell", cell).repartitionById(shares * stacks, F.col("cell"))
             .sortWithinPartitions("cell", "kind", "number").select("cell", "kind", "ids", "labels", "numbers", "windows"))

    def found(group: Group) -> Iterator[pa.RecordBatch]:
        if group.found is not None and group.scores.size:
            key, place = np.nonzero(group.found.scores > NONE)
            anchor, of = np.divmod(key, group.scores.shape[1])
            columns = group.ids[anchor], group.scores[anchor, of], group.found.ids[key, place], group.found.scores[key, place]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, share = None, []  # a share of the groups, then the blocks of a stack one by one
        for batch in batches:
            for i in range(batch.num_rows):
                number, kind, *packs = (c[i].as_py() for c in batch.columns)
                if number != last:
                    for group in share:
                        yield from found(group)
                    last, share = number, []
                if kind == 0:
                    share.append(Group(*packs))
                else:
                    block = Block(*packs[:3])
                    for group in share:
                        search(group, block)
        for group in share:
            yield from found(group)
        tidy()
    return dealt.mapInArrow(run, "anchor_id long, positive_score long, vec_id long, score long")


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The ``k`` best of each key with their rank; the limit is applied in the tasks before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = 5, keep: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its ``positives`` best other rows of the same label, and for each of these the ``keep`` best rows of
    another label whose score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialise(whole_vectors(vectors, anchor, id_col, vec_col, label_col))
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("q")).alias("dims")).first()
    n_blocks, n_groups = max(1, -(-counted.n // BLOCK_ROWS)), max(1, -(-counted.anchors // GROUP_ANCHORS))
    size = n_groups, n_blocks, counted.dims or 1
    blocks = materialise(packed(rows.select("vec_id", "label", "q"), "block", n_blocks, True))
    anchors = rows.where("anchor").select("vec_id", "label", "q")

    near = lambda group, block: best_positives(group, block, positives)
    hard = lambda group, block: best_negatives(group, block, keep, low, high)
    found = _meet(materialise(packed(anchors, "group", n_groups, False)), blocks, *size, near)
    good = materialise(_first(found, positives, "anchor_id").select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = good.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score"), False).alias("windows"))
    groups = materialise(packed(anchors.join(asked, "vec_id"), "group", n_groups, False))
    hits = _first(_meet(groups, blocks, *size, hard), keep, "anchor_id", "positive_score")
    return good.join(hits, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_sql() -> str:
    """What the query over ``embeddings`` must return."""
    return """
WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 65536)) = 0),
common AS (SELECT len(q) AS n FROM valid GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
once AS (SELECT vec_id, min({'label': label, 'q': q}) AS r FROM valid WHERE len(q) = (SELECT n FROM common) GROUP BY 1),
v AS (SELECT vec_id, r.label AS label, r.q AS q FROM once),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""
