"""Suffix-array deduplication: remove every byte inside a string of ``LENGTH`` bytes that also starts earlier.

Sorting every suffix of a corpus would move many times its size. Two steps leave only the suffixes whose order matters:

1. Anchors. In every window of LENGTH bytes the K-byte gram with the least hash is an anchor, so equal windows have equal anchors at
   equal places. An anchor stands for all windows that choose it; they lie in its context, LENGTH - K bytes before it to
   LENGTH after it. Per anchor, only hashes of gram and context are sent, and a task sends the first of equal contexts only:
   the others repeat it whole. Equal contexts settle most repeats.
2. Suffixes. Where one gram has different contexts, at the edges of what is repeated, the contexts themselves are fetched and
   the suffixes at their window starts are sorted to a depth of LENGTH bytes by deep-shallow sorting: multikey
   quicksort, eight bytes a step, to a shallow depth; then groups that still agree are ordered by blind tries, which
   look only at the places where members of a group branch off. Suffixes that agree over LENGTH bytes form a class, whose
   earliest start stays.

Copies of a whole text are settled by their hash. A byte goes if any class, context or copy covers it; all is judged on the input.

Defined cases: a null text is empty. Rows with a null id come after all others. Rows that share an id are one document:
at equal starts none of them is earlier. Texts under LENGTH bytes lose nothing. Hashes are of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import small_batches, tidy
from driftline.session import materialise

LENGTH, K = 100, 32
BEFORE = LENGTH - K
SHALLOW = 3  # words of eight bytes
WORDS = -(-LENGTH // 8)
BLOCK = 1 << 19
CHUNK = 8 << 20
BUCKET_BYTES = 12 << 20  # text whose anchors meet in one group; the contexts of 25,000 anchors are sorted in one
LAST_ID = (1 << 63) - 1

_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def node_of(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def _bodies(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
    return zip([LAST_ID if i is None else i for i in ids], [t or b"" for t in texts])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i:i + width]."""
    reach = 1
    while 2 * reach <= width:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    return pick(x[:len(x) - (width - reach)], x[width - reach:]) if reach < width else x


def anchors(block: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in a block of texts: places, gram hashes, and the unmixed hash of the K bytes from every place."""
    h = _TABLE[block]
    for i, step in enumerate(_STEP):
        h = h[:-(1 << i)] * step + h[1 << i:]
    mixed = h ^ (h >> np.uint64(29))
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    np.maximum(mixed, np.uint64(1), out=mixed)
    least = _sliding(mixed, BEFORE + 1, np.minimum)
    starts = np.arange(len(least))
    least[starts + LENGTH > ends[:len(least)]] = 0  # no window from here inside its text
    pad = np.zeros(BEFORE, np.uint64)
    chosen = _sliding(np.concatenate([pad, least, pad]), BEFORE + 1, np.maximum)
    at = np.flatnonzero(chosen == mixed)
    return at, mixed[at], h


def _merge(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite intervals of one key that touch."""
    if not len(a):
        return key, a, b
    order = np.lexsort((a, key))
    key, a, b = key[order], a[order], b[order]
    wide = int(b.max()) + 2
    at = np.unique(key, return_inverse=True)[1] * wide  # keys on one line, far enough apart
    top = np.maximum.accumulate(at + b)
    first = np.flatnonzero(np.append(True, (at + a)[1:] > top[:-1]))
    last = np.append(first[1:], len(a)) - 1
    return key[first], a[first], top[last] - at[last]


MARKS = pa.schema([("bucket", pa.int64()), ("gram", pa.binary()), ("context", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()),
                   ("before", pa.binary()), ("after", pa.binary()), ("ids", pa.binary()), ("nodes", pa.binary())])


def _collect(chunk: list[tuple[int, int, bytes]], buckets: int) -> pa.RecordBatch:
    """Anchors of some texts: the first of each context by bucket, and under bucket -1 what already repeats in the chunk."""
    gram, context, doc, pos, before, after = [], [], [], [], [], []

    def take(parts: list[tuple[int, int, bytes, int, int, int]]):
        """(document, its length, bytes, where they begin in it, core from, core to) laid side by side."""
        block = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        if len(block) < LENGTH:
            return
        sizes = np.array([len(p[2]) for p in parts])
        begin = np.cumsum(sizes) - sizes
        ends = np.repeat(begin + sizes, sizes)
        at, h, raw = anchors(block, ends)
        part = np.searchsorted(begin, at, "right") - 1
        table = np.array([(p[0], p[1], p[3], p[4], p[5]) for p in parts], np.int64)
        place = at - begin[part] + table[part, 2]
        core = (place >= table[part, 3]) & (place < table[part, 4])
        at, h, part, place = at[core], h[core], part[core], place[core]
        left, right = np.minimum(BEFORE, place), np.minimum(LENGTH, table[part, 1] - place)
        c = np.zeros(len(at), np.uint64)
        full = np.flatnonzero((left == BEFORE) & (right == LENGTH))
        for k, shift in enumerate((-BEFORE, K - BEFORE, 2 * K - BEFORE, 3 * K - BEFORE, 4 * K - BEFORE, LENGTH - K)):
            c[full] = (c[full] ^ raw[at[full] + shift] ^ (c[full] >> np.uint64(31))) * _STEP[k % 5]
        view = block.tobytes()
        for i in np.flatnonzero((left < BEFORE) | (right < LENGTH)):
            c[i] = xxhash.xxh64_intdigest(view[at[i] - left[i]:at[i] + right[i]], seed=int(left[i]) + 1)
        gram.append(h), context.append(c), doc.append(table[part, 0]), pos.append(place), before.append(left), after.append(right)

    parts, size = [], 0
    for i, (_, _, body) in enumerate(chunk):
        n = len(body)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            lo, hi = max(0, a - BEFORE - LENGTH), min(n, b + BEFORE + LENGTH)
            parts.append((i, n, body[lo:hi], lo, a, b))
            size += hi - lo
            if size >= BLOCK:
                take(parts)
                parts, size = [], 0
    if parts:
        take(parts)
    ids, nodes = np.array([c[0] for c in chunk], np.int64), np.array([c[1] for c in chunk], np.int64)
    if not gram:
        return pa.RecordBatch.from_pylist([], schema=MARKS)
    g, c, d, p, l, r = (np.concatenate(x) for x in (gram, context, doc, pos, before, after))
    order = np.lexsort((p, ids[d], c, g))
    g, c, d, p, l, r = (x[order] for x in (g, c, d, p, l, r))
    new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
    # a place equal to the first one belongs to the same document under another text: not a repeat
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    tied = ~new & (ids[d] == ids[d[head]]) & (p == p[head])
    repeat = ~new & ~tied
    md, ma, mb = _merge(d[repeat], (p - l)[repeat], (p + r)[repeat])
    rows = [(-1, b"", b"", md.astype("<i4").tobytes(), ma.astype("<i4").tobytes(), b"", mb.astype("<i4").tobytes(), ids.tobytes(), nodes.tobytes())]
    send = np.flatnonzero(~repeat)
    bucket = (g[send] % np.uint64(buckets)).astype(np.int64)
    for part in np.split(send[np.argsort(bucket, kind="stable")], np.flatnonzero(np.diff(np.sort(bucket))) + 1):
        used, at = np.unique(d[part], return_inverse=True)
        rows.append((int(g[part[0]] % np.uint64(buckets)), g[part].tobytes(), c[part].tobytes(), at.astype("<i4").tobytes(), p[part].astype("<i4").tobytes(),
                     l[part].astype("u1").tobytes(), r[part].astype("u1").tobytes(), ids[used].tobytes(), nodes[used].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(map(list, zip(*rows)), MARKS)], schema=MARKS)


def send_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: dict[int, tuple[int, int, bytes]] = {}
        size = 0
        for batch in batches:
            for doc_id, body in _bodies(batch):
                if len(body) < LENGTH:
                    continue
                node = node_of(body)
                if node in chunk:  # of copies, the first stands for all
                    chunk[node] = (min(doc_id, chunk[node][0]), node, body)
                    continue
                chunk[node] = (doc_id, node, body)
                size += len(body)
                if size >= CHUNK:
                    yield _collect(list(chunk.values()), buckets)
                    chunk, size = {}, 0
        if chunk:
            yield _collect(list(chunk.values()), buckets)
        chunk.clear()
        tidy()
    return docs.mapInArrow(run, "bucket long, gram binary, context binary, doc binary, pos binary, before binary, after binary, ids binary, nodes binary")


FOUND = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("pos", pa.int32()), ("gram", pa.int64())])


def _found(ids, nodes, a, b, pos=None, gram=None) -> pa.Table:
    blank = lambda t: pa.nulls(len(ids), t)
    return pa.table([pa.array(ids), pa.array(nodes), pa.array(a, pa.int32()), pa.array(b, pa.int32()), blank(pa.int32()) if pos is None else pa.array(pos, pa.int32()),
                     blank(pa.int64()) if gram is None else pa.array(gram)], schema=FOUND)


def _settle(key, table):
    """In one bucket: contexts that repeat an earlier one, and requests for the first ones where a gram has several."""
    get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    docs, ids, nodes = get("doc", "<i4"), get("ids", np.int64), get("nodes", np.int64)
    pos = np.concatenate(get("pos", "<i4"))
    i, n = np.concatenate([x[d] for x, d in zip(ids, docs)]), np.concatenate([x[d] for x, d in zip(nodes, docs)])
    if key[0].as_py() < 0:
        return _found(i, n, pos, np.concatenate(get("after", "<i4")))
    g, c = np.concatenate(get("gram", np.uint64)), np.concatenate(get("context", np.uint64))
    l, r = (np.concatenate(get(x, "u1")).astype(np.int32) for x in ("before", "after"))
    order = np.argsort(g, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(g[order]) != 0)) if len(g) else np.zeros(0, int)
    size = np.diff(np.append(first, len(g)))
    order = order[np.repeat(size > 1, size)]  # most grams are met once
    order = order[np.lexsort((pos[order], i[order], c[order], g[order]))]
    g, c, i, n, pos, l, r = (x[order] for x in (g, c, i, n, pos, l, r))
    if not len(g):
        return _found(i, n, pos, pos)
    new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    tied = ~new & (i == i[head]) & (pos == pos[head])
    again = ~new & ~tied
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    kinds = np.add.reduceat(new.astype(int), start)
    several = np.repeat(kinds > 1, np.diff(np.append(start, len(g)))) & ~again
    done = _found(i[again], n[again], (pos - l)[again], (pos + r)[again])
    asked = _found(i[several], n[several], (pos - l)[several], (pos + r)[several], pos[several], g[several].view(np.int64))
    return pa.concat_tables([done, asked])


def deep_shallow(words: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes inside their groups to LENGTH bytes. Returns the members of classes of two or more, and their class.

    ``words`` holds at every place the next eight bytes as a number, ``start`` where each suffix begins.
    """
    def word(at: np.ndarray, j) -> np.ndarray:
        w = words[start[at] + 8 * j]
        rest = LENGTH - 8 * (WORDS - 1)
        return np.where(np.asarray(j) == WORDS - 1, w >> np.uint64(8 * (8 - rest)), w)

    def split(at, g, key):
        order = np.lexsort((key, g))
        at, g, key = at[order], g[order], key[order]
        new = np.append(True, (g[1:] != g[:-1]) | (key[1:] != key[:-1]))
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        keep = np.repeat(size > 1, size)
        return at[keep], (np.cumsum(new) - 1)[keep]

    at, g = split(np.arange(len(start)), group, np.zeros(len(start), np.uint64))
    for j in range(SHALLOW):  # multikey quicksort, one word a step
        if not len(at):
            return at, g
        at, g = split(at, g, word(at, j))
    done_at, done_g, base = [], [], 0
    while len(at):  # blind tries: every group branches at the first place where any member leaves the first one
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(first, len(at)))
        lead = np.repeat(at[first], size)
        branch = np.full(len(at), WORDS)
        for j in range(WORDS - 1, SHALLOW - 1, -1):
            branch[word(at, j) != word(lead, j)] = j
        least = np.repeat(np.minimum.reduceat(branch, first), size)
        equal = least == WORDS
        done_at.append(at[equal]), done_g.append(g[equal] + base)
        base += int(g[-1]) + 1
        at, g, least = at[~equal], g[~equal], least[~equal]
        if len(at):
            at, g = split(at, g, word(at, least))
    return (np.concatenate(done_at), np.concatenate(done_g)) if done_at else (at, g)


def _sort_contexts(table):
    """Windows of the contexts of some grams that start earlier elsewhere, as intervals."""
    gram, ids, nodes = (table.column(x).to_numpy() for x in ("gram", "id", "node"))
    pos, a, b = (table.column(x).to_numpy().astype(np.int64) for x in ("pos", "a", "b"))
    order = np.argsort(gram, kind="stable")
    bodies = table.column("body").take(pa.array(order)).to_pylist()
    gram, ids, nodes, pos, a, b = (x[order] for x in (gram, ids, nodes, pos, a, b))
    out = []
    edges = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, int)
    edges = np.append(edges, len(gram))
    lo = 0
    while lo < len(edges) - 1:
        hi = lo + 1
        while hi < len(edges) - 1 and edges[hi + 1] - edges[lo] <= 20_000:
            hi += 1
        s = slice(edges[lo], edges[hi])
        lo = hi
        n = (b - a)[s]
        text = np.frombuffer(b"".join(bodies[s]) + bytes(16), np.uint8).astype(np.uint64)
        words = np.zeros(len(text) - 8, np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | text[k:k + len(words)]
        words = np.append(words, np.zeros(8 * WORDS, np.uint64))
        count = n - LENGTH + 1
        context = np.repeat(np.arange(len(n)), count)
        shift = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = (np.cumsum(n) - n)[context] + shift
        place = a[s][context] + shift
        which = np.cumsum(np.append(0, gram[s][1:] != gram[s][:-1]))[context]
        at, cls = deep_shallow(words, start, which * (BEFORE + 1) + (pos[s][context] - place))
        if not len(at):
            continue
        i, p = ids[s][context[at]], place[at]
        order = np.lexsort((p, i, cls))
        at, cls, i, p = at[order], cls[order], i[order], p[order]
        head = np.maximum.accumulate(np.where(np.append(True, cls[1:] != cls[:-1]), np.arange(len(at)), 0))
        later = at[(i != i[head]) | (p != p[head])]
        c, x, y = _merge(context[later], place[later], place[later] + LENGTH)
        out.append(_found(ids[s][c], nodes[s][c], x, y))
    tidy()
    return pa.concat_tables(out) if out else _found(*[np.zeros(0, np.int64)] * 4)


DOCS = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("node", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string())])
ZIPPED = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("body", pa.binary())])


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(None if i == LAST_ID else i, i, node_of(t), len(t), hashlib.sha256(t).hexdigest()) for i, t in _bodies(batch)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(map(list, zip(*rows)), DOCS)], schema=DOCS)


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        rows = [(i, node_of(t), z.compress(t)) for i, t in _bodies(batch) if len(t) >= LENGTH]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(map(list, zip(*rows)), ZIPPED)], schema=ZIPPED)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for i, node, body, asked in zip(*[batch.column(c).to_pylist() for c in ("id", "node", "body", "asked")]):
            text = z.decompress(body)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["gram"] for x in asked], pa.int64()), pa.array([i] * len(asked), pa.int64()), pa.array([node] * len(asked), pa.int64()),
                 *[pa.array([x[c] for x in asked], pa.int32()) for c in ("a", "b", "pos")], pa.array([text[x["a"]:x["b"]] for x in asked], pa.binary())],
                names=["gram", "id", "node", "a", "b", "pos", "body"])


def cut(body: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and how many runs were removed."""
    out, at, runs, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            out.append(body[at:a])
        end = max(end, b)
        at = max(at, b)
    out.append(body[at:])
    return b"".join(out), runs


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for i, node, body, spans in zip(*[batch.column(c).to_pylist() for c in ("id", "node", "body", "spans")]):
            text = z.decompress(body)
            left, runs = cut(text, [(x["a"], x["b"]) for x in spans])
            rows.append((i, node, len(text) - len(left), runs, hashlib.sha256(left).hexdigest(), left))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in map(list, zip(*rows))], names=["id", "node", "n_removed", "n_spans", "kept", "left"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Named documents, their zipped texts, and spans (id, node, a, b) of the first copy of each text."""
    small_batches(docs.sparkSession)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = materialise(body.mapInArrow(_name, "doc_id long, id long, node long, n_bytes long, sha string"))
    total = named.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, int(total) // BUCKET_BYTES)
    sent = send_anchors(body, buckets).withColumn("part", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("ids"), F.lit(buckets))).otherwise(F.col("bucket")))
    found = materialise(sent.groupBy("bucket", "part").applyInArrow(_settle, "id long, node long, a int, b int, pos int, gram long"))
    zipped = body.mapInArrow(_zip, "id long, node long, body binary")
    asked = found.where("gram IS NOT NULL")
    parts = max(8, asked.count() // 25_000)
    contexts = zipped.join(
        asked.groupBy("id", "node").agg(F.collect_list(F.struct("gram", "a", "b", "pos")).alias("asked")), ["id", "node"])
    edges = (contexts.mapInArrow(_contexts, "gram long, id long, node long, a int, b int, pos int, body binary")
             .dropDuplicates(["gram", "id", "node", "pos"]).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts)))
             .groupBy("part").applyInArrow(_sort_contexts, "id long, node long, a int, b int, pos int, gram long"))
    spans = found.where("gram IS NULL").select("id", "node", "a", "b").union(materialise(edges.select("id", "node", "a", "b")))
    return named, zipped, spans


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds the bytes left (``kept``)."""
    named, zipped, spans = repeated_spans(docs)
    firsts = materialise(named.groupBy("node").agg(F.min("id").alias("first")))  # so that the join can split a text of many copies
    by_doc = spans.groupBy("id", "node").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    result = (zipped.join(by_doc, ["id", "node"]).mapInArrow(_cut, "id long, node long, n_removed long, n_spans long, kept string, left binary")
              .drop(*[] if with_text else ["left"]).dropDuplicates(["id", "node"]))
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    joined = named.join(firsts, "node").join(result, ["id", "node"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    columns = [F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
               F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
               F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256")]
    text = [F.when(copy, F.lit(b"")).otherwise(F.col("left")).alias("kept")] if with_text else []
    return joined.select("doc_id", "n_bytes", *columns, *text)
