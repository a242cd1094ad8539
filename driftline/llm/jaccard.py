"""N-gram Jaccard join by set relations: components of documents whose shingle sets are at least 80 per cent alike.

A document's set holds its distinct 5-word shingles, hashed to 64 bits. All links count, but neither copies nor families of
near-copies are expanded into pairs:

1. Equal sets become one node.
2. Sets that cannot link are dropped. In one order of all tokens, two sets that link share their first l common tokens
   inside their first n - a + l tokens (a: the least overlap a link needs). So a set goes whose first tokens meet too few
   others. A task first merges equal tokens of its own texts, so a token of many copies is sent once a task.
3. The sets left are ordered by token frequency, rarest first; a set whose prefix meets no other is dropped.
4. Set relation: each set is compared with one or two leaders, those of the sets with its sampled tokens that have the
   smallest share of tokens of their own: an original has fewer than what was edited from it. A set that links with its
   leader joins its group and is kept as the difference to it.
5. The index holds, per token, groups instead of sets, with their range of sizes and the least position of the token. Lists are
   cut into blocks by size, and blocks that cannot hold a partner are skipped, as are positions after which too little
   of either set is left. Only groups not known to be connected meet.
6. A group's answers are derived: the overlap of a member with another group's leader is that of its own leader, less what
   the member lacks and plus what it adds; the overlap of two members follows in the same way. Bounds on the size of
   the differences stop most of it before any member is read.
7. Links and memberships form the graph whose components are returned.

``linked_nodes`` gives just enough links for components: sets known to be connected are not compared. ``link_counts`` counts all
links. There, 5 keeps every pair of groups, and the members of a group, and all sets near enough to its leader, are compared with
its members by their differences to that leader, in blocks of bounded size: with d the differences and l what a set lacks,
two sets share |leader| - l - l' + |d and d'|. Only sums per set and block leave a task. Each link counts for as many
documents as its other set has, and copies link with each other.

Defined cases: fewer than five words make one shingle of the whole sequence; null or wordless texts have an empty set and link with
nothing. Rows with one id count as one document in the result; with
different sets they count as one each in n_links, where a null id is an id. Ties between leaders go to the smaller node. Two steps of leaders give labels; sets of one label are connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import record_batch, text_batches, texts, tidy
from driftline.llm.components import components
from driftline.llm.words import kept, words_of
from driftline.session import broadcast_if_small, materialise

WIDTH = 5
BUCKET_TOKENS = 2_000_000
SAMPLE = 16
BLOCK_ROWS, BLOCK_TOKENS = 2048, 1_000_000  # of one side of a block of comparisons
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.lower())  # bytes: only A-Z change
        return h


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, limit: int = 300_000):
        self.known, self.limit = _Hashes(), limit

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64)
        if len(self.known) > self.limit:
            self.known.clear()
        a = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(WIDTH, len(a))
        h = np.full(len(a) - k + 1, k, np.uint64)
        for i in range(k):
            h += a[i:len(a) - k + 1 + i] * _FACTOR[i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h.view(np.int64))


def node_of(shingles: np.ndarray) -> int:
    """64-bit name of a set: among n sets two share one with odds n^2 / 2^65."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n):
    """What a set of n must share with any set it links with."""
    return (4 * n + 4) // 5


def spare(n):
    """How many of the common tokens the first filter asks for."""
    return n // 10 + 1


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])


def name_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, node; node is null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = kept("shingles", Shingler)
        for ids, bodies in text_batches(batches, "doc_id", "text"):
            sets = [shingle(t) for t in bodies]
            yield record_batch(SETS, [ids, [len(s) for s in sets], [node_of(s) if len(s) else None for s in sets]])
    return docs.mapInArrow(run, "doc_id long, n long, node long")


def _first_tokens(docs: DataFrame, buckets: int) -> DataFrame:
    """Per chunk of texts and bucket: tokens of the sets' first parts and which node has each, -1 if several here do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = kept("shingles", Shingler)
        for (bodies,) in text_batches(batches, "text", most=16 << 20):
            seen: dict[int, np.ndarray] = {}
            for t in bodies:
                s = shingle(t)
                if len(s):
                    n = len(s)
                    seen.setdefault(node_of(s), s[:n - least_overlap(n) + spare(n)])
            if not seen:
                continue
            nodes = np.fromiter(seen, np.int64, len(seen))
            tokens = np.concatenate(list(seen.values()))
            owner = np.repeat(nodes, [len(s) for s in seen.values()])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            count = np.diff(np.append(first, len(tokens)))
            # what is met twice here is known to be shared: its sets are told at once
            shared = np.repeat(count > 1, count)
            told, times = np.unique(owner[shared], return_counts=True)
            yield _blobs([-1], [told], [times.astype(np.int64)])
            tokens, owner = tokens[first], np.where(count > 1, -1, owner[first])
            bucket = (tokens.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            yield _blobs([int(bucket[p[0]]) for p in np.split(order, cuts)], [tokens[p] for p in np.split(order, cuts)],
                         [owner[p] for p in np.split(order, cuts)])
    return docs.select("text").mapInArrow(run, "bucket long, a binary, b binary")


def _blobs(bucket: list[int], a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([x.tobytes() for x in a], pa.binary()),
                                       pa.array([x.tobytes() for x in b], pa.binary())], names=["bucket", "a", "b"])


def _meet(parts: int):
    """How many tokens of each node in one bucket another node has too, packed by part of the nodes."""
    def meet(key, table):
        a = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("a").to_pylist()])
        b = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("b").to_pylist()])
        if key[0].as_py() < 0:
            node, times = a, b
        else:
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))  # copies of a set in other chunks count once
            a, b = a[once], b[once]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            count = np.diff(np.append(first, len(a)))
            node, times = np.unique(b[np.repeat(count > 1, count) & (b != -1)], return_counts=True)
        part = (node.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        pieces = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
        tidy()
        return pa.table({"part": pa.array([int(part[p[0]]) for p in pieces], pa.int64()), "nodes": pa.array([node[p].tobytes() for p in pieces], pa.binary()),
                         "times": pa.array([times[p].astype(np.int64).tobytes() for p in pieces], pa.binary())})
    return meet


def _add_up(key, table):
    node = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("nodes").to_pylist()])
    times = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("times").to_pylist()])
    nodes, at = np.unique(node, return_inverse=True)
    return pa.table({"node": pa.array(nodes), "times": pa.array(np.bincount(at, times, len(nodes)).astype(np.int64))})


def may_link(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Nodes (column node) whose first tokens meet enough others: a superset of all that link."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(total) // BUCKET_TOKENS)
    salted = (_first_tokens(docs, buckets)
              .withColumn("salt", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("a"), F.lit(buckets))).otherwise(F.col("bucket"))))
    told = salted.groupBy("bucket", "salt").applyInArrow(_meet(max(8, buckets // 4)), "part long, nodes binary, times binary")
    met = told.groupBy("part").applyInArrow(_add_up, "node long, times long")
    sizes = sets.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"))
    enough = F.floor(F.floor((4 * F.col("n") + 4) / 5) / 10) + 1  # the smallest partner asks for the least
    return met.join(sizes, "node").where(F.col("times") >= enough).select("node")


def token_sets(docs: DataFrame) -> DataFrame:
    """node, n, tokens of the given documents' sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = kept("shingles", Shingler)
        for (bodies,) in text_batches(batches, "text", most=1 << 22):
            sets = [s for s in map(shingle, bodies) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "tokens"])
    return docs.select("text").mapInArrow(run, "node long, n long, tokens array<long>")


def _need(n, m):
    """Least overlap of linked sets of n and m: 100 i >= 80 (n + m - i)."""
    return F.ceil((80 * (n + m)) / F.lit(180))


def _links(overlap, n, m):
    return 180 * overlap >= 80 * (n + m)


def _side(body: DataFrame, p: str) -> DataFrame:
    return body.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), F.col("tokens").alias(f"{p}_tokens"))


_OVERLAP = lambda: F.size(F.array_intersect("node_tokens", "leader_tokens"))


def _groups(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets that may link with their prefixes, their tokens, who joined which leader, and all as members of groups."""
    pairs = sets.select("node", F.explode("tokens").alias("token"))
    # written out, so that the join with it can split a token of many sets
    common = materialise(pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    ordered = (pairs.join(common, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
               .join(sets.select("node", "n"), "node"))
    lone = F.col("n") - F.size("own")  # tokens no other set has come first
    prefix = (F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1 - lone).cast("int")
    nodes = materialise(ordered.where(prefix > 0).select(
        "node", "n", F.transform(F.slice("own", F.lit(1), prefix), lambda x, i: F.struct(x.token.alias("token"), (i + lone).alias("at"))).alias("prefix"),
        F.slice(F.array_sort(F.transform("own", lambda x: x.token)), 1, SAMPLE).alias("sample"), (lone / F.col("n")).alias("lone")))
    body = materialise(sets.join(nodes.select("node"), "node", "left_semi"))

    # leaders
    drawn = nodes.select("node", "lone", F.explode("sample").alias("token"))
    least = materialise(drawn.groupBy("token").agg(F.min(F.struct("lone", "node")).alias("first")).select("token", F.col("first.node").alias("leader")))
    votes = drawn.join(least, "token").where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", (-F.col("leader")).alias("back"))), asc=False), 1, 2).alias("best"))
    tried = best.select("node", F.explode("best").alias("b")).select("node", (-F.col("b.back")).alias("leader"))
    compared = (tried.join(_side(body, "node"), "node").join(_side(body, "leader"), "leader").withColumn("overlap", _OVERLAP())
                .where(_links(F.col("overlap"), F.col("node_n"), F.col("leader_n"))))
    joined = materialise(compared.groupBy("node").agg(F.max_by(
        F.struct("leader", "overlap", F.array_except("node_tokens", "leader_tokens").alias("adds"), F.array_except("leader_tokens", "node_tokens").alias("lacks")),
        F.struct(F.col("overlap") / (F.col("node_n") + F.col("leader_n") - F.col("overlap")), -F.col("leader"))).alias("to")).select("node", "to.*"))

    # two steps towards the root: nodes with one label are connected
    up = joined.select(F.col("node").alias("leader"), F.col("leader").alias("next"))
    once = joined.select("node", "leader").join(up, "leader", "left").select("node", F.coalesce("next", "leader").alias("leader"))
    label = once.join(up, "leader", "left").select("node", F.coalesce("next", "leader").alias("label"))
    empty = F.lit([]).cast("array<long>")
    members = materialise(nodes.select("node", "n").join(joined.drop("overlap"), "node", "left").join(label, "node", "left").select(
        "node", "n", F.coalesce("leader", "node").alias("group"), F.coalesce("label", "node").alias("label"),
        F.coalesce("adds", empty).alias("adds"), F.coalesce("lacks", empty).alias("lacks")))
    return nodes, body, joined, members


def _near_leaders(nodes: DataFrame, body: DataFrame, members: DataFrame, every: bool) -> DataFrame:
    """Members f of one group that may link with members of another one: f, f_n, other, overlap with the other leader, and its
    tokens. Of two groups the one with the smaller name gives f; without ``every``, only groups not known to be connected meet."""
    # the index: lists of groups, in blocks of sizes a factor 1.25 apart
    block = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)) + 1e-9)
    lists = (nodes.select("node", F.explode("prefix").alias("p")).join(members.select("node", "n", "group", "label"), "node")
             .groupBy(F.col("p.token").alias("token"), "group").agg(F.min("label").alias("label"), F.min("n").alias("low"), F.max("n").alias("high"),
                                                                   F.min(F.col("p.at")).alias("at"), F.max(F.col("n") - F.col("p.at")).alias("left")))
    differ = "group" if every else "label"
    lists = materialise(lists.join(lists.groupBy("token").agg((F.min(differ) < F.max(differ)).alias("apart")).where("apart"), "token", "left_semi"))
    here = lists.select("token", F.explode(F.sequence(block(F.col("low")), block(F.col("high")))).alias("block"), *[F.col(c).alias(f"a_{c}") for c in ("group", "label", "low", "high", "left")])
    there = lists.select("token", F.explode(F.sequence(block(F.col("low")) - 1, block(F.col("high")) + 1)).alias("block"), *[F.col(c).alias(f"b_{c}") for c in ("group", "label", "low", "high", "left")])
    met = (here.join(there, ["token", "block"])
           .where("a_group < b_group" if every else "a_group < b_group AND a_label <> b_label").where("5 * a_high >= 4 * b_low AND 5 * b_high >= 4 * a_low")
           .where(F.least("a_left", "b_left") >= _need(F.col("a_low"), F.col("b_low")))
           .select(F.col("a_group").alias("node"), F.col("b_group").alias("leader")).distinct())

    # answers of the leaders, then of their members
    reach = members.groupBy("group").agg(F.max(F.size("adds")).alias("most"), F.min("n").alias("low"))
    of = lambda p: reach.select(F.col("group").alias(p), F.col("most").alias(f"{p}_most"), F.col("low").alias(f"{p}_low"))
    answers = (met.join(_side(body, "node"), "node").join(_side(body, "leader"), "leader").select("node", "leader", _OVERLAP().alias("overlap"))
               .join(of("node"), "node").join(of("leader"), "leader")
               .where(F.col("overlap") + F.col("node_most") + F.col("leader_most") >= _need(F.col("node_low"), F.col("leader_low"))))
    answers = materialise(answers.select(F.col("node").alias("group"), F.col("leader").alias("other"), "overlap", F.col("leader_most").alias("most"), F.col("leader_low").alias("low")))
    theirs = body.select(F.col("node").alias("other"), F.col("tokens").alias("other_tokens"))
    return (answers.join(members.select("group", F.col("node").alias("f"), F.col("n").alias("f_n"), "adds", "lacks"), "group")
               .where(F.col("overlap") + F.size("adds") + F.col("most") >= _need(F.col("f_n"), F.col("low")))
               .join(theirs, "other")
               .withColumn("overlap", F.col("overlap") - F.size(F.array_intersect("lacks", "other_tokens")) + F.size(F.array_intersect("adds", "other_tokens")))
               .where(F.col("overlap") + F.col("most") >= _need(F.col("f_n"), F.col("low")))
               .select("f", "f_n", "other", "overlap", "other_tokens"))


def linked_nodes(sets: DataFrame) -> DataFrame:
    """Edges a, b over the nodes of ``sets`` (node, n, tokens) that give the components of all links."""
    nodes, body, joined, members = _groups(sets)
    derived = _near_leaders(nodes, body, members, False).drop("other_tokens")
    mine = body.select(F.col("node").alias("f"), F.col("tokens").alias("f_tokens"))
    final = (derived.join(members.select(F.col("group").alias("other"), F.col("node").alias("g"), F.col("n").alias("g_n"), "adds", "lacks"), "other")
             .where(F.col("overlap") + F.size("adds") >= _need(F.col("f_n"), F.col("g_n")))
             .join(mine, "f")
             .withColumn("overlap", F.col("overlap") - F.size(F.array_intersect("lacks", "f_tokens")) + F.size(F.array_intersect("adds", "f_tokens")))
             .where(_links(F.col("overlap"), F.col("f_n"), F.col("g_n"))).select(F.col("f").alias("a"), F.col("g").alias("b")))
    return joined.select(F.col("node").alias("a"), F.col("leader").alias("b")).union(final)


_MEMBER, _OWN, _OTHER = 0, 1, 2  # a member of the group, the same as one who asks, one of another group who asks


def _count_block(table: pa.Table) -> pa.Table:
    """Rows (h, h_n, node, docs, side, lacks, diff) of one block of comparisons or of many small groups. Returns a, b, n: documents
    that the links of set a lead to (b null), and edges from sets of other groups to h."""
    table = table.combine_chunks()
    h, h_n, node, docs, side, lacks = (table.column(c).to_numpy() for c in ("h", "h_n", "node", "docs", "side", "lacks"))
    lists = table.column("diff").to_pylist() if not table.num_rows else [np.asarray(x.values) for x in table.column("diff")]
    size = np.array([len(x) for x in lists], np.int64)
    n = h_n + size - 2 * lacks
    order = np.lexsort((side, h))
    told: list[tuple] = []
    for part in np.split(order, np.flatnonzero(np.diff(h[order])) + 1) if len(order) else []:
        g, f = part[side[part] == _MEMBER], part[side[part] != _MEMBER]
        if not len(g) or not len(f):
            continue
        tokens = np.concatenate([lists[i] for i in g]).astype(np.int64)
        by_token = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[by_token], np.repeat(np.arange(len(g)), size[g])[by_token]
        asked = np.zeros(len(g), np.int64)
        for i in f:
            lack = 80 * (n[i] + n[g]) - 180 * (h_n[i] - lacks[i] - lacks[g])  # 180 times what common differences must give
            if ((lack > 0) & (180 * np.minimum(size[i], size[g]) >= lack)).any():
                low, high = np.searchsorted(tokens, lists[i], "left"), np.searchsorted(tokens, lists[i], "right")
                times = high - low
                at = np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
                linked = 180 * np.bincount(owner[at], minlength=len(g)) >= lack
            else:
                linked = lack <= 0
            linked &= node[g] != node[i]
            if not linked.any():
                continue
            told.append((node[i], None, docs[g][linked].sum()))
            if side[i] == _OTHER:
                asked += linked * docs[i]
                told.append((node[i], h[i], 0))
        told += [(node[g[k]], None, asked[k]) for k in np.flatnonzero(asked)]
    tidy()
    return pa.table({c: pa.array([None if t[k] is None else int(t[k]) for t in told], pa.int64()) for k, c in enumerate("abn")})


def link_counts(sets: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges a, b that give the components of all links over the nodes of ``sets`` (node, n, tokens), and node, linked: how many
    documents the links of each node lead to, where ``weights`` has the docs of each node."""
    nodes, body, joined, members = _groups(sets)
    near = _near_leaders(nodes, body, members, True)
    mine = body.select(F.col("node").alias("f"), F.col("tokens").alias("f_tokens"))
    row = lambda h, h_n, lacks, diff: [h.alias("h"), h_n.cast("long").alias("h_n"), F.col("node"), lacks.cast("long").alias("lacks"), diff.alias("diff")]
    own = materialise(members.select(*row(F.col("group"), F.col("n") - F.size("adds") + F.size("lacks"), F.size("lacks"), F.concat("adds", "lacks")))
                      .join(weights, "node"))
    missing = F.array_except("other_tokens", "f_tokens")
    others = materialise(near.join(mine, "f").withColumnRenamed("f", "node")
                         .select(*row(F.col("other"), F.size("other_tokens"), F.size(missing), F.concat(F.array_except("f_tokens", "other_tokens"), missing)))
                         .join(weights, "node"))
    much = lambda d, p: d.groupBy("h").agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.sum(F.size("diff")).alias(f"{p}_tokens"))
    blocks = lambda rows, tokens: F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(tokens / BLOCK_TOKENS)).cast("int")
    more = lambda c: F.coalesce(f"o_{c}", F.lit(0))
    plan = materialise(much(own, "g").join(much(others, "o"), "h", "left").where("g_rows > 1 OR o_rows > 0").select(
        "h", blocks(F.col("g_rows"), F.col("g_tokens")).alias("across"), blocks(F.col("g_rows") + more("rows"), F.col("g_tokens") + more("tokens")).alias("down"),
        ((2 * F.col("g_rows") + more("rows") <= 64) & (2 * F.col("g_tokens") + more("tokens") <= 20_000)).alias("small")))
    groups = plan.count()
    plan = broadcast_if_small(plan, groups, 24)
    task = F.when(F.col("small"), F.pmod(F.xxhash64("h"), F.lit(max(64, groups // 200)))).otherwise(F.col("h")).alias("task")
    cols = ["h", "h_n", "node", "docs", "lacks", "diff", task]
    split = lambda d, side, mine, theirs, i, j: d.join(plan, "h").select(
        *cols, F.lit(side).cast("long").alias("side"), F.pmod(F.xxhash64("node"), F.col(mine)).cast("int").alias(i), F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias(j))
    rows = (split(own, _MEMBER, "across", "down", "j", "i").unionByName(split(own, _OWN, "down", "across", "i", "j"))
            .unionByName(split(others, _OTHER, "down", "across", "i", "j")))
    told = materialise(rows.groupBy("task", "i", "j").applyInArrow(_count_block, "a long, b long, n long"))
    edges = joined.select(F.col("node").alias("a"), F.col("leader").alias("b")).union(told.where("b IS NOT NULL").select("a", "b").distinct())
    return edges, told.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id for every row, and n_links, the number of other documents it links with, unless ``links`` is
    false. Texts are read three times and never shuffled whole: the third time only for the sets that may link."""
    body = texts(docs, id_col, text_col)
    named = materialise(name_sets(body))
    firsts = materialise(named.where("node IS NOT NULL").select("node", "doc_id").distinct()
                         .groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs")))
    near = materialise(may_link(body, named))
    wanted = materialise(firsts.join(near, "node"))
    ids = broadcast_if_small(wanted.select(F.col("first_doc").alias("doc_id")), wanted.count(), 16)
    of_first = body["doc_id"].eqNullSafe(ids["doc_id"])  # a set that only documents without id have is fetched by its null
    sets = materialise(token_sets(body.join(ids, of_first, "left_semi")).join(near, "node", "left_semi").dropDuplicates(["node"]))
    edges, linked = link_counts(sets, wanted.select("node", "docs")) if links else (linked_nodes(sets), None)
    roots = components(edges)
    member = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = member.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_node = member.join(smallest, "root").select("node", "docs", "component_id")
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    if links:
        of_node = of_node.join(linked, "node", "left").select("node", "component_id", (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
        out.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return named.join(of_node, "node", "left").select(*out)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those whose component has a smaller id, and without repeated rows of one id and text."""
    found = materialise(jaccard_components(docs, id_col, text_col, links=False))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    keep = found.where(stays).select("doc_id")
    lost = materialise(found.where(~stays).select("doc_id").distinct().join(keep, "doc_id", "left_anti"))
    small = broadcast_if_small(lost, lost.count(), 16).alias("lost")  # named on both sides: documents may have any columns
    out = docs.alias("kept").join(small, F.col(f"kept.{id_col}").cast("long") == F.col("lost.doc_id"), "left_anti")
    unique = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return out if unique else out.dropDuplicates([id_col, text_col])
