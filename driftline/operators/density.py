"""Hierarchical density clustering (HDBSCAN): core distances, minimum spanning tree of mutual reachability, condensed
tree, selection by excess of mass, and merging below a distance.

Papers: Campello, Moulavi, Sander 2013; McInnes, Healy 2017; Malzer, Baum 2020.

Equal vectors become one weighted vertex at the start, so a large group of copies costs nothing further. The tree is
built in rounds in which every component takes its lightest outgoing edge; neighbour lists settle most rounds, and only
points whose list cannot prove the edge is lightest are searched again. Tree edges are then merged in bands of bounded
size in order of weight, carrying a small state per component from band to band.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.neighbours import SLACK, BlockIndex, Squares, exact_distance, nearest_neighbours
from driftline.operators.ordering import dense_index
from driftline.session import broadcast_if_small, discard, materialise

IN_TASK_COMPONENTS = 1_000_000
LEAST_DISTANCE = 1e-12  # stands for 0 where 1 / distance is needed
HEAVY_COPIES = 100_000


# ---- spanning tree -------------------------------------------------------------------------------------------

def _core(near, copies, min_samples: int):
    """Distance to the min_samples-th other row, copies counted; the farthest known one if there are fewer."""
    start = F.struct((copies - 1).alias("seen"), F.lit(0.0).alias("core"))
    step = lambda a, x: F.struct(
        (a["seen"] + x["m"]).alias("seen"), F.when(a["seen"] < min_samples, x["d"]).otherwise(a["core"]).alias("core"))
    return F.aggregate(near, start, step, lambda a: a["core"])


class _Sets:
    """Disjoint sets over the numbers of one bounded group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _merge_in_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """Kept edges (kind 1) and component -> root (kind 0) of one round."""
    sets, rows = _Sets(), []
    for w, lo, hi, c1, c2 in pdf.sort_values(["w", "lo", "hi"])[["w", "lo", "hi", "c1", "c2"]].itertuples(index=False):
        if sets.join(c1, c2):
            rows.append((1, lo, hi, w))
    rows += [(0, c, sets.find(c), 0.0) for c in list(sets.up)]
    return pd.DataFrame(rows, columns=["kind", "a", "b", "w"])


def _merge_by_jumps(best: DataFrame) -> DataFrame:
    """The same for any number of components: each points to its neighbour, the lower of a mutual pair is a root,
    and pointers are doubled until all reach a root."""
    up = best.select(F.col("c").alias("x"), F.when(F.col("c") == F.col("c1"), F.col("c2")).otherwise(F.col("c1")).alias("y"))
    back = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
    up = materialise(up.join(back, "y").select("x", F.when(
        (F.col("z") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("y")))
    for _ in range(64):
        nxt = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
        jumped = materialise(up.join(nxt, "y").select("x", F.col("z").alias("y"), (F.col("z") != F.col("y")).alias("moved")))
        up = jumped.select("x", "y")
        if jumped.filter("moved").isEmpty():
            break
    edges = best.select("lo", "hi", "w").distinct()
    return (up.select(F.lit(0).alias("kind"), F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0.0).alias("w"))
            .unionByName(edges.select(F.lit(1).alias("kind"), F.col("lo").alias("a"), F.col("hi").alias("b"), "w")))


def _lightest(edges: DataFrame) -> DataFrame:
    """(c, w, lo, hi): lightest edge per component, in one total order of edges."""
    return edges.groupBy("c").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("c", "e.*")


def _foreign_edge(q: dict, p: dict):
    """Kernel: per component of the queries its lightest edge to another component, within the component's bound."""
    comps, own = np.unique(q["c"], return_inverse=True)
    limit = np.full(len(comps), np.inf)
    np.minimum.at(limit, own, q["bound"])
    best: dict[int, tuple] = {}

    def bound(at: np.ndarray) -> np.ndarray:
        most = limit[own[at]]
        return np.where(q["core"][at] <= most, most, -1.0)  # an edge is no lighter than the core distance

    squares = Squares(q["v"], p["v"])

    def compare(at: np.ndarray, rows: np.ndarray) -> None:
        most, c = limit[own[at]], q["c"][at]
        one = (c == c[0]).all()
        rows = rows[(p["core"][rows] <= most.max()) & ((p["c"][rows] != c[0]) | (not one))]
        if not len(rows):
            return
        sq = squares(at, rows)
        if not one:
            sq[c[:, None] == p["c"][rows][None, :]] = np.inf
        found = np.flatnonzero(sq <= squares.most(most, at)[:, None])
        if len(found) > 2 * len(at):  # what a component's points reach here bounds them all
            reach = np.maximum(np.maximum(sq + 2 * squares.loss[at, None], (p["core"][rows] ** 2)[None, :]).min(axis=1), q["core"][at] ** 2)
            here, which = np.unique(own[at], return_inverse=True)
            least = limit[here]
            np.minimum.at(least, which, np.sqrt(np.maximum(reach, 0.0)) * (1 + SLACK))
            found = np.flatnonzero(sq <= squares.most(least[which], at)[:, None])
        i, j = np.divmod(found, len(rows))
        of, to = at[i], rows[j]
        w = np.maximum(np.maximum(exact_distance(q["v"][of], p["v"][to]), p["core"][to]), q["core"][of])
        ok = (w <= limit[own[of]]) & (q["c"][of] != p["c"][to])
        if not ok.any():
            return
        of, to, w = of[ok], to[ok], w[ok]
        lo, hi = np.minimum(p["n"][to], q["n"][of]), np.maximum(p["n"][to], q["n"][of])
        order = np.lexsort((hi, lo, w, own[of]))
        here, first = np.unique(own[of][order], return_index=True)
        for k, b in zip(here.tolist(), order[first]):
            best[k] = min(best.get(k, (np.inf,)), (float(w[b]), int(lo[b]), int(hi[b])))
            limit[k] = min(limit[k], best[k][0])

    def result() -> pa.Table:
        edges = [best[k] for k in best]
        kinds = (pa.float64(), pa.int64(), pa.int64())
        return pa.table({"c": pa.array(comps[list(best)], pa.int64()), **{x: pa.array([e[i] for e in edges], t) for i, (x, t) in enumerate(zip(("w", "lo", "hi"), kinds))}})
    return bound, compare, result


def _search_open(index: BlockIndex, comp: DataFrame, facts: DataFrame, best: DataFrame, n_comp: int) -> DataFrame:
    """Edges found by searching the points whose neighbour list does not settle their component's lightest edge."""
    small_best = broadcast_if_small(best.select("c", F.col("w").alias("bound")), n_comp, 32)
    state = facts.join(comp, "n")
    open_pts = state.join(small_best, "c", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    open_pts = open_pts.filter(F.col("r") <= F.col("bound")).select("n", "c", "core", "bound")
    open_pts = materialise(open_pts)
    if open_pts.isEmpty():
        return best
    pts = index.points.join(state.select("n", "c", "core"), "n").select("n", "v", "block", "c", "core")
    pts = materialise(pts)
    owner = np.full(len(index.cell), -1)
    for r in pts.groupBy("block").agg(F.min("c").alias("a"), F.max("c").alias("b")).collect():  # one row per block
        owner[r["block"]] = r["a"] if r["a"] == r["b"] else -1
    foreign = lambda q, blocks: q["c"][:, None] != owner[blocks]
    queries = open_pts.join(pts.select("n", "v"), "n")
    points = pts.select("n", "v", "block", "c", "core")
    schema = "c long, w double, lo long, hi long"

    def run(q: DataFrame, nearest_only: bool) -> DataFrame | None:
        return index.search(index.targets(q, foreign, nearest_only), points, _foreign_edge, schema, _lightest, foreign)

    unbounded = queries.filter(F.col("bound") == float("inf"))
    if not unbounded.isEmpty():
        # one block gives every such component a first bound
        first = run(unbounded, True)
        if first is not None:
            best = materialise(_lightest(best.unionByName(first)))
            bound = broadcast_if_small(best.select("c", F.col("w").alias("known")), n_comp, 32)
            queries = (queries.join(bound, "c", "left")
                       .withColumn("bound", F.least("bound", F.coalesce("known", F.lit(float("inf"))))).drop("known"))
    # a point whose own reach exceeds the bound cannot improve it
    more = run(queries.filter(F.col("core") <= F.col("bound")), False)
    if more is not None:
        best = materialise(_lightest(best.unionByName(more)))
        discard(more)
    discard(open_pts, pts)
    return best


def spanning_tree(index: BlockIndex, count: int, min_samples: int, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """(tree edges (lo, hi, w), vertices (n, m, core))."""
    k = max(neighbours, min_samples)
    known = nearest_neighbours(index, k)
    known = materialise(known.withColumn("core", _core(F.col("near"), F.col("m"), min_samples)))
    full = F.size("near") == k
    facts = known.select("n", "core", F.when(
        full, F.greatest(F.col("core"), F.element_at("near", -1)["d"])).otherwise(F.lit(float("inf"))).alias("r"))
    near = known.select(F.col("n").alias("a"), F.col("core").alias("core_a"), F.inline("near")).withColumnRenamed("n", "b")
    core_b = known.select(F.col("n").alias("b"), F.col("core").alias("core_b"))
    edges = materialise(near.join(core_b, "b").select(
        F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"),
        F.greatest("core_a", "core_b", "d").alias("w")).distinct())
    comp = known.select("n", F.col("n").alias("c"))
    n_comp, tree = count, None
    while n_comp > 1:
        old = edges, comp
        at = lambda end, c: comp.select(F.col("n").alias(end), F.col("c").alias(c))
        edges = materialise(edges.select("lo", "hi", "w").join(at("lo", "c1"), "lo").join(at("hi", "c2"), "hi")
                            .filter(F.col("c1") != F.col("c2")))
        both = edges.select("w", "lo", "hi", F.explode(F.array("c1", "c2")).alias("c"))
        listed = materialise(_lightest(both))
        searched = _search_open(index, comp, facts, listed, n_comp)
        best = materialise(searched.join(at("lo", "c1"), "lo").join(at("hi", "c2"), "hi"))
        if n_comp <= IN_TASK_COMPONENTS:
            merged = best.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(
                _merge_in_task, "kind int, a long, b long, w double")
        else:
            merged = _merge_by_jumps(best)
        merged = materialise(merged)
        kept = merged.filter("kind = 1").select(F.col("a").alias("lo"), F.col("b").alias("hi"), "w")
        roots = merged.filter("kind = 0").select(F.col("a").alias("c"), F.col("b").alias("root"))
        tree = kept if tree is None else tree.unionByName(kept)
        comp = materialise(comp.join(broadcast_if_small(roots, n_comp, 24), "c").select("n", F.col("root").alias("c")))
        n_comp = roots.select("root").distinct().count()
        discard(*old, listed, searched, best)
    if tree is None:
        tree = edges.select("lo", "hi", "w").limit(0)
    return tree, known.select("n", "m", "core")


# ---- condensed tree ------------------------------------------------------------------------------------------

STATE = "rep long, size double, cluster long, mass double, best double"


def _condense_band(min_size: int, band: int):
    """Merge one band of edges in order.

    Input rows are edges (kind 0) and the state of every component they touch (kind 1). Output rows: the new component
    of each touched one with the cluster it fell into, if any (kind 0); new component states (kind 1); clusters that
    ended because two of them met (kind 2).
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        st = pdf[pdf["kind"] == 1]
        size = dict(zip(st["rep"], st["size"]))
        cluster = dict(zip(st["rep"], st["cluster"]))
        mass = dict(zip(st["rep"], st["mass"]))
        best = dict(zip(st["rep"], st["best"]))
        loose = {r: [r] for r in st["rep"] if cluster[r] < 0}
        fell: dict[int, int] = {}
        sets, ended, made = _Sets(), [], 0
        edges = pdf[pdf["kind"] == 0].sort_values(["w", "lo", "hi"])
        for a, b, w in edges[["ra", "rb", "w"]].itertuples(index=False):
            a, b = sets.find(int(a)), sets.find(int(b))
            lam = 1.0 / max(w, LEAST_DISTANCE)
            ca, cb = cluster[a], cluster[b]
            total = size[a] + size[b]
            if ca >= 0 and cb >= 0:
                new = (band << 40) + made
                made += 1
                held = 0.0
                for r, c in ((a, ca), (b, cb)):
                    stable = mass[r] - size[r] * lam
                    chosen = stable >= best[r]
                    held += max(stable, best[r])
                    ended.append((c, new, w, chosen))
                m, h = total * lam, held
            elif ca >= 0 or cb >= 0:
                big, few = (a, b) if ca >= 0 else (b, a)
                new, m, h = cluster[big], mass[big] + size[few] * lam, best[big]
                fell.update((r, new) for r in loose.pop(few))
            elif total >= min_size:
                new = (band << 40) + made
                made += 1
                m, h = total * lam, 0.0
                fell.update((r, new) for x in (a, b) for r in loose.pop(x))
            else:
                new, m, h = -1, 0.0, 0.0
            sets.join(a, b)
            root = sets.find(a)
            if new < 0:
                loose[root] = loose.pop(a) + loose.pop(b)
            size[root], cluster[root], mass[root], best[root] = total, new, m, h
        cols = ["kind", "rep", "to", "size", "cluster", "mass", "best", "w", "chosen"]
        rows = [(0, r, sets.find(r), 0.0, fell.get(r, -1), 0.0, 0.0, 0.0, False) for r in st["rep"]]
        rows += [(1, r, r, size[r], cluster[r], mass[r], best[r], 0.0, False) for r in {sets.find(x) for x in st["rep"]}]
        rows += [(2, c, p, 0.0, c, 0.0, 0.0, w, bool(s)) for c, p, w, s in ended]
        return pd.DataFrame(rows, columns=cols)
    return run


def _condense(tree: DataFrame, vertices: DataFrame, count: int, min_size: int,
              band_edges: int) -> tuple[DataFrame, DataFrame]:
    """(vertex -> lowest cluster it belongs to or -1, ended clusters (cluster, parent, birth, chosen))."""
    tree = materialise(dense_index(tree, ["w", "lo", "hi"], "k"))
    alone = F.col("m") >= min_size  # a vertex of many copies is a cluster from the start
    own = F.when(alone, F.col("n") + (1 << 60)).otherwise(F.lit(-1))
    lam = 1.0 / F.greatest(F.col("core"), F.lit(LEAST_DISTANCE))
    state = vertices.select(
        F.col("n").alias("rep"), F.col("m").cast("double").alias("size"), own.cast("long").alias("cluster"),
        F.when(alone, F.col("m") * lam).otherwise(F.lit(0.0)).alias("mass"), F.lit(0.0).alias("best"))
    where = materialise(vertices.select("n", F.col("n").alias("rep"), own.cast("long").alias("cluster")))
    ended = None
    out = "kind int, rep long, to long, size double, cluster long, mass double, best double, w double, chosen boolean"
    bands = max(1, -(-(count - 1) // band_edges))
    for band in range(bands):
        part = tree.filter((F.col("k") >= band * band_edges) & (F.col("k") < (band + 1) * band_edges))
        end = lambda e, r: where.select(F.col("n").alias(e), F.col("rep").alias(r))
        part = part.join(end("lo", "ra"), "lo").join(end("hi", "rb"), "hi")
        touched = part.select(F.explode(F.array("ra", "rb")).alias("rep")).distinct()
        rows = part.select(F.lit(0).alias("kind"), "lo", "hi", "w", "ra", "rb").unionByName(
            state.join(touched, "rep").withColumn("kind", F.lit(1)), allowMissingColumns=True)
        # at most band_edges edges and twice as many states
        done = materialise(rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_condense_band(min_size, band), out))
        moves = done.filter("kind = 0").select("rep", "to", F.col("cluster").alias("fell"))
        moves = broadcast_if_small(moves, 2 * band_edges, 24)
        before = where
        where = materialise(where.join(moves, "rep", "left").select(
            "n", F.coalesce("to", "rep").alias("rep"),
            F.when(F.col("cluster") >= 0, F.col("cluster")).otherwise(F.coalesce("fell", F.lit(-1))).alias("cluster")))
        fresh = done.filter("kind = 1").select("rep", "size", "cluster", "mass", "best")
        if bands > 1:
            left = state
            state = materialise(state.join(touched, "rep", "left_anti").unionByName(fresh))
            discard(left)
        discard(before)
        closed = done.filter("kind = 2").select(
            "cluster", F.col("to").alias("parent"), F.col("w").alias("birth"), "chosen")
        ended = closed if ended is None else ended.unionByName(closed)
    return where.select("n", "cluster"), materialise(ended)


def _highest_marked(nodes: DataFrame) -> DataFrame:
    """(cluster, top): the highest marked cluster at or above each, by doubling pointers; NULL if none.

    ``nodes`` is (cluster, parent, marked); a parent that is not itself a node counts as none.
    """
    cur = materialise(nodes.select("cluster", F.col("parent").alias("up"), F.when(F.col("marked"), F.col("cluster")).alias("top")))
    while True:
        above = cur.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        cur = materialise(cur.join(above, "up", "left").select(
            "cluster", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")))
        if cur.filter(F.col("up").isNotNull()).isEmpty():
            return cur.select("cluster", "top")


def _select(ended: DataFrame, epsilon: float) -> DataFrame:
    """(cluster, final): the selected cluster each condensed cluster belongs to. The root is never selected."""
    tops = _highest_marked(ended.select("cluster", "parent", F.col("chosen").alias("marked")))
    if epsilon > 0:
        # climb from a selected cluster born below epsilon to the first ancestor born at or above it, short of the root
        parents = ended.select(F.col("cluster").alias("parent"), F.lit(True).alias("inner"))
        step = ended.join(parents, "parent", "left").select("cluster", F.when(
            (F.col("birth") < epsilon) & F.col("inner"), F.col("parent")).otherwise(F.col("cluster")).alias("to"))
        step = materialise(step)
        while True:
            nxt = step.select(F.col("cluster").alias("to"), F.col("to").alias("to2"))
            moved = materialise(step.join(nxt, "to").select(
                "cluster", F.col("to2").alias("to"), (F.col("to2") != F.col("to")).alias("moved")))
            step = moved.select("cluster", "to")
            if moved.filter("moved").isEmpty():
                break
        final = (tops.filter("top = cluster").select("cluster").join(step, "cluster")
                 .select(F.col("to").alias("cluster"), F.lit(True).alias("marked")).distinct())
        nodes = ended.select("cluster", "parent").join(final, "cluster", "left").select(
            "cluster", "parent", F.coalesce("marked", F.lit(False)).alias("marked"))
        tops = _highest_marked(nodes)
    return tops.filter(F.col("top").isNotNull()).select("cluster", F.col("top").alias("final"))


@dataclass
class Clusters:
    """What density clustering finds: ``vertices`` (n, v, m, first, core, node, cluster), one a distinct vector, where ``node``
    is the lowest node of the condensed tree that it belongs to and ``cluster`` its label; ``tree`` (node, parent, birth,
    cluster), where ``birth`` is the distance at which a node splits off and ``cluster`` the label that it lies in."""

    vertices: DataFrame
    tree: DataFrame
    count: int


def find_clusters(df: DataFrame, id_col: str, vec_col: str, min_cluster_size: int = 35, min_samples: int = 4, epsilon: float = 0.25,
                  neighbours: int = 12, block_rows: int = 2048, band_edges: int = 1_000_000) -> Clusters:
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    distinct = rows.groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m"))
    verts = materialise(dense_index(distinct, ["first"], "n"))
    count = verts.count()
    index = BlockIndex.build(verts.select("n", "m", "v"), count, block_rows)
    tree, facts = spanning_tree(index, count, min_samples, neighbours)
    where, ended = _condense(tree, facts, count, min_cluster_size, band_edges)
    final = _select(ended, epsilon)
    labelled = materialise(where.join(final, "cluster", "left").select("n", F.col("cluster").alias("node"), "final"))
    names = materialise(dense_index(labelled.filter(F.col("final").isNotNull()).groupBy("final").agg(F.min("n").alias("n")),
                                    ["n"], "label").select("final", F.col("label").cast("int").alias("label")))
    label = labelled.join(names, "final", "left").select("n", "node", F.coalesce("label", F.lit(-1)).alias("cluster"))
    vertices = materialise(verts.join(facts.select("n", "core"), "n").join(label, "n").select("n", "v", "m", "first", "core", "node", "cluster"))
    nodes = ended.join(final, "cluster", "left").join(names, "final", "left").select(
        F.col("cluster").alias("node"), "parent", "birth", F.coalesce("label", F.lit(-1)).alias("cluster"))
    return Clusters(vertices, nodes, count)


def labels_of(df: DataFrame, id_col: str, vec_col: str, found: Clusters) -> DataFrame:
    """(id, cluster) of the rows that the clusters were found in."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    keyed = found.vertices
    lone = keyed.filter("m = 1").select(F.col("first").alias("id"), "cluster")
    heavy = keyed.filter(F.col("m") > HEAVY_COPIES).select("v", "cluster")
    shared = keyed.filter((F.col("m") > 1) & (F.col("m") <= HEAVY_COPIES)).select("v", "cluster")
    out = lone
    if not keyed.filter(F.col("m") > 1).isEmpty():
        out = out.unionByName(rows.join(shared, "v").select("id", "cluster"))
        n_heavy = heavy.count()
        if n_heavy:
            dim = keyed.select(F.size("v")).first()[0]
            out = out.unionByName(rows.join(broadcast_if_small(heavy, n_heavy, 8 * dim + 16), "v").select("id", "cluster"))
    return out.select(F.col("id").alias(id_col), "cluster")


def hdbscan(df: DataFrame, id_col: str, vec_col: str, min_cluster_size: int = 35, min_samples: int = 4,
            epsilon: float = 0.25, neighbours: int = 12, block_rows: int = 2048,
            band_edges: int = 1_000_000) -> DataFrame:
    """(id, cluster): clusters numbered by their lowest member, noise -1. Euclidean distance, excess of mass."""
    return labels_of(df, id_col, vec_col, find_clusters(df, id_col, vec_col, min_cluster_size, min_samples, epsilon, neighbours, block_rows, band_edges))
