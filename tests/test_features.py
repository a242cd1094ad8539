import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from driftline.operators import checks, correlate, density, exemplars, paths, profile
from driftline.operators.clusterer import Clusterer
from driftline.operators.coding import Coder
from driftline.operators.neighbours import BlockIndex, nearest_neighbours
from driftline.operators.ordering import dense_index
from driftline.operators.scaling import Scaler


def frame(spark, x, **cols):
    rows = [(i, [float(v) for v in r], *[int(c[i]) for c in cols.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {c} int" for c in cols))


def blobs(rng):
    parts = [rng.normal(c, s, (m, 3)) for c, s, m in
             [((0, 0, 0), .3, 60), ((4, 0, 0), .4, 70), ((4, 1.6, 0), .3, 50), ((0, 5, 5), 1.0, 40)]]
    x = np.concatenate([*parts, rng.uniform(-3, 8, (40, 3))])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("epsilon,neighbours,block,band,copies", [(0.0, 12, 2048, 10**6, 0), (0.5, 4, 30, 37, 30)])
def test_density_clusters(spark, epsilon, neighbours, block, band, copies):
    """One block and one band, and the same through many blocks, bands and copies of one vector."""
    x = blobs(np.random.default_rng(1))
    x = np.concatenate([x, np.repeat(x[:1], copies, 0), np.repeat(x[100:101], copies // 6, 0)])
    got = density.hdbscan(frame(spark, x), "id", "v", 15, 4, epsilon, neighbours, block, band).orderBy("id").collect()
    assert [r.id for r in got] == list(range(len(x)))
    assert plain.same_partition(plain.hdbscan(x, 15, 4, epsilon), [r.cluster for r in got])


def entered(model, x, k):
    """(cluster, strength) of a new vector by looking at every training vector and climbing node by node."""
    vertices, tree = model
    d = [(np.sqrt(((x - np.array(p.v)) ** 2).sum()), p) for p in vertices]
    same = [p for e, p in d if e == 0]
    if same:
        best, reach = same[0], same[0].core
    else:
        core = sorted(e for e, p in d for _ in range(p.m))[k - 1]
        g, _, best = min((max(e, p.core), p.n, p) for e, p in d)
        reach = max(core, g)
    node = best.node
    while node in tree and reach > tree[node].birth:
        node = tree[node].parent
    cluster = tree[node].cluster if node in tree else -1
    least = min((p.core for p in vertices if p.cluster == cluster), default=0)
    return cluster, 0.0 if cluster < 0 else max(least, 1e-12) / max(reach, least, 1e-12)


@pytest.mark.parametrize("epsilon,block", [(0.0, 30), (0.5, 2048)])
def test_saved_clusterer(spark, tmp_path, epsilon, block):
    rng = np.random.default_rng(1)
    x = blobs(rng)
    x = np.concatenate([x, np.repeat(x[:1], 20, 0)])
    df = frame(spark, x)
    made = Clusterer.fit(df, "id", "v", 15, 4, epsilon, block_rows=block)
    made.save(f"{tmp_path}/model")
    model = Clusterer.load(spark, f"{tmp_path}/model")
    own = {r.id: r.cluster for r in model.labels(df, "id", "v").collect()}
    assert plain.same_partition(plain.hdbscan(x, 15, 4, epsilon), [own[i] for i in range(len(x))])
    back = {r.id: r.cluster for r in model.assign(df, "id", "v", block).collect()}
    assert back == own  # training vectors get their own labels
    new = np.concatenate([x[:60] + rng.normal(0, 0.05, (60, 3)), rng.uniform(-4, 9, (60, 3)), [[100, 100, 100]], x[7:9]])
    asked = frame(spark, new).unionByName(spark.createDataFrame([(900, None)], "id long, v array<double>"))
    got = {r.id: (r.cluster, r.strength) for r in model.assign(asked, "id", "v", block).collect()}
    tables = model.vertices.collect(), {r.node: r for r in model.tree.collect()}
    for i, v in enumerate(new):
        cluster, strength = entered(tables, v, 4)
        assert got[i][0] == cluster and got[i][1] == pytest.approx(strength), i
    assert got[900] == (-1, 0.0) and len({c for c, _ in got.values()}) > 2
    assert model.assign(df.limit(0), "id", "v").count() == 0


def test_merging_by_pointer_jumps_gives_the_same_components(spark):
    rng = np.random.default_rng(5)
    pos = np.sort(rng.uniform(0, 1, 200))
    edges = []
    for i in range(200):
        near = min((j for j in (i - 1, i + 1) if 0 <= j < 200), key=lambda j: abs(pos[j] - pos[i]))
        edges.append((i, float(abs(pos[near] - pos[i])), min(i, near), max(i, near), min(i, near), max(i, near)))
    best = spark.createDataFrame(edges, "c long, w double, lo long, hi long, c1 long, c2 long")
    a = density._merge_by_jumps(best).collect()
    b = best.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(
        density._merge_in_task, "kind int, a long, b long, w double").collect()
    part = lambda rows: [r.b for r in sorted(rows, key=lambda r: r.a) if r.kind == 0]
    assert plain.same_partition(part(a), part(b))
    assert {(r.a, r.b) for r in a if r.kind == 1} == {(r.a, r.b) for r in b if r.kind == 1}


def test_neighbours_are_exact(spark):
    x = np.random.default_rng(2).normal(size=(300, 4))
    pts = dense_index(frame(spark, x).select("id", "v", F.lit(1).cast("long").alias("m")), ["id"], "n").select("n", "m", "v")
    index = BlockIndex.build(pts, 300, 40)
    assert len(index.cell) > 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for r in nearest_neighbours(index, 5).collect():
        assert [e["n"] for e in r.near] == list(np.argsort(d[r.n])[:5])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("in_task", [4096, 15])
def test_exemplars(spark, metric, in_task):
    rng = np.random.default_rng(7)
    x, c = rng.normal(size=(150, 5)), rng.choice([-1, 0, 1, 1, 1, 1], 150)
    x, c = np.concatenate([x, [[9, 9, 9, 9, 9.]], [[1, 1, 1, 1, 1.]] * 2]), np.concatenate([c, [7, 8, 8]])
    df = frame(spark, x, cluster=c)
    got = {r.cluster: (r.typical, r.extreme) for r in exemplars.find_exemplars(df, "id", "v", metric=metric, in_task=in_task).collect()}
    want = {}
    for k in set(c) - {-1, 7}:
        ids = np.flatnonzero(c == k)
        diff = np.abs(x[ids][:, None] - x[ids][None])
        d = (np.sqrt((diff ** 2).sum(-1)) if metric == "euclidean" else diff.sum(-1)).mean(1).round(9)
        want[k] = (ids[d.argmin()], ids[d.argmax()])
    assert got == want and want[8] == (151, 151)
    out = exemplars.label_exemplars(df, exemplars.find_exemplars(df, "id", "v", metric=metric, in_task=in_task), "id")
    assert out.count() == len(x)
    checks.require(checks.exemplar_faults(out), "exemplars")


def test_scaler_and_outliers(spark, tmp_path):
    x = np.random.default_rng(3).normal(5, 2, (200, 4))
    x[:, 2] = 1.5
    x[0, 0] = 60
    df = frame(spark, x)
    sc = Scaler.fit(df, "v")
    assert np.allclose(sc.mean, x.mean(0)) and np.allclose(sc.std, x.std(0))
    z = np.array([r.v for r in sc.transform(df, "v").orderBy("id").collect()])
    assert np.allclose(z[:, [0, 1, 3]], ((x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1))[:, [0, 1, 3]])
    assert (z[:, 2] == 0).all()
    back = np.array([r.v for r in sc.inverse(sc.transform(df, "v"), "v").orderBy("id").collect()])
    assert np.allclose(back, x)
    assert {r.id for r in df.join(sc.drop_outliers(df, "v"), "id", "left_anti").collect()} == {0}
    sc.save(spark, f"{tmp_path}/s")
    assert Scaler.load(spark, f"{tmp_path}/s") == sc


def test_codes(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 8)) + rng.normal(scale=.05, size=(120, 8))
    df = frame(spark, x)
    coder = Coder.fit(df, "v", 4)
    back = np.array([r.reconstructed for r in coder.decode(coder.encode(df, "v")).orderBy("id").collect()])
    err = (((back - x) / x.std(0)) ** 2).mean(1)
    assert np.allclose(err, [r.error for r in coder.with_error(df, "v").orderBy("id").collect()])
    report = coder.size_report(df, "v", [1, 2, 3, 4]).orderBy("code_size").collect()
    errors = [r.mean_error for r in report]
    assert errors == sorted(errors, reverse=True) and math.isclose(errors[-1], err.mean(), rel_tol=1e-6)
    assert coder.most_anomalous(df, "v", "id", 1).first().id == int(err.argmax())
    coder.save(spark, f"{tmp_path}/c")
    again = Coder.load(spark, f"{tmp_path}/c")
    assert np.allclose(again.components, coder.components)


@pytest.mark.parametrize("rows", [10**6, 60, 25])
def test_kendall(spark, rows):
    """Whole in one task, cut into ranges, and ranges cut again; a third of x is one value."""
    rng = np.random.default_rng(6)
    x = np.where(rng.random(400) < .33, 2.0, rng.normal(size=400).round(2))
    y = (x + rng.normal(size=400)).round(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = correlate.kendall(df, ["x", "y"], 10, group_rows=rows).first().correlation
    assert math.isclose(got, plain.kendall(x, y), abs_tol=1e-9)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    for f in (correlate.pearson, correlate.spearman, correlate.kendall):
        r = {(r.var_1, r.var_2): r.correlation for r in f(df, ["x", "y"]).collect()}
        assert r[("x", "y")] is None
    assert correlate.strong_pairs(correlate.pearson(df, ["x", "y"]), 0.9).count() == 0


def test_quantiles_per_key_with_few_ranges(spark):
    rng = np.random.default_rng(8)
    k = rng.choice(3, 500, p=[.8, .15, .05])
    v = np.where(rng.random(500) < .4, 1.0, rng.normal(size=500))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(k, v)], "k int, v double")
    for r in profile.quantiles(df, ["k"], ["v"], [0.0, 0.1, 0.5, 0.99, 1.0], blocks=5).collect():
        assert math.isclose(r.value, np.quantile(v[k == r.k], r.prob), abs_tol=1e-12)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x, 0.0) for x in (-180.0, 180.0, 179.999, 180.001, -200.0, 0.0)], "x double, y double")
    got = {r.bin_x: r.n for r in profile.histogram_2d(df, "x", "y").collect()}
    assert got == {0: 1, 149: 2, 75: 1}


def test_paths(spark):
    n = 6
    east = ([90.0] * n, [10.0] * n, [100.0 + i for i in range(n)], [i * 1_000_000 for i in range(n)])
    short = ([0.0, 0.0], [1.0, 1.0], [5.0, 6.0], [0, 2_000_000])
    df = spark.createDataFrame([(1, *east), (2, *short)],
                               "id int, headings array<double>, ground_speeds array<double>, altitudes array<double>, time_offsets array<bigint>")
    p = paths.dead_reckon(df, ["id"])
    x = [r.x for r in paths.path_points(p, ["id"]).filter("id = 1").orderBy("point_idx").collect()]
    assert x == [0.0, 10.0, 30.0, 60.0, 100.0, 150.0]
    step = [r.x for r in paths.path_points(paths.dead_reckon(df, ["id"], "delta"), ["id"]).filter("id = 1").orderBy("point_idx").collect()]
    assert step == [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]
    rot = paths.path_points(paths.rotate_to_y(p, ["id"]), ["id"]).orderBy("id", "point_idx").collect()
    assert all(abs(r.x) < 1e-9 for r in rot) and [round(r.y, 6) for r in rot if r.id == 1] == x
    assert [r.z for r in rot if r.id == 2] == [5.0, 6.0]
    labels = spark.createDataFrame([(1, 0), (3, -1)], "id int, cluster int")
    out = paths.label_paths(labels, p, "id")
    assert out.filter("id = 1").count() == n and out.filter("id = 3").count() == 1
    with pytest.raises(checks.CheckFailed):
        checks.require(checks.join_size(labels, out, n), "rows per label")
    checks.require_columns(out, ["id", "cluster", "x"])
    with pytest.raises(checks.CheckFailed):
        checks.require_columns(out, ["nothing"])


def test_kendall_makes_as_many_jobs_at_any_group_size(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).cast("double").alias("x"), (F.col("id") * 104729 % 2999).cast("double").alias("y"))
    jobs, values = [], []
    for rows in (10**6, 50):
        spark.sparkContext.setJobGroup(f"kendall-{rows}", "")
        values.append(correlate.kendall(df, ["x", "y"], 10, rows).first().correlation)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"kendall-{rows}")))
    assert values[0] == values[1] and jobs[0] == jobs[1] < 20


def test_signed_zeros_are_one_value(spark):
    rng = np.random.default_rng(2)
    x, y = rng.choice([-0.0, 0.0, 1.0, -1.0, 2.0], 200), rng.normal(size=200).round(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert math.isclose(correlate.kendall(df, ["x", "y"], 10, 40).first().correlation, plain.kendall(x + 0.0, y + 0.0), abs_tol=1e-9)
    ranks = [np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v]) for v in (x, y)]
    assert math.isclose(correlate.spearman(df, ["x", "y"], 10, blocks=9).first().correlation, np.corrcoef(*ranks)[0, 1], abs_tol=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_exemplar_blocks_do_not_shrink_with_the_limit_of_one_task(spark, metric, monkeypatch):
    """400 members over a limit of 5: not 80 times 80 groups but one; cut into blocks, the exemplars stay the same."""
    x = np.random.default_rng(12).normal(size=(400, 3)).round(2)
    df = frame(spark, x, cluster=np.zeros(400, int))
    diff = np.abs(x[:, None] - x[None])
    d = (np.sqrt((diff ** 2).sum(-1)) if metric == "euclidean" else diff.sum(-1)).mean(1).round(9)
    groups = spark.sparkContext.accumulator(0)
    sums = exemplars._block_sums(metric)

    def counted(cand, block):
        groups.add(1)
        return sums(cand, block)

    monkeypatch.setattr(exemplars, "_block_sums", lambda metric: counted)
    for block_rows in (None, 150):
        got = exemplars.find_exemplars(df, "id", "v", metric=metric, in_task=5, block_rows=block_rows).first()
        assert (got.typical, got.extreme) == (d.argmin(), d.argmax())
        assert groups.value <= (1 if block_rows is None else 10)


def test_manhattan_sums_by_order():
    rng = np.random.default_rng(13)
    x, y = rng.normal(1e4, 2, (70, 6)).round(1), rng.normal(1e4, 2, (90, 6)).round(1)
    y[:30] = y[0]
    assert np.allclose(exemplars._sums_by_order(x, y), np.abs(x[:, None] - y[None]).sum((1, 2)), rtol=0, atol=1e-9)


def test_kendall_counts_of_range_pairs_are_split_over_groups(spark):
    """200 ranges of each column: no group holds more than a strip of their pairs, and the score is that of all pairs."""
    rng = np.random.default_rng(14)
    x = rng.permutation(3000).astype(float)
    y = np.round(x + rng.normal(0, 900, 3000), 0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    cuts = correlate.value_blocks(df, ["x", "y"], 200)
    wide = cuts["y"].assign(cuts["x"].assign(df, "_b_x"), "_b_y")
    parts = correlate._score_parts(correlate._weighted_pairs(wide, ["x", "y"], {"x": "_b_x", "y": "_b_y"}))
    largest = parts.groupBy("pair", "kind", "g").count().agg(F.max("count")).first()[0]
    assert largest < 1500  # about 2900 pairs of ranges hold rows
    assert math.isclose(correlate.kendall(df, ["x", "y"], 10, 30).first().correlation, plain.kendall(x, y), abs_tol=1e-9)


def test_search_sends_a_query_once_per_group_of_blocks(spark):
    """Fifty blocks in few groups: rows sent follow the groups; tables that no result reads are deleted."""
    x = np.random.default_rng(15).normal(size=(500, 6))
    pts = frame(spark, x).selectExpr("id AS n", "1L AS m", "v")
    index = BlockIndex.build(pts, 500, 10, group_rows=250)
    assert len(index.cell) >= 50 and index.group.max() <= 2
    queries = index.targets(pts.selectExpr("n", "v", "double('inf') AS bound")).selectExpr("size(targets) AS k")
    assert queries.agg(F.max("k")).first()[0] <= 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for r in nearest_neighbours(index, 5).collect():
        assert [e["n"] for e in r.near] == list(np.argsort(d[r.n])[:5])


def test_clustering_deletes_tables_of_past_rounds(spark):
    from driftline import session
    x = blobs(np.random.default_rng(1))
    held = lambda: set(session._scratch.get(spark.sparkContext.applicationId, []))
    before = held()
    got = density.hdbscan(frame(spark, x), "id", "v", 15, 4, 0.0, 4, 30).orderBy("id").collect()
    assert plain.same_partition(plain.hdbscan(x, 15, 4, 0.0), [r.cluster for r in got])
    made = held() - before
    assert all(os.path.exists(p.removeprefix("file:")) for p in made) and len(made) < 40, len(made)


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-13, 0.0), (1e18, 0.0), (1.0, 1e6)])
def test_close_queries_meet_near_leaves_only(scale, shift):
    """Nearest neighbours inside a task are exact, ties and copies included, and most rows are never compared."""
    from driftline.operators import neighbours
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12000, 3))
    x[100:140] = x[100]
    x = scale * np.round(x, 2 if scale == 1 else 9) + shift
    n = np.arange(len(x))
    q = {"n": n, "m": n * 0 + 1, "v": x, "block": n % 2, "bound": np.full(len(x), np.inf), "only": n * 0 - 1}
    bound, compare, result = neighbours._nearer(4, True)(q, q)
    seen = []

    def counted(at, rows):
        seen.append(len(at) * len(rows))
        compare(at, rows)
    got = neighbours.meet(q, q, (bound, counted, result), x[:2], np.arange(2), np.full(2, np.inf)).to_pylist()
    for r in got[::97] + got[100:140:9]:
        d = neighbours.exact_distance(x, x[r["n"]])
        d[r["n"]] = np.inf
        assert [e["n"] for e in r["near"]] == list(np.lexsort((n, d))[:4])
    if scale == 1:
        assert sum(seen) < 0.4 * len(x) ** 2


def test_groups_of_blocks_lie_side_by_side(spark):
    """Vectors on a line: a group is a stretch of it, not a choice of cells from all over it."""
    x = np.random.default_rng(8).uniform(size=(2000, 1))
    index = BlockIndex.build(frame(spark, x).selectExpr("id AS n", "1L AS m", "v"), 2000, 20, group_rows=500)
    of = {r["n"]: index.group[r["block"]] for r in index.points.select("n", "block").collect()}
    group = np.array([of[i] for i in range(2000)])
    assert len(np.unique(group)) >= 4
    assert sum(np.ptp(x[group == g]) for g in np.unique(group)) < 1.2


def test_edge_to_another_component_is_the_lightest():
    """The kernel finds what all pairs give, for queries of one component and of several, bounded or not."""
    from driftline.operators import neighbours
    rng = np.random.default_rng(6)
    x, core = np.round(rng.normal(size=(400, 2)), 1), rng.uniform(0.1, 0.6, 400)
    for c in (rng.integers(0, 9, 400), (x[:, 0] > 0).astype(int)):
        for most in (np.inf, 0.7):
            n = np.arange(400)
            q = {"n": n, "c": c, "core": core, "v": x, "block": n * 0, "bound": np.full(400, most), "only": n * 0 - 1}
            got = neighbours.meet(q, q, density._foreign_edge(q, q), x[:1], np.arange(1), np.full(1, np.inf)).to_pylist()
            w = np.maximum(np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), core[:, None]), core[None])
            for k in np.unique(c):
                a, b = np.nonzero((c == k)[:, None] & (c != k)[None])
                want = min(zip(w[a, b].tolist(), np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
                found = [(r["w"], r["lo"], r["hi"]) for r in got if r["c"] == k]
                assert found == ([want] if want[0] <= most else [])
