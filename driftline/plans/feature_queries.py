"""Scaling, codes, clusters and exemplars over ``embeddings`` (its label serves as the cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import density, exemplars, moments, summaries, windows
from driftline.operators.clusterer import Clusterer
from driftline.operators.coding import Coder
from driftline.operators.scaling import Scaler
from driftline.plans.registry import query, table
from driftline.session import materialise, scratch_path


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


STATS_SQL = """
WITH v AS (SELECT vec_id, label, i AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
s AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM v GROUP BY 1),
z AS (SELECT v.vec_id, v.label, v.dim, v.x, CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0 END AS z
      FROM v JOIN s USING (dim))
"""


@query(STATS_SQL + "SELECT vec_id, dim - 1 AS dim, round(z, 6) + 0.0 AS z FROM z")
def standardise(spark, sf_dir):
    e = vectors(spark, sf_dir)
    z = Scaler.fit(e, "embedding").transform(e, "embedding")
    return z.select("vec_id", F.posexplode("embedding").alias("dim", "z")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), (F.round("z", 6) + 0.0).alias("z"))


@query(STATS_SQL + "SELECT vec_id, round(sum(x * dim), 6) AS checksum FROM v GROUP BY 1")
def inverse_standardise(spark, sf_dir):
    e = vectors(spark, sf_dir)
    sc = Scaler.fit(e, "embedding")
    back = sc.inverse(sc.transform(e, "embedding"), "embedding")
    return back.select("vec_id", F.round(F.aggregate(
        F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("checksum"))


@query(STATS_SQL + "SELECT vec_id, label FROM z GROUP BY 1, 2 HAVING max(abs(z)) < 2.5")
def zscore_filter(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return Scaler.fit(e, "embedding").drop_outliers(e, "embedding", 2.5).select("vec_id", "label")


@query()
def pca_reconstruction_error(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return Coder.fit(e, "embedding", 16).with_error(e, "embedding").select("vec_id", F.round("error", 6).alias("error"))


@query()
def pca_codes(spark, sf_dir):
    e = vectors(spark, sf_dir)
    coder = Coder.fit(e, "embedding", 16)
    return coder.decode(coder.encode(e, "embedding")).select("vec_id", F.size("code").alias("code_size"),
                                                            F.size("reconstructed").alias("size"))


@query(STATS_SQL + """SELECT 64 AS input_size, 64 AS code_size, 1.0::DOUBLE AS compression_ratio,
1.0::DOUBLE AS explained_variance, 0.0::DOUBLE AS mean_error FROM (SELECT count(*) FROM z) WHERE true""")
def full_code_report(spark, sf_dir):
    """A code as long as the vector loses nothing."""
    return _report(spark, sf_dir, [64])


@query()
def code_size_report(spark, sf_dir):
    return _report(spark, sf_dir, [4, 8, 16, 32])


def _report(spark, sf_dir, sizes):
    e = vectors(spark, sf_dir)
    r = Coder.fit(e, "embedding", max(sizes)).size_report(e, "embedding", sizes)
    return r.select("input_size", "code_size", F.col("compression_ratio").cast("double").alias("compression_ratio"),
                    F.round("explained_variance", 6).alias("explained_variance"),
                    F.round("mean_error", 6).alias("mean_error"))


@query()
def most_anomalous(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return Coder.fit(e, "embedding", 16).most_anomalous(e, "embedding", "vec_id", 20).select("vec_id", "label")


@query("SELECT vec_id, true AS same_code, true AS same_error FROM embeddings")
def code_merged_from_days(spark, sf_dir):
    """States fitted on four parts, stored one after the other and merged, give the code of one fit over all rows to nine
    digits, and the error of the library's own principal components."""
    e = vectors(spark, sf_dir)
    path = scratch_path(spark, "states")
    for days in ((0, 1), (2, 3)):
        moments.save_states(moments.fit_parts(e.where((F.col("vec_id") % 4).isin(*days)), "embedding", F.col("vec_id") % 4), path)
    whole = moments.coder_of(moments.fit_parts(e, "embedding", F.lit("all")), 16)
    both = whole.encode(moments.coder_of(moments.load_states(spark, path), 16).with_error(e, "embedding", out="merged_error").withColumnRenamed("embedding", "v"), "v", "whole")
    both = both.join(moments.coder_of(moments.load_states(spark, path), 16).encode(e, "embedding", "merged").select("vec_id", "merged"), "vec_id")
    own = Coder.fit(e, "embedding", 16).with_error(e, "embedding").select("vec_id", "error")
    near = F.forall(F.zip_with("whole", "merged", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x)
    return both.join(own, "vec_id").select("vec_id", near.alias("same_code"), (F.abs(F.col("merged_error") - F.col("error")) < 1e-9).alias("same_error"))


@query("""SELECT vec_id % 5 = 0 AS held_out, count(*) AS n, true AS plausible FROM embeddings GROUP BY 1""")
def held_out_code_error(spark, sf_dir):
    """A code fitted without every fifth vector: its error on those beside that on the others, both of the size of a dimension."""
    e = vectors(spark, sf_dir)
    back = F.col("vec_id") % 5 == 0
    coder = moments.coder_of(moments.fit_parts(e.where(~back), "embedding", F.lit("train")), 16)
    split = moments.error_by_split(coder, e, "embedding", back)
    return split.select("held_out", "n", F.col("mean_error").between(0.0, 2.0).alias("plausible"))


@query("SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return summaries.cluster_sizes(vectors(spark, sf_dir).withColumnRenamed("label", "cluster"))


def noisy(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", "embedding", (F.col("label") - 1).alias("cluster"))


@query("""SELECT count(DISTINCT label) FILTER (label <> 0) AS clusters, count(*) FILTER (label = 0) AS noise_rows,
round(100.0 * count(*) FILTER (label = 0) / count(*), 2)::DOUBLE AS noise_percentage FROM embeddings""")
def cluster_overview(spark, sf_dir):
    return summaries.cluster_overview(noisy(spark, sf_dir))


def exemplar_sql(dist: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, label - 1 AS cluster, embedding::DOUBLE[64] AS v FROM embeddings),
m AS (SELECT a.vec_id, a.cluster, round(avg({dist}), 9) AS d FROM e a JOIN e b ON a.cluster = b.cluster
      WHERE a.cluster <> -1 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, vec_id) AS lo,
        row_number() OVER (PARTITION BY cluster ORDER BY d DESC, vec_id) AS hi,
        count(*) OVER (PARTITION BY cluster) AS n FROM m)
SELECT e.vec_id, e.cluster, coalesce(lo = 1 AND n > 1, false) AS is_most_typical,
       coalesce(hi = 1 AND n > 1, false) AS is_most_extreme FROM e LEFT JOIN r USING (vec_id)"""


@query(exemplar_sql("array_distance(a.v, b.v)"))
def cluster_exemplars(spark, sf_dir):
    e = noisy(spark, sf_dir)
    return exemplars.label_exemplars(e, exemplars.find_exemplars(e, "vec_id", "embedding"), "vec_id")


@query(exemplar_sql("list_sum([abs(x[1] - x[2]) for x in list_zip(a.v, b.v)])"))
def cluster_exemplars_manhattan(spark, sf_dir):
    e = noisy(spark, sf_dir)
    found = exemplars.find_exemplars(e, "vec_id", "embedding", metric="manhattan", in_task=20)
    return exemplars.label_exemplars(e, found, "vec_id")


@query(exemplar_sql("array_distance(a.v, b.v)"))
def cluster_exemplars_blocked(spark, sf_dir):
    """The same through the path for clusters too large for one task."""
    e = noisy(spark, sf_dir)
    return exemplars.label_exemplars(e, exemplars.find_exemplars(e, "vec_id", "embedding", in_task=16), "vec_id")


@query("""
WITH v AS (SELECT vec_id, label - 1 AS cluster, list_avg(embedding::DOUBLE[]) AS m, len(embedding) AS k FROM embeddings)
SELECT cluster, count(*) AS n, round(avg(m), 9) AS mean_value FROM v WHERE cluster <> -1 GROUP BY 1""")
def cluster_characteristics(spark, sf_dir):
    e = noisy(spark, sf_dir)
    c = summaries.cluster_characteristics(e, e, "vec_id", {"embedding": "mean_value"}, duration=None)
    return c.select("cluster", "n", F.round("mean_value", 9).alias("mean_value"))


@query()
def hdbscan_labels(spark, sf_dir):
    """Clusters of the whole vectors with the default parameters; iterative, so checked by brute force on fixtures."""
    return density.hdbscan(vectors(spark, sf_dir), "vec_id", "embedding")


@query("SELECT vec_id, true AS own_label FROM embeddings")
def saved_clusterer(spark, sf_dir):
    """A clusterer written to storage and read again gives every training vector its own label."""
    e = vectors(spark, sf_dir)
    path = scratch_path(spark, "clusterer")
    made = Clusterer.fit(e, "vec_id", "embedding", min_cluster_size=10)
    made.save(path)
    given = Clusterer.load(spark, path).assign(e, "vec_id", "embedding").withColumnRenamed("cluster", "given")
    return made.labels(e, "vec_id", "embedding").join(given, "vec_id").select("vec_id", (F.col("cluster") == F.col("given")).alias("own_label"))


@query()
def window_clusters(spark, sf_dir):
    """Event windows to features, codes, clusters and exemplars."""
    from driftline.plans.trace_queries import N, event_rates
    cols = [c for c in windows.FEATURES if c != "climb_descent_accels"]
    w = windows.assign_segment_id(event_rates(spark, sf_dir), ["user_id", "start_us"])
    flat = materialise(windows.flatten_features(w, "segment_id", cols, N))
    coder = Coder.fit(flat, "features", 8)
    coded = materialise(coder.encode(flat, "features").select("segment_id", "code"))
    labels = density.hdbscan(coded, "segment_id", "code", min_cluster_size=15, min_samples=4, epsilon=0.25)
    labelled = materialise(coded.join(labels, "segment_id"))
    return exemplars.label_exemplars(labelled, exemplars.find_exemplars(labelled, "segment_id", "code"), "segment_id")
