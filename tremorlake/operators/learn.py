"""Clustering, projection and transfer on Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.scalars import all_finite
from tremorlake.operators import score


def clamp_k(k: int, n: int) -> int:
    """A feasible number of clusters: at least 2 and under the number of rows."""
    return max(2, min(k, n - 1))


def kmeans(vectors: DataFrame, k: int, seeds: tuple[int, ...] = (0, 1, 2), vector: str = "embedding") -> DataFrame:
    """``cluster`` of every row by the run of least cost over the seeds; fewer than two rows are one cluster."""
    n = vectors.count()
    if n < 2:
        return vectors.withColumn("cluster", F.lit(0))
    data = vectors.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>"))).cache()
    models = [KMeans(k=clamp_k(k, n), seed=s, featuresCol="__x", predictionCol="cluster").fit(data) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return best.transform(data).drop("__x")


def kmeans_scan(vectors: DataFrame, k_min: int, k_max: int, key: str = "key", vector: str = "embedding", most: int = 3000) -> tuple[int, DataFrame]:
    """The number of clusters of best exact silhouette (the first of equal ones) and its clustering."""
    n = vectors.count()
    if n < 2:
        return 1, vectors.withColumn("cluster", F.lit(0))
    best = None
    for k in sorted({clamp_k(k, n) for k in range(k_min, k_max + 1)}):
        out = kmeans(vectors, k, vector=vector)
        value = score.silhouette(out, most, vector, "cluster", key).agg(F.avg("silhouette")).first()[0]
        if best is None or value > best[0]:
            best = (value, k, out)
    return best[1], best[2]


def zscored_vectors(vectors: DataFrame, key: str = "key", vector: str = "embedding", weights: list[float] | None = None) -> DataFrame:
    """``key, z``: vectors of population z-scores; weights scale dimensions after that (before, they would cancel)."""
    long = vectors.select(F.col(key).alias("key"), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    z = score.standardised(long)
    if weights is not None:
        z = z.withColumn("z", F.col("z") * F.sqrt(F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("dim"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda s: s["z"])
    return z.groupBy("key").agg(ordered.alias("z"))


def pca(vectors: DataFrame, components: int, vector: str = "z") -> DataFrame:
    """``pc`` arrays; the input is centred already. At most as many components as dimensions and rows less one."""
    data = vectors.withColumn("__x", array_to_vector(vector)).cache()
    width = F.size(vector)
    n, d = data.agg(F.count("*"), F.max(width)).first()
    model = PCA(k=max(1, min(components, d, n - 1)), inputCol="__x", outputCol="__pc").fit(data)
    data.unpersist()
    return model.transform(data).withColumn("pc", vector_to_array("__pc")).drop("__x", "__pc")


def _per_group(vectors: DataFrame, group: str, run) -> DataFrame:
    """``run`` on every group's rows, one group after the other (groups are subjects' hands, a few), with ``cluster_id`` counted over all groups in their order."""
    groups = [r[0] for r in vectors.select(group).distinct().orderBy(group).collect()]
    parts = [run(vectors.where(F.col(group).eqNullSafe(F.lit(g)))).withColumn(group, F.lit(g).cast(vectors.schema[group].dataType)) for g in groups]
    out = reduce(DataFrame.unionByName, parts) if parts else run(vectors).withColumn(group, F.lit(None).cast(vectors.schema[group].dataType))
    return score.global_ids(out, group, "cluster")


def apex_clusters(vectors: DataFrame, k_min: int, k_max: int, norm: str = "zscore", group: str = "grp", subject: str = "subject", key: str = "key", vector: str = "embedding") -> DataFrame:
    """``key, grp, cluster, cluster_id, k`` of apex features: rows with a component that isn't finite go, each group is normalised by subject, z-scored and
    clustered with the number of clusters of best silhouette.
    """
    whole = vectors.where(all_finite(F.col(vector)))

    def run(rows: DataFrame) -> DataFrame:
        long = rows.select(F.col(key).alias("key"), F.col(subject).alias("subject"), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
        own = score.subject_normalised(long, norm).withColumn("x", F.col("z"))
        z = score.standardised(own.drop("z"))
        ready = z.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda s: s["z"]).alias("z"))
        k, out = kmeans_scan(ready, k_min, k_max, "key", "z")
        return out.select("key", F.col("cluster").cast("long").alias("cluster"), F.lit(k).alias("k"))

    return _per_group(whole, group, run)


def grouped_trajectory_clusters(vectors: DataFrame, k: int, components: int = 30, group: str = "grp", key: str = "key", vector: str = "embedding") -> DataFrame:
    """``key, grp, cluster, cluster_id, medoid``: every group's trajectories z-scored, projected and clustered; ``medoid`` marks the member nearest its cluster's
    centre in projected space, the lowest key of equal ones.
    """

    def run(rows: DataFrame) -> DataFrame:
        out = trajectory_clusters(rows, k, components, key, vector)
        long = out.select("key", F.posexplode("pc").alias("dim", "x"))
        nearest = score.medoids(long, out.select("key", "cluster")).select("cluster", "medoid")
        joined = out.select("key", "cluster").join(F.broadcast(nearest), "cluster")  # a row a cluster
        return joined.select("key", F.col("cluster").cast("long").alias("cluster"), (F.col("key") == F.col("medoid")).alias("medoid"))

    return _per_group(vectors, group, run)


def trajectory_clusters(vectors: DataFrame, k: int, components: int = 30, key: str = "key", vector: str = "embedding") -> DataFrame:
    """z-score, projection, clustering: ``key, cluster`` and the projected vector."""
    return kmeans(pca(zscored_vectors(vectors, key, vector), components), k, vector="pc")


def subject_leakage(vectors: DataFrame, subject: str = "subject", folds: int = 5, key: str = "key", vector: str = "z") -> DataFrame | None:
    """One row: how well a linear classifier tells subjects apart over folds, beside the share of the largest and of an even guess.

    Folds deal every subject's rows evenly by a hash of their key. None with fewer than two subjects or rows of one.
    """
    spark = vectors.sparkSession
    sizes = [r["count"] for r in vectors.groupBy(subject).count().collect()]
    folds = min(folds, min(sizes, default=0))
    if len(sizes) < 2 or folds < 2:
        return None
    names = [r[0] for r in vectors.select(subject).distinct().orderBy(subject).collect()]
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(subject)) - 1
    dealt = Window.partitionBy(subject).orderBy(F.md5(F.col(key).cast("string")), key)
    data = vectors.select(array_to_vector(vector).alias("features"), number.cast("double").alias("label"), (F.row_number().over(dealt) % folds).alias("fold")).cache()
    right = [
        LogisticRegression(maxIter=50).fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        for f in range(folds)
    ]
    data.unpersist()
    return spark.createDataFrame([(sum(right) / folds, 1 / len(sizes), max(sizes) / sum(sizes))], "accuracy double, even_guess double, largest_share double")


def loso_transfer(vectors: DataFrame, k: int, subject: str = "subject", key: str = "key", vector: str = "embedding") -> DataFrame:
    """Per subject left out: its rows, and their mean distance to the others' clusters over the others' own mean distance.

    Means and deviations come from the other subjects alone. One model a subject, so meant for few subjects.
    """
    spark, out = vectors.sparkSession, []
    x = vectors.withColumn("__x", F.col(vector).cast("array<double>")).cache()
    for s in [r[0] for r in x.select(subject).distinct().orderBy(subject).collect()]:
        long = x.where(F.col(subject) != s).select(F.posexplode("__x").alias("dim", "v"))
        stats = long.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d")).orderBy("dim").collect()  # a row a dimension
        mean, dev = (F.array(*[F.lit(float(v)) for v in c]) for c in ([r["m"] for r in stats], [r["d"] if r["d"] >= 1e-12 else 1.0 for r in stats]))
        centred = F.zip_with("__x", mean, lambda v, m: v - m)
        z = F.zip_with(centred, dev, lambda v, d: v / d)
        data = x.select(subject, array_to_vector(z).alias("features"), z.alias("z"))
        train = data.where(F.col(subject) != s)
        n = train.count()
        model = KMeans(k=clamp_k(k, n), seed=0).fit(train)
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
        gap = F.sqrt(F.aggregate(F.zip_with("z", F.get(centres, F.col("prediction")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
        means = {r["own"]: (r["m"], r["n"]) for r in model.transform(data).groupBy((F.col(subject) == s).alias("own")).agg(F.avg(gap).alias("m"), F.count("*").alias("n")).collect()}
        out.append((s, means[True][1], means[True][0] / (means[False][0] + 1e-12)))
    x.unpersist()
    kind = dict(vectors.dtypes)[subject]
    return spark.createDataFrame(out, f"{subject} {kind}, n long, ratio double")
