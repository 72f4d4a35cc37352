"""Scores of clusterings and features in long form: rows of a key, a dimension and a value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.scalars import zscore

#: The silhouette's tasks hold a block of rows and pass by so many blocks of others, a strip of rows at a time.
BLOCK_ROWS, BLOCKS_A_TASK, STRIP_ROWS = 4096, 16, 256
SILHOUETTE_TASKS = 10_000  # at most


def features_view(embeddings: DataFrame) -> DataFrame:
    """``key, dim, x`` of an embedding table."""
    return embeddings.select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def standardised(features: DataFrame, by: list[str] | None = None, centre_only: bool = False) -> DataFrame:
    """``z`` of every value over its dimension (and ``by``): population z-score, or the value less the mean."""
    w = Window.partitionBy("dim", *(by or []))
    mean = F.avg("x").over(w)
    return features.withColumn("z", F.col("x") - mean if centre_only else zscore(F.col("x"), mean, F.stddev_pop("x").over(w)))


def subject_normalised(features: DataFrame, how: str = "zscore", subject: str = "subject") -> DataFrame:
    """``z`` of every value by ``how``: ``none`` as it is, ``center`` less its subject's mean, ``zscore`` by its subject's mean and deviation."""
    if how == "none":
        return features.withColumn("z", F.col("x"))
    if how not in ("center", "zscore"):
        raise ValueError(f"unknown normalisation {how!r}")
    return standardised(features, [subject], how == "center")


def centroids(features: DataFrame, assignment: DataFrame, value: str = "x") -> DataFrame:
    return features.join(assignment, "key").groupBy("cluster", "dim").agg(F.avg(value).alias("centre"), F.count("*").alias("n"))


def medoids(features: DataFrame, assignment: DataFrame, value: str = "x") -> DataFrame:
    """The member nearest its cluster's centroid, the lowest key of equal ones."""
    near = features.join(assignment, "key").join(centroids(features, assignment, value), ["cluster", "dim"])
    distance = near.groupBy("cluster", "key").agg(F.round(F.sqrt(F.sum((F.col(value) - F.col("centre")) ** 2)), 9).alias("distance"))
    return distance.groupBy("cluster").agg(F.min_by("key", F.struct("distance", "key")).alias("medoid"), F.min("distance").alias("distance"), F.count("*").alias("size"))


def _contingency(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    return rows.groupBy(F.col(cluster).alias("c"), F.col(label).alias("y")).agg(F.count("*").cast("double").alias("n"))


def purity(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    per = _contingency(rows, cluster, label).groupBy("c").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per.agg((F.sum("top") / F.sum("n")).alias("purity"))


def adjusted_rand(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """1 for partitions that are alike throughout, also trivial ones."""
    t = _contingency(rows, cluster, label)
    pairs = lambda c: c * (c - 1) / 2
    cells = t.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    side = lambda k: t.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"s{k}"))
    one = cells.join(side("c")).join(side("y"))  # one row each
    chance = F.col("sc") * F.col("sy") / pairs(F.col("total"))
    top, bottom = F.col("both") - chance, (F.col("sc") + F.col("sy")) / 2 - chance
    return one.select(F.when(bottom == 0, 1.0).otherwise(top / bottom).alias("ari"))


def normalised_mi(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Mutual information over the mean of both entropies; 1 when neither partition divides anything."""
    t = _contingency(rows, cluster, label)
    whole, by_c, by_y = Window.partitionBy(), Window.partitionBy("c"), Window.partitionBy("y")
    t = t.withColumns({"t": F.sum("n").over(whole), "nc": F.sum("n").over(by_c), "ny": F.sum("n").over(by_y)})
    agg = t.agg(
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nc") * F.col("ny")))).alias("mi"),
        F.sum(-F.col("n") / F.col("t") * F.log(F.col("nc") / F.col("t"))).alias("hc"), F.sum(-F.col("n") / F.col("t") * F.log(F.col("ny") / F.col("t"))).alias("hy"),
    )
    half = (F.col("hc") + F.col("hy")) / 2
    return agg.select(F.when(half == 0, 1.0).otherwise(F.col("mi") / half).alias("nmi"))


def label_metrics(rows: DataFrame, cluster: str = "cluster_id", label: str = "gesture_label") -> DataFrame:
    """One row over rows with a label; no scores with fewer than two rows or classes."""
    own = rows.where(F.length(label) > 0)
    counts = own.agg(F.count("*").alias("n_labeled"), F.countDistinct(label).alias("n_classes"))
    one = counts.join(adjusted_rand(own, cluster, label)).join(normalised_mi(own, cluster, label)).join(purity(own, cluster, label))
    enough = (F.col("n_labeled") >= 2) & (F.col("n_classes") >= 2)
    return one.select("n_labeled", "n_classes", *[F.when(enough, F.bround(c, 4)).alias(c) for c in ("ari", "nmi", "purity")])


def contamination(rows: DataFrame, cluster: str = "cluster", subject: str = "subject") -> DataFrame:
    """One row: mean over clusters of the largest subject's share, and how many are over 0.50 and 0.77."""
    per = rows.groupBy(cluster, subject).agg(F.count("*").alias("n")).groupBy(cluster).agg((F.max("n") / F.sum("n")).alias("share"))
    over = lambda x: F.count_if(F.col("share") > x)
    return per.agg(F.avg("share").alias("mean_share"), over(0.50).alias("n_over_50"), over(0.77).alias("n_over_77"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; near ones, which the product of norms would blur, by their differences."""
    norms = (a * a).sum(1)[:, None] + (b * b).sum(1)
    d = norms - 2 * (a @ b.T)
    x, y = np.nonzero(d <= 1e-6 * norms)
    for k in range(0, len(x), 1 << 15):
        p, q = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
        d[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return np.sqrt(d)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, cluster, c2, s, n`` of the rows marked ``mine``, which come first: the sum and number of distances to others of each cluster.

    Pairs of equal keys are left out. Rows whose vectors are null or differ in length have no distance.
    """
    held: list[pa.RecordBatch] = []
    names: dict = {}
    own = None
    for batch in batches:
        mine = batch.column("mine").to_numpy(zero_copy_only=False)
        if mine.any():
            if own is not None:
                raise ValueError("a block's rows came after others")
            held.append(batch.filter(pa.array(mine)))
            batch = batch.filter(pa.array(~mine))
        if not batch.num_rows or not held:
            continue
        if own is None:
            own = pa.Table.from_batches(held).combine_chunks()
            keys = own.column("key").combine_chunks().dictionary_encode()
            key, lists = keys.indices.to_numpy(), own.column("v").combine_chunks()
            parts = {size: (x, _matrix(lists, x, size)) for size, x in _by_length(lists)}
            sums, valid, pairs = (np.zeros((len(key), 0), t) for t in (float, np.int64, np.int64))
        found = batch.column("cluster").dictionary_encode(null_encoding="encode")
        code = np.array([names.setdefault(c, len(names)) for c in found.dictionary.to_pylist()])[found.indices.to_numpy()]
        more = ((0, 0), (0, len(names) - sums.shape[1]))
        sums, valid, pairs = np.pad(sums, more), np.pad(valid, more), np.pad(pairs, more)
        known = pc.fill_null(pc.index_in(batch.column("key"), keys.dictionary), -1).to_numpy()

        def count(out: np.ndarray, rows: np.ndarray, others: np.ndarray) -> None:
            out[rows] += np.bincount(code[others], minlength=len(names))  # noqa: B023
            equal = others[known[others] >= 0]  # noqa: B023
            if len(equal):
                same = np.zeros((len(keys.dictionary), len(names)), np.int64)
                np.add.at(same, (known[equal], code[equal]), 1)  # noqa: B023
                out[rows] -= same[key[rows]]

        count(pairs, np.arange(len(key)), np.arange(len(code)))
        for size, y in _by_length(batch.column("v")):
            if size not in parts:
                continue
            y = y[np.argsort(code[y], kind="stable")]
            (x, vx), vy = parts[size], _matrix(batch.column("v"), y, size)
            count(valid, x, y)
            starts = np.flatnonzero(np.diff(code[y], prepend=-1))
            for k in range(0, len(x), STRIP_ROWS):
                rows = x[k : k + STRIP_ROWS]
                d = _distances(vx[k : k + STRIP_ROWS], vy)
                if (known[y] >= 0).any():
                    d[key[rows][:, None] == known[y]] = 0
                sums[np.ix_(rows, code[y][starts])] += np.add.reduceat(d, starts, axis=1)
    if own is not None:
        r, c = np.nonzero(pairs)
        at, kind = pa.array(r), own.schema.field("cluster").type
        c2 = pa.array(list(names), kind).take(pa.array(c))
        one = lambda name: own.column(name).combine_chunks().take(at)
        yield pa.RecordBatch.from_arrays([one("key"), one("cluster"), c2, pa.array(sums[r, c]), pa.array(valid[r, c])], ["key", "cluster", "c2", "s", "n"])


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
    for size in np.unique(length[length >= 0]):
        yield int(size), np.flatnonzero(length == size)


def _matrix(lists: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    return lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def silhouette(vectors: DataFrame, most: int | None = None, vector: str = "embedding", cluster: str = "cluster", key: str = "key") -> DataFrame:
    """``key, cluster, silhouette`` by exact Euclidean distances among all rows, or among ``most`` rows chosen by a hash of their key.

    The work grows with the square of the rows. Tasks hold a block of rows, dealt by a hash of the key, and sum the
    distances to others by cluster as some blocks of those pass by. Lone members and rows without distances score 0; rows
    without a key are left out.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"), F.col(vector).cast("array<double>").alias("v")).where("key IS NOT NULL")
    if most is not None:
        rows = rows.orderBy(F.md5(F.col("key").cast("string")), "key").limit(most)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("v", F.when(~F.exists("v", lambda x: x.isNull()), F.col("v"))).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    spans = -(-blocks // BLOCKS_A_TASK)
    span = F.floor(F.col("block") / BLOCKS_A_TASK).cast("long")
    each = lambda n, body: F.transform(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"), body)
    held = each(spans, lambda k: F.struct(F.col("block").alias("i"), k.alias("span"), F.lit(True).alias("mine")))
    passing = each(blocks, lambda k: F.struct(k.alias("i"), span.alias("span"), F.lit(False).alias("mine")))
    met = rows.withColumn("to", F.explode(F.concat(held, passing))).select("key", "cluster", "v", "to.*")
    met = met.repartition(min(blocks * spans, SILHOUETTE_TASKS), "i", "span").sortWithinPartitions("i", "span", F.desc("mine"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"key {kind['key']}, cluster {kind['cluster']}, c2 {kind['cluster']}, s double, n long"
    met = met.groupBy("i", "span").applyInArrow(_block_sums, schema)
    sums = met.groupBy("key", "cluster", "c2").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    sums = sums.withColumn("d", F.when(F.col("n") > 0, F.col("s") / F.col("n")))
    per = sums.groupBy("key", "cluster").agg(
        F.max(F.when(F.col("c2") == F.col("cluster"), F.col("d"))).alias("a"), F.min(F.when(F.col("c2") != F.col("cluster"), F.col("d"))).alias("b")
    )
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select("key", "cluster", value.alias("silhouette"))


def global_ids(local: DataFrame, group: str = "grp", cluster: str = "local_id") -> DataFrame:
    """Cluster ids that are dense over all groups, in the groups' sorted order; the ranks run over one row a cluster."""
    distinct = local.select(group, cluster).distinct()
    ids = distinct.withColumn("cluster_id", (F.dense_rank().over(Window.orderBy(group, cluster)) - 1).cast("long"))
    return local.join(ids, [group, cluster])


def silhouette_means(rows: DataFrame, value: str = "silhouette", cluster: str = "cluster") -> DataFrame:
    """Mean silhouette and number of rows of every cluster."""
    return rows.groupBy(cluster).agg(F.avg(value).alias("mean_silhouette"), F.count("*").alias("n"))
