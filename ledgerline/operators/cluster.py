"""Clusterings: fitting, assignment, validity, agreement and consensus.

Vectors are arrays of doubles. What Spark aggregates grows with clusters and dimensions;
only matrices of that size, or a stated sample, reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.draws import draw
from ledgerline.operators.joins import squared_distance
from ledgerline.sources.durable import written


def as_double(vector: str) -> Column:
    return F.transform(vector, lambda v: v.cast("double"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, n, centre: means by position, aggregated long so that no group is gathered."""
    long = df.select(label, F.posexplode(as_double(vector)).alias("i", "v"))
    mean = long.groupBy(label, "i").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    packed = mean.groupBy(label).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))  # one entry a dimension
    return packed.select(label, "n", F.transform("s", lambda x: x["v"]).alias("centre"))


def assign(df: DataFrame, centres: DataFrame, label: str, vector: str) -> DataFrame:
    """df with label of the nearest centre, its squared distance and the margin (d2 - d1) / (d2 + d1); ties go to the least label.

    The centres, clusters x dimensions in size, ride along as one array.
    """
    packed = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centre").alias("c")))).alias("_c"))
    each = F.transform("_c", lambda c: F.struct(squared_distance(F.col("_x"), c["c"]).alias("d"), c["l"].alias("l")))
    out = df.withColumn("_x", as_double(vector)).join(F.broadcast(packed), how="cross").withColumn("_d", F.array_sort(each))
    d1, d2 = F.sqrt(F.col("_d")[0]["d"]), F.sqrt(F.col("_d")[1]["d"])
    margin = F.when(F.size("_d") > 1, (d2 - d1) / F.nullif(d2 + d1, F.lit(0.0)))
    return out.withColumns({label: F.col("_d")[0]["l"], "distance": F.col("_d")[0]["d"], "margin": margin}).drop("_x", "_c", "_d")


def k_means(df: DataFrame, key: str, vector: str, k: int, seed: int = 5, rounds: int = 20) -> DataFrame:
    """key, label: Lloyd's rounds from the built-in parallel initialisation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, array_to_vector(vector).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, initMode="k-means||").fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("label"))


def far_apart(x: np.ndarray, k: int, first: int) -> np.ndarray:
    """Starting centres: a first row, then each time the row farthest from those chosen (the earliest on a tie)."""
    chosen = [first]
    nearest = ((x - x[first]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def lloyd(x: np.ndarray, k: int, first: int, rounds: int = 20) -> np.ndarray:
    """Labels of Lloyd's rounds from far_apart(); for a stated sample. A cluster without rows keeps its centre."""
    centres = far_apart(x, k, first)
    for _ in range(rounds):
        label = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)])
        settled = np.abs(moved - centres).max() < 1e-9
        centres = moved
        if settled:
            break
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


def k_means_by(df: DataFrame, by: list[str], key: str, vector: str, k: int, rounds: int = 20, seed: int = 3) -> DataFrame:
    """by, key, label: lloyd() in every group at once; a round is one aggregation over all groups.

    A group's first centre is its row of the least draw. The centres, k a group, are broadcast:
    groups are months or configurations.
    """
    x = written(df.select(*by, key, as_double(vector).alias("x")))
    if (one := x.first()) is None:
        return x.select(*by, key, F.lit(0).alias("label"))
    dims = len(one["x"])
    distances = F.transform("cs", lambda c: squared_distance(F.col("x"), c))
    centres = x.groupBy(*by).agg(F.array(F.min_by("x", F.struct(draw(*by, key, seed=seed), key))).alias("cs"))
    for _ in range(k - 1):
        far = x.join(F.broadcast(centres), by).withColumn("_d", F.array_min(distances))
        centres = written(far.groupBy(*by).agg(F.any_value("cs").alias("cs"), F.max_by("x", F.struct("_d", -F.col(key))).alias("far")).select(*by, F.concat("cs", F.array("far")).alias("cs")))

    def labelled(centres: DataFrame) -> DataFrame:
        return x.join(F.broadcast(centres), by).withColumn("label", (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))

    for _ in range(rounds):
        mean = labelled(centres).groupBy(*by, "label").agg(F.array(*(F.avg(F.get("x", F.lit(i))) for i in range(dims))).alias("c"))
        found = mean.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("_new"))  # k at most
        moved = F.transform("cs", lambda c, i: F.coalesce(F.try_element_at("_new", i), c))
        step = written(centres.join(found, by).select(*by, "cs", moved.alias("_moved")))
        off = F.array_max(F.transform(F.arrays_zip("cs", "_moved"), lambda z: F.array_max(F.zip_with(z["cs"], z["_moved"], lambda a, b: F.abs(a - b)))))
        centres = step.select(*by, F.col("_moved").alias("cs"))
        if step.filter(off >= 1e-9).isEmpty():
            break
    return labelled(centres).select(*by, key, "label")


def silhouette_of(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Silhouettes of a stated sample."""
    names, of = np.unique(label, return_inverse=True)
    member = np.eye(len(names))[of]
    sizes, own = member.sum(axis=0), (np.arange(len(x)), of)
    sums = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) @ member
    if len(names) < 2:
        return np.zeros(len(x))
    a = sums[own] / np.maximum(sizes[of] - 1, 1)
    other = sums / sizes
    other[own] = np.inf
    b = other.min(axis=1)
    return np.where((sizes[of] > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)


def variable_k(sample: DataFrame, key: str, vector: str, low: int = 2, high: int = 8) -> DataFrame:
    """k, silhouette, chosen: the mean silhouette of each number of clusters on a sample of some hundred rows; the least k on a tie."""
    rows = sample.select(key, as_double(vector).alias("x"), draw(key, seed=3).alias("_h")).withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(high))))

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        x, k = np.array(rows["x"].tolist(), float), int(rows["k"].iloc[0])
        label = lloyd(x, min(k, len(x)), int(np.lexsort((rows[key], rows["_h"]))[0]))
        return pd.DataFrame([(k, float(silhouette_of(x, label).mean()))], columns=["k", "silhouette"])

    found = rows.groupBy("k").applyInPandas(score, "k int, silhouette double")
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("silhouette", 12).desc(), "k")) == 1  # a row for each k
    return found.withColumn("chosen", best)


def mixture(df: DataFrame, key: str, vector: str, k: int, seed: int = 5, rounds: int = 15) -> DataFrame:
    """key, label: a Gaussian mixture with diagonal covariances, fitted on all rows and dimensions from k-means labels."""
    x = written(df.select(key, as_double(vector).alias("x")))
    first = written(x.join(k_means(x, key, "x", k, seed), key).select("x", "label"))
    if (one := first.first()) is None:
        return x.select(key, F.lit(0).alias("label")).limit(0)
    dims = len(one["x"])

    def sums(rows: DataFrame, shares) -> np.ndarray:
        """k x (1 + 2 dims): the sums of the shares, of x and of its squares; one row a partition reaches the driver."""

        def partial(batches):
            total = np.zeros((k, 1 + 2 * dims))
            for batch in batches:
                v = np.array(batch["x"].tolist(), float).reshape(-1, dims)
                total += shares(v, batch).T @ np.hstack([np.ones((len(v), 1)), v, v * v])
            yield pd.DataFrame({"s": [total.ravel().tolist()]})

        return sum(np.array(r["s"]).reshape(k, -1) for r in rows.mapInPandas(partial, "s array<double>").collect())

    def model(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.maximum(total[:, :1], 1e-9)
        mean = total[:, 1 : 1 + dims] / n
        whole = total.sum(axis=0)
        spread = whole[1 + dims :] / whole[0] - (whole[1 : 1 + dims] / whole[0]) ** 2
        return n[:, 0] / n.sum(), mean, np.maximum(total[:, 1 + dims :] / n - mean**2, 1e-6 * spread + 1e-12)

    def densities(v: np.ndarray, fitted) -> np.ndarray:
        weight, mean, var = fitted
        return np.stack([np.log(w) - 0.5 * (np.log(s) + (v - m) ** 2 / s).sum(axis=1) for w, m, s in zip(weight, mean, var, strict=True)], axis=1)

    def expected(v: np.ndarray, fitted) -> np.ndarray:
        d = densities(v, fitted)
        e = np.exp(d - d.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    fitted = model(sums(first, lambda v, batch: np.eye(k)[batch["label"].to_numpy()]))
    for _ in range(rounds):
        fitted = model(sums(x, lambda v, batch, fitted=fitted: expected(v, fitted)))

    @F.pandas_udf("int")
    def likeliest(v: pd.Series) -> pd.Series:
        return pd.Series(densities(np.array(v.tolist(), float).reshape(-1, dims), fitted).argmax(axis=1).astype("int32"))

    return x.select(key, likeliest("x").alias("label"))


def bisecting(df: DataFrame, key: str, vector: str, k: int, seed: int = 5) -> DataFrame:
    """key, label: divisive hierarchical clustering."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, array_to_vector(vector).alias("features"))
    return BisectingKMeans(k=k, seed=seed).fit(rows).transform(rows).select(key, F.col("prediction").alias("label"))


def power_iteration(edges: DataFrame, k: int, rounds: int = 15) -> DataFrame:
    """id, cluster: spectral clustering of a weighted graph (src, dst, weight)."""
    from pyspark.ml.clustering import PowerIterationClustering

    return PowerIterationClustering(k=k, maxIter=rounds, srcCol="src", dstCol="dst", weightCol="weight").assignClusters(edges)


def agglomerate(x: np.ndarray, k: int, method: str = "ward", size: np.ndarray | None = None) -> np.ndarray:
    """Labels 0..k-1 of an agglomerative clustering by the Lance-Williams update; of a few thousand rows at most.

    A row may be the centre of `size` rows already merged.
    """
    n = len(x)
    size = np.ones(n) if size is None else np.array(size, float)
    d = np.array([((x - row) ** 2).sum(axis=1) for row in x]).reshape(n, n)
    if method == "average":
        d = np.sqrt(d)
    else:
        d *= 2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :])
    np.fill_diagonal(d, np.inf)
    member, alive = np.arange(n), np.ones(n, bool)
    for _ in range(n - k):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        rest = alive.copy()
        rest[[i, j]] = False
        si, sj, s = size[i], size[j], size[rest]
        new = (si * d[i, rest] + sj * d[j, rest]) / (si + sj) if method == "average" else ((si + s) * d[i, rest] + (sj + s) * d[j, rest] - s * d[i, j]) / (si + sj + s)
        d[i, rest] = d[rest, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i], alive[j] = si + sj, False
        member[member == member[j]] = member[i]
    return np.unique(member, return_inverse=True)[1]


def linkage_labels(df: DataFrame, key: str, vector: str, k: int, method: str = "ward", micro: int = 200, plain: int = 2000) -> DataFrame:
    """key, label: the plain agglomeration up to `plain` rows; beyond, an approximation: k-means micro-clusters, then agglomeration of their centres with their sizes."""
    n = df.count()
    if n <= plain:
        rows = df.orderBy(key).select(key, vector).toPandas()
        labels = agglomerate(np.array(rows[vector].tolist(), float), min(k, n), method)
        return df.sparkSession.createDataFrame(pd.DataFrame({key: rows[key], "label": labels.astype("int32")}))
    fine = written(k_means(df, key, vector, micro))
    centre = centroids(df.select(key, vector).join(fine, key), "label", vector).orderBy("label").toPandas()  # micro rows
    merged = agglomerate(np.array(centre["centre"].tolist(), float), k, method, centre["n"].to_numpy())
    names = df.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(centre["label"], merged, strict=True)], "label int, merged int")
    return fine.join(F.broadcast(names), "label").select(key, F.col("merged").alias("label"))


def dispersion(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: n, k, within and total sums of squares, their ratio and Calinski-Harabasz."""
    whole = centroids(df.withColumn("_all", F.lit(0)), "_all", vector).select(F.col("centre").alias("_g"))
    own = centroids(df, label, vector).select(label, F.col("centre").alias("_c"))
    d = df.join(F.broadcast(own), label).join(F.broadcast(whole), how="cross")  # clusters; one row
    x = as_double(vector)
    s = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k"), F.sum(squared_distance(x, F.col("_c"))).alias("within"), F.sum(squared_distance(x, F.col("_g"))).alias("total"))
    ch = ((F.col("total") - F.col("within")) / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return s.withColumns({"ratio": F.col("within") / F.col("total"), "calinski_harabasz": F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), ch)})


def davies_bouldin(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: the mean over clusters of the worst (s_i + s_j) / d_ij."""
    c = centroids(df, label, vector)
    spread = df.join(F.broadcast(c), label).groupBy(label, "centre").agg(F.avg(F.sqrt(squared_distance(as_double(vector), F.col("centre")))).alias("s"))
    a, b = spread.toDF("la", "ca", "sa"), spread.toDF("lb", "cb", "sb")
    pairs = a.join(F.broadcast(b), F.col("la") != F.col("lb")).withColumn("r", (F.col("sa") + F.col("sb")) / F.sqrt(squared_distance(F.col("ca"), F.col("cb"))))  # cluster pairs
    return pairs.groupBy("la").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def s_dbw(df: DataFrame, label: str, vector: str) -> DataFrame:
    """convention, status, k, scatter, density, s_dbw: one row for each way to count around a centre.

    `pair` counts the rows of both clusters around each centre, `own` only those of its cluster;
    around the midpoint both count. Where a pair has nobody around either centre the density is
    not defined, and the status says so; so do too few or too many clusters, and rows all alike.
    """
    x = as_double(vector)

    def variance(rows: DataFrame, by: str) -> DataFrame:
        long = rows.select(by, F.posexplode(x).alias("i", "v")).groupBy(by, "i").agg(F.var_pop("v").alias("v"))
        return long.groupBy(by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))

    per, whole = variance(df, label), variance(df.withColumn("_all", F.lit(0)), "_all").select(F.col("norm").alias("whole"))
    scatter = per.agg(F.avg("norm").alias("mean"), (F.sqrt(F.sum("norm")) / F.count(F.lit(1))).alias("reach"), F.count(F.lit(1)).alias("k")).join(F.broadcast(whole), how="cross")  # one row each
    scatter = scatter.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))), how="cross")
    c = centroids(df, label, vector)
    a, b = c.select(F.col(label).alias("la"), F.col("centre").alias("ca")), c.select(F.col(label).alias("lb"), F.col("centre").alias("cb"))
    pairs = a.join(F.broadcast(b), F.col("la") < F.col("lb")).withColumn("mid", F.zip_with("ca", "cb", lambda p, q: (p + q) / 2))  # cluster pairs
    pairs = pairs.join(F.broadcast(scatter.select("reach")), how="cross")
    near = df.select(label, x.alias("x")).join(F.broadcast(pairs), (F.col(label) == F.col("la")) | (F.col(label) == F.col("lb")))
    inside = lambda centre, who=None: F.count_if((F.sqrt(squared_distance(F.col("x"), F.col(centre))) <= F.col("reach")) & (F.lit(True) if who is None else F.col(label) == F.col(who)))
    dens = near.groupBy("la", "lb").agg(inside("mid").alias("m"), F.greatest(inside("ca"), inside("cb")).alias("pair"), F.greatest(inside("ca", "la"), inside("cb", "lb")).alias("own"))
    each = dens.unpivot(["la", "lb", "m"], ["pair", "own"], "convention", "around")
    each = each.groupBy("convention").agg(F.avg(F.col("m") / F.nullif("around", F.lit(0))).alias("density"), F.count_if(F.col("around") == 0).alias("empty"))
    both = df.sparkSession.createDataFrame([("pair",), ("own",)], "convention string").join(each, "convention", "left").join(F.broadcast(scatter), how="cross")
    status = F.when((F.col("k") < 2) | (F.col("k") >= F.col("n")), "not defined: number of clusters").when(F.col("whole") == 0, "not defined: all rows alike").when(F.col("empty") > 0, "not defined: nobody around two centres").otherwise("computed")
    out = both.withColumn("status", status)
    known = lambda v: F.when(F.col("status") == "computed", v)
    ratio = F.col("mean") / F.nullif("whole", F.lit(0.0))
    return out.select("convention", "status", "k", ratio.alias("scatter"), known(F.col("density")).alias("density"), known(ratio + F.col("density")).alias("s_dbw"))


def silhouette(df: DataFrame, key: str, label: str, vector: str, block: int = 2048) -> DataFrame:
    """key, label, s: exact silhouettes; all pairs are compared block by block, and only sums per row and cluster leave a block."""
    from ledgerline.operators.neighbours import block_pairs, blocks_of

    packed, blocks = blocks_of(df, key, {"id": key, "l": label, "x": vector}, block)

    def sums(frames):
        for frame in frames:
            for mine, theirs in zip(frame["mine"], frame["theirs"], strict=True):
                a, b = (np.array([r["x"] for r in z], float) for z in (mine, theirs))
                ids, own = (np.array([r[c] for r in mine]) for c in ("id", "l"))
                names, of = np.unique([r["l"] for r in theirs], return_inverse=True)
                member = np.eye(len(names))[of]
                sizes = member.sum(axis=0).astype(int)
                for at in range(0, len(a), 32):
                    q = slice(at, at + 32)
                    s = np.sqrt(((a[q, None, :] - b[None, :, :]) ** 2).sum(axis=2)) @ member
                    yield pd.DataFrame({"id": np.repeat(ids[q], len(names)), "own": np.repeat(own[q], len(names)), "other": np.tile(names, len(s)), "s": s.ravel(), "n": np.tile(sizes, len(s))})

    found = block_pairs(packed, blocks).mapInPandas(sums, "id long, own int, other int, s double, n long")
    per = found.groupBy("id", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    a = F.max(F.when((F.col("own") == F.col("other")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1)))
    b = F.min(F.when(F.col("own") != F.col("other"), F.col("s") / F.col("n")))
    out = per.groupBy("id", "own").agg(a.alias("a"), b.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return out.select(F.col("id").alias(key), F.col("own").alias(label), F.coalesce(s, F.lit(0.0)).alias("s"))


def block_sums(edges: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """la <= lb, w: the weight of undirected edges (u, v, weight) between the clusters of their ends."""
    l = labels.select(F.col(node).alias("_n"), F.col(label).alias("_l"))
    e = edges.join(l.toDF("u", "lu"), "u").join(l.toDF("v", "lv"), "v")
    return e.groupBy(F.least("lu", "lv").alias("la"), F.greatest("lu", "lv").alias("lb")).agg(F.sum("weight").alias("w"))


def network_indices(edges: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """One row over K clusters with symmetric block sums S (inside edges count twice):

    avi, the mean of S_ii / sum_j S_ij; avu, 1/K of the sum over i <> j of S_ij / (out_i + out_j - S_ij), out_i
    being the weight that leaves i; anui = 1 / (avu + 1 / avi); and Newman's q. A cluster without edges counts as 0.
    """
    b = block_sums(edges, labels, node, label)
    turned = b.filter("la <> lb").select(F.col("lb").alias("la"), F.col("la").alias("lb"), "w")
    sym = b.withColumn("w", F.when(F.col("la") == F.col("lb"), F.col("w") * 2).otherwise(F.col("w"))).unionByName(turned)
    inside = F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0))
    per = sym.groupBy("la").agg(F.sum("w").alias("d"), inside.alias("i")).withColumn("out", F.col("d") - F.col("i"))
    k = labels.agg(F.count_distinct(label).alias("k"))
    sums = per.agg(F.sum(F.col("i") / F.col("d")).alias("a"), F.sum("i").alias("inside"), F.sum("d").alias("t"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    outs = per.select("la", F.col("out").alias("oa")), per.select(F.col("la").alias("lb"), F.col("out").alias("ob"))
    cross = sym.filter("la <> lb").join(F.broadcast(outs[0]), "la").join(F.broadcast(outs[1]), "lb")  # clusters
    u = cross.agg(F.coalesce(F.sum(F.col("w") / F.nullif(F.col("oa") + F.col("ob") - F.col("w"), F.lit(0.0))), F.lit(0.0)).alias("u"))
    one = sums.join(u, how="cross").join(k, how="cross")  # one row each
    avi, avu = F.col("a") / F.col("k"), F.col("u") / F.col("k")
    q = F.col("inside") / F.col("t") - F.col("dd") / (F.col("t") * F.col("t"))
    return one.select(avi.alias("avi"), avu.alias("avu"), F.when(avi == 0, 0.0).otherwise(1 / (avu + 1 / F.nullif(avi, F.lit(0.0)))).alias("anui"), q.alias("q"))


def moran(values: DataFrame, neighbours: DataFrame, node: str, value: str) -> DataFrame:
    """One row: Moran's I of the values over neighbours (node, other, d) with row-normalised inverse distances."""
    w = (1 / F.greatest("d", F.lit(1e-12))) / F.sum(1 / F.greatest("d", F.lit(1e-12))).over(Window.partitionBy("node"))
    mean = values.agg(F.avg(value).alias("_mean"))
    z = values.join(F.broadcast(mean), how="cross").select(F.col(node).alias("id"), (F.col(value) - F.col("_mean")).alias("z"))  # one row
    e = neighbours.withColumn("w", w).join(z.select(F.col("id").alias("node"), F.col("z").alias("za")), "node").join(z.select(F.col("id").alias("other"), F.col("z").alias("zb")), "other")
    num = e.agg(F.sum(F.col("w") * F.col("za") * F.col("zb")).alias("num"), F.sum("w").alias("w"))
    den = z.agg(F.sum(F.col("z") * F.col("z")).alias("den"), F.count(F.lit(1)).alias("n"))
    return num.join(den, how="cross").select((F.col("n") / F.col("w") * F.col("num") / F.col("den")).alias("moran"))  # one row each


def components(edges: DataFrame, x: str, y: str, shared: str | None = None) -> DataFrame:
    """node, component: the least node each node is connected with.

    Each round takes the least label among neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest path; every round is written out.
    """
    both = edges.select(F.col(x).alias("a"), F.col(y).alias("b")).unionByName(edges.select(F.col(y).alias("a"), F.col(x).alias("b"))).distinct()
    both = written(both)
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("near"))
        step = labels.join(near, "node").select("node", F.least("l", "near").alias("l"), F.col("l").alias("before"))
        jump = step.join(step.select(F.col("node").alias("l"), F.col("l").alias("further")), "l", "left")
        after = written(jump.select("node", F.least("l", F.coalesce("further", "l")).alias("l"), "before"))
        changed = after.filter("l <> before").limit(1).count()
        labels = after.select("node", "l")
        if not changed:
            return labels.withColumnRenamed("l", "component")


def co_association(assignments: DataFrame, node: str, config: str, label: str) -> DataFrame:
    """u < v, share: the fraction of configurations in which both are in one cluster, of the pairs that ever are."""
    n = assignments.agg(F.count_distinct(config).alias("_n"))
    a = assignments.select(F.col(node).alias("u"), config, label)
    b = assignments.select(F.col(node).alias("v"), config, label)
    pairs = a.join(b, [config, label]).filter("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("_k"))
    return pairs.join(F.broadcast(n), how="cross").select("u", "v", (F.col("_k") / F.col("_n")).alias("share"))  # one row


def neighbour_overlaps(rows: DataFrame, node: str, month: str, label: str, value: str) -> DataFrame:
    """month, la, lb, n, va, vb, na, nb, sa, sb: what a cluster of the month before and one of the month share.

    n members are in both, with va of the value before and vb now; na, nb and sa, sb are the
    members and values of the two clusters.
    """
    sizes = rows.groupBy(month, label).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    before = rows.select(node, (F.col(month) + 1).alias(month), F.col(label).alias("la"), F.col(value).alias("_va"))
    after = rows.select(node, month, F.col(label).alias("lb"), F.col(value).alias("_vb"))
    cells = before.join(after, [node, month]).groupBy(month, "la", "lb").agg(F.count(F.lit(1)).alias("n"), F.sum("_va").alias("va"), F.sum("_vb").alias("vb"))
    old = sizes.select((F.col(month) + 1).alias(month), F.col(label).alias("la"), F.col("n").alias("na"), F.col("s").alias("sa"))
    new = sizes.select(month, F.col(label).alias("lb"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    return cells.join(F.broadcast(old), [month, "la"]).join(F.broadcast(new), [month, "lb"])  # months x clusters


def match_labels(cost: np.ndarray) -> np.ndarray:
    """Columns assigned to rows at least total cost (the Hungarian method with potentials); rows <= columns."""
    n, m = cost.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            p[j0], j0 = p[j1], j1
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


def bhattacharyya(d2: Column, var_a: Column, var_b: Column, dims: int) -> Column:
    """Overlap of two isotropic Gaussians: exp of minus their Bhattacharyya distance."""
    mean = (var_a + var_b) / 2
    return F.exp(-(d2 / (8 * mean) + F.lit(dims / 2) * F.ln(mean / F.sqrt(var_a * var_b))))
