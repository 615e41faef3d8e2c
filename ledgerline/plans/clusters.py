"""Clusterings, networks and their validity over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.draws import draw_sql
from ledgerline.operators import aggregates as A
from ledgerline.operators import cluster as C
from ledgerline.operators import identities as I
from ledgerline.operators import network as N
from ledgerline.operators import panel as P
from ledgerline.operators.joins import mutual, squared_distance
from ledgerline.plans.registry import PANEL, TOTALS, query
from ledgerline.plans.relations import KNN, feature_neighbours
from ledgerline.sources import tables

EMB = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), l AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e), cm AS (SELECT label, i, avg(v) AS v, count(*) AS n FROM l GROUP BY 1, 2), c AS (SELECT label, max(n) AS n, list(v ORDER BY i) AS c FROM cm GROUP BY 1)"
D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def vectors(spark, root):
    return tables.scan(spark, root, "embeddings").select("vec_id", "label", "embedding")


@query("cl_01_k_means")
def _(spark, root):
    return C.k_means(vectors(spark, root), "vec_id", "embedding", 10)


@query("cl_02_ward")
def _(spark, root):
    return C.linkage_labels(vectors(spark, root), "vec_id", "embedding", 10, "ward")


@query("cl_03_method_comparison")
def _(spark, root):
    v = vectors(spark, root)
    spectral = C.power_iteration(graph(spark, root).toDF("src", "dst", "weight"), 10).select(F.col("id").alias("vec_id"), F.col("cluster").alias("label"))
    found = {"average": C.linkage_labels(v, "vec_id", "embedding", 10, "average"), "mixture": C.mixture(v, "vec_id", "embedding", 10), "bisecting": C.bisecting(v, "vec_id", "embedding", 10), "spectral, of the nodes with an edge": spectral}
    out = None
    for name, labels in found.items():
        both = v.join(labels.withColumnRenamed("label", "fitted"), "vec_id")
        one = A.adjusted_rand(both, "label", "fitted").join(both.agg(F.count(F.lit(1)).alias("n")), how="cross").select(F.lit(name).alias("method"), "n", "ari")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def graph(spark, root):
    """Mutual neighbours with weight 1 / (1 + d)."""
    nn = feature_neighbours(spark, root, 8)
    pairs = nn.groupBy(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d")).filter("n = 2")
    return pairs.select("u", "v", (1 / (1 + F.col("d"))).alias("weight"))


@query("cl_04_communities")
def _(spark, root):
    return N.communities(graph(spark, root))


E5 = KNN + ", e2 AS (SELECT least(node, other) AS u, greatest(node, other) AS v, min(d) AS d FROM nn GROUP BY 1, 2 HAVING count(*) = 2)"


@query("cl_05_components", E5.replace("WITH e AS", "WITH RECURSIVE e AS") + ", b AS (SELECT u AS x, v AS y FROM e2 UNION SELECT v, u FROM e2), r AS (SELECT x AS node, x AS root FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node) SELECT node, min(root) AS component FROM r GROUP BY 1")
def _(spark, root):
    return C.components(mutual(feature_neighbours(spark, root), "node", "other"), "u", "v")


@query("cl_06_joint_affinity")
def _(spark, root):
    v = vectors(spark, root).select("vec_id", "label")
    e = graph(spark, root).join(v.toDF("u", "lu"), "u").join(v.toDF("v", "lv"), "v")
    mixed = e.select(F.col("u").alias("src"), F.col("v").alias("dst"), (F.lit(0.7) * F.col("weight") + F.lit(0.3) * (F.col("lu") == F.col("lv")).cast("double")).alias("weight"))
    return C.power_iteration(mixed, 10).select("id", "cluster")


@query("cl_07_variable_k")
def _(spark, root):
    v = vectors(spark, root).select("vec_id", "embedding")
    return C.variable_k(v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(400), "vec_id", "embedding")  # the sample is the operator's own


def monthly(spark, root):
    """(tid, m, x: the five log volumes of a nation in a month that has them all; tid, m, label by a k-means for each month)."""
    wide = P.panel(spark, root).groupBy("tid", "m").agg(F.array_sort(F.collect_list(F.struct("cat", "value"))).alias("s")).filter(F.size("s") == 5)
    x = wide.select("tid", "m", F.transform("s", lambda v: F.ln(v["value"])).alias("x"))
    return x, C.k_means_by(x, ["m"], "tid", "x", 3)


@query("cl_08_monthly_k_means")
def _(spark, root):
    return monthly(spark, root)[1]


def aligned(spark, root):
    """(x, m, label, aligned with the labels of the month before): by the least sum of squared distances of centres."""
    x, labels = monthly(spark, root)
    rows = I.regions(x.join(labels, ["tid", "m"]), "m", "label", "x").orderBy("m", "label").collect()  # months x clusters
    months: dict[int, list] = {}
    for r in rows:
        months.setdefault(r["m"], []).append((r["label"], np.array(r["centre"])))
    out, previous = [], {}
    for m, own in sorted(months.items()):
        names = {label: label for label, _ in own}
        if previous:
            known = sorted(previous)
            cost = np.array([[((c - previous[j]) ** 2).sum() for j in known] for _, c in own])
            if len(own) <= len(known):
                names = {own[i][0]: known[j] for i, j in enumerate(C.match_labels(cost))}
            else:
                taken = {int(i): known[j] for j, i in enumerate(C.match_labels(cost.T))}
                free = iter(sorted({label for label, _ in own} | set(range(len(own) + len(known)))))
                used = set(taken.values())
                names = {own[i][0]: taken[i] if i in taken else next(f for f in free if f not in used) for i in range(len(own))}
        previous |= {names[label]: c for label, c in own}
        out += [(m, int(label), int(names[label])) for label, _ in own]
    return x, labels, spark.createDataFrame(out, "m int, label int, aligned int")


@query("cl_09_alignment")
def _(spark, root):
    return aligned(spark, root)[2]


@query("cl_10_switch_penalty")
def _(spark, root):
    x, labels, names = aligned(spark, root)
    named = x.join(labels, ["tid", "m"]).join(F.broadcast(names), ["m", "label"])  # months x clusters
    centre = C.centroids(named.select("aligned", "x"), "aligned", "x").select(F.col("aligned").alias("label"), F.col("centre").alias("c"))
    return N.penalised(x, centre, "tid", "m", "x", 0.5)


DAYS = "WITH t AS (SELECT user_id AS n, CAST(ts AS DATE) - DATE '2024-01-01' AS d, min(event_type) AS l, CAST(sum(value) AS DOUBLE) AS v FROM events GROUP BY 1, 2), sz AS (SELECT d, l, count(*) AS n, sum(v) AS v FROM t GROUP BY 1, 2), x AS (SELECT b.d, a.l AS la, b.l AS lb, count(*) AS n, sum(a.v) AS va, sum(b.v) AS vb FROM t a JOIN t b ON b.n = a.n AND b.d = a.d + 1 GROUP BY 1, 2, 3), o AS (SELECT x.*, p.n AS na, q.n AS nb, p.v AS sa, q.v AS sb FROM x JOIN sz p ON p.d = x.d - 1 AND p.l = la JOIN sz q ON q.d = x.d AND q.l = lb)"


def day_labels(spark, root):
    """n, d, l, v: every user's label and total of each day."""
    e = tables.scan(spark, root, "events")
    return e.groupBy(F.col("user_id").alias("n"), F.datediff("ts", F.lit("2024-01-01")).alias("d")).agg(F.min("event_type").alias("l"), F.sum("value").cast("double").alias("v"))


@query("cl_11_cluster_overlap", DAYS + " SELECT d, la, lb, n AS \"both\", round(n / least(na, nb), 9) AS share FROM o")
def _(spark, root):
    o = C.neighbour_overlaps(day_labels(spark, root), "n", "d", "l", "v")
    return o.select("d", "la", "lb", F.col("n").alias("both"), F.round(F.col("n") / F.least("na", "nb"), 9).alias("share"))


VAR = EMB + ", va AS (SELECT label, avg(v) AS var FROM (SELECT label, i, var_pop(v) AS v FROM l GROUP BY 1, 2) GROUP BY 1)"


@query("cl_12_bhattacharyya", VAR + " SELECT a.label AS la, b.label AS lb, round(exp(-(" + D2.format(a="a.c", b="b.c") + " / (8 * (x.var + y.var) / 2) + 32 * ln((x.var + y.var) / 2 / sqrt(x.var * y.var)))), 9) AS overlap FROM c a JOIN c b ON a.label < b.label JOIN va x ON x.label = a.label JOIN va y ON y.label = b.label")
def _(spark, root):
    v = vectors(spark, root)
    c = C.centroids(v, "label", "embedding")
    var = v.select("label", F.posexplode(C.as_double("embedding")).alias("i", "v")).groupBy("label", "i").agg(F.var_pop("v").alias("v")).groupBy("label").agg(F.avg("v").alias("var"))
    s = c.join(var, "label")
    a, b = s.select(F.col("label").alias("la"), F.col("centre").alias("ca"), F.col("var").alias("va")), s.select(F.col("label").alias("lb"), F.col("centre").alias("cb"), F.col("var").alias("vb"))
    pairs = a.join(F.broadcast(b), F.col("la") < F.col("lb"))  # clusters
    return pairs.select("la", "lb", F.round(C.bhattacharyya(squared_distance(F.col("ca"), F.col("cb")), F.col("va"), F.col("vb"), 64), 9).alias("overlap"))


TIMES = " + ".join(f"CAST(1 - {{u}} / {1 << 60}::DOUBLE <= {t!r}::DOUBLE AS INTEGER)" for t in I.TAILS)
DRAWN = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), l AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e), dr AS (SELECT CAST(unnest(range(40)) AS INTEGER) AS draw), uu AS (SELECT vec_id, draw, {draw_sql("vec_id", "0", "draw", seed=31)} AS u FROM e CROSS JOIN dr), tt AS (SELECT vec_id, draw, {TIMES.format(u="u")} AS t FROM uu),
mv AS (SELECT draw, label, i, sum(t * v) / sum(t) AS c, greatest(sum(t * v * v) / sum(t) - (sum(t * v) / sum(t)) * (sum(t * v) / sum(t)), 0) AS s FROM l JOIN tt USING (vec_id) WHERE t > 0 GROUP BY 1, 2, 3), md AS (SELECT draw, label, list(c ORDER BY i) AS c1, avg(s) AS v1 FROM mv GROUP BY 1, 2),
ow AS (SELECT label AS other, list(c ORDER BY i) AS c2, avg(s) AS v2 FROM (SELECT label, i, avg(v) AS c, var_pop(v) AS s FROM l GROUP BY 1, 2) GROUP BY 1), ov AS (SELECT draw, label, other, exp(-{D2.format(a="c1", b="c2")} / (8 * (v1 + v2) / 2) - 32 * ln((v1 + v2) / 2 / sqrt(v1 * v2))) AS o FROM md CROSS JOIN ow)"""


def drawn(spark, root):
    return I.resampled(vectors(spark, root).withColumn("m", F.lit(0)), "vec_id", "m", "label", "embedding")


@query("cl_13_overlap_thresholds", DRAWN + ", q AS (SELECT quantile_cont(o, 0.05) FILTER (WHERE label = other) AS s, quantile_cont(o, 0.95) FILTER (WHERE label <> other) AS h, quantile_cont(o, 0.5) FILTER (WHERE label <> other) AS f FROM ov) SELECT round(s, 6) AS own_q05, round(h, 6) AS other_q95, round(h, 6) AS keep, round(greatest(s - h, 0), 6) AS margin, round(f, 6) AS floor, s < h AS ambiguous FROM q")
def _(spark, root):
    q = I.calibrate(drawn(spark, root), "label")
    return q.select(*(F.round(c, 6).alias(c) for c in q.columns if c != "ambiguous"), "ambiguous")


def seen(spark, root):
    """(regions of the monthly clusters, thresholds from the first twelve months)."""
    x, labels = monthly(spark, root)
    rows = x.join(labels, ["tid", "m"])
    first = rows.filter(F.col("m") < P.FIRST + 12)
    return I.regions(rows, "m", "label", "x"), I.calibrate(I.resampled(first, "tid", "m", "label", "x"), "label")


@query("cl_14_identity_tracking")
def _(spark, root):
    found, thresholds = seen(spark, root)
    return I.follow(found, "m", "label", thresholds)


KAPPAS = [0.15, 0.25, 0.35]


@query(
    "cl_15_containment",
    DAYS + f", k AS (SELECT CAST(unnest({KAPPAS}) AS DOUBLE) AS kappa), c AS (SELECT d, la, lb, n / na AS kept, va / sa AS kept_value, n / nb AS made, vb / sb AS made_value, kappa FROM o CROSS JOIN k), f AS (SELECT *, kept >= kappa AND kept_value >= kappa AS part_of_split, made >= kappa AND made_value >= kappa AS part_of_merge FROM c) SELECT d, la, lb, kappa, round(kept, 9) AS kept, round(kept_value, 6) AS kept_value, round(made, 9) AS made, round(made_value, 6) AS made_value, part_of_split, part_of_merge, part_of_split AND count(*) FILTER (WHERE part_of_split) OVER (PARTITION BY d, la, kappa) > 1 AS split, part_of_merge AND count(*) FILTER (WHERE part_of_merge) OVER (PARTITION BY d, lb, kappa) > 1 AS merge FROM f",
)
def _(spark, root):
    o = C.neighbour_overlaps(day_labels(spark, root), "n", "d", "l", "v")
    c = o.select("d", "la", "lb", (F.col("n") / F.col("na")).alias("kept"), (F.col("va") / F.col("sa")).alias("kept_value"), (F.col("n") / F.col("nb")).alias("made"), (F.col("vb") / F.col("sb")).alias("made_value"), F.explode(F.array(*(F.lit(k) for k in KAPPAS))).alias("kappa"))
    f = c.withColumns({"part_of_split": (F.col("kept") >= F.col("kappa")) & (F.col("kept_value") >= F.col("kappa")), "part_of_merge": (F.col("made") >= F.col("kappa")) & (F.col("made_value") >= F.col("kappa"))})
    several = lambda flag, side: F.col(flag) & (F.count_if(F.col(flag)).over(Window.partitionBy("d", side, "kappa")) > 1)
    f = f.withColumns({"split": several("part_of_split", "la"), "merge": several("part_of_merge", "lb")})
    return f.select("d", "la", "lb", "kappa", F.round("kept", 9).alias("kept"), F.round("kept_value", 6).alias("kept_value"), F.round("made", 9).alias("made"), F.round("made_value", 6).alias("made_value"), "part_of_split", "part_of_merge", "split", "merge")


@query("cl_16_identity_worlds")
def _(spark, root):
    w = I.written(I.worlds(spark))
    found = I.regions(w, "m", "label", "x", ["world"])
    thresholds = I.calibrate(I.resampled(w.filter("m < 12").withColumn("m", F.concat_ws(":", "world", "m")), "node", "m", "label", "x"), "label")
    events = I.follow(found, "m", "label", thresholds, ["world"])
    return I.score_identities(events, w.select("world", "m", "label", "subject").distinct())


@query("cl_17_centroid_margin", EMB + ", d AS (SELECT e.vec_id, sqrt(" + D2.format(a="e.x", b="c.c") + ") AS d, row_number() OVER (PARTITION BY e.vec_id ORDER BY " + D2.format(a="e.x", b="c.c") + ", c.label) AS r FROM e CROSS JOIN c) SELECT a.vec_id, round((b.d - a.d) / (b.d + a.d), 9) AS margin FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2")
def _(spark, root):
    v = vectors(spark, root)
    return C.assign(v.drop("label"), C.centroids(v, "label", "embedding"), "label", "embedding").select("vec_id", F.round("margin", 9).alias("margin"))


@query("cl_18_nearest_centroid", EMB + ", d AS (SELECT e.vec_id, c.label, round(" + D2.format(a="e.x", b="c.c") + ", 9) AS distance, row_number() OVER (PARTITION BY e.vec_id ORDER BY " + D2.format(a="e.x", b="c.c") + ", c.label) AS r FROM e CROSS JOIN c) SELECT vec_id, label, distance FROM d WHERE r = 1")
def _(spark, root):
    v = vectors(spark, root)
    return C.assign(v.drop("label"), C.centroids(v, "label", "embedding"), "label", "embedding").select("vec_id", "label", F.round("distance", 9).alias("distance"))


CO = "WITH t AS (SELECT CAST(c_nationkey AS BIGINT) AS node, c_mktsegment AS config, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY avg(c_acctbal), c_nationkey) AS INTEGER) AS label FROM customer GROUP BY 1, 2, c_nationkey)"


def configurations(spark, root):
    a = tables.scan(spark, root, "customer").groupBy(F.col("c_nationkey").cast("long").alias("node"), F.col("c_mktsegment").alias("config")).agg(F.avg("c_acctbal").alias("v"))
    return a.withColumn("label", F.ntile(4).over(Window.partitionBy("config").orderBy("v", "node"))).drop("v")


@query("cl_19_co_association", CO + " SELECT a.node AS u, b.node AS v, count(*) / (SELECT count(DISTINCT config) FROM t) AS share FROM t a JOIN t b ON a.config = b.config AND a.label = b.label AND a.node < b.node GROUP BY 1, 2")
def _(spark, root):
    return C.co_association(configurations(spark, root), "node", "config", "label")


@query("cl_20_consensus_cores")
def _(spark, root):
    return N.consensus_cores(C.co_association(configurations(spark, root), "node", "config", "label"), configurations(spark, root).select("node").distinct(), 0.5)


@query("cl_21_core_passports")
def _(spark, root):
    return N.passports(vectors(spark, root).withColumn("region", F.pmod("vec_id", F.lit(7))), "vec_id", "label", "embedding", "region")


@query("cl_22_silhouette", EMB + ", d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(sqrt(" + D2.format(a="a.x", b="b.x") + ")) AS s, count(*) AS n FROM e a CROSS JOIN e b GROUP BY 1, 2, 3), m AS (SELECT vec_id, own, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1, 2) SELECT vec_id, own AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 9) AS s FROM m")
def _(spark, root):
    return C.silhouette(vectors(spark, root), "vec_id", "label", "embedding").withColumn("s", F.round("s", 9))


SS = EMB + ", g AS (SELECT list(v ORDER BY i) AS g FROM (SELECT i, avg(v) AS v FROM l GROUP BY 1)), s AS (SELECT count(*) AS n, count(DISTINCT e.label) AS k, sum(" + D2.format(a="e.x", b="c.c") + ") AS w, sum(" + D2.format(a="e.x", b="g.g") + ") AS t FROM e JOIN c ON c.label = e.label CROSS JOIN g)"


@query("cl_23_calinski_harabasz", SS + " SELECT n, k, round(((t - w) / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM s")
def _(spark, root):
    return C.dispersion(vectors(spark, root), "label", "embedding").select("n", "k", F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query("cl_23_davies_bouldin", EMB + ", s AS (SELECT e.label, avg(sqrt(" + D2.format(a="e.x", b="c.c") + ")) AS s FROM e JOIN c ON c.label = e.label GROUP BY 1), r AS (SELECT a.label, max((sa.s + sb.s) / sqrt(" + D2.format(a="a.c", b="b.c") + ")) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1) SELECT round(avg(r), 9) AS davies_bouldin FROM r")
def _(spark, root):
    return C.davies_bouldin(vectors(spark, root), "label", "embedding").select(F.round("davies_bouldin", 9).alias("davies_bouldin"))


def s_dbw_sql(rows: str) -> str:
    """S_Dbw of rows (label, x) in both conventions."""
    return f"""WITH e AS ({rows}), l AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e), c AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS v FROM l GROUP BY 1, 2) GROUP BY 1),
nv AS (SELECT label, sqrt(sum(v * v)) AS norm FROM (SELECT label, i, var_pop(v) AS v FROM l GROUP BY 1, 2) GROUP BY 1), sc AS (SELECT avg(norm) / (SELECT sqrt(sum(v * v)) FROM (SELECT i, var_pop(v) AS v FROM l GROUP BY 1)) AS scatter, sqrt(sum(norm)) / count(*) AS reach, count(*) AS k FROM nv),
pr AS (SELECT a.label AS la, b.label AS lb, a.c AS ca, b.c AS cb, list_transform(list_zip(a.c, b.c), lambda z: (z[1] + z[2]) / 2) AS mid FROM c a JOIN c b ON a.label < b.label),
ct AS (SELECT la, lb, count(*) FILTER (WHERE sqrt({D2.format(a="x", b="mid")}) <= reach) AS m, count(*) FILTER (WHERE sqrt({D2.format(a="x", b="ca")}) <= reach) AS pa, count(*) FILTER (WHERE sqrt({D2.format(a="x", b="cb")}) <= reach) AS pb, count(*) FILTER (WHERE label = la AND sqrt({D2.format(a="x", b="ca")}) <= reach) AS oa, count(*) FILTER (WHERE label = lb AND sqrt({D2.format(a="x", b="cb")}) <= reach) AS ob FROM pr JOIN e ON label = la OR label = lb CROSS JOIN sc GROUP BY 1, 2),
dn AS (SELECT 'pair' AS convention, m, greatest(pa, pb) AS around FROM ct UNION ALL SELECT 'own', m, greatest(oa, ob) FROM ct), dd AS (SELECT convention, avg(m / nullif(around, 0)) AS density, count(*) FILTER (WHERE around = 0) AS empty FROM dn GROUP BY 1)
SELECT convention, CASE WHEN empty > 0 THEN 'not defined: nobody around two centres' ELSE 'computed' END AS status, k, round(scatter, 9) AS scatter, round(CASE WHEN empty = 0 THEN density END, 9) AS density, round(CASE WHEN empty = 0 THEN scatter + density END, 9) AS s_dbw FROM dd CROSS JOIN sc"""


def rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if k == "double" else c for c, k in df.dtypes))


@query("cl_24_s_dbw", s_dbw_sql("SELECT label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"))
def _(spark, root):
    return rounded(C.s_dbw(vectors(spark, root), "label", "embedding"))


@query("cl_24_s_dbw_density", s_dbw_sql("SELECT p_brand AS label, [p_size / 10, p_retailprice / 100] AS x FROM part"))
def _(spark, root):
    p = tables.scan(spark, root, "part").select(F.col("p_brand").alias("label"), F.array(F.col("p_size") / 10, F.col("p_retailprice") / 100).alias("x"))
    return rounded(C.s_dbw(p, "label", "x"))


NET = E5 + ", w AS (SELECT u, v, 1 / (1 + d) AS weight FROM e2), lb AS (SELECT vec_id, label FROM embeddings), s0 AS (SELECT least(a.label, b.label) AS la, greatest(a.label, b.label) AS lb, sum(weight) AS w FROM w JOIN lb a ON a.vec_id = u JOIN lb b ON b.vec_id = v GROUP BY 1, 2), s AS (SELECT la, lb, CASE WHEN la = lb THEN 2 * w ELSE w END AS w FROM s0 UNION ALL SELECT lb, la, w FROM s0 WHERE la <> lb), d AS (SELECT la, sum(w) AS d, coalesce(sum(w) FILTER (WHERE la = lb), 0) AS i FROM s GROUP BY 1), u AS (SELECT sum(s.w / (a.d - a.i + b.d - b.i - s.w)) AS u FROM s JOIN d a ON a.la = s.la JOIN d b ON b.la = s.lb WHERE s.la <> s.lb), kk AS (SELECT count(DISTINCT label) AS k FROM lb), z AS (SELECT (SELECT sum(i / d) FROM d) / k AS avi, (SELECT u FROM u) / k AS avu, (SELECT sum(i) / sum(d) - sum(d * d) / (sum(d) * sum(d)) FROM d) AS q FROM kk)"


def mutual_edges(spark, root):
    """u, v, weight of mutual neighbours among the five nearest."""
    e = feature_neighbours(spark, root).groupBy(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d")).filter("n = 2")
    return e.select("u", "v", (1 / (1 + F.col("d"))).alias("weight"))


@query("cl_25_network_indices", NET + " SELECT round(avi, 9) AS avi, round(avu, 9) AS avu, round(1 / (avu + 1 / avi), 9) AS anui, round(q, 9) AS q FROM z")
def _(spark, root):
    out = C.network_indices(mutual_edges(spark, root), vectors(spark, root), "vec_id", "label")
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


def dealt_sql(rows: str, key: str, value: str, draws: int, seed: int, strata: str = "") -> str:
    """CTE dealt(draw, key, value) over rows (key, value, strata); draw 0 is as it was."""
    also, on = (f", {strata}", f" AND a.{strata} = b.{strata}") if strata else ("", "")
    return f"""pool AS ({rows}), each AS (SELECT *, {draw_sql(key, "draw", seed=seed)} AS h FROM pool CROSS JOIN (SELECT CAST(unnest(range(1, {draws + 1})) AS INTEGER) AS draw)),
oa AS (SELECT draw, {key}{also}, row_number() OVER (PARTITION BY draw{also} ORDER BY {key}) AS i FROM each), ob AS (SELECT draw{also}, {value}, row_number() OVER (PARTITION BY draw{also} ORDER BY h, {key}) AS i FROM each),
dealt AS (SELECT a.draw, a.{key}{", a." + strata if strata else ""}, b.{value} FROM oa a JOIN ob b ON a.draw = b.draw AND a.i = b.i{on} UNION ALL SELECT 0, {key}{also}, {value} FROM pool)"""


@query(
    "cl_26_partition_null",
    E5 + ", w AS (SELECT u, v, 1 / (1 + d) AS weight FROM e2), " + dealt_sql("SELECT vec_id, label FROM embeddings", "vec_id", "label", 300, 41)
    + ", s AS (SELECT a.draw, sum(weight) FILTER (WHERE a.label = b.label) / sum(weight) AS s FROM w JOIN dealt a ON a.vec_id = u JOIN dealt b ON b.vec_id = v AND b.draw = a.draw GROUP BY 1), t AS (SELECT max(s) FILTER (WHERE draw = 0) AS observed, avg(coalesce(s, 0)) FILTER (WHERE draw > 0) AS mean, stddev_pop(coalesce(s, 0)) FILTER (WHERE draw > 0) AS spread FROM s) SELECT round(observed, 9) AS observed, round(mean, 9) AS mean, round(spread, 9) AS spread, round((observed - mean) / spread, 5) AS z FROM t",
)
def _(spark, root):
    e = mutual_edges(spark, root)
    out = N.partition_null(e, vectors(spark, root).select("vec_id", "label"), "vec_id", "label")
    return out.select(*(F.round(c, 5 if c == "z" else 9).alias(c) for c in out.columns))


@query("cl_27_dispersion_ratio", SS + " SELECT round(w / t, 9) AS ratio FROM s")
def _(spark, root):
    return C.dispersion(vectors(spark, root), "label", "embedding").select(F.round("ratio", 9).alias("ratio"))


@query("cl_28_degrees", E5 + ", b AS (SELECT u AS n FROM e2 UNION ALL SELECT v FROM e2), g AS (SELECT vec_id, count(b.n) AS degree FROM embeddings LEFT JOIN b ON b.n = vec_id GROUP BY 1) SELECT count(*) AS nodes, count(*) FILTER (WHERE degree = 0) AS isolates, median(degree) AS med, max(degree) AS most, round(quantile_cont(degree, 0.9), 9) AS q90 FROM g")
def _(spark, root):
    g = N.degrees(mutual(feature_neighbours(spark, root), "node", "other"), vectors(spark, root).select(F.col("vec_id").alias("node")))
    return g.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolates"), F.median("degree").alias("med"), F.max("degree").alias("most"), F.round(F.percentile("degree", F.lit(0.9)), 9).alias("q90"))


@query("cl_29_moran", KNN + ", w AS (SELECT node, other, (1 / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)) OVER (PARTITION BY node) AS w FROM nn), z AS (SELECT vec_id, label - (SELECT avg(label) FROM embeddings) AS z FROM embeddings) SELECT round((SELECT count(*) FROM z) / sum(w.w) * sum(w.w * a.z * b.z) / (SELECT sum(z * z) FROM z), 9) AS moran FROM w JOIN z a ON a.vec_id = w.node JOIN z b ON b.vec_id = w.other")
def _(spark, root):
    return C.moran(vectors(spark, root), feature_neighbours(spark, root), "vec_id", "label").select(F.round("moran", 9).alias("moran"))


@query(
    "cl_29_moran_permutations",
    KNN + ", w AS (SELECT node, other, (1 / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)) OVER (PARTITION BY node) AS w FROM nn), " + dealt_sql("SELECT vec_id, label FROM embeddings", "vec_id", "label", 99, 43)
    + ", mu AS (SELECT avg(label) AS mu, var_pop(label) AS va FROM embeddings), i AS (SELECT a.draw, sum(w * (a.label - mu) * (b.label - mu)) / sum(w) / any_value(va) AS i FROM w JOIN dealt a ON a.vec_id = node JOIN dealt b ON b.vec_id = other AND b.draw = a.draw CROSS JOIN mu GROUP BY 1), o AS (SELECT i AS o FROM i WHERE draw = 0) SELECT round(o, 9) AS observed, round(count(*) FILTER (WHERE i >= o - 1e-12) / count(*), 9) AS p FROM i CROSS JOIN o GROUP BY o",
)
def _(spark, root):
    out = N.moran_null(vectors(spark, root).select("vec_id", "label"), feature_neighbours(spark, root), "vec_id", "label", 99)
    return out.select(F.round("observed", 9).alias("observed"), F.round("p", 9).alias("p"))


@query("cl_30_fixed_effects_regression", TOTALS + ", x AS (SELECT t.tid, t.m, CAST(n_regionkey AS BIGINT) AS region, ln(t.value) AS y, ln(a.value) AS x FROM total t JOIN total a ON a.tid = t.tid AND a.m = t.m - 12 JOIN nation ON n_nationkey = t.tid), d AS (SELECT y - avg(y) OVER (PARTITION BY region) AS y, x - avg(x) OVER (PARTITION BY region) AS x FROM x) SELECT round(sum(x * y) / sum(x * x), 9) AS slope, count(*) AS n FROM d")
def _(spark, root):
    from ledgerline.functions.calendar import at_lag

    n = tables.scan(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("tid"), "n_regionkey")
    t = P.totals(spark, root).withColumn("a", at_lag("value", 12, ["tid"])).na.drop().join(F.broadcast(n), "tid")  # nations
    w = Window.partitionBy("n_regionkey")
    y, x = F.ln("value"), F.ln("a")
    d = t.select((y - F.avg(y).over(w)).alias("y"), (x - F.avg(x).over(w)).alias("x"))
    return d.agg(F.round(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), 9).alias("slope"), F.count(F.lit(1)).alias("n"))


@query("cl_31_ols_statistics", "SELECT regr_count(l_extendedprice, l_quantity) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(1 - (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 1) / (count(*) - 2), 9) AS adjusted_r2 FROM lineitem")
def _(spark, root):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    n = F.count(F.lit(1))
    return tables.scan(spark, root, "lineitem").agg(F.regr_count(y, x).alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(1 - (1 - F.regr_r2(y, x)) * (n - 1) / (n - 2), 9).alias("adjusted_r2"))


@query("cl_31_holm", "WITH p AS (SELECT event_type, 1 / (1 + count(*)) AS p FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS i, count(*) OVER () AS n FROM p) SELECT event_type, round(least(max((n - i + 1) * p) OVER (ORDER BY i), 1), 9) AS adjusted FROM r")
def _(spark, root):
    p = tables.scan(spark, root, "events").groupBy("event_type").agg((1 / (1 + F.count(F.lit(1)))).alias("p"))
    return N.holm(p, "event_type", "p").withColumn("adjusted", F.round("adjusted", 9))


@query("cl_32_grouped_folds")
def _(spark, root):
    from ledgerline.operators.forecast import linear, ridge

    n = tables.scan(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("tid"), F.col("n_regionkey").alias("fold"))
    from ledgerline.functions.calendar import at_lag

    t = P.totals(spark, root).withColumns({"a": at_lag("value", 1, ["tid"]), "b": at_lag("value", 12, ["tid"])}).na.drop().join(F.broadcast(n), "tid")  # nations
    out = None
    for fold in range(5):
        beta = ridge(t.filter(F.col("fold") != fold), ["a", "b"], "value", 0.1)
        one = t.filter(F.col("fold") == fold).select("fold", F.abs(F.col("value") - linear(beta, ["a", "b"])).alias("e")).groupBy("fold").agg(F.avg("e").alias("mae"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


REGIONAL = TOTALS + ", reg AS (SELECT t.tid * 100000 + t.m AS id, CAST(n_regionkey AS BIGINT) AS region, ln(t.value) AS y, ln(a.value) AS x FROM total t JOIN total a ON a.tid = t.tid AND a.m = t.m - 12 JOIN nation ON n_nationkey = t.tid), "


@query(
    "cl_31_within_region_permutation",
    REGIONAL + dealt_sql("SELECT id, region, x FROM reg", "id", "x", 199, 47, "region") + ", s AS (SELECT draw, regr_slope(y, dealt.x) AS s, count(*) AS n FROM dealt JOIN reg USING (id) GROUP BY 1), o AS (SELECT s AS o, n FROM s WHERE draw = 0) SELECT round(o, 9) AS slope, o.n, round(count(*) FILTER (WHERE abs(s) >= abs(o) - 1e-12) / count(*), 9) AS p FROM s CROSS JOIN o GROUP BY o, o.n",
)
def _(spark, root):
    from ledgerline.functions.calendar import at_lag

    n = tables.scan(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("tid"), F.col("n_regionkey").cast("long").alias("region"))
    t = P.totals(spark, root).withColumn("a", at_lag("value", 12, ["tid"])).na.drop().join(F.broadcast(n), "tid")  # nations
    rows = t.select((F.col("tid") * 100000 + F.col("m")).alias("id"), "region", F.ln("value").alias("y"), F.ln("a").alias("x"))
    each = N.dealt(rows, "id", ["region"], "x", 199, 47).select("draw", "id", "x").unionByName(rows.select(F.lit(0).alias("draw"), "id", "x"))
    s = each.join(rows.select("id", "y"), "id").groupBy("draw").agg(F.regr_slope("y", "x").alias("s"), F.count(F.lit(1)).alias("n"))
    o = F.max(F.when(F.col("draw") == 0, F.col("s"))).over(Window.partitionBy(F.lit(0)))  # a row for each draw
    return s.withColumn("o", o).groupBy("o", "n").agg((F.count_if(F.abs("s") >= F.abs("o") - 1e-12) / F.count(F.lit(1))).alias("p")).select(F.round("o", 9).alias("slope"), "n", F.round("p", 9).alias("p"))


@query("cl_33_stratified_permutation", "WITH " + dealt_sql("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer", "c_custkey", "c_mktsegment", 1, 1, "c_nationkey") + " SELECT c_custkey, c_nationkey, c_mktsegment FROM dealt WHERE draw = 1")
def _(spark, root):
    c = tables.scan(spark, root, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return N.permuted(c, "c_custkey", ["c_nationkey"], "c_mktsegment", 1)


@query(
    "cl_34_cluster_bootstrap",
    TOTALS + f", k AS (SELECT tid, row_number() OVER (ORDER BY tid) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT tid FROM total)), per AS (SELECT tid, sum(value) AS s, count(*) AS n FROM total GROUP BY 1), sl AS (SELECT unnest(range(1, 50 * (SELECT max(n) FROM k) + 1)) AS id), pk AS (SELECT CAST(floor((id - 1) / (SELECT max(n) FROM k)) + 1 AS INTEGER) AS draw, {draw_sql('id', seed=37)} % (SELECT max(n) FROM k) + 1 AS i FROM sl) SELECT draw, round(sum(s) / sum(per.n), 4) AS mean FROM pk JOIN k USING (i) JOIN per USING (tid) GROUP BY 1",
)
def _(spark, root):
    t = P.totals(spark, root)
    w = N.bootstrap_counts(t.select("tid").distinct(), "tid", 50)
    per = t.groupBy("tid").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return w.join(per, "tid").groupBy("draw").agg(F.round(F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n")), 4).alias("mean"))


@query("cl_35_weight_ablation")
def _(spark, root):
    v = vectors(spark, root)
    runs = F.explode(F.array(*(F.struct(F.lit(w).alias("weight"), F.lit(s).alias("seed")) for w in (0.0, 0.5, 1.0) for s in range(5))))
    x = v.select("vec_id", "embedding", runs.alias("run")).select("vec_id", "run.*", F.concat(C.as_double("embedding"), F.array(F.col("run.weight") * F.ln(F.col("vec_id") + 1) / 10)).alias("x"))
    labels = I.written(C.k_means_by(x, ["weight", "seed"], "vec_id", "x", 10).withColumnRenamed("label", "fitted"))
    out = None
    for w in (0.0, 0.5, 1.0):
        for s in range(5):
            own = labels.filter((F.col("weight") == w) & (F.col("seed") == s))
            one = A.adjusted_rand(v.join(own, "vec_id"), "label", "fitted").select(F.lit(w).alias("weight"), F.lit(s).alias("seed"), "ari")
            out = one if out is None else out.unionByName(one)
    return out


@query("cl_36_threshold_sweep", PANEL + ", g AS (SELECT p.tid, p.cat, p.m, abs(p.value / a.value - 1) AS g FROM panel p JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1), k AS (SELECT unnest([0.3, 0.5, 0.8]) AS k) SELECT CAST(k AS DOUBLE) AS k, count(*) FILTER (WHERE g > k) AS n, round(count(*) FILTER (WHERE g > k AND g > 0.5) / count(*) FILTER (WHERE g > k OR g > 0.5), 9) AS jaccard FROM g CROSS JOIN k GROUP BY 1")
def _(spark, root):
    from ledgerline.functions.calendar import at_lag

    p = P.panel(spark, root).withColumn("a", at_lag("value", 1, ["tid", "cat"])).na.drop(subset=["a"])
    g = p.select(F.abs(F.col("value") / F.col("a") - 1).alias("g"), F.explode(F.array(*(F.lit(k) for k in (0.3, 0.5, 0.8)))).alias("k"))
    over, main = F.col("g") > F.col("k"), F.col("g") > 0.5
    return g.groupBy("k").agg(F.count_if(over).alias("n"), F.round(F.count_if(over & main) / F.count_if(over | main), 9).alias("jaccard"))


@query("cl_37_margin_audit", DRAWN + ", g AS (SELECT draw, label, max(o) FILTER (WHERE label = other) - max(o) FILTER (WHERE label <> other) AS gap FROM ov GROUP BY 1, 2) SELECT label, round(quantile_cont(gap, 0.05), 6) AS q05, round(quantile_cont(gap, 0.5), 6) AS q50, round(avg(CASE WHEN gap <= 0.1 THEN 1 ELSE 0 END), 6) AS share_close FROM g GROUP BY 1")
def _(spark, root):
    d = I.margins(drawn(spark, root), [], "label")
    return d.groupBy("label").agg(F.round(F.percentile("gap", F.lit(0.05)), 6).alias("q05"), F.round(F.percentile("gap", F.lit(0.5)), 6).alias("q50"), F.round(F.avg((F.col("gap") <= 0.1).cast("int")), 6).alias("share_close"))


@query("cl_38_threshold_sensitivity")
def _(spark, root):
    found, t = seen(spark, root)
    found, t = I.written(found), I.written(t)
    base = I.follow(found, "m", "label", t)
    names = lambda e: F.concat_ws(":", "m", F.coalesce(F.col("label").cast("string"), F.lit("-")), F.coalesce(F.col("identity").cast("string"), F.lit("-")), "status")
    stored = I.written(base.select(names(base).alias("event"), "status"))
    out = None
    for f in (0.75, 1.0, 1.25):
        scaled = t.select(*((F.col(c) * f).alias(c) for c in ("keep", "margin", "floor")))
        e = I.follow(found, "m", "label", scaled)
        e = e.select(names(e).alias("event"), "status").join(stored.select("event", F.lit(1).alias("same")), "event", "left")
        one = e.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("same").alias("as_stored")).select(F.lit(f).alias("factor"), "status", "n", "as_stored")
        out = one if out is None else out.unionByName(one)
    return out
