"""Aggregates, metrics and agreement measures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import calendar, stats
from ledgerline.operators import aggregates as A
from ledgerline.operators import panel as P
from ledgerline.operators.shape import pivot
from ledgerline.plans.registry import PANEL, TOTALS, query
from ledgerline.sources import tables

BY = ["tid", "cat"]
LAGGED = PANEL + """, f AS (SELECT p.tid, p.cat, p.m, p.value, a.value AS last, b.value AS seasonal FROM panel p JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1 JOIN panel b ON b.tid = p.tid AND b.cat = p.cat AND b.m = p.m - 12)"""


def forecasts(spark, root):
    """The panel with last value and seasonal naive, where all three are known."""
    p = P.panel(spark, root)
    return p.withColumns({"last": calendar.at_lag("value", 1, BY), "seasonal": calendar.at_lag("value", 12, BY)}).na.drop(subset=["last", "seasonal"])


@query(
    "agg_01_summary",
    "SELECT event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, round(avg(value), 9) AS mean, min(value) AS low, max(value) AS high, median(value) AS med FROM events GROUP BY 1",
)
def _(spark, root):
    e = tables.scan(spark, root, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(P.exact_sum("value"), 2).alias("total"), F.round(F.avg("value"), 9).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.median("value").alias("med"))


@query("agg_02_named_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg((l_extendedprice * l_discount) ^ 2), 2) AS mse, round(avg(l_quantity), 9) AS mean_quantity FROM lineitem GROUP BY 1, 2")
def _(spark, root):
    d = F.col("l_extendedprice") * F.col("l_discount")
    return tables.scan(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d * d), 2).alias("mse"), F.round(F.avg("l_quantity"), 9).alias("mean_quantity"))


@query("agg_03_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) > 1 AS conflict FROM events GROUP BY 1")
def _(spark, root):
    return tables.scan(spark, root, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), (F.count_distinct("props") > 1).alias("conflict"))


@query("agg_04_conditional_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 20) AS large, count(*) AS n FROM events GROUP BY 1")
def _(spark, root):
    return tables.scan(spark, root, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 20).alias("large"), F.count(F.lit(1)).alias("n"))


@query("agg_05_having_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, root):
    return tables.scan(spark, root, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "agg_06_sum_min_count",
    "SELECT o_custkey, CASE WHEN count(x) >= 2 THEN CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) END AS total FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS x FROM orders) GROUP BY 1",
)
def _(spark, root):
    x = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))
    return tables.scan(spark, root, "orders").select("o_custkey", x.alias("x")).groupBy("o_custkey").agg(A.sum_min_count("x", 2).cast("double").alias("total"))


@query("agg_07_resolve_unique", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY 1")
def _(spark, root):
    return tables.scan(spark, root, "lineitem").groupBy("l_orderkey").agg(A.resolve_unique("l_returnflag").alias("flag"))


@query(
    "agg_08_pivot",
    PANEL + " SELECT tid, m, max(value) FILTER (WHERE cat = 'AUTOMOBILE') AS automobile, max(value) FILTER (WHERE cat = 'BUILDING') AS building, max(value) FILTER (WHERE cat = 'MACHINERY') AS machinery FROM panel GROUP BY 1, 2",
)
def _(spark, root):
    wide = pivot(P.panel(spark, root), ["tid", "m"], "cat", ["AUTOMOBILE", "BUILDING", "MACHINERY"], F.max("value"))
    return wide.toDF("tid", "m", "automobile", "building", "machinery")


@query(
    "agg_09_mode",
    """WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, max(n) AS best, sum(n) AS all_n FROM c GROUP BY 1)
SELECT c.o_custkey, min(p) AS mode, max(n) / max(all_n) AS share, count(*) > 1 AS tied FROM c JOIN b ON b.o_custkey = c.o_custkey AND n = best GROUP BY 1""",
)
def _(spark, root):
    return A.mode(tables.scan(spark, root, "orders"), ["o_custkey"], "o_orderpriority")


@query(
    "agg_10_quantiles",
    "SELECT event_type, round(quantile_cont(value, 0.01), 9) AS q01, round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.975), 9) AS q975 FROM events GROUP BY 1",
)
def _(spark, root):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 9)
    return tables.scan(spark, root, "events").groupBy("event_type").agg(q(0.01).alias("q01"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.975).alias("q975"))


@query(
    "agg_11_mad",
    PANEL + ", a AS (SELECT tid, cat, value, median(value) OVER (PARTITION BY tid, cat) AS med FROM panel WHERE m < 1999 * 12) SELECT tid, cat, round(any_value(med), 6) AS med, round(1.4826 * median(abs(value - med)), 6) AS mad FROM a GROUP BY 1, 2",
)
def _(spark, root):
    train = P.panel(spark, root).filter(F.col("m") < 1999 * 12)
    return stats.mad(train, "value", BY).select(*BY, F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


@query("agg_12_gini", PANEL + ", r AS (SELECT *, row_number() OVER (PARTITION BY tid, cat ORDER BY value, m) AS i FROM panel) SELECT tid, cat, round(2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*), 9) AS gini FROM r GROUP BY 1, 2")
def _(spark, root):
    return A.ranked(P.panel(spark, root), BY, "value", "m").groupBy(*BY).agg(F.round(stats.gini("value", "rank"), 9).alias("gini"))


@query("agg_13_hhi", PANEL + " SELECT tid, m, round(sum(value * value) / (sum(value) * sum(value)), 9) AS hhi FROM panel GROUP BY 1, 2")
def _(spark, root):
    return P.panel(spark, root).groupBy("tid", "m").agg(F.round(stats.hhi("value"), 9).alias("hhi"))


@query("agg_14_variation", PANEL + " SELECT tid, cat, round(stddev_pop(value) / abs(avg(value)), 9) AS cv FROM panel GROUP BY 1, 2")
def _(spark, root):
    return P.panel(spark, root).groupBy(*BY).agg(F.round(stats.variation("value"), 9).alias("cv"))


@query("agg_15_theil", PANEL + ", r AS (SELECT tid, cat, value / avg(value) OVER (PARTITION BY tid, cat) AS r FROM panel) SELECT tid, cat, round(avg(r * ln(r)), 9) AS theil FROM r GROUP BY 1, 2")
def _(spark, root):
    r = F.col("value") / F.avg("value").over(Window.partitionBy(*BY))
    return P.panel(spark, root).select(*BY, r.alias("r")).groupBy(*BY).agg(F.round(F.avg(F.col("r") * F.ln("r")), 9).alias("theil"))


@query("agg_16_trend_slope", PANEL + ", r AS (SELECT *, row_number() OVER (PARTITION BY tid, cat ORDER BY m) - 1 AS t FROM panel) SELECT tid, cat, round(regr_slope(value, t), 4) AS slope FROM r GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, root):
    r = A.ranked(P.panel(spark, root), BY, "m").withColumn("t", F.col("rank") - 1)
    return r.groupBy(*BY).agg(F.round(stats.slope("t", "value"), 4).alias("slope"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


@query(
    "agg_17_autocorrelation",
    PANEL + ", r AS (SELECT tid, cat, value - avg(value) OVER (PARTITION BY tid, cat) AS d, m FROM panel), s AS (SELECT *, lag(d) OVER (PARTITION BY tid, cat ORDER BY m) AS e FROM r) SELECT tid, cat, round(sum(d * e) / sum(d * d), 9) AS acf FROM s GROUP BY 1, 2 HAVING count(*) > 2",
)
def _(spark, root):
    w = Window.partitionBy(*BY)
    r = P.panel(spark, root).select(*BY, "m", (F.col("value") - F.avg("value").over(w)).alias("d")).withColumn("e", F.lag("d").over(w.orderBy("m")))
    return r.groupBy(*BY).agg(F.round(F.sum(F.col("d") * F.col("e")) / F.sum(F.col("d") * F.col("d")), 9).alias("acf"), F.count(F.lit(1)).alias("n")).filter("n > 2").drop("n")


@query("agg_18_seasonal_naive_mae", PANEL + ", s AS (SELECT tid, cat, abs(value - lag(value, 12) OVER (PARTITION BY tid, cat ORDER BY m)) AS e FROM panel) SELECT tid, cat, round(avg(e), 6) AS mae FROM s GROUP BY 1, 2 HAVING count(e) > 0")
def _(spark, root):
    e = F.abs(F.col("value") - F.lag("value", 12).over(Window.partitionBy(*BY).orderBy("m")))
    return P.panel(spark, root).select(*BY, e.alias("e")).na.drop(subset=["e"]).groupBy(*BY).agg(F.round(F.avg("e"), 6).alias("mae"))


@query(
    "agg_19_outlier_share",
    PANEL + ", a AS (SELECT *, median(value) OVER (PARTITION BY tid, cat) AS med FROM panel), b AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY tid, cat) AS mad FROM a) SELECT tid, cat, round(avg(CASE WHEN mad > 0 AND abs(0.67448975 * (value - med) / mad) > 3.5 THEN 1.0 ELSE 0.0 END), 9) AS share FROM b GROUP BY 1, 2",
)
def _(spark, root):
    z = stats.robust_z(P.panel(spark, root), "value", BY)
    return z.groupBy(*BY).agg(F.round(F.avg(F.when(F.abs("z") > 3.5, 1.0).otherwise(0.0)), 9).alias("share"))


@query("agg_20_grouped_metric", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(stddev_pop(l_quantity) / avg(l_quantity), 9) AS metric FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 200")
def _(spark, root):
    return tables.scan(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(stats.variation("l_quantity"), 9).alias("metric")).orderBy("l_returnflag", "l_linestatus").limit(200)


@query(
    "agg_21_correlations",
    """WITH r AS (SELECT l_returnflag AS f, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT f AS l_returnflag, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY 1""",
)
def _(spark, root):
    li = tables.scan(spark, root, "lineitem")
    r = li.withColumns({"rx": A.average_rank("l_quantity", ["l_returnflag"]), "ry": A.average_rank("l_extendedprice", ["l_returnflag"])})
    return r.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("pearson"), F.round(F.corr("rx", "ry"), 9).alias("spearman"))


@query(
    "agg_22_micro_losses",
    LAGGED + " SELECT 'last' AS model, count(*) AS n, round(avg(abs(value - last)), 6) AS mae, round(sqrt(avg((value - last) ^ 2)), 6) AS rmse FROM f UNION ALL SELECT 'seasonal', count(*), round(avg(abs(value - seasonal)), 6), round(sqrt(avg((value - seasonal) ^ 2)), 6) FROM f",
)
def _(spark, root):
    return A.losses(forecasts(spark, root), "value", ["last", "seasonal"]).select("model", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@query("agg_23_macro_mae", LAGGED + ", g AS (SELECT tid, avg(abs(value - last)) AS a, avg(abs(value - seasonal)) AS b FROM f GROUP BY 1) SELECT round(avg(a), 6) AS last, round(avg(b), 6) AS seasonal, count(*) AS groups FROM g")
def _(spark, root):
    f = forecasts(spark, root)
    e = lambda c: F.avg(F.abs(F.col("value") - F.col(c)))
    g = f.groupBy("tid").agg(e("last").alias("a"), e("seasonal").alias("b"))
    return g.agg(F.round(F.avg("a"), 6).alias("last"), F.round(F.avg("b"), 6).alias("seasonal"), F.count(F.lit(1)).alias("groups"))


@query("agg_24_normalised_loss", LAGGED + ", t AS (SELECT tid, cat, avg(value) AS base FROM panel WHERE m < 1998 * 12 GROUP BY 1, 2) SELECT round(avg(abs(value - last) / base), 9) AS last, round(avg(abs(value - seasonal) / base), 9) AS seasonal FROM f JOIN t USING (tid, cat) WHERE m >= 1998 * 12")
def _(spark, root):
    base = P.panel(spark, root).filter(F.col("m") < 1998 * 12).groupBy(*BY).agg(F.avg("value").alias("base"))
    f = forecasts(spark, root).filter(F.col("m") >= 1998 * 12).join(base, BY)
    e = lambda c: F.round(F.avg(F.abs(F.col("value") - F.col(c)) / F.col("base")), 9).alias(c)
    return f.agg(e("last"), e("seasonal"))


@query(
    "agg_25_win_share",
    LAGGED + ", d AS (SELECT tid, cat, abs(value - seasonal) - abs(value - last) AS d FROM f) SELECT tid, cat, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 9) AS win_share, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses, count(*) FILTER (WHERE d = 0) AS ties FROM d GROUP BY 1, 2",
)
def _(spark, root):
    d = forecasts(spark, root).withColumn("d", F.abs(F.col("value") - F.col("seasonal")) - F.abs(F.col("value") - F.col("last")))
    return d.groupBy(*BY).agg(F.round(F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)), 9).alias("win_share"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))


@query("agg_26_leave_group_out_mean", PANEL + ", g AS (SELECT m, cat, sum(value) AS s, count(*) AS n FROM panel GROUP BY 1, 2) SELECT m, cat, round((sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0), 6) AS rest FROM g WINDOW w AS (PARTITION BY m)")
def _(spark, root):
    return A.leave_group_out_mean(P.panel(spark, root), "cat", ["m"], "value").withColumn("rest", F.round("rest", 6))


@query(
    "agg_27_leave_one_out_median",
    PANEL + " SELECT p.tid, p.cat, p.m, round(median(q.value), 6) AS loo FROM panel p LEFT JOIN panel q ON q.cat = p.cat AND q.m = p.m AND q.tid <> p.tid GROUP BY 1, 2, 3",
)
def _(spark, root):
    return A.leave_one_out_median(P.panel(spark, root), ["cat", "m"], "value", "tid").select("tid", "cat", "m", F.round("loo", 6).alias("loo"))


@query(
    "agg_28_peer_median_mad",
    PANEL + """, q AS (SELECT p.*, CAST(n_regionkey AS BIGINT) AS region FROM panel p JOIN nation ON n_nationkey = tid), a AS (SELECT *, median(value) OVER (PARTITION BY region, cat, m) AS med FROM q)
SELECT region, cat, m, round(any_value(med), 6) AS med, round(median(abs(value - med)), 6) AS mad, count(*) AS peers FROM a GROUP BY 1, 2, 3""",
)
def _(spark, root):
    by = ["region", "cat", "m"]
    nation = tables.scan(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("tid"), F.col("n_regionkey").cast("long").alias("region"))
    q = P.panel(spark, root).join(nation, "tid")
    peers = q.groupBy(*by).agg(F.count(F.lit(1)).alias("peers"))
    return stats.mad(q, "value", by, 1.0).join(peers, by).select(*by, F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), "peers")


@query("agg_29_contingency", "SELECT label, CAST(embedding[1] > 0 AS INTEGER) * 4 + CAST(embedding[2] > 0 AS INTEGER) * 2 + CAST(embedding[3] > 0 AS INTEGER) AS other, count(*) AS n FROM embeddings GROUP BY 1, 2")
def _(spark, root):
    return A.contingency(_labels(spark, root), "label", "other")


def _labels(spark, root):
    return tables.scan(spark, root, "embeddings").select("vec_id", "label", sum((F.col("embedding")[i] > 0).cast("int") * (4 >> i) for i in range(3)).alias("other"))


_CELLS = """WITH e AS (SELECT label AS a, CAST(embedding[1] > 0 AS INTEGER) * 4 + CAST(embedding[2] > 0 AS INTEGER) * 2 + CAST(embedding[3] > 0 AS INTEGER) AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2), ra AS (SELECT sum(n) AS n FROM c GROUP BY a), rb AS (SELECT sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS n FROM c)"""


@query(
    "agg_30_adjusted_rand",
    _CELLS + ", s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(n * (n - 1) / 2) FROM ra) AS x, (SELECT sum(n * (n - 1) / 2) FROM rb) AS y, (SELECT n * (n - 1) / 2 FROM t) AS p) SELECT round((ab - x * y / p) / ((x + y) / 2 - x * y / p), 9) AS ari FROM s",
)
def _(spark, root):
    return A.adjusted_rand(_labels(spark, root), "label", "other").withColumn("ari", F.round("ari", 9))


@query(
    "agg_31_normalised_information",
    """WITH e AS (SELECT label AS a, CAST(embedding[1] > 0 AS INTEGER) * 4 + CAST(embedding[2] > 0 AS INTEGER) * 2 + CAST(embedding[3] > 0 AS INTEGER) AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT count(*) AS n FROM e),
x AS (SELECT a, count(*) AS n FROM e GROUP BY 1), y AS (SELECT b, count(*) AS n FROM e GROUP BY 1),
mi AS (SELECT sum(c.n / t.n * ln(c.n * t.n / (x.n * y.n))) AS v FROM c JOIN x USING (a) JOIN y USING (b), t),
ha AS (SELECT -sum(x.n / t.n * ln(x.n / t.n)) AS v FROM x, t), hb AS (SELECT -sum(y.n / t.n * ln(y.n / t.n)) AS v FROM y, t)
SELECT round(mi.v / ((ha.v + hb.v) / 2), 9) AS nmi FROM mi, ha, hb""",
)
def _(spark, root):
    return A.normalised_information(_labels(spark, root), "label", "other").withColumn("nmi", F.round("nmi", 9))


@query(
    "agg_32_jaccard_of_sets",
    "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1999), s AS (SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS x, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS y) SELECT x AS \"both\", y AS either, x / y AS jaccard FROM s",
)
def _(spark, root):
    o = tables.scan(spark, root, "orders")
    in_year = lambda y: o.filter(F.year("o_orderdate") == y)
    return A.jaccard(in_year(1996), in_year(1999), ["o_custkey"])


@query(
    "agg_33_switch_rate",
    "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, min(event_type) AS label FROM events GROUP BY 1, 2), s AS (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY d) AS prev FROM e) SELECT d, round(avg(CASE WHEN label <> prev THEN 1.0 ELSE 0.0 END), 9) AS rate, count(*) AS n FROM s WHERE prev IS NOT NULL GROUP BY 1",
)
def _(spark, root):
    e = tables.scan(spark, root, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("event_type").alias("label"))
    s = e.withColumn("prev", F.lag("label").over(Window.partitionBy("user_id").orderBy("d"))).na.drop(subset=["prev"])
    return s.groupBy("d").agg(F.round(F.avg(F.when(F.col("label") != F.col("prev"), 1.0).otherwise(0.0)), 9).alias("rate"), F.count(F.lit(1)).alias("n"))


@query(
    "agg_34_coverage_by_region",
    PANEL + " SELECT r_name, count(DISTINCT n_nationkey) AS listed, count(DISTINCT p.tid) AS observed, count(DISTINCT n_nationkey) - count(DISTINCT p.tid) AS missing FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT DISTINCT tid FROM panel WHERE m = 1997 * 12) p ON p.tid = n_nationkey GROUP BY 1",
)
def _(spark, root):
    seen = P.panel(spark, root).filter(F.col("m") == 1997 * 12).select(F.col("tid").alias("seen")).distinct()
    n = tables.scan(spark, root, "nation").join(tables.scan(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = n.join(seen, F.col("n_nationkey") == F.col("seen"), "left")
    listed, observed = F.count_distinct("n_nationkey"), F.count_distinct("seen")
    return j.groupBy("r_name").agg(listed.alias("listed"), observed.alias("observed"), (listed - observed).alias("missing"))


@query(
    "agg_35_missingness",
    PANEL + ", y AS (SELECT CAST(m // 12 AS BIGINT) AS year, count(*) AS present, (CASE WHEN m // 12 = 2001 THEN 8 ELSE 12 END) * 125 AS expected FROM panel GROUP BY 1, 3) SELECT year, present, CAST(expected AS BIGINT) AS expected, CAST(expected - present AS BIGINT) AS absent FROM (SELECT year, sum(present)::BIGINT AS present, max(expected) AS expected FROM y GROUP BY 1)",
)
def _(spark, root):
    year = F.floor(F.col("m") / 12).cast("long")
    y = P.panel(spark, root).groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("present"))
    expected = (F.when(F.col("year") == 2001, 8).otherwise(12) * 125).cast("long")
    return y.withColumn("expected", expected).withColumn("absent", F.col("expected") - F.col("present"))


@query(
    "agg_36_revision_diff",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE year(o_orderdate) < 2000), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE year(o_orderdate) > 1996)
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""",
)
def _(spark, root):
    from ledgerline.operators.joins import revision_diff

    o = tables.scan(spark, root, "orders").withColumnsRenamed({"o_orderkey": "k", "o_totalprice": "v"})
    revised = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("v") + 1).otherwise(F.col("v"))
    a, b = o.filter(F.year("o_orderdate") < 2000), o.filter(F.year("o_orderdate") > 1996).withColumn("v", revised)
    return revision_diff(a, b, ["k"], "v").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_37_accounting_identity",
    """WITH l AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 100 AS BIGINT) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS stated, lines, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) - lines AS residual, abs(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) - lines) <= 10 AS holds FROM orders JOIN l ON l_orderkey = o_orderkey""",
)
def _(spark, root):
    cents = lambda c: (c * 100).cast("long")
    lines = tables.scan(spark, root, "lineitem").groupBy("l_orderkey").agg(cents(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).alias("lines"))
    o = tables.scan(spark, root, "orders").select("o_orderkey", cents(F.col("o_totalprice").cast("decimal(18,2)")).alias("stated"))
    j = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("residual", F.col("stated") - F.col("lines"))
    return j.select("o_orderkey", "stated", "lines", "residual", (F.abs("residual") <= 10).alias("holds"))


@query(
    "agg_38_budget_profile",
    TOTALS + """, y AS (SELECT tid, m // 12 AS year, sum(CAST(value AS DECIMAL(18,2))) AS revenue FROM total GROUP BY 1, 2), z AS (SELECT a.tid, CAST(a.year AS BIGINT) AS year, CAST(a.revenue AS DOUBLE) AS revenue, CAST(b.revenue AS DOUBLE) AS spent FROM y a JOIN y b ON b.tid = a.tid AND b.year = a.year - 1)
SELECT tid, year, round(revenue - spent, 2) AS surplus, round(spent / revenue, 9) AS execution, round(greatest(spent - revenue, 0) / revenue, 9) AS deficit_share FROM z""",
)
def _(spark, root):
    year = F.floor(F.col("m") / 12)
    y = P.totals(spark, root).groupBy("tid", year.cast("long").alias("year")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("revenue"))
    prev = y.select("tid", (F.col("year") + 1).alias("year"), F.col("revenue").alias("spent"))
    r, s = F.col("revenue"), F.col("spent")
    return y.join(prev, ["tid", "year"]).select("tid", "year", F.round(r - s, 2).alias("surplus"), F.round(s / r, 9).alias("execution"), F.round(F.greatest(s - r, F.lit(0.0)) / r, 9).alias("deficit_share"))
