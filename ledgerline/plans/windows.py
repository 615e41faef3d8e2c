"""Windows, sorts and samples over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import calendar
from ledgerline.operators import panel as P
from ledgerline.operators import windows as W
from ledgerline.plans.registry import PANEL, TOTALS, query
from ledgerline.sources import tables

BY = ["tid", "cat"]

@query("win_01_row_lag", PANEL + " SELECT tid, cat, m, lag(value) OVER (PARTITION BY tid, cat ORDER BY m) AS previous FROM panel")
def _(spark, root):
    return P.panel(spark, root).select(*BY, "m", F.lag("value").over(Window.partitionBy(*BY).orderBy("m")).alias("previous"))


@query("win_02_calendar_lag", PANEL + " SELECT p.tid, p.cat, p.m, a.value AS lag1, b.value AS lag12 FROM panel p LEFT JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1 LEFT JOIN panel b ON b.tid = p.tid AND b.cat = p.cat AND b.m = p.m - 12")
def _(spark, root):
    return P.panel(spark, root).select(*BY, "m", calendar.at_lag("value", 1, BY).alias("lag1"), calendar.at_lag("value", 12, BY).alias("lag12"))


@query("win_03_shifted_rolling_mean", PANEL + ", r AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS a FROM panel WINDOW w AS (PARTITION BY tid, cat ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT tid, cat, m, CASE WHEN n = 3 THEN round(a, 6) END AS mean3 FROM r")
def _(spark, root):
    w = Window.partitionBy(*BY).orderBy("m").rowsBetween(-3, -1)
    return P.panel(spark, root).select(*BY, "m", F.when(F.count("value").over(w) == 3, F.round(F.avg("value").over(w), 6)).alias("mean3"))


@query(
    "win_04_feature_vector",
    PANEL + """ SELECT tid, cat, m, max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lag1, max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS lag2,
  max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS lag12, round(avg(value) OVER q, 6) AS mean3, round(stddev_pop(value) OVER q, 4) AS std3, round(avg(value) OVER y, 6) AS mean12, round(stddev_pop(value) OVER y, 4) AS std12
FROM panel WINDOW q AS (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), y AS (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
)
def _(spark, root):
    q, y = calendar.over_months(BY, -3, -1), calendar.over_months(BY, -12, -1)
    lags = [calendar.at_lag("value", k, BY).alias(f"lag{k}") for k in (1, 2, 12)]
    return P.panel(spark, root).select(*BY, "m", *lags, F.round(F.avg("value").over(q), 6).alias("mean3"), F.round(F.stddev_pop("value").over(q), 4).alias("std3"), F.round(F.avg("value").over(y), 6).alias("mean12"), F.round(F.stddev_pop("value").over(y), 4).alias("std12"))


@query(
    "win_05_release_lagged",
    PANEL + """, f AS (SELECT tid, cat, m, max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS v2, max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS v3,
  max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS v4, max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 13 PRECEDING AND 13 PRECEDING) AS v13 FROM panel)
SELECT *, round((v2 + v3 + v4) / 3, 6) AS mean3 FROM f WHERE v2 IS NOT NULL AND v3 IS NOT NULL AND v4 IS NOT NULL AND v13 IS NOT NULL""",
)
def _(spark, root):
    f = P.panel(spark, root).select(*BY, "m", *(calendar.at_lag("value", k, BY).alias(f"v{k}") for k in (2, 3, 4, 13)))
    return f.na.drop().withColumn("mean3", F.round((F.col("v2") + F.col("v3") + F.col("v4")) / 3, 6))


HOT = PANEL + ", h AS (SELECT p.tid, p.cat, p.m, p.value / a.value - 1 AS g, p.value > 1.2 * a.value OR p.value < 0.8 * a.value AS hot FROM panel p JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1)"


def hot(spark, root):
    """Months whose change on the month before is beyond 20 %, where there is one."""
    p = P.panel(spark, root).withColumn("before", calendar.at_lag("value", 1, BY)).na.drop(subset=["before"])
    return p.select(*BY, "m", (F.col("value") / F.col("before") - 1).alias("g"), ((F.col("value") > 1.2 * F.col("before")) | (F.col("value") < 0.8 * F.col("before"))).alias("hot"))


@query("win_06_persistence_2", HOT + " SELECT h.tid, h.cat, h.m FROM h JOIN h b ON b.tid = h.tid AND b.cat = h.cat AND b.m = h.m - 1 WHERE h.hot AND b.hot")
def _(spark, root):
    return hot(spark, root).withColumn("alarm", W.persistent("hot", BY, 2)).filter("alarm").select(*BY, "m")


@query("win_07_persistence_3_same_sign", HOT + " SELECT h.tid, h.cat, h.m FROM h JOIN h b ON b.tid = h.tid AND b.cat = h.cat AND b.m = h.m - 1 JOIN h c ON c.tid = h.tid AND c.cat = h.cat AND c.m = h.m - 2 WHERE h.hot AND b.hot AND c.hot AND sign(h.g) = sign(b.g) AND sign(b.g) = sign(c.g) AND h.g <> 0")
def _(spark, root):
    return hot(spark, root).withColumn("alarm", W.persistent_same_sign("hot", "g", BY, 3)).filter("alarm").select(*BY, "m")


@query(
    "win_08_page_hinkley",
    TOTALS.replace("WITH", "WITH RECURSIVE", 1)
    + """, s AS (SELECT tid, m, ln(value) AS x, row_number() OVER (PARTITION BY tid ORDER BY m) AS r FROM total),
f AS (SELECT tid, m, r, 1 AS n, x AS mean, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM s WHERE r = 1
UNION ALL SELECT tid, m, r, n, mean, greatest(0, up + x - mean - 0.05), greatest(0, down - x + mean - 0.05) FROM (
  SELECT s.tid, s.m, s.r, x, n0 + 1 AS n, mean0 + (x - mean0) / (n0 + 1) AS mean, up, down FROM (
    SELECT tid, r, CASE WHEN greatest(up, down) > 0.5 THEN 0 ELSE n END AS n0, CASE WHEN greatest(up, down) > 0.5 THEN 0 ELSE mean END AS mean0, CASE WHEN greatest(up, down) > 0.5 THEN 0 ELSE up END AS up, CASE WHEN greatest(up, down) > 0.5 THEN 0 ELSE down END AS down FROM f) p
  JOIN s ON s.tid = p.tid AND s.r = p.r + 1) q)
SELECT tid, m, round(greatest(up, down), 6) AS statistic, greatest(up, down) > 0.5 AS alarm FROM f""",
)
def _(spark, root):
    from ledgerline.operators.detect import page_hinkley

    return page_hinkley(P.totals(spark, root), ["tid"], "m", "value").withColumn("statistic", F.round("statistic", 6))


@query(
    "win_09_cooldown",
    HOT + """, a AS (SELECT tid, cat, list(DISTINCT m ORDER BY m) AS ms FROM h WHERE hot GROUP BY 1, 2),
k AS (SELECT tid, cat, list_reduce(list_prepend([]::INTEGER[], list_transform(ms, lambda x: [x])), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] >= 4 THEN list_concat(acc, x) ELSE acc END) AS kept FROM a)
SELECT tid, cat, unnest(kept) AS m FROM k""",
)
def _(spark, root):
    return W.cooldown(hot(spark, root).filter("hot").select(*BY, "m"), BY, 4)


@query("win_10_rank_descending", PANEL + " SELECT p.tid, p.cat, p.m, 1 + (SELECT count(*) FROM panel q WHERE q.cat = p.cat AND q.m = p.m AND q.value > p.value) AS rank_descending FROM panel p")
def _(spark, root):
    return P.panel(spark, root).select(*BY, "m", W.greater_rank("value", ["cat", "m"]).cast("long").alias("rank_descending"))


@query("win_11_percent_rank", "SELECT l_orderkey, l_linenumber, l_partkey, round((100.0 * (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1) + 50.0 * count(*) OVER (PARTITION BY l_returnflag, l_quantity)) / count(*) OVER (PARTITION BY l_returnflag), 9) AS pr FROM lineitem")
def _(spark, root):
    return tables.scan(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(W.percent_rank_mid("l_quantity", ["l_returnflag"]), 9).alias("pr"))


@query(
    "win_12_quantile_bucket",
    "WITH e AS (SELECT c_mktsegment AS s, quantile_cont(c_acctbal, 0.2) AS a, quantile_cont(c_acctbal, 0.4) AS b, quantile_cont(c_acctbal, 0.6) AS c, quantile_cont(c_acctbal, 0.8) AS d FROM customer GROUP BY 1) SELECT c_custkey, CAST(c_acctbal > a AS INTEGER) + CAST(c_acctbal > b AS INTEGER) + CAST(c_acctbal > c AS INTEGER) + CAST(c_acctbal > d AS INTEGER) AS bucket FROM customer JOIN e ON s = c_mktsegment",
)
def _(spark, root):
    return W.quantile_bucket(tables.scan(spark, root, "customer"), ["c_mktsegment"], "c_acctbal", 5).select("c_custkey", "bucket")


@query("win_12_equal_strata", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS stratum FROM customer")
def _(spark, root):
    return tables.scan(spark, root, "customer").select("c_custkey", F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("long").alias("stratum"))


@query("win_13_log2_bins", "SELECT tid, CAST(floor(log2(n)) AS BIGINT) AS bin FROM (SELECT c_nationkey AS tid, count(*) AS n FROM customer GROUP BY 1)")
def _(spark, root):
    n = tables.scan(spark, root, "customer").groupBy(F.col("c_nationkey").alias("tid")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("tid", F.floor(F.log2("n")).cast("long").alias("bin"))


@query("win_14_expanding_history", PANEL + " SELECT tid, cat, m, CASE WHEN count(*) OVER w >= 2 THEN round(avg(value) OVER w, 6) END AS history_mean, count(*) OVER w AS n FROM panel WINDOW w AS (PARTITION BY tid, cat ORDER BY m ROWS UNBOUNDED PRECEDING)")
def _(spark, root):
    w = calendar.up_to(BY)
    n = F.count(F.lit(1)).over(w)
    return P.panel(spark, root).select(*BY, "m", F.when(n >= 2, F.round(F.avg("value").over(w), 6)).alias("history_mean"), n.alias("n"))


@query(
    "win_15_glr",
    HOT + """, s AS (SELECT *, g AS s1, sum(g) OVER a AS s2, count(*) OVER a AS n2, sum(g) OVER b AS s3, count(*) OVER b AS n3 FROM h WINDOW a AS (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 1 PRECEDING AND CURRENT ROW), b AS (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT tid, cat, m, round(greatest(s1 * s1, CASE WHEN n2 = 2 THEN s2 * s2 / 2 END, CASE WHEN n3 = 3 THEN s3 * s3 / 3 END), 6) AS glr FROM s""",
)
def _(spark, root):
    return hot(spark, root).select(*BY, "m", F.round(W.glr("g", BY), 6).alias("glr"))


@query("win_16_group_relative", PANEL + " SELECT tid, cat, m, round(value - median(value) OVER (PARTITION BY cat, m), 6) AS deviation FROM panel")
def _(spark, root):
    p = P.panel(spark, root)
    med = p.groupBy("cat", "m").agg(F.median("value").alias("med"))
    return p.join(med, ["cat", "m"]).select(*BY, "m", F.round(F.col("value") - F.col("med"), 6).alias("deviation"))


@query("win_17_first_difference", PANEL + ", d AS (SELECT tid, cat, m, ln(value) - lag(ln(value)) OVER (PARTITION BY tid, cat ORDER BY m) AS d FROM panel) SELECT tid, cat, m, round(d, 9) AS d FROM d WHERE d IS NOT NULL")
def _(spark, root):
    d = F.ln("value") - F.lag(F.ln("value")).over(Window.partitionBy(*BY).orderBy("m"))
    return P.panel(spark, root).select(*BY, "m", F.round(d, 9).alias("d")).na.drop(subset=["d"])


@query("win_18_switches", "WITH e AS (SELECT user_id, event_type AS l, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type <> '') SELECT user_id, count(*) FILTER (WHERE p <> l) AS switches FROM e GROUP BY 1")
def _(spark, root):
    return W.switches(tables.scan(spark, root, "events"), ["user_id"], "event_id", "event_type")


SPANS = "WITH s AS (SELECT o_custkey, o_orderpriority AS code, min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high FROM orders GROUP BY 1, 2)"


def spans(spark, root):
    o = tables.scan(spark, root, "orders")
    return o.groupBy("o_custkey", F.col("o_orderpriority").alias("code")).agg(F.min(F.year("o_orderdate")).alias("low"), F.max(F.year("o_orderdate")).alias("high"))


@query("win_19_interval_scan", SPANS + ", n AS (SELECT *, lead(low) OVER (PARTITION BY o_custkey ORDER BY low, high, code) AS next_low FROM s) SELECT o_custkey, code, low, high, next_low, high = next_low AS contiguous, high > next_low AS overlaps FROM n")
def _(spark, root):
    return W.successors(spans(spark, root), "o_custkey", "low", "high", "code").select(*(F.col(c).cast("long") if c in ("low", "high", "next_low") else F.col(c) for c in ("o_custkey", "code", "low", "high", "next_low", "contiguous", "overlaps")))


@query(
    "win_20_dormancy",
    PANEL + ", s AS (SELECT tid, cat, min(m) AS f FROM panel GROUP BY 1, 2), g AS (SELECT tid, cat, unnest(range(f, 24020)) AS m FROM s), j AS (SELECT g.tid, g.cat, g.m, p.m AS seen FROM g LEFT JOIN panel p ON p.tid = g.tid AND p.cat = g.cat AND p.m = g.m), k AS (SELECT tid, cat, m, m - max(seen) OVER (PARTITION BY tid, cat ORDER BY m) AS gap FROM j) SELECT tid, cat, CAST(m AS INTEGER) AS m, CASE WHEN gap = 0 THEN 'active' WHEN gap <= 3 THEN 'dormant' ELSE 'retired' END AS status FROM k",
)
def _(spark, root):
    from ledgerline.operators.detect import dormancy

    seen = P.panel(spark, root).select("tid", "cat", "m")
    return dormancy(seen, BY, "m", P.FIRST, P.LAST)


@query("srt_01_multi_key_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS position FROM orders")
def _(spark, root):
    o = tables.scan(spark, root, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    from ledgerline.operators.sets import positions

    return positions(o, [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("srt_02_top_k", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def _(spark, root):
    li = tables.scan(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)


@query("srt_03_per_month_top_k", PANEL + ", r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY value DESC, tid, cat) AS r FROM panel) SELECT m, tid, cat, value, r AS rank FROM r WHERE r <= 3")
def _(spark, root):
    return W.top(P.panel(spark, root), ["m"], [F.desc("value"), F.asc("tid"), F.asc("cat")], 3).select("m", "tid", "cat", "value", F.col("rank").cast("long").alias("rank"))


@query("srt_04_online_top_k")
def _(spark, root):
    from ledgerline.operators.detect import online_top

    return online_top(P.panel(spark, root), "m", BY, "value", 3, 3)


@query("srt_05_distance_id_order", "SELECT a.n_nationkey AS x, b.n_nationkey AS y, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY abs(a.n_regionkey - b.n_regionkey), b.n_nationkey) AS place FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey")
def _(spark, root):
    n = tables.scan(spark, root, "nation")
    a, b = n.select(F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("rx")), n.select(F.col("n_nationkey").alias("y"), F.col("n_regionkey").alias("ry"))
    pairs = a.join(F.broadcast(b), F.col("x") != F.col("y")).withColumn("d", F.abs(F.col("rx") - F.col("ry")))  # nations: a fixed few
    return pairs.select("x", "y", F.row_number().over(Window.partitionBy("x").orderBy("d", "y")).cast("long").alias("place"))


@query(
    "srt_06_extremes",
    TOTALS + ", y AS (SELECT tid, m // 12 AS y, sum(CAST(value AS DECIMAL(18,2))) AS s FROM total GROUP BY 1, 2), d AS (SELECT a.tid, CAST(a.s - b.s AS DOUBLE) AS d FROM y a JOIN y b ON b.tid = a.tid AND b.y = 1997 WHERE a.y = 1998), r AS (SELECT *, row_number() OVER (ORDER BY d, tid) AS lo, row_number() OVER (ORDER BY d DESC, tid) AS hi FROM d) SELECT tid, d, CASE WHEN lo <= 2 THEN 'fall' ELSE 'rise' END AS kind FROM r WHERE lo <= 2 OR hi <= 2",
)
def _(spark, root):
    year = F.floor(F.col("m") / 12)
    y = P.totals(spark, root).groupBy("tid").agg(*(F.sum(F.when(year == k, F.col("value").cast("decimal(18,2)"))).alias(f"y{k}") for k in (1997, 1998)))
    d = y.select("tid", (F.col("y1998") - F.col("y1997")).cast("double").alias("d")).na.drop()
    low = d.orderBy("d", "tid").limit(2).withColumn("kind", F.lit("fall"))
    high = d.orderBy(F.desc("d"), "tid").limit(2).withColumn("kind", F.lit("rise"))
    return low.unionByName(high)


@query(
    "srt_07_ranked_search",
    """WITH r AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'small' OR CAST(p_partkey AS VARCHAR) = 'small' THEN 0 WHEN starts_with(lower(p_name), 'small') THEN 1 WHEN contains(lower(p_name), 'small') THEN 2 WHEN contains(lower(p_brand || ' ' || p_type), 'small') THEN 3 END AS rank FROM part)
SELECT p_partkey, p_name, CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM r WHERE rank IS NOT NULL) AS matched FROM r WHERE rank IS NOT NULL ORDER BY rank, p_name, p_partkey LIMIT 500""",
)
def _(spark, root):
    from ledgerline.functions.text import search_rank

    p = tables.scan(spark, root, "part")
    rank = search_rank("small", F.col("p_partkey").cast("string"), F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"))
    hits = p.select("p_partkey", "p_name", rank.alias("rank")).filter("rank is not null")
    return tables.report(hits, ["rank", "p_name", "p_partkey"], 500).select("p_partkey", "p_name", "rank", "matched")


@query("srt_08_hash_ordered_sample", "SELECT c_custkey, sha256('20260105:' || c_custkey) AS h FROM customer ORDER BY h, c_custkey LIMIT 10")
def _(spark, root):
    h = F.sha2(F.concat(F.lit("20260105:"), F.col("c_custkey").cast("string")), 256)
    return tables.scan(spark, root, "customer").select("c_custkey", h.alias("h")).orderBy("h", "c_custkey").limit(10)


@query("srt_09_blind_sample_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('blind:' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 3")
def _(spark, root):
    h = F.sha2(F.concat(F.lit("blind:"), F.col("c_custkey").cast("string")), 256)
    return W.top(tables.scan(spark, root, "customer").withColumn("h", h), ["c_nationkey"], [F.asc("h"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey")


@query("srt_10_first_per_group", "SELECT o_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS first_order FROM orders GROUP BY 1")
def _(spark, root):
    return tables.scan(spark, root, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
