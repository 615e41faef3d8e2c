"""Joins, sets and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import calendar, text
from ledgerline.operators import checks as C
from ledgerline.operators import joins as J
from ledgerline.operators import panel as P
from ledgerline.operators import sets as S
from ledgerline.plans.registry import PANEL, TOTALS, query
from ledgerline.plans.windows import SPANS, spans
from ledgerline.sources import tables

BY = ["tid", "cat"]


def scan(spark, root, *names):
    out = [tables.scan(spark, root, n) for n in names]
    return out if len(out) > 1 else out[0]


@query("jn_01_asserted_one_to_one", "SELECT c_custkey, c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(spark, root):
    c, o = scan(spark, root, "customer", "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return J.asserted(c.select("c_custkey", "c_name"), n, ["c_custkey"])


@query("jn_02_left_many_to_one", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 LEFT JOIN region ON r_regionkey = n_regionkey")
def _(spark, root):
    c, n, r = scan(spark, root, "customer", "nation", "region")
    dim = n.filter("n_regionkey < 3").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return J.asserted(c, dim, ["c_nationkey"], "left", "many_to_one").select("c_custkey", "n_name", "r_name")


@query("jn_03_left_one_to_many", "SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'")
def _(spark, root):
    c, n = scan(spark, root, "customer", "nation")
    many = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return J.asserted(n.select("n_nationkey"), many, ["n_nationkey"], "left", "one_to_many")


@query(
    "jn_04_outer_with_indicator",
    "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.n AS n96, b.n AS n97, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS merge FROM a FULL JOIN b ON a.k = b.k",
)
def _(spark, root):
    o = scan(spark, root, "orders").withColumn("y", F.year("o_orderdate"))
    n = lambda y: o.filter(F.col("y") == y).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(f"n{y - 1900}"))
    return J.reconcile(n(1996), n(1997), ["k"]).withColumnRenamed("_merge", "merge")


@query("jn_05_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1996)")
def _(spark, root):
    c, o = scan(spark, root, "customer", "orders")
    return c.select("c_custkey").join(o.filter(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    "jn_06_equal_mask",
    "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders) SELECT count(*) FILTER (WHERE a.k IS NULL OR b.k IS NULL) AS extra, count(*) FILTER (WHERE abs(a.v - b.v) > 1e-9) AS differ, false AS accepted FROM a FULL JOIN b ON a.k = b.k",
)
def _(spark, root):
    o = scan(spark, root, "orders").withColumnsRenamed({"o_orderkey": "k", "o_totalprice": "v"})
    changed = o.withColumn("v", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("v") + 1).otherwise(F.col("v")))
    return J.equal_masks(o.filter("o_orderstatus <> 'P'"), changed, ["k"], "v")


@query("jn_07_map_lookup", "SELECT l_orderkey, l_linenumber, l_suppkey, s_name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")
def _(spark, root):
    li, s = scan(spark, root, "lineitem", "supplier")
    names = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return li.join(names, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", "s_name")


@query("jn_08_calendar_self_join", PANEL + " SELECT t.tid, t.cat, t.m, t.value AS target, o.value AS origin, a.value AS target12, b.value AS origin12 FROM panel t JOIN panel o ON o.tid = t.tid AND o.cat = t.cat AND o.m = t.m - 3 JOIN panel a ON a.tid = t.tid AND a.cat = t.cat AND a.m = t.m - 12 JOIN panel b ON b.tid = t.tid AND b.cat = t.cat AND b.m = t.m - 15")
def _(spark, root):
    lag = lambda k: calendar.at_lag("value", k, BY)
    return P.panel(spark, root).select(*BY, "m", F.col("value").alias("target"), lag(3).alias("origin"), lag(12).alias("target12"), lag(15).alias("origin12")).na.drop()


@query("jn_09_interval_overlap", SPANS + " SELECT a.o_custkey AS code, a.code AS key_a, b.code AS key_b FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.code < b.code AND a.low < b.high AND b.low < a.high")
def _(spark, root):
    return J.overlapping(spans(spark, root), "o_custkey", "low", "high", "code").select("code", "key_a", "key_b")


ALARMS = PANEL + """, g AS (SELECT p.tid, p.cat, p.m, p.value / a.value - 1 AS g FROM panel p JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1),
alarms AS (SELECT tid, cat, m FROM g WHERE g > 0.8), onsets AS (SELECT tid, cat, m AS onset FROM g WHERE g < -0.6)"""


def alarms_onsets(spark, root):
    p = P.panel(spark, root).withColumn("before", calendar.at_lag("value", 1, BY))
    alarms = p.filter(F.col("value") / F.col("before") - 1 > 0.8).select(*BY, "m")
    onsets = p.filter(F.col("value") / F.col("before") - 1 < -0.6).select(*BY, F.col("m").alias("onset"))
    return alarms, onsets


@query("jn_10_near_month_candidates", ALARMS + " SELECT a.tid, a.cat, a.m, o.onset, a.m - o.onset AS d FROM alarms a JOIN onsets o ON o.tid = a.tid AND o.cat = a.cat AND abs(a.m - o.onset) <= 2")
def _(spark, root):
    a, o = alarms_onsets(spark, root)
    return J.near_month(a, o, BY, 2).select(*BY, "m", "onset", "d")


#: Onsets in order, each with the nearest alarm that no earlier one has.
GREEDY = ALARMS.replace("WITH", "WITH RECURSIVE", 1) + """, os AS (SELECT tid, cat, onset, row_number() OVER (PARTITION BY tid, cat ORDER BY onset) AS i FROM (SELECT DISTINCT tid, cat, onset FROM onsets)), nr AS (SELECT DISTINCT a.tid, a.cat, o.onset, a.m, a.m - o.onset AS d FROM alarms a JOIN onsets o ON o.tid = a.tid AND o.cat = a.cat AND abs(a.m - o.onset) <= 2),
gm AS (SELECT DISTINCT tid, cat, 0::BIGINT AS i, NULL::INTEGER AS onset, NULL::INTEGER AS m, []::INTEGER[] AS used FROM os
UNION ALL SELECT tid, cat, i, onset, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (SELECT g.tid, g.cat, os.i, os.onset, g.used, (SELECT first(n.m ORDER BY abs(n.d), n.d, n.m) FROM nr n WHERE n.tid = g.tid AND n.cat = g.cat AND n.onset = os.onset AND NOT list_contains(g.used, n.m)) AS pick FROM gm g JOIN os ON os.tid = g.tid AND os.cat = g.cat AND os.i = g.i + 1)),
matched AS (SELECT tid, cat, onset, m, m - onset AS d FROM gm WHERE m IS NOT NULL)"""


@query("jn_10_greedy_match", GREEDY + " SELECT tid, cat, onset, m, d FROM matched")
def _(spark, root):
    from ledgerline.operators.detect import greedy_match

    return greedy_match(*alarms_onsets(spark, root), BY, 2)


@query("jn_11_forward_match", ALARMS + ", f AS (SELECT o.tid, o.cat, o.onset, min(a.m - o.onset) AS delay FROM onsets o LEFT JOIN alarms a ON a.tid = o.tid AND a.cat = o.cat AND a.m BETWEEN o.onset AND o.onset + 3 GROUP BY 1, 2, 3) SELECT tid, cat, onset, delay, delay IS NOT NULL AS hit FROM f")
def _(spark, root):
    from ledgerline.operators.detect import forward_hits

    return forward_hits(*alarms_onsets(spark, root), BY, 3)


@query(
    "jn_12_as_of_availability",
    """WITH q AS (SELECT event_id AS qid, user_id, ts AS origin FROM events WHERE event_type = 'purchase'), k AS (SELECT user_id, CASE WHEN value > 2 THEN ts END AS available, value, event_id FROM events WHERE event_type = 'click'),
j AS (SELECT qid, q.user_id, origin, value AS known, event_id AS source, row_number() OVER (PARTITION BY qid ORDER BY available DESC, event_id DESC) AS r FROM q LEFT JOIN k ON k.user_id = q.user_id AND k.available <= q.origin)
SELECT qid, user_id, origin, known, source FROM j WHERE r = 1""",
)
def _(spark, root):
    e = scan(spark, root, "events")
    q = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("qid"), "user_id", F.col("ts").alias("origin"))
    k = e.filter("event_type = 'click'").select("user_id", F.when(F.col("value") > 2, F.col("ts")).alias("available"), F.col("value").alias("known"), F.col("event_id").alias("source"))
    return J.as_of(q, k, ["user_id"], "origin", "available", ["known", "source"])


@query("jn_13_origin_bounded_history", TOTALS + " SELECT o.m AS origin, t.tid, count(*) AS n, round(avg(t.value), 6) AS mean FROM (VALUES (23970), (23990), (24000)) o(m) JOIN total t ON t.m <= o.m - 2 GROUP BY 1, 2")
def _(spark, root):
    origins = F.explode(F.array(*(F.lit(o) for o in (23970, 23990, 24000))))
    h = P.totals(spark, root).withColumn("origin", origins).filter(F.col("m") <= F.col("origin") - 2)
    return h.groupBy("origin", "tid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


DIST = "WITH d AS (SELECT c_nationkey AS x, s_nationkey AS y, l_discount AS distance FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"


def distances(spark, root):
    li, o, c, s = scan(spark, root, "lineitem", "orders", "customer", "supplier")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("c_nationkey").alias("x"), F.col("s_nationkey").alias("y"), F.col("l_discount").alias("distance"))


@query("jn_14_undirected_pairs", DIST + " SELECT least(x, y) AS u, greatest(x, y) AS v, min(distance) AS distance FROM d WHERE x <> y AND distance > 0 GROUP BY 1, 2")
def _(spark, root):
    return J.undirected(distances(spark, root), "x", "y", "distance")


@query("jn_15_knn_from_distances", DIST + ", e AS (SELECT x, y, min(distance) AS distance FROM d WHERE x <> y AND distance > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY distance, y) AS rank FROM e) SELECT x, y, distance, rank FROM r WHERE rank <= 5")
def _(spark, root):
    e = distances(spark, root).filter("x <> y and distance > 0").groupBy("x", "y").agg(F.min("distance").alias("distance"))
    return J.nearest(e, "x", "y", "distance", 5).withColumn("rank", F.col("rank").cast("long"))


KNN = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id AS node, b.vec_id AS other, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, other) AS rank FROM p), nn AS (SELECT node, other, d, rank FROM k WHERE rank <= 5)"""


def feature_neighbours(spark, root, k=5):
    from ledgerline.operators.neighbours import nearest_vectors

    return nearest_vectors(scan(spark, root, "embeddings"), "vec_id", "embedding", k)


@query("jn_16_knn_features", KNN + " SELECT node, other, rank FROM nn")
def _(spark, root):
    return feature_neighbours(spark, root).select("node", "other", "rank")


@query("jn_16_mutual_knn", KNN + " SELECT least(node, other) AS u, greatest(node, other) AS v FROM nn GROUP BY 1, 2 HAVING count(*) = 2")
def _(spark, root):
    return J.mutual(feature_neighbours(spark, root), "node", "other")


@query(
    "jn_17_constrained_peers",
    """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS kind, c_nationkey AS nation, c_acctbal AS pop FROM customer WHERE c_acctbal > 100),
p AS (SELECT a.id, b.id AS peer, abs(a.pop - b.pop) AS d FROM c a JOIN c b ON a.kind = b.kind AND a.nation = b.nation AND a.id <> b.id AND b.pop BETWEEN 0.5 * a.pop AND 2 * a.pop),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, peer) AS rank, count(*) OVER (PARTITION BY id) AS n FROM p)
SELECT c.id, r.peer, r.rank, CASE WHEN r.id IS NULL THEN 'unsupported' ELSE 'ok' END AS status FROM c LEFT JOIN r ON r.id = c.id AND r.rank <= 5 AND r.n >= 2""",
)
def _(spark, root):
    c = scan(spark, root, "customer").filter("c_acctbal > 100").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("pop"))
    from ledgerline.operators.peers import peers

    return peers(c, "id", ["kind", "nation"], "pop", 0.5, 2.0, 5, 2).select("id", "peer", F.col("rank").cast("long").alias("rank"), "status")


@query(
    "jn_18_eligible_neighbours",
    """WITH c AS (SELECT s_suppkey AS id, s_nationkey AS kind, s_acctbal AS pop FROM supplier WHERE s_acctbal > 0), p AS (SELECT a.id, b.id AS peer, abs(a.pop - b.pop) AS d, a.kind = b.kind AND b.pop BETWEEN 0.5 * a.pop AND 2 * a.pop AS matched FROM c a JOIN c b ON a.id <> b.id)
SELECT id, peer, 'all' AS mask FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, peer) AS r FROM p) WHERE r <= 5 UNION ALL SELECT id, peer, 'matched' FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, peer) AS r FROM p WHERE matched) WHERE r <= 5""",
)
def _(spark, root):
    from ledgerline.operators.peers import nearest_on_line, peers

    c = scan(spark, root, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("kind"), F.col("s_acctbal").alias("pop"))
    every = nearest_on_line(c, "id", "pop", 5).select("id", "peer", F.lit("all").alias("mask"))
    matched = peers(c, "id", ["kind"], "pop", 0.5, 2.0, 5, 1).filter("peer is not null").select("id", "peer", F.lit("matched").alias("mask"))
    return every.unionByName(matched)


@query(
    "jn_19_series_signature",
    "WITH s AS (SELECT l_partkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS sig FROM lineitem GROUP BY 1) SELECT min(l_partkey) AS first, count(*) AS n, sig FROM s GROUP BY sig HAVING count(*) > 1",
)
def _(spark, root):
    li = scan(spark, root, "lineitem")
    sig = li.groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("sig"))
    return sig.groupBy("sig").agg(F.min("l_partkey").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "jn_20_name_candidates",
    "WITH c AS (SELECT lower(p_name) AS k, count(*) AS n, min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n = 2 THEN a + b - p_partkey END AS candidate, CASE WHEN n = 1 THEN 'none' WHEN n = 2 THEN 'unique' ELSE 'ambiguous' END AS status FROM part JOIN c ON k = lower(p_name)",
)
def _(spark, root):
    # every part is matched with the other parts of its name
    p = scan(spark, root, "part").select("p_partkey", F.lower("p_name").alias("k"))
    c = p.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    status = F.when(F.col("n") == 1, "none").when(F.col("n") == 2, "unique").otherwise("ambiguous")
    return p.join(c, "k").select("p_partkey", F.when(F.col("n") == 2, F.col("a") + F.col("b") - F.col("p_partkey")).alias("candidate"), status.alias("status"))


@query("jn_21_contiguous_successor", SPANS + " SELECT a.o_custkey, a.code AS old_code, b.code AS new_code, a.high AS at_year FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.high = b.low AND a.code <> b.code")
def _(spark, root):
    s = spans(spark, root)
    new = s.select("o_custkey", F.col("low").alias("at_year"), F.col("code").alias("new_code"))
    return s.select("o_custkey", F.col("high").alias("at_year"), F.col("code").alias("old_code")).join(new, ["o_custkey", "at_year"]).filter("old_code <> new_code").withColumn("at_year", F.col("at_year").cast("long"))


@query("jn_22_grid", PANEL + " SELECT s.tid, s.cat, g.m, p.value FROM (SELECT DISTINCT tid, cat FROM panel) s CROSS JOIN (SELECT CAST(unnest(range(23940, 24020)) AS INTEGER) AS m) g LEFT JOIN panel p ON p.tid = s.tid AND p.cat = s.cat AND p.m = g.m")
def _(spark, root):
    p = P.panel(spark, root)
    return P.grid(p.select(*BY).distinct(), P.FIRST, P.LAST).join(p, [*BY, "m"], "left")


@query("jn_23_semi_structured_key", "SELECT e.event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, s_name FROM events e JOIN supplier ON s_suppkey = CAST(json_extract_string(props, '$.k') AS BIGINT)")
def _(spark, root):
    e, s = scan(spark, root, "events", "supplier")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select("event_id", k.alias("k")).join(s.select(F.col("s_suppkey").alias("k"), "s_name"), "k")


VALID = "WITH v AS (SELECT o_custkey AS id, min(year(o_orderdate)) AS year_from, max(year(o_orderdate)) AS year_to, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS code FROM orders GROUP BY 1)"


def validity(spark, root):
    o = scan(spark, root, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.year("o_orderdate")).alias("year_from"), F.max(F.year("o_orderdate")).alias("year_to"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("code"))


@query("jn_24_expired_candidates", VALID + ", x AS (SELECT id, code, c_nationkey FROM v JOIN customer ON c_custkey = id WHERE year_to <= 2000), n AS (SELECT code, c_nationkey, count(*) AS active FROM v JOIN customer ON c_custkey = id WHERE year_to > 2000 GROUP BY 1, 2) SELECT x.id, x.code, coalesce(active, 0) AS candidates FROM x LEFT JOIN n ON n.code = x.code AND n.c_nationkey = x.c_nationkey")
def _(spark, root):
    v = validity(spark, root).join(scan(spark, root, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "id")
    active = v.filter("year_to > 2000").groupBy("code", "c_nationkey").agg(F.count(F.lit(1)).alias("active"))
    return v.filter("year_to <= 2000").join(active, ["code", "c_nationkey"], "left").select("id", "code", F.coalesce("active", F.lit(0)).alias("candidates"))


@query(
    "jn_25_code_presence_audit",
    VALID + ", y AS (SELECT DISTINCT o_custkey AS id, year(o_orderdate) AS year FROM orders) SELECT g.year, count(*) FILTER (WHERE year_from <= g.year AND g.year < year_to) AS half_open, count(*) FILTER (WHERE year_from <= g.year AND g.year <= year_to) AS inclusive, count(y.id) AS present, count(*) FILTER (WHERE year_from <= g.year AND g.year <= year_to AND y.id IS NULL) AS missing FROM v CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) g LEFT JOIN y ON y.id = v.id AND y.year = g.year GROUP BY 1",
)
def _(spark, root):
    seen = scan(spark, root, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"), F.lit(1).alias("seen")).distinct()
    g = validity(spark, root).withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001)))).join(seen, ["id", "year"], "left")
    began, y = F.col("year_from") <= F.col("year"), F.col("year")
    inclusive = began & (y <= F.col("year_to"))
    out = g.groupBy("year").agg(F.count_if(began & (y < F.col("year_to"))).alias("half_open"), F.count_if(inclusive).alias("inclusive"), F.count("seen").alias("present"), F.count_if(inclusive & F.col("seen").isNull()).alias("missing"))
    return out.withColumn("year", y.cast("long"))


@query("jn_26_prefix_crosswalk", "SELECT substr(c_name, 1, 16) AS parent, count(*) AS members, min(c_custkey) AS low, max(c_custkey) AS high FROM customer GROUP BY 1 HAVING count(*) > 1")
def _(spark, root):
    c = scan(spark, root, "customer").withColumn("parent", F.substring("c_name", 1, 16))
    return c.groupBy("parent").agg(F.count(F.lit(1)).alias("members"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high")).filter("members > 1")


@query(
    "jn_27_value_reconciliation",
    "WITH l AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1), j AS (SELECT abs(o_totalprice - v) AS d FROM orders JOIN l ON l.k = o_orderkey) SELECT count(*) AS n, count(*) FILTER (WHERE d >= 0.05) AS listed, round(avg(d), 4) AS mean_diff, round(max(d), 4) AS max_diff FROM j",
)
def _(spark, root):
    li, o = scan(spark, root, "lineitem", "orders")
    sums = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(P.exact_sum("l_extendedprice").alias("v"))
    d = o.join(sums, "o_orderkey").select(F.abs(F.col("o_totalprice") - F.col("v")).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") >= 0.05).alias("listed"), F.round(F.avg("d"), 4).alias("mean_diff"), F.round(F.max("d"), 4).alias("max_diff"))


@query("set_01_union_all", "SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def _(spark, root):
    n = lambda t: scan(spark, root, t).agg(F.lit(t).alias("t"), F.count(F.lit(1)).alias("n"))
    return n("orders").unionByName(n("customer")).unionByName(n("part"))


def _customers_of(spark, root, year):
    return scan(spark, root, "orders").filter(F.year("o_orderdate") == year).select("o_custkey")


@query("set_02_intersect", "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1999")
def _(spark, root):
    return _customers_of(spark, root, 1996).intersect(_customers_of(spark, root, 1999))


@query("set_03_except", "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1999 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996")
def _(spark, root):
    return _customers_of(spark, root, 1999).exceptAll(_customers_of(spark, root, 1999).limit(0)).subtract(_customers_of(spark, root, 1996))


@query("set_04_multiset_difference", "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1999 EXCEPT ALL SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996")
def _(spark, root):
    return S.multiset_difference(_customers_of(spark, root, 1999), _customers_of(spark, root, 1996))


@query("set_05_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def _(spark, root):
    for t in ("customer", "orders"):
        scan(spark, root, t).createOrReplaceTempView(f"cells_{t}")
    return spark.sql("select c_custkey from cells_customer c where exists (select 1 from cells_orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000) and exists (select 1 from cells_orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')")


@query("set_06_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, root):
    return scan(spark, root, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query(
    "set_07_coverage",
    "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1999) SELECT count(*) FILTER (WHERE b.o_custkey IS NOT NULL) AS covered, count(*) AS \"of\", count(*) FILTER (WHERE b.o_custkey IS NOT NULL) / count(*) AS coverage, (SELECT list(o_custkey ORDER BY o_custkey) FROM (SELECT o_custkey FROM a EXCEPT SELECT o_custkey FROM b ORDER BY 1 LIMIT 5)) AS missed FROM a LEFT JOIN b USING (o_custkey)",
)
def _(spark, root):
    out = S.coverage(_customers_of(spark, root, 1996), _customers_of(spark, root, 1999), ["o_custkey"])
    return out.withColumn("missed", F.transform("missed", lambda x: x["o_custkey"]))


@query("set_08_in_all", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) FILTER (WHERE year(o_orderdate) BETWEEN 1996 AND 2000) = 5")
def _(spark, root):
    return S.in_all([_customers_of(spark, root, y) for y in range(1996, 2001)], ["o_custkey"])


@query("set_09_reverse_edges", DIST + ", e AS (SELECT DISTINCT x, y FROM d WHERE x <> y AND distance = 0.1) SELECT x, y FROM e UNION SELECT y, x FROM e")
def _(spark, root):
    e = distances(spark, root).filter("x <> y and distance = 0.1").select("x", "y").distinct()
    return S.both_ways(e, "x", "y")


@query("chk_01_unique_key", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, root):
    return C.repeated(scan(spark, root, "events"), ["event_type", "user_id"])


@query(
    "chk_02_conflict_aware_dedup",
    "SELECT o_custkey, o_orderpriority, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN NULL ELSE min(o_orderstatus) END AS o_orderstatus, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'conflict' WHEN count(o_orderstatus) = 0 THEN 'missing' ELSE 'ok' END AS status FROM orders GROUP BY 1, 2",
)
def _(spark, root):
    return C.conflict_aware(scan(spark, root, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query("chk_03_null_capture", "SELECT event_id, 'k' AS field FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL OR TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) = 50")
def _(spark, root):
    e = scan(spark, root, "events").withColumn("k", F.nullif(F.get_json_object("props", "$.k").try_cast("long"), F.lit(50)))
    return C.split_nulls(e, "k")[1].select("event_id", F.lit("k").alias("field"))


@query("chk_04_orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _(spark, root):
    li, o = scan(spark, root, "lineitem", "orders")
    return C.orphans(li, o.filter("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("chk_05_type_check", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity = floor(l_quantity) AS whole, l_discount * 100 = floor(l_discount * 100) AS cents FROM lineitem")
def _(spark, root):
    whole = lambda c: c == F.floor(c).cast("double")
    return scan(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", whole(F.col("l_quantity")).alias("whole"), whole(F.col("l_discount") * 100).alias("cents"))


@query("chk_06_surrogate_id", "SELECT sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)) AS id, c_custkey FROM customer")
def _(spark, root):
    return scan(spark, root, "customer").select(text.surrogate(F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("id"), "c_custkey")


@query("chk_07_leakage", TOTALS + " SELECT o.m AS origin, t.m AS target, count(*) AS n FROM (VALUES (23970), (23980)) o(m) JOIN total t ON t.m > o.m - 2 AND t.m <= o.m + 3 GROUP BY 1, 2")
def _(spark, root):
    t = P.totals(spark, root).withColumn("origin", F.explode(F.array(F.lit(23970), F.lit(23980)))).filter(F.col("m") <= F.col("origin") + 3)
    return C.leaks(t, "origin", "m", 2).groupBy("origin", F.col("m").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("chk_08_future_invariance", "SELECT 0 AS broken")
def _(spark, root):
    run = lambda df: df.withColumn("before", calendar.at_lag("value", 1, ["tid"])).withColumn("mean", F.avg("value").over(calendar.up_to(["tid"], 1)))
    return C.unchanged_before(run, P.totals(spark, root), "m", "value", 23980, ["tid"]).agg(F.count(F.lit(1)).cast("int").alias("broken"))


@query("chk_09_provenance", "SELECT event_id FROM events WHERE event_type = 'error' AND value > 10")
def _(spark, root):
    e = scan(spark, root, "events").select("event_id", F.when(F.col("value") > 10, "measured").otherwise("scenario").alias("role"), F.when(F.col("event_type") == "error", "synthetic").otherwise("source").alias("origin"))
    return C.mixed_provenance(e, "role", "origin").select("event_id")


@query("chk_10_month_boundary", "SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS local_day, hour(ts) = 21 AND minute(ts) = 0 AS boundary FROM events WHERE hour(ts) >= 20")
def _(spark, root):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Moscow")
    return scan(spark, root, "events").filter(F.hour("ts") >= 20).select("event_id", F.date_format(local, "yyyy-MM-dd").alias("local_day"), ((F.hour("ts") == 21) & (F.minute("ts") == 0)).alias("boundary"))


@query("chk_13_guarded_resume", PANEL + " SELECT DISTINCT tid, cat FROM panel WHERE cat <> 'BUILDING'")
def _(spark, root):
    tasks = P.panel(spark, root).select(*BY).distinct()
    done = tasks.filter("cat in ('BUILDING', 'MACHINERY')").withColumn("fingerprint", F.when(F.col("cat") == "BUILDING", "current").otherwise("old"))
    return C.pending(tasks, done, BY, "current")


@query("fn_01_month_arithmetic", "SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, strftime(o_orderdate + INTERVAL 5 MONTH, '%Y-%m') AS plus5 FROM orders")
def _(spark, root):
    return scan(spark, root, "orders").select("o_orderkey", P.month_index("o_orderdate").alias("m")).withColumn("plus5", P.month_text(F.col("m") + 5))


@query("fn_02_month_difference", "SELECT o_custkey, CAST((year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate)) AS INTEGER) AS months FROM orders GROUP BY 1")
def _(spark, root):
    return scan(spark, root, "orders").groupBy("o_custkey").agg((F.max(P.month_index("o_orderdate")) - F.min(P.month_index("o_orderdate"))).alias("months"))


@query("fn_03_parse_utc", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_ms(date_trunc('second', ts)) // 1000 END AS at FROM events")
def _(spark, root):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    t = F.when(F.col("event_type") == "error", "no date").when(F.col("event_type") == "click", F.concat(t, F.lit("Z"))).otherwise(t)
    return scan(spark, root, "events").select("event_id", F.unix_timestamp(calendar.parse_utc(t)).alias("at"))


@query("fn_04_time_zone", "SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m') AS local_month FROM events")
def _(spark, root):
    return scan(spark, root, "events").select("event_id", calendar.local_month(F.col("ts").cast("timestamp")).alias("local_month"))


@query("fn_05_available_at", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE greatest(ts, ts + (length(event_type) - 5) * INTERVAL 1 HOUR) END AS available FROM events")
def _(spark, root):
    seen = F.when(F.col("event_type") != "error", F.expr("ts + make_dt_interval(0, length(event_type) - 5, 0, 0)"))
    return scan(spark, root, "events").select("event_id", calendar.available_at(F.col("ts"), seen).alias("available"))


@query("fn_06_day_first_date", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS shown, CAST(o_orderdate AS DATE) AS back FROM orders")
def _(spark, root):
    shown = F.date_format("o_orderdate", "dd.MM.yyyy")
    return scan(spark, root, "orders").select("o_orderkey", shown.alias("shown")).withColumn("back", F.to_date("shown", "dd.MM.yyyy"))


@query("fn_07_name_key", "SELECT p_partkey, list_aggregate(list_sort(string_split(lower(p_name), ' ')), 'string_agg', ' ') AS key FROM part")
def _(spark, root):
    return scan(spark, root, "part").select("p_partkey", text.name_key(F.col("p_name")).alias("key"))


@query("fn_08_code_normalise", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '000' AS code FROM customer")
def _(spark, root):
    dashed = F.concat_ws("-", F.substring(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), 1, 2), F.substring(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), 3, 6))
    return scan(spark, root, "customer").select("c_custkey", text.code11(dashed).alias("code"))


@query("fn_09_bare_name", "SELECT s_suppkey, regexp_replace(replace(lower(s_name), 'supplier#', ''), '0$', '') AS name FROM supplier")
def _(spark, root):
    return scan(spark, root, "supplier").select("s_suppkey", text.bare_name(F.col("s_name"), "supplier#", "0").alias("name"))


@query("fn_10_whitespace", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h FROM documents")
def _(spark, root):
    return scan(spark, root, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("h"))


@query("fn_12_typed_envelope", "SELECT n_nationkey, n_name AS value FROM nation")
def _(spark, root):
    n = scan(spark, root, "nation").withColumn("packed", F.concat(F.lit("__string__"), F.base64("n_name")))
    parts = F.regexp_extract("packed", "^__(\\w+?)__(.*)$", 1), F.regexp_extract("packed", "^__(\\w+?)__(.*)$", 2)
    return n.select("n_nationkey", text.envelope(*parts).alias("value"))


@query("fn_13_canonical_json", "SELECT c_custkey, '{\"kind\":\"' || c_mktsegment || '\",\"nation\":' || c_nationkey || '}' AS dims FROM customer")
def _(spark, root):
    return scan(spark, root, "customer").select("c_custkey", text.canonical_json(nation=F.col("c_nationkey"), kind=F.col("c_mktsegment")).alias("dims"))


@query("fn_14_url_allow_list", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_matches(url, '^https?://([^/@]+\\.)?example\\.com(/|$|\\?|:)') AS allowed FROM pages")
def _(spark, root):
    return scan(spark, root, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), text.allowed_url(F.col("url"), ["http", "https"], ["example.com"]).alias("allowed"))


@query("fn_15_formula_evaluator", "SELECT n_nationkey, n_regionkey, (n_nationkey + 2 * n_regionkey) / 4 + n_nationkey AS value FROM nation")
def _(spark, root):
    from ledgerline.functions.formula import evaluate

    n = scan(spark, root, "nation").select("n_nationkey", "n_regionkey")
    return n.withColumn("value", evaluate("(A1 + 2 * B1) / 4 - -A1", {"A1": F.col("n_nationkey").cast("decimal(20,6)"), "B1": F.col("n_regionkey").cast("decimal(20,6)")}).cast("double"))


@query("fn_16_math", "SELECT event_id, round(ln(value + 1), 9) AS a, round(exp(-value / 10), 9) AS b, round(sqrt(value), 9) AS c, floor(value)::BIGINT AS d, round(log2(value + 1), 9) AS e, round(sin(value), 9) AS f, sign(value - 10)::DOUBLE AS g, round(value ^ 1.5, 6) AS h FROM events")
def _(spark, root):
    x = F.col("value")
    return scan(spark, root, "events").select(
        "event_id", F.round(F.log1p(x), 9).alias("a"), F.round(F.exp(-x / 10), 9).alias("b"), F.round(F.sqrt(x), 9).alias("c"), F.floor(x).alias("d"),
        F.round(F.log2(x + 1), 9).alias("e"), F.round(F.sin(x), 9).alias("f"), F.signum(x - 10).alias("g"), F.round(F.pow(x, F.lit(1.5)), 6).alias("h"),
    )


@query("fn_17_array_reductions", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT vec_id, round(list_sum(list_transform(x, lambda v: v * v)), 6) AS dot, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm, list_position(x, list_max(x)) - 1 AS argmax, list_position(x, list_min(x)) - 1 AS argmin, round(list_avg(x), 9) AS mean FROM e")
def _(spark, root):
    from ledgerline.functions import arrays as R

    x = F.transform("embedding", lambda v: v.cast("double"))
    e = scan(spark, root, "embeddings").select("vec_id", x.alias("x"))
    return e.select("vec_id", F.round(R.dot(F.col("x"), F.col("x")), 6).alias("dot"), F.round(R.norm(F.col("x")), 6).alias("norm"), R.argmax(F.col("x")).alias("argmax"), R.argmin(F.col("x")).alias("argmin"), F.round(R.mean(F.col("x")), 9).alias("mean"))


@query("fn_18_round_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS even FROM lineitem")
def _(spark, root):
    return scan(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_quantity") / 2, 0).alias("even"))


@query("fn_19_json_field", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def _(spark, root):
    k = F.from_json("props", "k long")["k"]
    return scan(spark, root, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("fn_20_content_hash_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS h, count(*) AS n FROM documents GROUP BY 2")
def _(spark, root):
    return scan(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
