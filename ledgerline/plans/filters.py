"""Scans, filters, masks and projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import calendar, normalise
from ledgerline.operators import panel as P
from ledgerline.plans.registry import PANEL, TOTALS, query
from ledgerline.sources import tables


@query("src_01_named_scan", "SELECT r_regionkey, r_name FROM region")
def _(spark, root):
    return tables.scan(spark, root, "region")


@query("src_02_projected_scan", "SELECT DISTINCT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark, root):
    return tables.select(spark, root, "orders", ["o_orderkey", "o_orderstatus", "o_orderkey"], {"o_orderpriority": "1-URGENT"}).distinct()


@query("src_03_pushed_predicate", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
def _(spark, root):
    return tables.scan(spark, root, "lineitem").filter("l_quantity >= 49 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("src_04_conjunctive_scan", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size = 10 AND p_brand = 'Brand#11'")
def _(spark, root):
    return tables.select(spark, root, "part", ["p_partkey", "p_brand", "p_size"], {"p_size": 10, "p_brand": "Brand#11"})


COUNTED = " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS \"rows\" FROM {n}" for n in tables.NAMES)


@query("src_05_catalog", f"SELECT dataset, \"rows\", columns FROM ({COUNTED}) JOIN (SELECT table_name AS dataset, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns FROM information_schema.columns GROUP BY 1) USING (dataset)")
def _(spark, root):
    return tables.catalog(spark, root).select("dataset", "rows", "columns")


@query("src_05_contents")
def _(spark, root):
    return tables.catalog(spark, root).select("dataset", "files", "bytes", "content")


@query(
    "src_06_profile",
    """WITH s AS (SELECT count(*) AS n, count(*) - count(o_orderkey) AS a, count(*) - count(o_custkey) AS b, count(*) - count(o_orderstatus) AS c,
  count(*) - count(o_totalprice) AS d, count(*) - count(o_orderdate) AS e, count(*) - count(o_orderpriority) AS f, count(DISTINCT o_orderkey) AS k, count(DISTINCT o_custkey) AS q FROM orders)
SELECT 'o_orderkey' AS "column", n AS "rows", a AS nulls, k AS distinct_values FROM s UNION ALL SELECT 'o_custkey', n, b, q FROM s
UNION ALL SELECT 'o_orderstatus', n, c, NULL FROM s UNION ALL SELECT 'o_totalprice', n, d, NULL FROM s
UNION ALL SELECT 'o_orderdate', n, e, NULL FROM s UNION ALL SELECT 'o_orderpriority', n, f, NULL FROM s""",
)
def _(spark, root):
    return tables.profile(tables.scan(spark, root, "orders"), ["o_orderkey", "o_custkey"])


@query(
    "src_17_relational_view",
    "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
)
def _(spark, root):
    for t in ("customer", "nation", "region"):
        tables.scan(spark, root, t).createOrReplaceTempView(f"evidence_{t}")
    return spark.sql(
        "select n_name, r_name, count(*) as customers from evidence_customer join evidence_nation on c_nationkey = n_nationkey join evidence_region on n_regionkey = r_regionkey group by all"
    )


@query(
    "src_17_constraints",
    "SELECT 'orders: primary key' AS rule, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS broken UNION ALL SELECT 'lineitem: refers to orders', (SELECT count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'customer: unique name', (SELECT count(*) FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'orders: status is O, F or P', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')) UNION ALL SELECT 'supplier: balance not negative', (SELECT count(*) FROM supplier WHERE s_acctbal < 0)",
)
def _(spark, root):
    from ledgerline.operators import checks

    t = lambda name: tables.scan(spark, root, name)
    return checks.constraints(
        {
            "orders: primary key": checks.repeated(t("orders"), ["o_orderkey"]),
            "lineitem: refers to orders": checks.orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"),
            "customer: unique name": checks.repeated(t("customer"), ["c_name"]),
            "orders: status is O, F or P": t("orders").filter("o_orderstatus not in ('O', 'F', 'P')"),
            "supplier: balance not negative": t("supplier").filter("s_acctbal < 0"),
        }
    )


@query(
    "src_18_append_release",
    """WITH base AS (SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) <= 1998), delta AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE year(o_orderdate) >= 1998)
SELECT count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
FROM (SELECT * FROM base UNION ALL SELECT * FROM delta d WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.o_orderkey = d.o_orderkey))""",
)
def _(spark, root):
    orders = tables.scan(spark, root, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    base = orders.filter(F.year("o_orderdate") <= 1998).drop("o_orderdate")
    delta = orders.filter(F.year("o_orderdate") >= 1998).select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return tables.append(base, delta, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n"), F.round(P.exact_sum("o_totalprice"), 2).alias("total"))


@query("flt_01_equality_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3")
def _(spark, root):
    return tables.select(spark, root, "customer", ["c_custkey", "c_mktsegment"], {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 3})


@query("flt_02_mandatory_filter", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey = 7")
def _(spark, root):
    return tables.select(spark, root, "lineitem", ["l_orderkey", "l_partkey"], {"l_suppkey": 7}, required=("l_suppkey", "l_partkey"))


@query(
    "flt_03_limit_report",
    "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS matched, least((SELECT count(*) FROM orders), 50) AS returned, (SELECT count(*) FROM orders) > 50 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def _(spark, root):
    return tables.report(tables.scan(spark, root, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)


@query("flt_04_row_budget", "SELECT n_nationkey, n_name FROM nation")
def _(spark, root):
    return tables.guarded(tables.scan(spark, root, "nation").select("n_nationkey", "n_name"), 750_000)


@query("flt_05_month_range", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1997-03' AND '1997-06'")
def _(spark, root):
    ym = F.date_format("o_orderdate", "yyyy-MM")
    return tables.scan(spark, root, "orders").select("o_orderkey", ym.alias("ym")).filter(F.col("ym").between("1997-03", "1997-06"))


@query("flt_06_prefix", "SELECT p_partkey, p_name FROM part WHERE p_brand LIKE 'Brand#2%'")
def _(spark, root):
    return tables.scan(spark, root, "part").filter(F.col("p_brand").startswith("Brand#2")).select("p_partkey", "p_name")


@query("flt_07_regex", "SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(c_name, 'Customer#0*[1-9][0-9]?')")
def _(spark, root):
    return tables.scan(spark, root, "customer").filter(F.col("c_name").rlike("^Customer#0*[1-9][0-9]?$")).select("c_custkey", "c_name")


@query("flt_08_finite", "SELECT event_id, ln(value - 5) AS x FROM events WHERE value > 5")
def _(spark, root):
    x = tables.null_if_nan(tables.scan(spark, root, "events").select("event_id", F.ln(F.nullif(F.greatest(F.col("value") - 5, F.lit(0.0)), F.lit(0.0))).alias("x")))
    return x.filter(P.finite("x"))


@query(
    "flt_09_validity_interval",
    """WITH v AS (SELECT o_custkey, min(year(o_orderdate)) AS year_from, max(year(o_orderdate)) AS year_to FROM orders GROUP BY 1)
SELECT o_custkey, CAST(year_from AS INTEGER) AS year_from, CAST(year_to AS INTEGER) AS year_to, year_from <= 1998 AND 1998 < year_to AS half_open, year_from <= 1998 AND 1998 <= year_to AS inclusive FROM v WHERE year_from <= 1998 AND 1998 <= year_to""",
)
def _(spark, root):
    v = tables.scan(spark, root, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("year_from"), F.max(F.year("o_orderdate")).alias("year_to"))
    began = F.col("year_from") <= 1998
    return v.withColumns({"half_open": began & (F.lit(1998) < F.col("year_to")), "inclusive": began & (F.lit(1998) <= F.col("year_to"))}).filter("inclusive")


@query(
    "flt_10_drop_null_coerced",
    "SELECT event_id, k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL AND k >= 50",
)
def _(spark, root):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return tables.scan(spark, root, "events").select("event_id", k.alias("k")).na.drop(subset=["k"]).filter("k >= 50")


@query("flt_11_set_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def _(spark, root):
    wanted = tables.scan(spark, root, "customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return tables.scan(spark, root, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query(
    "flt_12_complete_grid",
    PANEL + ", y AS (SELECT * FROM panel WHERE m // 12 = 1997) SELECT tid, cat, m, value FROM y p WHERE (SELECT count(*) FROM y q WHERE q.tid = p.tid AND q.cat = p.cat) = 12",
)
def _(spark, root):
    return P.complete(P.panel(spark, root).filter(F.floor(F.col("m") / 12) == 1997), ["tid", "cat"], ["m"], 12)


@query(
    "flt_12_completeness_reasons",
    PANEL + " SELECT tid, cat, count(DISTINCT m) AS cells, count(*) FILTER (WHERE value <= 0) AS not_positive, CASE WHEN count(DISTINCT m) < 80 THEN 'missing cells' WHEN count(*) FILTER (WHERE value <= 0) > 0 THEN 'not positive' ELSE 'complete' END AS status FROM panel GROUP BY 1, 2",
)
def _(spark, root):
    return P.completeness(P.panel(spark, root), ["tid", "cat"], ["m"], 80)


@query(
    "flt_13_common_mask",
    PANEL + """, w AS (SELECT p.tid, p.cat, p.m, p.value, a.value AS pred_last, b.value AS pred_seasonal FROM panel p LEFT JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1 LEFT JOIN panel b ON b.tid = p.tid AND b.cat = p.cat AND b.m = p.m - 12)
SELECT * FROM w WHERE value IS NOT NULL AND pred_last IS NOT NULL AND pred_seasonal IS NOT NULL""",
)
def _(spark, root):
    p = P.panel(spark, root)
    p = p.withColumns({"pred_last": calendar.at_lag("value", 1, ["tid", "cat"]), "pred_seasonal": calendar.at_lag("value", 12, ["tid", "cat"])})
    return p.na.drop(subset=["value", "pred_last", "pred_seasonal"])


@query("prj_01_alias_by_candidates", "SELECT n_nationkey AS territory_id, n_name AS name FROM nation")
def _(spark, root):
    df = tables.scan(spark, root, "nation")
    pick = lambda *names: next(F.col(n) for n in names if n in df.columns)
    return df.select(pick("territory_id", "id", "n_nationkey").alias("territory_id"), pick("name", "n_name").alias("name"))


@query("prj_02_share_of_total", TOTALS + " SELECT p.tid, p.cat, p.m, p.value / t.value AS share FROM panel p JOIN total t ON t.tid = p.tid AND t.m = p.m")
def _(spark, root):
    total = P.totals(spark, root).withColumnRenamed("value", "total")
    return P.panel(spark, root).join(total, ["tid", "m"]).select("tid", "cat", "m", normalise.ratio(F.col("value"), F.col("total")).alias("share"))


@query("prj_03_sum_normalised", PANEL + ", a AS (SELECT tid, cat, sum(CAST(value AS DECIMAL(18,2))) AS v FROM panel WHERE m // 12 = 1998 GROUP BY 1, 2) SELECT tid, cat, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY tid) AS DOUBLE) AS share FROM a")
def _(spark, root):
    a = P.panel(spark, root).filter(F.floor(F.col("m") / 12) == 1998).groupBy("tid", "cat").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    return a.select("tid", "cat", (F.col("v").cast("double") / F.sum("v").over(normalise.over(["tid"])).cast("double")).alias("share"))


@query("prj_04_log_volume", PANEL + " SELECT tid, cat, round(ln(1 + avg(value)), 9) AS log_volume FROM panel GROUP BY 1, 2")
def _(spark, root):
    return P.panel(spark, root).groupBy("tid", "cat").agg(F.round(F.log1p(F.avg("value")), 9).alias("log_volume"))


@query(
    "prj_05_relative_volume",
    TOTALS + " SELECT t.tid, t.m, round(ln(t.value / k.med), 9) AS log_relative FROM total t JOIN (SELECT tid, median(value) AS med FROM total WHERE m < 1998 * 12 GROUP BY 1) k ON k.tid = t.tid",
)
def _(spark, root):
    t = P.totals(spark, root)
    med = t.filter(F.col("m") < 1998 * 12).groupBy("tid").agg(F.median("value").alias("med"))
    return t.join(med, "tid").select("tid", "m", F.round(F.ln(F.col("value") / F.col("med")), 9).alias("log_relative"))


@query(
    "prj_06_relative_change",
    PANEL + " SELECT p.tid, p.cat, p.m, round(p.value / a.value - 1, 9) AS mom, round(p.value / b.value - 1, 9) AS yoy, round(ln(p.value / b.value), 9) AS log_yoy FROM panel p LEFT JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1 LEFT JOIN panel b ON b.tid = p.tid AND b.cat = p.cat AND b.m = p.m - 12",
)
def _(spark, root):
    by, v = ["tid", "cat"], F.col("value")
    p = P.panel(spark, root).withColumns({"v1": calendar.at_lag("value", 1, by), "v12": calendar.at_lag("value", 12, by)})
    return p.select(*by, "m", F.round(v / F.col("v1") - 1, 9).alias("mom"), F.round(v / F.col("v12") - 1, 9).alias("yoy"), F.round(F.ln(v / F.col("v12")), 9).alias("log_yoy"))


@query("prj_07_z_score", PANEL + " SELECT tid, cat, m, round(CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z FROM panel WINDOW w AS (PARTITION BY tid, cat)")
def _(spark, root):
    return P.panel(spark, root).select("tid", "cat", "m", F.round(normalise.z_score("value", ["tid", "cat"]), 6).alias("z"))


@query(
    "prj_08_robust_z",
    PANEL + """, a AS (SELECT *, median(value) OVER (PARTITION BY tid, cat) AS med FROM panel), b AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY tid, cat) AS mad FROM a)
SELECT tid, cat, m, round(CASE WHEN mad = 0 THEN 0 ELSE 0.67448975 * (value - med) / mad END, 6) AS z FROM b""",
)
def _(spark, root):
    from ledgerline.functions.stats import robust_z

    return robust_z(P.panel(spark, root), "value", ["tid", "cat"]).select("tid", "cat", "m", F.round("z", 6).alias("z"))


@query("prj_09_min_max", PANEL + " SELECT tid, cat, m, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 9) AS x FROM panel WINDOW w AS (PARTITION BY tid, cat)")
def _(spark, root):
    return P.panel(spark, root).select("tid", "cat", "m", F.round(normalise.min_max("value", ["tid", "cat"]), 9).alias("x"))


@query("prj_10_log1p_guard", "SELECT event_id, round(ln(1 + value), 9) AS x FROM events")
def _(spark, root):
    return tables.scan(spark, root, "events").select("event_id", F.round(normalise.log1p_guarded("value"), 9).alias("x"))


@query("prj_11_mean_index", PANEL + " SELECT tid, cat, m, round(100 * value / avg(value) OVER (PARTITION BY tid, cat), 6) AS x FROM panel")
def _(spark, root):
    return P.panel(spark, root).select("tid", "cat", "m", F.round(normalise.mean_index("value", ["tid", "cat"]), 6).alias("x"))


@query("prj_12_grouped_normalise", "SELECT event_id, event_type, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 9) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def _(spark, root):
    e = tables.scan(spark, root, "events")
    return e.select("event_id", "event_type", F.round(normalise.z_score("value", ["event_type"]), 6).alias("z"), F.round(normalise.min_max("value", ["event_type"]), 9).alias("scaled"))


@query(
    "prj_13_frozen_standardisation",
    PANEL + " SELECT p.tid, p.cat, p.m, round((p.value - k.mu) / k.sigma, 6) AS z FROM panel p JOIN (SELECT cat, avg(value) AS mu, stddev_pop(value) AS sigma FROM panel WHERE m // 12 = 1996 GROUP BY 1) k ON k.cat = p.cat",
)
def _(spark, root):
    p = P.panel(spark, root)
    k = p.filter(F.floor(F.col("m") / 12) == 1996).groupBy("cat").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
    return p.join(k, "cat").select("tid", "cat", "m", F.round((F.col("value") - F.col("mu")) / F.col("sigma"), 6).alias("z"))


@query(
    "prj_14_alternative_normalisations",
    PANEL + """, k AS (SELECT cat, avg(value) FILTER (WHERE m // 12 = 1996) AS mu, stddev_pop(value) FILTER (WHERE m // 12 = 1996) AS sg, avg(value) AS ma, stddev_pop(value) AS sa,
  avg(ln(value)) FILTER (WHERE m // 12 = 1996) AS ml, stddev_pop(ln(value)) FILTER (WHERE m // 12 = 1996) AS sl FROM panel GROUP BY 1)
SELECT p.tid, p.cat, p.m, round((value - mu) / sg, 6) AS z_train, round((value - ma) / sa, 6) AS z_all, round((ln(value) - ml) / sl, 6) AS log_z_train FROM panel p JOIN k ON k.cat = p.cat""",
)
def _(spark, root):
    p, train, v = P.panel(spark, root), F.floor(F.col("m") / 12) == 1996, F.col("value")
    some = lambda x: F.when(train, x)
    stats = {"mu": F.avg(some(v)), "sg": F.stddev_pop(some(v)), "ma": F.avg(v), "sa": F.stddev_pop(v), "ml": F.avg(some(F.ln(v))), "sl": F.stddev_pop(some(F.ln(v)))}
    k = p.groupBy("cat").agg(*(x.alias(n) for n, x in stats.items()))
    z = lambda x, a, b: F.round((x - F.col(a)) / F.col(b), 6)
    return p.join(k, "cat").select("tid", "cat", "m", z(v, "mu", "sg").alias("z_train"), z(v, "ma", "sa").alias("z_all"), z(F.ln(v), "ml", "sl").alias("log_z_train"))


@query(
    "prj_15_one_hot",
    "SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS seg_building, CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS seg_furniture, CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS seg_household, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS seg_machinery FROM customer",
)
def _(spark, root):
    from ledgerline.operators.shape import one_hot

    c = tables.scan(spark, root, "customer")
    return one_hot(c, "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "seg").select("c_custkey", "seg_building", "seg_furniture", "seg_household", "seg_machinery")


@query("prj_16_cyclic", "SELECT DISTINCT m, round(sin(2 * pi() * m / 12), 9) + 0.0 AS s, round(cos(2 * pi() * m / 12), 9) + 0.0 AS c FROM (SELECT month(o_orderdate) AS m FROM orders)")
def _(spark, root):
    s, c = calendar.season("mi")
    m = tables.scan(spark, root, "orders").select(P.month_index("o_orderdate").alias("mi")).distinct()
    return m.select((F.col("mi") % 12 + 1).cast("long").alias("m"), (F.round(s, 9) + 0.0).alias("s"), (F.round(c, 9) + 0.0).alias("c")).distinct()


@query("prj_17_clip", "SELECT l_orderkey, l_linenumber, least(greatest(l_discount - 0.05, -0.03), 0.03) AS clipped FROM lineitem")
def _(spark, root):
    return tables.scan(spark, root, "lineitem").select("l_orderkey", "l_linenumber", normalise.clip(F.col("l_discount") - 0.05, -0.03, 0.03).alias("clipped"))


@query("prj_18_reason_ladder", "SELECT event_id, CASE WHEN user_id IS NULL THEN 'no user' WHEN event_type = 'error' THEN 'error' WHEN value < 1 THEN 'too small' ELSE 'accepted' END AS status FROM events")
def _(spark, root):
    from ledgerline.operators.shape import ladder

    return tables.scan(spark, root, "events").select("event_id", ladder([("no user", F.col("user_id").isNull()), ("error", F.col("event_type") == "error"), ("too small", F.col("value") < 1)], "accepted").alias("status"))


@query("prj_19_guarded_ratio", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS r FROM lineitem")
def _(spark, root):
    return tables.scan(spark, root, "lineitem").select("l_orderkey", "l_linenumber", normalise.ratio(F.col("l_discount"), F.col("l_tax")).alias("r"))


@query("prj_20_money_to_kopecks", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS kopecks, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100000 AS BIGINT) AS of_thousands FROM orders")
def _(spark, root):
    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return tables.scan(spark, root, "orders").select("o_orderkey", normalise.kopecks(text).alias("kopecks"), normalise.kopecks(text, 1000).alias("of_thousands"))


@query(
    "prj_21_pre_period_profile",
    TOTALS + """, t AS (SELECT tid, m - 1996 * 12 AS t, ln(value) AS y FROM total WHERE m // 12 = 1996)
SELECT tid, round(avg(y), 9) AS level, round(covar_pop(t - 5.5, y) / var_pop(t - 5.5), 9) AS slope, round(stddev_pop(y), 9) AS spread FROM t GROUP BY 1 HAVING count(*) = 12""",
)
def _(spark, root):
    t, y = F.col("m") - 1996 * 12 - 5.5, F.ln("value")
    rows = P.totals(spark, root).filter(F.floor(F.col("m") / 12) == 1996).select("tid", t.alias("t"), y.alias("y"))
    out = rows.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 9).alias("level"), F.round(F.covar_pop("t", "y") / F.var_pop("t"), 9).alias("slope"), F.round(F.stddev_pop("y"), 9).alias("spread"))
    return out.filter("n = 12").drop("n")


@query(
    "prj_22_entity_card",
    TOTALS + """, last AS (SELECT tid, max(m) AS m FROM total GROUP BY 1)
SELECT l.tid, n_name AS name, t.m, t.value, round(t.value / a.value - 1, 9) AS mom, round(t.value / b.value - 1, 9) AS yoy, (SELECT count(*) FROM customer WHERE c_nationkey = l.tid) AS customers
FROM last l JOIN total t ON t.tid = l.tid AND t.m = l.m JOIN nation ON n_nationkey = l.tid LEFT JOIN total a ON a.tid = l.tid AND a.m = l.m - 1 LEFT JOIN total b ON b.tid = l.tid AND b.m = l.m - 12""",
)
def _(spark, root):
    t = P.totals(spark, root).withColumns({"v1": calendar.at_lag("value", 1, ["tid"]), "v12": calendar.at_lag("value", 12, ["tid"])})
    last = t.groupBy("tid").agg(F.max_by(F.struct("m", "value", "v1", "v12"), "m").alias("x")).select("tid", "x.*")
    people = tables.scan(spark, root, "customer").groupBy(F.col("c_nationkey").cast("long").alias("tid")).agg(F.count(F.lit(1)).alias("customers"))
    names = tables.scan(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("tid"), F.col("n_name").alias("name"))
    card = last.join(names, "tid").join(people, "tid", "left")
    return card.select("tid", "name", "m", "value", F.round(F.col("value") / F.col("v1") - 1, 9).alias("mom"), F.round(F.col("value") / F.col("v12") - 1, 9).alias("yoy"), "customers")
