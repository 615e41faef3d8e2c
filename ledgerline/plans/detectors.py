"""Shocks, alarms and their scoring over the panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.calendar import at_lag
from ledgerline.functions.draws import draw, draw_sql
from ledgerline.operators import detect as D
from ledgerline.operators import deviations as V
from ledgerline.operators import panel as P
from ledgerline.operators import windows as W
from ledgerline.plans.registry import PANEL, TOTALS, query
from ledgerline.plans.relations import ALARMS, GREEDY, alarms_onsets
from ledgerline.sources import tables

BY = ["tid", "cat"]
REL = PANEL + ", r AS (SELECT p.tid, p.cat, p.m, (p.value - a.value) / greatest(abs(a.value), 1e-9) AS rel FROM panel p JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1)"
MAD = REL + ", c AS (SELECT tid, cat, rel, median(rel) OVER (PARTITION BY tid, cat) AS med FROM r WHERE m < 1999 * 12), d AS (SELECT tid, cat, 1.4826 * median(abs(rel - med)) AS mad FROM c GROUP BY 1, 2), s AS (SELECT r.tid, r.cat, r.m, abs(rel) / CASE WHEN mad > 0 THEN mad ELSE 0.05 END AS score FROM r LEFT JOIN d ON d.tid = r.tid AND d.cat = r.cat)"


def residuals(spark, root):
    p = P.panel(spark, root).withColumn("b", at_lag("value", 1, BY)).na.drop(subset=["b"])
    return p.select(*BY, "m", ((F.col("value") - F.col("b")) / F.greatest(F.abs("b"), F.lit(1e-9))).alias("rel"))


def threshold(spark, root, k=1.0):
    r = residuals(spark, root)
    return D.threshold_alarms(r, r.filter(F.col("m") < 1999 * 12), BY, "m", "rel", k)


@query(
    "det_01_event_registry",
    PANEL.replace("WITH", "WITH RECURSIVE")
    + f""", p AS (SELECT tid, cat, m AS onset, {draw_sql("tid", "cat", "m", seed=60)} AS h FROM panel), q AS (SELECT * FROM p ORDER BY h, tid, cat, onset LIMIT 60),
k AS (SELECT tid, cat, min(onset) AS onset FROM q GROUP BY 1, 2 UNION ALL SELECT q.tid, q.cat, min(q.onset) FROM k JOIN q ON q.tid = k.tid AND q.cat = k.cat AND q.onset >= k.onset + 12 GROUP BY q.tid, q.cat)
SELECT tid, cat, onset, CAST(h % 3 + 1 AS INTEGER) AS length, round((h % 5 + 1) / 10 * CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END, 9) AS size, 'synthetic' AS source FROM k JOIN q USING (tid, cat, onset)""",
)
def _(spark, root):
    picked = P.panel(spark, root).select(*BY, "m").withColumn("h", draw("tid", "cat", "m", seed=60)).orderBy("h", *BY, "m").limit(60)  # the registry's length
    spaced = W.cooldown(picked, BY, 12).withColumnRenamed("m", "onset")
    size = (F.pmod("h", F.lit(5)) + 1) / 10 * F.when(F.pmod("h", F.lit(2)) == 0, 1).otherwise(-1)
    return spaced.select(*BY, "onset", (F.pmod("h", F.lit(3)) + 1).cast("int").alias("length"), F.round(size, 9).alias("size"), F.lit("synthetic").alias("source"))


@query(
    "det_02_shock_injection",
    ALARMS + ", f AS (SELECT tid, cat, m, exp(sum(ln(1.5))) AS f FROM (SELECT tid, cat, onset + unnest([0, 1]) AS m FROM onsets) GROUP BY 1, 2, 3) SELECT p.tid, p.cat, p.m, round(p.value * coalesce(f, 1), 4) AS value FROM panel p LEFT JOIN f ON f.tid = p.tid AND f.cat = p.cat AND f.m = p.m",
)
def _(spark, root):
    onsets = alarms_onsets(spark, root)[1].withColumns({"length": F.lit(2), "size": F.lit(0.5)})
    return D.inject(P.panel(spark, root), onsets, BY, "m", "value").select(*BY, "m", F.round("value", 4).alias("value"))


@query("det_03_threshold", MAD + " SELECT s.tid, s.cat, s.m, round(s.score, 6) AS score, coalesce(s.score > 1 AND q.score > 1, false) AS alarm FROM s LEFT JOIN s q ON q.tid = s.tid AND q.cat = s.cat AND q.m = s.m - 1")
def _(spark, root):
    return threshold(spark, root).withColumn("score", F.round("score", 6))


@query(
    "det_04_page_hinkley",
    PANEL.replace("WITH", "WITH RECURSIVE")
    + """, s AS (SELECT tid, cat, m, ln(value) AS x, row_number() OVER (PARTITION BY tid, cat ORDER BY m) AS r FROM panel),
f AS (SELECT tid, cat, m, r, 1 AS n, x AS mean, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM s WHERE r = 1
UNION ALL SELECT tid, cat, m, r, n, mean, greatest(0, up + x - mean - 0.05), greatest(0, down - x + mean - 0.05) FROM (
  SELECT s.tid, s.cat, s.m, s.r, x, n0 + 1 AS n, mean0 + (x - mean0) / (n0 + 1) AS mean, up, down FROM (
    SELECT tid, cat, r, CASE WHEN greatest(up, down) > 1 THEN 0 ELSE n END AS n0, CASE WHEN greatest(up, down) > 1 THEN 0 ELSE mean END AS mean0, CASE WHEN greatest(up, down) > 1 THEN 0 ELSE up END AS up, CASE WHEN greatest(up, down) > 1 THEN 0 ELSE down END AS down FROM f) p
  JOIN s ON s.tid = p.tid AND s.cat = p.cat AND s.r = p.r + 1) q)
SELECT tid, cat, m, round(greatest(up, down), 6) AS statistic, greatest(up, down) > 1 AS alarm FROM f""",
)
def _(spark, root):
    return D.page_hinkley(P.panel(spark, root), BY, "m", "value", 0.05, 1.0).withColumn("statistic", F.round("statistic", 6))


@query("det_05_online_changepoint")
def _(spark, root):
    return D.online_changepoint(P.totals(spark, root), ["tid"], "m", "value")


@query(
    "det_06_threshold_grid",
    MAD + """, o AS (SELECT tid, cat, m AS onset FROM r WHERE rel > 1.5), g AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0]) AS k), h AS (SELECT k, count(*) FILTER (WHERE score > k) AS alarms, count(*) FILTER (WHERE score > k AND onset IS NOT NULL) AS hits FROM g CROSS JOIN s LEFT JOIN o ON o.tid = s.tid AND o.cat = s.cat AND o.onset = s.m GROUP BY 1),
f AS (SELECT k, alarms, hits, 2.0 * hits / (alarms + (SELECT count(*) FROM o)) AS f1, alarms - hits AS fa FROM h) SELECT CAST(k AS DOUBLE) AS k, alarms, hits, round(f1, 9) AS f1, row_number() OVER (ORDER BY f1 DESC, fa, k) = 1 AS chosen FROM f""",
)
def _(spark, root):
    s = threshold(spark, root)
    onsets = residuals(spark, root).filter("rel > 1.5").select(*BY, "m", F.lit(1).alias("hit"))
    events = onsets.agg(F.count(F.lit(1)).alias("events"))
    grid = F.explode(F.array(*(F.lit(k) for k in (0.5, 1.0, 1.5, 2.0, 3.0))))
    h = s.join(onsets, [*BY, "m"], "left").withColumn("k", grid).filter(F.col("score") > F.col("k"))
    h = h.groupBy("k").agg(F.count(F.lit(1)).alias("alarms"), F.count("hit").alias("hits")).join(events, how="cross")  # one row
    f = h.withColumns({"f1": F.lit(2.0) * F.col("hits") / (F.col("alarms") + F.col("events")), "fa": F.col("alarms") - F.col("hits")})
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), "fa", "k")) == 1  # the grid
    return f.withColumn("chosen", best).select("k", "alarms", "hits", F.round("f1", 9).alias("f1"), "chosen")


@query(
    "det_07_detector_scoring",
    GREEDY + ", e AS (SELECT count(*) AS events FROM onsets), a AS (SELECT count(*) AS alarms FROM alarms), h AS (SELECT count(*) AS hits, avg(d) AS mean_delay, avg(abs(d)) AS mean_abs_delay, avg(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS early_share FROM matched) SELECT events, alarms, hits, round(mean_delay, 9) AS mean_delay, round(mean_abs_delay, 9) AS mean_abs_delay, round(early_share, 9) AS early_share, round(hits / events, 9) AS recall, round(hits / alarms, 9) AS \"precision\", alarms - hits AS false_alarms FROM e, a, h",
)
def _(spark, root):
    a, o = alarms_onsets(spark, root)
    s = D.score(D.greedy_match(a, o, BY, 2), o, a)
    return s.select(*(F.round(c, 9).alias(c) if k == "double" else c for c, k in s.dtypes))


WIDE = """, w AS (SELECT tid, m, list(rel ORDER BY cat) AS x FROM r GROUP BY 1, 2 HAVING count(*) = 5)"""


@query(
    "det_08_multivariate_scores",
    REL + WIDE + " SELECT tid, m, round(list_sum(x) / sqrt(5), 6) AS stouffer, round(-list_sum(x) / sqrt(5), 6) AS stouffer_down, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS max_abs, round(list_sum(list_transform(x, lambda v: v * v)), 6) AS energy, round(list_max(list_transform(x, lambda v: v * v)), 6) AS glr FROM w",
)
def _(spark, root):
    from ledgerline.functions import arrays as R

    w = residuals(spark, root).groupBy("tid", "m").agg(F.array_sort(F.collect_list(F.struct("cat", "rel"))).alias("s")).filter(F.size("s") == 5)
    x = w.select("tid", "m", F.transform("s", lambda v: v["rel"]).alias("x"))
    sq = F.transform("x", lambda v: v * v)
    return x.select("tid", "m", F.round(R.total(F.col("x")) / F.sqrt(F.lit(5)), 6).alias("stouffer"), F.round(-R.total(F.col("x")) / F.sqrt(F.lit(5)), 6).alias("stouffer_down"), F.round(F.array_max(F.transform("x", F.abs)), 6).alias("max_abs"), F.round(R.total(sq), 6).alias("energy"), F.round(F.array_max(sq), 6).alias("glr"))


@query(
    "det_09_local_standardisation",
    PANEL + """, d AS (SELECT p.tid, p.cat, p.m, ln(p.value) - ln(a.value) AS d FROM panel p JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1), e AS (SELECT *, d - median(d) OVER (PARTITION BY cat, m) AS e FROM d),
c AS (SELECT tid, cat, e, median(e) OVER (PARTITION BY tid, cat) AS med FROM e WHERE m < 1999 * 12), k AS (SELECT tid, cat, any_value(med) AS med, 1.4826 * median(abs(e - med)) AS mad FROM c GROUP BY 1, 2)
SELECT e.tid, e.cat, e.m, round((e - med) / mad, 6) AS z FROM e JOIN k ON k.tid = e.tid AND k.cat = e.cat WHERE mad > 0""",
)
def _(spark, root):
    from ledgerline.functions.stats import mad

    p = P.panel(spark, root).withColumn("b", at_lag("value", 1, BY)).na.drop(subset=["b"])
    d = p.select(*BY, "m", (F.ln("value") - F.ln("b")).alias("d"))
    med = d.groupBy("cat", "m").agg(F.median("d").alias("c"))
    e = d.join(med, ["cat", "m"]).select(*BY, "m", (F.col("d") - F.col("c")).alias("e"))
    k = mad(e.filter(F.col("m") < 1999 * 12), "e", BY).filter("mad > 0")
    return e.join(k, BY).select(*BY, "m", F.round((F.col("e") - F.col("med")) / F.col("mad"), 6).alias("z"))


@query("det_10_shrunk_covariance")
def _(spark, root):
    from ledgerline.operators.worlds import shrunk_precision

    w = residuals(spark, root).groupBy("tid", "m").pivot("cat", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).agg(F.max("rel")).na.drop()
    return shrunk_precision(w, w.columns[2:])


@query("det_11_worlds")
def _(spark, root):
    from ledgerline.operators.worlds import worlds

    return worlds(spark, 200, 24, 5)


@query("det_12_joint_bank")
def _(spark, root):
    from ledgerline.operators.worlds import joint_bank, worlds

    return joint_bank(worlds(spark, 400, 24, 5), 0.03)


@query("det_13_return_control", REL + ", e AS (SELECT tid, cat, m AS entry FROM r WHERE rel < -0.6), x AS (SELECT e.tid, e.cat, e.entry, min(r.m) AS back FROM e LEFT JOIN r ON r.tid = e.tid AND r.cat = e.cat AND r.rel > 0.8 AND r.m BETWEEN e.entry + 1 AND e.entry + 3 GROUP BY 1, 2, 3) SELECT tid, cat, entry, back, back IS NOT NULL AS \"both\" FROM x")
def _(spark, root):
    r = residuals(spark, root)
    entry = r.filter("rel < -0.6").select(*BY, F.col("m").alias("entry"))
    ahead = entry.withColumn("m", F.explode(F.sequence(F.col("entry") + 1, F.col("entry") + 3)))
    back = ahead.join(r.filter("rel > 0.8").select(*BY, "m"), [*BY, "m"]).groupBy(*BY, "entry").agg(F.min("m").alias("back"))
    return entry.join(back, [*BY, "entry"], "left").withColumn("both", F.col("back").isNotNull())


SHARES = TOTALS + ", s AS (SELECT p.tid, p.cat, p.m, p.value / t.value AS share FROM panel p JOIN total t ON t.tid = p.tid AND t.m = p.m), g AS (SELECT a.tid, a.cat, a.m, a.share - b.share AS change FROM s a JOIN s b ON b.tid = a.tid AND b.cat = a.cat AND b.m = a.m - 12)"


def share_changes(spark, root):
    total = P.totals(spark, root).withColumnRenamed("value", "total")
    s = P.panel(spark, root).join(total, ["tid", "m"]).select(*BY, "m", (F.col("value") / F.col("total")).alias("share"))
    return s.withColumn("b", at_lag("share", 12, BY)).na.drop(subset=["b"]).select(*BY, "m", (F.col("share") - F.col("b")).alias("change"))


PEER = SHARES + ", q AS (SELECT *, median(change) OVER (PARTITION BY cat, m) AS med, count(*) OVER (PARTITION BY cat, m) AS peers FROM g), d AS (SELECT *, median(abs(change - med)) OVER (PARTITION BY cat, m) AS mad FROM q), f AS (SELECT tid, cat, m, change - med AS gap, CASE WHEN mad > 0 THEN (change - med) / (1.4826 * mad) END AS score FROM d WHERE peers >= 5)"


def peer_gaps(spark, root):
    from ledgerline.functions.stats import mad

    g = share_changes(spark, root)
    n = g.groupBy("cat", "m").agg(F.count(F.lit(1)).alias("peers"))
    k = mad(g, "change", ["cat", "m"])
    j = g.join(k, ["cat", "m"]).join(n, ["cat", "m"]).filter("peers >= 5")
    gap = F.col("change") - F.col("med")
    return j.select(*BY, "m", gap.alias("gap"), F.when(F.col("mad") > 0, gap / F.col("mad")).alias("score"))


#: Numbers of peers, least gaps and least scores of the sweep; the main one is 8 peers, 0.01 and 3.
PEERS, GAPS, SCORES = [6, 8, 12, 16, 24], [0.0075, 0.01, 0.0125], [2.5, 3.0, 3.5]
NEAR = SHARES + f""", sz AS (SELECT tid, ln(avg(value)) AS s FROM total GROUP BY 1), pr AS (SELECT a.tid, b.tid AS peer, row_number() OVER (PARTITION BY a.tid ORDER BY abs(a.s - b.s), b.tid) AS r FROM sz a JOIN sz b ON a.tid <> b.tid), kk AS (SELECT unnest({PEERS}) AS k),
met AS (SELECT g.tid, g.cat, g.m, k, g.change, o.change AS other FROM g JOIN pr ON pr.tid = g.tid JOIN kk ON pr.r <= k JOIN g o ON o.tid = pr.peer AND o.cat = g.cat AND o.m = g.m),
pm AS (SELECT *, median(other) OVER w AS med, count(*) OVER w AS n FROM met WINDOW w AS (PARTITION BY tid, cat, m, k)), pd AS (SELECT tid, cat, m, k, any_value(change) AS change, any_value(med) AS med, median(abs(other - med)) AS mad FROM pm WHERE n >= 5 GROUP BY 1, 2, 3, 4),
loo AS (SELECT a.tid, a.cat, a.m, a.change - median(b.change) AS common FROM g a JOIN g b ON b.cat = a.cat AND b.m = a.m AND b.tid <> a.tid GROUP BY a.tid, a.cat, a.m, a.change),
f AS (SELECT tid, cat, m, k, change - med AS gap, (change - med) / greatest(1.4826 * mad, 0.0025) AS score, common FROM pd JOIN loo USING (tid, cat, m))"""


def near_peers(spark, root):
    from ledgerline.operators.peers import nearest_on_line

    size = P.totals(spark, root).groupBy("tid").agg(F.ln(F.avg("value")).alias("s"))
    return V.ranked_peers(nearest_on_line(size, "tid", "s", max(PEERS)), "tid")


def deviating(spark, root, sizes):
    return V.from_peers(share_changes(spark, root), near_peers(spark, root), "tid", ["cat"], "m", "change", sizes)


@query("det_14_peer_gap_flags", NEAR + " SELECT tid, cat, m, round(gap, 9) AS gap, round(score, 6) AS score, round(common, 9) AS common, abs(gap) >= 0.01 AND abs(score) >= 3 AND gap * common > 0 AS flag FROM f WHERE k = 8")
def _(spark, root):
    g = deviating(spark, root, [8]).withColumn("flag", V.flagged(0.01, 3.0))
    return g.select(*BY, "m", F.round("gap", 9).alias("gap"), F.round("score", 6).alias("score"), F.round("common", 9).alias("common"), "flag")


@query(
    "det_15_denominator_decomposition",
    TOTALS + """, x AS (SELECT p.tid, p.cat, p.m, ln(p.value) - ln(a.value) AS num, ln(t.value) - ln(u.value) AS den FROM panel p JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 12 JOIN total t ON t.tid = p.tid AND t.m = p.m JOIN total u ON u.tid = p.tid AND u.m = p.m - 12)
SELECT tid, cat, m, round(num - avg(num) OVER w, 9) AS numerator, round(den - avg(den) OVER w, 9) AS denominator, round((num - den) - avg(num - den) OVER w, 9) AS excess FROM x WINDOW w AS (PARTITION BY cat, m)""",
)
def _(spark, root):
    t = P.totals(spark, root).withColumn("u", at_lag("value", 12, ["tid"])).select("tid", "m", (F.ln("value") - F.ln("u")).alias("den"))
    x = P.panel(spark, root).withColumn("a", at_lag("value", 12, BY)).select(*BY, "m", (F.ln("value") - F.ln("a")).alias("num")).join(t, ["tid", "m"]).na.drop()
    w = Window.partitionBy("cat", "m")
    less = lambda c: F.round(c - F.avg(c).over(w), 9)
    return x.select(*BY, "m", less(F.col("num")).alias("numerator"), less(F.col("den")).alias("denominator"), less(F.col("num") - F.col("den")).alias("excess"))


SWEEP = NEAR + f""", c AS (SELECT k, CAST(g AS DOUBLE) AS g, CAST(s AS DOUBLE) AS s FROM kk CROSS JOIN (SELECT unnest({GAPS}) AS g) CROSS JOIN (SELECT unnest({SCORES}) AS s)),
h AS (SELECT c.k, c.g, c.s, tid, cat, m, sign(gap) AS d FROM c JOIN f ON f.k = c.k AND abs(gap) >= c.g AND abs(score) >= c.s AND gap * common > 0),
sel AS (SELECT DISTINCT x.k, x.g, x.s, x.tid, x.cat FROM h x JOIN h y ON y.k = x.k AND y.g = x.g AND y.s = x.s AND y.tid = x.tid AND y.cat = x.cat AND y.d = x.d AND y.m = x.m + 1 JOIN h z ON z.k = x.k AND z.g = x.g AND z.s = x.s AND z.tid = x.tid AND z.cat = x.cat AND z.d = x.d AND z.m = x.m + 2),
mn AS (SELECT tid, cat FROM sel WHERE k = 8 AND g = 0.01 AND s = 3)"""


def swept(spark, root):
    """k, g, s, tid, cat: what each of the 45 configurations selects; and all configurations."""
    gaps = deviating(spark, root, PEERS)
    rules = F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.lit(s).alias("s")) for g in GAPS for s in SCORES)))
    each = gaps.withColumn("c", rules).select("*", "c.g", "c.s").withColumn("flag", V.flagged(F.col("g"), F.col("s"))).filter("flag")
    return V.lasting(each, ["k", "g", "s", *BY], "m")


@query("det_16_robustness_sweep", SWEEP + " SELECT c.k, c.g, c.s, count(sel.tid) AS selected, count(mn.tid) AS retained, round(CASE WHEN count(sel.tid) + (SELECT count(*) FROM mn) = 0 THEN 1 ELSE count(mn.tid) / (count(sel.tid) + (SELECT count(*) FROM mn) - count(mn.tid)) END, 9) AS jaccard FROM c LEFT JOIN sel ON sel.k = c.k AND sel.g = c.g AND sel.s = c.s LEFT JOIN mn ON mn.tid = sel.tid AND mn.cat = sel.cat GROUP BY 1, 2, 3")
def _(spark, root):
    found = swept(spark, root)
    w = Window.partitionBy(*BY)
    is_main = (F.col("k") == 8) & (F.col("g") == 0.01) & (F.col("s") == 3.0)
    per = found.withColumn("_main", F.max(is_main.cast("int")).over(w)).groupBy("k", "g", "s").agg(F.count(F.lit(1)).alias("selected"), F.sum("_main").alias("retained"))
    rules = spark.createDataFrame([(k, g, s) for k in PEERS for g in GAPS for s in SCORES], "k int, g double, s double")
    all_rules = rules.join(F.broadcast(per), ["k", "g", "s"], "left").na.fill(0, ["selected", "retained"])  # 45
    total = F.max(F.when(is_main, F.col("selected"))).over(Window.partitionBy(F.lit(0)))  # 45 rows
    union = F.col("selected") + total - F.col("retained")
    return all_rules.select("k", "g", "s", "selected", "retained", F.round(F.when(union == 0, 1.0).otherwise(F.col("retained") / F.nullif(union, F.lit(0))), 9).alias("jaccard"))


@query("det_16_descriptive_core", SWEEP + " SELECT sel.tid, sel.cat, count(*) AS configurations, round(count(*) / 45, 9) AS fraction, max(mn.tid) IS NOT NULL AS original, count(*) / 45 >= 0.8 AS core FROM sel LEFT JOIN mn ON mn.tid = sel.tid AND mn.cat = sel.cat GROUP BY 1, 2")
def _(spark, root):
    n, rules = F.count(F.lit(1)), len(PEERS) * len(GAPS) * len(SCORES)
    is_main = (F.col("k") == 8) & (F.col("g") == 0.01) & (F.col("s") == 3.0)
    return swept(spark, root).groupBy(*BY).agg(n.alias("configurations"), F.round(n / rules, 9).alias("fraction"), (F.count_if(is_main) > 0).alias("original"), (n / rules >= 0.8).alias("core"))


@query("det_17_conditional_null")
def _(spark, root):
    # quarters, as a month of these orders leaves categories without any
    quarter = F.floor(F.col("m") / 3).cast("int").alias("q")
    rows = P.sales(spark, root).groupBy("tid", "cat", quarter).agg(P.exact_sum("price").alias("value"))
    shares = rows.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy("tid", "q"))).select(*BY, "q", "share")
    first = (P.LAST + 1) // 3 - 24
    return V.null_summary(V.conditional_null(shares, near_peers(spark, root), "tid", "cat", "q", first, 8))


@query(
    "det_18_recovery",
    TOTALS + ", s AS (SELECT t.tid, t.m AS shock, a.value AS base FROM total t JOIN total a ON a.tid = t.tid AND a.m = t.m - 1 WHERE t.value < 0.6 * a.value), i AS (SELECT s.tid, s.shock, t.m, abs(t.value / s.base - 1) <= 0.1 AS inside FROM s JOIN total t ON t.tid = s.tid AND t.m > s.shock), k AS (SELECT i.tid, i.shock, min(i.m) AS back FROM i JOIN i j ON j.tid = i.tid AND j.shock = i.shock AND j.m = i.m + 1 WHERE i.inside AND j.inside GROUP BY 1, 2) SELECT s.tid, s.shock, k.back - s.shock AS months, CASE WHEN k.back IS NULL THEN 'censored' ELSE 'recovered' END AS status FROM s LEFT JOIN k ON k.tid = s.tid AND k.shock = s.shock",
)
def _(spark, root):
    t = P.totals(spark, root)
    s = t.withColumn("base", at_lag("value", 1, ["tid"])).filter("value < 0.6 * base").select("tid", F.col("m").alias("shock"), "base")
    i = s.join(t, "tid").filter("m > shock").withColumn("inside", F.abs(F.col("value") / F.col("base") - 1) <= 0.1)
    w = Window.partitionBy("tid", "shock").orderBy("m").rangeBetween(1, 1)
    i = i.withColumn("then", F.max(F.col("inside").cast("int")).over(w) == 1)
    k = i.filter("inside and then").groupBy("tid", "shock").agg(F.min("m").alias("back"))
    return s.join(k, ["tid", "shock"], "left").select("tid", "shock", (F.col("back") - F.col("shock")).alias("months"), F.when(F.col("back").isNull(), "censored").otherwise("recovered").alias("status"))


@query("det_19_story_selection", PEER + ", r AS (SELECT *, row_number() OVER (PARTITION BY sign(gap) ORDER BY round(abs(gap), 12) DESC, tid, cat, m) AS r FROM f WHERE abs(score) >= 2) SELECT tid, cat, m, CAST(sign(gap) AS DOUBLE) AS sign, round(abs(gap), 9) AS size FROM r WHERE r <= 3")
def _(spark, root):
    g = peer_gaps(spark, root).filter("abs(score) >= 2").withColumn("sign", F.signum("gap"))
    return W.top(g, ["sign"], [F.round(F.abs("gap"), 12).desc(), F.asc("tid"), F.asc("cat"), F.asc("m")], 3).select(*BY, "m", "sign", F.round(F.abs("gap"), 9).alias("size"))


@query("det_20_residual_contrast", REL + ", q AS (SELECT *, median(rel) OVER (PARTITION BY cat, m) AS med FROM r) SELECT tid, cat, m, round(100 * (rel - med), 6) AS contrast FROM q")
def _(spark, root):
    r = residuals(spark, root)
    med = r.groupBy("cat", "m").agg(F.median("rel").alias("med"))
    return r.join(med, ["cat", "m"]).select(*BY, "m", F.round(F.lit(100) * (F.col("rel") - F.col("med")), 6).alias("contrast"))


@query(
    "det_21_as_of_audit",
    "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS r FROM events) SELECT event_id, CASE WHEN r > 1 THEN 'excluded: repeated' WHEN event_type = 'error' THEN 'quarantined: unknown time' WHEN ts > TIMESTAMP '2024-01-20' THEN 'excluded: after cutoff' WHEN value < 1 THEN 'excluded: too small' ELSE 'eligible' END AS status FROM e",
)
def _(spark, root):
    from ledgerline.operators.shape import ladder

    e = tables.scan(spark, root, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id", "props").orderBy("ts", "event_id")))
    late = F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")
    status = ladder([("excluded: repeated", F.col("r") > 1), ("quarantined: unknown time", F.col("event_type") == "error"), ("excluded: after cutoff", late), ("excluded: too small", F.col("value") < 1)], "eligible")
    return e.select("event_id", status.alias("status"))
