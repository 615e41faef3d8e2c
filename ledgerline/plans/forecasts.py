"""Forecasts and their evaluation over the panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.calendar import at_lag, over_months
from ledgerline.functions.draws import draw, draw_sql
from ledgerline.operators import aggregates as A
from ledgerline.operators import forecast as FC
from ledgerline.operators import panel as P
from ledgerline.plans.registry import PANEL, TOTALS, query
from ledgerline.sources import tables

BY, H = ["tid", "cat"], 3
BASE = PANEL + """, med AS (SELECT cat, m, median(value) AS med FROM panel GROUP BY 1, 2),
b AS (SELECT p.tid, p.cat, p.m, p.value, o.value AS yo, a.value AS yt12, c.value AS yo12, mo.med AS mo, mt.med AS mt12, mq.med AS mo12 FROM panel p JOIN panel o ON o.tid = p.tid AND o.cat = p.cat AND o.m = p.m - 3
  LEFT JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 12 LEFT JOIN panel c ON c.tid = p.tid AND c.cat = p.cat AND c.m = p.m - 15
  LEFT JOIN med mo ON mo.cat = p.cat AND mo.m = p.m - 3 LEFT JOIN med mt ON mt.cat = p.cat AND mt.m = p.m - 12 LEFT JOIN med mq ON mq.cat = p.cat AND mq.m = p.m - 15)"""


def frame(spark, root):
    return FC.base(P.panel(spark, root), BY, "cat", H)


def shown(df, predicted):
    return df.select(*BY, "m", "value", F.round(predicted, 4).alias("predicted")).na.drop(subset=["predicted"])


@query("fc_01_last_value", BASE + " SELECT tid, cat, m, value, round(yo, 4) AS predicted FROM b")
def _(spark, root):
    return shown(frame(spark, root), F.col("yo"))


@query("fc_02_seasonal_naive", BASE + " SELECT tid, cat, m, value, round(yt12, 4) AS predicted FROM b WHERE yt12 IS NOT NULL")
def _(spark, root):
    return shown(frame(spark, root), F.col("yt12"))


@query("fc_03_train_mean", PANEL + " SELECT p.tid, p.cat, p.m, p.value, round(avg(q.value), 4) AS predicted FROM panel p JOIN panel q ON q.tid = p.tid AND q.cat = p.cat AND q.m <= p.m - 3 GROUP BY 1, 2, 3, 4")
def _(spark, root):
    return shown(P.panel(spark, root), FC.history_mean(BY, H))


@query("fc_04_row_history", PANEL + ", r AS (SELECT *, row_number() OVER w AS n, lag(value, 3) OVER w AS last, lag(value, 12) OVER w AS seasonal, row_number() OVER (PARTITION BY tid, cat ORDER BY m DESC) AS from_end FROM panel WINDOW w AS (PARTITION BY tid, cat ORDER BY m)) SELECT tid, cat, m, value, last, seasonal FROM r WHERE n > 12 + 3 AND from_end <= 6")
def _(spark, root):
    w = Window.partitionBy(*BY).orderBy("m")
    r = P.panel(spark, root).withColumns({"n": F.row_number().over(w), "last": F.lag("value", 3).over(w), "seasonal": F.lag("value", 12).over(w), "from_end": F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("m")))})
    return r.filter("n > 15 and from_end <= 6").select(*BY, "m", "value", "last", "seasonal")


@query("fc_05_category_seasonal", BASE + " SELECT tid, cat, m, value, round(yo * (mt12 / mo12), 4) AS predicted FROM b WHERE mt12 > 0 AND mo12 > 0")
def _(spark, root):
    return shown(frame(spark, root), F.col("yo") * FC.seasonal_ratio())


@query(
    "fc_06_balanced_prior",
    BASE + ", r AS (SELECT t.cat, t.m + 12 AS m, median(t.value) / median(o.value) AS ratio FROM panel t JOIN panel o ON o.tid = t.tid AND o.cat = t.cat AND o.m = t.m - 3 GROUP BY 1, 2) SELECT tid, b.cat, b.m, value, round(yo * ratio, 4) AS predicted FROM b JOIN r ON r.cat = b.cat AND r.m = b.m",
)
def _(spark, root):
    p = P.panel(spark, root)
    r = FC.balanced_ratio(p, BY, "cat", H)
    return shown(FC.base(p, BY, "cat", H).join(r, ["cat", "m"]), F.col("yo") * F.col("ratio"))


@query("fc_07_half_ensemble", BASE + " SELECT tid, cat, m, value, round((yo + yt12) / 2, 4) AS predicted FROM b WHERE yt12 IS NOT NULL")
def _(spark, root):
    return shown(frame(spark, root), (F.col("yo") + F.col("yt12")) / 2)


@query(
    "fc_08_growth_naive",
    PANEL + """, g AS (SELECT tid, cat, m, value, max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS y12, sum(value) OVER r AS sr, count(*) OVER r AS nr, sum(value) OVER q AS sq, count(*) OVER q AS nq,
  max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS yo, max(value) OVER (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 15 PRECEDING AND 15 PRECEDING) AS yq
  FROM panel WINDOW r AS (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 5 PRECEDING AND 3 PRECEDING), q AS (PARTITION BY tid, cat ORDER BY m RANGE BETWEEN 17 PRECEDING AND 15 PRECEDING))
SELECT tid, cat, m, value, round(y12 * yo / yq, 4) AS growth1, round(CASE WHEN nr = 3 AND nq = 3 THEN y12 * sr / sq END, 4) AS growth3 FROM g WHERE y12 * yo / yq IS NOT NULL""",
)
def _(spark, root):
    p = P.panel(spark, root).withColumns({"growth1": FC.growth(BY, H, 1), "growth3": FC.growth(BY, H, 3)})
    return p.select(*BY, "m", "value", F.round("growth1", 4).alias("growth1"), F.round("growth3", 4).alias("growth3")).na.drop(subset=["growth1"])


def smoothing_sql(rows: str, value: str) -> str:
    """CTEs that fold a table (tid, m, value), given as SQL, under every alpha: ses(tid, m, n, level, alpha)."""
    return f""", alphas AS (SELECT CAST(unnest(range(1, 20)) AS DOUBLE) / 20 AS alpha), src AS ({rows}), begun AS (SELECT tid, min(m) AS m FROM src GROUP BY 1),
fold AS (SELECT src.tid, src.m, 1 AS n, alpha, {value} AS level, 0.0::DOUBLE AS loss FROM src JOIN begun USING (tid, m) CROSS JOIN alphas
UNION ALL SELECT f.tid, f.m + 1, n + 1, alpha, level + alpha * ({value} - level), loss + abs({value} - level) FROM fold f JOIN src ON src.tid = f.tid AND src.m = f.m + 1),
ses AS (SELECT tid, m, n, first(level ORDER BY loss, alpha) AS level, first(alpha ORDER BY loss, alpha) AS alpha FROM fold GROUP BY 1, 2, 3)"""


RECURSIVE = TOTALS.replace("WITH", "WITH RECURSIVE", 1)
MED = ", med AS (SELECT m, median(value) AS med FROM total GROUP BY 1)"


@query("fc_09_ses", RECURSIVE + smoothing_sql("SELECT * FROM total", "value") + " SELECT tid, m, round(level, 4) AS level, round(alpha, 2) AS alpha FROM ses WHERE n >= 3")
def _(spark, root):
    return FC.smoothed(P.totals(spark, root), ["tid"], "value").withColumns({"level": F.round("level", 4), "alpha": F.round("alpha", 2)})


@query(
    "fc_10_conditional_ses",
    RECURSIVE + MED + smoothing_sql("SELECT tid, m, value / med AS value FROM total JOIN med USING (m)", "value")
    + " SELECT t.tid, t.m, t.value, round(s.level * mo.med * (mt.med / mq.med), 4) AS predicted FROM total t JOIN ses s ON s.tid = t.tid AND s.m = t.m - 3 AND s.n >= 13 JOIN med mo ON mo.m = t.m - 3 JOIN med mt ON mt.m = t.m - 12 JOIN med mq ON mq.m = t.m - 15 WHERE mt.med > 0 AND mq.med > 0",
)
def _(spark, root):
    return FC.conditional_ses(P.totals(spark, root).withColumn("cat", F.lit("total")), ["tid", "cat"], "cat", H).select("tid", "m", "value", F.round("predicted", 4).alias("predicted"))


@query(
    "fc_11_profile_ses",
    RECURSIVE + MED
    + """, u AS (SELECT tid, m, value, m - min(m) OVER (PARTITION BY tid) AS i, row_number() OVER (PARTITION BY tid ORDER BY m) - 1 AS r, ln(value / med) AS u FROM total JOIN med USING (m)), run AS (SELECT * FROM u WHERE i = r),
prof AS (SELECT tid, i AS k, 0.7 * (u - avg(u) OVER (PARTITION BY tid)) AS s FROM run WHERE i < 12), adj AS (SELECT run.tid, run.m, run.u - prof.s AS value FROM run JOIN prof ON prof.tid = run.tid AND prof.k = run.i % 12)"""
    + smoothing_sql("SELECT * FROM adj", "value")
    + """, g AS (SELECT run.tid, run.m, run.i, ln(a.med / b.med) AS g FROM run JOIN med a ON a.m = run.m JOIN med b ON b.m = run.m - 12 WHERE run.i >= 12), growth AS (SELECT tid, m, avg(g) OVER (PARTITION BY tid ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS g FROM g)
SELECT run.tid, run.m, run.value, round(exp(s.level + prof.s + growth.g) * b.med, 4) AS predicted FROM run JOIN ses s ON s.tid = run.tid AND s.m = run.m - 3 JOIN growth ON growth.tid = run.tid AND growth.m = run.m - 3 JOIN prof ON prof.tid = run.tid AND prof.k = run.i % 12 JOIN med b ON b.m = run.m - 12""",
)
def _(spark, root):
    return FC.profile_ses(P.totals(spark, root).withColumn("cat", F.lit("total")), ["tid", "cat"], "cat", H).select("tid", "m", "value", F.round("predicted", 4).alias("predicted"))


NATIONAL = BASE + ", nat AS (SELECT m, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS n FROM panel GROUP BY 1)"


def national(spark, root):
    return P.panel(spark, root).groupBy("m").agg(P.exact_sum("value").alias("n"))


@query("fc_12_national_yoy", NATIONAL + " SELECT b.tid, b.cat, b.m, b.value, round(b.yt12 * x.n / y.n, 4) AS predicted FROM b JOIN nat x ON x.m = b.m - 5 JOIN nat y ON y.m = b.m - 17 WHERE yt12 IS NOT NULL")
def _(spark, root):
    n = national(spark, root)
    x, y = n.select((F.col("m") + 5).alias("m"), F.col("n").alias("nx")), n.select((F.col("m") + 17).alias("m"), F.col("n").alias("ny"))
    return shown(frame(spark, root).join(F.broadcast(x), "m").join(F.broadcast(y), "m"), F.col("yt12") * F.col("nx") / F.col("ny"))  # one row a month


@query("fc_13_extrapolated_national", NATIONAL + " SELECT a.m, round(b.n * (c.n / d.n), 2) AS path FROM nat a JOIN nat b ON b.m = a.m - 12 JOIN nat c ON c.m = a.m - 3 JOIN nat d ON d.m = a.m - 15")
def _(spark, root):
    n = national(spark, root)
    j = n.select("m")
    for name, k in (("b", 12), ("c", 3), ("d", 15)):
        j = j.join(n.select((F.col("m") + k).alias("m"), F.col("n").alias(name)), "m")
    return j.select("m", F.round(F.col("b") * (F.col("c") / F.col("d")), 2).alias("path"))


@query("fc_14_own_seasonal_growth", BASE + " SELECT tid, cat, m, value, round(yt12 * yo / yo12, 4) AS predicted FROM b WHERE yt12 * yo / yo12 IS NOT NULL")
def _(spark, root):
    return shown(frame(spark, root), F.col("yt12") * F.col("yo") / F.col("yo12"))


@query("fc_15_causal_residual", PANEL + " SELECT p.tid, p.cat, p.m, round((p.value - a.value) / greatest(abs(a.value), 1e-9), 9) AS rel FROM panel p JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1")
def _(spark, root):
    p = P.panel(spark, root).withColumn("b", at_lag("value", 1, BY)).na.drop(subset=["b"])
    return p.select(*BY, "m", F.round((F.col("value") - F.col("b")) / F.greatest(F.abs("b"), F.lit(1e-9)), 9).alias("rel"))


@query(
    "fc_16_past_only_selection",
    BASE + """, l AS (SELECT m - 3 AS origin, m, value, yo AS last, yt12 AS seasonal FROM b WHERE yt12 IS NOT NULL), u AS (SELECT 'last' AS model, m, abs(value - last) AS e FROM l UNION ALL SELECT 'seasonal', m, abs(value - seasonal) FROM l),
k AS (SELECT o.origin, u.model, avg(e) AS mae FROM (SELECT DISTINCT origin FROM l) o LEFT JOIN u ON u.m < o.origin GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY mae NULLS LAST, model) AS r FROM k)
SELECT origin, coalesce(max(model) FILTER (WHERE r = 1), 'last') AS "first", coalesce(max(model) FILTER (WHERE r = 2), 'last') AS "second" FROM r GROUP BY 1""",
)
def _(spark, root):
    ledger = frame(spark, root).na.drop(subset=["yt12"]).select((F.col("m") - H).alias("origin"), "m", "value", F.col("yo").alias("last"), F.col("yt12").alias("seasonal"))
    return FC.select_past_best(ledger, ["last", "seasonal"], "last")


def features(spark, root):
    f = frame(spark, root).na.drop(subset=["yt12", "yo12"])
    return f.withColumns({"f1": F.ln(F.col("yt12") / F.col("yo12")), "f2": F.ln(F.col("mt12") / F.col("mo12")), "f3": F.ln(F.col("yo") / F.col("yo12"))})


@query("fc_17_ridge_correction")
def _(spark, root):
    return FC.ridge_correction(features(spark, root), ["f1", "f2", "f3"], "yo", 23980).select(*BY, "m", "value", "yo", "corrected")


@query("fc_18_weighted_ridge")
def _(spark, root):
    rows = features(spark, root).withColumns({"w": 1 / F.count(F.lit(1)).over(Window.partitionBy("m")), "y": F.ln(F.col("value") / F.col("yo"))})
    names = ["f1", "f2", "f3"]
    beta = FC.ridge(rows.filter("m <= 23980"), names, "y", 0.1, "w")
    return rows.filter("m > 23980").select(*BY, "m", "value", (F.col("yo") * F.exp(FC.linear(beta, names))).alias("predicted"))


@query("fc_19_boosted_trees")
def _(spark, root):
    return FC.boosted(features(spark, root), ["yo", "yt12", "yo12", "mo"], 23980).select(*BY, "m", "value", "predicted")


@query("fc_20_hinged_trend")
def _(spark, root):
    return FC.trend(P.totals(spark, root), ["tid"], H)


def last_year_median(contexts, h, seed):
    """Stands where a pretrained model would be: the median of a context's last twelve values."""
    return [float(sorted(c[-12:])[5] + sorted(c[-12:])[6]) / 2 for c in contexts]


@query("fc_21_batched_inference", TOTALS + ", r AS (SELECT a.tid, a.m, a.value, b.value AS v, row_number() OVER (PARTITION BY a.tid, a.m ORDER BY b.m DESC) AS k FROM total a JOIN total b ON b.tid = a.tid AND b.m <= a.m - 3) SELECT tid, m, value, round(median(v), 4) AS predicted FROM r WHERE k <= 12 GROUP BY 1, 2, 3 HAVING count(*) = 12")
def _(spark, root):
    out = FC.batched(P.totals(spark, root), ["tid"], H, last_year_median)
    return out.select("tid", "m", "value", F.round("predicted", 4).alias("predicted"))


@query("fc_22_expanding_grid", PANEL + ", h AS (SELECT unnest([1, 3, 6, 12]) AS h) SELECT h.h, p.m AS target, p.m - h.h AS origin, count(*) AS n, round(avg(abs(p.value - o.value)), 4) AS mae FROM panel p CROSS JOIN h JOIN panel o ON o.tid = p.tid AND o.cat = p.cat AND o.m = p.m - h.h GROUP BY 1, 2, 3")
def _(spark, root):
    p = P.panel(spark, root).withColumns({f"o{h}": at_lag("value", h, BY) for h in (1, 3, 6, 12)})
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"o{h}").alias("o")) for h in (1, 3, 6, 12))))
    rows = p.select("m", "value", each.alias("x")).filter("x.o is not null").select("value", "x.*", F.col("m").alias("target"), (F.col("m") - F.col("x.h")).alias("origin"))
    return rows.groupBy("h", "target", "origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("value") - F.col("o"))), 4).alias("mae"))


def paired(spark, root):
    f = frame(spark, root).na.drop(subset=["yt12"])
    return f.select(*BY, "m", F.abs(F.col("value") - F.col("yo")).alias("a"), F.abs(F.col("value") - F.col("yt12")).alias("b"))


@query("fc_23_block_bootstrap")
def _(spark, root):
    return FC.block_bootstrap(paired(spark, root), "m", "a", "b")


@query("fc_24_lagged_macro", NATIONAL + " SELECT b.tid, b.cat, b.m, round(ln(x.n), 9) AS level, round(ln(x.n) - ln(y.n), 9) AS change FROM b JOIN nat x ON x.m = b.m - 3 - 2 JOIN nat y ON y.m = b.m - 3 - 3")
def _(spark, root):
    n = national(spark, root)
    x, y = n.select((F.col("m") + 5).alias("m"), F.ln("n").alias("lx")), n.select((F.col("m") + 6).alias("m"), F.ln("n").alias("ly"))
    j = frame(spark, root).join(F.broadcast(x), "m").join(F.broadcast(y), "m")  # one row a month
    return j.select(*BY, "m", F.round("lx", 9).alias("level"), F.round(F.col("lx") - F.col("ly"), 9).alias("change"))


@query(
    "fc_25_event_features",
    "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), e AS (SELECT user_id, CAST(ts AS DATE) AS day, value > 10 AS verified FROM events WHERE event_type = 'error') SELECT d.user_id, d.day, count(e.day) FILTER (WHERE e.day BETWEEN d.day - 3 AND d.day - 1) AS after_publication, count(e.day) FILTER (WHERE verified AND e.day BETWEEN d.day - 3 AND d.day - 1) AS strict, count(e.day) FILTER (WHERE e.day BETWEEN d.day - 4 AND d.day - 2) AS delayed FROM d LEFT JOIN e ON e.user_id = d.user_id GROUP BY 1, 2",
)
def _(spark, root):
    e = tables.scan(spark, root, "events").withColumn("day", F.to_date("ts"))
    per = e.groupBy("user_id", F.datediff("day", F.lit("2024-01-01")).alias("k"), "day").agg(F.count_if(F.col("event_type") == "error").alias("n"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 10)).alias("s"))
    total = lambda c, a, b: F.coalesce(F.sum(c).over(over_months(["user_id"], -a, -b, "k")), F.lit(0))
    return per.select("user_id", "day", total("n", 3, 1).alias("after_publication"), total("s", 3, 1).alias("strict"), total("n", 4, 2).alias("delayed"))


@query(
    "fc_26_lag_sensitivity",
    PANEL + ", l AS (SELECT p.tid, p.cat, p.m, p.value, a.value AS l1, b.value AS l2, c.value AS l3 FROM panel p LEFT JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 1 LEFT JOIN panel b ON b.tid = p.tid AND b.cat = p.cat AND b.m = p.m - 2 LEFT JOIN panel c ON c.tid = p.tid AND c.cat = p.cat AND c.m = p.m - 3) "
    + " UNION ALL ".join(f"SELECT {k} AS lag, count(l{k}) AS n, round(avg(abs(value - l{k})), 4) AS mae, count(l{k}) FILTER (WHERE l1 + l2 + l3 IS NOT NULL) AS n_common, round(avg(abs(value - l{k})) FILTER (WHERE l1 + l2 + l3 IS NOT NULL), 4) AS mae_common FROM l" for k in (1, 2, 3)),
)
def _(spark, root):
    p = P.panel(spark, root).withColumns({f"l{k}": at_lag("value", k, BY) for k in (1, 2, 3)})
    p = p.withColumn("whole", F.col("l1").isNotNull() & F.col("l2").isNotNull() & F.col("l3").isNotNull())
    long = p.select("value", "whole", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("y")) for k in (1, 2, 3)))).alias("x")).select("value", "whole", "x.*").na.drop(subset=["y"])
    e = F.abs(F.col("value") - F.col("y"))
    return long.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(e), 4).alias("mae"), F.count_if("whole").alias("n_common"), F.round(F.avg(F.when(F.col("whole"), e)), 4).alias("mae_common"))


CONTROLS = (1, 2, 3, 6)


@query(
    "fc_27_negative_control",
    BASE
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY tid, cat ORDER BY m) AS i, row_number() OVER (PARTITION BY tid, cat ORDER BY {draw_sql("tid", "cat", "m", seed=17)}, m) AS j FROM b), d AS (SELECT x.tid, x.cat, x.m, x.value, x.yo, y.yo AS dealt FROM o x JOIN o y ON y.tid = x.tid AND y.cat = x.cat AND y.j = x.i)
SELECT 'last value' AS control, count(*) AS n, round(avg(abs(value - yo)), 4) AS mae, 'valid' AS status FROM d UNION ALL SELECT 'labels dealt anew within each series', count(*), round(avg(abs(value - dealt)), 4), 'control' FROM d UNION ALL SELECT 'the target itself', count(*), 0, 'quarantined: leakage' FROM d """
    + " ".join(f"UNION ALL SELECT 'published {k} months later', count(*), round(avg(abs(p.value - q.value)), 4), 'control' FROM panel p JOIN panel q ON q.tid = p.tid AND q.cat = p.cat AND q.m = p.m - {3 + k}" for k in CONTROLS),
)
def _(spark, root):
    p = P.panel(spark, root).withColumns({f"later{k}": at_lag("value", H + k, BY) for k in (0, *CONTROLS)})
    w = Window.partitionBy(*BY)
    f = p.filter("later0 is not null")
    dealt = f.withColumn("i", F.row_number().over(w.orderBy("m"))).join(f.select(*BY, F.row_number().over(w.orderBy(draw("tid", "cat", "m", seed=17), "m")).alias("i"), F.col("later0").alias("dealt")), [*BY, "i"])
    dealt = dealt.withColumns({"last value": F.col("later0"), "labels dealt anew within each series": F.col("dealt"), "the target itself": F.col("value")})
    names = ["last value", "labels dealt anew within each series", "the target itself"]
    later = p.withColumnsRenamed({f"later{k}": f"published {k} months later" for k in CONTROLS})
    rows = dealt.unpivot("value", names, "control", "predicted").unionByName(later.unpivot("value", [f"published {k} months later" for k in CONTROLS], "control", "predicted")).na.drop(subset=["predicted"])
    status = F.when(F.col("control") == names[0], "valid").when(F.col("control") == names[2], "quarantined: leakage").otherwise("control")
    return rows.groupBy("control").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("value") - F.col("predicted"))), 4).alias("mae")).withColumn("status", status)


@query(
    "fc_28_conditional_median3",
    BASE + ", z AS (SELECT p.tid, p.cat, p.m, p.value / med.med AS z FROM panel p JOIN med ON med.cat = p.cat AND med.m = p.m), s AS (SELECT b.tid, b.cat, b.m, median(z.z) AS z, count(*) AS n FROM b JOIN z ON z.tid = b.tid AND z.cat = b.cat AND z.m BETWEEN b.m - 5 AND b.m - 3 GROUP BY 1, 2, 3) SELECT b.tid, b.cat, b.m, b.value, round(s.z * mo * (mt12 / mo12), 4) AS predicted FROM b JOIN s ON s.tid = b.tid AND s.cat = b.cat AND s.m = b.m WHERE n = 3 AND mt12 > 0 AND mo12 > 0",
)
def _(spark, root):
    p = P.panel(spark, root)
    med = p.groupBy("cat", "m").agg(F.median("value").alias("_med"))
    z = p.join(med, ["cat", "m"]).select(*BY, "m", (F.col("value") / F.col("_med")).alias("z"))
    at = [at_lag("z", k, BY).alias(f"z{k}") for k in (3, 4, 5)]
    three = z.select(*BY, "m", F.sort_array(F.array(*at))[1].alias("z"), F.size(F.array_compact(F.array(*at))).alias("n")).filter("n = 3").drop("n")
    return shown(FC.base(p, BY, "cat", H).join(three, [*BY, "m"]), F.col("z") * F.col("mo") * FC.seasonal_ratio())


@query("fc_29_conditional_trend")
def _(spark, root):
    t = P.totals(spark, root)
    med = t.groupBy("m").agg(F.median("value").alias("med"))
    z = t.join(med, "m").withColumn("value", F.col("value") / F.col("med")).drop("med")
    at = med.select((F.col("m") + H).alias("m"), "med")
    return FC.trend(z, ["tid"], H).join(at, "m").select("tid", "m", (F.col("predicted") * F.col("med")).alias("predicted"))


@query("fc_30_ledger_validation", BASE + " SELECT count(*) AS n, 0::BIGINT AS wrong_horizon, 0::BIGINT AS not_finite, count(*) - count(DISTINCT (tid, cat, m)) AS repeated FROM b")
def _(spark, root):
    ledger = frame(spark, root).withColumns({"origin": F.col("m") - H, "horizon": F.lit(H)})
    bad = F.col("origin") + F.col("horizon") != F.col("m")
    return ledger.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("wrong_horizon"), F.count_if(~P.finite("value", "yo")).alias("not_finite"), (F.count(F.lit(1)) - F.count_distinct(*BY, "m")).alias("repeated"))


@query("fc_31_paired_intervals")
def _(spark, root):
    return FC.block_bootstrap(paired(spark, root), "tid", "a", "b")


@query("fc_32_task_ledger", PANEL + ", s AS (SELECT tid, cat, m AS origin, count(*) OVER (PARTITION BY tid, cat ORDER BY m ROWS UNBOUNDED PRECEDING) AS history FROM panel) SELECT tid, cat, origin, history, CASE WHEN history < 24 THEN 'short history' ELSE 'fitted' END AS status FROM s")
def _(spark, root):
    return FC.fit_ledger(P.panel(spark, root), BY, H, least=24).select(*BY, "origin", "history", "status")


MAIN = TOTALS + """, f AS (SELECT t.tid, t.m, t.value, o.value AS last, s.value AS seasonal FROM total t JOIN total o ON o.tid = t.tid AND o.m = t.m - 1 JOIN total s ON s.tid = t.tid AND s.m = t.m - 12)
SELECT 'last' AS model, count(*) AS n, round(avg(abs(value - last)), 4) AS mae, round(sqrt(avg((value - last) ^ 2)), 4) AS rmse FROM f UNION ALL SELECT 'seasonal', count(*), round(avg(abs(value - seasonal)), 4), round(sqrt(avg((value - seasonal) ^ 2)), 4) FROM f"""


@query("panel_forecast_comparison", MAIN)
def _(spark, root):
    t = P.totals(spark, root).withColumns({"last": at_lag("value", 1, ["tid"]), "seasonal": at_lag("value", 12, ["tid"])})
    return A.losses(t, "value", ["last", "seasonal"]).select("model", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))
