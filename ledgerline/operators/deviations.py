"""How far a unit moves from its peers and from all others, and how often that happens by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.draws import draw
from ledgerline.operators.aggregates import leave_one_out_median
from ledgerline.operators.windows import persistent_same_sign


def array_median(x: Column) -> Column:
    s = F.sort_array(x)
    at = lambda i: F.get(s, F.floor(i).cast("int"))
    return (at((F.size(x) - 1) / 2) + at(F.size(x) / 2)) / 2


def ranked_peers(near: DataFrame, entity: str) -> DataFrame:
    """entity, peer, rank of neighbours (entity, peer, d)."""
    return near.select(entity, "peer", F.row_number().over(Window.partitionBy(entity).orderBy("d", "peer")).alias("rank"))


def from_peers(changes: DataFrame, peers: DataFrame, entity: str, by: list[str], month: str, value: str, sizes: list[int], least: int = 5, floor: float = 0.0025) -> DataFrame:
    """entity, by, month, k, gap, score, common: for each k of sizes the gap to the median of the k nearest peers that have the month.

    score is the gap over the scaled median absolute deviation of those peers, no less than floor;
    common is the gap to the median of all others. Rows with fewer than least such peers are left
    out. A row meets at most max(sizes) peers.
    """
    other = changes.select(F.col(entity).alias("peer"), *by, month, F.col(value).alias("_v"))
    met = peers.filter(F.col("rank") <= max(sizes)).join(other, "peer").groupBy(entity, *by, month).agg(F.collect_list(F.struct("rank", "_v")).alias("_peers"))
    own = leave_one_out_median(changes.select(entity, *by, month, value), [*by, month], value, entity)
    each = own.join(met, [entity, *by, month]).withColumn("k", F.explode(F.array(*(F.lit(k) for k in sizes))))
    each = each.withColumn("_near", F.transform(F.filter("_peers", lambda p: p["rank"] <= F.col("k")), lambda p: p["_v"])).filter(F.size("_near") >= least)
    each = each.withColumn("_med", array_median(F.col("_near")))
    each = each.withColumn("_mad", array_median(F.transform("_near", lambda v: F.abs(v - F.col("_med")))))
    gap = F.col(value) - F.col("_med")
    return each.select(entity, *by, month, "k", gap.alias("gap"), (gap / F.greatest(F.lit(1.4826) * F.col("_mad"), F.lit(floor))).alias("score"), (F.col(value) - F.col("loo")).alias("common"))


def flagged(gap: float | Column, score: float | Column) -> Column:
    """Far enough from the peers, and on the same side of all others."""
    return (F.abs("gap") >= gap) & (F.abs("score") >= score) & (F.col("gap") * F.col("common") > 0)


def lasting(flags: DataFrame, by: list[str], month: str) -> DataFrame:
    """by: the groups with a flag and a gap of one sign in three months on end."""
    kept = flags.withColumn("_kept", persistent_same_sign("flag", "gap", by, 3, month))
    return kept.filter("_kept").select(*by).distinct()


def _logit(x: Column) -> Column:
    return F.ln(x / (1 - x))


def conditional_null(shares: DataFrame, peers: DataFrame, entity: str, cat: str, month: str, first: int, k: int, draws: int = 100, seed: int = 23, year: int = 12, block: int = 3, gap: float = 0.01, score: float = 3.0) -> DataFrame:
    """draw, n: how many (entity, cat) are flagged for long when the second year is made anew.

    shares (entity, cat, month, share) are known for `year` months from first and as many after.
    The made year is the first one's share plus the median change of all entities, moved on the
    logit scale by noise: blocks of `block` month-to-month innovations of the first year, each
    entity's own around its mean and less the median of all, summed up. The months drawn are
    those of the draw, the same for all entities. Draw -1 has no noise, draw -2 is what was
    observed. Entities without all months, or with a made share outside (0, 1), are left out.
    """
    rows = shares.filter((F.col(month) >= first) & (F.col(month) < first + 2 * year))
    cats = rows.agg(F.count_distinct(cat)).first()[0]
    whole = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 2 * year * cats)
    rows = rows.join(whole.select(entity), entity, "left_semi")
    at = F.pmod(F.col(month) - first, F.lit(year)).cast("int")
    paired = rows.groupBy(entity, cat, at.alias("j")).agg(F.min_by("share", month).alias("before"), F.max_by("share", month).alias("after"))
    of_all = paired.groupBy(cat, "j").agg(F.median(F.col("after") - F.col("before")).alias("shift"), F.median(_logit(F.col("before"))).alias("level"))
    paired = paired.join(F.broadcast(of_all), [cat, "j"]).withColumn("base", F.col("before") + F.col("shift"))  # categories x months
    good = paired.groupBy(entity).agg(F.min("base").alias("low"), F.max("base").alias("high")).filter("low > 0 and high < 1")
    paired = paired.join(good.select(entity), entity, "left_semi")
    series = paired.groupBy(entity, cat).agg(F.array_sort(F.collect_list(F.struct("j", "before", "after", _logit(F.col("base")).alias("b"), (_logit(F.col("before")) - F.col("level")).alias("u")))).alias("s"))  # a year
    steps = F.transform(F.sequence(F.lit(0), F.lit(year - 2)), lambda i: F.get("s", i + 1)["u"] - F.get("s", i)["u"])
    mean = F.aggregate("_steps", F.lit(0.0), lambda a, v: a + v) / F.lit(float(year - 1))
    series = series.withColumn("_steps", steps).withColumn("_steps", F.transform("_steps", lambda v: v - mean))
    blocks = -(-year // block)
    each = series.withColumn("draw", F.explode(F.sequence(F.lit(-2), F.lit(draws - 1))))
    starts = F.array(*(F.pmod(draw("draw", F.lit(b), seed=seed), F.lit(year - 1)) for b in range(blocks)))
    each = each.withColumn("_starts", starts)
    picked = F.transform(F.sequence(F.lit(0), F.lit(year - 1)), lambda j: F.get("_steps", F.pmod(F.get("_starts", F.floor(j / block).cast("int")) + j % block, F.lit(year - 1)).cast("int")))
    moved = F.aggregate(picked, F.array(F.lit(0.0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    each = each.withColumn("_moved", moved).select("draw", entity, cat, "_moved", F.posexplode("s").alias("j", "x"))
    noise = F.when(F.col("draw") == -1, 0.0).otherwise(F.get("_moved", F.col("j") + 1))
    made = 1 / (1 + F.exp(-(F.col("x.b") + noise)))
    change = F.when(F.col("draw") == -2, F.col("x.after")).otherwise(made) - F.col("x.before")
    changes = each.select("draw", entity, cat, F.col("j").alias("_m"), change.alias("change"))
    gaps = from_peers(changes, peers, entity, ["draw", cat], "_m", "change", [k])
    kept = lasting(gaps.withColumn("flag", flagged(gap, score)), ["draw", entity, cat], "_m")
    found = kept.groupBy("draw").agg(F.count(F.lit(1)).alias("n"))
    all_draws = changes.sparkSession.range(-2, draws).select(F.col("id").cast("int").alias("draw"))
    return all_draws.join(found, "draw", "left").select("draw", F.coalesce("n", F.lit(0)).alias("n"))


def null_summary(counts: DataFrame) -> DataFrame:
    """One row of conditional_null(): observed, without_noise, mean, low, median, high."""
    made = F.when(F.col("draw") >= 0, F.col("n"))
    q = lambda p: F.percentile(made, F.lit(p))
    only = lambda d: F.max(F.when(F.col("draw") == d, F.col("n")))
    return counts.agg(only(-2).alias("observed"), only(-1).alias("without_noise"), F.avg(made).alias("mean"), q(0.025).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"))
