"""A small table-function surface: named tools with declared parameters; callers pass neither SQL nor paths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import normalise, stats
from ledgerline.functions.calendar import at_lag
from ledgerline.functions.text import allowed_url, code11, collapse, surrogate
from ledgerline.operators import aggregates as A
from ledgerline.operators import cluster as C
from ledgerline.operators import panel as P
from ledgerline.operators.forecast import history_mean
from ledgerline.operators.joins import squared_distance
from ledgerline.operators.sets import coverage
from ledgerline.sources import tables
from ledgerline.sources.durable import written

#: Rows of an answer at most, and rows that a tool may work on unless the caller allows more.
MAX_ROWS, ROW_BUDGET = 200, 750_000


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    required: dict[str, type]
    optional: dict[str, type] = field(default_factory=dict)


def _limited(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows, each with how many there were and whether some are missing."""
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit: 1 to {MAX_ROWS}")
    return tables.report(df, order, limit)


def _read(spark: SparkSession, root: str, dataset: str, columns: list[str], filters: dict | None, budget: int) -> DataFrame:
    return tables.guarded(tables.select(spark, root, dataset, columns, filters), budget)


def _describe(spark: SparkSession, root: str, dataset: str = "") -> DataFrame:
    return tables.catalog(spark, root, (dataset,) if dataset else tables.NAMES)


def _rows(spark: SparkSession, root: str, dataset: str, columns: list, filters: dict | None = None, limit: int = MAX_ROWS) -> DataFrame:
    return _limited(tables.select(spark, root, dataset, columns, filters), columns, limit)


#: Names of normalisers and what they make of a value within a group.
NORMALISERS: dict[str, Callable] = {
    "z_score": normalise.z_score,
    "min_max": normalise.min_max,
    "mean_index": normalise.mean_index,
    "log1p": lambda value, by: normalise.log1p_guarded(value),
}


def _normalise(spark: SparkSession, root: str, dataset: str, value: str, method: str, group_by: list | None = None, filters: dict | None = None, limit: int = MAX_ROWS, budget: int = ROW_BUDGET) -> DataFrame:
    if method not in (*NORMALISERS, "robust_z"):
        raise ValueError(f"unknown method: {method!r}")
    by = list(group_by or [])
    df = _read(spark, root, dataset, [*by, value], filters, budget).na.drop(subset=[value])
    keys = by or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(0))  # budget rows at most
    out = stats.robust_z(df, value, keys).withColumnRenamed("z", "normalised") if method == "robust_z" else df.withColumn("normalised", NORMALISERS[method](value, keys))
    return _limited(out.select(*by, value, "normalised"), [*by, value, "normalised"], limit)


def _metric(spark: SparkSession, root: str, dataset: str, metric: str, value: str, group_by: list, filters: dict | None = None, time: str = "", lag: int = 12, threshold: float = 3.5, limit: int = MAX_ROWS, budget: int = ROW_BUDGET) -> DataFrame:
    simple = {
        "mean": lambda: F.avg(value), "sum": lambda: F.sum(value), "count": lambda: F.count(value), "median": lambda: F.median(value),
        "variation": lambda: stats.variation(value), "hhi": lambda: stats.hhi(value), "gini": lambda: stats.gini(value, "rank"),
    }
    ordered = {"trend": lambda: stats.slope("_t", value), "autocorrelation": lambda: F.corr(value, "_lag"), "seasonal_mae": lambda: F.avg(F.abs(F.col(value) - F.col("_lag")))}
    if metric not in (*simple, *ordered, "theil", "outlier_share"):
        raise ValueError(f"unknown metric: {metric!r}")
    if metric in ordered and not time:
        raise ValueError(f"{metric}: time is needed")
    df = _read(spark, root, dataset, [*group_by, value, *([time] if time else [])], filters, budget)
    if metric == "gini":
        df = A.ranked(df, group_by, value)
    if metric in ordered:
        w = Window.partitionBy(*group_by).orderBy(time)
        df = df.withColumns({"_t": F.row_number().over(w) - 1, "_lag": F.lag(value, lag).over(w)})
    if metric == "theil":
        mean = df.groupBy(*group_by).agg(F.avg(value).alias("_mean"))
        share = F.col(value) / F.nullif("_mean", F.lit(0.0))
        df = df.join(mean, group_by).withColumn("_part", F.when(F.col(value) == 0, 0.0).otherwise(share * F.ln(share)))
    if metric == "outlier_share":
        df = stats.robust_z(df, value, group_by).withColumn("_part", (F.abs("z") > threshold).cast("int"))
    made = F.avg("_part") if metric in ("theil", "outlier_share") else (simple | ordered)[metric]()
    out = df.groupBy(*group_by).agg(made.alias("metric"), F.count(F.lit(1)).alias("n"))
    return _limited(out, group_by, limit)


def _moran(spark: SparkSession, root: str, dataset: str, key: str, value: str, vector: str, neighbours: int = 8, permutations: int = 99, filters: dict | None = None, budget: int = ROW_BUDGET) -> DataFrame:
    from ledgerline.operators.neighbours import nearest_vectors
    from ledgerline.operators.network import moran_null

    if not 2 <= neighbours <= 20 or not 0 <= permutations <= 199:
        raise ValueError("neighbours: 2 to 20, permutations: 0 to 199")
    df = _read(spark, root, dataset, [key, value, vector], filters, budget)
    near = nearest_vectors(df, key, vector, neighbours).select("node", "other", "d")
    out = C.moran(df, near, key, value).withColumn("p", F.lit(None).cast("double")) if permutations == 0 else moran_null(df.select(key, value), near, key, value, permutations).select(F.col("observed").alias("moran"), "p")
    return out.withColumn("permutations", F.lit(permutations))


def _cluster(spark: SparkSession, root: str, dataset: str, key: str, vector: str, method: str = "k_means", k: int = 5, seed: int = 5, filters: dict | None = None, budget: int = ROW_BUDGET) -> DataFrame:
    if method not in ("k_means", "ward") or not 2 <= k <= 20:
        raise ValueError("method: k_means or ward; k: 2 to 20")
    df = _read(spark, root, dataset, [key, vector], filters, budget)
    labels = written(C.k_means(df, key, vector, k, seed) if method == "k_means" else C.linkage_labels(df, key, vector, k, "ward"))
    rows = df.join(labels, key)
    mean = C.silhouette(rows, key, "label", vector).groupBy("label").agg(F.avg("s").alias("silhouette"))
    centre = C.centroids(rows, "label", vector)
    within = rows.join(F.broadcast(centre), "label").groupBy("label").agg(F.sum(squared_distance(C.as_double(vector), F.col("centre"))).alias("within"))  # clusters
    return centre.join(within, "label").join(mean, "label").select("label", "n", "centre", "within", "silhouette")


def _forecast(spark: SparkSession, root: str, horizon: int = 1, budget: int = ROW_BUDGET) -> DataFrame:
    """model, n, mae, mae_macro of last value, seasonal naive and mean of the past over the rows that all of them have."""
    if not 1 <= horizon <= 3:
        raise ValueError("horizon: 1 to 3")
    by = ["tid", "cat"]
    rows = tables.guarded(P.panel(spark, root), budget).withColumns({"last": at_lag("value", horizon, by), "seasonal": at_lag("value", 12, by), "mean": history_mean(by, horizon)}).na.drop()
    long = rows.unpivot([*by, "value"], ["last", "seasonal", "mean"], "model", "predicted").withColumn("e", F.abs(F.col("value") - F.col("predicted")))
    per = long.groupBy("model", *by).agg(F.sum("e").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("model").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mae"), F.avg(F.col("s") / F.col("n")).alias("mae_macro"))


def _crosswalk(spark: SparkSession, root: str) -> DataFrame:
    """One row: how many of the panel's entities are in the register of entities, and the first that aren't."""
    panel = tables.scan(spark, root, "customer").select(F.col("c_nationkey").alias("key")).distinct()
    known = tables.scan(spark, root, "nation").select(F.col("n_nationkey").alias("key"))
    return coverage(panel, known, ["key"])


#: Where public channels live, by platform.
CHANNEL_HOSTS = {"telegram": ["t.me", "telegram.me"], "max": ["max.ru"]}
PRECISIONS = ("building", "street", "settlement", "municipality_centroid")


def channel_records(rows: DataFrame) -> DataFrame:
    """rows with channel_id, oktmo11, public_url, relation and problem: normalised records of public channels; nothing is stored.

    rows: label, platform, public_url, channel_kind, officiality, oktmo, latitude, longitude,
    geocode_precision, checked_at. The id is a hash of platform and address, so one channel has one id;
    problem names the first thing that is wrong, and such a row has no id and no relation.
    """
    url = F.regexp_replace(F.regexp_replace(F.trim("public_url"), "[?#].*$", ""), "/+$", "")
    url = F.when(url.rlike("^[a-z]+://"), url).otherwise(F.concat(F.lit("https://"), url))
    problem = F.when(F.coalesce(F.length(F.trim("label")), F.lit(0)) == 0, "no label").when(~F.coalesce(F.col("platform").isin(list(CHANNEL_HOSTS)), F.lit(False)), "platform")
    for platform, hosts in CHANNEL_HOSTS.items():
        problem = problem.when((F.col("platform") == platform) & ~allowed_url(url, ["https"], hosts), "address")
    code = code11(F.col("oktmo"))
    problem = problem.when(F.length(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))) < 2, "address").when(~F.coalesce(F.col("channel_kind").isin("channel", "chat"), F.lit(False)), "kind")
    problem = problem.when(~F.coalesce(F.col("officiality").isin("confirmed", "candidate", "unverified"), F.lit(False)), "officiality").when(code.isNull(), "territory code")
    problem = problem.when(~F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False)), "coordinates").when(~F.coalesce(F.col("geocode_precision").isin(*PRECISIONS), F.lit(False)), "precision")
    problem = problem.when(F.coalesce(F.try_to_timestamp("checked_at"), F.lit(None)).isNull(), "time of check")
    out = rows.withColumns({"problem": problem, "public_url": url, "oktmo11": code})
    good = F.col("problem").isNull()
    return out.withColumns({"label": collapse(F.col("label")), "channel_id": F.when(good, surrogate(F.col("platform"), F.lower("public_url"))), "relation": F.when(good, F.concat(F.lit("SERVES_TERRITORY:"), F.col("oktmo11")))})


def _channel(spark: SparkSession, root: str, record: dict) -> DataFrame:
    texts = ("label", "platform", "public_url", "channel_kind", "officiality", "oktmo", "geocode_precision", "checked_at")
    if unknown := set(record) - {*texts, "latitude", "longitude"}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    row = [(*(None if record.get(t) is None else str(record[t]) for t in texts), *(None if record.get(c) is None else float(record[c]) for c in ("latitude", "longitude")))]
    return channel_records(spark.createDataFrame(row, ", ".join(f"{t} string" for t in texts) + ", latitude double, longitude double"))


def forecast_user(rows: DataFrame, horizon: int = 3, least: int = 12, last: int = 6) -> DataFrame:
    """territory_id, category, n, mae_last, mae_seasonal of a user's table (territory_id, category, date, value).

    Row-lag baselines over each series' last rows, for series with enough of a history.
    """
    by = ["territory_id", "category"]
    w = Window.partitionBy(*by).orderBy("date")
    r = rows.withColumns({"_n": F.row_number().over(w), "_last": F.lag("value", horizon).over(w), "_seasonal": F.lag("value", 12).over(w), "_end": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))})
    e = lambda c: F.avg(F.abs(F.col("value") - F.col(c)))
    return r.filter((F.col("_n") > least + horizon) & (F.col("_end") <= last)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), e("_last").alias("mae_last"), e("_seasonal").alias("mae_seasonal"))


def cluster_user(rows: DataFrame, k: int, seed: int = 5, method: str = "k_means") -> DataFrame:
    """territory_id, label of a user's table by mean value per category; a category without rows counts as zero, here alone."""
    if not 2 <= k <= 20 or method not in ("k_means", "ward"):
        raise ValueError("k: 2 to 20; method: k_means or ward")
    names = sorted(r["category"] for r in rows.select("category").distinct().limit(tables.MAX_VALUES + 1).collect())
    if len(names) > tables.MAX_VALUES:
        raise ValueError(f"more than {tables.MAX_VALUES} categories")
    wide = rows.groupBy("territory_id").pivot("category", names).agg(F.avg("value")).na.fill(0.0)
    x = wide.select("territory_id", F.array(*(F.log1p(F.col(f"`{n}`")) for n in names)).alias("x"))
    return C.k_means(x, "territory_id", "x", k, seed) if method == "k_means" else C.linkage_labels(x, "territory_id", "x", k, "ward")


class Job:
    """A user's forecast or clustering as a job: queued, running, then done or failed with a reason; its result is written before it is done."""

    def __init__(self, spark: SparkSession, kind: str, rows: DataFrame, budget: int = ROW_BUDGET, **arguments):
        runs = {"forecast": forecast_user, "clusters": cluster_user}
        if kind not in runs:
            raise ValueError(f"unknown job: {kind!r}")
        self.spark, self.kind, self.rows, self.budget, self.arguments, self._run = spark, kind, rows, budget, arguments, runs[kind]
        self.states, self.reason, self.result = ["queued"], None, None

    @property
    def state(self) -> str:
        return self.states[-1]

    def run(self) -> Job:
        self.states.append("running")
        try:
            self.result = written(self._run(tables.guarded(self.rows, self.budget), **self.arguments))
            self.states.append("done")
        except Exception as e:  # whatever it is, the job's owner gets it as the reason
            self.reason = str(e).splitlines()[0]
            self.states.append("failed")
        return self


TOOLS = {
    "describe": Tool(_describe, {}, {"dataset": str}),
    "rows": Tool(_rows, {"dataset": str, "columns": list}, {"filters": dict, "limit": int}),
    "normalise": Tool(_normalise, {"dataset": str, "value": str, "method": str}, {"group_by": list, "filters": dict, "limit": int, "budget": int}),
    "metric": Tool(_metric, {"dataset": str, "metric": str, "value": str, "group_by": list}, {"filters": dict, "time": str, "lag": int, "threshold": float, "limit": int, "budget": int}),
    "moran": Tool(_moran, {"dataset": str, "key": str, "value": str, "vector": str}, {"neighbours": int, "permutations": int, "filters": dict, "budget": int}),
    "cluster": Tool(_cluster, {"dataset": str, "key": str, "vector": str}, {"method": str, "k": int, "seed": int, "filters": dict, "budget": int}),
    "forecast": Tool(_forecast, {}, {"horizon": int, "budget": int}),
    "crosswalk": Tool(_crosswalk, {}),
    "channel": Tool(_channel, {"record": dict}),
}


def call(spark: SparkSession, root: str, tool: str, **arguments) -> DataFrame:
    """Run a named tool; unknown tools and arguments, missing ones and wrong types are refused before any plan is built."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool: {tool!r}")
    spec = TOOLS[tool]
    known = spec.required | spec.optional
    for name, value in arguments.items():
        if name not in known:
            raise ValueError(f"{tool}: unknown argument {name!r}")
        if not isinstance(value, known[name]) or isinstance(value, bool):
            raise ValueError(f"{tool}: {name} must be {known[name].__name__}")
    if missing := set(spec.required) - set(arguments):
        raise ValueError(f"{tool}: missing {sorted(missing)}")
    return spec.run(spark, root, **arguments)


def main(argv: list[str] | None = None) -> int:
    """python -m ledgerline.sources.api ROOT QUERY: run a registered query and print its first rows."""
    import argparse

    from ledgerline.plans.catalog import QUERIES

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("root")
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    QUERIES[args.query](spark, args.root).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
