"""Past-only forecasts and their evaluation.

A forecast for month t made at origin o = t - h uses rows at or before o alone: lags are
calendar-exact windows, medians are of months at or before o, and folds run over the past
of one series.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.calendar import at_lag, over_months, up_to

ALPHAS = np.arange(1, 20) / 20
SHRINK, YEAR = 0.7, 12


def base(panel: DataFrame, by: list[str], cat: str, h: int) -> DataFrame:
    """The panel with y at origin, a year before target and origin, and the category's medians there.

    Columns: yo, yt12, yo12, and mo, mt12, mo12 for the medians; rows need a value at the origin.
    """
    med = panel.groupBy(cat, "m").agg(F.median("value").alias("med"))
    lags = {"yo": h, "yt12": 12, "yo12": 12 + h}
    out = panel.withColumns({n: at_lag("value", k, by) for n, k in lags.items()}).filter(F.col("yo").isNotNull())
    for name, k in (("mo", h), ("mt12", 12), ("mo12", 12 + h)):
        out = out.join(med.select(cat, (F.col("m") + k).alias("m"), F.col("med").alias(name)), [cat, "m"], "left")
    return out


def seasonal_ratio() -> Column:
    """How the category's median moved from origin to target a year before."""
    return F.when((F.col("mo12") > 0) & (F.col("mt12") > 0), F.col("mt12") / F.col("mo12"))


def balanced_ratio(panel: DataFrame, by: list[str], cat: str, h: int) -> DataFrame:
    """cat, m, ratio: as seasonal_ratio(), over entities seen in both months."""
    both = panel.select(*by, "m", "value").withColumn("before", at_lag("value", h, by)).na.drop(subset=["before"])
    med = both.groupBy(cat, "m").agg(F.median("value").alias("_t"), F.median("before").alias("_o"))
    return med.select(cat, (F.col("m") + 12).alias("m"), F.when(F.col("_o") > 0, F.col("_t") / F.col("_o")).alias("ratio"))


def growth(by: list[str], h: int, k: int) -> Column:
    """y[t-12] times the sum of the last k months to the origin over the same a year before; all of them known."""
    recent, prior = over_months(by, -h - k + 1, -h), over_months(by, -h - k - 11, -h - 12)
    whole = (F.count("value").over(recent) == k) & (F.count("value").over(prior) == k)
    return F.when(whole, at_lag("value", 12, by) * F.sum("value").over(recent) / F.sum("value").over(prior))


def best_levels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each prefix of x: the level of simple exponential smoothing and its alpha, the one of least total absolute one-step error so far (the least alpha on a tie)."""
    paths = np.empty((len(x), len(ALPHAS)))
    paths[0] = x[0]
    for t in range(1, len(x)):
        paths[t] = paths[t - 1] + ALPHAS * (x[t] - paths[t - 1])
    missed = np.abs(x[1:, None] - paths[:-1])
    chosen = np.vstack([np.zeros(len(ALPHAS)), np.cumsum(missed, axis=0)]).argmin(axis=1)
    return paths[np.arange(len(x)), chosen], ALPHAS[chosen]


def unbroken(m: np.ndarray) -> int:
    """How many of the sorted months m follow the first without a gap."""
    return int(np.argmin(np.append(np.diff(m) == 1, False))) + 1


def smoothed(df: DataFrame, by: list[str], value: str, least: int = 3) -> DataFrame:
    """by, m, level, alpha: the SES of each series up to and with each month; months in a row from its first on.

    A gap ends a series' forecasts, as nothing is imputed. One series is folded at a time.
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("m")
        m, x = rows["m"].to_numpy(), rows[value].to_numpy(float)
        level, alpha = best_levels(x[: unbroken(m)])
        frame = pd.DataFrame({"m": m[: len(level)], "level": level, "alpha": alpha})[least - 1 :]
        for c in by:
            frame[c] = rows[c].iloc[0]
        return frame[[*by, "m", "level", "alpha"]]

    return df.select(*by, "m", value).groupBy(*by).applyInPandas(fold, f"{kinds}, m int, level double, alpha double")


def conditional_ses(panel: DataFrame, by: list[str], cat: str, h: int) -> DataFrame:
    """by, m, value, predicted: SES of own over median, times the median at the origin and the seasonal ratio."""
    med = panel.groupBy(cat, "m").agg(F.median("value").alias("_med"))
    z = panel.join(med, [cat, "m"]).withColumn("z", F.col("value") / F.col("_med"))
    at_origin = smoothed(z, by, "z", 13).select(*by, (F.col("m") + h).alias("m"), "level")
    joined = base(panel, by, cat, h).join(at_origin, [*by, "m"])
    return joined.select(*by, "m", "value", (F.col("level") * F.col("mo") * seasonal_ratio()).alias("predicted")).na.drop(subset=["predicted"])


def profile_ses(panel: DataFrame, by: list[str], cat: str, h: int) -> DataFrame:
    """by, m, value, predicted: SES of the log deviation from the median less a shrunk profile of the first year, times median growth."""
    med = panel.groupBy(cat, "m").agg(F.median("value").alias("med"))
    rows = panel.join(med, [cat, "m"]).select(*by, "m", "value", "med")
    kinds = ", ".join(f"{c} {panel.schema[c].dataType.simpleString()}" for c in by)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("m")
        rows = rows[: unbroken(rows["m"].to_numpy())]
        deviation = np.log(rows["value"].to_numpy(float) / rows["med"].to_numpy(float))
        first_year = deviation[:YEAR]
        profile = np.resize(SHRINK * (first_year - first_year.mean()), len(rows))  # repeated every year
        rows = rows.assign(level=best_levels(deviation - profile)[0], profile=profile)
        # year-on-year growth of the median, averaged over the last three months that have one
        rows["growth"] = np.log(rows["med"] / rows["med"].shift(YEAR)).rolling(3, min_periods=1).mean()
        at_origin = rows[["level", "growth"]].shift(h)
        rows["predicted"] = np.exp(at_origin["level"] + rows["profile"] + at_origin["growth"]) * rows["med"].shift(YEAR)
        frame = rows.dropna(subset=["predicted"])[["m", "value", "predicted"]].copy()
        for name in by:
            frame[name] = rows[name].iloc[0]
        return frame[[*by, "m", "value", "predicted"]]

    return rows.groupBy(*by).applyInPandas(fold, f"{kinds}, m int, value double, predicted double")


def select_past_best(ledger: DataFrame, models: list[str], start: str) -> DataFrame:
    """origin, first, second: the models by mean absolute error over the targets known before each origin; `start` where there are none.

    ledger: origin, m (target), value and one column per model.
    """
    long = ledger.unpivot(["origin", "m", "value"], models, "model", "predicted").na.drop(subset=["predicted"])
    per = long.groupBy("model", "m").agg(F.sum(F.abs(F.col("value") - F.col("predicted"))).alias("s"), F.count(F.lit(1)).alias("n"))
    past = Window.partitionBy("model").orderBy("m").rangeBetween(Window.unboundedPreceding, -1)
    origins = ledger.select(F.col("origin").alias("m")).distinct().withColumn("_ask", F.lit(1))
    asked = origins.join(per.select("model").distinct(), how="cross")  # origins x models: both few
    at = asked.join(per, ["model", "m"], "full").withColumns({"ps": F.sum("s").over(past), "pn": F.sum("n").over(past)}).filter("_ask = 1")
    ranked = at.withColumn("mae", F.col("ps") / F.nullif("pn", F.lit(0))).withColumn("r", F.row_number().over(Window.partitionBy("m").orderBy(F.col("mae").asc_nulls_last(), "model")))
    pick = lambda i: F.max(F.when((F.col("r") == i) & F.col("mae").isNotNull(), F.col("model")))
    return ranked.groupBy(F.col("m").alias("origin")).agg(F.coalesce(pick(1), F.lit(start)).alias("first"), F.coalesce(pick(2), F.lit(start)).alias("second"))


def gram(df: DataFrame, features: list[str], target: str, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(weighted Z'Z, Z'y, total weight) of the features with an intercept in front: one aggregation, solved on the driver."""
    z = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    w = F.col(weight) if weight else F.lit(1.0)
    k = len(z)
    sums = [F.sum(w * z[i] * z[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * z[i] * F.col(target)) for i in range(k)] + [F.sum(w)]
    row = [float(x or 0.0) for x in df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
    zz, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            zz[i, j] = zz[j, i] = row[at]
            at += 1
    return zz, np.array(row[at : at + k]), row[-1]


def ridge(df: DataFrame, features: list[str], target: str, penalty: float, weight: str | None = None) -> np.ndarray:
    """Intercept and coefficients; the intercept isn't penalised, and features are standardised through their sums."""
    zz, zy, n = gram(df, features, target, weight)
    mean = zz[0, 1:] / n
    spread = np.sqrt(np.maximum(np.diag(zz)[1:] / n - mean**2, 0.0))
    spread[spread == 0] = 1.0
    cov = (zz[1:, 1:] / n - np.outer(mean, mean)) / np.outer(spread, spread)
    cy = (zy[1:] / n - mean * zy[0] / n) / spread
    beta = np.linalg.solve(cov + penalty * np.eye(len(features)), cy) / spread
    return np.concatenate([[zy[0] / n - mean @ beta], beta])


def linear(coefficients: np.ndarray, features: list[str]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, f in zip(coefficients[1:], features, strict=True):
        out = out + F.lit(float(c)) * F.col(f)
    return out


def ridge_correction(df: DataFrame, features: list[str], base_column: str, split: int, penalty: float = 1.0, bound: float = 0.1) -> DataFrame:
    """df after month split with corrected: base times exp of the clipped ridge estimate of ln(value / base), fitted on rows up to split."""
    rows = df.withColumn("_y", F.ln(F.col("value") / F.col(base_column)))
    beta = ridge(rows.filter(F.col("m") <= split), features, "_y", penalty)
    step = F.least(F.greatest(linear(beta, features), F.lit(-bound)), F.lit(bound))
    return rows.filter(F.col("m") > split).withColumn("corrected", F.col(base_column) * F.exp(step)).drop("_y")


def hinged(t: np.ndarray, y: np.ndarray, at: float, changes: int, penalty: float) -> float:
    """The value at a time of a linear trend with `changes` hinges at equal parts of the first 80 % of t, hinges penalised."""
    span = max(t[-1] - t[0], 1)
    knots = np.arange(1, changes + 1) / (changes + 1) * 0.8
    design = lambda x: np.column_stack([np.ones(len(x)), x, np.maximum(x[:, None] - knots, 0)])
    z, scale = design((t - t[0]) / span), y.mean()
    eye = np.diag([1e-9, 1e-9, *[penalty / 100 + 1e-9] * changes])
    beta = np.linalg.solve(z.T @ z + eye, z.T @ (y / scale))
    return float(max((design(np.array([(at - t[0]) / span])) @ beta)[0] * scale, 0.0))


def fit_ledger(panel: DataFrame, by: list[str], h: int, changes: int = 3, penalty: float = 10.0, least: int = 14) -> DataFrame:
    """by, origin, m, value, history, status, reason, predicted: hinged() for every month of every series from its rows up to h months before.

    Nothing is left out: `short history` has fewer than least rows, `failed` says why in reason. One series
    is fitted at a time. value is that of month m, the origin's h-th next, null where it isn't known yet.
    """
    kinds = ", ".join(f"{c} {panel.schema[c].dataType.simpleString()}" for c in by)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("m")
        m, y = rows["m"].to_numpy(), rows["value"].to_numpy(float)
        known, out = dict(zip(m.tolist(), y.tolist(), strict=True)), []
        for i, origin in enumerate(m.tolist()):
            status, reason, predicted = "short history", None, None
            if i + 1 >= least:
                try:
                    predicted = hinged(m[: i + 1], y[: i + 1], origin + h, changes, penalty)
                    status, reason = ("fitted", None) if np.isfinite(predicted) else ("failed", "not a finite forecast")
                except (np.linalg.LinAlgError, FloatingPointError, ZeroDivisionError) as e:
                    status, reason = "failed", str(e)
            out.append((origin, origin + h, known.get(origin + h), i + 1, status, reason, predicted if status == "fitted" else None))
        frame = pd.DataFrame(out, columns=["origin", "m", "value", "history", "status", "reason", "predicted"])
        for k, c in enumerate(by):
            frame.insert(k, c, rows[c].iloc[0])
        return frame

    return panel.select(*by, "m", "value").groupBy(*by).applyInPandas(fold, f"{kinds}, origin int, m int, value double, history long, status string, reason string, predicted double")


def trend(panel: DataFrame, by: list[str], h: int, changes: int = 3, penalty: float = 10.0, least: int = 14) -> DataFrame:
    """by, m, value, predicted: fit_ledger() where a fit and the value are known."""
    done = fit_ledger(panel, by, h, changes, penalty, least).filter("status = 'fitted' and value is not null")
    return done.select(*by, "m", "value", "predicted")


def batched(panel: DataFrame, by: list[str], h: int, predict: Callable[[list[np.ndarray], int, int], np.ndarray], least: int = 12, longest: int = 512, batch: int = 64, seed: int = 7) -> DataFrame:
    """by, origin, m, value, predicted: a pretrained model's forecasts, by batches of contexts; nothing is fitted here.

    For every month m with at least `least` rows up to its origin, h months before, the context is those
    rows' values, `longest` of them at most. predict(contexts, h, seed) gives a number for each context; its seed
    comes from the batch's keys, so a batch that is run again gives the same. One series' contexts
    are made at a time.
    """
    kinds = ", ".join(f"{c} {panel.schema[c].dataType.simpleString()}" for c in by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("m")
        m, y = rows["m"].to_numpy(), rows["value"].to_numpy(float)
        known = np.searchsorted(m, m - h, side="right")
        asked, out = np.flatnonzero(known >= least), np.zeros(0)
        for a in range(0, len(asked), batch):
            some = asked[a : a + batch]
            name = "|".join(str(rows[c].iloc[0]) for c in by) + f"|{m[some[0]]}|{seed}"
            own = int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "big")
            out = np.concatenate([out, np.asarray(predict([y[max(0, known[i] - longest) : known[i]] for i in some], h, own), float)])
        frame = pd.DataFrame({c: rows[c].iloc[0] for c in by} | {"origin": (m[asked] - h).astype("int32"), "m": m[asked].astype("int32"), "value": y[asked], "predicted": out}, index=range(len(asked)))
        return frame[[*by, "origin", "m", "value", "predicted"]]

    return panel.select(*by, "m", "value").groupBy(*by).applyInPandas(run, f"{kinds}, origin int, m int, value double, predicted double")


def boosted(df: DataFrame, features: list[str], split: int, depth: int = 3, rounds: int = 20, seed: int = 7) -> DataFrame:
    """df after month split with predicted, from boosted trees fitted on rows up to split: never the rows it predicts."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.na.drop(subset=[*features, "value"]))
    model = GBTRegressor(featuresCol="_x", labelCol="value", predictionCol="predicted", maxDepth=depth, maxIter=rounds, seed=seed).fit(rows.filter(F.col("m") <= split))
    return model.transform(rows.filter(F.col("m") > split)).drop("_x")


def block_bootstrap(df: DataFrame, block: str, a: str, b: str, draws: int = 10_000, seed: int = 11) -> DataFrame:
    """One row: mean difference of errors a - b with a 95 % interval, blocks drawn with replacement, and the jackknife range.

    Spark sums per block; the blocks (months, or entities) are few and are drawn on the driver.
    """
    rows = df.groupBy(block).agg(F.sum(F.col(a) - F.col(b)).alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("z")).orderBy(block).collect()
    s, n, z = (np.array([r[c] for r in rows], float) for c in ("s", "n", "z"))
    pick = np.random.Generator(np.random.PCG64(seed)).multinomial(len(s), np.full(len(s), 1 / len(s)), size=draws)
    means = (pick @ s) / (pick @ n)
    left = (s.sum() - s) / (n.sum() - n)
    row = (float(s.sum() / n.sum()), *(float(q) for q in np.quantile(means, [0.025, 0.975])), float(left.min()), float(left.max()), float(z.sum() / n.sum()), float(n.max() / n.sum()), len(s))
    return df.sparkSession.createDataFrame([row], "difference double, low double, high double, jackknife_low double, jackknife_high double, zero_share double, largest_share double, blocks int")


def history_mean(by: list[str], h: int, least: int = 1) -> Column:
    w = up_to(by, h)
    return F.when(F.count("value").over(w) >= least, F.avg("value").over(w))
