"""Contract checks as DataFrames: each gives the rows, or counts, that break a rule."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def conflict_aware(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, status: exact and null duplicates collapse; more than one known value is a conflict, and its value null."""
    per = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    conflict = F.col("_lo") != F.col("_hi")
    return per.select(*keys, F.when(conflict, None).otherwise(F.col("_lo")).alias(value), F.when(conflict, "conflict").when(F.col("_lo").isNull(), "missing").otherwise("ok").alias("status"))


def split_nulls(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a value, rows without)."""
    return df.filter(F.col(value).isNotNull()), df.filter(F.col(value).isNull())


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key no row of parent has; a null key refers to nothing and is no orphan."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def leaks(df: DataFrame, origin: str, target: str, lag: int) -> DataFrame:
    """Training rows whose target lies after origin - lag."""
    return df.filter(F.col(target) > F.col(origin) - lag)


def constraints(broken: dict[str, DataFrame]) -> DataFrame:
    """rule, broken: how many rows (or keys) break each rule, 0 too; the rules are counted in one job."""
    counted = [df.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(rule).alias("rule"), "broken") for rule, df in broken.items()]
    return reduce(DataFrame.unionByName, counted)


def ingest(stored: DataFrame, rows: DataFrame, keys: list[str], parent: DataFrame | None = None, foreign: str | None = None, parent_key: str | None = None) -> DataFrame:
    """stored with the rows that keep its rules; rows that repeat a key or refer to nothing make the whole ingest fail."""
    both = stored.unionByName(rows)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = both.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit("key repeats")).cast("boolean")).otherwise(True)).drop("_n")
    if parent is None:
        return checked
    known = parent.select(F.col(parent_key).alias(foreign), F.lit(1).alias("_known"))
    missing = F.col("_known").isNull() & F.col(foreign).isNotNull()
    return checked.join(known, foreign, "left").filter(F.when(missing, F.raise_error(F.lit("refers to nothing")).cast("boolean")).otherwise(True)).select(stored.columns)


def fingerprint(df: DataFrame) -> str:
    """A digest of rows and schema that doesn't depend on their order."""
    row = F.xxhash64(*(F.to_json(F.struct(F.col(c).alias("v"))) for c in df.columns))
    one = df.select(row.alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((df.dtypes, tuple(one))).encode()).hexdigest()


def unchanged_before(run, df: DataFrame, month: str, value: str, origin: int, keys: list[str]) -> DataFrame:
    """Rows of run(df) up to origin that change when all later values do; none, if run looks only back."""
    changed = df.withColumn(value, F.when(F.col(month) > origin, F.col(value) * 3 + 17).otherwise(F.col(value)))
    a, b = run(df).filter(F.col(month) <= origin), run(changed).filter(F.col(month) <= origin)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select(*keys, month)


def mixed_provenance(df: DataFrame, role: str, origin: str) -> DataFrame:
    """Rows of synthetic origin in a measured role."""
    return df.filter((F.col(role) == "measured") & (F.col(origin) == "synthetic"))


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Tasks without a finished row of the same mark: what a resumed run has still to do."""
    return tasks.join(done.filter(F.col("fingerprint") == mark).select(keys), keys, "left_anti")


def differing(a: DataFrame, b: DataFrame, keys: list[str], value: str, rel: float = 1e-10, absolute: float = 1e-8) -> DataFrame:
    """keys, old, new, problem of numbers that aren't the same to a tolerance, or that only one side has."""
    x, y = a.select(*keys, F.col(value).cast("double").alias("old"), F.lit(1).alias("_a")), b.select(*keys, F.col(value).cast("double").alias("new"), F.lit(1).alias("_b"))
    j = x.join(y, keys, "full")
    far = F.abs(F.col("old") - F.col("new")) > F.greatest(F.lit(absolute), F.lit(rel) * F.greatest(F.abs("old"), F.abs("new")))
    unlike = F.col("old").isNull() != F.col("new").isNull()
    problem = F.when(F.col("_a").isNull(), "new key").when(F.col("_b").isNull(), "missing key").when(unlike | far, "changed")
    return j.withColumn("problem", problem).filter("problem is not null").drop("_a", "_b")


def frozen(df: DataFrame, digest: str) -> DataFrame:
    """df, refused unless its fingerprint is the digest."""
    if (found := fingerprint(df)) != digest:
        raise ValueError(f"input has changed: {found}")
    return df
