"""The panel: one row per entity, category and month, with gaps; and masks over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.tables import scan

#: The months of the driver's orders, as year * 12 + month - 1.
FIRST, LAST = 1995 * 12, 2001 * 12 + 7


def month_index(ts: Column | str) -> Column:
    """year * 12 + month - 1."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def month_text(m: Column | str) -> Column:
    """A month index as YYYY-MM."""
    m = F.col(m) if isinstance(m, str) else m
    return F.format_string("%04d-%02d", F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"))


def exact_sum(c: str) -> Column:
    """A sum of money that doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def sales(spark: SparkSession, root: str) -> DataFrame:
    """tid, cat, m, price of every order."""
    orders = scan(spark, root, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = scan(spark, root, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_nationkey").cast("long").alias("tid"), F.col("c_mktsegment").alias("cat"), month_index("o_orderdate").alias("m"), F.col("o_totalprice").alias("price"))


def panel(spark: SparkSession, root: str) -> DataFrame:
    """tid, cat, m, value: the orders of a nation's segment in a month."""
    return sales(spark, root).groupBy("tid", "cat", "m").agg(exact_sum("price").alias("value"))


def totals(spark: SparkSession, root: str) -> DataFrame:
    """tid, m, value: a row of its own, not a sum of categories."""
    return sales(spark, root).groupBy("tid", "m").agg(exact_sum("price").alias("value"))


def finite(*columns: str) -> Column:
    """All of the columns are numbers."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def complete(df: DataFrame, entity: list[str], grid: list[str], cells: int) -> DataFrame:
    """Rows of the entities that have all cells of the grid (relational division); the others go whole."""
    whole = df.groupBy(*entity).agg(F.count_distinct(*grid).alias("_n")).filter(F.col("_n") == cells)
    return df.join(whole.select(*entity), entity, "left_semi")


def completeness(df: DataFrame, entity: list[str], grid: list[str], cells: int) -> DataFrame:
    """Each entity with its number of cells and the first reason against it, else `complete`."""
    per = df.groupBy(*entity).agg(F.count_distinct(*grid).alias("cells"), F.count_if(F.col("value") <= 0).alias("not_positive"))
    reason = F.when(F.col("cells") < cells, "missing cells").when(F.col("not_positive") > 0, "not positive").otherwise("complete")
    return per.withColumn("status", reason)


def grid(entities: DataFrame, first: int, last: int) -> DataFrame:
    """Every entity with every month from first to last; the months are made in place."""
    return entities.withColumn("m", F.explode(F.sequence(F.lit(first), F.lit(last))))
