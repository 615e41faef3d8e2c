"""Named datasets: an allow-list from name to Parquet, scans with pruning and pushdown, profiles, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: At most so many columns and listed values in one request.
MAX_COLUMNS, MAX_VALUES = 16, 200


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The named dataset under root; a name outside the list, or one that leaves the folder, is refused."""
    if name not in NAMES:
        raise ValueError(f"unknown dataset: {name!r}")
    return spark.read.parquet(f"{root}/{name}.parquet")


def condition(df: DataFrame, filters: dict[str, object]) -> Column:
    """Equality for a scalar, membership for a list of 1 to MAX_VALUES values; unknown fields are refused."""
    parts = []
    for field, value in filters.items():
        if field not in df.columns:
            raise ValueError(f"no such field: {field!r}")
        if isinstance(value, (list, tuple, set)):
            if not 1 <= len(value) <= MAX_VALUES:
                raise ValueError(f"{field}: 1 to {MAX_VALUES} values")
            parts.append(F.col(field).isin(list(value)))
        else:
            parts.append(F.col(field) == F.lit(value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def select(spark: SparkSession, root: str, name: str, columns: list[str], filters: dict[str, object] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Projected, filtered scan: only the columns asked for and those of the filters are read.

    required: one of these fields must be among the filters (a guard for very large tables).
    """
    df, filters = scan(spark, root, name), filters or {}
    columns = list(dict.fromkeys(columns))
    if not 1 <= len(columns) <= MAX_COLUMNS:
        raise ValueError(f"1 to {MAX_COLUMNS} columns")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    if required and not set(required) & set(filters):
        raise ValueError(f"a filter on one of {required} is needed")
    return df.filter(condition(df, filters)).select(columns)


def guarded(df: DataFrame, budget: int) -> DataFrame:
    """df, refused when it has more than budget rows; only budget + 1 rows are looked at, if an int can say so."""
    if (df.limit(budget + 1) if budget < (1 << 31) - 1 else df).count() > budget:
        raise ValueError(f"more than {budget} rows")
    return df


def report(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in an order, with matched, returned and truncated beside them."""
    matched = df.agg(F.count(F.lit(1)).alias("matched"))
    first = df.orderBy(*order).limit(limit)
    joined = first.crossJoin(F.broadcast(matched))  # one row
    return joined.withColumns({"returned": F.least("matched", F.lit(limit).cast("long")), "truncated": F.col("matched") > limit})


def columns(spark: SparkSession, root: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """dataset, column, type and position of every column of the datasets; data isn't read."""
    rows = [(n, f.name, f.dataType.simpleString(), i) for n in names for i, f in enumerate(scan(spark, root, n).schema)]
    return spark.createDataFrame(rows, "dataset string, column string, type string, position int")


#: What catalog() found, by dataset and the sizes and times of its files.
_known: dict[tuple, tuple] = {}


def catalog(spark: SparkSession, root: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """dataset, rows, columns, files, bytes, content of the datasets.

    Rows are counted from the files' footers. content is a digest of rows and schema that doesn't
    depend on their order or files. Both are remembered for as long as no file changes.
    """
    from ledgerline.operators.checks import fingerprint

    out = []
    for n in names:
        df = scan(spark, root, n)
        files = spark.read.format("binaryFile").load(f"{root}/{n}.parquet").select("path", "length", "modificationTime").drop("content")
        count, size, last, mark = files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
        key = (root, n, count, size, last, mark)
        if key not in _known:
            _known[key] = (df.count(), fingerprint(df))
        rows, content = _known[key]
        out.append((n, rows, ",".join(df.columns), count, size, content))
    return spark.createDataFrame(out, "dataset string, rows long, columns string, files long, bytes long, content string")


def profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """column, rows, nulls and, for keys, distinct values; one pass."""
    measures = [F.count(F.lit(1)).alias("_rows")]
    measures += [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns]
    measures += [F.count_distinct(F.col(c)).alias(f"d_{c}") for c in keys]
    wide = df.agg(*measures)
    each = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"n_{c}").alias("nulls"), (F.col(f"d_{c}") if c in keys else F.lit(None).cast("long")).alias("distinct_values")) for c in df.columns]
    return wide.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def append(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Copy-on-write append: base with the rows of delta whose key is new; both stay as they are."""
    fresh = delta.join(base.select(keys), keys, "left_anti")
    return base.unionByName(fresh)


def write_new(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write to a path that must not exist yet; the commit protocol makes it all or nothing."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "json":
        writer = writer.option("ignoreNullFields", "false")
    if format == "csv":
        writer = writer.option("header", "true").option("nullValue", "NA")
    if format == "parquet":
        writer = writer.option("compression", "zstd")
    writer.format(format).save(path)


def null_if_nan(df: DataFrame) -> DataFrame:
    """Not-a-number and infinite values of all double columns become null."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in df.columns if kinds[c] in ("double", "float")})


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A Markdown table of at most limit rows."""
    rows = df.limit(limit).collect()
    line = lambda values: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in values) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])
