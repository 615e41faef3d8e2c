"""Exact dedup by progressive refinement, in DataFrame functions only.

Texts are equal when they are after each run of white space became one space. One scan
notes length and prefix hash of each row; lengths that occur once are settled, then
(length, prefix hash) pairs that occur once; only the rows left over have their full
content read and hashed. All grouping is on narrow rows with map-side partial counts,
and decisions are joined back with hot groups broadcast apart (see common.attach).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import attach, materialise, small, table

PREFIX_CHARS = 256


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """row_id, doc_id, keep_id, group_size, kept, text_sha256; one row per row of docs.

    digest_all: the caller wants the full hash of every row, so the one scan that notes
    lengths and prefixes notes it too; else the full content is read again, for the
    surviving groups alone, and text_sha256 is null elsewhere. Either way, rows are
    grouped by full hash only if they survive the length and the prefix.

    A null text counts as empty. The row with the smallest doc_id stays (a null doc_id
    counts as largest); of rows repeated with the same doc_id one stays. An empty table
    gives an empty result; other columns of docs are not read.
    """
    noted = docs.select("doc_id", normalised().alias("_t"))
    columns = [F.monotonically_increasing_id().alias("row_id"), "doc_id", F.octet_length("_t").alias("n"), F.xxhash64(F.substring("_t", 1, PREFIX_CHARS)).alias("prefix")]
    noted = materialise(noted.select(*columns, *([F.sha2("_t", 256).alias("full")] if digest_all else [])), "noted")
    n_rows = noted.count()

    pairs = noted.groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("c"))
    lengths = pairs.groupBy("n").agg(F.sum("c").alias("of_length")).filter("of_length > 1").select("n")
    alive = materialise(pairs.join(lengths, "n", "left_semi").filter("c > 1"), "alive")

    candidates = attach(noted, alive, ["n", "prefix"], "c", n_rows, "inner").drop("c")
    if not digest_all:
        # rows with equal doc_id, length and prefix get a hash each; any pairing of them is right
        again = docs.select("doc_id", normalised().alias("_t"))
        again = again.select("doc_id", F.octet_length("_t").alias("n"), F.xxhash64(F.substring("_t", 1, PREFIX_CHARS)).alias("prefix"), "_t")
        keys = ["doc_id", "n", "prefix"]
        wanted = small(materialise(candidates.select(keys).distinct(), "wanted"))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
        hashed = again.alias("a").join(wanted.alias("w"), same[0] & same[1] & same[2], "left_semi").select(*keys, F.sha2("_t", 256).alias("full"))
        candidates = hashed.withColumn("row_id", F.monotonically_increasing_id())
        candidates = materialise(candidates, "hashed")
        settled = attach(noted, alive, ["n", "prefix"], "c", n_rows, "left_anti").withColumn("full", F.lit(None).cast("string"))
        # scan ids and ids of the second read may not clash
        noted = settled.withColumn("row_id", -1 - F.col("row_id")).unionByName(candidates)
    first = F.min_by(F.struct("doc_id", "row_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "row_id"))
    groups = candidates.groupBy("full").agg(F.count(F.lit(1)).alias("c"), first.alias("first")).filter("c > 1")
    groups = materialise(groups, "groups")
    has = noted.filter(F.col("full").isNotNull())
    lone = noted.filter(F.col("full").isNull()).withColumns({"c": F.lit(1).cast("long"), "first": F.struct("doc_id", "row_id")})
    out = attach(has, groups, ["full"], "c", n_rows, "left")
    if not digest_all:
        out = out.unionByName(lone)
    alone = F.col("c").isNull()
    return out.select(
        "row_id",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("c", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row_id") == F.col("row_id"))).alias("kept"),
        F.col("full").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of equal texts: the one with the smallest doc_id.

    A null text is an empty one; a missing doc_id is larger than all others; of repeated rows one stays;
    an empty table stays empty; other columns, whatever their names, go along.
    """
    decided = exact_dedup(docs)
    key = ["doc_id", "text_sha256"]
    pairs = decided.filter("group_size > 1").groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.max("kept").alias("stays"))
    pairs = materialise(pairs.filter("not stays or c > 1"), "pairs")
    gone, repeated = pairs.filter("not stays").select(key), pairs.filter("stays").select(key)
    if gone.isEmpty() and repeated.isEmpty():
        return docs

    rows = docs.select("doc_id", F.sha2(normalised(), 256).alias("_sha"), F.struct(*docs.columns).alias("_row"))

    def matches(other: DataFrame, how: str) -> DataFrame:
        on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._sha") == F.col("b.text_sha256"))
        return rows.alias("a").join(small(other).alias("b"), on, how)

    if repeated.isEmpty():
        return matches(gone, "left_anti").select("_row.*")
    one = matches(repeated, "left_semi").dropDuplicates(["doc_id", "_sha"])
    return matches(pairs.select(key), "left_anti").unionByName(one).select("_row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
