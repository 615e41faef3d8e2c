"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation once per turn, each snapshot a prefix of the next. Each
conversation's turns get a rolling prefix hash: the xor, over the turns so far, of a
128-bit hash of (position, role, text). A conversation whose last rolling hash is the
rolling hash of a proper prefix elsewhere is a snapshot, and an anti-join removes it; of
equal conversations the smallest conv_id stays. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import attach, materialise, table

#: Turns numbered within one block are sorted in one task; longer conversations are cut into blocks of so many.
BLOCK = 256
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _positions(turns: DataFrame) -> DataFrame:
    """turns with block and pos, the ordinal of the turn in its conversation (from 1)."""
    cut = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long"))
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "c1", "c2")
    cut = cut.withColumn("i", F.row_number().over(in_block))
    blocks = cut.groupBy("conv_id", "block").agg(F.max("i").alias("m"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.block") == F.col("b.block"))
    joined = cut.alias("a").join(blocks.alias("b"), same)
    return joined.select("a.*", (F.col("b.start") + F.col("a.i")).alias("pos"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, block, pos, h1, h2: the rolling hash of the conversation's first pos turns.

    Equal to 128 bits exactly when the (role, text) sequences are equal, but for chance.
    Null roles and texts differ from empty ones. Equal turn numbers are ordered by content;
    a null turn number comes first.
    """
    flag = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    content = turns.select("conv_id", "turn", F.xxhash64(flag, "role", "text").alias("c1"), F.xxhash64(F.lit("second"), "text", flag, "role").alias("c2"))
    placed = _positions(content).withColumns({"x1": F.xxhash64("pos", "c1", "c2"), "x2": F.xxhash64("c2", "pos", "c1")})
    rolling = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns({"h1": F.bit_xor("x1").over(rolling), "h2": F.bit_xor("x2").over(rolling)})
    blocks = placed.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("conv_id", "block", F.coalesce(F.bit_xor("b1").over(before), zero).alias("o1"), F.coalesce(F.bit_xor("b2").over(before), zero).alias("o2"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.block") == F.col("b.block"))
    joined = placed.alias("a").join(blocks.alias("b"), same)
    return joined.select("a.conv_id", "a.block", "a.pos", F.col("a.h1").bitwiseXOR(F.col("b.o1")).alias("h1"), F.col("a.h2").bitwiseXOR(F.col("b.o2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another and the first of their equals."""
    hashes = materialise(prefix_hashes(turns), "hashes")
    # a conversation's last position, without a sort: the largest pos and the hash beside it
    ends = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    ends = materialise(ends, "ends")
    finals = ends.groupBy("pos", "h1", "h2").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    # every prefix once with its number of conversations; proper ones have more conversations through them than end there
    through = hashes.groupBy("pos", "h1", "h2").agg(F.count(F.lit(1)).alias("through"))
    longer = through.join(finals.select("pos", "h1", "h2", F.col("n_copies").alias("ending")), ["pos", "h1", "h2"]).filter("through > ending")
    kept = finals.join(longer.select("pos", "h1", "h2"), ["pos", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies, text: the kept conversations as chat markup.

    A part holds the turns of one block of BLOCK turn numbers, so no task gathers more than
    that of a long conversation (many turns of one number, or without one, are one part); the
    parts in order are the whole. Turns meet their conversation by attach(), so a conversation with
    a large share of all turns stays spread over the tasks. Null roles and texts render as empty.
    """
    cut = turns.select("conv_id", "turn", "role", "text", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long").alias("part"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    key = {"_none": F.col("conv_id").isNull(), "_id": F.coalesce("conv_id", F.lit("0").cast(kind))}
    # every conversation with its size, so that large ones are known even where they go
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_size"))
    ends = sizes.join(kept.withColumnRenamed("conv_id", "_kept_id"), F.col("conv_id").eqNullSafe(F.col("_kept_id")), "left")
    own = materialise(ends.select(*(c.alias(k) for k, c in key.items()), "_size", "n_turns", "n_copies"), "ends")
    n_rows = own.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    mine = attach(cut.withColumns(key), own, list(key), "_size", n_rows, "inner").filter("n_turns is not null").drop(*key, "_size")
    # ties in turn are ordered as they are when hashed
    flag = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    one = F.struct("turn", F.xxhash64(flag, "role", "text").alias("c1"), F.xxhash64(F.lit("second"), "text", flag, "role").alias("c2"), "role", "text")
    parts = mine.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(one)).alias("s"))
    empty = F.lit("")
    text = F.transform("s", lambda x: F.concat(F.lit(OPEN), F.coalesce(x["role"], empty), F.lit(MIDDLE), F.coalesce(x["text"], empty), F.lit(CLOSE)))
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.concat_ws("", text).alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Render the maximal conversations of turns (conv_id, turn, role, text); see maximal() and render().

    An empty table gives an empty result; rows with a null conv_id form one conversation;
    other columns are not read.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    return render(turns, maximal(turns))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
p AS (SELECT conv_id, pos, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '')
        OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM t),
e AS (SELECT conv_id, max(pos) AS n_turns, max_by(prefix, pos) AS text FROM p GROUP BY conv_id),
f AS (SELECT text, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM e GROUP BY text, n_turns),
longer AS (SELECT DISTINCT p.prefix FROM p JOIN e USING (conv_id) WHERE p.pos < e.n_turns)
SELECT conv_id, 0::BIGINT AS part, n_turns::BIGINT AS n_turns, n_copies, text FROM f
WHERE text NOT IN (SELECT prefix FROM longer)
"""
