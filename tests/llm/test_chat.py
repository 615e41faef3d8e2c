from ledgerline.llm import chat
from ledgerline.llm.registry import QUERIES, SQL
from tests import oracle

SCHEMA = "conv_id long, turn long, role string, text string, block string, pos int"


def turns(spark, convs):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x, "clash", 0) for c, xs in convs.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, SCHEMA)


def test_matches_sql(spark, root):
    oracle.same(oracle.connect(root), QUERIES["op4_chat_format"](spark, root), SQL["op4_chat_format"])


def test_snapshots_collapse(spark):
    convs = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["a", "b", "c"], 6: ["b"], 7: [None], 8: [""]}
    kept = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.maximal(turns(spark, convs)).collect()}
    assert kept == {3: (3, 2), 4: (2, 1), 6: (1, 1), 7: (1, 1), 8: (1, 1)}


def test_null_keys_ties_and_empty(spark):
    rows = [(None, 0, "user", "q"), (None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df).filter("part >= 0").collect()}
    assert set(got) == {None, 1} and got[1].n_copies == 2
    assert chat.format_chats(df.limit(0)).collect() == []


def test_long_conversations_come_in_parts(spark):
    n = 3 * chat.BLOCK + 5
    long = [f"t{i}" for i in range(n)]
    df = turns(spark, {1: long, 2: long[:-1], 3: long[: chat.BLOCK], 4: [*long[:-1], "other"]})
    parts = chat.format_chats(df).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part) for r in parts] == [(c, p) for c in (1, 4) for p in range(4)]
    whole = "".join(r.text for r in parts if r.conv_id == 1)
    assert whole == "".join(f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}\n{t}<|im_end|>\n" for i, t in enumerate(long))
