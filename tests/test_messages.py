import json

import pytest
from pyspark.sql import functions as F

from gleaner.config import MARKER_CLOSE as C
from gleaner.config import MARKER_OPEN as O
from gleaner.operators import messages as m
from gleaner.streaming.messages import prune_stream

CONTEXT = "reset your password in settings\n\n" + "\n\n".join(f"penguins live far south {i}" for i in range(10))


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat(spark):
    df = chat(
        spark,
        [
            (1, 0, "user", f"how do I reset my password? {O}{CONTEXT}{C} thanks {O}  {C}!"),
            (1, 1, "assistant", "nothing marked"),
            (2, 0, "user", "password"),
            (2, 1, "tool", CONTEXT),
            (2, 2, "tool", f"{O}kept as it is{C}"),
            (3, 0, "user", f"{O}the of\n\nand is{C}"),
            (4, 0, "assistant", "no user"),
            (5, 0, "user", f"open {O} never closed"),
            (5, 1, "user", None),
        ],
    )
    got = {(r.conv_id, r.turn): r for r in m.prune_chat(df, auto_mark_tool_results=True).collect()}
    assert len(got) == 9
    first = got[1, 0]
    assert first.text.startswith("how do I reset my password? reset your password") and first.text.endswith(" thanks !")
    assert first.tokens_pruned > 0 and first.text.count("penguins") < 10
    assert got[1, 1].text == "nothing marked" and got[1, 1].tokens_pruned == 0
    assert "password in settings" in got[2, 1].text and got[2, 1].text.count("penguins") < 10
    assert got[2, 2].text == "kept as it is"
    assert got[3, 0].text == "the of\n\nand is"  # nothing to score: everything stays
    assert got[5, 0].text == f"open {O} never closed" and got[5, 1].text is None
    off = {(r.conv_id, r.turn): r.text for r in m.prune_chat(df).collect()}
    assert off[2, 1] == CONTEXT
    totals = {r.conv_id: r.tokens_pruned for r in m.request_totals(m.prune_chat(df, auto_mark_tool_results=True)).collect()}
    assert totals[1] == first.tokens_pruned and totals[4] == 0


def test_query(spark):
    df = chat(spark, [(1, 0, "user", "old"), (1, 1, "user", f"new {O}x{C}"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a")])
    assert {r.conv_id: r.query_text for r in m.chat_query(df).collect()} == {1: "new", 2: ""}


def test_block_scores(spark):
    rows = [(1, i, t, "reset password") for i, t in enumerate(["reset password", "penguins", "password"])]
    rows += [(2, i, "the of", "reset") for i in range(11)]
    df = spark.createDataFrame(rows, "b long, position int, text string, query_text string")
    got = {(r.b, r.position): (r.score, r["rank"]) for r in m.rank_and_score(df, ["b"]).collect()}
    assert got[1, 0][1] == 0 and got[1, 0][0] == pytest.approx(1.0) and got[1, 1][0] == 0.0
    assert [got[2, i] for i in range(11)] == [(1.0, i) for i in range(11)]


def test_block_content(spark):
    blocks = [
        {"type": "text", "text": "password reset?"},
        {"type": "tool_result", "tool_use_id": "x", "content": CONTEXT},
        {"type": "tool_result", "content": [{"type": "text", "text": CONTEXT, "k": {"a": 1}}, {"type": "image", "d": [1]}]},
        {"type": "image", "source": {"k": 1.5}},
        {"type": "text", "text": 5},
    ]
    df = spark.createDataFrame(
        [(1, 0, "user", json.dumps(blocks)), (1, 1, "assistant", json.dumps(f'say "x" {O}{CONTEXT}{C}')),
         (2, 0, "user", json.dumps("first")), (2, 1, "user", json.dumps(blocks[1:2]))],
        "conv_id long, turn long, role string, content string",
    )
    assert {r.conv_id: r.query_text for r in m.block_query(df).collect()} == {1: "password reset?\n5", 2: ""}
    off = {(r.conv_id, r.turn): json.loads(r.content) for r in m.prune_block_messages(df).collect()}
    assert off[1, 0] == blocks
    on = {(r.conv_id, r.turn): r for r in m.prune_block_messages(df, auto_mark_tool_results=True).collect()}
    new = json.loads(on[1, 0].content)
    assert new[0] == blocks[0] and new[3:] == blocks[3:] and new[1]["tool_use_id"] == "x"
    assert new[1]["content"].count("penguins") < 10 and "password" in new[1]["content"]
    sub = new[2]["content"]
    assert sub[0]["text"] == new[1]["content"] and sub[0]["k"] == {"a": 1} and sub[1] == {"type": "image", "d": [1]}
    assert json.loads(on[1, 1].content).startswith('say "x" reset') and on[1, 0].tokens_pruned > 0
    # A last turn of tool results only has no query: just the floors keep chunks.
    assert json.loads(on[2, 1].content)[0]["content"].count("\n\n") == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, 0, "user", f"password? {O}{CONTEXT}{C}") for i in range(3)] + [(i, 1, "tool", CONTEXT) for i in range(3)]
    flat = chat(spark, rows)
    requests = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).select(
        "conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages")
    )
    requests.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    prune_stream(stream, write, str(tmp_path / "ck"), auto_mark_tool_results=True).awaitTermination(120)
    got = spark.read.parquet(out).drop("batch")
    want = m.prune_chat(flat, auto_mark_tool_results=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_requests_are_never_lost(spark):
    from gleaner.streaming.messages import explode_requests

    mark = f"{O}alpha beta\n\ngamma delta{C}"
    said = spark.createDataFrame([(1, 0, "user", "alpha?")], "conv_id long, turn long, role string, text string")
    system = spark.createDataFrame([(1, mark), (2, mark)], "conv_id long, text string")
    got = m.prune_chat(said, system=system, preset="no such preset").collect()
    assert sorted((r.conv_id, r.turn) for r in got) == [(1, -1), (1, 0), (2, -1)]
    requests = spark.createDataFrame([(1, [("user", "a")]), (2, [])], "conv_id long, messages array<struct<role:string,text:string>>")
    assert sorted((r.conv_id, r.turn) for r in explode_requests(requests).collect()) == [(1, 0), (2, None)]
