"""Preference formatting: common prefixes, spans, odd conversations, the query against its SQL."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from skimmer.llm import preferences as P

SCHEMA = "pair int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"


def test_pairs(spark):
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no é")
    rows = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, [u], [u, a, u]), (4, [], [a]), (5, None, None), (6, [a], [b])]
    got = {r["pair"]: r for r in P.preference_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k]["n_common"] for k in range(1, 7)] == [1, 2, 1, 0, 0, 0]
    r = got[1]
    assert r["prompt"] == "<|start|>user\nhi<|end|>\n" and r["chosen_completion"] == "<|start|>assistant\nyes<|end|>\n"
    begin, end = map(int, r["rejected_spans"].split(":"))
    assert r["rejected_completion"][begin:end] == "no é<|end|>\n"
    assert got[2]["chosen_completion"] == got[2]["rejected_completion"] == "" and got[2]["chosen_spans"] == ""
    assert got[3]["chosen_completion"] == "" and got[3]["rejected_completion"].endswith("<|start|>user\nhi<|end|>\n") and got[3]["rejected_spans"].count(":") == 1
    assert got[5]["prompt"] == "" and got[6]["prompt"] == ""
    assert P.preference_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spans_cover_only_the_assistant(spark):
    turns = [("user", "a" * 5), ("assistant", "b" * 7), ("system", ""), ("assistant", ""), ("tool", "c"), ("assistant", "dé")]
    r = P.preference_pairs(spark.createDataFrame([(1, turns, [])], SCHEMA)).first()
    shown = [r["chosen_completion"][int(x) : int(y)] for x, y in (s.split(":") for s in r["chosen_spans"].split(","))]
    assert shown == ["b" * 7 + "<|end|>\n", "<|end|>\n", "dé<|end|>\n"]


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", "y", "k"), (1, 0, "user", "x", "k"), (None, 0, None, None, None), (None, None, "assistant", "z", "k"), (2, 0, "user", "only", "k"), (3, 0, "assistant", "q", "k"), (3, 0, "assistant", "q", "k")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    convs = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in P.conversations(turns).collect()}
    assert convs == {1: [("user", "x"), ("assistant", "y")], None: [("assistant", "z"), ("", "")], 2: [("user", "only")], 3: [("assistant", "q"), ("assistant", "q")]}
    pairs = {r["conv_id"]: r for r in P.with_other_reply(P.conversations(turns)).collect()}
    assert set(pairs) == {1, None, 3}
    assert [tuple(t) for t in pairs[1]["rejected"]] == [("user", "x"), ("assistant", "q")]
    assert [tuple(t) for t in pairs[None]["rejected"]] == [("assistant", "y")]  # the next by id; what followed the reply goes
    assert [tuple(t) for t in pairs[3]["rejected"]] == [("assistant", "q"), ("assistant", "z")]


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found, wanted = P.op4_preference_chat(spark, sf_dir), con.sql(P.OP4_SQL)
    assert found.columns == wanted.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted.fetchall())


def test_long_conversation(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word "), 50).alias("text"))
    r = P.preference_pairs(P.with_other_reply(P.conversations(rows))).first()
    assert r["n_common"] == 3000 and r["chosen_completion"] == ""
