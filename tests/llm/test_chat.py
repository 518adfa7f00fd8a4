"""Chat examples: exact round trip of hostile texts, the loss stretch, and the query against its SQL and against Python."""

from __future__ import annotations

import hashlib
import re

import duckdb
from conftest import SF

from gridscribe.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, `a.b` string, pos int"
HOSTILE = ["\\", "\\\\", "</turn>", "</turn>\n", "<\\/turn>", "### user\nhi</turn>\n", "####", "\\#\\#\\#", "#" * 7, "<", "</turn", "x\\", "\n", "", None, "é😀</turn>\n### ", "%0A%25"]


def test_hostile_texts_come_back(spark):
    rows = [(i, t, "assistant" if t % 2 else "user", HOSTILE[(i + t) % len(HOSTILE)], "z", 1) for i in range(len(HOSTILE)) for t in range(4)]
    rows += [(100, 0, "odd\nrole%0A", "a", None, None), (100, 1, None, "b", None, None), (100, 2, "", "c", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in chat.read_back(chat.prefix_targets(df)).collect()}
    for i in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == i]
        assert [tuple(t) for t in got[i]["_turns"]] == mine
        assert "".join(got[i]["_replies"]) == "".join(t for role, t in mine if role == "assistant")


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "one"), (1, 3, "user", "v"), (1, 4, "assistant", "two</turn>"), (1, 5, "user", "w"), (2, 0, "user", "alone")]
    rows = [(*r, None, 0) for r in rows]
    got = chat.prefix_targets(spark.createDataFrame(rows[::-1], SCHEMA)).orderBy("conv_id", "_example").collect()
    head = "### system\ns</turn>\n### user\nu</turn>\n### assistant\none</turn>\n"
    full = head + "### user\nv</turn>\n### assistant\ntwo<\\/turn></turn>\n"
    assert [r["_text"] for r in got] == [head, full, full + "### user\nw</turn>\n", "### user\nalone</turn>\n"]
    assert [r["_text"][r["_loss_from"] : r["_loss_to"]] for r in got] == ["one", "two<\\/turn>", "", ""]
    marks = re.findall(r"### |</turn>\n", got[2]["_text"])
    assert marks == ["### ", "</turn>\n"] * 6


def test_odd_rows(spark):
    rows = [(None, None, None, None, "x", 1), (None, 1, "assistant", "r", "x", 1), (3, 1, "assistant", "same", "x", 1), (3, 1, "assistant", "same", "x", 1), (3, None, "user", "last", "x", 1), (4, 0, "assistant", "é" * 200_000, "x", 1)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.prefix_targets(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [tuple(t) for t in got[None]["_turns"]] == [("assistant", "r"), ("", "")] and got[None]["_replies"] == ["r"]
    assert [t["text"] for t in got[3]["_turns"]] == ["same", "same", "last"] and got[3]["_replies"] == ["same", "same"]
    assert got[4]["_replies"] == ["é" * 200_000]
    assert chat.prefix_targets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force(spark):
    turns = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    turns += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    by = {}
    for c, t, role, text in sorted(turns, key=lambda r: (r[0], r[1])):
        by.setdefault(c, []).append((role, text or ""))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for c, mine in by.items():
        reply = "".join(t for r, t in mine if r == "assistant")
        want[c] = (len(mine), digest("".join(f"{r}\n{t}\n" for r, t in mine)), len(reply), digest(reply))
    rows = chat.op11_chat_formatting(spark, SF).collect()
    assert len(rows) == len(want) and {r[0]: tuple(r[1:5]) for r in rows} == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in rows)
