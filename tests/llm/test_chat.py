"""Chat formatting: an exact round trip of everything that goes in."""

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from chartfold.llm import chat
from chartfold.llm.queries import QUERIES, table

TEXT = st.lists(st.sampled_from(["#", "###", "\\", "</turn>", "<", "/turn>", " ", "\n", ": ", "é", "🙂", "a"]), max_size=9).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(TEXT, st.just("assistant")), TEXT), min_size=1, max_size=6))
def test_every_turn_comes_back(turns):
    roles, texts = (pa.array(x, pa.string()) for x in zip(*turns))
    formatted, spans, n = chat.assemble(roles, texts, np.array([0, len(turns)]), "assistant")
    text = formatted[0].as_py()
    assert chat.parse(text) == turns and n[0].as_py() == len(turns)
    loss = [chat.unescape(text[s["start"] : s["end"]]) for s in spans[0].as_py()]
    assert loss == [t for r, t in turns if r == "assistant"]


def test_query_equals_brute_force(spark, sf):
    groups = defaultdict(list)
    for r in sorted(tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()):
        groups[r[0]].append((r[2], r[3] or ""))
    tricky = "\\### Assistant: </turn> ok"
    groups[-7] = [("user", tricky), ("assistant", tricky)]
    got = {r.conv_id: r for r in QUERIES["op8_chat_formatting"](spark, sf).collect()}
    assert set(got) == set(groups)
    for i, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert tuple(got[i])[1:5] == (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
        )
        assert got[i].formatted_chars >= len(whole)


def test_hard_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 3, "assistant", "x" * 300_000),
            (None, 1, "assistant", "b"), (None, 0, "user", "a"), (2, 1, "user", "é\n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS id", "2 AS formatted", "3 AS n_turns", "4 AS loss_spans").repartition(4)
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert chat.parse(got[1].formatted) == [("", ""), ("user", ""), ("user", "")]
    assert chat.parse(got[2].formatted) == [("user", "é\n"), ("assistant", "x" * 300_000)]
    assert chat.parse(got[None].formatted) == [("user", "a"), ("assistant", "b")]
    assert chat.read_back(chat.format_chat(df)).count() == 3
    assert chat.read_back(chat.format_chat(df.limit(0))).collect() == []


def test_conversations_that_run_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).selectExpr("id DIV 100 AS conv_id", "id AS turn", "'user' AS role", "string(id) AS text")
        got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chat(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {c: [("user", str(c * 100 + i)) for i in range(100)] for c in range(5)}


def test_conversations_are_put_together_in_slices_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE_BYTES", 40)
    df = spark.range(60).selectExpr("id DIV 3 AS conv_id", "id AS turn", "'user' AS role", "repeat('x', int(id)) AS text").coalesce(1)
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chat(df).collect()}
    assert got == {c: [("user", "x" * (3 * c + i)) for i in range(3)] for c in range(20)}
