"""Ranked lexical search against a plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brute import lower, messy
from chartfold.llm import lexical
from chartfold.llm.queries import QUERIES, table
from chartfold.sources import scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall(lower(text or "")))


def ranked(docs, queries, k=20):
    """{(item, rank): (doc_id, score)} of (id, text) rows."""
    held = [(i, t) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(held), sum(sum(t.values()) for _, t in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, text in queries:
        found = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in terms(text).items() if t in c
            )
            if s > 0:
                found.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank] = (None if none else i, -s)
    return out


def result(df):
    rows = df.collect()
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_on_all_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert result(QUERIES["op12_lexical_search"](spark, sf)) == ranked(docs, items)


LETTERS = "the of and a river bank old fox ünder 12 x1 dog cat".split()


def made_up(rng, n):
    docs = [(rng.randrange(400), " ".join(rng.choices(LETTERS, range(13, 0, -1), k=rng.randint(0, 12)))) for _ in range(n)]
    queries = [(i, " ".join(rng.choices([*LETTERS, "unknown"], k=rng.randint(0, 6)))) for i in range(30)]
    return docs, queries


@pytest.mark.parametrize("short", [1, 4, 10**9])
@pytest.mark.parametrize("window", [1, 7, 1000])
def test_lists_are_summed_or_skipped_through(monkeypatch, short, window):
    """All lists long, some, or all short; windows of one document, of some, of all."""
    monkeypatch.setattr(lexical, "SHORT", short)
    monkeypatch.setattr(lexical, "WINDOW", window)
    docs, queries = made_up(random.Random(window), 500)
    blocks = []
    for lo in range(0, len(docs), 90):
        part = [d for d in docs[lo : lo + 90] if terms(d[1])]
        postings = lexical.Postings(lexical.Texts(pa.array([t for _, t in part])))
        half = pa.array([i for i, _ in part])
        blocks.append(pa.RecordBatch.from_arrays(lexical._block([(half, postings)]), lexical.INDEX))
    n_docs = sum(len(b.column(0)[0]) for b in blocks)
    df = Counter(t for _, d in docs for t in terms(d))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    n_terms = sum(sum(terms(d).values()) for _, d in docs)
    searcher = lexical.Searcher([lexical.query_terms(q) for _, q in queries], weight, n_docs, n_terms, 5)
    got = {(q, rank): (i, -s) for q, best in enumerate(searcher.run(iter(blocks))) for rank, (s, i) in enumerate(best.rows, 1)}
    assert got == ranked(docs, queries, k=5)


def test_weak_lists_name_no_candidates(monkeypatch):
    """Once the best are found, a list whose bound is below them is not gone through."""
    monkeypatch.setattr(lexical, "SHORT", 10**9)
    rare, common = (np.arange(0, 50), np.full(50, 1000)), (np.arange(0, 10_000), np.full(10_000, 3))
    its, best = lexical.Iterators([common, rare], 10_000), lexical.Best(20)
    assert its.bound == [3, 1000]
    seen = []
    add = best.add
    best.add = lambda score, doc, ids: (seen.append(len(doc)), add(score, doc, ids))
    lexical.top_of_block(its, 10_000, best, list(range(10_000)))
    assert [i for _, i in best.rows] == list(range(20)) and best.least == 1003
    assert len(seen) == 1  # the windows after the rare documents are skipped


def test_batches_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_BYTES", 60)
    docs, queries = made_up(random.Random(5), 600)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = result(lexical.search(lexical.build_index(df), spark.createDataFrame(queries, "item_id int, text string"), k=5))
    assert got == ranked(docs, queries, k=5)


def test_blocks_of_one_document(monkeypatch, spark):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 1)
    docs = [(i, f"word{i % 3} common") for i in range(9)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    queries = [(0, "word1 common"), (1, "COMMON common word2")]
    got = result(lexical.search(index, spark.createDataFrame(queries, "item_id int, text string")))
    assert got == ranked(docs, queries)


def test_blocks_are_read_one_by_one(spark, monkeypatch):
    """A reader lays out a row group, and a worker an Arrow batch: a block each."""
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 1)
    monkeypatch.setattr(scratch, "BATCH_BYTES", 1)
    task = lexical._task

    def checked(*args):
        run = task(*args)

        def one_by_one(blocks):
            def each():
                for b in blocks:
                    assert b.num_rows == 1
                    yield b

            return run(each())

        return one_by_one

    monkeypatch.setattr(lexical, "_task", checked)
    before = spark.conf.get(scratch.ARROW_BYTES)
    docs, queries = made_up(random.Random(8), 40)
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert max(f.num_rows for f in files) > 1 and all(f.num_row_groups == f.num_rows for f in files)
    assert result(lexical.search(index, spark.createDataFrame(queries, "item_id int, text string"))) == ranked(docs, queries)
    assert spark.conf.get(scratch.ARROW_BYTES) == before


def test_hard_rows(spark):
    df = messy(spark)
    queries = [(1, "The lazy fox"), (2, None), (3, ""), (4, " *** "), (None, "one WORD xx größere x"), (6, "no id here"), (7, "x" * 60_000)]
    asked = spark.createDataFrame(queries, "item_id int, text string").selectExpr("*", "1 AS q", "2 AS id", "3 AS score")
    got = lexical.search(lexical.build_index(df), asked).collect()
    want = ranked([(r.doc_id, r.text) for r in df.collect()], queries)
    assert sorted(map(repr, [((r.item_id, r["rank"]), (r.doc_id, r.score)) for r in got])) == sorted(map(repr, want.items()))
    assert lexical.search(lexical.build_index(df.limit(0)), asked).collect() == []
    assert lexical.search(lexical.build_index(df), asked.limit(0)).collect() == []


def test_text_ids(spark):
    docs = [("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "two")]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id string, text string"))
    got = lexical.search(index, spark.createDataFrame([("q", "one")], "item_id string, text string"))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == ["a", "b", None]
