"""N-best pieces and the vector index against exhaustive search; the pipeline stage by stage."""

import random
import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from brute import jaccard_components, messy
from chartfold.llm import multiindex, piece_nbest
from chartfold.llm.queries import PIECE_MODEL, QUERIES, table
from chartfold.sources.scratch import stored

TEXT = st.lists(st.sampled_from(["a", "b", " ", "the", "is", "\n", "é", "執", "①", "er", "in"]), max_size=6).map("".join)


def every_segmentation(text):
    pieces = piece_nbest._pieces(PIECE_MODEL)
    text = piece_nbest.MARK + text.replace(" ", piece_nbest.MARK) if text else ""
    found = []

    def walk(i, score, ids):
        if i == len(text):
            found.append((score, ids))
            return
        for j in range(i + 1, len(text) + 1):
            if e := pieces.table.get(text[i:j]):
                walk(j, score + e[0], ids + e[1])
        if not pieces.table.get(text[i]):
            walk(i + 1, score + pieces.unknown, ids + tuple(pieces.byte[b] for b in text[i].encode()))

    walk(0, 0.0, ())
    return sorted(found, key=lambda f: -f[0])


def edited(ids, edits):
    ids = list(ids)
    for e in reversed(edits):
        ids[e["at"] : e["at"] + e["drop"]] = e["ids"]
    return tuple(ids)


@settings(max_examples=120, deadline=None)
@given(TEXT, st.sampled_from([1, 2, 3, 6]))
def test_nbest_equals_exhaustive_search(text, n):
    raw, score, others = piece_nbest.encode_text(text, PIECE_MODEL, n)
    ids = tuple(np.frombuffer(raw, np.int32).tolist())
    got = [(score, ids)] + [(o["score"], edited(ids, o["edits"])) for o in others]
    want = every_segmentation(text)
    assert [g[0] for g in got] == [w[0] for w in want[:n]]
    assert len(set(got)) == len(got) and set(got) <= set(want)
    assert piece_nbest.decode_ids(ids, PIECE_MODEL) == text


def test_marks_in_the_text_come_back():
    for text in ("▁", "▁a", " ▁", "a▁▁ b", "▁ ", "a ▁b▁"):
        ids = np.frombuffer(piece_nbest.encode_text(text, PIECE_MODEL)[0], np.int32)
        assert piece_nbest.decode_ids(ids, PIECE_MODEL) == text


def test_long_runs_of_equal_letters_end():
    text = "a" * 20_000
    ids, _, others = piece_nbest.encode_text(text, PIECE_MODEL, 3)
    assert len(others) == 2 and piece_nbest.decode_ids(np.frombuffer(ids, np.int32), PIECE_MODEL) == text


def test_decoding_is_that_of_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = piece_nbest.decode(piece_nbest.encode(docs, PIECE_MODEL), PIECE_MODEL).collect()
    assert len(rows) == len(texts)
    assert all(r.decoded == texts[r.doc_id] for r in rows)
    assert all(library.decode(r.ids) == r.decoded for r in rows[:100])
    broken = [library.piece_to_id(p) for p in ("<0xE5>", "▁a", "<0xFF>", "<0x41>")]
    assert piece_nbest.decode_ids(np.array(broken), PIECE_MODEL) == library.decode(broken)


def test_pieces_of_hard_rows(spark):
    df = messy(spark)
    encoded = piece_nbest.encode(df, PIECE_MODEL)
    got = piece_nbest.decode(encoded, PIECE_MODEL).collect()
    assert sorted(map(repr, ((r.doc_id, r.decoded) for r in got))) == sorted(map(repr, ((r.doc_id, r.text or "") for r in df.collect())))
    assert piece_nbest.encode(df.limit(0), PIECE_MODEL).collect() == []
    nulls = spark.createDataFrame([(None, "x"), ([], "y")], "ids array<int>, decoded string")
    assert [r.decoded for r in piece_nbest.decode(nulls, PIECE_MODEL).collect()] == [None, ""]


@pytest.mark.parametrize("a,b", [(1, 1), (1, 7), (7, 1), (6, 9)])
def test_multi_sequence_visits_the_nearest_first(a, b):
    rng = random.Random(a * b)
    x, y = sorted(rng.random() for _ in range(a)), sorted(rng.random() for _ in range(b))
    got = multiindex._multi_sequence(x, y, a * b)
    assert len(set(got)) == a * b
    assert [x[i] + y[j] for i, j in got] == pytest.approx(sorted(p + q for p in x for q in y))


@pytest.fixture(scope="module")
def vectors(spark):
    """Clouds of near copies, one of them with a third of all rows, among others that are alone."""
    rng = np.random.default_rng(6)
    rows = [rng.normal(size=16) for _ in range(300)]
    for size, spread in ((400, 0.12), (60, 0.08), (40, 0.15), (25, 0.05), (25, 0.1)):
        base = rng.normal(size=16)
        rows += [base + rng.normal(size=16) * spread for _ in range(size)]
    rows += rows[:20]  # copies
    data = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(rows)]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>").repartition(4), data


def links(data, least=0.9):
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    return near


def test_index_finds_the_links(vectors, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 64)
    df, data = vectors
    got = {r.vec_id: r for r in multiindex.near_copies(df).collect()}
    near = links(data)
    found, there = np.array([got[i].n_links for i in range(len(data))]), near.sum(axis=1)
    assert (found <= there).all() and found.sum() >= 0.95 * there.sum()
    a, b = np.nonzero(near)
    label = multiindex._labels(len(data), a, b)
    assert np.mean([got[i].component_id == label[i] for i in range(len(data))]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_every_cell_visited_finds_all(vectors, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 100)
    monkeypatch.setattr(multiindex, "LEAST_CELLS", 10_000)
    df, data = vectors
    got = {r.vec_id: r.n_links for r in multiindex.near_copies(df).collect()}
    assert [got[i] for i in range(len(data))] == links(data).sum(axis=1).tolist()


@pytest.fixture(scope="module")
def sparse(spark):
    """Vectors that are all different, but for 12 pairs just above the limit."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(12):
        aside = rng.normal(size=32)
        aside -= aside @ x[i] * x[i]
        x[5000 + i] = 0.91 * x[i] + (1 - 0.91**2) ** 0.5 * aside / np.linalg.norm(aside)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(4), data


@pytest.mark.parametrize("most", [256, 16384])
def test_rare_links_are_found(sparse, monkeypatch, most):
    monkeypatch.setattr(multiindex, "MOST_QUERIES", most)
    df, data = sparse
    near = links(data)
    got = {r.vec_id: r.n_links for r in multiindex.near_copies(df).collect()}
    found = sum(got.values())
    assert near.sum() == 24 and all(got[i] <= near[i].sum() for i in got) and found >= 0.98 * near.sum()


def test_queries_are_added_until_enough_have_a_link(sparse):
    df, _ = sparse
    vectors = stored(df.selectExpr("vec_id AS id", "embedding AS vec"), "test")
    index = multiindex.fit(vectors, 32, 8192)
    got = multiindex.visits_for(vectors, index, 0.9, 0.98, 256)
    assert got.queries == 6000 and got.linked == 24 and got.recall >= 0.98
    assert got.cells > multiindex.LEAST_CELLS


def test_recall_is_reported_and_kept_beyond_any_number_of_cells(sparse, monkeypatch):
    df, data = sparse
    told = []
    # every pair is as far off as can be: the places of the others come last
    monkeypatch.setattr(multiindex.MultiIndex, "places", lambda self, x, cells: np.full(len(x), len(self.first) ** 2 - 1))
    got = {r.vec_id: r.n_links for r in multiindex.near_copies(df, report=told.append).collect()}
    assert [got[i] for i in range(len(data))] == links(data).sum(axis=1).tolist()
    assert len(told) == 1 and told[0].all_pairs and told[0].recall == 1.0 and told[0].linked == 24


def test_searched_words_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(piece_nbest, "REMEMBERED_BYTES", 3000)
    asked = []
    known = piece_nbest.Remembered(lambda key: asked.append(key) or [(0.5, (1, 2, 3))])
    keys = [("w" * n, 0.0, (1,) * n) for n in (1, 10, 500, 2, 10, 1, 10)]
    assert all(known[k] == [(0.5, (1, 2, 3))] for k in keys)
    assert keys[2] not in known and keys[2] not in known.old and known.held <= 3000
    assert asked.count(keys[1]) == 1  # it came over from the old table


def test_recall_on_an_indexed_table(spark):
    """All embeddings of sf0.1 and two noisy copies of each: more than are compared pair by pair."""
    rows = sorted((r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect())
    rng, x = np.random.default_rng(4), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copies = [x + rng.normal(size=x.shape) * s / x.shape[1] ** 0.5 for s in (0.25, 0.45)]
    data = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, *copies]))]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(8)
    told = []
    got = {r.vec_id: r.n_links for r in multiindex.near_copies(df, report=told.append).collect()}
    assert len(told) == 1 and not told[0].all_pairs
    there = links(data).sum(axis=1)
    found = np.array([got[i] for i, _ in data])
    assert there.sum() > 2 * len(x) and (found <= there).all() and found.sum() >= 0.95 * there.sum()


@pytest.mark.parametrize("sent", [0, 1000])
def test_hot_cells_are_dealt_out_by_their_blocks(spark, monkeypatch, sent):
    """A cell of many vectors goes to as many tasks as it has pairs of blocks."""
    monkeypatch.setattr(multiindex, "BLOCK", 16)
    monkeypatch.setattr(multiindex, "HOT_SENT", sent)
    rows = [(i, i, 1, [1.0, float(i)], i % 300 and 7 or i) for i in range(600)]
    members = spark.createDataFrame(rows, "id bigint, own bigint, weight bigint, vec array<double>, cell bigint")
    members = members.withColumns({"own": F.col("cell"), "cells": F.array("cell")})
    found = multiindex._verify(members, 0.9, "bigint")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(cell#\d+L, i#\d+, j#\d+", text)


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 0.0]),
            (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS id", "2 AS vec", "3 AS ok", "4 AS n_links")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in multiindex.near_copies(df).collect())
    assert got == [(0, 0, None, False), (1, 4, 1, True), (2, 4, 1, False)] + [(i, 0, i, True) for i in range(3, 10)] + [
        (10, 4, 1, False), (11, 4, 1, False), (11, 4, 1, False), (12, 0, 12, True)]
    assert multiindex.near_copies(df.limit(0)).collect() == []


def test_vectors_of_every_length_are_linked(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 32)
    rng, data = np.random.default_rng(8), []
    for length, n in ((12, 500), (8, 300), (5, 40), (3, 2)):
        x = np.repeat(rng.normal(size=(n // 2, length)), 2, axis=0) + rng.normal(size=(n, length)) * 0.05
        data += [(len(data) + i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in multiindex.near_copies(df).collect()}
    for length in (12, 8, 5, 3):
        part = [(i, v) for i, v in data if len(v) == length]
        there, found = links(part).sum(axis=1), np.array([got[i] for i, _ in part])
        assert there.sum() >= len(part) and (found <= there).all() and found.sum() >= 0.97 * there.sum()


def test_pipeline_stage_by_stage(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf), "stage"))
        assert name == "piece encoding" or kept[-1].columns == columns
    rules, good, single, mixed, pieces = ([tuple(r) for r in k.collect()] for k in kept[1:])
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert set(good) <= set(rules) <= {tuple(r) for r in docs.collect()}
    left = [labels[r[0]] for r in good if r[0] in labels]
    assert left.count(0) <= 0.01 * len(left) and left.count(1) >= 0.9 * list(labels.values()).count(1)
    groups = jaccard_components([(r[0], r[1]) for r in good], 5, 80)
    assert sorted(single) == sorted(r for r in good if groups[r[0]][1] == r[0])
    assert set(mixed) <= set(single) and max(map(mixed.count, set(mixed))) <= 3
    assert sorted(r[0] for r in pieces) == sorted(r[0] for r in mixed)
    assert kept[-1].filter(~F.col("round_trip")).count() == 0
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "score")
    again = kept[-1].select("doc_id", "score")
    assert whole.exceptAll(again).count() == 0 == again.exceptAll(whole).count()


def test_pipeline_of_hard_rows(spark, tmp_path):
    df = messy(spark).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (7, 1), (8, 0), (None, 0)], "doc_id bigint, quality int").withColumn("toxic", F.lit(0)).write.parquet(
        str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).filter(~F.col("round_trip")).count() == 0
    empty = tmp_path / "empty"
    df.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
