"""The Jaccard join and the components of its links against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from brute import Roots, jaccard_components, messy
from chartfold.llm import jaccard
from chartfold.llm.components import components
from chartfold.llm.queries import table


def outcome(df, k, percent):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k=k, percent=percent).collect()}


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_all_documents_equal_brute_force(spark, sf, k, percent):
    docs = table(spark, sf, "documents")
    assert outcome(docs, k, percent) == jaccard_components(texts(docs), k, percent)


@pytest.fixture(scope="module")
def edited(spark):
    """Families of texts that differ in a few words: similarities on both sides of the limit."""
    rng, rows = random.Random(8), []
    for family in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 9, 10, 19, 60, 200]))]
        for _ in range(25):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                other[rng.randrange(len(other))] = f"v{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(other)))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


@pytest.mark.parametrize("depth,small,dense", [(1, 1000, 16), (2, 1, 0), (3, 4, 0), (3, 1, 10**6)])
def test_every_way_through_is_exact(edited, monkeypatch, depth, small, dense):
    """Signatures of a few sets, of many that are screened in blocks, and of many that are compared whole."""
    plan = jaccard.Bands.plan
    monkeypatch.setattr(jaccard.Bands, "plan", lambda self, band: (plan(self, band)[0], depth))
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 10)
    monkeypatch.setattr(jaccard, "SCREEN_SETS", 5)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "SENT", 0 if depth == 2 else 1_000_000)
    assert outcome(edited, 3, 90) == jaccard_components(texts(edited), 3, 90)


@pytest.mark.parametrize("percent", [80, 90, 95, 100])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for depth in (1, 2, 3):
        bands = jaccard.Bands(percent)
        plan = bands.plan
        bands.plan = lambda band: (plan(band)[0], depth)
        for n in [1, 2, 5, 9, 10, 11, 30, 100, 400]:
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
                drop = int(rng.integers(0, n // 4 + 1))
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    assert set(jaccard.signatures(a, bands)) & set(jaccard.signatures(b, bands)), (n, len(b), both)


def test_signatures_by_expected_cost():
    few, many = jaccard.Bands(80), jaccard.Bands(80, {b: 10**9 for b in range(60)})
    band = few.of(300)
    assert few.plan(band)[1] == 1 and many.plan(band)[1] == 3
    assert jaccard.Bands(90).most_apart(0) == 0


def test_blocks_compare_exactly(monkeypatch):
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randint(0, 60) for _ in range(rng.randint(1, 40))], np.int64)) for _ in range(30)]
    linked = jaccard._linked(sets[:12], sets[12:], 60)
    for i, a in enumerate(sets[:12]):
        for j, b in enumerate(sets[12:]):
            both = len(set(a.tolist()) & set(b.tolist()))
            assert linked[i, j] == (100 * both >= 60 * (len(a) + len(b) - both))


def test_hard_rows(spark):
    df = messy(spark)
    got = jaccard.jaccard_components(df, k=3, percent=90).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[5] == 1 and by[9] == by[10] == 9
    assert [by[i] for i in (2, 3, 4, 6, 7, 8)] == [2, 3, 4, 6, 7, 8] and by[None] is None
    assert {r.doc_id: r.n_shingles for r in got}[3] == 0
    assert jaccard.jaccard_components(df.limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    df = messy(spark)
    kept = jaccard.keep_one(df, k=3, percent=90)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert jaccard.keep_one(df.limit(0)).collect() == []
    twice = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (3, "other words in here"), (4, "a b c d")], "doc_id int, text string")
    assert [r.doc_id for r in jaccard.keep_one(twice).collect()] == [3]


@pytest.mark.parametrize("n,m", [(50, 40), (300, 290)])
def test_components(spark, n, m):
    rng = random.Random(m)
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    links += [(1000 + i, 1001 + i) for i in range(40)]  # a long chain
    root = Roots(x for e in links for x in e)
    for a, b in links:
        root.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got | {x: x for x in root.parent if x not in got} == {x: root(x) for x in root.parent}
    assert not alone & set(got)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
