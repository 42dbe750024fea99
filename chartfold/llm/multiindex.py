"""Near copies among embeddings with an inverted multi-index.

The two halves of a vector have codebooks of their own; a pair of centroids is a
cell of the product grid, and every vector lies in the cell of its nearest pair.
A multi-sequence traversal visits the cells around a vector in the order of their
distance.  How many are visited comes from a set of query vectors that are
compared with all vectors, as many as it takes to find enough links: as many cells
as the target recall takes.  Whatever meets in
a cell is verified exactly.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartfold.llm.components import components
from chartfold.llm.textbatch import column
from chartfold.sources.scratch import stored

#: a cell holds about so many vectors, as far as the sample can fit codebooks
PER_CELL = 16
LEAST_CELLS = 4
#: so many queries with a link settle how many cells are visited; to find them, up to so many queries
LINKED = 64
MOST_QUERIES = 16384
#: made-up pairs that settle it where links are too rare
MADE_UP = 2048
#: members of a cell that are compared with one another in one block
BLOCK = 512
#: up to so many cells of several blocks are sent to all tasks, 12 bytes each
HOT_SENT = 1_000_000


def _unit(array: pa.Array, size: int) -> np.ndarray:
    x = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` centroids by Lloyd's rounds from rows spread over ``x``; empty ones stay where they are."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :]


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the halves; a cell is a number, ``first * k + second``."""

    first: np.ndarray
    second: np.ndarray

    @property
    def size(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first: the first is its own."""
        half, k = self.first.shape[1], len(self.second)
        a, b = _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)
        n = min(n, a.shape[1] * k)
        order_a, order_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        out = np.empty((len(x), n), np.int64)
        for r in range(len(x)):
            ia, ib = order_a[r], order_b[r]
            da, db = a[r, ia].tolist(), b[r, ib].tolist()
            out[r] = [ia[i] * k + ib[j] for i, j in _multi_sequence(da, db, n)]
        return out

    def places(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells of the whole grid come before ``cells[r]`` around row ``r``; ties come before."""
        half, k = self.first.shape[1], len(self.second)
        out = np.empty(len(x), np.int64)
        for lo in range(0, len(x), 1024):
            a, b = _distances(x[lo : lo + 1024, :half], self.first), _distances(x[lo : lo + 1024, half:], self.second)
            for r, cell in enumerate(cells[lo : lo + 1024].tolist()):
                upto = a[r, cell // k] + b[r, cell % k] + 1e-12
                out[lo + r] = np.searchsorted(np.sort(b[r]), upto - a[r], "right").sum() - 1
        return out


def _multi_sequence(a: list[float], b: list[float], n: int) -> list[tuple[int, int]]:
    """The ``n`` pairs of places with the least sums of two sorted lists, least first.

    A pair is looked at once both pairs before it, in either list, are taken.
    """
    heap, out = [(a[0] + b[0], 0, 0)], []
    taken: list[int] = [0] * len(a)  # pairs taken of each row
    while heap and len(out) < n:
        _, i, j = heappop(heap)
        out.append((i, j))
        taken[i] = j + 1
        if i + 1 < len(a) and taken[i + 1] == j:
            heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or taken[i - 1] > j + 1):
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def fit(vectors: DataFrame, size: int, sample: int) -> MultiIndex:
    """Codebooks from at most ``sample`` vectors, those with the least hash of their id."""
    n = vectors.count()
    rows = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample)
    x = _unit(pa.array([r["vec"] for r in rows.collect()], pa.list_(pa.float64())), size)
    k = max(1, min(int((n / PER_CELL) ** 0.5), len(x) // 8, 1024))
    half = size // 2
    return MultiIndex(_codebook(x[:, :half], k), _codebook(x[:, half:], k))


@dataclass(frozen=True)
class Visits:
    """How many cells a vector visits, and what the number rests on."""

    cells: int
    recall: float | None  # of the pairs that the queries have, at that number; None if they have none
    linked: int  # queries that have a pair
    queries: int
    all_pairs: bool = False  # too many cells: all pairs are compared instead, and the recall is 1


def visits_for(vectors: DataFrame, index: MultiIndex, least: float, target: float, queries: int) -> Visits:
    """How many cells a vector has to visit for the ``target`` recall.

    ``queries`` vectors are compared with all others; for each similar one it is
    noted how many cells come before its own.  The recall is that of all pairs
    and that of the average query, whichever is lower.  While fewer than
    ``LINKED`` queries have a similar vector there are four times as many
    queries, up to ``MOST_QUERIES`` or all vectors.  Where links are so rare
    that this does not settle it, the number is also that of made-up pairs.
    """
    n = vectors.count()
    while True:
        chosen = vectors.select("id", "vec").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(queries).collect()
        x = _unit(pa.array([r["vec"] for r in chosen], pa.list_(pa.float64())), index.size)
        held = _places(vectors, index, [r["id"] for r in chosen], x, least)
        linked = len(np.unique(held[:, 0]))
        if linked >= LINKED or len(x) >= min(n, MOST_QUERIES):
            break
        queries = min(4 * max(queries, 1), MOST_QUERIES)
    grid = len(index.first) * len(index.second)
    cells = LEAST_CELLS
    places, recall = _recall(held)
    if linked:
        enough = np.flatnonzero(recall >= target - 1e-9)
        cells = max(cells, int(places[enough[0]]) + 1)
    if linked < LINKED and len(x) < n:
        cells = max(cells, _made_up(index, x[:MADE_UP], least, target))
    cells = min(cells, grid)
    reached = np.searchsorted(places, cells)  # places before the cells that are visited
    return Visits(cells, (float(recall[reached - 1]) if reached else 0.0) if linked else None, linked, len(x))


def _places(vectors: DataFrame, index: MultiIndex, ids: list, x: np.ndarray, least: float) -> np.ndarray:
    """(query, place, pairs): in how many pairs of the query ``place`` cells come before the other's own."""
    size, step = index.size, max(1, (1 << 22) // max(len(x), 1))

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, other = _unit(column(batch, "vec"), size), column(batch, "id").to_pylist()
            own, met = index.cells(y, 1)[:, 0], []
            for lo in range(0, len(y), step):
                q, j = np.nonzero(x @ y[lo : lo + step].T >= least)
                differ = np.array([ids[a] != other[lo + b] for a, b in zip(q.tolist(), j.tolist())], bool)
                met.append(np.stack([q[differ], own[lo + j[differ]]], axis=1))
            pairs, count = np.unique(np.concatenate(met), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(index.places(x[pairs[:, 0]], pairs[:, 1])), pa.array(count)],
                ["query", "place", "pairs"],
            )

    found = vectors.select("id", "vec").mapInArrow(compare, "query bigint, place bigint, pairs bigint")
    held = found.groupBy("query", "place").agg(F.sum("pairs")).collect()  # at most a row per query and cell
    return np.array(sorted(tuple(r) for r in held), np.int64).reshape(-1, 3)


def _recall(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in their order, and the recall once the cells up to each are visited."""
    query, place, pairs = held[np.argsort(held[:, 1], kind="stable")].T
    of_query = np.bincount(query, pairs, 1)[query] if len(query) else pairs
    share = pairs / of_query / max(len(np.unique(query)), 1)
    return place, np.minimum(np.cumsum(pairs) / max(pairs.sum(), 1), np.cumsum(share))


def _made_up(index: MultiIndex, x: np.ndarray, least: float, target: float) -> int:
    """Cells to visit for pairs at the greatest distance that ``least`` allows.

    Each of ``x`` is turned by the angle of ``least``, once in a random
    direction and once towards another of ``x``, as far as pairs can be apart;
    the number is that of the kind that takes more.
    """
    cells = 0
    for to in (np.random.default_rng(0).normal(size=x.shape), np.roll(x, 1, axis=0)):
        aside = to - (to * x).sum(1, keepdims=True) * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        y = least * x + max(0.0, 1 - least * least) ** 0.5 * aside
        places = np.sort(index.places(x, index.cells(y, 1)[:, 0]))
        cells = max(cells, int(places[int(np.ceil(target * len(places))) - 1]) + 1)
    return cells


def _members(vectors: DataFrame, index: MultiIndex, visits: int, kind: str, item: str) -> DataFrame:
    """(cell, own, id, weight, vec, cells): every vector in every cell that it visits; ``cells`` only in its own."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = index.cells(_unit(column(batch, "vec"), index.size), visits)
            n, row = cells.shape[1], np.repeat(np.arange(len(cells)), cells.shape[1])
            take = pa.array(row)
            ends = -(-np.arange(len(row) + 1) // n) * n  # the first of a vector's rows has all its cells
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel()), pa.array(cells[row, 0]), column(batch, "id").take(take),
                 column(batch, "weight").take(take), column(batch, "vec").take(take),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(cells.ravel()))],
                ["cell", "own", "id", "weight", "vec", "cells"],
            )

    schema = f"cell bigint, own bigint, id {kind}, weight bigint, vec array<{item}>, cells array<bigint>"
    return vectors.mapInArrow(run, schema)


def _together(vectors: DataFrame) -> DataFrame:
    """Like :func:`_members`, with one cell per length, so that all pairs are compared."""
    cell = F.size("vec").cast("bigint")
    return vectors.select(cell.alias("cell"), cell.alias("own"), "id", "weight", "vec", F.array(cell).alias("cells"))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row is joined with, over links ``a`` to ``b``."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(members: DataFrame, least: float, kind: str) -> DataFrame:
    """(id, links, to): per block, how much each vector is linked, and one that it is joined with.

    A pair is looked at where one of the two lies in the cell.  If each visits
    the other's cell, the pair counts in the cell with the lower number.  Cells
    of several blocks are looked up in a table that is sent to all tasks while it
    is small, and joined by a shuffle beyond that.
    """

    def compare(rows: pa.Table) -> pa.Table:
        ids = rows["id"].combine_chunks()
        rank = np.argsort(np.array(ids.to_pylist()), kind="stable")
        rows = rows.take(pa.array(rank))
        ids, cell = rows["id"].combine_chunks(), rows["cell"][0].as_py()
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        block, own, weight = (rows[c].to_numpy() for c in ("block", "own", "weight"))
        x = _unit(rows["vec"].combine_chunks(), len(rows["vec"][0]))
        home = own == cell
        visited = rows["cells"].combine_chunks().flatten().to_numpy().reshape(home.sum(), -1) if home.any() else own[:, None]
        at = np.cumsum(home) - 1
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(x[left] @ x[right].T >= least)
        a, b = left[a], right[b]
        fit = (a < b) if i == j else np.ones(len(a), bool)
        fit &= home[a] | home[b]
        a, b = a[fit], b[fit]
        # of two cells that both see the pair, the lower one counts it
        here, there = np.where(home[a], a, b), np.where(home[a], b, a)
        both, step = np.zeros(len(a), bool), max(1, (1 << 22) // visited.shape[1])
        for lo in range(0, len(a), step):
            part = slice(lo, lo + step)
            both[part] = (visited[at[here[part]]] == own[there[part], None]).any(axis=1)
        fit = ~both | (own[there] >= cell)
        a, b = a[fit], b[fit]
        links = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
        label = _labels(len(x), a, b)
        some = np.flatnonzero(links > 0)
        return pa.table([ids.take(pa.array(some)), pa.array(links[some].astype(np.int64)),
                         ids.take(pa.array(label[some]))], names=["id", "links", "to"])

    hot = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k")).filter("k > 1")
    hot = stored(hot, "hot-cells")
    small = hot.count() <= HOT_SENT
    dealt = members.join(F.broadcast(hot) if small else hot, "cell", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    sent = dealt.select("cell", "own", "id", "weight", "vec", "cells", "block", other).withColumns({
        "i": F.greatest("block", "other"), "j": F.least("block", "other"),
    }).drop("other")
    # a join by cell would do for the groups, too, and leave a hot cell in one task
    sent = sent.repartition("cell", "i", "j")
    return sent.groupBy("cell", "i", "j").applyInArrow(compare, f"id {kind}, links bigint, to {kind}")


def near_copies(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    least: float = 0.9,
    target: float = 0.98,
    sample: int = 8192,
    queries: int = 256,
    report: Callable[[Visits], None] | None = None,
) -> DataFrame:
    """One row per row of ``vectors``: ``id``, ``n_links``, ``component_id``, ``kept``.

    Two vectors are linked if their cosine, in double precision, is ``least`` or
    more and the index lets them meet; ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest id that links reach, and the row
    with it is ``kept``.

    Equal vectors stand for one another and count as often as there are rows.
    Vectors that are null, zero, or have null, infinite or undefined components
    link with nothing, like rows without an id, which are not kept.  Vectors of
    different lengths are not linked; each length has an index of its own, those
    of few vectors are compared in blocks.  Rows that share an id are one node,
    whose links add up.  Codebooks are fit on at most ``sample`` vectors; every
    vector is indexed, or compared with all others in blocks where this takes no
    more than visiting cells.  ``report`` gets the :class:`Visits` with their
    recall, which are logged, too, once for each length that has an index.  Other columns are not looked at.
    """
    kind, type_ = vectors.schema[id].dataType.simpleString(), vectors.schema[vector].dataType
    item = type_.elementType.simpleString()
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vec"))
    ok = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ok = F.col("id").isNotNull() & F.coalesce(ok & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("ok", ok)

    stand = stored(
        rows.filter("ok").groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "vectors"
    )
    # an index is for lengths that take more blocks than the least number of cells
    size = F.size("vec")
    large = stand.groupBy(size.alias("size")).count().filter(F.col("count") > LEAST_CELLS * BLOCK).orderBy("size").collect()
    whole, parts = [], []
    for r in large:
        same = stand.filter(size == r["size"])
        index = fit(same, r["size"], sample)
        visits = visits_for(same, index, least, target, queries)
        if visits.cells > -(-r["count"] // BLOCK):
            visits = replace(visits, recall=1.0, all_pairs=True)
            whole.append(r["size"])
        else:
            parts.append(_verify(_members(same, index, visits.cells, kind, item), least, kind))
        logging.getLogger(__name__).info("length %d: %s", r["size"], visits)
        if report:
            report(visits)
    indexed = [r["size"] for r in large if r["size"] not in whole]
    parts.append(_verify(_together(stand.filter(~size.isin(indexed))), least, kind))
    found = stored(reduce(DataFrame.union, parts), "found")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found, "id", "to")
    known = (
        stand.join(linked, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select(F.col("vec").alias("__vec"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component"))
    )
    out = rows.join(known, F.col("ok") & (F.col("vec") == F.col("__vec")), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
