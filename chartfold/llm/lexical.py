"""Ranked lexical search: short posting lists term at a time, long ones document at a time.

``build_index`` cuts the documents into blocks of bounded text and writes a row
per block: its documents, its terms, and for each term the documents that hold it
and how often.  ``search`` looks up the terms of the queries in every block.

Within a block, a query's short lists are added up term by term into one list of
documents with summed scores.  That list has a largest score, as every long list
has, and joins them as one more bounded iterator.  These are then read document at
a time, a window of documents after the other: lists whose bounds together cannot
lift a document into the best ``k`` name no candidates; they are only looked into,
by binary search, for the documents that the others name, and the documents that
can no longer make it are dropped before the next list.  A task carries the best
``k`` of a query from block to block, so its threshold rises as it reads.

Scores are whole numbers, so nothing depends on the order of sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chartfold.llm.textbatch import LOWER, Texts, Words, column, places, slices, span_hashes
from chartfold.sources.scratch import small_batches, stored, stored_blocks

BLOCK_BYTES = 4 << 20  # text of a block
BATCH_BYTES = 4 << 20  # text of the queries that are searched together
WINDOW = 2048  # documents that are scored together
SHORT = 64  # lists of up to a share 1 / SHORT of a block's documents are short
SALTS = 64  # how many groups the best of the tasks go through first

#: bytes that no term [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ holds
APART = np.zeros(256, bool)
APART[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


class Postings:
    """Terms of some texts: ``hash`` and ``text`` of each different one, and ``term``, ``doc``, ``tf`` of its postings."""

    def __init__(self, texts: Texts):
        words = Words(texts, APART)
        data = LOWER[texts.data]
        self.n = words.counts
        hashes = span_hashes(data, words.begin, words.end)
        doc = np.repeat(np.arange(len(texts)), self.n)
        order = np.argsort(hashes, kind="stable")
        hashes, doc = hashes[order], doc[order]
        new_term = np.ones(len(order), bool)
        new_term[1:] = hashes[1:] != hashes[:-1]
        new = new_term.copy()
        new[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(new)
        self.hash = hashes[new_term]
        self.doc = doc[at]
        self.tf = np.diff(at, append=len(order))
        self.term = np.cumsum(new_term)[at] - 1
        # the letters of a term are those of its first occurrence
        first = order[new_term]
        size = words.end[first] - words.begin[first]
        letters = data[places(words.begin[first], size)]
        edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        self.text = pa.StringArray.from_buffers(len(first), pa.py_buffer(edge), pa.py_buffer(letters))


def _block(parts: list[tuple[pa.Array, Postings]]) -> list[pa.Array]:
    """The columns of the row of a block."""
    before = np.cumsum([0, *[len(p.n) for _, p in parts]])
    hashes, at, term = np.unique(np.concatenate([p.hash for _, p in parts]), return_index=True, return_inverse=True)
    text = pa.concat_arrays([p.text for _, p in parts]).take(pa.array(at))
    starts = np.cumsum([0, *[len(p.hash) for _, p in parts]])
    term = np.concatenate([term[s + p.term] for s, (_, p) in zip(starts, parts)])
    doc = np.concatenate([b + p.doc for b, (_, p) in zip(before, parts)])
    tf = np.concatenate([p.tf for _, p in parts])
    order = np.argsort(term, kind="stable")  # documents of a term stay in order
    first = np.searchsorted(term[order], np.arange(len(hashes) + 1))
    n = np.concatenate([p.n for _, p in parts])
    ids = pa.concat_arrays([i for i, _ in parts])
    lists = [ids, pa.array(n, pa.int64()), text, pa.array(np.diff(first), pa.int32()),
             pa.array(doc[order], pa.int32()), pa.array(tf[order], pa.int32())]
    return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]


INDEX = ["ids", "n", "terms", "df", "doc", "tf"]


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per block of about :data:`BLOCK_BYTES` of text, written to the shared folder.

    ``ids`` and ``n``: id and number of terms of every document with a term;
    ``terms`` and ``df``: the different terms, and how many documents hold them;
    ``doc`` and ``tf``: places in ``ids`` and frequencies, term after term.
    Terms are the maximal runs of ASCII letters, digits and characters beyond
    ASCII in whole texts, A-Z in lower case.  Documents that are null, empty or
    without a term are not in the index.  Repeated rows are documents of their
    own, a null id stays null, other columns are not looked at.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        parts, held = [], 0
        for batch in slices(batches, "text"):
            found = Texts(column(batch, "text"))
            p = Postings(found)
            some = np.flatnonzero(p.n)
            if len(some):
                new = np.cumsum(p.n > 0) - 1
                p.n, p.doc = p.n[some], new[p.doc]
                parts.append((column(batch, "id").take(pa.array(some)), p))
                held += len(found.data)
            if held >= BLOCK_BYTES:
                yield pa.RecordBatch.from_arrays(_block(parts), INDEX)
                parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays(_block(parts), INDEX)

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = (f"ids array<{kind}>, n array<bigint>, terms array<string>, "
              "df array<int>, doc array<int>, tf array<int>")
    return stored_blocks(rows.mapInArrow(run, schema), "lexical-index")


def query_terms(text: str | None) -> Counter:
    """The terms of a query and how often it has each."""
    if not text:
        return Counter()
    found = Texts(pa.array([text]))
    words, data = Words(found, APART), LOWER[found.data]
    return Counter(data[a:b].tobytes().decode() for a, b in zip(words.begin, words.end))


class Iterators:
    """The lists of a query within a block, short ones summed up, by ascending bound."""

    def __init__(self, lists: Sequence[tuple[np.ndarray, np.ndarray]], n_docs: int):
        limit = max(1, n_docs // SHORT)
        short = [x for x in lists if len(x[0]) <= limit]
        self.lists = [x for x in lists if len(x[0]) > limit]
        if short:
            doc = np.concatenate([d for d, _ in short])
            order = np.argsort(doc, kind="stable")
            doc = doc[order]
            start = np.flatnonzero(np.diff(doc, prepend=-1))
            total = np.add.reduceat(np.concatenate([s for _, s in short])[order], start)
            self.lists.append((doc[start], total))
        bound = [int(s.max()) for _, s in self.lists]
        order = sorted(range(len(bound)), key=bound.__getitem__)
        self.lists = [self.lists[i] for i in order]
        self.bound = [bound[i] for i in order]
        #: the most that the first so many lists can give together
        self.upto = np.concatenate([[0], np.cumsum(np.array(self.bound, np.int64))])


def top_of_block(its: Iterators, n_docs: int, best: Best, ids: Sequence) -> None:
    """Puts the documents of a block that belong there into ``best``."""
    at = [0] * len(its.lists)
    weak = 0  # so many lists cannot lift a document into the best by themselves
    for lo in range(0, n_docs, WINDOW):
        while weak < len(its.lists) and its.upto[weak + 1] < best.least:
            weak += 1
        if weak == len(its.lists):
            return
        hi = min(lo + WINDOW, n_docs)
        score = np.zeros(hi - lo, np.int64)
        for i in range(weak, len(its.lists)):
            doc, gain = its.lists[i]
            a = at[i] = at[i] if lo == 0 else int(np.searchsorted(doc, lo))
            b = int(np.searchsorted(doc, hi))
            score[doc[a:b] - lo] += gain[a:b]
        found = np.flatnonzero(score)
        total = score[found]
        for i in range(weak - 1, -1, -1):
            able = total + its.upto[i + 1] >= best.least
            found, total = found[able], total[able]
            if not len(found):
                break
            doc, gain = its.lists[i]
            place = np.minimum(np.searchsorted(doc, found + lo), len(doc) - 1)
            total = total + np.where(doc[place] == found + lo, gain[place], 0)
        if len(found):
            best.add(total, found + lo, ids)


class Best:
    """The best ``k`` documents of a query so far: highest scores, then lowest ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, score: np.ndarray, doc: np.ndarray, ids: Sequence) -> None:
        good = score >= self.least
        score, doc = score[good], doc[good]
        if len(score) > self.k:
            good = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc = score[good], doc[good]
        rows = self.rows + [(-int(s), ids[int(d)]) for s, d in zip(score, doc)]
        rows.sort(key=lambda r: (r[0], r[1] is None, r[1] if r[1] is not None else 0))
        self.rows = rows[: self.k]
        if len(self.rows) == self.k:
            self.least = max(1, -self.rows[-1][0])


class Searcher:
    """Queries with the weights of their terms, and the corpus' figures."""

    def __init__(self, queries: list[Counter], weight: dict[str, int], n_docs: int, n_terms: int, k: int):
        self.k, self.n_docs, self.n_terms = k, n_docs, n_terms
        self.terms = [t for t, w in weight.items() if w > 0]
        place = {t: i for i, t in enumerate(self.terms)}
        self.weight = np.array([weight[t] for t in self.terms], np.int64)
        self.queries = [[(place[t], times) for t, times in q.items() if t in place] for q in queries]

    def run(self, blocks: Iterator[pa.RecordBatch]) -> list[Best]:
        best = [Best(self.k) for _ in self.queries]
        for batch in blocks:
            for r in range(batch.num_rows):
                self._block([batch.column(batch.schema.get_field_index(c))[r].values for c in INDEX], best)
        return best

    def _block(self, row: list[pa.Array], best: list[Best]) -> None:
        ids, n, terms, df, doc, tf = row
        wanted = pa.array(self.terms, pa.string())
        place = pc.index_in(wanted, value_set=terms.cast(pa.string()))
        here = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        if not len(here):
            return
        where = place.take(pa.array(here)).to_numpy().astype(np.int64)
        df = df.to_numpy().astype(np.int64)
        size = df[where]
        take = places((np.cumsum(df) - df)[where], size)
        doc, tf = doc.to_numpy()[take].astype(np.int64), tf.to_numpy()[take].astype(np.int64)
        m = 75 + 25 * n.to_numpy() * self.n_docs // self.n_terms
        gain = np.repeat(self.weight[here], size) * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        edge = np.concatenate([[0], np.cumsum(size)])
        lists = {int(t): (doc[a:b], gain[a:b]) for t, a, b in zip(here, edge, edge[1:])}
        for query, found in zip(self.queries, best):
            mine = [(lists[t][0], lists[t][1] * times) for t, times in query if t in lists]
            if mine:
                top_of_block(Iterators(mine, len(n)), len(n), found, Ids(ids))


class Ids:
    """The ids of a block, made into Python values one by one."""

    def __init__(self, array: pa.Array):
        self.array = array

    def __getitem__(self, i: int):
        return self.array[i].as_py()


def search(
    index: DataFrame, queries: DataFrame, k: int = 20, query_id: str = "item_id", query: str = "text", id: str = "doc_id"
) -> DataFrame:
    """The best ``k`` documents of an index for every row of ``queries``: query id, ``rank``, document id, ``score``.

    A term weighs ``floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and a document
    that holds it ``tf`` times gains ``weight * (10**9 * tf div (1000 * tf + 12 * m))``
    with ``m = 75 + 25 n N div L``; a query's repeats count.  Only scores above 0
    are put out; equal ones go by ascending document id, null last.  A null or
    empty query, and one without a known term, has no rows; nor has an empty
    table.  Queries go to the tasks in batches of about :data:`BATCH_BYTES` of
    text, so any number of them may be asked; what is found is written to the
    shared folder.
    """
    spark = index.sparkSession
    about = index.agg(
        F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("terms")
    ).first()
    asked = queries.select(F.col(query_id).alias("item"), F.col(query).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = -(-size // BATCH_BYTES)
    kinds = (queries.schema[query_id].dataType, index.schema["ids"].dataType.elementType)
    schema = f"q string, item {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score bigint"
    found = None
    for b in range(n_batches if about.docs else 0):
        part = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_batches)) == b).collect()  # about BATCH_BYTES
        counted = [query_terms(r.text) for r in part]
        searcher = _searcher(index, counted, about.docs, about.terms, k)
        shared = spark.sparkContext.broadcast((searcher, [r.item for r in part]))
        rows = index.select(*INDEX).mapInArrow(_task(shared, f"{b}/", kinds), schema)
        with small_batches(spark):  # a task reads a block at a time
            best = stored(_ranked(rows, k), "lexical-best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = _ranked(spark.createDataFrame([], schema), k)
    return found.select(F.col("item").alias(query_id), "rank", F.col("id").alias(id), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, of which every task has put out as many."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    # first the best within some groups of tasks, then of these
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order)))
    some = some.filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)


def _searcher(index: DataFrame, counted: list[Counter], n_docs: int, n_terms: int, k: int) -> Searcher:
    """Weights of the terms of a batch of queries, from the document frequencies in the index."""
    spark = index.sparkSession
    terms = sorted(set().union(*counted))
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))  # about BATCH_BYTES at most
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).select(F.col("e.terms").alias("term"), "e.df")
    df = held.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = {r.term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in df.collect()}
    return Searcher(counted, weight, n_docs, n_terms, k)


def _task(shared, batch: str, kinds):
    types = [pa.string(), *map(to_arrow_type, kinds), pa.int64()]

    def run(blocks):
        searcher, items = shared.value
        best = searcher.run(blocks)
        rows = [(f"{batch}{q}", items[q], i, -s) for q, b in enumerate(best) for s, i in b.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["q", "item", "id", "score"])

    return run
