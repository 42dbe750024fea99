"""Exact Jaccard join on word shingles by partitioning the universe of shingles.

Two sets that are similar enough differ in at most ``H`` elements, a number that
their sizes bound.  All shingles are dealt into ``H + 1`` segments by hash, so two
such sets agree in one segment at least.  More is true: going round the segments
as a ring, there is one from which on the first ``l`` segments together never
differ in more than ``l - 1`` elements, for every ``l``.

A set is therefore indexed under each of its segments.  A segment without
elements tells little, as many sets have it; where the expected comparisons cost
more than further signatures, it is indexed together with the one-deletion
neighbourhood of the segment after it, and that, where it has less than two
elements left, with the two-deletion neighbourhood of the third.

Sets that meet are candidates.  They are compared exactly, first each with the
smallest candidate, then only those pairs that are not in one component yet.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartfold.llm.components import components
from chartfold.llm.textbatch import LOWER, Texts, Words, column, fresh, mix, runs, slices, span_hashes
from chartfold.sources.scratch import stored

MASK = (1 << 64) - 1
LOW = np.uint64(255)
#: comparing a candidate costs as much as so many signatures
COMPARE = 50
#: the sets of a signature, up to so many, are screened in pairs; of more, in blocks of their sizes and counts
SMALL = 16
SCREEN_SETS = 512
#: a block with more plausible pairs for each set than this is compared whole, set by set, without naming them
DENSE = 16
#: most sets of a block, and most elements in them, on average
BLOCK_SETS, BLOCK_ELEMENTS = 256, 1 << 20
#: text whose shingles are worked out together: they and their signatures take some hundred bytes of memory for each
PART_BYTES = 1 << 19
#: up to so many ids are sent to all executors; more are joined by a shuffle
SENT = 1_000_000


class Bands:
    """Bands of set sizes, and how the sets of each are partitioned.

    A set can be similar only to sets of its own band and of the ones beside it.
    Band ``j`` joins sets of bands ``j - 1`` and ``j``, so every set takes part
    in two.  Similarity is at least ``percent`` of a hundred.
    """

    def __init__(self, percent: int, counts: dict[int, int] | None = None):
        if not 50 <= percent <= 100:
            raise ValueError(f"the similarity must be from 50 to 100 percent, got {percent}")
        self.percent, self.first, self.counts = percent, [1], counts or {}
        self._plans: dict[int, tuple[int, int]] = {}

    def of(self, size: int) -> int:
        """The band of a size: it begins where the band before can reach no more."""
        while self.first[-1] <= size:
            last = self.first[-1]
            self.first.append(last * 100 // self.percent + 1)
        return int(np.searchsorted(self.first, size, "right")) - 1

    def most_apart(self, band: int) -> int:
        """The most elements that two similar sets of the band can differ in."""
        self.of(self.first[-1] if band >= len(self.first) - 1 else 1)
        while band + 1 >= len(self.first):
            self.of(self.first[-1])
        top = 2 * (self.first[band + 1] - 1)
        p = self.percent
        return max(0, *(s - 2 * -(-p * s // (100 + p)) for s in (top, top - 1)))

    def plan(self, band: int) -> tuple[int, int]:
        """Segments of the band, and over how many of them an empty one is indexed."""
        if band not in self._plans:
            m = self.most_apart(band) + 1
            held = (self.first[band] + self.first[band + 1]) / 2 / m  # elements of a segment
            sets = self.counts.get(band, 0) + self.counts.get(band - 1, 0)
            empty = math.exp(-held)
            # comparisons that one empty segment brings, and those left with a neighbourhood added
            plain, near = COMPARE * sets * empty, COMPARE * sets * empty * empty * (1 + 2 * held)
            self._plans[band] = (m, 1 if plain <= 1 + held else 2 if near <= held * held else 3)
        return self._plans[band]


def shingles(texts: Texts, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles, A-Z in lower case."""
    data = LOWER[texts.data]
    words = Words(texts)
    hashes = span_hashes(data, words.begin, words.end)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        h = hashes[a:b]
        out.append(np.unique(runs(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64))
    return out


def _chain(i: int, m: int, depth: int, start: list[int], parts: list[int], salt: list[int]) -> list[int]:
    """Signatures of the empty segment ``i`` with what follows it on the ring.

    From the right start, the second segment differs in one element at most, and
    the second and third in two together.  Two sets then share what both have.
    """
    j, k = (i + 1) % m, (i + 2) % m
    second, third = parts[start[j] : start[j + 1]], parts[start[k] : start[k + 1]]
    whole, out = sum(second), []
    for left, n in [(whole, len(second)), *[(whole - x, len(second) - 1) for x in second]]:
        key = salt[i] + 3 * left + 7
        if depth < 3 or n > 1 or m < 3:
            out.append(key & MASK)
            continue
        all_three, key = sum(third), key + salt[j]
        out.append((key + 5 * all_three) & MASK)
        for a, x in enumerate(third):
            out.append((key + 5 * (all_three - x)) & MASK)
            out += [(key + 5 * (all_three - x - y)) & MASK for y in third[a + 1 :]]
    return out


def signatures(found: np.ndarray, bands: Bands) -> np.ndarray:
    """What a set is indexed under: two sets that are similar share one."""
    out, own = [], bands.of(len(found))
    spread, value = mix(found + np.uint64(1)), mix(found + np.uint64(2))
    for band in (own, own + 1):
        m, depth = bands.plan(band)
        segment = (spread % np.uint64(m)).astype(np.int64)
        # the hash of a segment's elements is their sum, so one is taken out by a subtraction
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, value)
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
        keys = mix(total + salt)
        if depth > 1 and m > 1:
            held = np.bincount(segment, minlength=m)
            empty = np.flatnonzero(held == 0)
            if len(empty):
                order = np.argsort(segment, kind="stable")
                start = np.concatenate([[0], np.cumsum(held)])
                parts = value[order].tolist()
                at, salts = start.tolist(), salt.tolist()
                far = [k for i in empty.tolist() for k in _chain(i, m, depth, at, parts, salts)]
                keys = np.concatenate([keys[held > 0], mix(np.array(far, np.uint64))])
        out.append(keys)
    return np.unique(np.concatenate(out))


def _digests(docs: DataFrame, k: int, kind: str) -> DataFrame:
    """id, n, a digest of the set (null without words), and how many elements it has in each of 256 buckets."""

    def run(batches):
        for batch in slices(batches, "text", PART_BYTES):
            sets = shingles(Texts(column(batch, "text")), k)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            counts = [np.minimum(np.bincount((mix(s + np.uint64(3)) & LOW).astype(np.int64), minlength=256), 255) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array([c.astype(np.uint8).tobytes() for c in counts], pa.binary())],
                ["id", "n", "digest", "counts"],
            )

    return docs.mapInArrow(run, f"id {kind}, n bigint, digest binary, counts binary")


def _plausible(pairs: DataFrame, shingled: DataFrame, percent: int, kind: str) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) that may be similar by their sizes and counts.

    Two sets differ in at least as many elements as their counts do, so no
    similar pair is lost; most pairs that met by chance go without a comparison.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = column(batch, "n_a").to_numpy(), column(batch, "n_b").to_numpy()
            counts = [
                np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
                for c in ("counts_a", "counts_b")
            ]
            apart = np.abs(counts[0] - counts[1]).sum(axis=1)
            most = a + b - 2 * -(-percent * (a + b) // (100 + percent))
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most))

    for side in ("a", "b"):
        known = shingled.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("counts").alias(f"counts_{side}"))
        pairs = pairs.join(known.filter(F.col(f"n_{side}") > 0), side)
    sized = pairs.filter(f"100 * n_a >= {percent} * n_b AND 100 * n_b >= {percent} * n_a")
    columns = ("a", "b", "n_a", "n_b", "counts_a", "counts_b")
    return sized.select(*columns).mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _indexed(docs: DataFrame, k: int, bands: Bands, kind: str) -> DataFrame:
    """(sig, id, first): every set under its signatures.

    Within a slice of rows the first set of a signature stands for the others:
    these carry it as ``first``.  So a signature that very many sets have comes
    to its task once per slice.  ``leads`` marks a set that stands for others.
    """

    def run(batches):
        for batch in slices(batches, "text", PART_BYTES):
            ids = column(batch, "id")
            sigs = [signatures(s, bands) if len(s) else s for s in shingles(Texts(column(batch, "text")), k)]
            row = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            new = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
            at = np.flatnonzero(new)
            size = np.diff(np.concatenate([at, [len(flat)]]))
            first = pa.array(np.repeat(row[at], size), mask=new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat.view(np.int64)), ids.take(pa.array(row)), ids.take(first),
                 pa.array(np.repeat(size > 1, size) & new)], ["sig", "id", "first", "leads"],
            )

    return docs.mapInArrow(run, f"sig bigint, id {kind}, first {kind}, leads boolean")


def _sets(docs: DataFrame, k: int, kind: str) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text", PART_BYTES):
            sets = [s.view(np.int64) for s in shingles(Texts(column(batch, "text")), k)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"]
            )

    return docs.mapInArrow(run, f"id {kind}, set array<bigint>")


def _picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` is among ``ids`` (distinct and stored)."""
    few = ids.count() <= SENT
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) with ``linked``, from an exact comparison."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", (100 * both >= percent * union).alias("linked"))
    return stored(compared.groupBy("a", "b").agg(F.max("linked").alias("linked")), "compared")


def _linked(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``x`` and ``y`` are similar, from products of their incidence matrices."""
    sizes = [np.array([len(s) for s in part]) for part in (x, y)]
    flat = np.concatenate([*x, *y])
    row = np.repeat(np.arange(len(x) + len(y)), np.concatenate(sizes))
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[place] > 1  # an element of one set only meets none
    place, row = (np.cumsum(count > 1) - 1)[place[shared]], row[shared]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    both = np.zeros((len(x), len(y)), np.float32)
    width = 4096
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [lo, lo + width])
        held = np.zeros((len(x) + len(y), width), np.float32)
        held[row[a:b], place[a:b] - lo] = 1
        both += held[: len(x)] @ held[len(x) :].T
    both = both.astype(np.int64)  # whole numbers below 2 ** 24 are exact in float32
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def _forest(linked: np.ndarray, x: list, y: list) -> list[tuple]:
    """Links that join what ``linked`` joins, one less than there are nodes at most."""
    parent: dict = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = root(x[i]), root(y[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((max(x[i], y[j]), min(x[i], y[j])))
    return out


def _screened(members: DataFrame, shingled: DataFrame, percent: int, kind: str) -> DataFrame:
    """What may be similar among the sets of large signatures: (``a``, ``b``, ``dense``).

    ``members`` are (``sig``, ``id``, ``c``, ``n``): the signature, a set, its
    component so far, and how many sets the signature has.  These are dealt into
    blocks, and a task compares the sizes and bucket counts of two blocks of one
    signature.  It puts out the pairs of different components that may be
    similar; where these are too many, each set with the block's smallest
    one, as ``dense``: then all sets of the two blocks have to be compared.
    """
    known = shingled.select("id", F.col("n").alias("size"), "counts").filter("size > 0")
    dealt = members.withColumn("k", F.ceil(F.col("n") / SCREEN_SETS).cast("int")).join(known, "id")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    sent = dealt.select("sig", "id", "c", "size", "counts", "block", other).select(
        "sig", F.greatest("block", "other").alias("i"), F.least("block", "other").alias("j"), "block", "id", "c", "size", "counts"
    )

    def screen(rows: pa.Table) -> pa.Table:
        ids, kind_of = rows["id"].to_pylist(), rows.schema.field("id").type
        block, size = rows["block"].to_numpy(), rows["size"].to_numpy()
        component = np.unique(np.array(rows["c"].to_pylist()), return_inverse=True)[1]
        counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for a in x.tolist():
            b = y[y > a] if i == j else y
            total = size[a] + size[b]
            near = (component[b] != component[a]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
            b, total = b[near], total[near]
            apart = np.abs(counts[b] - counts[a]).sum(axis=1)
            found += [(a, other) for other in b[apart <= total - 2 * -(-percent * total // (100 + percent))].tolist()]
        if len(found) > DENSE * len(ids):
            least = min(ids)
            pairs = [(v, least) for v in ids]
        else:
            pairs = [(max(ids[a], ids[b]), min(ids[a], ids[b])) for a, b in found if ids[a] != ids[b]]
        columns = [pa.array([p[k] for p in pairs], kind_of) for k in (0, 1)]
        return pa.table([*columns, pa.array([len(found) > DENSE * len(ids)] * len(pairs), pa.bool_())], names=["a", "b", "dense"])

    return sent.groupBy("sig", "i", "j").applyInArrow(screen, f"a {kind}, b {kind}, dense boolean")


def _within_groups(members: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links between sets of dense groups: (``a``, ``b``) that join all that are similar.

    Groups (``p``) that overlap are one.  Its sets are dealt into blocks of
    bounded size and a task compares two blocks, so no task holds a group, and
    what a task puts out are not its pairs but a forest over its sets.
    """
    group = components(members.select(F.col("id").alias("a"), F.col("p").alias("b"))).select(
        F.col("node").alias("id"), F.col("component").alias("g")
    )
    group = group.unionByName(group.select(F.col("g").alias("id"), "g")).distinct()
    held = group.join(sets, "id").select("g", "id", F.size("set").alias("n"))
    blocks = held.groupBy("g").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("k")
    )
    dealt = group.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    sent = dealt.select("g", "id", "block", other).join(sets, "id").select(
        "g", F.greatest("block", "other").alias("i"), F.least("block", "other").alias("j"), "block", "id", "set"
    )

    def compare(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        block, ids = rows["block"].to_numpy(), rows["id"].to_pylist()
        found = [s.values.to_numpy() for s in rows["set"]]
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = _linked([found[k] for k in x], [found[k] for k in y], percent) if len(x) and len(y) else np.zeros((0, 0))
        pairs = _forest(linked, [ids[k] for k in x], [ids[k] for k in y])
        kind_of = rows.schema.field("id").type
        return pa.table([pa.array([p[k] for p in pairs], kind_of) for k in (0, 1)], names=["a", "b"])

    return stored(sent.groupBy("g", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}"), "found")


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_shingles``, ``component_id``.

    Two texts are linked if the Jaccard similarity of their sets of ``k``-word
    shingles is at least ``percent`` of a hundred; ``component_id`` is the
    smallest id that can be reached over links.  Texts with fewer than ``k``
    words have one shingle, all of them; those without words have none and are
    linked with nothing.  Equal sets are linked and stand for one another, so
    copies cost one comparison.  Rows that share an id are linked; a row without
    an id takes the component of its copies, and is null without one.  Other
    columns are not looked at, whatever their names.
    """
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    bands = Bands(percent)
    # sets per band, judged by words: this steers cost only
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    level = F.floor(F.log(F.greatest(words, F.lit(1)).cast("double")) * 64).alias("level")
    for r in rows.groupBy(level).count().collect():  # 64 levels for each power of e
        band = bands.of(max(1, round(math.exp(r["level"] / 64))))
        bands.counts[band] = bands.counts.get(band, 0) + r["count"]

    shingled = stored(_digests(rows, k, kind), "shingled")
    # equal sets stand for one another: the smallest id has them all
    named = shingled.filter("id IS NOT NULL AND digest IS NOT NULL")
    node_of = stored(named.groupBy("digest").agg(F.min("id").alias("node")), "nodes")
    nodes = stored(node_of.select(F.col("node").alias("id")).distinct(), "nodes")

    indexed = _indexed(_picked(rows, nodes), k, bands, kind)
    # a set that another one of its slice stands for needs no further meeting
    meeting = F.when(F.col("first").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", "id"))
    group = W.partitionBy("at", "met")
    met = stored(
        indexed.withColumns({"at": meeting, "met": F.col("first").isNull()})
        .select("sig", "id", F.coalesce("first", F.min("id").over(group)).alias("p"),
                (F.col("leads") | ~F.col("met") | (F.count(F.lit(1)).over(group) > 1)).alias("some"))
        .filter("some").drop("some"), "met",
    )

    def sets_of(ids: DataFrame) -> DataFrame:
        return stored(_sets(_picked(rows, stored(ids.distinct(), "candidates")), k, kind), "sets")

    pairs = met.filter("id <> p").select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b")).distinct()
    pairs = stored(_plausible(pairs, shingled, percent, kind), "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))

    # the smallest candidate of each set first
    compared = _compare(pairs.groupBy("a").agg(F.min("b").alias("b")), sets, percent)
    to = compared.filter("linked").select(F.col("a").alias("node"), F.col("b").alias("to"))

    def labelled(pairs: DataFrame, names: DataFrame, keep: bool = False) -> DataFrame:
        """Pairs that are not known to be in one component; ``keep``: with the components."""
        for side in ("a", "b"):
            label = names.select(F.col("node").alias(side), F.col("to").alias(f"in_{side}"))
            pairs = pairs.join(label, side, "left").withColumn(f"in_{side}", F.coalesce(f"in_{side}", side))
        return pairs.filter("in_a <> in_b").select("a", "b", *(["in_a", "in_b"] if keep else []))

    rest = labelled(pairs.join(compared, ["a", "b"], "left_anti"), to)
    compared = stored(compared.unionByName(_compare(rest, sets, percent)), "compared")

    # sets that met under a signature, were not compared, and are not in one component yet
    joined = components(compared.filter("linked"))
    inside = met.select("sig", "id").join(joined.withColumnRenamed("node", "id"), "id", "left").select(
        "sig", "id", F.coalesce("component", "id").alias("c")
    )
    open_ = inside.groupBy("sig").agg(
        F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("n"), F.min("id").alias("p")
    ).filter("c1 < c2").select("sig", "n", "p")
    inside = stored(inside.join(open_, "sig"), "open")
    few = inside.filter(F.col("n") <= SMALL)
    other = few.select("sig", F.col("id").alias("b"), F.col("c").alias("c_b"))
    crossing = few.join(other, "sig").filter("b < id AND c <> c_b").select(F.col("id").alias("a"), "b").distinct()
    crossing = crossing.join(compared, ["a", "b"], "left_anti")
    few = _plausible(crossing, shingled, percent, kind)
    large = _screened(inside.filter(F.col("n") > SMALL).select("sig", "id", "c", "n"), shingled, percent, kind)
    large = stored(large.distinct(), "screened")
    many = large.filter("dense").select(F.col("a").alias("id"), F.col("b").alias("p"))
    crossing = few.unionByName(large.filter("NOT dense").select("a", "b")).distinct()
    crossing = stored(crossing.join(compared, ["a", "b"], "left_anti"), "pairs")
    sets = sets_of(crossing.select(F.explode(F.array("a", "b")).alias("id")).unionByName(many.select("id")))
    # one pair of every two components first: most of the others are then within one
    names = joined.select("node", F.col("component").alias("to"))
    first = stored(labelled(crossing, names, keep=True).groupBy("in_a", "in_b").agg(
        F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b"), "first")
    once = _compare(first, sets, percent)
    compared = stored(compared.unionByName(once), "compared")
    joined = components(compared.filter("linked"))
    names = joined.select("node", F.col("component").alias("to"))
    rest = labelled(crossing.join(once, ["a", "b"], "left_anti"), names)
    compared = compared.unionByName(_compare(rest, sets, percent))
    found = _within_groups(many, sets, percent, kind)
    links = compared.filter("linked").select("a", "b").unionByName(found)
    joined = components(links)

    component = node_of.join(joined, "node", "left").select(
        F.col("digest").alias("__digest"), F.coalesce("component", "node").alias("__component")
    )
    return shingled.join(component, F.col("digest") == F.col("__digest"), "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("__component", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each group of linked texts: the one with the smallest id.

    Rows that share an id are one group too, of which the row with the least
    hash stays.  Texts without words are linked with nothing and stay, and rows
    without an id are not compared and stay.  The columns are those of ``docs``.
    """
    named = docs.filter(F.col(id).isNotNull())
    found = jaccard_components(named.select(id, text), id, text, k, percent)
    key, n, place = (fresh(c, docs.columns) for c in ("__id", "__n", "__place"))
    staying = stored(
        found.filter(F.col(id) == F.col("component_id")).groupBy(F.col(id).alias(key)).agg(F.count(F.lit(1)).alias(n)),
        "staying",
    )
    few = staying.count() <= SENT
    rows = named.join(F.broadcast(staying) if few else staying, F.col(id) == F.col(key))
    single = rows.filter(F.col(n) == 1).select(docs.columns)
    first = W.partitionBy(id).orderBy(F.xxhash64(*docs.columns))
    several = rows.filter(F.col(n) > 1).withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    return single.unionByName(several.select(docs.columns)).unionByName(docs.filter(F.col(id).isNull()))
