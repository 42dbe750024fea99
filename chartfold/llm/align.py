"""Alignment of the tokens of two tokenizers by the bytes that they cover.

Where tokens of both end at the same byte, the tokens up to there form a group.
Most groups are one token of each, so the two arrays of ends mostly agree at a
fixed shift of the index.  ``runs`` follows that diagonal: from a common end on,
ends agree as long as sizes do, so it compares stretches of 16, 32, 64, ... sizes,
finds the first that differs from the lowest bit that does, and jumps there.
The group that begins there is irregular; the ends are stepped through until they
meet, and the next stretch is compared at the new shift.

A pair of ids is linked in a document if a group holds both.  Counts over the
corpus go by blocks: a block of documents holds each of its pairs once, with the
number of its documents that hold it, so what is shuffled does not grow with the
occurrences of a pair, and a pair that every document holds is one row per block.
The counts return to the blocks the same way.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartfold.llm.backtrack_bpe import byte_letters
from chartfold.llm.textbatch import column, places, slices, spans_total
from chartfold.sources.scratch import stored, stored_blocks

BLOCK_BYTES = 2 << 20  # text of a block
PART_BYTES = 1 << 19  # text whose tokens are laid out at a time; they take some hundred times as much
STRETCH = 16  # sizes that are compared first
PAIRS_AT_ONCE = 1 << 21  # pairs of irregular groups that are laid out at a time
ID_BITS = 32

# Fixed value: how files of this kind cut a text into words before any merge.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Ids and token bytes of a byte-level file of the tokenizers library; special strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        cut = config["pre_tokenizer"]
        if config["normalizer"] or config["model"].get("ignore_merges") or config["model"].get("end_of_word_suffix") or (
            cut["type"], cut["add_prefix_space"], cut["use_regex"]) != ("ByteLevel", False, True):
            raise ValueError(f"{path} is not a plain byte-level file")
        value = {c: b for b, c in enumerate(byte_letters())}
        vocab, merges = config["model"]["vocab"], config["model"]["merges"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != sorted(made):
            raise ValueError(f"{path} does not number its tokens as they are merged")
        ranks = {bytes([value[c] for c in t]): i for t, i in vocab.items()}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Ids and token bytes of a sentencepiece file that puts a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        self.bytes = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
        ]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Tokens:
    """Tokens of some texts, one after the other: ``ids``, the byte ``size`` of each, where they end, and where
    each text's begin, ``at``; ``spelled``: what the tokens of each text spell out."""

    def __init__(self, tokenizer, texts: list[str]):
        found = tokenizer(texts)
        self.at = np.cumsum([0, *map(len, found)])
        self.ids = np.fromiter(chain.from_iterable(found), np.int64, int(self.at[-1]))
        self.spelled = [b"".join(map(tokenizer.bytes.__getitem__, x)) for x in found]
        self.size = tokenizer.sizes[self.ids]
        self.ends = np.cumsum(self.size)

    def only(self, texts: np.ndarray) -> None:
        """Empties all texts but those that are flagged."""
        n = np.diff(self.at)
        keep = np.repeat(texts, n)
        self.ids, self.size = self.ids[keep], self.size[keep]
        self.ends = np.cumsum(self.size)
        self.at = np.concatenate([[0], np.cumsum(n * texts)])
        del self.spelled


def runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of two arrays of ends, which grow and have the same last value.

    Rows ``(i, j, n)``: n groups of one token each, from ``a[i]`` and ``b[j]`` on;
    rows ``(i, j, p, q)``: an irregular group of ``a[i:p]`` and ``b[j:q]``.
    """
    size_a, size_b = np.diff(a, prepend=0), np.diff(b, prepend=0)
    kind = np.min_scalar_type(int(max(size_a.max(initial=0), size_b.max(initial=0))))
    width = kind.itemsize
    raw_a, raw_b = size_a.astype(kind).tobytes(), size_b.astype(kind).tobytes()
    list_a, list_b = (raw_a, raw_b) if width == 1 else (size_a.tolist(), size_b.tolist())
    number = int.from_bytes
    irregular = []
    x = y = 0  # places in raw_a and raw_b
    while x < len(raw_a):
        step = STRETCH * width
        differ = number(raw_a[x : x + step], "little") ^ number(raw_b[y : y + step], "little")
        while not differ and x < len(raw_a):
            x += step
            y += step
            step *= 2
            differ = number(raw_a[x : x + step], "little") ^ number(raw_b[y : y + step], "little")
        if differ:
            n = ((differ & -differ).bit_length() - 1) // (8 * width)
            i, j = x // width + n, y // width + n
            u, v = list_a[i], list_b[j]  # bytes of the group so far
            p, q = i + 1, j + 1
            while u != v:
                if u < v:
                    u += list_a[p]
                    p += 1
                else:
                    v += list_b[q]
                    q += 1
            irregular += (i, j, p, q)
            x, y = p * width, q * width
    irregular = np.array(irregular, np.int64).reshape(-1, 4)
    begin = np.concatenate([[[0, 0]], irregular[:, 2:]])
    n = np.append(irregular[:, 0], len(a)) - begin[:, 0]
    return np.column_stack([begin, n])[n > 0], irregular


class Groups:
    """The groups of two rows of tokens: how many of each a group has, in order."""

    def __init__(self, a: Tokens, b: Tokens):
        regular, self.irregular = runs(a.ends, b.ends)
        self.one_a = places(regular[:, 0], regular[:, 2])  # tokens that are a group with one other
        self.one_b = places(regular[:, 1], regular[:, 2])
        # a group is known by its first token of each
        first_a = np.concatenate([self.one_a, self.irregular[:, 0]])
        order = np.argsort(first_a, kind="stable")
        self.first_a = first_a[order]
        self.first_b = np.concatenate([self.one_b, self.irregular[:, 1]])[order]
        self.n_a = np.diff(self.first_a, append=len(a.ids))
        self.n_b = np.diff(self.first_b, append=len(b.ids))

    def __len__(self) -> int:
        return len(self.first_a)


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (group, id), in order, and how often each occurs."""
    key, n = np.unique(group << ID_BITS | ids, return_counts=True)
    return key >> ID_BITS, key & ((1 << ID_BITS) - 1), n


def _merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of ``n``."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], np.add.reduceat(n[order], start)


def links(a: Tokens, b: Tokens, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The linked pairs of every text: where each text's begin, place of the pair among the different
    ones, how many occurrences are linked; and the different pairs, as ``a << 32 | b``."""
    text_a = np.repeat(np.arange(len(a.at) - 1), np.diff(a.at))
    codes = [a.ids[groups.one_a] << ID_BITS | b.ids[groups.one_b]]
    texts, times = [text_a[groups.one_a]], [np.ones(len(groups.one_a), np.int64)]
    rows = groups.irregular
    n_a, n_b = rows[:, 2] - rows[:, 0], rows[:, 3] - rows[:, 1]
    number = np.arange(len(rows))
    # equal ids of a group count together, so a group has at most its different ids times each other
    ga, ia, ca = _distinct(np.repeat(number, n_a), a.ids[places(rows[:, 0], n_a)])
    gb, ib, cb = _distinct(np.repeat(number, n_b), b.ids[places(rows[:, 1], n_b)])
    begin = np.searchsorted(gb, number)
    size = (np.searchsorted(gb, number, "right") - begin)[ga]  # partners of every entry of a
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        other = places(begin[ga[at:end]], size[at:end])
        mine = np.repeat(np.arange(at, end), size[at:end])
        code = ia[mine] << ID_BITS | ib[other]
        text = text_a[rows[ga[mine], 0]]
        codes.append(code)
        texts.append(text)
        times.append(ca[mine] * cb[other])
        at = end
    pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
    key, n = _merged(np.concatenate(texts) << ID_BITS | place, np.concatenate(times))
    first = np.searchsorted(key, np.arange(len(a.at)) << ID_BITS)
    return first, key & ((1 << ID_BITS) - 1), n, pairs


class Numerals:
    """Decimal ids with a mark behind, filled up with zeros: of id ``i``, ``,`` at ``i``, ``|`` at ``n + i``, ``;`` at ``2 * n + i``."""

    def __init__(self, n: int):
        self.n = n
        width = (len(str(n)) + 8) // 8 * 8
        self.text = np.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], f"S{width}")
        self.size = np.char.str_len(self.text)


def group_digests(a: Tokens, b: Tokens, groups: Groups, numerals: Numerals) -> list[str]:
    """Hex digests of ``a1,a2|b1;a3|b2,b3`` for every text, ``''`` for one without tokens."""
    upto_a, upto_b = groups.first_a + groups.n_a, groups.first_b + groups.n_b
    ids = np.empty(len(a.ids) + len(b.ids), np.int64)
    ids[np.arange(len(a.ids)) + np.repeat(groups.first_b, groups.n_a)] = a.ids
    ids[np.arange(len(b.ids)) + np.repeat(upto_a, groups.n_b)] = b.ids
    ids[upto_a + groups.first_b - 1] += numerals.n
    ids[upto_a + upto_b - 1] += 2 * numerals.n
    edge = np.concatenate([[0], np.cumsum(numerals.size[ids])])[a.at + b.at]
    text = numerals.text[ids].view(np.uint8)
    raw = text[text != 0].tobytes()
    return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edge.tolist(), edge[1:].tolist())]


class Aligner:
    """Both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        for t in (self.a, self.b):
            t.sizes = np.array([len(x) for x in t.bytes], np.int64)
        self.numerals = Numerals(max(len(self.a.bytes), len(self.b.bytes)))

    def tokens(self, texts: list[str | None]) -> tuple[Tokens, Tokens]:
        """The tokens of both; none for texts that are null, empty or not spelled out by both."""
        plain = [t or "" for t in texts]
        a, b = Tokens(self.a, plain), Tokens(self.b, plain)
        spelled = np.array([
            bool(t) and x == y == b" " + t.encode() for t, x, y in zip(plain, a.spelled, b.spelled)
        ], bool)
        a.only(spelled)
        b.only(spelled)
        return a, b

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of ``id`` and ``text`` as rows of blocks."""
        for batch in slices(batches, "text", BLOCK_BYTES):
            parts = [self.part(column(s, "text").to_pylist()) for s in slices(iter([batch]), "text", PART_BYTES)]
            yield _block(column(batch, "id"), parts)

    def part(self, texts: list[str | None]) -> list[Sequence]:
        """The columns of some documents of a block, and their pairs."""
        a, b = self.tokens(texts)
        groups = Groups(a, b)
        first, place, n, pairs = links(a, b, groups)
        group_at = np.searchsorted(groups.first_a, a.at)
        return [
            np.diff(a.at), np.diff(b.at), np.diff(group_at), spans_total(n, first),
            group_digests(a, b, groups, self.numerals), np.diff(first), place, n, pairs,
        ]


def _block(ids: pa.Array, parts: list[list[Sequence]]) -> pa.RecordBatch:
    """The row of a block."""
    *columns, digests, n_pairs, place, n, pairs = zip(*parts)
    before = np.cumsum([0, *map(len, pairs)])
    pairs, at = np.unique(np.concatenate(pairs), return_inverse=True)
    place = np.concatenate([at[x + p] for x, p in zip(before, place)])
    held = np.bincount(place, minlength=len(pairs))  # documents of the block that hold a pair
    row = [
        ids, *[pa.array(np.concatenate(c)) for c in columns], pa.array(chain.from_iterable(digests), pa.string()),
        pa.array(np.concatenate(n_pairs), pa.int32()), pa.array(place, pa.int32()), pa.array(np.concatenate(n)),
        pa.array(pairs), pa.array(held, pa.int32()),
    ]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row]
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists], BLOCK)


#: a row per block: its documents' columns; of each document, its pairs by their place; the pairs, how many documents hold each
BLOCK = ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "place", "n", "pairs", "held"]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment of all documents, a row per block, written to the shared folder."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        yield from aligner(path_a, path_b).blocks(batches)

    schema = (f"block string, ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
              "n_links array<bigint>, groups_sha256 array<string>, n_pairs array<int>, place array<int>, n array<bigint>, "
              "pairs array<bigint>, held array<int>")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return stored_blocks(rows.mapInArrow(run, schema), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Every linked pair: ``pair`` (``a << 32 | b``), ``n_docs`` that hold it, ``best`` among those of its first id."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("e")).select("e.pairs", "e.held")
    counted = stored(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n_docs")), "pair-counts")
    first = F.shiftright("pair", ID_BITS)
    most = counted.groupBy(first.alias("a")).agg(F.max("n_docs").alias("most"))  # at most a row per id of the first tokenizer
    met = counted.withColumn("a", first).join(F.broadcast(most), "a")
    return met.select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, token, group and link counts, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``path_a`` is a byte-level file of the tokenizers library, which gets a blank
    and the text; ``path_b`` a sentencepiece file that puts the blank there
    itself.  Groups end where tokens of both end; all occurrences of a group are
    linked.  ``n_best`` counts the links whose pair is in the most documents of
    all pairs of its first id, ties included; ``count_sum`` adds up the documents
    of the pairs over all links.  A text that is null or empty, or that the tokens
    of one do not spell out, has zeros and an empty digest.  Repeated rows are
    documents of their own, a null id stays null, an empty table gives an empty
    one, and other columns are not looked at, whatever their names.  Both files
    must exist on every machine.
    """
    kind = docs.schema[id].dataType.simpleString()
    blocks = aligned_blocks(docs, path_a, path_b, id, text)
    counts = pair_counts(blocks)
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    back = asked.join(counts, "pair").select("of", "at", "n_docs", "best")
    rows = blocks.drop("pairs", "held")
    schema = f"id {kind}, {', '.join(f'{c} bigint' for c in RESULT)}, groups_sha256 string"
    done = rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_with_counts, schema)
    return done.withColumnRenamed("id", id)


def _with_counts(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus' counts of its pairs."""
    row = {c: block.column(c).combine_chunks()[0].values for c in block.column_names if c != "block"}
    at = counts.column("at").to_numpy()
    n_docs, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    n_docs[at], best[at] = counts.column("n_docs").to_numpy(), counts.column("best").to_numpy()
    place, n = row["place"].to_numpy(), row["n"].to_numpy()
    first = np.concatenate([[0], np.cumsum(row["n_pairs"].to_numpy())])
    n_best, total = spans_total(n * best[place], first), spans_total(n * n_docs[place], first)
    return pa.table(
        [row["ids"], *[row[c] for c in RESULT[:4]], pa.array(n_best), pa.array(total), row["groups_sha256"]],
        names=["id", *RESULT, "groups_sha256"],
    )
