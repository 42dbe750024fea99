"""Token counts by heap-and-linked-list byte-pair merging.

A sentencepiece BPE file ranks its pieces; encoding merges, again and again, the
adjacent pair of symbols that makes the best-ranked piece.  Only the number of
tokens is wanted here: the characters at the start, less one for every merge.
No pieces or identifiers are put out.

No piece of such a file holds a word mark behind another character, so no merge
crosses the start of a word.  Texts are therefore merged word by word, and each
worker keeps the counts of words it has seen, in a table of bounded size.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartfold.llm.textbatch import column, slices

MARK = "▁"
REMEMBERED = 500_000  # words
REMEMBERED_BYTES = 64 << 20  # what they take, about


class PieceRanks:
    """What the pieces of a sentencepiece BPE file with an identity normaliser merge into.

    Every piece has a number.  ``merges`` maps a pair of numbers to the rank and
    the number of the piece that the pair makes.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        probe = "ﬁ  Ａ́\t\n"
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{model_path} changes texts before it splits them; only identity files are supported")
        score = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        if any(MARK in p.lstrip(MARK) for p in score):
            raise ValueError(f"{model_path} has pieces that reach over the start of a word")
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True), 1)}
        self.number = {p: i for i, p in enumerate(score, 1)}
        self.merges = {
            self.number[p[:i]] << 18 | self.number[p[i:]]: (rank[score[p]], self.number[p])
            for p in score
            for i in range(1, len(p))
            if p[:i] in score and p[i:] in score
        }
        #: characters that stand side by side in a piece; no merge crosses others
        self.inner = {p[i : i + 2] for p in score for i in range(len(p) - 1)}
        in_pieces = set("".join(score))
        apart = re.escape("".join(c for c in map(chr, range(128)) if c not in in_pieces))
        # characters that no piece holds stand alone and never merge
        self.segments = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+|[{apart}]").findall

    def parts(self, word: str) -> list[str]:
        """``word`` cut where no merge can cross."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inner]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]


class WordCounts(dict):
    """Tokens of a word, worked out when it is first asked for.

    When the table is full it starts afresh, and takes over from the old one
    the words that are asked for again.
    """

    def __init__(self, ranks: PieceRanks):
        super().__init__()
        self.ranks, self.old, self.held = ranks, {}, 0

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            parts = self.ranks.parts(word)
            n = count_by_merging(word, self.ranks) if len(parts) == 1 else sum(map(self.__getitem__, parts))
        size = 150 + 4 * len(word)
        if len(self) >= REMEMBERED or self.held + size > REMEMBERED_BYTES:
            self.old, self.held = dict(self), 0
            self.clear()
        if size <= REMEMBERED_BYTES:
            self[word] = n
            self.held += size
        return n


def count_by_merging(word: str, ranks: PieceRanks) -> int:
    """Tokens of ``word``.  Characters without a piece count as their UTF-8 bytes.

    The heap holds, as one number each, the rank of a merge, the place of its
    left symbol and the piece that it makes.  ``due[i]`` is the entry of the
    pair that begins at ``i`` now; other entries of that place are out of date.
    """
    number, merge = ranks.number, ranks.merges.get
    symbol = [number.get(c, 0) for c in word]
    n = tokens = len(symbol)
    if 0 in symbol:
        tokens += sum(len(c.encode()) - 1 for c, s in zip(word, symbol) if not s)
    due, heap = [0] * n, []
    for i in range(n - 1):
        m = merge(symbol[i] << 18 | symbol[i + 1])
        if m:
            due[i] = e = (m[0] << 30 | i) << 18 | m[1]
            heap.append(e)
    heapify(heap)
    right, left = [*range(1, n), -1], [*range(-1, n - 1)]
    while heap:
        e = heappop(heap)
        i = e >> 18 & 0x3FFFFFFF
        if due[i] != e:
            continue
        made = symbol[i] = e & 0x3FFFF
        j = right[i]
        k = right[i] = right[j]
        due[i] = due[j] = 0
        tokens -= 1
        if k >= 0:
            left[k] = i
            m = merge(made << 18 | symbol[k])
            if m:
                due[i] = e = (m[0] << 30 | i) << 18 | m[1]
                heappush(heap, e)
        h = left[i]
        if h >= 0:
            m = merge(symbol[h] << 18 | made)
            if m:
                due[h] = e = (m[0] << 30 | h) << 18 | m[1]
                heappush(heap, e)
            else:
                due[h] = 0
    return tokens


@lru_cache(maxsize=2)
def _counter(model_path: str):
    ranks = PieceRanks(model_path)
    return ranks.segments, WordCounts(ranks)


def count_tokens(text: str | None, model_path: str) -> int:
    """Tokens of one text."""
    if not text:
        return 0
    segments, counts = _counter(model_path)
    return sum(map(counts.__getitem__, segments(MARK + text.replace(" ", MARK))))


def token_counts(
    docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", limit: int = 4096
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Counts are those of the sentencepiece library without begin and end tokens.
    A null or empty text has no tokens.  Strings that look like special tokens
    are ordinary text.  Repeated rows are counted one by one; other columns are
    not looked at, whatever their names.  ``model_path`` must exist on every
    machine.
    """
    kind = docs.schema[id].dataType.simpleString()

    def count(batches):
        for batch in slices(batches, "text"):
            texts = column(batch, "text").to_pylist()
            n = [count_tokens(t, model_path) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            over = [x > limit for x in n]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(over, pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return counted.withColumnRenamed("id", id)
