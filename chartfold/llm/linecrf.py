"""Quality rules with line labels from a linear-chain conditional random field.

Plain counts reject documents that are too short or repeat themselves.  In the
others, Viterbi decoding marks every line as content or boilerplate, and the
share of the text that is content decides whether a document stays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartfold.llm.textbatch import Texts, Words, column, runs, slices, span_hashes, spans_total

SYMBOLS = b"#*$%&|<>"
ENDS = b".!?:;\"')"
WINDOW = 5
#: text that is filtered at a time: its counts take some hundred bytes of memory for each
PART_BYTES = 1 << 19


def _table(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


IS_SYMBOL, IS_END = _table(SYMBOLS), _table(ENDS)
IS_UPPER, IS_LOWER, IS_DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789")
IS_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])  # the first byte of a code point

# a line's features: for each, where its values are cut into bins
CUTS = {
    "symbol_share": (0.0, 0.02, 0.1),
    "exclaim_share": (0.0, 0.02, 0.1),
    "upper_share": (0.1, 0.3, 0.6),
    "digit_share": (0.0, 0.1, 0.3),
    "pipe_share": (0.0, 0.02, 0.1),
    "words": (3.0, 8.0, 20.0),
    "word_length": (3.0, 7.0, 11.0),
    "ends": (0.5,),
    "starts_lower": (0.5,),
    "repeated": (0.5,),
}
WIDTH = 1 + max(map(len, CUTS.values()))


class Lines:
    """The lines with a word of a batch of texts, and counts over whole texts."""

    def __init__(self, texts: Texts):
        data, words = texts.data, Words(texts)
        is_break = data == ord("\n")
        breaks = np.flatnonzero(is_break)
        # a line begins with its text or after a line feed, and ends before one or with its text
        begin = np.sort(np.concatenate([texts.at[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([texts.at[1:], breaks]), kind="stable")
        n_lines = texts.per_text(is_break) + 1
        text_of = np.repeat(np.arange(len(texts)), n_lines)
        word_at = np.searchsorted(words.begin, np.concatenate([begin, [len(data)]]))
        n_words = np.diff(word_at) if len(begin) else np.zeros(0, np.int64)
        some = n_words > 0
        self.begin, self.end, self.text_of = begin[some], end[some], text_of[some]
        self.n_words, self.first = n_words[some], np.searchsorted(text_of[some], np.arange(len(texts) + 1))
        self.repeated = self._repeats(data)

        word_hashes = span_hashes(data, words.begin, words.end)
        inside = np.concatenate([[0], np.cumsum(IS_POINT[data] & ~_SPACE[data])])
        self.chars = inside[self.end] - inside[self.begin]
        self.counts = {
            "n_words": words.counts,
            "word_chars": inside[texts.at[1:]] - inside[texts.at[:-1]],
            "n_symbols": texts.per_text(IS_SYMBOL[data]),
            "n_dup_lines": spans_total(self.repeated, self.first),
            "n_repeat_words": np.array([
                repeated_words(word_hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:])
            ], np.int64),
        }
        self.data = data

    def _repeats(self, data: np.ndarray) -> np.ndarray:
        """Lines equal to an earlier line of their text."""
        hashes = span_hashes(data, self.begin, self.end)
        order = np.lexsort((np.arange(len(hashes)), hashes, self.text_of))
        h, t = hashes[order], self.text_of[order]
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
        return again

    def features(self) -> np.ndarray:
        """The bin of each feature of each line."""
        def share(flags):
            total = np.concatenate([[0], np.cumsum(flags)])
            return (total[self.end] - total[self.begin]) / np.maximum(self.chars, 1)

        data, upper, lower = self.data, IS_UPPER[self.data], IS_LOWER[self.data]
        # the last and first byte that is not white space
        solid = np.flatnonzero(~_SPACE[data])
        last = data[solid[np.searchsorted(solid, self.end) - 1]] if len(self.end) else data[:0]
        start = data[solid[np.searchsorted(solid, self.begin)]] if len(self.end) else data[:0]
        up, low = share(upper), share(lower)
        values = {
            "symbol_share": share(IS_SYMBOL[data]),
            "exclaim_share": share(data == ord("!")),
            "upper_share": up / np.maximum(up + low, 1e-9),
            "digit_share": share(IS_DIGIT[data]),
            "pipe_share": share(data == ord("|")),
            "words": self.n_words,
            "word_length": self.chars / np.maximum(self.n_words, 1),
            "ends": IS_END[last],
            "starts_lower": IS_LOWER[start],
            "repeated": self.repeated,
        }
        return np.stack([np.searchsorted(cuts, values[name], "left") for name, cuts in CUTS.items()], axis=1)


_SPACE = np.array([b == 0x20 or 9 <= b <= 13 for b in range(256)])


def repeated_words(hashes: np.ndarray, k: int = WINDOW) -> int:
    """Words inside windows of ``k`` words that the text holds twice or more."""
    windows = runs(hashes, k)
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(windows, again))
    np.add.at(hit, at, 1)
    np.add.at(hit, at + k, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


@dataclass
class LineCRF:
    """A chain of two labels, 0 boilerplate and 1 content.

    ``weights`` has, for every feature and bin, what it adds to content;
    ``step[a, b]`` what going from label ``a`` to ``b`` adds.
    """

    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(CUTS), WIDTH)))
    bias: float = 0.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(len(CUTS)), bins].sum(axis=-1) + self.bias

    def viterbi(self, content: list[float]) -> list[int]:
        """The best labels for one text's lines, ties to content."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, 0.0, []
        for i, e in enumerate(content):
            if i:
                from_a, from_b = a + s00 > b + s10, a + s01 > b + s11
                a, b = (a + s00 if from_a else b + s10), (a + s01 if from_b else b + s11)
                back.append((not from_a, not from_b))
            b += e
        label = int(b >= a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]

    def fit(self, bins: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 80, rate: float = 0.15,
            l2: float = 1e-3) -> "LineCRF":
        """Maximum likelihood by gradient steps; ``bins`` is (texts, lines, features), padded to the longest."""
        n, t, _ = bins.shape
        there = np.arange(t)[None, :] < lengths[:, None]
        y = labels * there
        moves = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                moves[a, b] = ((labels[:, :-1] == a) & (labels[:, 1:] == b) & there[:, 1:]).sum()
        params = [self.weights, np.zeros(1), self.step]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = there.sum()
        for r in range(1, rounds + 1):
            e = np.stack([np.zeros((n, t)), params[0][np.arange(len(CUTS)), bins].sum(-1) + params[1]], axis=-1)
            fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            fwd[:, 0] = e[:, 0]
            for i in range(1, t):
                ahead = np.logaddexp.reduce(fwd[:, i - 1, :, None] + params[2], axis=1) + e[:, i]
                fwd[:, i] = np.where(there[:, i, None], ahead, fwd[:, i - 1])
            for i in range(t - 2, -1, -1):
                behind = np.logaddexp.reduce(params[2] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
                bwd[:, i] = np.where(there[:, i + 1, None], behind, 0.0)
            z = np.logaddexp.reduce(fwd[:, -1], axis=1)
            content = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * there
            pair = np.exp(fwd[:, :-1, :, None] + params[2] + (e + bwd)[:, 1:, None, :] - z[:, None, None, None])
            expected = (pair * there[:, 1:, None, None]).sum(axis=(0, 1))
            wrong = y - content
            grads = [np.zeros_like(params[0]), np.array([wrong.sum()]), moves - expected]
            for f in range(len(CUTS)):
                grads[0][f] = np.bincount(bins[:, :, f].ravel(), wrong.ravel(), WIDTH)
            for p, g, m, v in zip(params, grads, first, second):  # Adam
                g = g / total - l2 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        return LineCRF(params[0], float(params[1][0]), params[2])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    sample: int = 1500,
    lines: int = 64,
) -> LineCRF:
    """Fits the chain on about ``sample`` labelled documents, chosen by a hash of their id.

    The lines of a good document count as content, those of a bad one and
    repeated lines as boilerplate.  A document of more than ``lines`` lines is cut
    into even stretches, of which one takes part, chosen by a hash, so that every
    line of a text has the same chance.  Rows of equal id and text count once, and
    at most twice ``sample`` rows take part.  These bounds hold for the fit alone.
    Without documents of both kinds there is nothing to learn, and the chain calls
    every line content.
    """
    marked = labels.filter(F.col(quality).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(
        F.min(quality).cast("int").alias("good")
    )
    n = marked.count()
    share = min(1.0, sample / max(n, 1))
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    rows = (
        docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(chosen)
        .join(marked.filter(chosen), "id").select("id", "text", "good").distinct()
        .select("text", "good", F.xxhash64("id", "text").alias("pick"))
    )

    def featurise(batches):
        for batch in slices(batches, "text"):
            found = Lines(Texts(column(batch, "text")))
            bins, good = found.features().astype(np.int8), column(batch, "good").to_numpy()
            out = []
            for first, n, g, pick in zip(found.first[:-1].tolist(), np.diff(found.first).tolist(), good, column(batch, "pick").to_pylist()):
                if n:
                    parts = -(-n // lines)
                    part = pick % parts
                    a, b = first + part * n // parts, first + (part + 1) * n // parts
                    out.append((pick, bins[a:b].tobytes(), (~found.repeated[a:b] & (g > 0)).astype(np.int8).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                ["pick", "bins", "labels"],
            )

    found = rows.mapInArrow(featurise, "pick bigint, bins binary, labels binary")
    got = found.orderBy("pick", "bins", "labels").limit(2 * sample).collect()
    got.sort(key=lambda r: (bytes(r["bins"]), bytes(r["labels"])))
    kinds = {x for r in got for x in set(bytes(r["labels"]))}
    if kinds != {0, 1}:
        return LineCRF(bias=1.0)
    lengths = np.array([len(r["labels"]) for r in got])
    bins = np.zeros((len(got), lengths.max(), len(CUTS)), np.int64)
    y = np.zeros((len(got), lengths.max()), np.int64)
    for i, r in enumerate(got):
        bins[i, : lengths[i]] = np.frombuffer(r["bins"], np.int8).reshape(-1, len(CUTS))
        y[i, : lengths[i]] = np.frombuffer(r["labels"], np.int8)
    return LineCRF().fit(bins, y, lengths)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(texts: pa.Array, crf: LineCRF, min_share: float = 0.5) -> dict[str, np.ndarray]:
    """All result columns for an array of texts."""
    found = Lines(Texts(texts))
    n = found.counts
    failed = (n["n_words"] < 10) | (100 * n["n_repeat_words"] > 20 * n["n_words"])
    content = crf.emissions(found.features()).tolist()
    share = np.zeros(len(texts))
    for i, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
        if b > a:
            chars = found.chars[a:b]
            share[i] = (chars * np.array(crf.viterbi(content[a:b]))).sum() / max(chars.sum(), 1)
    return n | {"content_share": share, "base_failed": failed, "kept": ~failed & (share >= min_share)}


def quality_rules(
    docs: DataFrame, crf: LineCRF, id: str = "doc_id", text: str = "text", min_share: float = 0.5
) -> DataFrame:
    """One row per row of ``docs``: its id, the counts, ``content_share``, ``base_failed``, ``kept``.

    A null or empty text has no words and fails.  Equal texts get equal results.
    Other columns are not looked at, whatever their names.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            got = judge(column(batch, "text"), crf, min_share)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), *map(pa.array, got.values())], ["id", *got]
            )

    schema = ", ".join([f"id {kind}", *[f"{c} bigint" for c in COUNTS], "content_share double",
                        "base_failed boolean", "kept boolean"])
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)


def keep_good(docs: DataFrame, crf: LineCRF, text: str = "text", min_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged.

    Only the text decides: null and empty texts have too few words and go, as do
    very short ones, copies and repeated rows stay or go together, and other
    columns, whatever they are called or hold, are passed on.  An empty table
    gives an empty one.
    """

    def run(batches):
        for batch in slices(batches, text, PART_BYTES):
            yield batch.filter(pa.array(judge(column(batch, text), crf, min_share)["kept"]))

    return docs.mapInArrow(run, docs.schema)
