"""Language of texts and of the spans in mixed ones.

Every word is scored for every language by the character n-grams in it.  The
script of the word leaves only languages that are written in it.  Viterbi
decoding over the words of a text, with a penalty for every switch, labels its
spans, and the language of most of the text is the answer.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartfold.llm.textbatch import Texts, column, slices

GRAMS = (1, 2, 3, 4)
BITS = 15
SLOTS = 1 << BITS
NONE = "und"

# Fixed values of Unicode: where stretches of code points of a script begin.
SCRIPT_FROM = {
    0x0: "latin", 0x370: "greek", 0x400: "cyrillic", 0x530: "armenian", 0x590: "hebrew", 0x600: "arabic",
    0x700: "syriac", 0x750: "arabic", 0x780: "thaana", 0x7C0: "other", 0x870: "arabic", 0x900: "devanagari",
    0x980: "bengali", 0xA00: "gurmukhi", 0xA80: "gujarati", 0xB00: "oriya", 0xB80: "tamil", 0xC00: "telugu",
    0xC80: "kannada", 0xD00: "malayalam", 0xD80: "sinhala", 0xE00: "thai", 0xE80: "lao", 0xF00: "tibetan",
    0x1000: "myanmar", 0x10A0: "georgian", 0x1100: "hangul", 0x1200: "ethiopic", 0x13A0: "other", 0x1780: "khmer",
    0x1800: "mongolian", 0x18B0: "other", 0x1C80: "cyrillic", 0x1C90: "georgian", 0x1CC0: "other", 0x1D00: "latin",
    0x1F00: "greek", 0x2000: "other", 0x2C60: "latin", 0x2C80: "other", 0x2D00: "georgian", 0x2D30: "other",
    0x2D80: "ethiopic", 0x2DE0: "cyrillic", 0x2E00: "other", 0x2E80: "han", 0x2FE0: "other", 0x3005: "han",
    0x3008: "other", 0x3021: "han", 0x302A: "other", 0x3038: "han", 0x303C: "other", 0x3040: "kana", 0x3100: "bopomofo",
    0x3130: "hangul", 0x3190: "other", 0x31A0: "bopomofo", 0x31C0: "other", 0x31F0: "kana", 0x3200: "other",
    0x3400: "han", 0xA000: "other", 0xA640: "cyrillic", 0xA6A0: "other", 0xA720: "latin", 0xA800: "other",
    0xA960: "hangul", 0xA980: "other", 0xAB30: "latin", 0xAB70: "other", 0xAC00: "hangul", 0xD800: "other",
    0xF900: "han", 0xFB00: "latin", 0xFB13: "armenian", 0xFB1D: "hebrew", 0xFB50: "arabic", 0xFE00: "other",
    0xFE70: "arabic", 0xFF00: "latin", 0xFF66: "kana", 0xFFA0: "hangul", 0xFFE0: "other", 0x20000: "han", 0x40000: "other",
}
SCRIPTS = tuple(dict.fromkeys(SCRIPT_FROM.values()))


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: is it a letter, its script, its lower case (where that is one code point)."""
    n = 0x110000
    letter, lower = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for c in range(n):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            if len(t := s.lower()) == 1:
                lower[c] = ord(t)
    number = np.array([SCRIPTS.index(s) for s in SCRIPT_FROM.values()], np.int8)
    script = number[np.searchsorted([*SCRIPT_FROM], np.arange(n), "right") - 1]
    return letter, script, lower


class Chars:
    """The words of a batch as code points, and the n-grams of each word.

    Words are padded by one mark on both sides; characters that are no letters
    only part words.
    """

    def __init__(self, array: pa.Array):
        texts = Texts(array)
        points = np.frombuffer(texts.data.tobytes().decode().encode(f"utf-32-{sys.byteorder[0]}e"), np.uint32)
        is_letter, script, lower = _characters()
        letter = is_letter[points]
        at = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])[texts.at]
        edge = np.zeros(len(points) + 1, bool)
        edge[at] = True
        begin = np.flatnonzero(letter & (edge[:-1] | ~np.concatenate([[False], letter[:-1]]))) if len(points) else at[:0]
        end = np.flatnonzero(letter & (edge[1:] | ~np.concatenate([letter[1:], [False]]))) + 1 if len(points) else at[:0]
        self.size = end - begin  # letters of each word
        self.first = np.searchsorted(begin, at)
        self.script = script[points[begin]]
        # the letters of all words with a mark before and after each word
        n = len(begin)
        self.start = np.cumsum(np.concatenate([[0], self.size + 2]))
        flat = np.zeros(self.start[-1], np.uint32)
        where = np.repeat(self.start[:-1] + 1 - np.concatenate([[0], np.cumsum(self.size)])[:-1], self.size)
        letters = lower[points[letter]]
        flat[where + np.arange(len(letters))] = letters
        self.flat, self.n = flat, n

    def grams(self):
        """For each length: slot of each n-gram, and how many each word has."""
        x = self.flat.astype(np.uint64)
        step = np.uint64(0x9E3779B97F4A7C15)
        for k in GRAMS:
            if len(x) < k:
                continue
            h = np.full(len(x) - k + 1, np.uint64(k))
            for i in range(k):
                h = (h ^ x[i : i + len(h)]) * step
                h ^= h >> np.uint64(29)
            slot = ((h * step) >> np.uint64(64 - BITS)).astype(np.int32)
            count = np.maximum(self.size + 3 - k, 0)
            inside = np.repeat(self.start[:-1] - np.concatenate([[0], np.cumsum(count)])[:-1], count)
            yield k, slot[inside + np.arange(count.sum())], count


@dataclass(frozen=True)
class Model:
    """``logs``: per n-gram length, slot and language, how far the n-gram speaks for the language."""

    languages: tuple[str, ...]
    logs: np.ndarray
    scripts: np.ndarray  # (script, language): is it written in it
    penalty: float

    def word_scores(self, chars: Chars) -> np.ndarray:
        total = np.zeros((chars.n, len(self.languages)))
        for k, slot, count in chars.grams():
            at = np.concatenate([[0], np.cumsum(count)])
            logs = self.logs[k - 1]
            for j in range(len(self.languages)):
                sums = np.concatenate([[0.0], np.cumsum(logs[slot, j], dtype=np.float64)])
                total[:, j] += sums[at[1:]] - sums[at[:-1]]
        allowed = self.scripts[chars.script]
        allowed |= ~allowed.any(axis=1, keepdims=True)  # a script that no language is known to use tells nothing
        return np.where(allowed, total, total.min(initial=0.0) - 50.0)

    def label(self, array: pa.Array) -> tuple[Chars, np.ndarray, np.ndarray]:
        """The words, the language number of each, and their scores."""
        chars = Chars(array)
        scores = self.word_scores(chars)
        return chars, viterbi(scores, chars.first, self.penalty), scores


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of all words; texts go side by side, one word of each at a time.

    ``first`` has the first word of each text.  Every switch costs ``penalty``.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")  # the longest texts first, so that those left are a prefix
    starts, size = first[:-1][order], size[order]
    back = np.zeros(scores.shape, np.int16)  # the label before, for each label of each word
    label = np.zeros(len(scores), np.int64)
    if not len(size) or not size[0]:
        return label
    languages = np.arange(scores.shape[1], dtype=np.int16)
    lefts = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts longer than t
    best = scores[starts[: lefts[0]]].copy()
    for t in range(1, size[0]):
        n = lefts[t]
        now, at = best[:n], starts[:n] + t
        top = now.argmax(axis=1)
        jump = now[np.arange(n), top] - penalty
        stay = now >= jump[:, None]
        back[at] = np.where(stay, languages, top[:, None])
        best[:n] = np.where(stay, now, jump[:, None]) + scores[at]
    current = best.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = lefts[t]
        at = starts[:n] + t
        label[at] = current[:n]
        current[:n] = back[at, current[:n]]
    return label


def held_out(id: Column) -> Column:
    """The fifth of the documents that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", penalty: float = 8.0,
    least_share: float = 0.01,
) -> Model | None:
    """Counts the n-grams of all documents with a language that are not held out.

    Each task counts into one table per language, whose size is fixed, and these
    are summed up.  A language is written in the scripts that ``least_share`` of
    its words are in.  None without any such document.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))
    )
    cells = len(GRAMS) * SLOTS

    def count(batches):
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, "text"):
            names = column(batch, "lang").to_pylist()
            chars = Chars(column(batch, "text"))
            for name in set(names):
                grams, scripts = tables.setdefault(name, (np.zeros((len(GRAMS), SLOTS), np.int64), np.zeros(len(SCRIPTS), np.int64)))
            number = {name: i for i, name in enumerate(tables)}
            of_word = np.repeat([number[x] for x in names], np.diff(chars.first))
            listed = list(tables.values())
            for k, slot, n in chars.grams():
                both = np.repeat(of_word, n) * SLOTS + slot
                found = np.bincount(both, minlength=len(listed) * SLOTS).reshape(-1, SLOTS)
                for (grams, _), f in zip(listed, found):
                    grams[k - 1] += f
            found = np.bincount(of_word * len(SCRIPTS) + chars.script, minlength=len(listed) * len(SCRIPTS))
            for (_, scripts), f in zip(listed, found.reshape(-1, len(SCRIPTS))):
                scripts += f
        for name, (grams, scripts) in tables.items():
            flat = np.concatenate([scripts, grams.ravel()])
            # a stretch of the table per row, so that adding up is spread over tasks
            for part, a in enumerate(range(0, len(flat), STRETCH)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([part], pa.int32()), pa.array([flat[a : a + STRETCH].tobytes()], pa.binary())],
                    ["lang", "part", "counts"],
                )

    def add(batches):
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                got = np.frombuffer(counts, np.int64)
                held[name, part] = held[name, part] + got if (name, part) in held else got
        for (name, part), counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())],
                ["lang", "part", "counts"],
            )

    schema = "lang string, part int, counts binary"
    parts = rows.select("text", "lang").mapInArrow(count, schema).repartition("lang", "part").mapInArrow(add, schema)
    tables: dict[str, np.ndarray] = {}
    for r in parts.collect():  # the tables of a language have a fixed size
        flat = tables.setdefault(r["lang"], np.zeros(len(SCRIPTS) + cells, np.int64))
        flat[r["part"] * STRETCH :][: len(r["counts"]) // 8] += np.frombuffer(r["counts"], np.int64)
    languages = tuple(sorted(tables))
    counts = [tables[x][len(SCRIPTS):].reshape(len(GRAMS), SLOTS) for x in languages]
    if not sum(c.sum() for c in counts):
        return None
    logs = np.stack([np.log((c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * SLOTS)) for c in counts], axis=-1)
    logs -= logs.mean(axis=-1, keepdims=True)  # only differences between languages matter
    used = np.stack([tables[x][: len(SCRIPTS)] for x in languages], axis=-1)
    scripts = used >= np.maximum(1, least_share * used.sum(axis=0))
    return Model(languages, logs.astype(np.float32), scripts, penalty)


STRETCH = 1 << 14


def _decide(model: Model, array: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text and the share of its letters that is in it."""
    chars, label, _ = model.label(array)
    n, m = len(array), len(model.languages)
    of_text = np.repeat(np.arange(n), np.diff(chars.first))
    letters = np.bincount(of_text * m + label, chars.size, minlength=n * m).reshape(n, m)
    top, total = letters.argmax(axis=1), letters.sum(axis=1)
    names = [model.languages[i] if t else NONE for i, t in zip(top, total)]
    return names, np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)


def identify(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``lang_pred``, ``score``.

    ``score`` is the share of the letters that lie in spans of the language.
    ``und`` with score 0 stands for a text that is null or has no letter, and
    for all texts where there is no model.  Ties go to the language that sorts
    first.  Other columns are not looked at, whatever their names.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            array = column(batch, "text")
            names, share = _decide(model, array) if model else ([NONE] * len(array), np.zeros(len(array)))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(names, pa.string()), pa.array(share)], ["id", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def spans(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span of one language: id, ``span``, ``lang``, ``first_word``, ``words``, ``letters``.

    Words are runs of letters, counted from 0.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            chars, label, _ = model.label(column(batch, "text"))
            of_text = np.repeat(np.arange(batch.num_rows), np.diff(chars.first))
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (of_text[1:] != of_text[:-1])
            at = np.flatnonzero(new)
            ends = np.concatenate([at[1:], [len(label)]])
            letters = np.concatenate([[0], np.cumsum(chars.size)])
            row, first = of_text[at], at - chars.first[of_text[at]]
            place = np.arange(len(at)) - np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id").take(pa.array(row)), pa.array(place.astype(np.int32)),
                 pa.array([model.languages[i] for i in label[at]], pa.string()), pa.array(first.astype(np.int64)),
                 pa.array(ends - at), pa.array(letters[ends] - letters[at])],
                ["id", "span", "lang", "first_word", "words", "letters"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = f"id {kind}, span int, lang string, first_word bigint, words bigint, letters bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)
