"""BPE encoding with a backtracking search for tokens, and decoding by an offset table.

A row of tokens is what byte-pair merging makes of its bytes if and only if every
two neighbours are: no merge across their boundary would have come before the
merges that built them.  So there is no need to merge.  An Aho-Corasick automaton
finds the longest token that begins at each place; the encoder takes the longest
one that is compatible with the token before, shorter ones if need be, and goes
back a token where none is.  Since the tokens of a prefix are unique, a place that
was left once is never entered again, and the time is linear in the text.

Whether two tokens are compatible follows from how they were built.  A token's
right edge goes through a chain of ever larger tokens, each there from its own
merge to the next one; the left edge of its neighbour likewise.  A merge of two
edges that exist at the same time, ranked before either of them ends, crosses the
boundary.  Answers are kept in a table of pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartfold.llm.textbatch import Texts, column, fresh, places, slices

# Fixed value: how the supported files cut a text into words before any merge.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed value: white space as the tokenizers library sees it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

PAIRS_KEPT = 1 << 20
WORDS_KEPT_BYTES = 48 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level file: itself where it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Merges:
    """Tokens of a byte-level BPE file and which of them can stand side by side.

    A token is known by its symbols: a character for each byte, 256 higher where
    the byte ends a word.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        letters = {c: b for b, c in enumerate(byte_letters())}
        size = max(vocab.values()) + 1
        self.symbols: list[str | None] = [None] * size
        for text, i in vocab.items():
            if text in letters:
                self.symbols[i] = chr(letters[text])
            elif suffix and text.endswith(suffix) and text[: -len(suffix)] in letters:
                self.symbols[i] = chr(letters[text[: -len(suffix)]] + 256)
        if sum(s is not None for s in self.symbols) != (512 if suffix else 256):
            raise ValueError("the file does not have a token for every byte")
        self.rank = [-1] * size  # bytes are there before any merge
        self.made: dict[tuple[int, int], int] = {}
        self.right: list[tuple[int, ...]] = [(i,) for i in range(size)]  # what a token's right edge was, smallest first
        self.left: list[tuple[int, ...]] = [(i,) for i in range(size)]
        usable = [s is not None for s in self.symbols]
        for rank, pair in enumerate(merges):
            a, b = (vocab[t] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            c = vocab[pair.replace(" ", "", 1) if isinstance(pair, str) else "".join(pair)]
            if self.symbols[c] is not None or self.symbols[a] is None or self.symbols[b] is None:
                raise ValueError("merges must come in order, and one for each token")
            self.symbols[c] = self.symbols[a] + self.symbols[b]
            self.rank[c] = rank
            # a token that its own bytes would not be merged into is never seen
            usable[c] = usable[a] and usable[b] and not self._crossed(a, b, rank)
            self.made[a, b] = c
            self.right[c] = (*self.right[b], c)
            self.left[c] = (*self.left[a], c)
        self._kept: dict[int, bool] = {}
        tokens = {s: i for i, s in enumerate(self.symbols) if s is not None and usable[i]}
        self.length = [len(s or "") for s in self.symbols]
        #: the longest token that a token begins with; -1: none
        self.shorter = [-1] * size
        for s, i in tokens.items():
            self.shorter[i] = next((tokens[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in tokens), -1)
        self.automaton = ahocorasick.Automaton()
        for s, i in tokens.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def _crossed(self, a: int, b: int, limit: float) -> bool:
        """Whether a merge across the boundary of ``a`` and ``b`` comes before the rank ``limit``.

        Of equal pairs the left one is merged first: an edge of ``a`` has gone by
        the time of its next merge, an edge of ``b`` is still there.
        """
        edges_a, edges_b, rank = self.right[a], self.left[b], self.rank
        i = j = 0
        while True:
            end_a = rank[edges_a[i + 1]] if i + 1 < len(edges_a) else limit
            end_b = rank[edges_b[j + 1]] if j + 1 < len(edges_b) else limit
            c = self.made.get((edges_a[i], edges_b[j]))
            if c is not None and rank[c] < min(end_a, limit) and (rank[c] <= end_b if end_b < limit else rank[c] < limit):
                return True
            if end_a >= limit and end_b >= limit:
                return False
            if end_a <= end_b:
                i += 1
            else:
                j += 1

    def fit(self, a: int, b: int) -> bool:
        """The table of pairs: whether ``b`` can follow ``a``."""
        key = a << 32 | b
        known = self._kept.get(key)
        if known is None:
            if len(self._kept) >= PAIRS_KEPT:
                self._kept.clear()
            known = self._kept[key] = not self._crossed(a, b, float("inf"))
        return known

    def encode(self, symbols: str) -> list[int]:
        """The tokens that merging makes of ``symbols``."""
        n, length, shorter, fit = len(symbols), self.length, self.shorter, self.fit
        longest = [-1] * n
        for end, token in self.automaton.iter(symbols):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        alive = bytearray(b"\1") * (n + 1)
        path: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and not (alive[at + length[token]] and (not path or fit(path[-1], token))):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0  # nothing can follow here: take less for the token that led here
                token = path.pop()
                at -= length[token]
                token = shorter[token]
        return path


class WordTokens(dict):
    """A number for every word seen, and the tokens of the word with that number.

    What it holds is counted in bytes; :meth:`renew`, called between slices,
    starts it afresh when that is too much.
    """

    def __init__(self, merges: Merges, suffix: bool, special: dict[str, int]):
        super().__init__()
        self.merges, self.suffix, self.special = merges, suffix, special
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.tokens, self.ends = array("I"), array("q", [0])
        self.held = 0
        for text, i in self.special.items():
            self._add(text, [i])

    def _add(self, word: str, tokens: list[int]) -> int:
        self.tokens.extend(tokens)
        self.ends.append(len(self.tokens))
        self.held += 200 + 4 * len(word) + 4 * len(tokens)
        self[word] = number = len(self.ends) - 2
        return number

    def __missing__(self, word: str) -> int:
        symbols = word.encode().decode("latin-1")
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + 256)
        return self._add(word, self.merges.encode(symbols))

    def renew(self) -> None:
        if self.held > WORDS_KEPT_BYTES:
            self._empty()

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words with ``numbers``, one after the other, and how many each has."""
        ends, tokens = np.frombuffer(self.ends, np.int64), np.frombuffer(self.tokens, np.uint32)
        size = ends[numbers + 1] - ends[numbers]
        return tokens[places(ends[numbers], size)], size


def _ranges(points: list[int]) -> str:
    """``points``, in order, as the inside of a character class."""
    out = []
    for _, run in groupby(enumerate(points), lambda x: x[1] - x[0]):
        run = [p for _, p in run]
        out.append(f"\\u{run[0]:04x}-\\u{run[-1]:04x}")
    return "".join(out)


class WordSplitter:
    """Cuts texts into the words that are merged, special tokens among them.

    Python's own tables serve for the characters that they know below U+10000;
    texts with others are cut by the library's normaliser and pattern, whose
    tables may be newer.
    """

    def __init__(self, config: dict):
        from tokenizers import Regex, normalizers, pre_tokenizers

        steps = [(n["type"], n.get("pattern")) for n in (config["normalizer"] or {}).get("normalizers", [])]
        cuts = [(p["type"], p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex"))
                for p in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)] or cuts != [
            ("Split", {"Regex": WORD_PATTERN}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False),
        ]:
            raise ValueError("only files with NFC, lower case and the usual words are supported")
        # white space only parts words, so it need not be made one blank
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.cut = pre_tokenizers.Split(Regex(WORD_PATTERN), "removed", invert=True).pre_tokenize_str
        kinds: dict[str, list[int]] = {"L": [], "N": [], "Cn": []}
        for point in range(0x10000):
            kind = unicodedata.category(chr(point))
            kinds.get(kind if kind == "Cn" else kind[0], []).append(point)
        letters, numbers = _ranges(kinds["L"]), _ranges(kinds["N"])
        pattern = WORD_PATTERN.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
        self.words = re.compile(pattern.replace(r"\s\p{L}\p{N}", f"{WHITE}{letters}{numbers}")).findall
        self.newer = re.compile(f"[{_ranges(kinds['Cn'])}\\U00010000-\\U0010ffff]").search
        added = config.get("added_tokens", [])
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens must be found in texts as they are")
        self.special = {t["content"]: t["id"] for t in added}
        self.parts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")

    def __call__(self, text: str) -> list[str]:
        if not self.parts.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.parts.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.words(text.lower())
        composed = unicodedata.normalize("NFC", text)
        if self.newer(composed):
            return [w for w, _ in self.cut(self.normal(text))]
        # every capital sigma alike, also at the end of a word
        return self.words("σ".join([t.lower() for t in composed.split("Σ")]))


def _config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    model = config["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        raise ValueError(f"{path} is not a plain BPE file")
    return config


class Encoder:
    """Splits and encodes as a byte-level BPE file says."""

    def __init__(self, path: str):
        config = _config(path)
        model = config["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.split = WordSplitter(config)
        self.known = WordTokens(Merges(model["vocab"], model["merges"], suffix), bool(suffix), self.split.special)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, one after the other, and where each text's begin, and the end."""
        self.known.renew()
        words = [self.split(t) if t else [] for t in texts]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(first[-1]))
        tokens, size = self.known.of(number)
        return tokens, np.concatenate([[0], np.cumsum(size)])[first]


class Decoder:
    """The tokens' texts in one buffer, each with the blank that follows it, and where each begins."""

    def __init__(self, path: str):
        config = _config(path)
        if config.get("decoder"):
            raise ValueError(f"{path} has a decoder; only tokens with blanks between them are supported")
        names = {i: t for t, i in config["model"]["vocab"].items()} | {t["id"]: t["content"] for t in config["added_tokens"]}
        texts = [f"{names.get(i, '')} ".encode() for i in range(max(names) + 1)]
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts whose tokens begin at ``at``, and where each text begins, and the end."""
        size = self.begin[tokens + 1] - self.begin[tokens]
        upto = np.concatenate([[0], np.cumsum(size)])[at]
        data = self.text[places(self.begin[tokens], size)]
        # no blank behind the last token of a text
        some = np.diff(at) > 0
        keep = np.ones(len(data), bool)
        keep[upto[1:][some] - 1] = False
        return data[keep], upto - np.concatenate([[0], np.cumsum(some)])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``ids`` (the tokens), ``n_tokens`` and ``ids_sha256``.

    Tokens are those of the tokenizers library without begin and end tokens; the
    file's special tokens inside a text are taken as such.  ``ids_sha256`` is of
    the tokens as little-endian 32-bit numbers.  A null or empty text, and one of
    white space alone, has none.  Repeated rows are encoded one by one, a null id
    stays null, other columns are not looked at, whatever their names, and an
    empty table gives an empty one.  ``path`` must exist on every machine.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            tokens, at = encoder(path).encode(column(batch, "text").to_pylist())
            raw, edge = tokens.astype("<u4").tobytes(), (4 * at).tolist()
            digest = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.astype(np.int32))),
                 pa.array(np.diff(at)), pa.array(digest, pa.string())],
                ["id", "ids", "n_tokens", "ids_sha256"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens bigint, ids_sha256 string").withColumnRenamed("id", id)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the tokens ``ids`` in a column ``out``, which replaces one of that name.

    Special tokens are part of the text.  No tokens, and a null list, give an
    empty text; a token that the file does not have, or a null one, fails.
    """
    kept = [c for c in df.columns if c.lower() != out.lower()]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(ids, F.array().cast("array<int>")).alias(fresh("ids", kept)))
    name = rows.columns[-1]
    schema = rows.drop(name).withColumn(out, F.lit("")).schema

    def run(batches):
        for batch in batches:
            for part in _token_slices(batch, name):
                lists = part.column(part.schema.get_field_index(name))
                values = lists.flatten()
                if values.null_count:
                    raise ValueError("a token is null")
                at = lists.offsets.to_numpy().astype(np.int64)
                data, upto = decoder(path).decode(values.to_numpy().astype(np.int64), at - at[0])
                text = pa.StringArray.from_buffers(len(part), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([*part.drop_columns([name]).columns, text], [*kept, out])

    return rows.mapInArrow(run, schema)


def _token_slices(batch: pa.RecordBatch, name: str, tokens: int = 1 << 20):
    """The rows of ``batch`` in slices of about so many tokens, one row at least."""
    at = batch.column(batch.schema.get_field_index(name)).offsets.to_numpy().astype(np.int64)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + tokens, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
