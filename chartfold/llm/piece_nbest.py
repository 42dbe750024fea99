"""SentencePiece encoding with N-best segmentations, and decoding.

The pieces that fit a text form a lattice.  Forward Viterbi gives the best score
of every position from the start.  These scores are exact, so a backward A-star
search that adds them to what it has gathered from the end meets complete
segmentations in the order of their scores, and stops after the N-th.

No piece crosses the start of a word or a character that no piece holds, so the
N best of a text are put together from those of its words.  The words of a batch
run through Viterbi side by side, each different one once.  Backward scores tell
what the second best of a word loses; only the words of a text that lose least
can differ in its N best, and only these are searched.
"""

from __future__ import annotations

import sys
from functools import lru_cache
from heapq import heappop, heappush
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartfold.llm.textbatch import Texts, column, mix, slices, span_hashes

MARK = "▁"
LITERAL = 0x110000  # stands for the mark where it is in a text itself: beyond all code points
REMEMBERED = 50_000  # words
REMEMBERED_BYTES = 64 << 20  # what they take, about
UNKNOWN_BELOW = 10.0  # a character without a piece scores so much less than the worst one with
SLOT_BITS = 20
CELLS = 1 << 16  # characters of a block of words
SHORT = 48  # longer words are searched one by one


class Pieces:
    """Pieces and scores of a sentencepiece file with an identity normaliser, as a lattice sees them."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        probe = "ﬁ  Ａ́\t\n"
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{model_path} changes texts before it splits them; only identity files are supported")
        size = sp.get_piece_size()
        self.text: list[str | bytes] = [""] * size
        self.byte = [0] * 256
        self.score = np.zeros(size)
        # a piece with its score and number; what only begins a piece has None
        self.table: dict[str, tuple[float, tuple[int]] | None] = {}
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(p[3:5], 16)
                self.byte[value], self.text[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i], self.score[i] = p.replace(MARK, " "), sp.get_score(i)
                self.table[p] = (sp.get_score(i), (i,))
                for j in range(1, len(p)):
                    self.table.setdefault(p[:j])
        if any(MARK in p.lstrip(MARK) for p in self.table):
            raise ValueError(f"{model_path} has pieces that reach over the start of a word")
        single = [v[0] for p, v in self.table.items() if v and len(p) == 1]
        self.unknown = min(single, default=0.0) - UNKNOWN_BELOW
        self.longest = max(map(len, self.table), default=1)
        # of each code point: is it in a piece
        self.held = np.zeros(LITERAL + 1, bool)
        self.held[[ord(c) for c in set("".join(self.table))]] = True
        self._hash_table()

    def _hash_table(self) -> None:
        """The table as arrays: every prefix of a piece in one of two places that its hash names."""
        keys = [p for p in self.table]
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(keys):
            by_length.setdefault(len(p), []).append(i)
        hashes = np.zeros(len(keys), np.uint64)
        for n, which in by_length.items():
            points = np.frombuffer("".join(keys[i] for i in which).encode(f"utf-32-{sys.byteorder[0]}e"), np.uint32).reshape(-1, n)
            h = np.zeros(len(which), np.uint64)
            for k in range(n):
                h = mix(h + points[:, k] + np.uint64(1))
            hashes[which] = h
        self.slot = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(2)]
        self.value = [np.full(1 << SLOT_BITS, -2, np.int32) for _ in range(2)]
        for h, p in zip(hashes, keys):
            entry = (h, self.table[p][1][0] if self.table[p] else -1)
            for turn in range(200):  # who is in the way goes to its other place
                side = turn % 2
                at = self._place(entry[0], side)
                there = (self.slot[side][at], self.value[side][at])
                self.slot[side][at], self.value[side][at] = entry
                if there[1] == -2:
                    break
                entry = there
            else:
                raise ValueError("the table of pieces is too full")

    @staticmethod
    def _place(h, side: int):
        return h >> np.uint64(64 - SLOT_BITS) if side == 0 else h & np.uint64((1 << SLOT_BITS) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers; -1 for what only begins a piece, -2 for what does not."""
        out = np.full(len(hashes), -2, np.int32)
        for side in (0, 1):
            at = self._place(hashes, side)
            same = self.slot[side][at] == hashes
            out[same] = self.value[side][at[same]]
        return out

    def bytes_of(self, point: int) -> list[int]:
        return [self.byte[b] for b in (MARK if point == LITERAL else chr(point)).encode()]

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length, a row of code points each: pieces of all one after the other,
        pieces of each, best score, and what the second best loses on it."""
        n, size = words.shape
        flat = words.ravel()
        longest = min(self.longest, size)
        edge = np.full((longest + 1, n, size), -inf)  # score of the piece of a length that begins here
        piece = np.full((longest + 1, n, size), -1, np.int32)
        at, h = np.flatnonzero(self.held[flat]), None
        for k in range(1, longest + 1):
            fits = at % size + k <= size
            at, h = at[fits], (np.zeros(fits.sum(), np.uint64) if h is None else h[fits])
            h = mix(h + flat[at + k - 1] + np.uint64(1))
            found = self.find(h)
            hit = found >= 0
            edge[k].ravel()[at[hit]] = self.score[found[hit]]
            piece[k].ravel()[at[hit]] = found[hit]
            at, h = at[found != -2], h[found != -2]
        edge[1][edge[1] == -inf] = self.unknown
        best = np.full((n, size + 1), -inf)
        best[:, 0] = 0
        last = np.zeros((n, size + 1), np.int64)
        for j in range(1, size + 1):
            for k in range(1, min(j, longest) + 1):
                score = best[:, j - k] + edge[k][:, j - k]
                better = score > best[:, j]
                best[better, j], last[better, j] = score[better], k
        rest = np.full((n, size + 1), -inf)
        rest[:, size] = 0
        for i in range(size - 1, -1, -1):
            for k in range(1, min(size - i, longest) + 1):
                np.maximum(rest[:, i], edge[k][:, i] + rest[:, i + k], out=rest[:, i])
        taken = np.zeros((n, size), np.int64)  # length of the piece of the best path that begins here
        row, end = np.arange(n), np.full(n, size)
        while len(row):
            k = last[row, end]
            end = end - k
            taken[row, end] = k
            row, end = row[end > 0], end[end > 0]
        second = np.full(n, -inf)
        for k in range(1, longest + 1):
            through = best[:, : size - k + 1] + edge[k][:, : size - k + 1] + rest[:, k:]
            through[taken[:, : size - k + 1] == k] = -inf
            np.maximum(second, through.max(axis=1), out=second)
        row, start = np.nonzero(taken)
        number = piece[taken[row, start], row, start]
        points = words[row, start]
        count = np.ones(len(row), np.int64)
        unknown = np.unique(points[number < 0])
        for p in unknown:
            count[(number < 0) & (points == p)] = len(self.bytes_of(int(p)))
        place = np.cumsum(count) - count
        ids = np.zeros(count.sum(), np.int32)
        ids[place] = number
        for p in unknown:
            for k, b in enumerate(self.bytes_of(int(p))):
                ids[place[(number < 0) & (points == p)] + k] = b
        pieces = np.bincount(row, count, n).astype(np.int64)
        return ids, pieces, best[:, size], best[:, size] - second

    def nbest(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, pieces) of ``part``, best first; among equal ones, longer last pieces first."""
        size, table = len(part), self.table
        best = [0.0] + [-inf] * size
        # of each way into a position: where from, its score, the best score with it, its pieces
        into: list[list[tuple[int, float, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            here = best[i]
            for j in range(i + 1, size + 1):
                e = table.get(part[i:j], 0)
                if e:
                    score, ids = e
                    upto = here + score
                    into[j].append((i, score, upto, ids))
                    if upto > best[j]:
                        best[j] = upto
                elif e == 0:
                    break
            if not table.get(part[i]):
                upto = here + self.unknown
                into[i + 1].append((i, self.unknown, upto, tuple([self.byte[b] for b in part[i].encode()])))
                if upto > best[i + 1]:
                    best[i + 1] = upto
        found, count = [], 0
        # what is nearer to the start goes first among equals, or ties would be searched in breadth
        heap = [(-best[size], size, 0, 0.0, ())]
        while heap and len(found) < n:
            _, at, _, gathered, path = heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((gathered, tuple(ids)))
                continue
            for i, score, upto, ids in into[at]:
                count += 1
                heappush(heap, (-(gathered + upto), i, count, gathered + score, (ids, path)))
        return found


class Remembered(dict):
    """Results by key.  When it is full it starts afresh, and takes over what is asked for again."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        size = 500 + 4 * len(key[0]) + 40 * (len(key[-1]) + sum(len(ids) for _, ids in got))
        if len(self) >= REMEMBERED or self.held + size > REMEMBERED_BYTES:
            self.old, self.held = dict(self), 0
            self.clear()
        if size <= REMEMBERED_BYTES:
            self[key] = got
            self.held += size
        return got


def _cheapest(near: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
    """The ``n`` least (loss, [(word, its other pieces)]), that of nothing changed first.

    ``near`` has the other choices of the ``n - 1`` words that lose least.  No
    others are in them: with any other word changed there are already ``n`` that
    lose no more.
    """
    heap, out = [(0.0, ())], []
    while heap and len(out) < n:
        loss, changed = heappop(heap)
        out.append((loss, [(k, near[k][which][1]) for k, which in changed]))
        # every set of changes is made from one other: by its last word's next choice, or by one more word
        last = -1
        if changed:
            last, which = changed[-1]
            if which + 1 < len(near[last]):
                more = loss - near[last][which][0] + near[last][which + 1][0]
                heappush(heap, (more, (*changed[:-1], (last, which + 1))))
        for k in range(last + 1, len(near)):
            heappush(heap, (loss + near[k][0][0], (*changed, (k, 0))))
    return out


@lru_cache(maxsize=2)
def _pieces(model_path: str) -> Pieces:
    return Pieces(model_path)


@lru_cache(maxsize=2)
def _others(model_path: str, n: int) -> Remembered:
    """Of a word and its best pieces: what others lose on it, and they, least first."""

    def search(key: tuple[str, float, tuple[int, ...]]) -> list[tuple[float, tuple[int, ...]]]:
        word, score, best = key
        return [(score - s, ids) for s, ids in _pieces(model_path).nbest(word, n) if ids != best][: n - 1]

    return Remembered(search)


def _words(array: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, a mark before each that is not empty; where words begin; the first word of each text."""
    texts = Texts(array)
    raw = np.frombuffer(texts.data.tobytes().decode().encode(f"utf-32-{sys.byteorder[0]}e"), np.uint32)
    at = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])[texts.at]
    full = np.diff(at) > 0
    ahead = np.cumsum(full)  # marks put in up to each text
    flat = np.full(len(raw) + int(full.sum()), ord(MARK), np.uint32)
    marked = np.where(raw == ord(MARK), LITERAL, np.where(raw == ord(" "), ord(MARK), raw)).astype(np.uint32)
    flat[np.arange(len(raw)) + np.repeat(ahead, np.diff(at))] = marked
    begin = at + np.concatenate([[0], ahead])
    space, apart = flat == ord(MARK), ~pieces.held[flat]
    before = np.concatenate([[False], space[:-1]])
    alone = np.concatenate([[False], apart[:-1]])
    new = apart | (space & ~before) | (~space & alone)
    new[begin[:-1][full]] = True
    return flat, np.flatnonzero(new), np.searchsorted(np.flatnonzero(new), begin)


def segment(array: pa.Array, model_path: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """Of each text: its best pieces (all one after the other, and where each text's begin), their score, and the next best."""
    pieces, known = _pieces(model_path), _others(model_path, n)
    flat, begin, first = _words(array, pieces)
    end = np.concatenate([begin[1:], [len(flat)]])[: len(begin)]
    _, example, word = np.unique(span_hashes(flat, begin, end), return_index=True, return_inverse=True)
    size = (end - begin)[example]
    place, count = np.zeros(len(example), np.int64), np.zeros(len(example), np.int64)
    score, gap = np.zeros(len(example)), np.full(len(example), inf)
    found, total = [np.zeros(0, np.int32)], 0
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        length = int(size[order[at]])
        same = int(np.searchsorted(size[order], length, "right"))
        which = order[at : min(same, at + max(1, CELLS // length))]
        if length > SHORT:
            which = which[:1]
            text = "".join(map(chr, flat[begin[example[which[0]]] :][:length]))
            ways = pieces.nbest(text, 2)
            ids, many = np.array(ways[0][1], np.int32), np.array([len(ways[0][1])])
            best, lost = np.array([ways[0][0]]), np.array([ways[0][0] - ways[1][0] if len(ways) > 1 else inf])
        else:
            ids, many, best, lost = pieces.viterbi(flat[begin[example[which]][:, None] + np.arange(length)])
        found.append(ids)
        place[which], count[which] = total + np.cumsum(many) - many, many
        score[which], gap[which] = best, lost
        total += len(ids)
        at += len(which)
    found = np.concatenate(found)

    upto = np.concatenate([[0], np.cumsum(count[word])])  # pieces before each word
    ids = found[np.repeat(place[word] - upto[:-1], count[word]) + np.arange(upto[-1])]
    scores, others = np.zeros(len(array)), []
    for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        others.append(rows := [])
        if a == b:
            continue
        scores[t] = score[word[a:b]].sum()
        if n == 1:
            continue
        lost = gap[word[a:b]]
        least = np.argsort(lost, kind="stable")[: n - 1] if b - a <= 4 * n else np.argpartition(lost, n - 2)[: n - 1]
        least = sorted(a + i for i in least.tolist() if lost[i] < inf)
        near = []
        for i in least:
            w = word[i]
            text = "".join(map(chr, flat[begin[i] : end[i]]))
            near.append(known[text, float(score[w]), tuple(found[place[w] : place[w] + count[w]].tolist())])
        for loss, changes in _cheapest(near, n)[1:]:
            rows.append({"score": float(scores[t] - loss), "edits": [
                {"at": int(upto[least[k]] - upto[a]), "drop": int(count[word[least[k]]]), "ids": list(other)}
                for k, other in sorted(changes)
            ]})
    return ids, upto[first], scores, others


def encode_text(text: str | None, model_path: str, n: int = 3) -> tuple[bytes, float, list[dict]]:
    """Best pieces (int32) of one text, their score, and the next best ones as edits of these."""
    ids, _, scores, others = segment(pa.array([text], pa.string()), model_path, n)
    return ids.tobytes(), float(scores[0]), others[0]


EDITS = "array<struct<score: double, edits: array<struct<at: int, drop: int, ids: array<int>>>>>"


def encode(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id, ``ids``, ``score``, ``others``, ``round_trip``.

    ``ids`` is the best segmentation of the whole text, and ``others`` are the
    next ``n - 1``, fewer if there are no more: each by its score and the edits
    that make it from ``ids`` (``drop`` pieces from ``at`` on give way to its
    ``ids``).  ``round_trip`` tells whether decoding ``ids`` gives the text (for
    null, the empty one).  A score is the sum of the scores in the file; a character without
    a piece, and a word mark in the text itself, becomes its UTF-8 bytes.  Null and empty texts have no pieces.  No
    begin or end piece is added, and no string in a text is taken for one.
    Other columns are not looked at.  ``model_path`` must exist on every machine.
    """
    kind = docs.schema[id].dataType.simpleString()
    edit = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    other = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))]))

    def run(batches):
        for batch in slices(batches, "text"):
            texts = column(batch, "text")
            ids, at, scores, others = segment(texts, model_path, n)
            same = [
                decode_ids(ids[a:b].tolist(), model_path) == (t or "")
                for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), texts.to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                 pa.array(scores), pa.array(others, other), pa.array(same)],
                ["id", "ids", "score", "others", "round_trip"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    encoded = rows.mapInArrow(run, f"id {kind}, ids array<int>, score double, others {EDITS}, round_trip boolean")
    return encoded.withColumnRenamed("id", id)


def decode_ids(ids: np.ndarray, model_path: str) -> str:
    """The text of ``ids``: bytes that do not make characters come out as U+FFFD."""
    table = _pieces(model_path).text
    out: list[str] = []
    raw = bytearray()
    for piece in map(table.__getitem__, ids):
        if type(piece) is bytes:
            raw += piece
            continue
        if raw:
            out.append(raw.decode(errors="replace"))
            raw.clear()
        out.append(piece)
    if raw:
        out.append(raw.decode(errors="replace"))
    return "".join(out).removeprefix(" ")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids`` as ``out``, in the place of a column of that name.  Null stays null."""
    kept = [f for f in encoded.schema.fields if f.name != out]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{out}` string"])

    def run(batches):
        for batch in batches:
            lists = column(batch, ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            texts = [
                decode_ids(flat[a:b].tolist(), model_path) if ok else None
                for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, f.name) for f in kept], pa.array(texts, pa.string())], [*[f.name for f in kept], out]
            )

    return encoded.mapInArrow(run, schema)
