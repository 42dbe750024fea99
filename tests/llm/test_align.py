"""Alignment of two tokenizers against a plain form of it, with the libraries' tokens."""

import hashlib
import random
import sys
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brute import messy
from chartfold.llm import align
from chartfold.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES, table
from chartfold.sources import scratch

TEXTS = st.lists(st.sampled_from([
    "a", "the", "ing", " ", "  ", "\n", "é", "É", "<|endoftext|>", "</s>", "<0x0A>", "▁", "執", "🙂", "12", "'s", "Ａ", "ﬁ", "====", "\x00", "ß",
]), max_size=25).map("".join)


@pytest.fixture(scope="module")
def libraries():
    byte = Tokenizer.from_file(BYTE_MODEL)
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def tokens(libraries, text):
    """(id, bytes) of both, or nothing."""
    byte, piece = libraries
    value = {c: b for b, c in enumerate(align.byte_letters())}
    a = [(i, bytes(value[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + (text or ""), add_special_tokens=False).ids]
    b = []
    for i in piece.encode(text or ""):
        p = piece.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + (text or "")).encode()
    if not text or any(b"".join(t for _, t in x) != want for x in (a, b)):
        return [], []
    return a, b


def grouped(a, b):
    """The groups as pairs of lists of ids."""
    ends = [set(np.cumsum([len(t) for _, t in x]).tolist()) for x in (a, b)]
    both = np.array(sorted(ends[0] & ends[1]), np.int64)
    out = [([], []) for _ in both]
    for side, x in enumerate((a, b)):
        at = 0
        for i, t in x:
            at += len(t)
            out[int(np.searchsorted(both, at))][side].append(i)
    return out


def expected(libraries, texts):
    """Result columns of every text."""
    groups = [grouped(*tokens(libraries, t)) for t in texts]
    linked = [Counter((x, y) for g, h in doc for x in g for y in h) for doc in groups]
    count = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for doc, c in zip(groups, linked):
        spelled = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in doc)
        yield (
            sum(len(g) for g, _ in doc), sum(len(h) for _, h in doc), len(doc), sum(c.values()),
            sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if doc else "",
        )


def results(df):
    return [(r.doc_id, *[r[c] for c in align.RESULT], r.groups_sha256) for r in df.collect()]


def ends_of(values):
    return np.cumsum(np.array(values, np.int64))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=60),
       st.integers(0, 40))
def test_runs_cover_both_arrays(x, y, same):
    shared = [2] * same
    a, b = ends_of([1, *shared, *x]), ends_of([1, *shared, *y])
    end = max(a[-1], b[-1]) + 1
    a, b = np.append(a, end), np.append(b, end)
    regular, irregular = align.runs(a, b)
    found = [((k, k + 1), (j + k - i, j + k - i + 1)) for i, j, n in regular.tolist() for k in range(i, i + n)]
    found = sorted([*found, *[((i, p), (j, q)) for i, j, p, q in irregular.tolist()]])
    both = sorted(set(a.tolist()) & set(b.tolist()))
    want_a, want_b = [0, *(np.searchsorted(a, both) + 1).tolist()], [0, *(np.searchsorted(b, both) + 1).tolist()]
    assert found == sorted(zip(zip(want_a, want_a[1:]), zip(want_b, want_b[1:])))
    assert all(p - i > 1 or q - j > 1 for i, j, p, q in irregular.tolist())


def test_long_equal_stretches_are_compared_in_few_steps():
    a = np.arange(1, 200_001)
    regular, irregular = align.runs(a, a)
    assert regular.tolist() == [[0, 0, 200_000]] and not len(irregular)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([1, 255, 256, 257, 65_535, 65_536, 65_537]), min_size=1, max_size=40),
       st.lists(st.sampled_from([1, 255, 256, 257, 65_535, 65_536, 65_537]), min_size=1, max_size=40), st.integers(0, 40))
def test_runs_of_long_tokens(x, y, same):
    shared = [65_792] * same
    a, b = ends_of([1, *shared, *x, *shared]), ends_of([1, *shared, *y, *shared])
    end = max(a[-1], b[-1]) + 1
    a, b = np.append(a, end), np.append(b, end)
    regular, irregular = align.runs(a, b)
    last = sorted([*[i + k for i, _, n in regular.tolist() for k in range(n)], *[p - 1 for _, _, p, _ in irregular.tolist()]])
    assert a[last].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in regular.tolist())


def test_runs_of_nothing():
    regular, irregular = align.runs(ends_of([]), ends_of([]))
    assert regular.shape == (0, 3) and irregular.shape == (0, 4)


def test_an_irregular_group_takes_few_steps():
    """Lines of Python that run, per irregular group: 51 when stretches were halved."""
    a, b = ends_of([*[2] * 9, 1, 3] * 1000), ends_of([*[2] * 9, 3, 1] * 1000)
    lines = 0

    def trace(frame, event, _):
        nonlocal lines
        if frame.f_code is not align.runs.__code__:
            return None
        lines += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        _, irregular = align.runs(a, b)
    finally:
        sys.settrace(before)
    assert len(irregular) == 1000 and lines < 25 * 1000


def test_digests_lay_out_no_index_per_digit(libraries):
    made = align.aligner(BYTE_MODEL, PIECE_MODEL)
    a, b = made.tokens(["the old river and the mountain are far away " * 5000])
    groups = align.Groups(a, b)
    tracemalloc.start()
    try:
        align.group_digests(a, b, groups, made.numerals)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 64 * (len(a.ids) + len(b.ids))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), min_size=1, max_size=6))
def test_tokens_of_a_block(libraries, texts):
    a, b = align.aligner(BYTE_MODEL, PIECE_MODEL).tokens(texts)
    for k, text in enumerate(texts):
        want = tokens(libraries, text)
        assert [x.ids[x.at[k] : x.at[k + 1]].tolist() for x in (a, b)] == [[i for i, _ in w] for w in want]


def test_query_on_all_documents(spark, sf, libraries):
    rows = table(spark, sf, "documents").collect()
    got = results(QUERIES["op13_token_alignment"](spark, sf))
    assert sorted(got) == sorted((r.doc_id, *x) for r, x in zip(rows, expected(libraries, [r.text for r in rows])))


def test_counts_go_over_all_blocks(spark, monkeypatch, libraries):
    """A block per document; and few pairs of irregular groups at a time."""
    monkeypatch.setattr(align, "PAIRS_AT_ONCE", 3)
    texts = ["the old 執執 river", "ééé the 🙂🙂 old", None, "", "a▁b", "the the the", "12 ==== ééé", "🙂執"] * 3
    want = sorted((i, *x) for i, x in enumerate(expected(libraries, texts)))
    for size in (1, 40):
        monkeypatch.setattr(align, "BLOCK_BYTES", size)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
        assert sorted(results(align.align(df, BYTE_MODEL, PIECE_MODEL))) == want


def test_memory_of_a_block(libraries):
    """Tokens are laid out for a part of a block, not for all of its text."""
    rng = random.Random(4)
    words = ["the", "river", "antidisestablishment", "größere", "x1", "執", "old", "12,5"]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(700)]
    size = sum(len(t.encode()) for t in texts)
    assert align.BLOCK_BYTES * 0.9 < size < align.BLOCK_BYTES
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    made = align.aligner(BYTE_MODEL, PIECE_MODEL)
    tracemalloc.start()
    try:
        blocks = list(made.blocks(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(blocks) == 1 and most < 40 * size


@pytest.mark.parametrize("size", [1, 30])
def test_blocks_in_parts(monkeypatch, libraries, size):
    texts = ["the old 執執 river", "ééé the 🙂🙂 old", None, "", "a▁b", "the the the", "12 ==== ééé", "🙂執", "river the"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    made = align.aligner(BYTE_MODEL, PIECE_MODEL)
    (whole,) = made.blocks(iter([batch]))
    monkeypatch.setattr(align, "PART_BYTES", size)
    (parts,) = made.blocks(iter([batch]))
    assert parts.drop_columns(["block"]).equals(whole.drop_columns(["block"]))


def test_blocks_are_written_one_by_one(spark, monkeypatch, libraries):
    """Each in a row group of its own; texts come to a worker by bytes, not by rows."""
    monkeypatch.setattr(scratch, "BATCH_BYTES", 1)
    texts = ["the old river", "ééé the old", None, "", "the the the", "12 ==== ééé"] * 2
    want = sorted((i, *x) for i, x in enumerate(expected(libraries, texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    blocks = align.aligned_blocks(df, BYTE_MODEL, PIECE_MODEL)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    assert sum(f.num_rows for f in files) == len(texts) and all(f.num_row_groups == f.num_rows for f in files)
    assert sorted(results(align.align(df, BYTE_MODEL, PIECE_MODEL))) == want


def test_links_in_pieces(monkeypatch, libraries):
    texts = ["執執🙂 ééé", "🙂🙂🙂"]
    made = align.aligner(BYTE_MODEL, PIECE_MODEL)
    a, b = made.tokens(texts)
    whole = align.links(a, b, align.Groups(a, b))
    monkeypatch.setattr(align, "PAIRS_AT_ONCE", 1)
    for x, y in zip(whole, align.links(a, b, align.Groups(a, b))):
        assert x.tolist() == y.tolist()


def test_hard_rows(spark, libraries):
    df = messy(spark)
    rows = df.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, expected(libraries, [r.text for r in rows]))]
    got = results(align.align(df, BYTE_MODEL, PIECE_MODEL))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert align.align(df.limit(0), BYTE_MODEL, PIECE_MODEL).collect() == []


def test_very_long_text(libraries):
    text = " " * 300_000 + "x" * 50_000 + "=" * 50_000 + "\n" * 20_000
    a, b = align.aligner(BYTE_MODEL, PIECE_MODEL).tokens([text])
    want = tokens(libraries, text)
    assert [x.ids.tolist() for x in (a, b)] == [[i for i, _ in w] for w in want]
