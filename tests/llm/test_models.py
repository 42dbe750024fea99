"""Learned scores: quality and language, by accuracy on what was held out."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brute import messy, words
from chartfold.llm import langid, linecrf, qda
from chartfold.llm.queries import QUERIES, table

BIG = "/root/testdata/sf0.1"


def test_quality_of_documents_held_out(spark):
    labels = {r.doc_id: r.quality for r in table(spark, BIG, "labels").collect()}
    got = QUERIES["op7_quality_classifier"](spark, BIG).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(judged) > 1000 and sum(a == b for a, b in judged) >= 0.99 * len(judged)


def test_labels_held_out_are_not_learned_from(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    hidden = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 3 = 1, 1 - quality, quality) AS quality")
    a, b = qda.train(docs, labels), qda.train(docs, hidden)
    assert np.allclose(a.means, b.means) and np.allclose(a.whiten, b.whiten) and np.allclose(a.offsets, b.offsets)


def test_discriminant_is_the_difference_of_densities():
    rng = np.random.default_rng(3)
    x = [rng.normal(size=(500, 3)), rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + 2]
    n = np.array([500.0, 300.0])
    model = qda.Discriminant.fit(n, np.array([p.sum(0) for p in x]), np.array([p.T @ p for p in x]), 0.2, 0.1)
    inner = [np.cov(p.T, bias=True) for p in x]
    pooled = (500 * inner[0] + 300 * inner[1]) / 800
    at, logs = rng.normal(size=(20, 3)), []
    for c in (0, 1):
        cov = 0.7 * inner[c] + 0.2 * pooled + 0.1 * np.diag(np.diag(pooled))
        d = at - x[c].mean(0)
        logs.append(np.log(n[c] / 800) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1))
    assert model.score(at) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_of_hard_rows(spark, sf):
    df = messy(spark)
    model = qda.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    got = qda.score_quality(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert all(r.held_out is False for r in got if r.doc_id is None)
    kept = qda.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.score >= 0.5 for r in got)
    assert qda.score_quality(df.limit(0), model).collect() == []
    one = spark.createDataFrame([(1, 1), (None, 0), (7, None)], "doc_id bigint, quality int")
    for labels, score in ((one, 1.0), (one.limit(0), 0.5)):
        assert {r.score for r in qda.score_quality(df, qda.train(df, labels)).collect()} == {score}


def test_language_of_documents_held_out(spark):
    langs = {r.doc_id: r.lang for r in table(spark, BIG, "documents").select("doc_id", "lang").collect()}
    got = QUERIES["op9_language_id"](spark, BIG).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    judged = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert len(judged) > 1500 and sum(judged) >= 0.995 * len(judged)


def test_viterbi_equals_brute_force():
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 2, 5, 7]) for _ in range(40)]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = np.array([[rng.gauss(0, 2) for _ in range(3)] for _ in range(first[-1])]).reshape(-1, 3)
    label = langid.viterbi(scores, first, 1.5)

    def value(s, labels):
        return sum(s[i, k] for i, k in enumerate(labels)) - 1.5 * sum(a != b for a, b in zip(labels, labels[1:]))

    for a, b in zip(first[:-1], first[1:]):
        s = scores[a:b]
        best = max(value(s, x) for x in itertools.product(range(3), repeat=b - a))
        assert value(s, label[a:b].tolist()) == pytest.approx(best)


@pytest.fixture(scope="module")
def model(spark, sf):
    return langid.train(table(spark, sf, "documents"))


def test_spans_of_mixed_text(spark, sf, model):
    by = {r.lang: r.text for r in table(spark, sf, "documents").filter("n_chars > 3000").orderBy("doc_id").collect()}
    text = {x: " ".join(by[x].split()[50:150]) for x in ("de", "es", "en")}
    df = spark.createDataFrame([(1, f"{text['de']} {text['es']} {text['en']}")], "doc_id bigint, text string")
    found = langid.spans(df, model).orderBy("first_word").collect()
    assert [r.lang for r in found if r.words > 20] == ["de", "es", "en"]
    assert sum(r.letters for r in found) == sum(c.isalpha() for t in text.values() for c in t)


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "привет мир как дела", "ru") for i in range(1, 20)] + [(i, "hello you are well", "en") for i in range(20, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df)
    assert model.languages == ("en", "ru")
    new = spark.createDataFrame([(1, "щука hello hello you"), (2, "незнакомец"), (3, "γειά")], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(new, model).collect()} | {3: "-"} == {1: "en", 2: "ru", 3: "-"}


def test_letters_of_every_plane_count(spark):
    """Han letters of the extensions B (plane 2), G and H (plane 3)."""
    rows = [(i, "\U00020000\U00020001 \U00020002", "zh") for i in range(1, 20)] + [(i, "hello you are well", "en") for i in range(20, 40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    new = spark.createDataFrame([(1, "\U00020000\U00020001"), (2, "\U00030000\U00030001"), (3, "\U00031350")], "doc_id bigint, text string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(new, model).collect()} == {i: ("zh", 1.0) for i in (1, 2, 3)}


def test_language_of_hard_rows(spark, model):
    df = messy(spark)
    got = langid.identify(df, model).collect()
    assert len(got) == df.count()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 7} == {"de"}
    assert langid.identify(df.limit(0), model).collect() == []
    nothing = langid.train(df.limit(0))
    assert nothing is None and {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    langid.train(df)  # learns from nulls and long words without trouble


def test_the_end_of_long_documents_is_learned_from(spark):
    """Boilerplate that stands only after the 64th line of long documents; rows that are repeated count once."""
    good = [(i, "\n".join(f"This is a sentence number {j} of text {i}, and it ends." for j in range(200)), 1) for i in range(40)]
    bad = [(i, "\n".join([f"This is a sentence number {j} of text {i}, and it ends." for j in range(70)]
                         + [f"### $$$ | BUY {j} NOW | $$$ ###" for j in range(130)]), 0) for i in range(40, 80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id bigint, quality int")
    crf = linecrf.train(docs, labels)
    tail = linecrf.Lines(linecrf.Texts(pa.array(["\n".join(["### $$$ | BUY 1 NOW | $$$ ###", "$$$ | BUY 2 NOW | $$$"])])))
    assert (crf.emissions(tail.features()) < -1).all()
    again = linecrf.train(docs.unionAll(docs).unionAll(docs), labels)
    assert np.array_equal(crf.weights, again.weights) and crf.bias == again.bias


TEXTS = [
    None, "", " \n\t", "One. Two, three!", "AB cd12 ### $| !!\n\nsame line here\nsame line here\nSAME line here\n",
    "größere Häuser, ünd wéiter.\nx\nx\nx", "averyveryverylongword another_very_long_word a a a a\n  lower start (end)",
    "日本 語 🙂 | | ok", "\n\n\n", "word " * 50 + "\x0b\x0c\r end\"",
]


def _share(part, whole, smooth=20.0):
    return math.sqrt(part / (whole + smooth))


def test_statistics_equal_brute_force():
    got = qda.statistics(linecrf.Texts(pa.array(TEXTS)))
    for row, text in zip(got, TEXTS):
        text = text or ""
        w, lines = words(text), [x for x in text.split("\n") if x]
        n, chars = len(w), sum(map(len, w))
        symbols = [c for c in text if c in linecrf.SYMBOLS.decode()]
        upper, lower = (sum(a <= c <= z for c in text) for a, z in (("A", "Z"), ("a", "z")))
        again = len(lines) - len(set(lines))
        assert row.tolist() == pytest.approx([
            math.log1p(n), math.log1p(chars / max(n, 1)), _share(len(symbols), chars), _share(text.count("!"), chars),
            _share(text.count("|"), chars), _share(upper, upper + lower), _share(sum(c in "0123456789" for c in text), chars),
            _share(text.count("."), n, 5), _share(text.count(","), n, 5), math.log1p(n / max(len(lines), 1)),
            math.log1p(len(set(w))) - math.log1p(n), _share(again, len(lines), 3),
            _share(sum(len(x) > 12 for x in w), n, 5),
            _share(sum(any(c in linecrf.SYMBOLS.decode() for c in x) for x in w), n, 5),
        ]), text


def test_line_features_equal_brute_force():
    found = linecrf.Lines(linecrf.Texts(pa.array(TEXTS)))
    want = []
    for text in TEXTS:
        seen = set()
        for line in (text or "").split("\n"):
            w = words(line)
            if not w:
                continue
            chars, bare = sum(map(len, w)), line.strip(" \t\n\x0b\x0c\r")
            upper, lower = (sum(a <= c <= z for c in line) / chars for a, z in (("A", "Z"), ("a", "z")))
            values = {
                "symbol_share": sum(c in linecrf.SYMBOLS.decode() for c in line) / chars,
                "exclaim_share": line.count("!") / chars, "upper_share": upper / max(upper + lower, 1e-9),
                "digit_share": sum(c in "0123456789" for c in line) / chars, "pipe_share": line.count("|") / chars,
                "words": len(w), "word_length": chars / len(w), "ends": bare[-1] in linecrf.ENDS.decode(),
                "starts_lower": "a" <= bare[0] <= "z", "repeated": line in seen,
            }
            seen.add(line)
            want.append([sum(c < values[name] for c in cuts) for name, cuts in linecrf.CUTS.items()])
    assert found.features().tolist() == want


def test_word_scores_equal_brute_force(model):
    texts = ["Häuser und the river", None, "", "a İx 12 été", "執 x" * 3]
    chars = langid.Chars(pa.array(texts))
    got = model.word_scores(chars)
    allowed = model.scripts[chars.script]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    letters = [w for t in texts for w in re.findall(r"[^\W\d_]+", t or "")]
    assert len(letters) == chars.n

    def slot(gram):
        h = len(gram)
        for c in gram:
            h = ((h ^ c) * 0x9E3779B97F4A7C15) % 2**64
            h ^= h >> 29
        return (h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - langid.BITS)

    for w, row, may in zip(letters, got, allowed):
        padded = [0, *[ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in w], 0]
        total = sum(
            model.logs[k - 1, slot(padded[i : i + k])].astype(float) for k in langid.GRAMS for i in range(len(padded) - k + 1)
        )
        assert row[may] == pytest.approx(total[may], abs=1e-3), w


def test_scripts_of_their_own(spark):
    """Common Han letters, Tamil, Lao and Ethiopic are four scripts, and kana is another."""
    known = {"zh": "中文 漢字", "ta": "தமிழ் மொழி", "lo": "ພາສາ ລາວ", "am": "አማርኛ ቋንቋ", "ja": "ひらがな カタカナ"}
    rows = [(20 * i + j, t, x) for i, (x, t) in enumerate(known.items()) for j in range(19)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    new = {"zh": "國 学", "ta": "உலகம்", "lo": "ໂລກ", "am": "ዓለም", "ja": "せかい"}
    df = spark.createDataFrame(list(enumerate(new.values())), "doc_id bigint, text string")
    assert [r.lang_pred for r in langid.identify(df, model).orderBy("doc_id").collect()] == list(new)
