"""Plain Python forms of the training-data operators, and tables that are hard on them."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = "word " * 20_000 + "x" * 60_000  # a very long text that ends in a very long word

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "src0", 10),
    (2, None, "en", "src1", None),
    (3, "", None, "src0", 0),
    (4, " \n\t ", "fr", None, 4),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "src0", 10),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "src0", 10),
    (6, LONG, "en", "src2", 1),
    (7, "Ein Satz über größere Häuser.\nUnd noch einer dazu.\nUnd noch einer dazu.", "de", "src1", 1),
    (None, "no id here, but there are some words in it all the same, ten or more", None, None, None),
    (8, "<s> </turn> ### *** $$$ | | <0x0A> \\ ▁ 執 🙂 \x00 é́", "de", "src9", 1),
    (9, "one", "en", "src0", 1),
    (10, "one", "en", "src0", 1),
]

#: names that the operators use inside or put out
CLASHES = ("id", "n", "set", "sig", "kept", "score", "shard", "slot", "size", "copies", "n_tokens", "component_id",
           "label", "ids", "decoded", "__row", "__id", "target", "digest", "held_out", "lang_pred", "block", "cell")


def messy(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(DOCS, schema).repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def shingle_set(text, k):
    w = words(lower(text))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


class Roots:
    def __init__(self, nodes):
        self.parent = {v: v for v in nodes}

    def __call__(self, v):
        while self.parent[v] != v:
            self.parent[v] = v = self.parent[self.parent[v]]
        return v

    def join(self, a, b):
        a, b = self(a), self(b)
        self.parent[max(a, b)] = min(a, b)


def jaccard_components(rows, k, percent):
    """{id: (set size, component)} of (id, text) rows with different ids."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    root, holders = Roots(sets), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root.join(i, j)
    return {i: (len(s), root(i)) for i, s in sets.items()}
