"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import pytest

from topicloom.llm.phrases import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall(r"[^ \t]+", piece)
            total[lang] += len(ws)
            for m in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside.get(p[i:j], 0), a)
        kept = []
        for p, a in found.items():
            if 100 * inside.get(p, 0) >= 100 * a:
                continue
            score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def some_rows(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ωmega", "#x", "The", "a\x1cb"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = ["alpha beta Gamma delta", "one two three four five six", "w1 new york", "w0 w0 w0 w0"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            words += [rng.choice(fixed)] if rng.random() < 0.1 else rng.choices(vocabulary, weights)
            if rng.random() < 0.1:
                words.append(rng.choice([".", ",", "\n", ";;", "\t"]))
        rows.append((rng.choice(["en", "en", "en", "fr", None]), " ".join(words)))
    return rows


@pytest.mark.parametrize(("least", "top", "first"), [(4, 40, 1), (4, 10_000, 2), (20, 30, 32)])
def test_equal_to_counting_every_phrase(spark, least, top, first):
    rows = some_rows(400, least + top) + [("en", None), ("fr", ""), (None, "...")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, w int, ws string")
    got = [tuple(r) for r in collocations(docs, least=least, top=top, first_cap=first).select(*COLUMNS).collect()]
    assert sorted(got) == brute(rows, least, top)


def test_long_text_and_hot_phrase(spark):
    rows = [("en", "so it goes " * 30_000), ("en", "and so it goes.")] + [("de", "x y")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(r) for r in collocations(docs, least=5, top=50).select(*COLUMNS).collect()]
    assert sorted(got) == brute(rows, 5, 50)


def test_empty_table_and_no_candidates(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations(docs).collect() == []
    assert collocations(spark.createDataFrame([("en", "one two")], "lang string, text string")).collect() == []
