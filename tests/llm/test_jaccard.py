import random
import re

import numpy as np
import pytest

from topicloom.llm import jaccard
from topicloom.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = WORDS.findall(low)
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                label[root(i)] = root(j)
    out = []
    for k, (i, _) in enumerate(rows):
        out.append((i, len(sets[k]), min(rows[m][0] for m in range(len(rows)) if root(m) == root(k))))
    return sorted(out)


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 4)))
    rows = []
    for base in range(12):
        words = [word() for _ in range(r.choice([1, 2, 4, 9, 12, 30, 80, 200]))]
        for _ in range(r.choice([1, 3, 20])):
            other = list(words)
            for _ in range(r.randrange(0, 1 + len(other) // 25)):
                other[r.randrange(len(other))] = word()
            rows.append(" ".join(other))
    rows += [None, "", " \n", "One", "one", "ONE two", "one two", "É", "é"] + [rows[5], rows[5].upper(), "w " * 4000]
    return list(zip(r.sample(range(1000), len(rows)), rows))


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_like_brute_force(spark, words, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard.jaccard_groups(docs, words, percent, tile=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, words, percent)


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_linked_sets_share_a_fingerprint(percent):
    """Also where the only equal part may be empty: small sets, random and worst differences."""
    r = np.random.default_rng(percent)
    linked = 0
    for _ in range(1500):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        cut = int(r.integers(0, 1 + len(a) * (100 - percent) // 100))
        add = int(r.integers(0, 1 + len(a) * (100 - percent) // 100))
        b = np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 63, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        linked += 1
        keys = []
        for s in (a, b):
            keys.append(set(jaccard.part_keys(np.zeros(len(s), np.int64), s, np.array([len(s)]), percent)[1].tolist()))
        assert keys[0] & keys[1], (len(a), len(b), both)
    assert linked > 300


def test_kept_documents_and_odd_tables(spark):
    rows = [(i, t, i) for i, t in corpus()] + [(None, "one two three four", 1), (None, None, 2)]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {(i) for i, n, c in brute([(i, t) for i, t, _ in rows if i is not None], 5, 80) if i == c}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2
    empty = spark.createDataFrame([], docs.schema)
    assert jaccard.jaccard_groups(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (99, 100), (7, None), (8, 8)], "a bigint, b bigint")
    got = {(r.node, r.component) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(61)} | {(99, 99), (100, 99)}
