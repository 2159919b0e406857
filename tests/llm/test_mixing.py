import re
from collections import Counter, defaultdict

import pytest

from topicloom.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, rest, out = set(order), float(sum(sizes.values())), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = cap * sizes[s]
            rest -= out[s]
        open_ -= above
    return out


def corpus():
    rows = []
    for i in range(900):
        source = ["a", "b", "c", "B", "ä", None, "tiny"][i % 6 if i < 890 else 6]
        source = "a" if i % 3 == 0 and source != "tiny" else source
        rows.append((i, " ".join(["w"] * (1 + i * 37 % 211)), source))
    return rows + [(1000, None, "a"), (1001, "", None), (1002, " \n ", "empty"), (7, rows[7][1], rows[7][2])] * 2 + [
        (2000, "long " * 30_000, "c")
    ]


@pytest.fixture(scope="module")
def planned(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, source string")
    return docs, mixing.mixing_plan(docs).collect()


def test_targets_and_totals(planned):
    rows = corpus()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    want = fill(sizes)
    got = planned[1]
    assert len(got) == len(rows)
    assert Counter((r.id, r.size, r.source) for r in got) == Counter(
        (i, len(WORDS.findall(t or "")), s) for i, t, s in rows
    )
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, (s, taken[s], want[s])


def test_reruns_agree_and_documents_follow_the_plan(spark, planned):
    docs, got = planned
    again = mixing.mixing_plan(docs.repartition(7)).collect()
    assert Counter(again) == Counter(got)
    extra = docs.withColumn("size", docs.doc_id).withColumn("ord", docs.source)
    mixed = mixing.mix_documents(extra)
    assert mixed.columns == extra.columns
    copies = Counter()
    for r in got:
        copies[r.id] += r.copies if r.size else 0
    assert Counter(r.doc_id for r in mixed.collect()) == +copies


def test_rounding_keeps_expectation(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 5), "a" if i < 40 else "b") for i in range(60)], "doc_id bigint, text string, source string"
    )
    hits, runs = Counter(), 4
    for seed in range(runs):
        rows = mixing.mixing_plan(docs, weights=(1, 2), seed=seed).collect()
        for r in rows:
            hits[r.source] += r.copies
    # ratio of a: one third of 180 words over its 120
    assert hits["a"] / (40 * runs) == pytest.approx(0.5, abs=0.1)


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mixing_plan(docs).count() == 0 and mixing.mix_documents(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id bigint, text string, source string")
    rows = mixing.mixing_plan(docs).collect()
    assert [(r.size, r.target, r.copies) for r in rows] == [(0, 0.0, 0)] * 2
    assert mixing.mix_documents(docs).count() == 0
