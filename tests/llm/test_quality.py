import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from topicloom.llm import quality as q


def test_em_recovers_labellers():
    """Votes drawn from known accuracies: EM, which sees no label, finds them again."""
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.8
    accuracy, speaks = [0.95, 0.9, 0.8, 0.7], [0.9, 0.6, 0.8, 0.7]
    patterns = []
    for good in truth:
        p = ""
        for a, s in zip(accuracy, speaks):
            vote = good if r.random() < a else not good
            p += ("2" if vote else "0") if r.random() < s else "1"
        patterns.append(p)
    counts: dict[str, int] = {}
    for p in patterns:
        counts[p] = counts.get(p, 0) + 1
    found, good, posterior = q.estimate(counts)
    assert np.abs(found - accuracy).max() < 0.05 and abs(good - 0.8) < 0.04
    judged = np.array([posterior[p] >= 0.5 for p in patterns])
    assert (judged == truth).mean() > 0.93


def corpus(seed=2):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefghij"), int(r.integers(2, 8)))) for _ in range(300)]
    rows, truth = [], {}
    for i in range(400):
        w = r.choice(words, int(r.integers(8, 90))).tolist()
        good = i % 5 != 0
        if good:
            text = " ".join(x + "." if k % 9 == 8 else x for k, x in enumerate(w)) + "."
        else:
            text = [" ".join(f"{x}###" for x in w), f"{w[0]} " * 60, " | ".join(w), " ".join(x.upper() + "!!" for x in w)][i // 5 % 4]
        rows.append((i, text))
        truth[i] = good
    return rows, truth


def test_classifier_finds_junk(spark):
    rows, truth = corpus()
    odd = [(1000, None), (1001, ""), (1002, "x " * 60_000), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, 1.0, "s") for i, t in rows + odd], "doc_id bigint, text string, score double, pattern string")
    scorer, posterior, accuracy, cast = q.fit(docs)
    assert cast.count() == len(rows) + len(odd) and len(accuracy) == len(q.LABELLERS)
    out = q.classify(docs, scorer, posterior).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    kept = {r.id: r.kept for r in out}
    assert sum(kept[i] == truth[i] for i in truth) / len(truth) > 0.97
    assert sum(kept[i] for i in truth if truth[i]) / sum(truth.values()) > 0.98
    assert not kept[1000] and not kept[1001] and not kept[1002]
    # fresh texts that the scorer has not seen
    fresh, truth = corpus(seed=9)
    right = [(scorer(q.Text(t)) >= q.KEEP) == truth[i] for i, t in fresh]
    assert sum(right) / len(right) > 0.95
    again = q.fit(docs.repartition(5))[0]
    assert np.allclose(again.weights, scorer.weights)


def plain_em(counts, rounds=300):
    """Expectation maximisation vote by vote."""
    posterior = {p: 0.15 if "0" in p else 0.95 for p in counts}
    n = len(next(iter(counts)))
    for _ in range(rounds):
        good = (sum(posterior[p] * c for p, c in counts.items()) + 1) / (sum(counts.values()) + 2)
        chance = {}
        for is_good in (True, False):
            for k in range(n):
                held = [0.5 + sum(c * (posterior[p] if is_good else 1 - posterior[p]) for p, c in counts.items() if p[k] == v) for v in "012"]
                chance[is_good, k] = [h / sum(held) for h in held]
        before = posterior
        posterior = {}
        for p in counts:
            odds = math.log(good / (1 - good))
            odds += sum(math.log(chance[True, k][int(v)] / chance[False, k][int(v)]) for k, v in enumerate(p) if v != "1")
            posterior[p] = 1 / (1 + math.exp(-max(-40, min(40, odds))))
        if max(abs(posterior[p] - before[p]) for p in counts) < 1e-9:
            break
    return posterior


def plain_scorer(samples):
    """AdaGrad on dictionaries, sample by sample, in the order of the same generator."""
    weights, seen = {}, {}
    order = np.random.default_rng(7)
    for _ in range(q.EPOCHS):
        for k in order.permutation(len(samples)):
            x, y, w = samples[k]
            z = sum(weights.get(s, 0.0) * v for s, v in x.items())
            slope = w * (1 / (1 + math.exp(-max(-30, min(30, z)))) - y)
            for s, v in x.items():
                g = slope * v + q.DECAY * weights.get(s, 0.0)
                seen[s] = seen.get(s, 1e-6) + g * g
                weights[s] = weights.get(s, 0.0) - q.RATE * g / math.sqrt(seen[s])
    return weights


def test_equal_to_a_plain_version(spark):
    """Votes, posteriors, weights and scores of the query's path, worked out plainly."""
    rows = corpus()[0][:150] + [(500, None), (501, ""), (None, "a lone text without an id"), (3, corpus()[0][3][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pattern = {t: "".join("012"[f(q.Text(t)) + 1] for f in q.LABELLERS) for _, t in rows}
    counts = Counter(pattern[t] for _, t in rows)
    posterior = plain_em(counts)
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").distinct().collect()
    texts, slices = [], Counter()
    for h, t in sorted((r["h"], r["text"]) for r in hashed):  # the sample: the first of each slice of a pattern
        slices[pattern[t], h % q.SLICES] += 1
        texts += [(h, t)] if slices[pattern[t], h % q.SLICES] <= q.PER_SLICE else []
    total = Counter(pattern[t] for _, t in texts)
    weight = {p: math.sqrt(counts[p]) / total[p] for p in total}
    top = max(weight.values())
    weights = plain_scorer([(q.features(q.Text(t)), posterior[pattern[t]], weight[pattern[t]] / top) for _, t in texts])
    scorer, found, _, cast = q.fit(docs)
    assert set(found) == set(posterior) and all(abs(found[p] - posterior[p]) < 1e-6 for p in found)
    assert all(abs(scorer.weights[s] - w) < 1e-5 for s, w in weights.items())
    want = sorted(
        (-1 if i is None else i, pattern[t], round(1 / (1 + math.exp(-sum(weights[s] * v for s, v in q.features(q.Text(t)).items()))), 3)) for i, t in rows
    )
    for out in (q.judge(docs, scorer, found, cast), q.classify(docs, scorer, found)):
        assert sorted((-1 if r["id"] is None else r["id"], r["pattern"], round(r["score"], 3)) for r in out.collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    scorer, posterior, _, cast = q.fit(docs)
    assert q.classify(docs, scorer, posterior).count() == 0
    assert q.judge(docs, scorer, posterior, cast).count() == 0


def test_variety_looks_at_the_whole_text():
    varied, poor = [f"w{i}" for i in range(400)], ["x", "y"] * 2000
    assert q.by_variety(q.Text(" ".join(varied + poor))) == q.BAD
    assert q.by_variety(q.Text(" ".join(poor[:400] + [f"v{i % 900}" for i in range(4000)]))) == q.GOOD
    assert q.by_variety(q.Text(" ".join(varied + ["x"] * 19))) == q.GOOD  # no short window at the end
    assert q.by_variety(q.Text(" ".join(varied[:19]))) == q.NONE and q.by_variety(q.Text("a b " * 100)) == q.BAD


def test_measures_are_worked_out_once(monkeypatch):
    """Equal to looking at every character and word, but a word is matched once however often it comes."""
    texts = ["", "abc DEF", "Straße ÄÖÜ αβΓ ǅ ª Ⅷ ⓐ ǅx", "aİi " * 9, "ok, " * 500, "x" * 90 + " Word. a1 don't"]
    for raw in texts:
        text = q.Text(raw)
        assert q.cases(text) == (sum(map(str.isupper, raw)), sum(map(str.islower, raw)))
        share = sum(q.PLAIN.fullmatch(w) is not None for w in raw.split()) / max(1, len(raw.split()))
        assert q.by_plain_words(q.Text(raw)) == (q.BAD if share < 0.55 else q.GOOD if share > 0.8 else q.NONE)
        held = Counter()
        for word, n in Counter(text.words).items():
            held[q._slot(word)] += n
        length = math.sqrt(sum(c * c for c in held.values()))
        assert q.word_features(text) == {s: c / length for s, c in held.items()}

    class Counted:
        calls = 0

        def fullmatch(self, word):
            self.calls += 1
            return None

    counted = Counted()
    monkeypatch.setattr(q, "PLAIN", counted)
    assert q.by_plain_words(q.Text("seldom-heard-word " * 1000)) == q.BAD
    q._known_plain.cache_clear()
    assert counted.calls == 1
