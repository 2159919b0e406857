"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on a text. Their accuracies and
the share of good texts are estimated by expectation maximisation over the patterns of
votes (a table of at most 3 ** labellers rows, however many texts there are), without any
true label. The posterior of a pattern then labels its texts, and a linear scorer over
hashed features learns from these labels on a bounded sample: at most 512 texts
of each pattern and ``SAMPLE`` in all, those of smallest hash. The scorer judges every text, also those on which
no labeller votes.

Defined results: a null or empty text is voted on like others (too short) and scored; rows
that repeat are counted and scored one by one, and weigh as the rows they are; an empty
table gives an empty result; a text of any length is read whole; further columns are not
looked at. Reruns agree.
"""

from __future__ import annotations

import operator
import re
import string
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.base import query, table
from topicloom.llm.rules import SYMBOLS, Text
from topicloom.session import materialize

GOOD, NONE, BAD = 1, 0, -1
SLOTS = 4096  # hashed features
SLICES, PER_SLICE = 256, 2  # texts of each pattern of votes the scorer learns from, at most: 512
SAMPLE = 8000  # and of all patterns together, the first of each pattern first
EPOCHS, RATE, DECAY = 25, 0.5, 1e-4
KEEP = 0.5  # least score that keeps a text
ROWS = 128
SPAN = 400  # words of a window of by_variety


#: bytes of letters that ``str.isupper`` and ``str.islower`` know in ASCII
UPPER, LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
MOST_WORDS, LONGEST = 200_000, 40  # words a worker remembers, and the longest of a text that it looks up


def cases(text: Text) -> tuple[int, int]:
    """How many characters are upper case and how many lower case, worked out once a text."""
    found = text._known.get("cases")
    if found is None:
        raw = text.text
        data = raw.encode("utf-8", "surrogatepass")
        rest = "" if len(data) == len(raw) else "".join(BEYOND_ASCII.findall(raw))
        upper, lower = (len(data) - len(data.translate(None, letters)) for letters in (UPPER, LOWER))
        found = text._known["cases"] = upper + sum(map(str.isupper, rest)), lower + sum(map(str.islower, rest))
    return found


def _share(text: Text, measure: str) -> float:
    return text[measure] / max(1, text["n_words"])


def _words_seen_often(text: Text) -> float:
    """Share of words equal to the word before, worked out once a text."""
    found = text._known.get("seen_often")
    if found is None:
        words = text.words
        found = text._known["seen_often"] = sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    return found


PLAIN = re.compile(r"[\"'(]?[^\W\d_]+(?:['-][^\W\d_]+)*[.,;:!?]?[\"')]?")


def _is_plain(word: str) -> bool:
    return PLAIN.fullmatch(word) is not None


_known_plain = lru_cache(maxsize=MOST_WORDS)(_is_plain)


def by_length(text: Text) -> int:
    return BAD if text["n_words"] < 3 else NONE


def by_symbols(text: Text) -> int:
    return BAD if _share(text, "n_symbols") > 0.3 else NONE


def by_plain_words(text: Text) -> int:
    """Words of letters with at most one mark behind them."""
    words = text.text.split()
    plain = _known_plain if max(map(len, words), default=0) <= LONGEST else _is_plain
    share = sum(map(plain, words)) / max(1, len(words))
    return BAD if share < 0.55 else GOOD if share > 0.8 else NONE


def by_windows(text: Text) -> int:
    return BAD if _share(text, "n_repeat_words") > 0.4 else NONE


def by_neighbours(text: Text) -> int:
    return BAD if _words_seen_often(text) > 0.2 else NONE


def by_variety(text: Text) -> int:
    """Distinct words against what a text of that length has: the mean share over windows of ``SPAN``
    words that cover the whole text, evenly spaced so that the last is whole too."""
    words, n = text.words, len(text.words)
    if n < 20:
        return NONE
    parts, span = -(-n // SPAN), min(n, SPAN)
    starts = [(n - span) * k // max(1, parts - 1) for k in range(parts)]
    share = sum(len(set(words[a : a + span])) for a in starts) / (span * parts)
    return BAD if share < 0.25 else GOOD if share > 0.4 else NONE


def by_lines(text: Text) -> int:
    return BAD if 2 * text["n_dup_lines"] > text["n_lines"] else NONE


def by_sentences(text: Text) -> int:
    ends = text.text.count(". ") + text.text.count(".\n") + text.text.rstrip().endswith(".")
    n = text["n_words"]
    return NONE if n < 20 else GOOD if 100 * ends >= n else BAD if not ends else NONE


def by_case(text: Text) -> int:
    upper, lower = cases(text)
    if upper + lower < 20:
        return NONE
    return BAD if upper > lower else NONE


LABELLERS = (by_case, by_length, by_symbols, by_plain_words, by_windows, by_neighbours, by_variety, by_lines, by_sentences)


@lru_cache(maxsize=200_000)
def _slot(word: bytes) -> int:
    return zlib.crc32(word) % (SLOTS - 64) + 64


def shapes(text: Text) -> list[int]:
    """Which of the first 64 slots a text has: steps of its measures."""
    n = text["n_words"]
    out = [0]

    def step(first: int, value: float, edges: tuple[float, ...]) -> None:
        out.append(first + sum(value > e for e in edges))

    step(1, n, (5, 20, 100, 500, 2500))
    step(8, _share(text, "n_symbols"), (0.01, 0.05, 0.3, 1))
    step(14, _share(text, "n_repeat_words"), (0.02, 0.1, 0.3, 0.6))
    step(20, _words_seen_often(text), (0.01, 0.05, 0.2, 0.5))
    step(26, len(set(text.words)) / max(1, n), (0.1, 0.25, 0.4, 0.6, 0.8))
    step(33, text["n_dup_lines"] / max(1, text["n_lines"]), (0.05, 0.3, 0.5, 0.8))
    step(39, text["word_chars"] / max(1, n), (2, 4, 6, 9, 15))
    step(46, sum(map(text.text.count, ".!?")) / max(1, n), (0.005, 0.03, 0.1, 0.3))
    step(52, sum(map(text.text.count, SYMBOLS[:3])) / max(1, n), (0.01, 0.1))
    step(56, cases(text)[0] / max(1, text["word_chars"]), (0.05, 0.2, 0.5))
    return out


def word_features(text: Text) -> dict[int, float]:
    """The words' slots and their counts, as a vector of length one."""
    held = Counter(map(_slot, text.words))
    length = float(np.sqrt(sum(c * c for c in held.values())))
    return {s: c / length for s, c in held.items()}


def features(text: Text) -> dict[int, float]:
    """Hashed features: shapes of the text in the first 64 slots, words in the others."""
    return dict.fromkeys(shapes(text), 1.0) | word_features(text)


def votes(docs: DataFrame, id_col: str, text_col: str, labellers=LABELLERS) -> DataFrame:
    """(id, h, pattern, shape): a digit per labeller: 0 bad, 1 nothing, 2 good; and the text's shapes."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                patterns, shape = [], []
                for raw in part.column(2).to_pylist():
                    text = Text(raw)
                    patterns.append("".join("012"[f(text) + 1] for f in labellers))
                    shape.append(bytes(shapes(text)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(patterns, pa.string()), pa.array(shape, pa.binary())], names=["id", "h", "pattern", "shape"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h bigint, pattern string, shape binary")


def estimate(counts: dict[str, int], rounds: int = 300) -> tuple[np.ndarray, float, dict[str, float]]:
    """Accuracies, share of good texts and the posterior of each pattern, by EM.

    For good and for bad texts each labeller has its own chances of voting good, bad or
    nothing, so a labeller that calls nearly everything good says little by it; voting
    nothing says nothing. It starts from the guess that a text with any bad vote is likely bad. The accuracy of a labeller
    is the expected share of its votes that are right.
    """
    patterns = sorted(counts)
    if not patterns:
        return np.zeros(0), 0.5, {}
    digits = np.array([[int(c) for c in p] for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    cast = (digits[:, :, None] == np.arange(3)).astype(float)
    spoken = cast * [1.0, 0.0, 1.0]
    posterior = np.where((digits == 0).any(axis=1), 0.15, 0.95)
    for _ in range(rounds):
        chances = []
        for share in (posterior, 1 - posterior):
            held = np.einsum("p,plv->lv", weight * share, cast) + 0.5
            chances.append(np.log(held / held.sum(axis=1, keepdims=True)))
        good = (posterior @ weight + 1) / (weight.sum() + 2)
        odds = np.einsum("plv,lv->p", spoken, chances[0] - chances[1]) + np.log(good / (1 - good))
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(posterior - before).max() < 1e-9:
            break
    right = np.einsum("p,pl->l", weight * posterior, cast[:, :, 2]) + np.einsum("p,pl->l", weight * (1 - posterior), cast[:, :, 0])
    voted = np.einsum("p,pl->l", weight, 1 - cast[:, :, 1])
    return (right + 1) / (voted + 2), float(good), dict(zip(patterns, posterior.tolist()))


def learn(samples: list[tuple[dict[int, float], float, float]]) -> np.ndarray:
    """Weights of the linear scorer from (features, label between 0 and 1, weight), by AdaGrad."""
    weights, seen = np.zeros(SLOTS), np.full(SLOTS, 1e-6)
    rows = [(np.array(list(x)), np.array(list(x.values())), y, w) for x, y, w in samples]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, value, y, w = rows[k]
            score = 1 / (1 + np.exp(-np.clip(weights[at] @ value, -30, 30)))
            slope = w * (score - y) * value + DECAY * weights[at]
            seen[at] += slope * slope
            weights[at] -= RATE * slope / np.sqrt(seen[at])
    return weights


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def words(self, text: Text) -> float:
        """What the words add to the score's logit."""
        held = word_features(text)
        return float(self.weights[list(held)] @ np.array(list(held.values()))) if held else 0.0

    def judged(self, words: float, shape: list[int] | bytes) -> float:
        total = words + float(self.weights[list(shape)].sum())
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, total)))))

    def __call__(self, text: Text) -> float:
        return self.judged(self.words(text), shapes(text))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labellers=LABELLERS):
    """(scorer, {pattern: posterior}, accuracies, (id, h, pattern, shape) of all documents, stored)."""
    cast = materialize(votes(docs, id_col, text_col, labellers), "votes")
    counts = {r["pattern"]: r["count"] for r in cast.groupBy("pattern").count().collect()}  # 3 ** labellers rows at most
    accuracy, _, posterior = estimate(counts)
    # the smallest hashes in each of some slices of a pattern, so that no pattern meets in one task
    order = Window.partitionBy("pattern", "slice").orderBy("h", "id")
    few = cast.select("id", "h", "pattern").distinct().withColumn("slice", F.pmod(F.col("h"), F.lit(SLICES))).withColumn("k", F.row_number().over(order))
    few = few.where(F.col("k") <= PER_SLICE)
    few = few.orderBy("k", "h").limit(SAMPLE).select("h", "pattern").distinct()
    picked = F.broadcast(materialize(few, "picked"))  # SAMPLE rows at most
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = docs.select(h.alias("h"), F.col(text_col).alias("text")).join(picked, "h").dropDuplicates(["h"])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                held = [features(Text(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([list(x) for x in held], pa.list_(pa.int32())),
                     pa.array([list(x.values()) for x in held], pa.list_(pa.float64()))], names=["h", "pattern", "slots", "values"],
                )

    rows = texts.select("h", "text", "pattern").mapInArrow(run, "h bigint, pattern string, slots array<int>, values array<double>").collect()
    rows.sort(key=lambda r: r["h"])
    total = {p: sum(r["pattern"] == p for r in rows) for p in {r["pattern"] for r in rows}}
    # a pattern weighs by the root of its rows, so that rare ones are heard
    weight = {p: np.sqrt(counts[p]) / total[p] for p in total}
    top = max(weight.values(), default=1.0)
    weights = learn([(dict(zip(r["slots"], r["values"])), posterior[r["pattern"]], weight[r["pattern"]] / top) for r in rows])
    return Scorer(weights), posterior, accuracy, cast


def classify(docs: DataFrame, scorer: Scorer, posterior: dict[str, float], id_col: str = "doc_id", text_col: str = "text", labellers=LABELLERS) -> DataFrame:
    """(id, pattern, weak_label, score, kept), a row per document; map-only.

    weak_label is the posterior of the votes; score is the scorer's.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                patterns, scores = [], []
                for raw in part.column(1).to_pylist():
                    text = Text(raw)
                    patterns.append("".join("012"[f(text) + 1] for f in labellers))
                    scores.append(scorer(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(patterns, pa.string()), pa.array([posterior.get(p) for p in patterns], pa.float64()),
                     pa.array(scores, pa.float64()), pa.array([s >= KEEP for s in scores], pa.bool_())],
                    names=["id", "pattern", "weak_label", "score", "kept"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, pattern string, weak_label double, score double, kept boolean"
    )


def judge(docs: DataFrame, scorer: Scorer, posterior: dict[str, float], cast: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``classify`` for the documents that ``fit`` has read: their votes and shapes are in ``cast``, so a
    text is read once more for its words only, and meets the rest of it in narrow rows."""

    def read(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                words = [scorer.words(Text(t)) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.float64())], names=["id", "h", "words"])

    def run(batches):
        for batch in batches:
            words, patterns, shape = (batch.column(c).to_pylist() for c in ("words", "pattern", "shape"))
            scores = [scorer.judged(w, x) for w, x in zip(words, shape)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("pattern"), pa.array([posterior.get(p) for p in patterns], pa.float64()),
                 pa.array(scores, pa.float64()), pa.array([s >= KEEP for s in scores], pa.bool_())],
                names=["id", "pattern", "weak_label", "score", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(read, f"id {kind}, h bigint, words double")
    known = cast.select("h", "pattern", "shape").dropDuplicates(["h"])  # equal h: equal id and text
    return rows.join(known, "h").select("id", "words", "pattern", "shape").mapInArrow(
        run, f"id {kind}, pattern string, weak_label double, score double, kept boolean"
    )


@query("op9_quality_classifier")
def quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    scorer, posterior, _, cast = fit(docs)
    return judge(docs, scorer, posterior, cast).withColumnRenamed("id", "doc_id")
