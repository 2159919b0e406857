"""Quality rules as a short-circuit cascade.

A rule looks at a few measures of a text and rejects it or not. ``plan_cascade``
estimates each rule's cost and selectivity on a bounded sample and orders the rules
by rejection per cost; a text then meets the rules in that order and stops at the
first that rejects it. The verdict is the same in any order, so the sample decides
only how fast the cascade is.

Defined results: a null or empty text has no words and fails ``few_words``; rows that
repeat are judged one by one; an empty table gives an empty result and the rules in
their given order; further columns pass through ``keep_documents`` untouched, whatever
their names. A text of any length is read whole; memory is that of one batch of rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.base import query, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SAMPLE_ROWS = 400  # bound of the sample that orders the rules


class Text:
    """The measures of one text, each worked out when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._words: list[bytes] | None = None
        self._known: dict[str, int] = {}

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.text.encode("utf-8", "surrogatepass").split()
        return self._words

    def __getitem__(self, measure: str) -> int:
        value = self._known.get(measure)
        if value is None:
            value = self._known[measure] = getattr(self, f"_{measure}")()
        return value

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        text = self.text
        return len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]

    def _n_lines(self) -> int:
        return len(self._lines())

    def _n_dup_lines(self) -> int:
        lines = self._lines()
        return len(lines) - len(set(lines))

    def _n_repeat_words(self) -> int:
        return repeated_window_words(self.words)


def repeated_window_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words found twice or more.

    Exact: words become numbers, then windows of 2, 4, 8 words do, each numbered by
    its pair of halves. Stops once no window of some length is found twice.
    """
    n = len(words)
    if n <= window:
        return 0
    number = dict(zip(dict.fromkeys(words), range(n)))
    if len(number) == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    size = 1
    while size < window:
        keys = ids[:-size] * n + ids[size:]
        _, ids, counts = np.unique(keys, return_inverse=True, return_counts=True)
        if len(counts) == len(keys):
            return 0
        size *= 2
    starts = counts[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(starts)] += starts
    edge[window : window + len(starts)] -= starts
    return int(np.count_nonzero(np.cumsum(edge[:n])))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


def few_words(text: Text) -> bool:
    return text["n_words"] < 20


def repeats_itself(text: Text) -> bool:
    return 100 * text["n_repeat_words"] > 30 * text["n_words"]


def many_symbols(text: Text) -> bool:
    return 10 * text["n_symbols"] > 3 * text["n_words"]


def odd_word_length(text: Text) -> bool:
    n, chars = text["n_words"], text["word_chars"]
    return n > 0 and (chars < 2 * n or chars > 20 * n)


def duplicate_lines(text: Text) -> bool:
    return 2 * text["n_dup_lines"] > text["n_lines"]


RULES = (
    Rule("few_words", few_words, base=True),
    Rule("repeats_itself", repeats_itself, base=True),
    Rule("many_symbols", many_symbols),
    Rule("odd_word_length", odd_word_length),
    Rule("duplicate_lines", duplicate_lines),
)


def _strings(column) -> Iterator[str | None]:
    """Texts of an Arrow column one after another, not all as Python objects at once."""
    for start in range(0, len(column), 64):
        yield from column.slice(start, 64).to_pylist()


def _costs(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, rows = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for raw in _strings(batch.column(0)):
                rows += 1
                for k, rule in enumerate(rules):
                    fresh = Text(raw)  # each rule pays for its own measures
                    start = time.perf_counter()
                    hits[k] += rule.rejects(fresh)
                    spent[k] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict(
            {"rule": pa.array(range(len(rules)), pa.int32()), "seconds": spent,
             "hits": pa.array(hits, pa.int64()), "n": pa.array([rows] * len(rules), pa.int64())}
        )

    return run


def plan_cascade(docs: DataFrame, rules=RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejection per second, estimated on at most ``rows`` documents."""
    sample = docs.select(F.col(text_col).alias("text")).sample(fraction=0.25, seed=11).limit(rows)
    seen = (
        sample.mapInArrow(_costs(rules), "rule int, seconds double, hits bigint, n bigint")
        .groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
        .collect()  # one row a rule
    )
    # a rule that met nothing in the sample still counts as if it might reject half a row
    worth = {r["rule"]: (r["hits"] + 0.5) / (r["seconds"] + 1e-6) for r in seen if r["n"]}
    order = sorted(range(len(rules)), key=lambda k: (-worth.get(k, 0.0), k))
    return [rules[k] for k in order]


def _first_rejection(text: Text, cascade) -> Rule | None:
    return next((rule for rule in cascade if rule.rejects(text)), None)


def judge_documents(
    docs: DataFrame, cascade=None, id_col: str = "doc_id", text_col: str = "text", measures=DIGEST
) -> DataFrame:
    """id, ``measures`` (long), base_failed, kept, rejected_by (the first rule in cascade order).

    With ``measures=()`` nothing is worked out but what the cascade asks for, and
    base_failed is left out.
    """
    cascade = cascade or plan_cascade(docs, text_col=text_col)
    base = [rule for rule in cascade if rule.base]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            out = {m: [] for m in measures}
            failed, by = [], []
            for raw in _strings(batch.column(1)):
                text = Text(raw)
                rule = _first_rejection(text, cascade)
                by.append(rule.name if rule else None)
                for m in measures:
                    out[m].append(text[m])
                if measures:
                    failed.append(bool(rule and rule.base) or any(r.rejects(text) for r in base))
            arrays = [batch.column(0), *(pa.array(out[m], pa.int64()) for m in measures)]
            arrays += [pa.array(failed, pa.bool_())] if measures else []
            arrays += [pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [id_col, *measures, *(["base_failed"] if measures else []), "kept", "rejected_by"]
    kind = docs.schema[id_col].dataType.simpleString()
    types = [kind, *["bigint"] * len(measures), *(["boolean"] if measures else []), "boolean", "string"]
    return source.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))


def keep_documents(docs: DataFrame, cascade=None, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns; one pass, no shuffle."""
    cascade = cascade or plan_cascade(docs, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            mask = [_first_rejection(Text(raw), cascade) is None for raw in _strings(batch.column(at))]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
l AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words
            OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))
            OR 2 * n_dup_lines > n_lines) AS kept
FROM m"""


@query("op4_quality_rules", ORACLE)
def quality_rules(spark, sf):
    return judge_documents(table(spark, sf, "documents")).drop("rejected_by")
