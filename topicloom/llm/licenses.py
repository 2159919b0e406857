"""Licence scans by a positional index of rare tokens.

A template is a known notice: its words, the key phrases that it must not lack, and its
``ANCHORS`` words of highest IDF with their positions. The index leads from such a word to
(template, position). A file's licence words, rarest first, open templates: one that needs
``need`` of its R anchors is opened by one of the R - need + 1 rarest or not at all. For an open
template every posting of an anchor at file position p and template position q says where the
template would start, p - q; starts that ``need`` anchors agree on, within ``slack`` words, are
candidates, and those where every key phrase stands in its place, within the same slack, are
places of the label. Coverage is the share of the template's IDF found between the place's ends.

Exact templates are single phrases: all words are anchors, all are needed, the slack is 0;
their places are those where the words stand consecutively. Document frequencies are counted
over all documents, for the words of the templates only, so what reaches the driver is bounded
by the templates. Both passes are map-only over the texts.

Words: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII.

Defined results: null and empty texts have no words and no labels; rows that repeat are
scanned one by one; null ids stay null; an empty table gives an empty result; further columns are
not looked at. Texts are read whole, one at a time; equal IDFs are ordered by word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.base import query, table
from topicloom.llm.rules import _strings

ANCHORS = 8  # rare words of a template that are indexed

_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).lower().split() if text else []


@dataclass(frozen=True)
class Template:
    """``keys`` are phrases of ``text``; without keys the whole text is one, to be met exactly."""

    label: str
    text: str
    keys: tuple[str, ...] = ()


# The phrases that the contract names, then notices as licences publish them.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)

NOTICES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template(
        "gpl-3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version",
        ("gnu general public license", "free software foundation", "version 3 of the license"),
    ),
    Template(
        "gpl-2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version",
        ("gnu general public license", "free software foundation", "version 2 of the license"),
    ),
    Template("lgpl-3", "licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license", "version 3")),
    Template("agpl-3", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "version 3")),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
        ("source code form is subject to", "mozilla public license v 2 0"),
    ),
    Template(
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission",
        ("redistribution and use in source and binary forms", "to endorse or promote products derived from this software"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use",
        ("free and unencumbered software released into the public domain",),
    ),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    Template(
        "cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ("creative commons attribution sharealike 4 0 international license",),
    ),
    Template(
        "cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        ("creative commons attribution noncommercial 4 0 international license",),
    ),
)


def _find(words: list[bytes], phrase: list[bytes]) -> int:
    n = len(phrase)
    return next((i for i in range(len(words) - n + 1) if words[i : i + n] == phrase), -1)


class Notice:
    """A template with its anchors chosen: words of highest IDF, each at its first position."""

    def __init__(self, template: Template, base: bool, idf: dict[bytes, float]):
        self.label, self.base = template.label, base
        self.words = words_of(template.text)
        rare = sorted(dict.fromkeys(self.words), key=lambda w: (-idf[w], w))
        self.exact = not template.keys
        rare = rare if self.exact else rare[:ANCHORS]
        self.anchors = [(w, self.words.index(w)) for w in rare]
        self.need = len(rare) if self.exact else -(-len(rare) * 3 // 4)
        self.slack = 0 if self.exact else max(2, len(self.words) // 8)
        phrases = [self.words] if self.exact else [words_of(k) for k in template.keys]
        self.keys = [(k, _find(self.words, k)) for k in phrases]
        if any(at < 0 for _, at in self.keys):
            raise ValueError(f"a key phrase of {template.label} is not in its text")
        self.mass = Counter(self.words)
        self.weight = sum(idf[w] for w in self.words)
        self.idf = {w: idf[w] for w in self.mass}

    def openers(self) -> list[bytes]:
        """Of these rarest anchors every place holds at least one."""
        return [w for w, _ in self.anchors[: len(self.anchors) - self.need + 1]]

    def starts(self, at: dict[bytes, list[int]]) -> Iterator[int]:
        """Starts on which ``need`` anchors agree: the least of those within the slack."""
        if self.exact:
            first, rest = self.anchors[0], self.anchors[1:]
            held = {p - first[1] for p in at.get(first[0], ())}
            for word, q in rest:  # rarest first, so the sets stay small
                held &= {p - q for p in at.get(word, ())}
            yield from sorted(held)
            return
        found = sorted((p - q, k) for k, (word, q) in enumerate(self.anchors) for p in at.get(word, ()))
        inside: Counter = Counter()
        right, last = 0, None
        for left, (start, k) in enumerate(found):
            while right < len(found) and found[right][0] <= start + self.slack:
                inside[found[right][1]] += 1
                right += 1
            if len(inside) >= self.need and start != last:
                last = start
                yield start
            inside[k] -= 1
            if not inside[k]:
                del inside[k]

    def verified(self, words: list[bytes], start: int, at: dict[bytes, list[int]]) -> bool:
        """Every key phrase stands where the start puts it, within the slack."""
        for phrase, q in self.keys:
            low, high = start + q - self.slack, start + q + 2 * self.slack
            places = at[phrase[0]]
            near = places[bisect_left(places, low) : bisect_right(places, high)]
            if not any(words[p : p + len(phrase)] == phrase for p in near):
                return False
        return True

    def coverage(self, words: list[bytes], start: int) -> float:
        if self.exact:
            return 1.0
        held = Counter(words[max(0, start - self.slack) : max(0, start + len(self.words) + 2 * self.slack)])
        return min(1.0, sum(min(n, held[w]) * self.idf[w] for w, n in self.mass.items()) / self.weight)


class Index:
    """From rare words to the notices they open, and where anchors and key phrases start."""

    def __init__(self, base: Iterable[Template], notices: Iterable[Template], idf: dict[bytes, float]):
        self.notices = [Notice(t, True, idf) for t in base] + [Notice(t, False, idf) for t in notices]
        self.opens: dict[bytes, list[int]] = defaultdict(list)
        for i, notice in enumerate(self.notices):
            for word in notice.openers():
                self.opens[word].append(i)
        self.listed = {w for n in self.notices for w, _ in n.anchors} | {k[0] for n in self.notices for k, _ in n.keys}

    def scan(self, words: list[bytes]) -> list[tuple[Notice, int, float]]:
        """(notice, start, coverage) of all places, by start."""
        if self.opens.keys().isdisjoint(words):
            return []
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            if word in self.listed:
                at[word].append(i)
        opened = sorted({i for w in at if w in self.opens for i in self.opens[w]})
        out = []
        for i in opened:
            notice = self.notices[i]
            out += [(notice, s, notice.coverage(words, s)) for s in notice.starts(at) if notice.verified(words, s, at)]
        return sorted(out, key=lambda found: (found[1], found[0].label, -found[2]))


def inverse_frequencies(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> dict[bytes, float]:
    """IDF of the templates' words over all documents."""

    def run(batches):
        known, counts, rows = set(vocabulary), Counter(), 0
        for batch in batches:
            for text in _strings(batch.column(0)):
                rows += 1
                counts.update(known.intersection(words_of(text)))
        names = [None, *counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([rows, *counts.values()], pa.int64())], names=["word", "n"]
        )

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {r["word"] if r["word"] is None else bytes(r["word"]): r["n"] for r in counted.collect()}  # the templates' words at most
    rows = seen.get(None, 0)
    return {w: log((1 + rows) / (1 + seen.get(w, 0))) + 1 for w in vocabulary}


def scan_licenses(
    docs: DataFrame, base: Iterable[Template] = BASE, notices: Iterable[Template] = NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, places), a row per document; places are (label, base, first_word, n_words, coverage) by first word."""
    base, notices = tuple(base), tuple(notices)
    vocabulary = sorted({w for t in (*base, *notices) for w in words_of(t.text)})
    idf = inverse_frequencies(docs, vocabulary, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("coverage", pa.float64())])

    def run(batches):
        index = Index(base, notices, idf)
        for batch in batches:
            sizes, places = [], []
            for text in _strings(batch.column(1)):
                words = words_of(text)
                sizes.append(len(words))
                places.append([
                    {"label": n.label, "base": n.base, "first_word": s, "n_words": len(n.words), "coverage": c} for n, s, c in index.scan(words)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(place))], names=["id", "n_words", "places"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words bigint, places array<struct<label:string,base:boolean,first_word:bigint,n_words:bigint,coverage:double>>"
    )


@query("op11_license_scans")
def license_scans(spark, sf):
    found = scan_licenses(table(spark, sf, "documents"))
    based = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    first = F.transform(based, lambda p: p["first_word"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(based).cast("bigint").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        labels(based).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"),
    )
