"""Licence scans against a plain search of every phrase at every word."""

import random
import re

import pytest

from topicloom.llm import licenses
from topicloom.llm.licenses import BASE, NOTICES, Index, Notice, scan_licenses, words_of
from topicloom.llm.registered import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute_base(text):
    words = plain_words(text)
    places = []
    for t in BASE:
        phrase = t.text.split()
        places += [(i, t.label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    return len(words), sorted(places)


def brute_notice(notice, words):
    """The definition, start by start, without an index."""
    starts = set()
    for start in range(-len(notice.words) - notice.slack, len(words) + 1):
        hits = [{d for d in range(notice.slack + 1) if 0 <= start + d + q < len(words) and words[start + d + q] == w} for w, q in notice.anchors]
        if sum(map(bool, hits)) >= notice.need and any(0 in h for h in hits):
            starts.add(start)
    out = []
    for start in sorted(starts):
        good = all(
            any(words[p : p + len(k)] == k for p in range(max(0, start + q - notice.slack), start + q + 2 * notice.slack + 1)) for k, q in notice.keys
        )
        if good:
            out.append(start)
    return out


def some_texts(n, seed):
    rng = random.Random(seed)
    notices = [t.text for t in (*BASE, *NOTICES)]
    filler = ["stone", "licensed", "Under", "the", "GNU", "version", "2", "3", "license", "MIT", "cc", "by", "nc", "été", "apache", "x.y", "\n"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                words = rng.choice(notices).split()
                for _ in range(rng.choice([0, 0, 1, 2, 4])):
                    at = rng.randrange(len(words))
                    words[at : at + 1] = rng.choice([[], ["extra"], ["one", "two"]])
                    words = words or ["x"]
                parts.append(" ".join(words))
            else:
                parts.append(" ".join(rng.choice(filler) for _ in range(rng.randint(1, 30))))
        out.append(rng.choice(["\n", " ", "; "]).join(parts))
    return out


def test_places_equal_a_search_at_every_word():
    idf = {w: 1 + (hash_like(w) % 97) / 10 for t in (*BASE, *NOTICES) for w in words_of(t.text)}
    index = Index(BASE, NOTICES, idf)
    for text in some_texts(250, 5):
        words = words_of(text)
        want = sorted((s, n.label, n.base) for n in index.notices for s in brute_notice(n, words))
        assert sorted((s, n.label, n.base) for n, s, _ in index.scan(words)) == want
        assert sorted((s, n.label) for n, s, _ in index.scan(words) if n.base) == brute_base(text)[1]


def hash_like(word):
    return sum((i + 1) * c for i, c in enumerate(word))


def test_rows_with_nulls_long_texts_and_clashing_columns(spark):
    long = "filler words " * 60_000 + "Released under the MIT License." + " more" * 60_000
    texts = [None, "", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.",
             "This work is licensed under the GNU General Public License, version 3.", "under the mit\nlicense under THE mit license", long,
             "gnu general license public 3 version", "BY cc nc by"]
    rows = [(i, t, "a", 1, "b") for i, t in enumerate(texts)] + [(2, texts[2], "a", 1, "b"), (None, texts[2], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int, places string")
    got = scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: r for r in got}
    for i, text in enumerate(texts):
        n, places = brute_base(text)
        assert by_id[i]["n_words"] == n
        assert sorted((p["first_word"], p["label"]) for p in by_id[i]["places"] if p["base"]) == places
    assert [p["label"] for p in by_id[4]["places"]] == ["gpl-3"]
    assert by_id[None]["n_words"] == 5
    assert scan_licenses(docs.limit(0)).collect() == []


def test_query_on_a_small_table(spark, tmp_path):
    texts = some_texts(120, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op11_license_scans"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        n, places = brute_base(text)
        r = got[i]
        at = [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None))
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base))
        assert base <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_key_phrases_must_be_in_their_template():
    with pytest.raises(ValueError):
        Notice(licenses.Template("x", "some words", ("other words",)), False, {b"some": 1.0, b"words": 1.0})
