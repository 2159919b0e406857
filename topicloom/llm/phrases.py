"""Collocations by best-first branch-and-bound growth of phrases.

A phrase of 2 to ``LONGEST`` words found ``least`` times or more is a candidate; its score is the
lowest floor(1000 a n / (l r)) over its cuts. As no part of a phrase is rarer than the phrase, no
phrase that starts with p scores above floor(1000 n / f(p)): prefix counts bound what growth can bring.
The frontier are the phrases found but not yet grown. A round grows, language by language, all
of the frontier up to a count (down to a bound), word by word until nothing of it is left within
that count; then the ``top``-th surviving score tells whether the bound of what is left lies below
it. If not, the next round's count is the one that this score asks for, or 64 times the last where
a language has fewer survivors yet. Ties at the bound are grown too, so the answer is exact.

A round counts over the encoded corpus, in which a word is a 64-bit hash of language and word and 0
is a border of pieces. Python tasks turn it into counts with numpy; what they emit goes through filters
of fixed size that leave out only what surely is too rare or not asked for (a counting sketch of
``SKETCH`` counters a length, bitmaps of ``BITS`` bits of the prefixes to grow), then exact counts decide. With
more phrases than bits the filters let more through and the result stays right.

A survivor needs the counts of its later parts, which may never have been grown, and its neighbours:
one more pass counts both. A candidate lies inside an equally frequent longer one just if all its
occurrences have the same word before them, or all the same word behind (any longer one
holds one that is longer by a word and at least as frequent).

Defined results: null texts are empty, null languages ``und``; rows that repeat count as often; texts are
read whole; products are decimals of 38 digits; an empty table gives an empty result; further columns are not
looked at. Equal words are told by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.base import query, table
from topicloom.llm.rules import _strings
from topicloom.session import discard, materialize

LONGEST = 5
LEAST = 100
TOP = 2_000
FIRST_CAP = 32  # times ``least``: the counts that the first round grows
WIDER = 64
BITS = 1 << 23  # 1 MB a bitmap
PAGE = 1 << 15
SKETCH = 1 << 22
SKETCH_PAGE = 1 << 16
OUT_WORDS, CHUNK = 64_000, 200_000  # words that are encoded, and that are counted, at once

HELD_WORDS = 120_000  # distinct words of a share

_BORDERS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BORDERS, b"." * len(_BORDERS))


def tokens(text: str | None) -> list[bytes]:
    """Words, and b"." for every border of pieces."""
    if not text:
        return []
    # of the white space that split() knows, blanks and tabs are left
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).replace(b".", b" . ").split()


class _Places(dict):
    """Words of a language to places 1, 2, ... in the order met; the border of pieces is 0."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [b"."]

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.words)
        self.words.append(word)
        return place


class _Dictionary:
    """The words of a language in a share: their hashes and counts."""

    def __init__(self, lang: str):
        self.prefix = lang.encode("utf-8", "surrogatepass") + b"\0"
        self.place = _Places()
        self.hash, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode(self, words: list[bytes]) -> np.ndarray:
        """The words' hashes; counts them."""
        known = len(self.place)
        places = np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))
        if len(self.place) > known:
            new = self.place.words[known:]
            fresh = np.fromiter((xxhash.xxh3_64_intdigest(self.prefix + w) - (1 << 63) or 1 for w in new), np.int64, len(new))
            if len(self.place) > len(self.hash):
                self.hash, self.count = (np.concatenate([x, np.zeros(len(self.place) + len(x), np.int64)]) for x in (self.hash, self.count))
            self.hash[known : len(self.place)] = fresh
        met, n = np.unique(places, return_counts=True)
        self.count[met] += n
        return self.hash[places]

    def entries(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        words = self.place.words
        part = slice(1, len(words))
        return [w.decode("utf-8", "surrogatepass") for w in words[part]], self.hash[part], self.count[part]


# --- the encoded corpus --------------------------------------------------------

ENCODED = "ws array<bigint>, lang string, word string, key bigint, n bigint"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of hashes per text, closed by a border, and a row per word of every share.

    Rows are no longer than their text: readers hold thousands of rows at once.
    """
    names = [f.split()[0] for f in ENCODED.split(", ")]
    known: dict[str, _Dictionary] = {}
    parts: list[np.ndarray] = []

    def texts():
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        ws = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
        none = [pa.nulls(len(parts), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([ws, *none], names=names)

    def dictionary():
        for lang, held in known.items():
            words, keys, counts = held.entries()
            for i in range(0, len(words), 10_000):
                part = slice(i, i + 10_000)
                word = pa.array(words[part], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(word), pa.list_(pa.int64())), pa.array([lang] * len(word), pa.string()), word, pa.array(keys[part]), pa.array(counts[part])], names=names
                )

    held = 0
    for rows in batches:
        for lang, text in zip(rows.column(0).to_pylist(), _strings(rows.column(1))):
            lang = "und" if lang is None else lang
            if lang not in known:
                known[lang] = _Dictionary(lang)
            parts.append(np.append(known[lang].encode(tokens(text)), 0))
            held += len(parts[-1])
            if held >= OUT_WORDS:
                yield texts()
                parts, held = [], 0
            if sum(len(words.place) for words in known.values()) > HELD_WORDS:
                yield from dictionary()
                known = {}
    if parts:
        yield texts()
    yield from dictionary()


def encoded(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The corpus as hashes, with the words of every share and their counts; stored."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(_encode, ENCODED), "encoded")


# --- hashes of phrases and filters of fixed size --------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying loses nothing


def _next(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes' phrases longer by one word."""
    x = (prefix ^ (prefix >> np.uint64(31))) * _MIX + word
    return x ^ (x >> np.uint64(29))


def grams(ws: np.ndarray, longest: int = LONGEST) -> list[tuple[np.ndarray, np.ndarray]]:
    """For m = 1, 2, ...: (hash of the m words from each place, whether they are all in one piece)."""
    word, inside = ws.view(np.uint64), ws != 0
    out = [(word, inside)]
    for m in range(2, longest + 1):
        if len(ws) < m:
            break
        g, ok = out[-1]
        out.append((_next(g[:-1], word[m - 1 :]), ok[:-1] & inside[m - 1 :]))
    return out


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The encoded words of a task in shares of CHUNK or a little more, cut between rows."""
    for batch in batches:
        column = batch.column(0)
        ends = np.asarray(column.offsets)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(ends, ends[first] + CHUNK))
            last = min(max(last, first + 1), len(column))
            yield column.slice(first, last - first).flatten().to_numpy(zero_copy_only=False)
            first = last


def _spot(g: np.ndarray, size: int) -> np.ndarray:
    return ((g ^ (g >> np.uint64(32))) & np.uint64(size - 1)).astype(np.int64)


def has(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    at = _spot(g, len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS // 8, np.uint8)
    for batch in batches:
        for phrase in batch.column(0):
            ws = phrase.values.to_numpy(zero_copy_only=False)
            at = int(_spot(grams(ws, len(ws))[-1][0], BITS)[0])
            bits[at >> 3] |= 1 << (at & 7)
    pages = bits.reshape(-1, PAGE // 8)
    held = np.flatnonzero(pages.any(axis=1))
    for i in range(0, len(held), 256):
        part = held[i : i + 256]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([pages[p].tobytes() for p in part])], names=["page", "bits"])


def bitmap(phrases: DataFrame) -> np.ndarray:
    """The phrases (``ws``) as a bitmap of BITS bits, whatever their number."""
    out = np.zeros(BITS // 8, np.uint8)
    pages = phrases.select("ws").mapInArrow(_pages, "page int, bits binary").groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))
    for row in pages.collect():  # BITS bits at most
        out[row["page"] * (PAGE // 8) :][: PAGE // 8] = np.frombuffer(bytes(row["bits"])[: PAGE // 8], np.uint8)
    return out


def sketches(corpus: DataFrame, least: int) -> dict[int, np.ndarray]:
    """{m: bitmap of SKETCH bits}: a phrase of m words whose bit is not set is found fewer than ``least`` times."""

    kind = next(k for k in ("<u1", "<u2", "<u4", "<i8") if least <= np.iinfo(k).max)  # counters stop at ``least``

    def count(batches):
        total = {m: np.zeros(SKETCH, kind) for m in range(2, LONGEST + 1)}
        for ws in _shares(batches):
            for m, (g, ok) in enumerate(grams(ws), 1):
                if m > 1:
                    at, n = np.unique(_spot(g[ok], SKETCH), return_counts=True)
                    total[m][at] = np.minimum(total[m][at] + n, least).astype(kind)
        for m, counts in total.items():
            pages = counts.reshape(-1, SKETCH_PAGE)
            for p in np.flatnonzero(pages.any(axis=1)):
                yield pa.RecordBatch.from_pydict({"m": pa.array([m], pa.int32()), "page": pa.array([p], pa.int32()), "counts": [zlib.compress(pages[p].tobytes(), 1)]})

    def add(batches):
        at, total = None, None

        def row():
            return pa.RecordBatch.from_pydict({"m": pa.array([at[0]], pa.int32()), "page": pa.array([at[1]], pa.int32()), "bits": [np.packbits(total >= least, bitorder="little").tobytes()]})

        for batch in batches:
            for m, page, counts in zip(*(batch.column(i) for i in range(3))):
                here = (m.as_py(), page.as_py())
                if here != at:
                    if at:
                        yield row()
                    at, total = here, np.zeros(SKETCH_PAGE, np.int64)
                total = np.minimum(total + np.frombuffer(zlib.decompress(counts.as_py()), kind), least)
        if at:
            yield row()

    found = corpus.mapInArrow(count, "m int, page int, counts binary").repartition("m", "page").sortWithinPartitions("m", "page")
    out = {m: np.zeros(SKETCH // 8, np.uint8) for m in range(2, LONGEST + 1)}
    for r in found.mapInArrow(add, "m int, page int, bits binary").collect():  # SKETCH bits a length
        out[r["m"]][r["page"] * (SKETCH_PAGE // 8) :][: SKETCH_PAGE // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


# --- passes over the corpus ------------------------------------------------------


def _phrase_lists(ws: np.ndarray, at: np.ndarray, m: int) -> pa.Array:
    flat = ws[at[:, None] + np.arange(m)].ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, m), pa.int32()), pa.array(flat, pa.int64()))


def grown(corpus: DataFrame, m: int, prefixes: np.ndarray, last: np.ndarray, sketch: np.ndarray, least: int) -> DataFrame:
    """(ws, f): phrases of m words, ``least`` times or more, that the ``prefixes`` let through."""

    def run(batches):
        for ws in _shares(batches):
            found = grams(ws, m)
            if len(found) < m:
                continue
            (before, _), (g, ok) = found[-2], found[-1]
            at = np.flatnonzero(ok)
            at = at[has(sketch, g[at])]
            at = at[has(prefixes, before[at])]
            at = at[has(last, found[0][0][at + m - 1])]
            if len(at):
                _, first, n = np.unique(g[at], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_phrase_lists(ws, at[first], m), pa.array(n, pa.int64())], names=["ws", "n"])

    return corpus.mapInArrow(run, "ws array<bigint>, n bigint").groupBy("ws").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


AROUND = [f"{side}_{what}" for side in ("before", "behind") for what in ("least", "most", "n")]


def with_neighbours(corpus: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """(ws, f, AROUND): phrases that the bitmaps let through, by length, with the least and the greatest
    hash of the word before and behind them and in how many places there is one."""

    def run(batches):
        for ws in _shares(batches):
            n = len(ws)
            padded = np.concatenate([[0], ws, [0]])
            for m, (g, ok) in enumerate(grams(ws), 1):
                if m not in wanted:
                    continue
                at = np.flatnonzero(ok)
                at = at[has(wanted[m], g[at])]
                if not len(at):
                    continue
                at = at[np.argsort(g[at], kind="stable")]
                start = np.flatnonzero(np.concatenate([[True], g[at][1:] != g[at][:-1]]))
                columns = [_phrase_lists(ws, at[start], m), pa.array(np.diff(np.append(start, len(at))), pa.int64())]
                for near in (padded[at], padded[np.minimum(at + m, n) + 1]):
                    there = near != 0
                    columns += [
                        pa.array(np.minimum.reduceat(np.where(there, near, np.iinfo(np.int64).max), start), pa.int64()),
                        pa.array(np.maximum.reduceat(np.where(there, near, np.iinfo(np.int64).min), start), pa.int64()),
                        pa.array(np.add.reduceat(there.astype(np.int64), start), pa.int64()),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names=["ws", "n", *AROUND])

    rows = corpus.mapInArrow(run, "ws array<bigint>, n bigint, " + ", ".join(f"{c} bigint" for c in AROUND))
    how = {"least": F.min, "most": F.max, "n": F.sum}
    return rows.groupBy("ws").agg(F.sum("n").alias("f"), *[how[c.split("_")[1]](c).alias(c) for c in AROUND])


# --- growth ----------------------------------------------------------------------


def _score(a: Column, n: Column, low: Column, high: Column) -> Column:
    """floor(1000 a n / (low high)) without overflow."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, low, high)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1], wide[2] * wide[3])


def _scored(corpus: DataFrame, new: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, ws, a, l, r, n, score, survives) of the new candidates; ``known`` are all phrases found, words included."""
    size = F.size("ws")
    parts = new.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    parts = parts.select("lang", "ws", F.col("f").alias("a"), "k", F.slice("ws", F.lit(1), F.col("k")).alias("left"), F.expr("slice(ws, k + 1, size(ws) - k)").alias("right"))
    parts = materialize(parts, "cuts")
    asked = parts.select(F.col("right").alias("ws")).where(size > 1).unionByName(new.select("ws"))
    wanted = {m: bitmap(asked.where(size == m)) for m in range(2, LONGEST + 1)}
    around = with_neighbours(corpus, {m: bits for m, bits in wanted.items() if bits.any()})
    around = materialize(around, "around")
    # single words are known; of longer parts the pass has just counted all
    counts = known.where(size == 1).select("ws", "f").unionByName(around.select("ws", "f"))
    cuts = parts.join(known.select(F.col("ws").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("ws").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.join(totals, "lang").withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "ws", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = [(F.col(f"{s}_n") == F.col("a")) & (F.col(f"{s}_least") == F.col(f"{s}_most")) for s in ("before", "behind")]
    out = best.join(around.drop("f"), "ws").select(
        "lang", "ws", "a", "cut.l", "cut.r", "n", "cut.score", ((size == LONGEST) | ~(inside[0] | inside[1])).alias("survives")
    )
    out = materialize(out, "scored")
    discard(parts)
    discard(around)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", first_cap: int = FIRST_CAP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` surviving candidates."""
    source = encoded(docs, lang_col, text_col)
    words = source.where("word IS NOT NULL").groupBy("lang", "word").agg(F.min("key").alias("w"), F.sum("n").alias("f"))
    words = materialize(words, "words")
    corpus = source.where("ws IS NOT NULL").select("ws")
    totals = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = words.where(F.col("f") >= least)
    spelled = materialize(frequent.select("lang", "word", "w", "f"), "spelled")
    found = {m: [] for m in range(1, LONGEST + 1)}  # frames of (lang, ws, f, round) by length
    found[1].append(spelled.select("lang", F.array("w").alias("ws"), "f", F.lit(0).alias("round")))
    last, sketch = bitmap(found[1][0]), sketches(corpus, least)
    first_words = spelled.select("lang", "w")
    opened = materialize(totals.select("lang", "n", F.lit(0).cast("bigint").alias("low"), F.lit(least * first_cap).cast("bigint").alias("cap")), "open")
    scored: list[DataFrame] = []
    turn = 0
    while True:
        turn += 1
        new = []
        for m in range(2, LONGEST + 1):
            if not found[m - 1]:
                continue
            grow = _union(found[m - 1]).join(opened, "lang").where(
                (F.col("f") <= F.col("cap")) & ((F.col("f") > F.col("low")) | (F.col("round") == turn))
            )
            prefixes = bitmap(grow)
            if not prefixes.any():
                continue
            # the bitmap may let others through: only children of what is grown now are kept
            children = grown(corpus, m, prefixes, last, sketch[m], least)
            children = children.join(grow.select(F.col("ws").alias("prefix")), F.expr(f"slice(ws, 1, {m - 1}) = prefix"), "left_semi")
            children = children.join(first_words, F.expr("ws[0] = w")).select("lang", "ws", "f", F.lit(turn).alias("round"))
            children = materialize(children, f"phrases{m}")
            found[m].append(children)
            new.append(children)
        known = _union([part for m in range(1, LONGEST) for part in found[m]])
        if new:
            scored.append(_scored(corpus, _union(new).drop("round"), known, totals))
        # what is left to grow, and whether it may still reach the top
        rest = known.join(opened, "lang").where(F.col("f") > F.col("cap")).groupBy("lang", "n", "cap").agg(F.min("f").alias("f"))
        if scored:
            order = Window.partitionBy("lang").orderBy(F.desc("score"))
            settled = _union(scored).where("survives").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
            settled = settled.where(F.col("place") == top).select("lang", F.col("score").alias("settled"))
            rest = rest.join(settled, "lang", "left")
        else:
            rest = rest.withColumn("settled", F.lit(None).cast("bigint"))
        n, one = F.col("n"), F.lit(1)
        bound = _score(one, n, F.col("f"), one)
        # every count with a bound at the settled score or above: n 1000 / f >= settled
        asked = F.when(F.col("settled") > 0, _score(one, n, F.greatest(F.col("settled"), one), one))
        left = rest.where(F.col("settled").isNull() | (bound >= F.col("settled"))).select(
            "lang", "n", F.col("cap").alias("low"), F.greatest("f", F.coalesce(asked, F.greatest("cap", "f") * WIDER)).alias("cap")
        )
        left = materialize(left, "open")
        discard(opened)
        opened = left
        if opened.isEmpty():
            break
    empty = docs.sparkSession.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    if not scored:
        return empty
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = _union(scored).where("survives").withColumn("place", F.rank().over(ranked)).where(F.col("place") <= top).drop("place", "survives")
    best = materialize(best, "best")
    spell = best.select("ws", F.posexplode("ws").alias("pos", "w")).join(spelled.select("w", "word"), "w").groupBy("ws").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("phrase")  # LONGEST words
    )
    named = best.join(spell, "ws")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = named.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*)::HUGEINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
  FROM c, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
s AS (
  SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT DISTINCT c.lang, array_to_string(ws[i:j], ' ') AS phrase, c.f
  FROM c, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j) WHERE i < j AND j <= m AND j - i + 1 < m),
gone AS (SELECT DISTINCT best.lang, best.phrase FROM best JOIN inner_ USING (lang, phrase) WHERE 100 * inner_.f >= 100 * best.a),
kept AS (SELECT * FROM best ANTI JOIN gone USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000"""


@query("op13_phrase_collocations", ORACLE)
def phrase_collocations(spark, sf):
    return collocations(table(spark, sf, "documents"))
