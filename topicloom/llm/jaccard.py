"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, sorted-array intersection.

A document's set is its distinct word shingles, as 64-bit hashes. Two documents link when
100 * |intersection| >= percent * |union|; the result is the connected groups.

1. Documents with equal sets are one class; from here on a class is one row.
2. Sizes fall into bands so wide that linked sets lie in one band or in two neighbours.
   Linked sets of a band differ in at most d elements, a number the band fixes, so of
   d + 1 parts of the set (by element hash) one is equal in both. Each class emits a
   fingerprint per part; classes that share one are candidates. Two sets whose only equal
   part is empty differ by exactly one element in every other part, so the fingerprint of
   an empty part holds the parities of the other parts' sizes, up to turning all of them.
3. Candidates that hang together are cut into tiles: blocks of bounded size per band, met
   with the blocks of the same and the next band. In a tile, bits counted in hashed bitmap
   signatures bound the overlap from above; what passes is intersected exactly. Pairs that
   the tile has already connected are not looked at, and only joining links leave it.

No pair is lost: steps 2 and 3 only skip pairs that cannot link or are known to be
connected. Hot groups are spread over tiles, never collected; texts of candidates alone
are read a second time.

Defined results: null and empty texts have the empty set and link with nothing; texts with
fewer words than a shingle have one shingle of all their words; rows that repeat, and ties,
are linked; rows without an id link with nothing and have a null component; an empty table
gives an empty result; further columns are not looked at, or pass through
``keep_one_of_each`` untouched.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.base import query, table
from topicloom.llm.components import components
from topicloom.llm.filters import id_bitmap, with_maybe
from topicloom.session import materialize

TILE = 128  # classes in a block
BITS = 1024
SEEN = 200_000  # sets a task remembers to leave out copies
BATCH_BYTES = 1 << 18  # texts hashed at once


# --- shingles ----------------------------------------------------------------

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = pow(0x9E3779B97F4A7C15 | 5, 1, 1 << 64)
    inverse = pow(base, -1, 1 << 64)
    out = []
    for step in (base, inverse):
        p = np.full(n, step, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of ``text``: a polynomial of its bytes, then mixed."""
    raw = np.frombuffer(text, np.uint8)
    space = _SPACE[raw]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(inside & np.concatenate([space[1:], [True]])) + 1
    size = 1 << max(10, len(raw).bit_length())
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)])])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), sorted and distinct, of a batch of texts."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    docs, shingles = [], []
    at = 0
    while at < len(encoded):
        upto, size = at, 0
        while upto < len(encoded) and (upto == at or size + len(encoded[upto]) <= BATCH_BYTES):
            size += len(encoded[upto]) + 1
            upto += 1
        text = b"\n".join(encoded[at:upto]).translate(_LOWER)
        edges = np.concatenate([[0], np.cumsum([len(x) + 1 for x in encoded[at:upto]])])
        if text:
            start, h = word_hashes(text)
            doc = np.searchsorted(edges, start, side="right") - 1
            if len(h):
                first = np.searchsorted(doc, np.arange(upto - at))
                count = np.diff(np.append(first, len(doc)))
                if len(h) >= words:
                    roll = np.full(len(h) - words + 1, words, np.uint64)
                    for k in range(words):
                        roll = mix(roll * _ODD + h[k : len(h) - words + 1 + k])
                    same = doc[: len(roll)] == doc[words - 1 :]
                    docs.append(doc[: len(roll)][same] + at)
                    shingles.append(roll[same])
                for d in np.flatnonzero((count > 0) & (count < words)):
                    value = np.array([count[d]], np.uint64)
                    for k in range(first[d], first[d] + count[d]):
                        value = mix(value * _ODD + h[k : k + 1])
                    docs.append(np.array([d + at]))
                    shingles.append(value)
        at = upto
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, value = np.concatenate(docs), np.concatenate(shingles)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
    return doc[new], value[new]


def _sums(values: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, slots, values)
    return out


def signatures(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, signature) of each document's set."""
    size = np.bincount(doc, minlength=n_docs)
    return size, mix(_sums(mix(value + _ODD), doc, n_docs) ^ mix(size.astype(np.uint64)))


# --- bands and parts ---------------------------------------------------------


@lru_cache(maxsize=8)
def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each band, parts of each band), for sizes up to ``most``."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
    edges.append(edges[-1] * 100 // percent + 1)
    parts = []
    for nxt in edges[1:]:
        small = nxt - 1
        both = small + small * 100 // percent
        parts.append(both * (100 - percent) // (100 + percent) + 1)
    return np.array(edges), np.array(parts)


def part_keys(doc: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of every part, for a set's own band and the one below."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edges, parts = bands(percent, 1 << int(size.max()).bit_length())
    own = np.searchsorted(edges, size, side="right") - 1
    out_doc, out_key = [], []
    spread, weight = mix(value * np.uint64(0xD6E8FEB86659FD93)), mix(value ^ _ODD)
    for below in (0, 1):
        home = own - below
        used = (size > 0) & (home >= 0)
        k = np.where(used, parts[np.maximum(home, 0)], 0)
        base = np.concatenate([[0], np.cumsum(k)])
        live = used[doc]
        d = doc[live]
        slot = base[d] + (spread[live] % k[d].astype(np.uint64)).astype(np.int64)
        total = int(base[-1])
        prints = _sums(weight[live], slot, total)
        held = np.bincount(slot, minlength=total)
        owner = np.repeat(np.arange(len(size)), k)
        index = np.arange(total) - base[owner]
        # parities of the other parts, up to turning all: summed over the parts that are
        # not alike with the first other part
        odd = held & 1
        pattern = mix((index + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        ones = _sums(pattern * odd.astype(np.uint64), owner, len(size))
        every = _sums(pattern, owner, len(size))
        empty = np.flatnonzero(held == 0)
        lone = np.zeros(total, np.uint64)
        if len(empty):
            eo = owner[empty]
            rest = every[eo] - pattern[empty]
            first = base[eo] + (index[empty] == 0)
            has = k[eo] > 1
            turned = np.zeros(len(empty), bool)
            turned[has] = odd[np.minimum(first[has], total - 1)] == 1
            lone[empty] = np.where(turned, rest - ones[eo], ones[eo])
        body = np.where(held == 0, mix(lone + np.uint64(7)), prints + held.astype(np.uint64))
        key = mix(body + mix((home[owner] * 1_000_003 + index).astype(np.uint64) * _ODD))
        out_doc.append(owner)
        out_key.append(key)
    return np.concatenate(out_doc), np.concatenate(out_key)


# --- the join ----------------------------------------------------------------


def _slices(batches, rows: int = 256):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_sizes(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, sig): a row per document; sig is null for the empty set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in _slices(batches):
            doc, value = shingle_sets(part.column(1).to_pylist(), words)
            size, sig = signatures(doc, value, part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size.astype(np.int64)), pa.array(sig.view(np.int64), mask=size == 0)], names=["id", "n", "sig"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n bigint, sig bigint")


def candidate_keys(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(key, sig): the part fingerprints of every document with an id.

    A task that has just given those of a set does not give them again: copies, however
    many, leave a task about once.
    """

    def run(batches):
        seen: set[int] = set()
        for part in _slices(batches):
            doc, value = shingle_sets(part.column(0).to_pylist(), words)
            size, sig = signatures(doc, value, part.num_rows)
            fresh = np.zeros(part.num_rows, bool)
            for i, s in enumerate(sig.tolist()):
                if s not in seen:
                    seen.add(s)
                    fresh[i] = True
            if len(seen) > SEEN:
                seen.clear()
            live = fresh[doc]
            owner, key = part_keys(doc[live], value[live], np.where(fresh, size, 0), percent)
            yield pa.RecordBatch.from_arrays([_signed(key), _signed(sig[owner])], names=["key", "sig"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(run, "key bigint, sig bigint")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` with ``elements``, the sorted set, instead of ``text`` (the last column)."""
    names = rows.columns[:-1]

    def run(batches):
        for part in _slices(batches):
            doc, value = shingle_sets(part.column(part.num_columns - 1).to_pylist(), words)
            edge = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edge), _signed(value))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*names, "elements"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, elements array<bigint>")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS), np.uint8)
    for row, elements in zip(out, sets):
        row[elements & np.uint64(BITS - 1)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def tile_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets ``left`` with the sets ``right`` (places in ``sets``), as a forest."""
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bits = bitmaps(sets)
    size = np.array([len(s) for s in sets])
    out = []
    for i in left:
        others = right[right != i]
        total = size[i] + size[others]
        need = -(-percent * total // (100 + percent))  # least overlap that links
        shared = np.minimum(
            size[i] - np.bitwise_count(bits[i] & ~bits[others]).sum(axis=1, dtype=np.int64),
            size[others] - np.bitwise_count(bits[others] & ~bits[i]).sum(axis=1, dtype=np.int64),
        )
        for j, least in zip(others[shared >= need].tolist(), need[shared >= need].tolist()):
            a, b = root(i), root(j)
            if a != b and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= least:
                parent[a] = b
                out.append((int(i), j))
    return out


def _tiles(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """(group, tile, side, rep) of ``members`` (rep, n, group): each class in every tile it meets."""
    # the band by the same integer edges, as a bounded literal list (a few hundred)
    edges, _ = bands(percent, 1 << 40)
    rows = members.withColumn("band", F.aggregate(
        F.array(*(F.lit(int(e)) for e in edges)), F.lit(-1), lambda acc, e: acc + (F.col("n") >= e).cast("int")))
    counts = materialize(rows.groupBy("group", "band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks")), "blocks")
    above = counts.select("group", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = counts.select("group", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    rows = rows.join(counts.join(above, ["group", "band"], "left").join(below, ["group", "band"], "left"), ["group", "band"])
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")

    def meeting(band, i, step, j, side):
        return F.struct(band.alias("band"), i.cast("int").alias("i"), F.lit(step).alias("step"), j.cast("int").alias("j"), F.lit(side).alias("side"))

    band, none = F.col("band"), F.expr("cast(array() as array<int>)")
    every = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(none)
    meets = F.concat(
        F.transform(every("blocks"), lambda j: F.when(
            j >= F.col("block"), meeting(band, F.col("block"), 0, j, 0)).otherwise(meeting(band, j, 0, F.col("block"), 1))),
        F.transform(F.coalesce(every("above"), none), lambda j: meeting(band, F.col("block"), 1, j, 0)),
        F.transform(F.coalesce(every("below"), none), lambda j: meeting(band - 1, j, 1, F.col("block"), 1)),
    )
    return rows.withColumn("block", block).select("group", "rep", F.explode(meets).alias("m")).select(
        "group", F.struct("m.band", "m.i", "m.step", "m.j").alias("tile"), F.col("m.side").alias("side"), "rep"
    )


def jaccard_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n, component): every document, its set's size, the smallest id of its group."""
    sizes = materialize(set_sizes(docs, words, id_col, text_col), "sets")
    classes = materialize(
        sizes.where("sig IS NOT NULL AND id IS NOT NULL").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n")),
        "classes",
    )
    keys = candidate_keys(docs, words, percent, id_col, text_col)
    least = F.min("sig").over(Window.partitionBy("key"))
    stars = keys.withColumn("a", least).where("sig <> a").select("a", F.col("sig").alias("b")).distinct()
    groups = components(materialize(stars, "stars"))
    members = classes.join(groups, classes.sig == groups.node).select("rep", "n", F.col("component").alias("group"))
    members = materialize(members, "members")
    texts = with_maybe(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")), "rep", id_bitmap(members.select("rep")))
    texts = texts.where("__maybe").drop("__maybe").join(members.select("rep", F.col("n").alias("size")), "rep")
    # a repeated id may come with other texts: only the set that stands for the class
    wanted = materialize(
        _sets(texts.select("rep", "size", "text"), words).where(F.size("elements") == F.col("size")).select("rep", "elements"), "elements"
    )
    tiled = _tiles(members, percent, tile).join(wanted, "rep")
    kind = docs.schema[id_col].dataType.simpleString()

    def links(rows: pa.Table) -> pa.Table:
        rep, side = rows.column("rep").to_pylist(), rows.column("side").to_numpy()
        cut = rows.column("elements").combine_chunks()
        flat, edge = cut.values.to_numpy(zero_copy_only=False).view(np.uint64), cut.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(edge[:-1], edge[1:])]
        tile_of = rows.column("tile")[0].as_py()
        within = tile_of["step"] == 0 and tile_of["i"] == tile_of["j"]
        left = np.arange(len(sets)) if within else np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        found = tile_links(sets, left, right, percent)
        return pa.table({"a": pa.array([rep[i] for i, _ in found], rows.schema.field("rep").type),
                         "b": pa.array([rep[j] for _, j in found], rows.schema.field("rep").type)})

    linked = tiled.groupBy("group", "tile").applyInArrow(links, f"a {kind}, b {kind}")
    found = components(materialize(linked, "links"))
    named = classes.join(found, classes.rep == found.node, "left").select("sig", F.coalesce("component", "rep").alias("component"))
    return sizes.join(named, "sig", "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")
    )


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that with the smallest id (one of its rows, if they
    repeat), and all that link with nothing, with all their columns."""
    groups = jaccard_groups(docs, words, percent, id_col=id_col, text_col=text_col)
    gone = materialize(groups.where("id <> component").select(F.col("id").alias(id_col)).distinct(), "gone")
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    twice = materialize(
        groups.where("id = component AND n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("id").alias(id_col)),
        "twice",
    )
    if twice.isEmpty():
        return kept
    repeated = kept.join(twice, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return kept.join(twice, id_col, "left_anti").select(*docs.columns).unionByName(repeated)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 2], 'string_agg', ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 100 * c >= 90 * (m.n + k.n - c)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""


@query("op6_ngram_jaccard", ORACLE)
def ngram_jaccard(spark, sf):
    groups = jaccard_groups(table(spark, sf, "documents"), words=3, percent=90)
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
