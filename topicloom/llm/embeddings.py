"""Embedding near-dedup by product quantisation.

Index: a coarse quantiser cuts the unit sphere into inverted lists; what is left of a
vector after its list's centre is coded subspace by subspace. Quantisers are fitted on a
sample of at most ``SAMPLE`` vectors; every vector is in the index. Search: each vector
probes its ``PROBES`` nearest lists; table lookups of the query against the subspace codes
give its product with the coded vector, and the length of the coding error, kept with the
code, bounds what the true cosine can be. What may reach the threshold is compared exactly,
in double precision. Only whether a pair's lists are probed is approximate; the tests
measure a recall above 0.9 against brute force.

Equal vectors are one class first. A list is cut into blocks of data and of queries that
meet in tiles of bounded size, so hot lists are spread. A tile gives link counts per class
and a joining forest, never its pairs; a pair that both sides find counts once.

Defined results: vectors that are null, zero, empty or hold null or non-finite numbers link
with nothing; a shorter vector counts as filled up with zeros; rows that repeat link with
each other; rows of one id and unlike vectors are compared as they are; a null id is no component's
name unless the row is alone (then null); an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.base import query, table
from topicloom.llm.components import components
from topicloom.session import materialize

THRESHOLD = 0.9
LIST_ROWS = 200  # classes in a list, on average
LISTS = (16, 4096)  # fewest and most lists
PROBES = 12
SAMPLE = 20_000  # vectors the quantisers are fitted on, at most
SUBSPACES, CODES = 8, 256
DATA_BLOCK, QUERY_BLOCK = 512, 1024
SEED = 5


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate(
        [np.argmax(points[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(points), 4096)] or [np.zeros(0, np.int64)]
    )


def _means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    r = np.random.default_rng(SEED)
    k = min(k, len(points))
    centres = points[np.sort(r.permutation(len(points))[:k])].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        live = count > 0
        centres[live] = total[live] / count[live, None]
    return centres


class Quantiser:
    """Coarse centres, and codebooks for what is left of a vector after its centre."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _means(sample, lists)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_means(rest[:, c], CODES, 6) for c in self.cuts]

    def probes(self, units: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector, nearest first."""
        half = (self.centres * self.centres).sum(axis=1) / 2
        score = units @ self.centres.T - half
        n = min(n, score.shape[1])
        top = np.argpartition(-score, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable")
        return np.take_along_axis(top, order, axis=1)

    def encode(self, units: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the coding error)."""
        rest = units - self.centres[own]
        codes = np.zeros((len(units), len(self.cuts)), np.uint8)
        square = np.zeros(len(units))
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            codes[:, m] = _nearest(rest[:, cut], book)
            off = rest[:, cut] - book[codes[:, m]]
            square += (off * off).sum(axis=1)
        return codes, np.sqrt(square)

    def products(self, queries: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Queries times the coded vectors of one list, by lookup in each query's own tables."""
        out = np.repeat((queries @ self.centres[own])[:, None], len(codes), axis=1)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            out += (queries[:, cut] @ book.T)[:, codes[:, m]]
        return out


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    edge = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(edge)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(edge[:-1] - edge[0], sizes)] = flat[edge[0] : edge[-1]]
    return out


def tile_links(q: dict, d: dict, tool: Quantiser, own: int, threshold: float):
    """Links between queries and the data of list ``own``: (query places, data places)."""
    may = tool.products(q["unit"], own, d["code"]) + d["error"] >= threshold - 1e-9
    i, j = np.nonzero(may)
    apart = q["node"][i] != d["node"][j]
    i, j = i[apart], j[apart]
    # found from both sides: only the side of the smaller node counts
    both = (d["probes"][j] == q["own"][i][:, None]).any(axis=1)
    once = ~both | (q["node"][i] < d["node"][j])
    i, j = i[once], j[once]
    close = np.concatenate(
        [np.einsum("ij,ij->i", q["unit"][i[k : k + 65536]], d["unit"][j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
        or [np.zeros(0, bool)]
    )
    return i[close], j[close]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Places of the pairs that join something not joined before."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for place, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            out.append(place)
    return out


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, n_links, component), a row per vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("node", F.when(_usable(F.col("v")), F.xxhash64("v")))
    rows = materialize(rows, "vectors")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    classes = materialize(classes, "classes")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    width = size["width"]
    lists = max(LISTS[0], min(LISTS[1], size["n"] // LIST_ROWS))
    # a bounded sample, the same in every run
    some = classes.select(F.xxhash64("node").alias("h"), "v").orderBy("h").limit(SAMPLE).toArrow()
    tool = Quantiser(unit(_matrix(some.column("v"), width)), lists)
    handle = spark.sparkContext.broadcast(tool)  # bounded: lists and codebooks

    def assign(batches):
        tool = handle.value
        for batch in batches:
            units = unit(_matrix(batch.column(2), width))
            if not len(units):
                continue
            near = tool.probes(units, probes)
            code, error = tool.encode(units, near[:, 0])
            flat = pa.array(near.astype(np.int32).ravel())
            step = np.arange(len(units) + 1, dtype=np.int32) * near.shape[1]
            edge = np.arange(len(units) + 1, dtype=np.int32) * width
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edge), pa.array(units.ravel())),
                 pa.ListArray.from_arrays(pa.array(step), flat), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)],
                names=["node", "m", "u", "probes", "code", "error"],
            )

    index = materialize(
        classes.select("node", "m", "v").mapInArrow(
            assign, "node bigint, m bigint, u array<double>, probes array<int>, code binary, error double"
        ), "index",
    )
    index = index.withColumn("own", F.element_at("probes", 1))
    wanted = index.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks"))
    held = index.groupBy(F.col("own").alias("list")).agg(F.ceil(F.count(F.lit(1)) / DATA_BLOCK).cast("int").alias("d_blocks"))
    blocks = F.broadcast(materialize(held.join(wanted, "list"), "blocks"))  # a row per list, LISTS[1] at most
    spread = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    data = index.withColumn("list", F.col("own")).join(blocks, "list").select(
        "list", every("q_blocks").alias("qb"), spread("d_blocks").alias("db"), F.lit(True).alias("data"), "node", "m", "u", "probes", "code", "error", "own"
    )
    queries = index.withColumn("list", F.explode("probes")).join(blocks, "list").select(
        "list", spread("q_blocks").alias("qb"), every("d_blocks").alias("db"), F.lit(False).alias("data"), "node", "m", "u",
        F.expr("cast(null as array<int>)").alias("probes"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"), "own",
    )

    def meet(rows: pa.Table) -> pa.Table:
        tool = handle.value
        data = rows.column("data").to_numpy()
        q = rows.filter(pa.array(~data))
        d = rows.filter(pa.array(data))
        if not len(d):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        qs = {"unit": _matrix(q.column("u"), width), "node": q.column("node").to_numpy(), "own": q.column("own").to_numpy()}
        ds = {"unit": _matrix(d.column("u"), width), "node": d.column("node").to_numpy(), "error": d.column("error").to_numpy(),
              "code": np.frombuffer(b"".join(d.column("code").to_pylist()), np.uint8).reshape(len(d), -1),
              "probes": np.array(d.column("probes").to_pylist())}
        i, j = tile_links(qs, ds, tool, rows.column("list")[0].as_py(), threshold)
        nodes, place = np.unique(np.concatenate([qs["node"], ds["node"]]), return_inverse=True)
        a, b = place[: len(q)][i], place[len(q) :][j]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, a, d.column("m").to_numpy()[j])
        np.add.at(links, b, q.column("m").to_numpy()[i])
        joins = _forest(a, b, len(nodes))
        linked = np.flatnonzero(links)
        return pa.table({
            "a": np.concatenate([nodes[linked], nodes[a[joins]]]),
            "b": pa.array(np.concatenate([np.zeros(len(linked), np.int64), nodes[b[joins]]]), mask=np.arange(len(linked) + len(joins)) < len(linked)),
            "n": np.concatenate([links[linked], np.zeros(len(joins), np.int64)]),
        })

    met = data.unionByName(queries).groupBy("list", "qb", "db").applyInArrow(meet, "a bigint, b bigint, n bigint")
    met = materialize(met, "met")
    counts = met.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("found"))
    groups = components(met.where("b IS NOT NULL").select("a", "b"))
    per_class = classes.select("node", "rep", "m").join(counts, "node", "left").join(groups, "node", "left").withColumn(
        "group", F.coalesce("component", "node")
    )
    per_class = materialize(per_class, "linked")
    names = per_class.groupBy("group").agg(F.min("rep").alias("name"))
    known = per_class.join(names, "group").select("node", (F.col("m") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.col("name").alias("component"))
    return rows.select("id", "node").join(known, "node", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component")
    )


@query("op8_embedding_dedup")
def embedding_dedup(spark, sf):
    found = near_duplicates(table(spark, sf, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
