"""Prefix trie of conversations, rolled up by centroid decomposition.

A conversation is a sequence of turns (role, text); a node is a distinct sequence of the first d
turns, and its members are the conversations that start with it. Turns are numbered by a range
sort, and a prefix is named by the exclusive or of two hashes of every (place, role, text) up
to d, so prefixes of long conversations are worked out in blocks. Conversations that are equal as a
whole are one weighted sequence before anything is grouped by prefix. A node's key without its last
turn is its parent's, so the edges need no join.

Totals over subtrees: ``roll_up`` takes the forest of parent edges. A component of more than
``local`` nodes is cut at its centroid, the smallest subtree of at least half of it: the total of the
subtree below is the centroid's own plus those of the components that hang on it, and is added to
every node on the path from the centroid to the component's top; then the pieces go on alone.
Sizes, paths and pieces come from the sequences: the ancestor of a node at any depth is the
prefix of its owner (its smallest member) there, so a cut is a few joins, whatever the depth. Components
of at most ``local`` nodes are finished the same way inside a task, many of them in one.

``ends`` digests may cover a third of all conversations: ids are joined into texts of
``ENDS_BLOCK`` in range-sorted order, and one stream a node hashes the blocks.

Defined results: turns are ordered by (turn, role, text), nulls first; null role or text is empty; rows
that repeat are turns of their own; rows without conv_id are not looked at; an empty table gives an
empty result (no conversation, no root); texts of any length are hashed whole; further columns
are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.base import query, table
from topicloom.operators.numbering import dense_index
from topicloom.operators.skew import measured_join
from topicloom.session import discard, materialize

BLOCK = 512  # turns whose running keys one window works out
LOCAL = 20_000  # nodes of a component that a task finishes
ENDS_BLOCK = 2_048


# --- sequences ---------------------------------------------------------------


def _key(a: Column, b: Column) -> Column:
    """Two hashes as one name of 32 digits."""
    return F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (a, b)])


ROOT = "0" * 32


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, chars, h1, h2): turns from 0 in order, their content as two hashes; no task sorts a whole conversation."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ranked = dense_index(rows, ["conv", "turn", "role", "text"], "n").select(
        "conv", "n", F.length("text").cast("bigint").alias("chars"), *[F.xxhash64(F.lit(s), "role", "text").alias(f"h{s}") for s in (1, 2)]
    )
    ranked = materialize(ranked, "turns")
    first = ranked.groupBy("conv").agg(F.min("n").alias("first"))
    return materialize(ranked.join(first, "conv").select("conv", (F.col("n") - F.col("first")).alias("pos"), "chars", "h1", "h2"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv), turns): the first h turns of the hundred's first conversation, h being
    crc32(conv) % 6, then the conversation's own behind its first h."""
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    plan = lengths.select("conv", (F.crc32(F.col("conv").cast("string")) % 6).alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    bases = lengths.select(F.col("conv").alias("base"), "own")
    plan = materialize(
        plan.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("own", F.lit(0))).alias("taken")), "plan"
    )
    heads = turns.where("pos < 6").withColumnRenamed("conv", "base")
    columns = ["conv", "pos", "chars", "h1", "h2"]
    copied = plan.join(heads, "base").where("pos < taken").select(*columns)
    own = turns.join(plan, "conv").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select(*columns)
    return plan.select("conv"), copied.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, chars) for every prefix of at least one turn; ``turns`` hold (conv, pos, e1, e2, chars)."""
    rows = turns.withColumn("block", F.floor(F.col("pos") / BLOCK))
    blocks = rows.groupBy("conv", "block").agg(*[F.bit_xor(f"e{i}").alias(f"b{i}") for i in (1, 2)])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    within = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select("*", *[F.bit_xor(f"e{i}").over(within).alias(f"r{i}") for i in (1, 2)]).join(starts, ["conv", "block"])
    here = [F.col(f"r{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)]
    before_it = [k.bitwiseXOR(F.col(f"e{i}")) for i, k in zip((1, 2), here)]
    return running.select("conv", (F.col("pos") + 1).alias("depth"), _key(*here).alias("node"), _key(*before_it).alias("parent"), "chars")


# --- totals over subtrees ----------------------------------------------------


def centroid_totals(parent: list[int], values: list[np.ndarray]) -> list[np.ndarray]:
    """Totals over subtrees of a forest by centroid decomposition; parents come before their children.

    ``parent`` is -1 for tops. A level cuts every component at its centroid; nodes of a component of one are done.
    """
    n = len(parent)
    up, top = list(parent), list(range(n))
    sums = [np.zeros(n, v.dtype) for v in values]
    alive = list(range(n))
    while alive:
        size = dict.fromkeys(alive, 1)
        for v in reversed(alive):
            if up[v] >= 0:
                size[up[v]] += size[v]
        for v in alive:
            top[v] = v if up[v] < 0 else top[up[v]]
        # subtrees of at least half lie on one path, so the smallest of them is the last in order
        centroid: dict[int, int] = {}
        for v in alive:
            if 2 * size[v] >= size[top[v]]:
                centroid[top[v]] = v
        cut = set(centroid.values())
        piece: dict[int, int] = {}
        for v in alive:  # pieces after the cut: the centroid itself, what hangs on it, what is above
            piece[v] = v if up[v] < 0 or v in cut or up[v] in cut else piece[up[v]]
        order = np.array(alive)
        owner = np.array([piece[v] for v in alive])
        for s, values_of in zip(sums, values):
            total = np.zeros(n, values_of.dtype)
            np.add.at(total, owner, values_of[order])
            below = {c: total[c] for c in cut}
            for v in alive:
                if piece[v] == v and up[v] in cut:
                    below[up[v]] += total[v]
            for c in cut:
                v = c
                while v >= 0:
                    s[v] += below[c]
                    v = up[v]
        for v in alive:
            if v in cut or up[v] in cut:
                up[v] = -1
        alive = [v for v in alive if v not in cut]
    return sums


def _finish(share: pa.Table) -> pa.Table:
    """Totals of all components in one task's share."""
    rows = share.sort_by("depth")
    place = {k: i for i, k in enumerate(rows.column("node").to_pylist())}
    above = zip(rows.column("node").to_pylist(), rows.column("component").to_pylist(), rows.column("parent").to_pylist())
    parent = [-1 if node == top else place[up] for node, top, up in above]
    totals = centroid_totals(parent, [rows.column(c).to_numpy() for c in ("leaves", "saved")])
    return pa.table({"node": rows.column("node"), "leaves": pa.array(totals[0]), "saved": pa.array(totals[1])})


STATE = ["node", "parent", "depth", "owner", "leaves", "saved", "size", "component"]


def _cut(state: DataFrame, paths: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One level of the decomposition: (the pieces, totals to add to the nodes on the way up from the centroids)."""
    half = state.join(big, "component").where(2 * F.col("size") >= F.col("whole"))
    least = F.min_by(F.struct("node", "depth", "owner", "size", "leaves", "saved"), F.struct("size", -F.col("depth")))
    cuts = materialize(half.groupBy("component").agg(least.alias("at")).select("component", "at"), "cuts")
    # the piece of an owner's nodes below the centroid starts where its sequence leaves it
    pieces = paths.join(cuts.select("component", F.col("at.node").alias("parent")), "parent").select("component", F.col("conv").alias("owner"), F.col("node").alias("piece"))
    way = paths.join(cuts.select("component", F.col("at.owner").alias("conv"), F.col("at.depth").alias("last")), "conv").where("depth <= last")
    way = way.select("component", "node", F.lit(True).alias("on_way"))
    held = state.join(cuts, "component").join(pieces, ["component", "owner"], "left").join(way, ["component", "node"], "left")
    down = F.col("piece").isNotNull() & (F.col("depth") > F.col("at.depth"))
    on_way = F.coalesce("on_way", F.col("depth") == 0)
    held = materialize(held.select(*STATE, "at", "piece", down.alias("down"), on_way.alias("on_way")), "held")
    totals = held.where("down").groupBy("component", "piece").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = totals.groupBy("component").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = cuts.join(below, "component", "left").select(
        "component", *[(F.col(f"at.{c}") + F.coalesce(c, F.lit(0))).alias(c) for c in ("leaves", "saved")]
    )
    added = materialize(held.where("on_way").select("component", "node").join(below, "component").drop("component"), "added")
    size = F.when(F.col("on_way"), F.col("size") - F.col("at.size")).otherwise(F.col("size"))
    moved = held.where(F.col("node") != F.col("at.node")).withColumn("size", size).withColumn(
        "component", F.when(F.col("down"), F.col("piece")).otherwise(F.col("component"))
    )
    rest = state.join(cuts.select("component"), "component", "left_anti")
    after = materialize(rest.select(*STATE).unionByName(moved.select(*STATE)), "forest")
    for spent in (cuts, held):
        discard(spent)
    return after, added


def roll_up(nodes: DataFrame, paths: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, leaves, saved): totals over the subtree of every node, itself included.

    ``nodes`` are (node, parent, depth, owner, leaves, saved) with one node of depth 0; ``paths``
    are (conv, depth, node, parent), the sequences of the owners. Both are stored.
    """
    n = nodes.count()
    owned = nodes.where("depth > 0").groupBy(F.col("owner").alias("conv")).agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("last"))
    # of an owner's nodes, those below a node of its sequence: all, but no more than lie at that depth and deeper
    below = paths.join(owned, "conv").groupBy("node").agg(F.sum(F.least("n", F.col("last") - F.col("depth") + 1)).alias("size"))
    state = nodes.join(below, "node", "left").withColumn("size", F.coalesce("size", F.lit(n))).withColumn("component", F.lit(ROOT))
    state = materialize(state.select(*STATE), "forest")
    added = []
    while True:
        whole = state.where("node = component").select("component", F.col("size").alias("whole")).where(F.col("whole") > local)
        big = materialize(whole, "big")
        if big.isEmpty():
            discard(big)
            break
        after, more = _cut(state, paths, big)
        added.append(more)
        discard(big)
        discard(state)
        state = after
    shares = max(1, -(-n // local))
    done = state.withColumn("share", F.pmod(F.xxhash64("component"), F.lit(shares))).select("share", "node", "parent", "depth", "component", "leaves", "saved")
    done = done.groupBy("share").applyInArrow(_finish, "node string, leaves bigint, saved bigint")
    for more in added:
        done = done.unionByName(more)
    return done.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


# --- digests of the conversations that end at a node ---------------------------


def _joined(batches):
    """Runs of (node, conv), in order, as texts of at most ENDS_BLOCK ids: (node, first, ids)."""
    node, ids = None, []

    def text():
        return pa.RecordBatch.from_arrays(
            [pa.array([node]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"]
        )

    for batch in batches:
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (name != node or len(ids) == ENDS_BLOCK):
                yield text()
                ids = []
            node = name
            ids.append(conv)
    if ids:
        yield text()


def _digested(batches):
    """(node, ends_sha256) from texts in order; what is held is one hash state."""
    node, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if state is not None and name == node:
                state.update(b",")
            else:
                if state is not None:
                    yield row()
                node, state = name, hashlib.sha256()
            state.update(ids.encode())
    if state is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv): SHA-256 of the ids in order, joined by commas."""
    blocks = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(
        _joined, "node string, first bigint, ids string"
    )
    return blocks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node string, ends_sha256 string")


# --- the trie ------------------------------------------------------------------


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = numbered_turns(conversations)
    everyone, turns = rebuilt(turns)
    turns = materialize(
        turns.select("conv", "pos", "chars", *[F.xxhash64(F.lit(s), "pos", "h1", "h2").alias(f"e{s}") for s in (1, 2)]), "rebuilt"
    )
    whole = turns.groupBy("conv").agg(*[F.bit_xor(f"e{i}").alias(f"k{i}") for i in (1, 2)])
    zero = F.lit(0).cast("bigint")
    whole = everyone.join(whole, "conv", "left").select("conv", _key(F.coalesce("k1", zero), F.coalesce("k2", zero)).alias("node"))
    whole = materialize(whole, "whole")
    alike = materialize(whole.groupBy("node").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight")), "alike")
    # one sequence of each, weighted by how many conversations it stands for
    paths = materialize(prefixes(turns.join(alike.select("conv"), "conv", "left_semi")).join(alike.select("conv", "weight"), "conv"), "paths")
    found = paths.groupBy("node").agg(
        F.min("conv").alias("owner"), F.sum("weight").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("chars").alias("chars")
    )
    top = alike.agg(F.min("conv").alias("owner"), F.sum("weight").alias("n_convs")).where("owner IS NOT NULL").select(
        F.lit(ROOT).alias("node"), "owner", "n_convs", zero.alias("depth"), F.lit(None).cast("string").alias("parent"), zero.alias("chars")
    )
    nodes = materialize(found.unionByName(top), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    valued = nodes.select(
        "node", "parent", "depth", "owner", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    )
    totals = roll_up(valued, paths.select("conv", "depth", "node", "parent"), local)
    ends = end_digests(whole)
    above = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    own = measured_join(nodes.where("parent IS NOT NULL"), above, ["parent"]).unionByName(
        nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    )
    return own.join(totals, "node").join(ends, "node", "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
plan AS (SELECT ids.*, least(h, (SELECT count(*) FROM t WHERE t.c = ids.base)) AS taken FROM ids),
turns AS (
  SELECT plan.c, pos, role, text FROM plan JOIN t ON t.c = plan.base WHERE pos < taken
  UNION ALL SELECT plan.c, pos - h + taken, role, text FROM plan JOIN t USING (c) WHERE pos >= h),
pre AS (
  SELECT c, pos + 1 AS d, length(text) AS chars,
         string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY pos) AS k FROM turns),
path AS (SELECT c, d, chars, k FROM pre UNION ALL SELECT c, 0, 0, '' FROM plan),
node AS (SELECT k, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(chars) AS chars FROM path GROUP BY k),
kids AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
val AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids USING (k)),
under AS (
  SELECT path.k, sum((v.kids = 0)::BIGINT) AS leaves, sum((v.n - 1) * v.chars) AS saved
  FROM val v JOIN path ON path.c = v.c AND path.d <= v.d GROUP BY path.k),
ends AS (
  SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS who
  FROM (SELECT c, max_by(k, d) AS k FROM path GROUP BY c) GROUP BY k)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, up.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children,
       under.leaves::BIGINT AS n_leaves, under.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.who, '')) AS ends_sha256
FROM val v JOIN under ON under.k = v.k LEFT JOIN ends ON ends.k = v.k
LEFT JOIN node up ON v.d > 0 AND up.k = left(v.k, length(v.k) - 32)"""


@query("op12_prefix_trie", ORACLE)
def conversation_prefix_trie(spark, sf):
    return prefix_trie(table(spark, sf, "conversations"))
