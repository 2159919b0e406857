"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from topicloom.llm.tries import centroid_totals, prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in convs.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        seq = tuple(base[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, d == len(seq)))
    out = []
    for seq, members in nodes.items():
        under = [s for s in nodes if s[: len(seq)] == seq]
        kids = lambda s: sum(len(x) == len(s) + 1 and x[: len(s)] == s for x in nodes)
        ends = ",".join(map(str, sorted(c for c, last in members if last)))
        out.append((
            min(members)[0], len(seq), min(nodes[seq[:-1]])[0] if seq else None, len(members), kids(seq),
            sum(kids(s) == 0 for s in under), sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in under if s), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def some_rows(n_convs, seed, longest=8):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_convs):
        conv = rng.choice([rng.randrange(-120, 450), rng.randrange(3)])
        n = rng.randint(1, longest)
        for turn in range(n):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi", "yes é", "", None, "ok"])))
    return rows


def check(spark, rows, local):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, node string, depth int")
    got = [tuple(r) for r in prefix_trie(frame, local=local).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == brute(rows)


@pytest.mark.parametrize("local", [3, 20_000])
def test_equal_to_a_dictionary_of_prefixes(spark, local):
    check(spark, some_rows(60, local) + [(None, 1, "user", "hi"), (7, 1, None, None), (7, 1, None, None)], local)


def test_long_chain_and_hot_copies(spark):
    long = [(1000, t, "user", "abc" * (t % 3)) for t in range(700)]
    copies = [(2000 + c, t, "user", "the same") for c in range(90) for t in range(7)]
    check(spark, long + copies, 64)


def test_only_turnless_and_empty_table(spark):
    # crc32("5") % 6 > 0, and there is no conversation 0: its one turn goes and nothing comes
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    check(spark, [(lone, 0, "user", "hi")], 10)
    assert prefix_trie(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


def test_centroid_totals_of_random_forests():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 60)
        parent = [-1 if i == 0 or rng.random() < 0.1 else rng.randrange(max(0, i - rng.choice([1, 5, 60])), i) for i in range(n)]
        value = np.array([rng.randrange(-5, 9) for _ in range(n)])
        want = value.copy()
        for v in range(n - 1, -1, -1):
            if parent[v] >= 0:
                want[parent[v]] += want[v]
        depth = [0] * n
        for v in range(n):
            depth[v] = depth[parent[v]] + 1 if parent[v] >= 0 else 0
        order = sorted(range(n), key=lambda v: depth[v])
        place = {v: i for i, v in enumerate(order)}
        moved = [place[parent[v]] if parent[v] >= 0 else -1 for v in order]
        got, same = centroid_totals(moved, [value[order], value[order]])
        assert got.tolist() == want[order].tolist() == same.tolist()
