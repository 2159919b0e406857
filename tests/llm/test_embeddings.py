import numpy as np
import pytest

from topicloom.llm import embeddings as e


def close_pairs(r, n, cosine, width=64):
    a = e.unit(r.normal(size=(n, width)))
    side = r.normal(size=(n, width))
    side = e.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * side


@pytest.mark.parametrize(("cosine", "least"), [(0.9, 0.9), (0.93, 0.95), (0.98, 0.99)])
def test_probes_are_enough(cosine, least):
    """Pairs just above the threshold among random vectors, the hardest case, at 256 lists."""
    r = np.random.default_rng(2)
    a, b = close_pairs(r, 6000, cosine)
    tool = e.Quantiser(np.concatenate([a, b])[r.permutation(12_000)[:8000]], 256)
    pa, pb = tool.probes(a, e.PROBES), tool.probes(b, e.PROBES)
    found = (pa == pb[:, :1]).any(axis=1) | (pb == pa[:, :1]).any(axis=1)
    print(found.mean())
    assert found.mean() >= least
    own = int(pb[0, 0])
    inside = np.flatnonzero(pb[:, 0] == own)
    codes, error = tool.encode(b[inside], pb[inside, 0])
    exact = a[:500] @ b[inside].T
    assert (np.abs(tool.products(a[:500], own, codes) - exact) <= error + 1e-9).all()


def brute(rows, threshold=0.9):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    width = max(len(v) for _, v in rows if v is not None)
    n = len(rows)
    ok = np.array([usable(v) for _, v in rows])
    x = np.zeros((n, width))
    for k in np.flatnonzero(ok):
        x[k, : len(rows[k][1])] = rows[k][1]
    x[ok] = e.unit(x[ok])
    link = (x @ x.T >= threshold) & ok[:, None] & ok[None, :]
    np.fill_diagonal(link, False)
    label = np.arange(n)
    while True:
        near = np.array([min([label[k], *label[link[k]]]) for k in range(n)])
        if (near == label).all():
            break
        label = near
    ids = [i for i, _ in rows]
    name = {g: min(ids[k] for k in range(n) if label[k] == g) for g in set(label.tolist())}
    return sorted((ids[k], int(link[k].sum()), name[label[k]]) for k in range(n))


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(e, "DATA_BLOCK", 16)
    monkeypatch.setattr(e, "QUERY_BLOCK", 32)
    r = np.random.default_rng(4)
    base = r.normal(size=(150, 12))
    hot = base[0] + 0.1 * r.normal(size=(90, 12))
    vectors = [*base.tolist(), *hot.tolist(), *(base[:40] + 0.3 * r.normal(size=(40, 12))).tolist()]
    vectors += [base[3].tolist()] * 5 + [(2 * base[3]).tolist(), [0.0] * 12, [], None, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11]
    vectors += [[float("inf")] + [1.0] * 11, base[5].tolist()[:11], [1e-30] * 12, [1e30] * 12]
    rows = list(zip(r.permutation(1000)[: len(vectors)].tolist(), vectors))
    rows.append(rows[10])
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<double>, node int, m string")
    got = sorted(map(tuple, e.near_duplicates(frame, probes=16).collect()))
    assert got == brute(rows)


def test_empty_and_unusable(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert e.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = e.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0]), (None, [])], schema)).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]
    got = e.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 2.0])], schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
