import numpy as np
import pytest

from provenant.llm import embedding_dedup as ed
from tests.llm.test_simhash import plain_components

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows, threshold=0.98):
    good = {}
    for i, v, label, _ in rows:
        if v is None or label is None or not len(v) or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float32).astype(np.float64)
        if np.isfinite(x).all() and x.any():
            good[i] = (label, x / np.linalg.norm(x))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold]
    comp = plain_components([r[0] for r in rows], links)
    n = dict.fromkeys(comp, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in comp}


@pytest.mark.parametrize("capacity", [5, 4096])
def test_equals_brute_force(spark, capacity):
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(60):
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        for _ in range(rng.integers(1, 12)):
            vectors.append(c + rng.normal(size=64) * rng.choice([0, 0.009, 0.012, 0.02]))
    hot = rng.normal(size=64)
    vectors += [hot + rng.normal(size=64) * 0.05 for _ in range(60)] + [hot] * 5
    vectors += [rng.normal(size=8) for _ in range(5)]
    ids = rng.permutation(len(vectors) + 100)
    rows = [(int(i), [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 2)), "x") for i, v in zip(ids, vectors)]
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows += [(1000 + k, v, 1, "x") for k, v in enumerate(odd)]
    rows += [(2000 + k, rows[0][1], None, "x") for k in range(2)]
    got = ed.op1_embedding_dedup(spark.createDataFrame(rows, SCHEMA), capacity=capacity).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def test_recall_just_above_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    p, q = (ed.CrossPolytope().codes(x) for x in (a, b))
    met = (p == q[:, :, :1]).any(axis=(1, 2)) | (q == p[:, :, :1]).any(axis=(1, 2))
    assert met.mean() > 0.999


def test_hadamard_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = ed.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(ed.hadamard(y), x)


def test_empty(spark):
    assert ed.op1_embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    got = ed.op1_embedding_dedup(spark.createDataFrame([(None, [1.0, 0.0], 1, ""), (3, [1.0, 0.0], 1, "")] * 2, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (0, 0), (3, 1), (3, 1)]
