import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lumenmatch.llm import whitening
from lumenmatch.llm.queries import op11_whitening


def brute(rows, components=16):
    """n, S, eigenvalues (falling), eigenvectors and trace of the fit list, and the integer vector of each sound row."""
    sound = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in sound})
    n, dims = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(dims)]
    v = np.array([[float(Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n**3)) for b in range(dims)] for a in range(dims)])
    values, vectors = np.linalg.eigh(v)
    return n, s, values[::-1], vectors[:, ::-1], float(np.trace(v)), sound


def check(got, rows, components=16):
    n, s, values, vectors, trace, sound = brute(rows)
    k = min(components, int((values > trace * 1e-12).sum()))
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert len(got) == k * len(sound)
    signs = {}
    for i, x in sound:
        d = [n * c - t for c, t in zip(x, s)]
        own = by[i, sum(c * c for c in d)]
        assert sorted(own) == list(range(1, k + 1))
        for c in range(1, k + 1):
            want = sum(float(Fraction(a, n)) * w for a, w in zip(d, vectors[:, c - 1])) / math.sqrt(values[c - 1])
            for r in own[c]:
                assert r["n"] == n and abs(r["explained"] - values[c - 1] / trace) < 1e-9 and r["identity_error"] < 1e-9
                if abs(want) > 1e-6:
                    sign = signs.setdefault(c, 1 if r["whitened"] * want > 0 else -1)
                    assert abs(r["whitened"] * sign - want) < 1e-6 * max(1, abs(want))


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for n, dims, high in ((1, 1, 1), (63, 5, 2), (64, 3, 9), (65, 4, 1 << 20), (200, 2, 1 << 50)):
        z = rng.integers(0, high, (n, dims))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) if j >= i else 0 for j in range(dims)] for i in range(dims)]
        assert whitening.cross_products(z).tolist() == want


def test_hostile_rows(spark):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 0.2) for _ in range(5)]
    same = vec()
    rows = [(i, vec()) for i in range(40)] + [(50 + i, same) for i in range(30)] + [(100, None), (101, [None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, vec()), (7, vec()), (104, [-0.0, 1e-300, 3.0, -2.0, 7.0])]
    schema = "vec_id long, embedding array<double>"
    frame = lambda x: spark.createDataFrame(x, schema).selectExpr("*", "1 as n", "2 as component", "'a' as x", "3 as dims").repartition(3)
    check(whitening.whiten(frame(rows)).collect(), rows)
    check(whitening.whiten(frame(rows + [(200, [1.0]), (201, [])]), components=3).collect(), rows, 3)
    assert whitening.whiten(frame(rows).limit(0)).collect() == []
    assert whitening.whiten(frame([(1, same), (2, same)])).collect() == []
    assert whitening.whiten(frame([(1, []), (2, None)])).collect() == []
    flat = [(i, [float(i % 4), 1.0, 2.0 * (i % 4)]) for i in range(9)]
    check(whitening.whiten(frame(flat)).collect(), flat)
    huge = whitening.whiten(frame([(1, [1e300, 0.0]), (2, [-1e300, 0.5]), (3, [0.0, 0.0])])).collect()
    assert huge and all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in huge if r["vec_id"] < 3)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_query_against_brute_force(spark, sf, kind):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in docs.collect()]
    got = op11_whitening(spark, sf).collect() if kind == "float" else whitening.whiten(docs.withColumn("embedding", docs["embedding"].cast("array<double>"))).collect()
    n, s, values, vectors, trace, sound = quick(rows)
    assert len(got) == 16 * len(sound) and got[0]["n"] == n
    w = np.zeros((len(sound), 16))
    at = {i: k for k, (i, _) in enumerate(sound)}
    for r in got:
        w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - values[r["component"] - 1] / trace) < 1e-9
        assert r["deviation"] == sum((n * c - t) ** 2 for c, t in zip(sound[at[r["vec_id"]]][1], s))
    x = np.array([x for _, x in sound], float) - np.array(s) / n
    want = x @ vectors[:, :16] / np.sqrt(values[:16])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-6
    assert max(r["identity_error"] for r in got) < 1e-9


def quick(rows):
    sound = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=np.int64)
    n = len(fit)
    s = [int(v) for v in fit.sum(axis=0)]
    d = n * fit - np.array(s)
    v = (d.T @ d) / n**3
    values, vectors = np.linalg.eigh(v)
    return n, s, values[::-1], vectors[:, ::-1], float(np.trace(v)), sound
