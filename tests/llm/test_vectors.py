"""Both vector searches against all pairs."""

import numpy as np
import pytest

from llm import rabitq, topk

NAN, INF = float("nan"), float("inf")


def rows_of(seed, n=700, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    v = (centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, d))).astype(np.float32)
    rows = [(int(i), [float(x) for x in row], "x") for i, row in enumerate(v)]
    hot = rows[10][1]
    rows += [(int(i), hot, "hot") for i in range(n, n + 300)]  # one vector that many rows hold
    rows += [(2000, None, "a"), (2050, [0.0] * d, "b"), (2001, [NAN] + [1.0] * (d - 1), "c"), (2002, [INF] * d, "d"),
             (2003, [None] + [1.0] * (d - 1), "e"), (None, hot, "f"), (2100, [2 * x for x in hot], "g"), (2150, [1.0, 2.0], "h"),
             (2004, [2.0, 1.0], "i"), (2200, [], "j"), (2005, hot, "k"), (2005, hot, "k"), (50, [-x for x in hot], "l")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def usable(rows, zero):
    out = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out.append((i, tuple(map(float, np.array(v, np.float32).astype(float)))))
    return out


def brute(rows, score, k=5):
    asked = {}
    for i, v in rows:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, v in asked.items():
        scored = sorted(((-score(v, w), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(want)


def test_threshold_algorithm_is_exact(spark):
    rows = rows_of(1)
    whole = [(i, tuple(int(np.floor(x * 256)) for x in v)) for i, v in usable(rows, True)]
    want = brute(whole, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    got = topk.top_products(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == want
    assert topk.top_products(frame(spark, []) if False else frame(spark, rows).limit(0)).count() == 0


def test_threshold_search_stops_early():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-5, 5, (4000, 8))
    vectors[17] = 1000
    lists = np.argsort(vectors, axis=0, kind="stable").T.copy()
    query = np.array([1, 2, 3, 4, 5, 6, 7, 8])
    rows, scores = topk.threshold_search(vectors, np.arange(4000), lists, query, 1)
    assert (rows.tolist(), scores.tolist()) == ([17], [36_000])
    for k in (1, 5, 5000):
        q = rng.integers(-3, 4, 8)
        rows, scores = topk.threshold_search(vectors, np.arange(4000), lists, q, k)
        order = np.lexsort((np.arange(4000), -(vectors @ q)))[:k]
        assert rows.tolist() == order.tolist() and scores.tolist() == (vectors @ q)[order].tolist()


@pytest.mark.parametrize("seed", [2, 5])
def test_recall(spark, seed):
    rows = rows_of(seed)

    def cosine(a, b):
        dot = na = nb = 0.0
        for x, y in zip(a, b, strict=True):
            dot += x * y
            na += x * x
            nb += y * y
        return dot / (np.sqrt(na) * np.sqrt(nb))
    want = brute(usable(rows, False), cosine)
    got = sorted(map(tuple, rabitq.nearest(frame(spark, rows)).collect()))
    assert len(got) == len(want)
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.98 * len(want)
    exact = {(q, i): s for q, _, i, s in want}
    assert all(s == exact[q, i] for q, _, i, s in got if (q, i) in exact)
    assert rabitq.nearest(frame(spark, rows).limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    codes, factors = rabitq.encode(v)
    estimate, reach = rabitq.bounds(codes, factors, v[:50])
    off = np.abs(estimate - v @ v[:50].T) <= reach[:, None] + 1e-6
    assert off.mean() > 0.99 and codes.shape == (3000, 32 * rabitq.BITS // 8)
