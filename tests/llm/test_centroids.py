import hashlib
import random

import numpy as np

from quillmill.llm import centroids


def brute(rows, k, rounds, dims, scale, seed=1):
    """Plain Lloyd, every vector against every centroid in every round."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    drawn = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in drawn[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        own = nearest()
        for n in range(len(c)):
            if mine := [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == n]:
                c[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = nearest()
    inertia = {n: sum(d for d, o in own if o == n) for n in range(len(c))}
    return sorted((i or 0, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, own, strict=True))


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'x' AS v", "2 AS distance")
    return sorted((r.vec_id or 0, *r[1:]) for r in centroids.cluster(df, **how).collect())


def test_rounds_against_plain_lloyd(spark):
    rnd = random.Random(3)
    for dims, k, rounds in ((4, 5, 3), (3, 16, 6), (2, 3, 0)):
        rows = [(i, [rnd.choice([-1, 0, 1]) * rnd.random() + i % 3 for _ in range(dims)]) for i in range(200)]
        how = {"dims": dims, "k": k, "rounds": rounds, "scale": 16}
        assert got(spark, rows, **how) == brute(rows, **how)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]  # many equal starts: all but two stay empty
    how = {"dims": 2, "k": 8, "rounds": 3, "scale": 2}
    assert got(spark, rows, **how) == brute(rows, **how)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [-inf, 0.0]), (8, [0.5, -0.5]), (8, [0.5, -0.5]), (None, [0.25, 3.0]), (9, [1.0, 2.0, 3.0]), (10, [-0.01, 0.0])]
    how = {"dims": 2, "k": 16, "rounds": 3, "scale": 64}
    want = brute(rows, **how)
    assert len(want) == 4 and got(spark, rows, **how) == want
    assert got(spark, [], **how) == [] and got(spark, rows[:7], **how) == []
    huge = got(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e300, 1e300])], dims=2, k=1, rounds=1, scale=64)
    assert len(huge) == 3 and all(r[2] >= 0 and r[3] >= r[2] for r in huge)


def test_a_round_compares_only_what_changed(monkeypatch):
    seen = []
    real = np.einsum
    monkeypatch.setattr(centroids.np, "einsum", lambda s, a, b: seen.append(len(a)) or real(s, a, b))
    v = np.array([[0, 0], [1, 0], [10, 0], [11, 0], [20, 0]], np.int64)
    c = np.array([[0, 0], [10, 0], [20, 0]], np.int64)
    owner, d = centroids.nearest(v, np.full(5, -1), np.zeros(5, np.int64), c, np.ones(3, bool))
    assert seen == [5, 5, 5] and owner.tolist() == [0, 0, 1, 1, 2] and d.tolist() == [0, 1, 0, 1, 0]
    seen.clear()
    c[2] = [12, 0]
    owner, d = centroids.nearest(v, owner, d, c, np.array([False, False, True]))
    assert seen == [1, 1, 5] and owner.tolist() == [0, 0, 1, 1, 2] and d.tolist() == [0, 1, 0, 1, 64]


def test_transfers_are_signed_sums(spark):
    state = spark.createDataFrame([(1, [1, 2], 0, 1, 0), (2, [3, 4], -1, 0, 0), (3, [5, 6], 1, 1, 0), (4, [7, 8], 1, 0, 0)], centroids._STATE)
    assert sorted(centroids.transfers(state, 2)) == [(0, 1, [9, 10]), (1, 0, [-6, -6])]
