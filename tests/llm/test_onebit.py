"""Neighbours in crowds of vectors that are nearly or wholly alike: what tasks hold and make, and what is found."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import onebit


def crowd(n, dim=16, spread=0.01):
    rng = np.random.default_rng(11)
    return rng.normal(size=dim) + spread * rng.normal(size=(n, dim))


def test_a_scan_holds_the_best_of_each_query_only(monkeypatch):
    monkeypatch.setattr(onebit, "TILE", 7)
    monkeypatch.setattr(onebit, "PAIR_NUMBERS", 100)
    x, k = crowd(400), 5
    exact = x[:30] @ x.T
    exact[np.arange(30), np.arange(30)] = -np.inf
    want = np.argsort(-exact, axis=1)[:, :k]
    turn, centre = onebit.rotation(16), x.mean(0)
    for proven in (range(0), range(0, 400, 100), range(0, 400, 50)):
        first = onebit.Scan(x[:30], np.arange(30), turn, k, onebit.EPSILON)
        for a in proven:
            first.prove(np.arange(a, a + 50), onebit.encode(x[a : a + 50], centre, turn), x[a : a + 50])
        bars = first.proven.min(1)
        assert (bars <= np.sort(exact, axis=1)[:, -k] + 1e-9).all()
        scan = onebit.Scan(x[:30], np.arange(30), turn, k, onebit.EPSILON, bars)
        for a in range(0, 400, 50):
            scan.take(np.arange(a, a + 50), onebit.encode(x[a : a + 50], centre, turn), x[a : a + 50])
            assert sum(len(q) for q, _, _ in scan.held.values()) <= 30 * k
        query, ids, score = (np.concatenate(c) for c in zip(*scan.held.values(), strict=True))
        assert (np.bincount(query, minlength=30) == k).all()
        hits = sum(len({*ids[query == q]} & {*want[q]}) for q in range(30))
        assert hits / (30 * k) > 0.95 and np.allclose(score, exact[query, ids], atol=1e-12)


def test_rows_do_not_follow_the_number_of_blocks(spark):
    x, k = crowd(800), 3
    made = []
    save = onebit.save

    def counted(df, name):
        made.append((name, out := save(df, name)))
        return out

    onebit.save = counted
    try:
        found = onebit.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=k, block_rows=10).collect()
    finally:
        onebit.save = save
    rows = {name: df.count() for name, df in made}
    assert rows["onebit-index"] > 60 and rows["onebit-found"] < 40 * k * 2 * onebit.PILOT
    exact = x @ x.T
    hits = sum(r["vec_id"] in np.argsort(-np.where(np.arange(800) == r["query_id"], -np.inf, exact[r["query_id"]]))[:k] for r in found)
    assert len(found) == 40 * k and hits / len(found) > 0.95


def test_copies_behind_many_rows_of_the_querys_own_id(spark):
    rows = [(20, [1.0, 2.0])] * 9 + [(i, [1.0, 2.0]) for i in range(21, 60)] + [(3, [0.5, 1.0]), (61, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted({(r["query_id"], r["rank"], r["vec_id"]) for r in onebit.nearest(vectors, F.col("vec_id").isin(20, 25), k=3).collect()})
    assert found == [(20, 1, 21), (20, 2, 22), (20, 3, 23), (25, 1, 20), (25, 2, 20), (25, 3, 20)]
