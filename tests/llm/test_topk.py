import math

import numpy as np
from pyspark.sql import functions as F

from slidegrid.llm import topk


def test_bounds():
    rng = np.random.default_rng(1)
    a, b = rng.normal(3, 20, (40, 30)), rng.normal(-2, 9, (50, 30))
    for r in topk.RESOLUTIONS:
        assert (topk._segment_features(a, r) @ topk._segment_features(b, r).T >= a @ b.T - 1e-6).all()


def test_few_pairs_are_scored():
    """Of vectors in groups, and of vectors of unlike lengths, the bounds leave few to be scored; the best stay right."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (40, 8)).repeat(4, axis=1)
    grouped = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 4, (6000, 32)))
    lengths = np.floor(rng.normal(0, 64, (6000, 32)) * (1 + 30 * (rng.random(6000) < 0.02))[:, None])
    for rows in (grouped, lengths):
        ids = np.arange(len(rows))
        search = topk._Search(ids[:50], rows[:50], 20)
        order = np.argsort(-(rows**2).sum(axis=1), kind="stable")
        for at in [0, *range(topk.FIRST_PIECE, len(rows), topk.PIECE)]:
            part = order[at : topk.FIRST_PIECE] if not at else order[at : at + topk.PIECE]
            search.offer(ids[part], rows[part])
        scores = (rows[:50] @ rows.T).astype(np.int64)
        for q in range(50):
            want = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if i != q)[:20]
            mine = search.rows == q
            assert sorted(zip((-search.scores[mine]).tolist(), search.found[mine].tolist())) == want
        assert search.met == 50 * len(rows) - 50 and search.scored < 0.2 * search.met


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "FIRST_PIECE", 7)
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.normal(0, 1, 6).round(1)], int(k)) for k in range(400)]
    rows += [(400, None, 0), (420, [1.0, None, 2.0], 0), (440, [math.nan], 0), (460, [math.inf, 1.0], 0), (480, [], 0), (500, [1.0, 2.0], 0), (None, [9.0] * 6, 0), (20, [1.0] * 6, 0), (21, [5.0] * 9, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, x in good:
        if q % 20 == 0:
            expected += [(q, i, sum(a * b for a, b in zip(x, y))) for i, y in good if i != q]
    best = {}
    for q, i, s in expected:
        best.setdefault(q, []).append((-s, i))
    want = sorted((q, k + 1, i, -s) for q, found in best.items() for k, (s, i) in enumerate(sorted(found)[:20]))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert [g for g in got if g[0] != 20] == [w for w in want if w[0] != 20]  # two rows share id 20
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
