import math

import numpy as np
import pytest

from slidegrid.llm import mixing


def test_targets():
    for sizes in ([100, 100, 100], [1, 500, 20, 300, 0], [7], [0, 0], []):
        out = mixing.targets(sizes)
        assert sum(out) == pytest.approx(1.5 * sum(sizes))
        assert all(t <= 2 * n + 1e-9 for t, n in zip(out, sizes))
        free = [(t / mixing.WEIGHTS[k % 3]) for k, (t, n) in enumerate(zip(out, sizes)) if n and t < 2 * n - 1e-9]
        assert not free or max(free) == pytest.approx(min(free))
        capped = [2 * n / mixing.WEIGHTS[k % 3] for k, (t, n) in enumerate(zip(out, sizes)) if n and t >= 2 * n - 1e-9]
        assert not free or not capped or max(capped) <= max(free) + 1e-6


def test_permutations_and_shards():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 12345).tolist()) == list(range(n))
    quotas = np.array([50, 0, 7, 130])
    all_ = list(mixing.shard_counts(quotas, 19, range(19), 10, 3))
    assert [s for s, _, _ in all_] == list(range(19))
    total = np.zeros(4, dtype=int)
    for shard, before, here in all_:
        assert (before == total).all() and here.sum() == (10 if shard < 18 else 7)
        total += here
    assert (total == quotas).all()
    alone = [next(iter(mixing.shard_counts(quotas, 19, range(k, k + 1), 10, 3))) for k in range(19)]
    assert all((a[2] == b[2]).all() and (a[1] == b[1]).all() for a, b in zip(all_, alone))


def test_hypergeometric():
    """The sampler agrees with the exact probabilities where they can be summed, and with mean and spread beyond."""
    rng = np.random.default_rng(4)
    for good, bad, taken in ((30, 50, 20), (400, 3, 200), (5, 2000, 700), (900, 900, 1500)):
        low, high = max(0, taken - bad), min(good, taken)
        log = [-sum(map(math.lgamma, (k + 1, good - k + 1, taken - k + 1, bad - taken + k + 1))) for k in range(low, high + 1)]
        p = np.exp(np.array(log) - max(log))
        p /= p.sum()
        n = 20_000
        seen = np.bincount([mixing.hypergeometric(good, bad, taken, rng) - low for _ in range(n)], minlength=len(p))
        often = p * n > 20
        assert (np.abs(seen - p * n)[often] < 5 * np.sqrt(p * n)[often]).all()
    good, bad, taken = 3 * 10**11, 7 * 10**11, 4 * 10**11
    draws = np.array([mixing.hypergeometric(good, bad, taken, rng) for _ in range(4_000)], dtype=float)
    spread = math.sqrt(taken * 0.3 * 0.7 * 0.6)
    assert abs(draws.mean() - 0.3 * taken) < 5 * spread / math.sqrt(len(draws)) and abs(draws.std() / spread - 1) < 0.06
    assert mixing.hypergeometric(0, 10, 4, rng) == 0 and mixing.hypergeometric(10, 0, 4, rng) == 4


def test_mix(spark, odd_documents, no_documents):
    rows = mixing.mix(odd_documents, block=8).collect()
    assert len(rows) == odd_documents.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        if r.ranges:
            assert sum((x.hi - x.lo) * x.times for x in r.ranges) == r.taken
        by.setdefault(r.source, []).append(r)
    for source, own in by.items():
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 24
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_documents.repartition(3), block=8).collect()))
    assert mixing.mix(no_documents).count() == 0


def test_take_words():
    text = " a b\nc  d e "
    assert mixing.take_words(text, [{"lo": 0, "hi": 2, "times": 2}, {"lo": 2, "hi": 3, "times": 1}, {"lo": 4, "hi": 5, "times": 0}]) == ["a b\nc", "a b"]
    assert mixing.take_words(text, []) == []


def test_query_against_plain_targets(spark):
    """Sizes, source sizes and targets of all documents by plain loops; no document beyond twice its size, sources near their
    targets, and a second run draws the same."""
    import re

    from slidegrid.llm import queries
    from tests.conftest import DATA

    d = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    held: dict = {}
    for r in docs:
        held[r.source] = held.get(r.source, 0) + size[r.doc_id]
    names = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(held.values()), set(names)
    while free:
        full = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * held[s]}
        for s in full or free:
            target[s] = 2.0 * held[s] if full else left * weight[s] / sum(weight[x] for x in free)
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    rows = queries.op3_source_mixing(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(size)
    assert all(r["size"] == size[r.doc_id] and r.source_size == held[r.source] and 0 <= r.taken <= 2 * r["size"] for r in rows)
    assert all(abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source]) for r in rows)
    for s in names:
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= max(200, 0.02 * target[s])
    again = {r.doc_id: r.taken for r in queries.op3_source_mixing(spark, d).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
