import random
import re

import numpy as np
from tests.conftest import DATA

from slidegrid.llm import near_dedup, queries
from slidegrid.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute_force(rows, width, percent):
    """{doc_id: (sizes, component)}: rows that share an id are one document."""
    rows = [(d, shingles(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for d, s in rows:
        for g in s:
            index.setdefault(g, []).append((d, s))
    classes = {}
    for d, s in rows:
        classes.setdefault(s, set()).add(d)
    for s, same in classes.items():
        if not s:
            continue
        ids = sorted(same)
        for d in ids[1:]:
            parent[find(d)] = find(ids[0])
    distinct = sorted((s for s in classes if s), key=len)
    sizes = [len(s) for s in distinct]
    for i, s in enumerate(distinct):
        for j in range(i + 1, len(distinct)):
            if 100 * sizes[i] < percent * sizes[j]:
                break
            both = len(s & distinct[j])
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                parent[find(min(classes[s]))] = find(min(classes[distinct[j]]))
    roots = {}
    for d in parent:
        roots[find(d)] = min(d, roots.get(find(d), d))
    return {d: roots[find(d)] for d in parent}


def check(got, rows, width, percent):
    expected = brute_force(rows, width, percent)
    assert len(got) == len(rows)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, width)) for _, t in rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op8_near_dedup(spark, f"{DATA}/sf0.01").collect(), rows, 2, 80)


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    check(near_dedup.near_duplicates(odd_documents, width=5).collect(), rows, 5, 80)
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_large_groups_and_chains(spark, monkeypatch):
    """Groups larger than a hub's members and than a block, chains whose ends are not alike, and buckets of several components."""
    monkeypatch.setattr(near_dedup, "MEMBERS", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 5)
    monkeypatch.setattr(near_dedup, "COLUMNS", 16)
    rng = random.Random(4)
    rows = []
    for _ in range(4):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(60):
            words = list(words)
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(60)] = f"w{rng.randrange(500)}"
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    check(got, rows, 2, 80)


def test_sketch_agrees_as_jaccard():
    rng = np.random.default_rng(6)
    agree = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (80, 10, 10))
        x, y = (near_dedup.sketch(np.unique(np.concatenate([both, z]))) for z in (a, b))
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 0.8) < 0.01 and np.std(agree) < 0.06
    assert (near_dedup.sketch(np.array([5], dtype=np.uint64)) != ~np.uint64(0)).all()


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 480)] + [(900, k) for k in range(901, 950)] + [(None, 3), (5, 5)]
    expected = {}
    neighbours = {}
    for u, v in links:
        if u is not None and u != v:
            neighbours.setdefault(u, set()).add(v)
            neighbours.setdefault(v, set()).add(u)
    for start in sorted(neighbours):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = start
                todo += neighbours[x]
    got = connected_components(spark.createDataFrame(links, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == expected
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
