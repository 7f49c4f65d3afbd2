import hashlib
import random

import pytest
from tests.conftest import DATA

from slidegrid.llm import queries, suffix_dedup


def brute_force(texts, length):
    """For each text: its bytes, and which of them a string covers that starts at two places."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for k, raw in enumerate(raws):
        for at in range(len(raw) - length + 1):
            seen.setdefault(hashlib.blake2b(raw[at : at + length], digest_size=12).digest(), []).append((k, at))
    covered = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for k, at in places:
                covered[k][at : at + length] = b"\1" * length
    out = []
    for raw, c in zip(raws, covered):
        runs = sum(1 for i in range(len(c)) if c[i] and not (i and c[i - 1]))
        out.append((len(raw), sum(c), runs, bytes(b for b, x in zip(raw, c) if not x)))
    return out


def check(docs, length, name, monkeypatch=None):
    rows = docs.select("doc_id", "text").collect()
    expected = sorted((str(r.doc_id), *x) for r, x in zip(rows, brute_force([r.text for r in rows], length)))
    spans = suffix_dedup.repeated_spans(docs, length=length, name=name)
    got = suffix_dedup.remove_spans(docs, spans).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == expected
    return got


def test_documents(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((r.doc_id, a, b, c, hashlib.sha256(k).hexdigest()) for r, (a, b, c, k) in zip(rows, brute_force([r.text for r in rows], 400)))
    assert sum(x[2] for x in expected) > 0
    found = queries.op10_suffix_array_dedup(spark, f"{DATA}/sf0.01").collect()
    assert sorted(tuple(r)[:5] for r in found) == expected
    assert all(len(r.text.encode()) == r.n_bytes - r.n_removed for r in found if r.text.isascii())


def test_odd_documents(spark, odd_documents, no_documents):
    got = check(odd_documents, 400, 100)
    assert {"length", "lang", "source"} <= set(got[0].row.asDict())
    check(odd_documents, 40, 10)
    assert suffix_dedup.remove_spans(no_documents, suffix_dedup.repeated_spans(no_documents)).count() == 0


def test_repeated_rows(spark):
    """A thousand equal rows of one id, others without an id, beside rows that share a part of their text."""
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    a, b = make(300), make(90)
    rows = [(7, a)] * 1000 + [(None, b)] * 30 + [(8, make(50) + a[100:200] + make(20)), (9, a[:45] + make(60)), (10, b[10:] + make(9)), (11, make(80)), (12, make(70)), (12, make(80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = check(docs, 40, 10)
    assert sum(r.n_removed == 300 for r in got) == 1000
    spans = suffix_dedup.repeated_spans(docs, length=40, name=10)
    assert spans.count() < 2000


@pytest.mark.parametrize("together", [64, 2])
def test_shared_passages(spark, monkeypatch, together):
    """Passages in many surroundings, at the borders of texts, in runs and periods, of just enough and just too few bytes."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "PIECE", 97)
    rng = random.Random(together)
    letters = "abcdé "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (38, 39, 40, 41, 45, 60, 90, 150)]
    texts = []
    for _ in range(70):
        parts = [make(rng.choice([0, 1, 5, 30, 80]))]
        for _ in range(rng.randint(1, 3)):
            parts += [rng.choice(shared), make(rng.choice([0, 1, 2, 20]))]
        texts.append("".join(parts))
    texts += ["ab" * 60, "x" + "ab" * 45 + "y", "a" * 39, "a" * 40, "a" * 41, "q" * 41, "q" * 200 + shared[3], shared[2] + "z" + shared[2], "abc" * 30 + "q" * 60]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 40, 10)
