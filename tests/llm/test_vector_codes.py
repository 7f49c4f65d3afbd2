import hashlib
import math

import numpy as np
import pytest

from slidegrid.llm import vector_codes


def test_nearest_equals_all_distances():
    """Ties go to the lower index, repeated entries included; entries of spread sums are mostly not looked at."""
    rng = np.random.default_rng(1)
    for high, n in ((3, 2), (4, 5), (400, 8), (100_000, 16)):
        entries, parts = rng.integers(-high, high, (256, n)), rng.integers(-high, high, (700, n))
        book = vector_codes.Codebook(entries)
        best, distance = book.nearest(parts)
        every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    spread = rng.integers(-9, 9, (256, 16)) + 50 * np.arange(256)[:, None]
    book = vector_codes.Codebook(spread)
    best, _ = book.nearest(spread[rng.integers(0, 256, 500)] + 1)
    assert book.compared < 0.1 * 500 * 256


def brute(rows, parts=4, entries=256, rounds=4):
    """rows (id, vector, label) by plain loops over all entries."""
    good = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in good), default=1) // parts) * parts
    good = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in good]
    n = width // parts
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * n : p * n + n] for r in first] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            got = {}
            for _, v, _ in good:
                part = v[p * n : p * n + n]
                got.setdefault(near(part, book)[1], []).append(part)
            books[p] = [[sum(c) // len(got[k]) for c in zip(*got[k])] if k in got else e for k, e in enumerate(book)]
    out, by_label = [], {}
    for i, v, lab in good:
        found = [near(v[p * n : p * n + n], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, v string, id int, code int, error long"


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(np.float32(x)) for x in rng.normal(0, 0.02, 8).round(2)], [None, 1, 2][k % 3]) for k in rng.permutation(700)]
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [math.nan] * 8, 1), (903, [math.inf] * 8, 2), (None, [0.5] * 8, 1), (None, None, None)]
    rows += [(5, [0.25] * 8, 4), (5, [0.25] * 8, 4), (6, [-0.5, 1.0], 4), (904, [], None)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in vector_codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == brute(rows)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.vector_codes(none).count() == 0
    few = [(2, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0, 3.5, 4.0], None)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in few], SCHEMA)
    assert sorted((tuple(r) for r in vector_codes.vector_codes(df).collect()), key=str) == brute(few)
    coded, books = vector_codes.compress(df)
    assert {r.id: r.v for r in vector_codes.decode(coded, books).collect()} == {2: [1024, 2048, 3072, 4096], 1: [1024, 2048, 3584, 4096]}
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e12] * 4, 1, "x", 1, 2, 3)], SCHEMA))
