import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.conftest import DATA

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from slidegrid.llm import packing, queries, token_shards  # noqa: E402
from slidegrid.llm.encoding import WordTableEncoder, slices  # noqa: E402
from slidegrid.llm.shared import fresh_path  # noqa: E402

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path):
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", "a \n b\n c", "\n a", "don't 'S we'll", "x<|endoftext|> y", "é ́x", "İstanbul ΣΑΣ, ΟΔΟΣ.", "a\x1c b", "a\0b", "😀 👍🏽, ok", "trail ", "中文 字。"]
    texts += ["".join(rng.choice(" \n\tabC',.éß1$Σ ́") for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    ours = WordTableEncoder(path, table_bytes=10_000)
    assert ours.encode(texts) == ours._library(texts)
    assert [t for _, part in slices(["abc", None, "d" * 10], 4) for t in part] == ["abc", "", "d" * 10]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in ([], [0], [7], [0, 0, 0], np.sort(rng.integers(0, 10**12, 3000)), np.arange(1000), np.zeros(600), [0, 2**62]):
        v = np.asarray(values, dtype=np.uint64)
        code = token_shards.EliasFano.from_buffer(memoryview(token_shards.EliasFano.of(v).to_bytes()))
        assert (code.select_many(np.arange(len(v))) == v).all()
        assert [code.select(k) for k in range(len(v))] == v.tolist()
    dense = np.sort(rng.integers(0, 4_000_000, 10_000))
    assert len(token_shards.EliasFano.of(dense).to_bytes()) * 8 < 11.5 * 10_000


def test_elias_fano_of_sparse_ids():
    """Random 64-bit ids in shards of 2 to 200 documents: each comes back by select and by select_many."""
    rng = np.random.default_rng(4)
    for n in [*range(2, 12), 50, 127, 128, 129, 200]:
        for _ in range(20):
            ids = np.sort(rng.integers(-(2**63), 2**63, n))
            shard = token_shards.Shard(token_shards.shard_bytes(ids.tolist(), [1] * n, [b"\1\0"] * n, 2))
            assert shard.doc_ids == ids.tolist()
            code = token_shards.EliasFano.of((ids - ids[0]).view(np.uint64))
            assert [code.select(k) for k in range(n)] == [int(d) - int(ids[0]) for d in ids]
    shard = token_shards.Shard(token_shards.shard_bytes([-5, 6917529027641081850], [1, 1], [b"\1\0"] * 2, 2))
    assert shard.doc_ids == [-5, 6917529027641081850]


def test_paths_are_the_default_file_system(spark, tmp_path):
    assert token_shards.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    with pytest.raises(Exception):
        token_shards.qualified(spark, "nosuch://x/y")


def op1_expected(rows):
    t = Tokenizer.from_file(WORD)
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_shards_of_documents(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op1_token_shards(spark, f"{DATA}/sf0.001").orderBy("start").collect()
    assert [tuple(r) for r in got] == op1_expected(rows)


def test_token_shards_of_odd_documents(spark, odd_documents, no_documents):
    out = fresh_path(spark, "t")
    got = token_shards.read_token_shards(out, token_shards.write_token_shards(odd_documents, out, WORD, 1, shard_ids=300)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd_documents.collect()), key=lambda d: (d is not None, d))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((n, c) for _, _, n, c in op1_expected([(r.doc_id, r.text) for r in odd_documents.collect()]))
    empty = fresh_path(spark, "t")
    assert token_shards.read_token_shards(empty, token_shards.write_token_shards(no_documents, empty, WORD, 1)).count() == 0


def test_shard_document_lookup():
    raw = token_shards.shard_bytes([None, 3, 9], [2, 1, 3], [np.array(x, "<u2").tobytes() for x in ([5, 1], [1], [7, 8, 1])], 2)
    shard = token_shards.Shard(raw)
    assert shard.doc_ids == [None, 3, 9]
    assert [shard.document(k).tolist() for k in range(3)] == [[5, 1], [1], [7, 8, 1]]


def check_packing(docs, got, capacity):
    t = Tokenizer.from_file(BYTE)
    pieces = []
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        pieces += [(doc_id, p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(pieces, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(b[-1]) <= capacity
    return len(bins), -(-sum(p[3] for p in pieces) // capacity)


def test_packing_of_documents(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    used, least = check_packing(rows, queries.op4_best_fit_packing(spark, f"{DATA}/sf0.001").collect(), 2048)
    assert used <= least + 1


def test_packing_of_odd_documents(spark, odd_documents, no_documents):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    packed = packing.pack_documents(odd_documents, BYTE, 0, 64, with_ids=True).select(*columns).cache()
    check_packing([(r.doc_id, r.text) for r in odd_documents.collect()], packed.drop("ids").collect(), 64)
    rows = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in rows) == 4 * packed.selectExpr("sum(length) as n").first().n
    assert packing.pack_documents(no_documents, BYTE).count() == 0


def brute_force_bins(items, capacity):
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity:
                go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best


def test_plan_against_brute_force():
    rng = random.Random(3)
    worse = 0
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = packing.plan_bins({x: items.count(x) for x in items}, 20)
        assert sorted(x for bin_, n in plan for _ in range(n) for x in bin_) == sorted(items)
        assert all(sum(bin_) <= 20 for bin_, _ in plan)
        worse += sum(n for _, n in plan) - brute_force_bins(items, 20)
    assert worse <= 1


def _fewest(items, capacity):
    """By trying all placements."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[at] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[at]
                go(at + 1, bins)
                bins[k] -= items[at]
        go(at + 1, [*bins, items[at]])

    go(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest_bins():
    """Against exhaustion, on lengths of which best-fit decreasing needs more bins now and then."""
    rng, beaten = random.Random(1), 0
    for _ in range(400):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randint(2, capacity * 6 // 10) for _ in range(rng.randint(3, 11))]
        counted = Counter(items)
        plan = packing.plan_bins(dict(counted), capacity)
        assert all(sum(b) <= capacity for b, _ in plan) and Counter(x for b, n in plan for x in b for _ in range(n)) == counted
        lengths = np.array(sorted(counted, reverse=True))
        counts, fewest = np.array([counted[x] for x in lengths.tolist()]), _fewest(items, capacity)
        assert sum(n for _, n in plan) == fewest >= packing.least_bins(lengths, counts, capacity)
        beaten += sum(n for _, n in packing._best_fit(lengths, counts, capacity)) > fewest
    assert beaten


def test_plans_near_the_bound():
    """Lengths that best-fit packs badly: within 0.5 % of the lower bound after a few descents, and never worse than best-fit
    without any."""
    rng = random.Random(1)
    for low, high, n in ((400, 899, 1500), (300, 1099, 1500)):
        counted = Counter(rng.randint(low, high) for _ in range(n))
        lengths = np.array(sorted(counted, reverse=True))
        counts = np.array([counted[x] for x in lengths.tolist()])
        least, fit = packing.least_bins(lengths, counts, 2048), sum(t for _, t in packing._best_fit(lengths, counts, 2048))
        plan = packing.plan_bins(dict(counted), 2048, nodes=200)
        held = Counter()
        for bin_, times in plan:
            assert sum(bin_) <= 2048
            for x in bin_:
                held[x] += times
        assert held == counted and sum(t for _, t in plan) <= 1.005 * least < 1.02 * least < fit
        assert sum(t for _, t in packing.plan_bins(dict(counted), 2048, nodes=50, descents=0)) <= fit


def test_search_without_budgets_is_exact():
    rng = random.Random(8)
    for _ in range(60):
        counted = Counter(rng.randint(3, 12) for _ in range(rng.randint(4, 9)))
        items, best = sorted(counted.elements(), reverse=True), [99]

        def put(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= 20:
                    put(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
            put(k + 1, [*bins, items[k]])

        put(0, [])
        assert sum(t for _, t in packing.plan_bins(dict(counted), 20, nodes=None, descents=0)) == best[0]
        assert sum(t for _, t in packing.plan_bins(dict(counted), 20, nodes=None, descents=None)) == best[0]
