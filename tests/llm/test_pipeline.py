from collections import Counter

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import test_near_dedup, test_suffix_dedup
from tests.llm.test_tokens import check_packing

from slidegrid.llm import mixing, quality
from slidegrid.llm.shared import stash


def staged(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], ""), "stage"))
    return out


def check(spark, docs, packed_check=True):
    """Each stage against a plain computation on its own input."""
    raw, good, single, trimmed, mixed, packed = staged(spark, docs)
    for df in (good, single, trimmed, mixed):
        assert df.columns == raw.columns
    text = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    kept = {(str(r.doc_id), r.n_words) for r in quality.judge(quality.ledger(raw)).collect() if r.kept}
    words = lambda t: len(mixing._WORD.findall(t or ""))
    assert text(good) == sorted((str(r.doc_id), r.text or "") for r in raw.collect() if (str(r.doc_id), words(r.text)) in kept)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    component = test_near_dedup.brute_force(rows, 5, 80)
    assert text(single) == sorted((str(d), t or "") for d, t in rows if d is None or component[d] == d)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    cut = [(str(d), k.decode("utf-8", "ignore")) for (d, _), (n, _, _, k) in zip(rows, test_suffix_dedup.brute_force([t for _, t in rows], 400)) if k or not n]
    assert text(trimmed) == sorted(cut)
    assert all(r.n_chars == len(r.text) for r in trimmed.collect() + mixed.collect())
    have, took = Counter(), Counter()
    for _, t in text(trimmed):
        have.update(mixing._WORD.findall(t))
    for _, t in text(mixed):
        took.update(mixing._WORD.findall(t))
    assert all(n <= 2 * have[w] for w, n in took.items())
    assert abs(sum(took.values()) - 1.5 * sum(have.values())) <= 0.05 * sum(have.values()) + 64
    if packed_check:
        used, least = check_packing([(r.doc_id, r.text) for r in mixed.collect()], packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect(), 2048)
        assert used <= least + 2


def test_pipeline(spark):
    check(spark, spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))


def test_pipeline_of_odd_documents(spark, odd_documents, no_documents):
    check(spark, odd_documents.where("doc_id is null or doc_id <> 6"))
    assert staged(spark, no_documents)[-1].count() == 0
