import hashlib
import random

import numpy as np
import pytest
from tests.conftest import DATA

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from slidegrid.llm import bpe, queries  # noqa: E402

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
BLANKS = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def both(text):
        ids = t.encode(text, add_special_tokens=False).ids
        return ids, t.decode(ids, skip_special_tokens=False)

    return both


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_equals_library(path):
    rng = random.Random(1)
    texts = ["", " ", "a  b", "don't 'S we'll'", "x<|endoftext|><|startoftext|> y<|endoftext|", "é ́x", "İstanbul ΣΑΣ, ΟΔΟΣ.", "a\x1c b", "a\0b", "😀 👍🏽, ok", "trail ", "中文 字。"]
    texts += ["a" * n for n in (2, 3, 4, 5, 31, 3000)] + ["!" * 97, "=-" * 300, "</w> a</w>", f"x{BLANKS}y", "ǅ ﬁ ½ ² ́ é ẛ̣"]
    texts += ["".join(rng.choice(" \n\tabC',.éß1$Σ ́aeinrst") for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(5, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x370, 0x3000), rng.randrange(0x1F300, 0x1F650)))) for _ in range(12)) for _ in range(1500)]
    texts += [f"a{b}B{c}c" for b in BLANKS for c in BLANKS]
    ours, expected = bpe.BacktrackingEncoder(path, table_bytes=20_000), library(path)
    for text in texts:
        ids, decoded = expected(text)
        got = ours.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert ours.decode(got) == decoded, text


def test_every_token_is_its_own_encoding():
    """And every pair of neighbours in an encoding fits, no other split of the same two tokens' symbols does."""
    own = bpe.BacktrackingEncoder(WORD).merges
    rng = random.Random(2)
    sound = [t for t in range(len(own.length)) if own.length[t]]
    assert len(sound) > 49_000
    for t in rng.sample([t for t in sound if own.rank[t] >= 0], 2000):
        assert own._fit(own.left[t], own.right[t], own.rank[t]) and not own.fits[own.left[t], own.right[t]]


def test_long_words_take_linear_work(monkeypatch):
    """Letters whose longest tokens seldom fit: pairs are asked for in proportion to the length."""
    own = bpe.BacktrackingEncoder(WORD).merges
    asked = []
    judge = own.fits.__getitem__

    class Count(dict):
        def __missing__(self, pair):
            asked.append(1)
            return judge(pair)

    own.fits = Count()
    rng = random.Random(3)
    word = "".join(rng.choice("aehinst") for _ in range(40_000))
    found = own.encode(word)
    assert sum(own.length[t] for t in found) == len(word) and len(asked) < 10 * len(word)


def digest(rows):
    both = library(WORD)
    out = []
    for doc_id, text in rows:
        ids, decoded = both(text or "")
        sha = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        out.append((doc_id, len(ids), sha, hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_library(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in queries.op11_bpe(spark, f"{DATA}/sf0.01").collect()), key=str) == digest(rows)


def test_odd_documents(spark, odd_documents, no_documents):
    coded = bpe.encode_texts(odd_documents, WORD)
    assert [(c, d) for c, d in coded.dtypes] == [("doc_id", "bigint"), ("ids", "binary")]
    both, expected = bpe.encode_and_decode(odd_documents, WORD).collect(), library(WORD)
    want = sorted(((r.doc_id, *expected(r.text or "")) for r in odd_documents.collect()), key=str)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in both), key=str) == want
    decoded = bpe.decode_ids(coded, WORD)
    assert sorted((str(r.doc_id), r.decoded) for r in decoded.collect()) == sorted((str(r.doc_id), r.decoded) for r in both)
    assert bpe.encode_and_decode(no_documents, WORD).count() == 0
