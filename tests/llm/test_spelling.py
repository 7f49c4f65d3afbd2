import random
import re
import zlib
from collections import Counter

import pytest
from tests.conftest import DATA

from slidegrid.llm import queries, spelling


def counted(docs, drop_every=31, least_length=7):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if drop_every and h % drop_every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least_length:
                n[word] += 1
    return {w: c for w, c in n.items() if c >= 2}


def neighbours(words):
    """Sets of words one edit apart: by looking up every possible edit of short alphabets, or each word less a letter."""
    less = {}
    for w in words:
        for i in range(len(w)):
            less.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in words}
    for (_, rest), group in less.items():
        for w in group:
            near[w].update(g for g in group if g != w)
            if rest in near:
                near[w].add(rest)
                near[rest].add(w)
    return near


def expected(n, ratio=10):
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def edits(rng, word, letters):
    at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    if kind == 0 or at == len(word):
        return word[:at] + rng.choice(letters) + word[at:]
    return word[:at] + (rng.choice(letters) if kind == 1 else "") + word[at + 1 :]


def test_an_edit_leaves_the_other_grams_and_listed_ones_meet():
    """Of any two words one edit apart, in the class that both are in: at most as many of a word's grams are lost as the
    bound says, and they are listed under a common key."""
    rng = random.Random(1)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(5, 16))) for _ in range(400)]
    frequent = Counter(w[i : i + q] for w in base for q in spelling.GROWING for i in range(len(w) - q + 1))
    frequent = {g: k for g, k in frequent.items() if k > 12}
    assert {len(g) for g in frequent} >= {2, 3, 4}
    for _ in range(6000):
        s = rng.choice(base)
        t = edits(rng, s, "abcdé")
        if s == t or len(t) < 4:
            continue
        caps = [{len(w) // 2, (len(w) - 1) // 2} for w in (s, t)]
        cap = max(caps[0] & caps[1])
        grams = [{(side, d, w[a:b]) for side, d, a, b in spelling.decompose(w, cap, frequent)} for w in (s, t)]
        for w, own in zip((s, t), grams):
            bound = spelling.most_affected(spelling.decompose(w, cap, frequent), len(w))
            assert len(grams[0] & grams[1]) >= len(own) - bound > 0
        assert {k[0] for k in spelling.listed(s, cap, frequent)} & {k[0] for k in spelling.listed(t, cap, frequent)}


def test_against_brute_force(spark, monkeypatch):
    """Words of few letters around common stems, so that lists are long: merged pair by pair, by a second gram, by hash, and
    mixed."""
    rng = random.Random(2)
    stems = ["international", "abcdefg", "aaaaaaaa", "ananananan", "éèêëàâä", "zzzzzzz"]
    words = set(stems)
    for _ in range(1500):
        word = rng.choice(stems)
        for _ in range(rng.randint(1, 4)):
            word = edits(rng, word, "abinzé÷")
        if len(word) >= 7:
            words.add(word)
    n = {w: rng.choice((2, 3, 25, 400, 6000)) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    want = expected(n)
    assert sum(r[4] for r in want) > 2000 and any(r[1] and r[2] != r[1] for r in want)
    for pairwise, rare in ((64, 16), (0, 2), (6, 2), (10**9, 5)):
        monkeypatch.setattr(spelling, "PAIRWISE", pairwise)
        monkeypatch.setattr(spelling, "RARE", rare)
        assert rows_of(spelling.spelling_variants(df)) == want


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.op12_spelling_variants(spark, f"{DATA}/sf0.01")) == expected(counted(docs))


def test_odd_documents(spark, odd_documents, no_documents, monkeypatch):
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    docs += [(20, "Colour COLOUR colours Ünüsüell ünüsüell ÜNÜSÜELL ×÷×÷×÷× ×÷×÷×÷×"), (None, "colours xcolour xcolour")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", spelling.F.lit("x")).withColumn("n", spelling.F.lit(1))
    for long in (4_000_000, 10):
        monkeypatch.setattr(spelling, "_LONG", long)
        monkeypatch.setattr(spelling, "_HELD", 5)
        for every in (31, 2, 0):
            want = counted(docs, every)
            words = spelling.count_words(df, drop_every=every)
            assert {r.word: r.n for r in words.collect()} == want
    assert "xcolour" in want and rows_of(spelling.spelling_variants(words)) == expected(want)
    assert spelling.spelling_variants(spelling.count_words(no_documents)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([("abc", 2)], "word string, n long"))
