import random

from pyspark.sql import functions as F

from slidegrid.llm import licenses, quality, toxicity


def expected_measures(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    grams = {}
    for k in range(len(words) - 2):
        grams.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {p + d for places in grams.values() if len(places) > 1 for p in places for d in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality_of_odd_documents(spark, odd_documents, no_documents):
    rng = random.Random(3)
    extra = [(100 + k, "".join(rng.choice(["a ", "b ", "c\n", "## ", "é\t", "\n", "a a a "]) for _ in range(rng.randrange(200))), None, None, None, 0) for k in range(60)]
    docs = odd_documents.union(spark.createDataFrame(extra, odd_documents.schema))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    entries = quality.judge(quality.ledger(docs)).collect()
    measured = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in entries)
    assert measured == sorted((str(d), *expected_measures(t)) for d, t in texts)
    for r in entries:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    carried = quality.kept_rows(docs)
    assert carried.columns == docs.columns and carried.count() == sum(r.kept for r in entries)
    ablation = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(quality.ledger(docs), "v3").collect()}
    for name in quality.POLICIES["v3"]:
        bit, mask = quality.mask((name,)), quality.mask(quality.POLICIES["v3"])
        assert ablation.get(name, (0, 0)) == (sum(1 for r in entries if r.failed & bit), sum(1 for r in entries if r.failed & mask == bit))
    assert quality.judge(quality.ledger(no_documents)).count() == 0


def test_licenses(spark, odd_documents, no_documents):
    s = licenses.SENTENCES
    texts = {
        1: "Text.\n" + s["apache2_line"], 2: "\n".join(s[k] for k in ("mit_title", "mit_grant", "mit_notice", "mit_warranty")), 3: s["mit_grant"] + "\n" + s["mit_warranty"],
        4: "x. " + s["gpl3_line"] + " y.\n" + s["ccbync4_line"], 5: "This has an odd license of its own.", 6: None, 7: "", 8: s["mit_line"].upper() + "\n\n" + s["mit_line"],
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[k].licenses for k in range(1, 9)] == ["Apache-2.0", "MIT", "", "CC-BY-NC-4.0,GPL-3.0-only", "", "", "", "MIT"]
    assert got[2].sentence_ids == "mit_title mit_grant mit_notice mit_warranty" and got[3].n_known == 2 and got[8].n_known == 2
    assert [got[k].n_unknown for k in (1, 5, 6)] == [0, 1, 0]
    assert licenses.scan(odd_documents).count() == odd_documents.count() and licenses.scan(no_documents).count() == 0


def test_wrapped_licenses(spark):
    """Notices wrapped, commented and numbered as files hold them, and sentences that end in a colon in one line."""
    import textwrap

    s = licenses.SENTENCES
    wrap = lambda keys, width=72, lead="": "\n".join("\n".join(lead + x for x in textwrap.wrap(s[k], width)) for k in keys)
    apache, mit, gpl = ("apache2_grant", "apache2_copy", "apache2_basis", "apache2_see"), ("mit_grant", "mit_notice", "mit_warranty"), ("gpl3_program_later", "program_useful", "gpl_see")
    header = "# " + s["apache2_grant"].replace(", Version 2.0 ", ", Version 2.0\n# ").replace("except in", "except\n# in") + "\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n" + wrap(apache[2:], 70, "# ")
    bsd2 = wrap(("bsd_redistribution",)) + "\n\n1. " + wrap(("bsd_source",)) + "\n\n2. " + wrap(("bsd_binary",))
    third = "\n\n3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    texts = {
        1: s["mit_grant"] + " " + s["mit_warranty"], 2: "x\n" + wrap(mit) + "\ny", 3: header, 4: wrap(gpl, 66, " * "), 5: bsd2, 6: bsd2 + third.format("the copyright holder"),
        7: bsd2 + third.format("Example\n   Widgets Inc"), 8: "\n".join(s[k] for k in ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names")), 9: " ".join(s[k] for k in ("bsd_redistribution", "bsd_source", "bsd_binary")),
        10: "It is not released under\nthe MIT License.", 11: "Released under the. MIT License.", 12: wrap(mit, 80).replace("\n", "\r\n"),
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].sentence_ids == "mit_grant mit_warranty" and got[1].n_known == 2
    assert [got[k].licenses for k in range(2, 13)] == ["MIT", "Apache-2.0", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "BSD-3-Clause", "BSD-2-Clause", "", "", "MIT"]
    assert got[3].sentence_ids == " ".join(apache) and [got[k].n_unknown for k in (2, 3, 4)] == [0, 0, 0]


def test_more_licenses(spark):
    """Notices of each family, in comments of several styles; the SQL agrees on all of them and on random mixtures."""
    import textwrap

    import duckdb

    s, rng = licenses.SENTENCES, random.Random(5)
    wrap = lambda keys, width, lead, between: between.join("\n".join(lead + x for x in textwrap.wrap(s[k].replace("v 2.0", "v. 2.0"), width)) for k in keys)
    texts, want = {}, {}
    for n, (name, keys) in enumerate(licenses.RULES):
        lead, between = rng.choice([("// ", "\n//\n"), (" * ", "\n"), ("", "\n\n"), ("# ", "\n"), ("", " ")])
        texts[n], want[n] = "x = 1\n" + wrap(keys, rng.choice([40, 72, 2000]), lead, between) + "\ny", name
    at = len(texts)
    texts |= {
        at: "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
        at + 1: s["bsd_redistribution"] + "\n1. " + s["bsd_source"] + "\n2. " + s["bsd_binary"] + "\n3. " + s["bsd_advertising"] + "\n   This product includes software developed by Example.\n4. " + s["bsd_names"].replace("the copyright holder", "the University"),
        at + 2: "// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", at + 3: "/* SPDX-License-Identifier: GPL-2.0-only */",
        at + 4: "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
        at + 5: "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details.",
        at + 6: "\n".join([s["mit_grant"]] + [s["mit_notice"]] * 3000 + [s["mit_warranty"]]), at + 7: "word " * 200_000 + ".\n" + s["unlicense_free"],
        at + 8: (s["apache2_line"] + "\n") * 3000 + "\u212aelvin \u0130 LICENSE",
    }
    want |= {at: "MPL-2.0", at + 1: "BSD-4-Clause", at + 2: "", at + 3: "GPL-2.0-only", at + 4: "GPL-2.0-or-later", at + 5: "LGPL-2.1-or-later", at + 6: "", at + 7: "Unlicense", at + 8: "Apache-2.0"}
    pool = [*s.values(), "license", "No licence here", "Neither the name of A B\nC nor the names of the contributors", "v.\n2.0", "x:", ":", "!", "?\n", "\u00e9"]
    for n in range(at + 9, at + 250):
        texts[n] = "".join(rng.choice(pool) + rng.choice(["\n", " ", ". ", ": ", ":\n * ", ".", "\r\n", "\n\n"]) for _ in range(rng.randrange(9)))
    texts[at + 250] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in licenses.scan(df.repartition(4)).collect()}
    assert {n: got[n][4] for n in want} == want
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: r for r in con.execute(licenses.SQL).fetchall()} == got


def test_toxicity_held_out(spark):
    from tests.conftest import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    positive, negative = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / (len(positive) * len(negative))
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    print("held-out AUC", auc, "accuracy", right)
    assert auc > 0.97 and right > 0.95


def test_counterfactual_penalty():
    """Where toxic texts mention one group more, the penalty keeps the group's name out of the score."""
    rng = random.Random(2)
    texts, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        words = {rng.choice(["tree", "house", "river", "stone", "cloud"]) for _ in range(4)}
        if rng.random() < (0.8 if bad else 0.1):
            words.add("muslims")
        if bad and rng.random() < 0.7:
            words.add("idiot")
        texts.append(words)
        labels.append(int(bad))
    import numpy as np

    features, counter = [toxicity.features_of(t) for t in texts], [toxicity.features_of(toxicity.swapped(t)) for t in texts]
    gap = []
    for penalty in (0.0, toxicity.PENALTY):
        weights, _ = toxicity.train(features, counter, np.array(labels, dtype=float), penalty)
        total = lambda words: sum(weights.get(int(f), 0.0) for f in toxicity.features_of(words))  # noqa: B023, E731
        gap.append(abs(total({"muslims"}) - total({"christians"})))
        assert total({"idiot"}) > 1
    assert gap[0] > 1 and gap[1] < gap[0] / 3


def test_penalty_acts_on_the_query(spark):
    """The model that the query fits: swapping groups changes scores less than without the penalty, and scores are the plain
    sum of the weights of a text's features."""
    import math

    from tests.conftest import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    free, held = (toxicity.learn(docs, labels, penalty=p) for p in (0.0, toxicity.PENALTY))
    terms = sorted(toxicity._NEXT)
    total = lambda model, words: sum(model[0].get(int(f), 0.0) for f in toxicity.features_of(words))
    change = lambda model: sum(abs(total(model, {t}) - total(model, toxicity.swapped({t}))) for t in terms) / len(terms)
    assert free != held and change(held) < 0.5 * change(free)
    some = docs.where("doc_id % 25 = 0")
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in toxicity.score(some, held).collect():
        z = held[1] + total(held, toxicity.words_of(texts[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (5, None), (None, 1), (9, 0), (12, 1)], "doc_id long, toxic int")
    got = toxicity.classify(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.classify(odd_documents, labels.where("false")).where("score > 0.001").count() == 0
    assert toxicity.classify(no_documents, labels).count() == 0


def test_fit_is_bounded_by_texts(spark):
    """One labelled id with 100,000 rows weighs as much as its distinct texts, and no more texts than the sample are fitted."""
    rows = [(k, "horrid filthy words" if k % 2 else "gentle kind words") for k in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")
    many = docs.unionByName(spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(rows[2][1]).alias("text")))
    assert toxicity.learn(many, labels) == toxicity.learn(docs, labels)
    varied = docs.unionByName(spark.range(3_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text")))
    weights, _ = toxicity.learn(varied, labels, sample=20)
    assert len(weights) <= 20 * 14
    everything = toxicity.learn(docs, labels, features=None)
    assert everything[0]
