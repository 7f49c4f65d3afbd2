r"""Toxicity by a logistic classifier that is regularised with counterfactuals.

Features are the presence of words and of their beginnings of four to six letters, hashed. Training takes a bounded
sample of labelled rows, keeps the features that tell the classes apart best, and minimises the weighted log loss, an
absolute-value penalty that empties weights, and for each sentence with a term for a group of people the squared change
of its score when the term is swapped for another group's. Corpora name few groups, so every INSERT-th sentence without such
a term is learned from once more with one put in, and its counterfactual has another: what a group's name seems to say
by chance is penalised too. A score thus can't rest on which group is mentioned, and neutral mentions are not taken for toxic ones. Scoring is one pass over the texts with the few weights that remain.

Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0; no other column than the text is an input.
Null and empty texts get the score of a text without features. Repeated rows and ids are scored each for itself; rows
with a null doc_id are scored, never learned and not held out. If no labels of both classes are there, every score is
the share of toxic labels (0 without any). An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.shared import tidied

#: Labelled texts that are learned from at most (those of least hash), and features that training keeps where the caller does
#: not say how many (None: all). Both are parameters of learn() and classify().
SAMPLE, FEATURES = 16_000, 4_096
#: Weight of the counterfactual penalty and of the absolute values; steps of the minimiser.
PENALTY, SPARSITY, STEPS = 5.0, 2e-4, 300
#: Of sentences without a term for a group, one in so many is learned from again with a term put in.
INSERT = 4
_TABLE = 300_000
_WORD = re.compile(r"[^\W\d_]+")

# Terms for groups of people, each list in one grammatical form, so that one can stand for another.
IDENTITY_TERMS = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites", "asians", "latinos"),
    ("woman", "man", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee"),
    ("female", "male", "gay", "straight", "lesbian", "bisexual", "transgender", "black", "white", "asian", "jewish", "latino", "disabled", "deaf", "blind"),
)
_NEXT = {word: terms[(k + 1) % len(terms)] for terms in IDENTITY_TERMS for k, word in enumerate(terms)}


def _of_word(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    parts = {f"{word}$", *(word[:n] for n in (4, 5, 6) if len(word) >= n)}
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) & 0x3FFFFFFF for p in parts)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(words: set[str]) -> set[str]:
    """The words with each term for a group replaced by the next in its list."""
    return {_NEXT.get(w, w) for w in words}


def with_term(words: set[str], draw: int) -> set[str] | None:
    """The words of every INSERT-th sentence without a term, by draw, with one of the terms put in."""
    if draw % INSERT or words & _NEXT.keys():
        return None
    terms = sorted(_NEXT)
    return words | {terms[draw // INSERT % len(terms)]}


def features_of(words: set[str]) -> np.ndarray:
    return np.array(sorted({f for w in words for f in _of_word(w)}), dtype=np.int64)


def _flat(rows: list[np.ndarray], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of the feature among the kept) of all kept features."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    values, row = np.concatenate([*rows, np.empty(0, dtype=np.int64)]), np.repeat(np.arange(len(rows)), lengths)
    if not len(kept):
        return row[:0], row[:0]
    place = np.minimum(np.searchsorted(kept, values), len(kept) - 1)
    hit = kept[place] == values
    return row[hit], place[hit]


def train(features: list[np.ndarray], counter: list[np.ndarray], labels: np.ndarray, penalty: float = PENALTY, most: int | None = FEATURES) -> tuple[dict[int, float], float]:
    """Weights by feature and the bias. counter: of each row with its group terms swapped (the same if it has none). Of all
    features the `most` telling ones are kept, None for all of them."""
    n, positive = len(labels), float(labels.sum()) if len(labels) else 0.0
    if not 0 < positive < n:
        share = positive / n if n else 0.0
        return {}, float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    values, row = np.concatenate(features), np.repeat(np.arange(n), [len(f) for f in features])
    names, place = np.unique(values, return_inverse=True)
    of_toxic = np.bincount(place, weights=labels[row], minlength=len(names))
    count = np.bincount(place, minlength=len(names))
    expected = count * positive / n
    surprise = (of_toxic - expected) ** 2 / np.maximum(expected * (1 - positive / n), 1e-9)
    surprise[count < 2] = 0
    terms = np.intersect1d(names, features_of(set(_NEXT)))  # these stay, however little they tell
    kept = np.union1d(names[np.argsort(-surprise, kind="stable")[:most]], terms)
    rows, cols = _flat(features, kept)
    other_rows, other_cols = _flat(counter, kept)
    differs = np.flatnonzero([len(a) != len(b) or (a != b).any() for a, b in zip(features, counter, strict=True)])
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (n - positive))
    w, bias = np.zeros(len(kept)), 0.0
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    rate = 0.1
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows, weights=w[cols], minlength=n)
        pull = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        gradient = np.bincount(cols, weights=pull[rows], minlength=len(kept))
        if len(differs):
            change = np.zeros(n)
            both = z - bias - np.bincount(other_rows, weights=w[other_cols], minlength=n)
            change[differs] = 2 * penalty * both[differs] / len(differs)
            gradient += np.bincount(cols, weights=change[rows], minlength=len(kept)) - np.bincount(other_cols, weights=change[other_rows], minlength=len(kept))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * pull.sum(), 0.999 * vb + 0.001 * pull.sum() ** 2
        a, b = 1 - 0.9**step, 1 - 0.999**step
        scale = rate / (np.sqrt(v / b) + 1e-8)
        w = w - scale * m / a
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale, 20.0) * SPARSITY, 0)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return {int(k): float(x) for k, x in zip(kept, w, strict=True) if x}, float(bias)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY, sample: int = SAMPLE, features: int | None = FEATURES) -> tuple[dict[int, float], float]:
    """Fits the model in one task, whose rows `sample` bounds, and brings its weights, about `features`, to the driver. Equal
    texts of one id and label count once, so that an id with many rows weighs no more than another; the bound holds for
    texts, not for ids."""
    usable = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).select(F.col("doc_id").alias("d"), F.col("toxic").cast("int").alias("y"))
    some = usable.distinct().orderBy(F.xxhash64("d"), "d", "y").limit(sample)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    keys = hashed.select("doc_id", "h").join(F.broadcast(some), F.col("doc_id") == F.col("d")).select("d", "h", "y").distinct()  # `sample` rows of two numbers
    chosen = keys.orderBy(F.xxhash64("d"), "d", "h", "y").limit(sample)
    texts = hashed.join(F.broadcast(chosen.withColumnRenamed("h", "g")), (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("g")))  # `sample` rows of three numbers
    texts = texts.groupBy("d", "h", "y").agg(F.min("text").alias("text")).select("text", "y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts, labels = batch.column(0).slice(at, 500).to_pylist(), batch.column(1).slice(at, 500).to_pylist()
                words = [words_of(t) for t in texts]
                more = [(with_term(x, zlib.crc32((t or "").encode("utf-8", "surrogatepass"))), y) for x, t, y in zip(words, texts, labels, strict=True)]
                words, labels = words + [x for x, _ in more if x], labels + [y for x, y in more if x]
                columns = [[features_of(x) for x in words], [features_of(swapped(x)) if x & _NEXT.keys() else None for x in words]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.list_(pa.int64())) for c in columns), pa.array(labels, pa.int32())], names=["f", "g", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, g, y = [], [], []
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                f.append(a.values.to_numpy())
                g.append(b.values.to_numpy() if b.is_valid else f[-1])
            y += batch.column(2).to_pylist()
        weights, bias = train(f, g, np.array(y, dtype=np.float64), penalty, features)
        yield pa.RecordBatch.from_pydict({"k": [-1, *weights], "w": [bias, *weights.values()]}, schema=pa.schema([("k", pa.int64()), ("w", pa.float64())]))

    found = texts.mapInArrow(tidied(extract), "f array<long>, g array<long>, y int").repartition(1).sortWithinPartitions("y", "f", "g").mapInArrow(tidied(fit), "k long, w double").collect()
    weights = {r["k"]: r["w"] for r in found}
    return weights, weights.pop(-1, train([], [], np.empty(0))[1])  # no rows, no fit


def score(docs: DataFrame, model: tuple[dict[int, float], float]) -> DataFrame:
    """doc_id and score, a row for each document."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                total, features = bias, set()
                for word in words_of(text.as_py()):
                    own = table.get(word)
                    if own is None:
                        if len(table) >= _TABLE:
                            table.clear()
                        table[word] = own = tuple(f for f in _of_word(word) if f in weights)
                    if own:
                        features.update(own)
                total += sum(weights[f] for f in sorted(features))
                out.append(1 / (1 + np.exp(-min(max(total, -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY, sample: int = SAMPLE, features: int | None = FEATURES) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    scored = score(docs, learn(docs, labels, penalty, sample, features))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
