r"""Spelling variants: words one edit apart, found over an index of variable-length grams, and the form each stands for.

Gram dictionary: all grams of 2 to 5 letters of the vocabulary are counted, and those are kept that occur more often than
a bound (at least 16, at least one in 200,000 of all occurrences, so fewer than 200,000 grams are kept at any size). A
gram that is not kept is rare enough and need not grow.

Decomposition: from its first letter on a word is cut into grams that grow letter by letter until they are rare or have the
cap's length, each beginning where the last one ended (forward); and in the same way from its last letter back (backward).
What the word's end cuts short while still frequent is left out. So a forward gram depends on the letters up to its end
only, a backward one on those from its beginning. Forward grams carry their distance from the word's start, backward ones
from its end.

Affected grams: an edit at a place leaves all forward grams before it and all backward grams after it as they are. The
least number left over all places is what a word shares with each neighbour; what it has beyond that is the most that an
edit can affect. With a cap of half a word's length its first forward and its last backward gram never overlap, so at
least one is always left. Two neighbours' lengths differ by one at most, so words meet in classes of one cap: a word of
length L belongs to those of L // 2 and (L - 1) // 2.

Merging: of each word only the rarest grams are listed, one more than an edit can affect: lists of neighbours then have at
least one gram in common. Lists of up to 64 words are merged pair by pair and verified by edit distance. In longer
lists a second gram is asked for: neighbours that meet by a gram agree in all letters from the word's end up to it, and the
rest holds the edit, so of the rest's two halves one is the same in both; each word is listed again with either half, and
once more where lists are still too long, until nothing is left to halve. What is too long then differs in three letters
at most and is verified by hash: its words are neighbours just if they become equal by leaving out one of those letters,
at the same place of both or from the longer one, and those groups are no larger than the alphabet. So work stays
in proportion to lists of any length, and nothing is capped.

Forms: a word's form is its most frequent neighbour, if that is `ratio` times as frequent, and its root what the
forms end in; pointers double each round.

Words are maximal runs of `[A-Za-zÀ-ÿ]`, only A-Z lowered. Null and empty texts have none. Rows of documents
are texts on their own, whether or not they share an id; a null id counts as an empty one. Ties go to the smaller word in
code-point order. An empty table gives no rows; other columns are ignored. Texts are read whole, long ones word by word.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.shared import discard, release, stash, tidied

_WORD = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Shortest gram, and lengths of grams that are counted and may grow; the longest gram has one letter more.
SHORTEST, GROWING = 2, (2, 3, 4, 5)
#: Grams are kept that occur more often than the first, and than all occurrences over the second.
RARE, DICTIONARY = 16, 200_000
#: Words of a list that are compared pair by pair.
PAIRWISE = 64
#: Words counted in a task before the counts go out, and characters of a text whose words are held at once.
_HELD, _LONG = 400_000, 4_000_000


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least `least_length` letters with at least `least_count` occurrences. With drop_every, the
    occurrences whose h = crc32("id:word") it divides lose their letter h % length first: known misspellings, the
    same in every run."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").translate(_LOWER)
                own = Counter(_WORD.findall(text) if len(text) < _LONG else (m.group() for m in _WORD.finditer(text)))
                if drop_every:
                    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word in list(own):
                        h = zlib.crc32(word.encode(), before)
                        if not h % drop_every:
                            n, at = own.pop(word), h % len(word)
                            own_word = word[:at] + word[at + 1 :]
                            if len(own_word) >= least_length:
                                held[own_word] += n
                for word, n in own.items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= _HELD:
                    yield out()
        if held:
            yield out()

    each = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(tidied(count), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Grams that are frequent enough to grow, with their occurrences: fewer than DICTIONARY at any size, since each has
    more than one in DICTIONARY of all occurrences."""
    spans = [F.transform(F.sequence(F.lit(1), F.length("word") - q + 1), lambda i, q=q: F.substring(F.col("word"), i, F.lit(q))) for q in GROWING]
    grams = stash(words.select(F.explode(F.concat(*spans)).alias("g")).groupBy("g").agg(F.count("*").alias("n")), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    kept = dict(grams.where(F.col("n") > max(RARE, total // DICTIONARY)).toPandas().itertuples(index=False, name=None))
    discard(grams)
    return kept


def decompose(word: str, cap: int, frequent: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(side, distance from that side, first, end) of a word's grams."""
    found, n = [], len(word)
    first = 0
    for end in range(SHORTEST, n + 1):
        if end - first == cap or (end - first >= SHORTEST and word[first:end] not in frequent):
            found.append(("f", first, first, end))
            first = end
    end = n
    for first in range(n - SHORTEST, -1, -1):
        if end - first == cap or (end - first >= SHORTEST and word[first:end] not in frequent):
            found.append(("b", n - end, first, end))
            end = first
    return found


def most_affected(grams: list[tuple[str, int, int, int]], length: int) -> int:
    """The most grams that one edit can affect: all but forward ones before its place and backward ones after it."""
    before, after = [0] * (length + 1), [0] * (length + 1)
    for side, _, first, end in grams:
        if side == "f":
            before[end] += 1
        elif first:
            after[first - 1] += 1
    for i in range(length):
        before[i + 1] += before[i]
        after[length - i - 1] += after[length - i]
    return len(grams) - min(before[i] + after[i] for i in range(length))


def listed(word: str, cap: int, frequent: dict[str, int]) -> list[tuple[int, str, int, int]]:
    """(key, side, first, end) of the grams under which a word is listed: its rarest, one more than an edit can affect."""
    grams = decompose(word, cap, frequent)
    keyed = []
    for side, distance, first, end in grams:
        gram = word[first:end]
        key = xxhash.xxh3_64_intdigest(f"{cap} {side} {distance} {gram}") - (1 << 63)
        keyed.append((frequent.get(gram, 0), key, side, first, end))
    return [k[1:] for k in sorted(keyed)[: most_affected(grams, len(word)) + 1]]


def _postings(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """key, word, n, cap, head, tail: a row for each listed gram. Neighbours that it leaves alike agree in their first `head` and last
    `tail` letters: those up to the gram's far end."""
    held = words.sparkSession.sparkContext.broadcast(frequent)
    longest = GROWING[-1] + 1
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("cap", pa.int32()), ("head", pa.int32()), ("tail", pa.int32())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows: list[tuple] = []
                for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for cap in {min(len(word) // 2, longest), min((len(word) - 1) // 2, longest)}:
                        rows += [(key, word, n, cap, end if side == "f" else 0, 0 if side == "f" else len(word) - first) for key, side, first, end in listed(word, cap, own)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)] or [pa.array([], f.type) for f in schema], schema=schema)

    return words.select("word", "n").mapInArrow(tidied(index), "key long, word string, n long, cap int, head int, tail int")


def _long(rows: DataFrame) -> DataFrame:
    """Keys of lists that are too long for pairs: one in PAIRWISE rows at most."""
    return stash(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > PAIRWISE).select("key"), "long-lists")


def _merged(rows: DataFrame, long: DataFrame) -> DataFrame:
    """word, n, near, near_n: neighbours, the smaller word first, within the lists that are not long."""
    few = rows.join(long, "key", "left_anti")
    own, other = few.select("key", "word", "n"), few.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    return own.join(other, "key").where((F.col("word") < F.col("near")) & near).select("word", "n", "near", "near_n")


def _rest() -> Column:
    """Letters between head and tail in the shortest words of a class, so that both of a pair are cut alike."""
    return 2 * F.col("cap") - F.col("head") - F.col("tail")


def _halved(rows: DataFrame) -> DataFrame:
    """Each row with the first half of its rest added to the head, and with the last half added to the tail."""
    h = F.floor(_rest() / 2).cast("int")
    grown = F.array(F.struct((F.col("head") + h).alias("head"), "tail"), F.struct("head", (F.col("tail") + h).alias("tail")))
    out = rows.select("word", "n", "cap", F.explode(grown).alias("g")).select("word", "n", "cap", "g.head", "g.tail")
    return out.select(F.xxhash64("cap", "head", "tail", F.expr("left(word, head)"), F.expr("right(word, tail)")).alias("key"), *out.columns)


def _left_out(rows: DataFrame) -> DataFrame:
    """word, n, near, near_n: neighbours within lists of any length, by the words less a letter between head and tail."""
    rest = F.expr("concat(left(word, at), substring(word, at + 2))")
    places = F.when(F.length("word") > F.col("head") + F.col("tail"), F.sequence(F.col("head"), F.length("word") - F.col("tail") - 1))
    less = rows.select("key", "word", "n", F.explode(places).alias("at"))
    same = less.select(F.xxhash64("key", "at", rest).alias("h"), "word", "n")
    replaced = same.join(same.select("h", F.col("word").alias("near"), F.col("n").alias("near_n")), "h").where("word < near")
    longer = less.select(F.xxhash64("key", rest).alias("h"), "word", "n")
    put_in = longer.join(rows.select(F.xxhash64("key", "word").alias("h"), F.col("word").alias("near"), F.col("n").alias("near_n")), "h")
    return replaced.unionByName(put_in).where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words that differ by one letter put in, left out or replaced, each both ways."""
    rows, found = stash(_postings(words, gram_dictionary(words)), "postings"), []
    while not rows.isEmpty():
        long = _long(rows)
        found.append(stash(_merged(rows, long), "found-pairs"))
        many = rows.join(long, "key", "left_semi")
        last = many.where(_rest() < 2)
        if not last.isEmpty():
            found.append(stash(_left_out(last), "found-pairs"))
        following = stash(_halved(many.where(_rest() >= 2)), "second-postings")
        discard(rows, long)
        release(words.sparkSession)
        rows = following
    discard(rows)
    pairs = functools.reduce(DataFrame.unionByName, found) if found else words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    backwards = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    out = stash(pairs.unionByName(backwards).distinct(), "near-pairs")
    discard(*found)
    release(words.sparkSession)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: where the forms end. Forms are ever more frequent, so there are no circles."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = stash(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = following
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of words (word, n); words must be distinct and have at least 4
    letters, so that half of one holds a gram."""
    words = stash(words.select("word", "n"), "words")
    if not words.where(F.length("word") < 2 * SHORTEST).isEmpty():
        raise ValueError(f"words of fewer than {2 * SHORTEST} letters")
    pairs = near_pairs(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    stands = F.col("form_n") >= ratio * F.col("n")
    formed = stash(
        joined.select("word", F.when(stands, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, F.col("form_n")).alias("form_n")),
        "forms",
    )
    discard(pairs, words)
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
