import random

import pytest


def random_text(rng: random.Random, words: int, vocabulary: int = 60) -> str:
    return "".join(f"w{rng.randrange(vocabulary)}{rng.choice([' ', ' ', ' ', ', ', chr(10), '. '])}" for _ in range(words))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rng = random.Random(5)
    long_text = random_text(rng, 30_000, 5_000)
    rows = [
        (1, "", "en", "a", 0, 1), (2, None, None, None, None, 1), (3, "word", "en", "a", 4, 2), (4, "a b", "en", "b", 3, 3),
        (5, random_text(rng, 400), "en", "a", 1, 4), (6, random_text(rng, 90), "de", "a", 1, 5), (6, random_text(rng, 80), "de", "c", 1, 5),
        (7, "same text " * 60, "en", "b", 1, 6), (7, "same text " * 60, "en", "b", 1, 6), (8, "same text " * 60, "en", None, 1, 6),
        (None, "no id here", "en", "b", 1, 7), (None, None, "en", "b", 1, 8), (9, long_text, "fr", "a", 1, 9), (10, long_text + " end", "fr", "a", 1, 9),
        (11, "É à \x1c <|endoftext|> x\n\n y", "fr", "a", 1, 9), (12, "aaaa" * 900, "fr", "d", 1, 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int")


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.where("false")
