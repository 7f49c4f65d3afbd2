"""Token ids of whole texts by the tokenizers library, with ids of repeated words kept in a bounded table.

BPE never merges across the boundary between a non-blank character and a following blank, so a text is cut there, each
distinct cut string is encoded once by the library, and the ids are joined. Strings of letters go to the library's model
directly; all others, and whole texts that hold strings of special tokens or characters that the library and Python
class differently, go through its whole pipeline.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata

import numpy as np

#: Bytes of the word table of a worker process, and what an entry takes beside its word and ids.
TABLE_BYTES, ENTRY_BYTES = 48 << 20, 150
_WHOLE = re.compile("[\0\x1c-\x1f\x85]")
_TWO_BLANKS = re.compile(r"\s\s")
_SPLIT = re.compile(r"(?<!\s) ")
_STOPS = frozenset(",.;:!?")
#: Before a word that follows a single line feed instead of a space.
_LINE = "\0"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, others from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Table(dict):
    """Ids by word; learns a missing word, and drops its newer half when full: the older one has the frequent words."""

    def __init__(self, learn, limit: int):
        super().__init__()
        self.learn, self.limit, self.size = learn, limit, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        own = 2 * len(word) + len(ids) + ENTRY_BYTES
        if own > self.limit // 8:
            return ids
        if self.size + own > self.limit:
            kept = dict(itertools.islice(self.items(), len(self) // 2))
            self.clear()
            self.update(kept)
            self.size = sum(2 * len(w) + len(i) + ENTRY_BYTES for w, i in kept.items())
        self[word] = ids
        self.size += own
        return ids


class WordTableEncoder:
    """encode(texts) gives for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {ord(chr(b)): c for b, c in _byte_letters().items()}
        #: Lower-casing vocabularies with word ends drop blanks; the others put the space before a word into its ids.
        self.drops_blanks = bool(getattr(self.model, "end_of_word_suffix", None))
        self.table = _Table(self._learn, table_bytes)
        self.stops = dict(zip(_STOPS, self._library(list(_STOPS)), strict=True))
        self.line = self._library(["\n"])[0]

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, word: str) -> bytes:
        """Ids of a string between two cuts: a word that ends in a stop is its stem's ids and the stop's."""
        if len(word) > 1 and word[-1] in _STOPS and word[-2].isalpha():
            return self.table[word[:-1]] + self.stops[word[-1]]
        after_line = word[:1] == _LINE
        if after_line and self.drops_blanks:
            return self.table[word[1:]]
        bare = word[1:] if after_line else word
        if bare.isalpha():
            piece = bare
            if self.drops_blanks:
                piece = bare.lower()
                if not piece.isascii() and (not piece.isalpha() or "\u03a3" in bare or not unicodedata.is_normalized("NFC", bare)):
                    return self._library([bare])[0]
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self.letters)
            if not self.drops_blanks and not after_line:
                piece = "\u0120" + piece
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])
        else:
            ids = self._library([bare if after_line else f" {bare}"])[0]
        return self.line + ids if after_line else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        find = self.table.__getitem__
        for text in texts:
            if any(s in text for s in self.special) or _WHOLE.search(text):
                out += self._library([text])
            else:
                if _TWO_BLANKS.search(text):
                    head, *words = _SPLIT.split(text)
                else:
                    head, *words = text.replace("\n", f" {_LINE}").split(" ")
                out.append(b"".join([self._library([head])[0] if head else b"", *map(find, words)]))
        return out


@functools.cache
def encoder(path: str, table_bytes: int = TABLE_BYTES) -> WordTableEncoder:
    """One encoder for each worker process, vocabulary file and size of table."""
    return WordTableEncoder(path, table_bytes)


def slices(texts: list[str | None], most_chars: int = 1_000_000):
    """(first, texts) pieces of a list, each of a bounded number of characters or of one text; None becomes empty."""
    part, first, total = [], 0, 0
    for k, text in enumerate(texts):
        part.append(text or "")
        total += len(part[-1])
        if total >= most_chars:
            yield first, part
            part, first, total = [], k + 1, 0
    if part:
        yield first, part
