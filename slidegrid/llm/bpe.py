r"""Byte-pair encoding without running the merges, and decoding from one table of bytes.

A sequence of tokens is the encoding of its text just if each two neighbours are the encoding of theirs. So the encoder
needs no merges: an Aho-Corasick automaton over all tokens finds the longest one at each place of a word, a table says
which pairs of tokens may stand side by side, and where the longest does not fit, the next shorter token at that place is
tried; where none is left, the last token is taken back. A place that failed once fails for good, since only one sequence
leads to it, so each place is given up once at most and the time is linear in the word.

Two tokens fit if no merge would have crossed the border between them. Going back in time, the newer of the two pieces at
the border falls into its halves; a crossing pair that has an earlier merge than the one just undone would have been
merged before. Of equal merges the left one comes first. Tokens that their own merges never reach are left out of the
automaton.

Decoding: the bytes of all tokens stand in one array, with the places where they begin; a sequence of ids is one gather.
Vocabularies without a decoder give their tokens' names, with blanks between, as the tokenizers library does.

Normalisation and the split into words are the library's own, worked out once for each distinct string between blanks
(vocabularies with word ends drop blanks) or each distinct piece (others), and kept in a table of bounded size.

Null texts count as empty and give no ids and an empty text. Rows are neither joined nor ordered: null and repeated ids
stay as they are, an empty table gives no rows, and other columns are ignored. Texts of any length are read whole; the
ids of a text are gathered in stretches.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.encoding import _byte_letters, _Table, slices
from slidegrid.llm.shared import tidied

#: Bytes of a worker's table of encoded words, and entries of its table of pairs.
TABLE_BYTES, PAIRS = 128 << 20, 2_000_000
#: Ids that are decoded in one gather.
_STRETCH = 200_000
#: Word ends are told apart from the same letter inside a word by this distance in code points.
_END = 1 << 12
#: Python's str.split() takes these for blanks, Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: The characters of the White_Space property.
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_STOPS = frozenset(",.;:!?")


class _Pairs(dict):
    """Whether two tokens may stand side by side; forgets all when full."""

    def __init__(self, judge):
        super().__init__()
        self.judge = judge

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        self[pair] = fits = self.judge(*pair)
        return fits


class Merges:
    """Tokens, merges and what follows from them; words are strings of symbols, the last one marked as a word's end
    where the vocabulary knows word ends."""

    def __init__(self, model: dict):
        suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.word_ends = bool(suffix)
        #: Merge that makes a token (-1: a single symbol), and its halves.
        size = max(ids.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        keys: dict[int, str] = {}
        for letter in _byte_letters().values():
            if letter in ids:
                keys[ids[letter]] = letter
            if suffix and letter + suffix in ids:
                keys[ids[letter + suffix]] = chr(ord(letter) + _END)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, token = ids[a], ids[b], ids[a + b]
            if token in keys or left not in keys or right not in keys:
                raise ValueError(f"merge {rank} makes a token again, or one of unknown halves")
            self.pair_rank[left, right] = rank
            self.rank[token], self.left[token], self.right[token] = rank, left, right
            keys[token] = keys[left] + keys[right]
        self.fits = _Pairs(self._fit)
        sound = [t for t in keys if self.rank[t] < 0 or self._fit(self.left[t], self.right[t], self.rank[t])]
        self.automaton = ahocorasick.Automaton()
        place = {keys[t]: t for t in sound}
        self.length, self.shorter = [0] * size, [-1] * size
        for token in sound:
            key = keys[token]
            self.length[token] = len(key)
            self.automaton.add_word(key, (len(key), token))
            self.shorter[token] = next((place[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in place), -1)
        self.automaton.make_automaton()

    def _fit(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge earlier than `before` crosses the border of a and b."""
        rank = self.rank
        while True:
            if self.pair_rank.get((a, b), before) < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            else:
                before, b = rank[b] + 1, self.left[b]

    def encode(self, word: str) -> list[int]:
        """Tokens of a word of symbols."""
        longest = [-1] * len(word)
        for last, (length, token) in self.automaton.iter(word):
            longest[last - length + 1] = token  # ends ascend, so the longest comes last
        length, shorter, fits = self.length, self.shorter, self.fits
        found: list[int] = []
        failed = bytearray(len(word) + 1)
        at, token = 0, longest[0]
        while at < len(word):
            while token >= 0 and (failed[at + length[token]] or (found and not fits[found[-1], token])):
                token = shorter[token]
            if token >= 0:
                found.append(token)
                at += length[token]
                token = longest[at] if at < len(word) else -1
            elif found:
                failed[at] = 1
                last = found.pop()
                at -= length[last]
                token = shorter[last]
            else:
                raise ValueError("a symbol that the vocabulary lacks")
        return found


class Decoder:
    """Bytes of all tokens in one array, and the places where they begin."""

    def __init__(self, spec: dict):
        kind = (spec["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not known")
        self.names = kind is None
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        bytes_of = {c: b for b, c in _byte_letters().items()}
        own = [names.get(i, "") for i in range(max(names) + 1)]
        if self.names:
            parts = [f"{t} ".encode() for t in own]
        else:
            parts = [bytes(map(bytes_of.__getitem__, t)) if all(c in bytes_of for c in t) else t.encode() for t in own]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for at in range(0, len(ids), _STRETCH):
            part = ids[at : at + _STRETCH].astype(np.int64)
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            shift = start - (np.cumsum(size) - size)
            out.append(self.bytes[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes())
        raw = b"".join(out)
        return (raw[:-1] if self.names else raw).decode("utf-8", "replace")


class BacktrackingEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers; decode(ids) the text."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = {"dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"}
        odd = [t for t in spec["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if spec["model"]["type"] != "BPE" or any(spec["model"].get(k) for k in known) or odd:
            raise ValueError(f"{path}: not a plain byte-pair vocabulary")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.merges, self.decoder = Merges(spec["model"]), Decoder(spec)
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self.find_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        #: Whether ASCII letters stay one piece, each its own symbol or the lower-cased one.
        letters = string.ascii_letters
        self.plain = {letters: str, letters.lower(): str.lower}.get(self._normal(letters))
        if len(self.splitter.pre_tokenize_str("abc")) != 1 or len(self.splitter.pre_tokenize_str("abc,")) != 2:
            self.plain = None
        self.table = _Table(self._learn if self.merges.word_ends else self._piece, table_bytes)

    def _normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _pieces(self, text: str) -> list[str]:
        return [p for p, _ in self.splitter.pre_tokenize_str(self._normal(text))]

    def _piece(self, piece: str) -> bytes:
        if self.merges.word_ends:
            piece = piece[:-1] + chr(ord(piece[-1]) + _END)
        return np.array(self.merges.encode(piece), dtype="<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        """Ids of a string between blanks; letters with a stop after them are the letters' ids and the stop's."""
        if self.plain and word.isascii():
            if word.isalpha():
                return self._piece(self.plain(word))
            if word[-1] in _STOPS and word[:-1].isalpha():
                return self.table[word[:-1]] + self._piece(word[-1])
        return b"".join(map(self._piece, self._pieces(word)))

    def _stretch(self, text: str) -> bytes:
        if not self.merges.word_ends:
            return b"".join(map(self.table.__getitem__, self._pieces(text)))
        words = [w for w in _BLANKS.split(text) if w] if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.table.__getitem__, words))

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.find_added.finditer(text):
            out += [self._stretch(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self._stretch(text[at:])]) if at < len(text) else b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.decoder.decode(np.frombuffer(ids, "<u4"))


@functools.cache
def coder(path: str, table_bytes: int = TABLE_BYTES) -> BacktrackingEncoder:
    """One coder for each worker process, vocabulary file and size of table."""
    return BacktrackingEncoder(path, table_bytes)


def _each_text(docs: DataFrame, id_col: str, column: str, schema: str, work) -> DataFrame:
    """work(text or ids) gives the values of the columns after the id, for each row of docs."""
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for first, part in slices(rows.column(1).to_pylist()):
                    columns = [pa.array(list(c)) for c in zip(*map(work, part), strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.column(0).slice(first, len(part)), *columns], names=names)

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(column))
    return kept.mapInArrow(tidied(run), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id and ids, binary: little-endian unsigned 32-bit integers."""
    return _each_text(docs, id_col, text_col, "ids binary", lambda text: (coder(tokenizer_path, table_bytes).encode(text),))


def decode_ids(coded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id and decoded, the text of the ids; null ids count as none."""
    return _each_text(coded, id_col, ids_col, "decoded string", lambda ids: (coder(tokenizer_path, table_bytes).decode(ids or b""),))


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, ids and decoded in one pass over the texts, by one worker process a task."""

    def both(text: str) -> tuple[bytes, str]:
        own = coder(tokenizer_path, table_bytes)
        ids = own.encode(text)
        return ids, own.decode(ids)

    return _each_text(docs, id_col, text_col, "ids binary, decoded string", both)
