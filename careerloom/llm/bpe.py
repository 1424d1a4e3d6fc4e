"""BPE encoding and decoding with batched numpy merge rounds.

A batch's new words lie in one flat array of symbols. Each round looks every adjacent pair up by binary search in the
sorted pair keys, finds the lowest rank of each word, and merges that pair at all its places in the word at once.
Words, not texts, are merged: the words of a task are looked up in a bounded table of words already done.

Null text counts as empty and gives no tokens; empty texts likewise. Repeated rows give repeated results. Extra columns
are not read. A text of any length is handled whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the word-level vocabulary family that this operator reads: how words are found in a text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words remembered by a task before its tables start anew; bounds memory, never results.
REMEMBERED = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next free one above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, extra = {b: chr(b) for b in prints}, 256
    for b in range(256):
        if b not in shown:
            shown[b] = chr(extra)
            extra += 1
    return [shown[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Merge tables of fixed size, small enough to send to every task."""

    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merged: np.ndarray  # by rank: the id of the merged pair
    first: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte that ends a word
    tokens: list[str]
    special: dict[str, int]
    ids: dict[str, str] = field(default_factory=dict)  # of each word: its ids, joined by one space
    names: dict[str, str] = field(default_factory=dict)  # and its tokens

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        shown = byte_symbols()
        return cls(
            keys[order], order.astype(np.int64), merged, np.array([vocab[c] for c in shown], np.int64),
            np.array([vocab[c + end] for c in shown], np.int64), tokens, special,
        )

    def __getstate__(self):
        return {**self.__dict__, "ids": {}, "names": {}}

    def ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each of the places ``at``; the number of merges where there is none."""
        none = len(self.merged)
        out = np.full(len(at), none)
        inner = np.flatnonzero(at < len(symbols) - 1)
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        keys = (symbols[at[inner]] << 32) | symbols[at[inner] + 1]
        found = np.searchsorted(self.pair_keys, keys)
        found[found == len(self.pair_keys)] = 0
        out[inner] = np.where(self.pair_keys[found] == keys, self.pair_ranks[found], none)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the index of each word's first id (one more at the end)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(lengths)
        symbols = self.first[flat]
        symbols[stops - 1] = self.last[flat[stops - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        none = len(self.merged)
        rank = self.ranks(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(symbols))))
            ready = lowest == none
            if ready.any():  # words without a pair left leave the array
                done_symbols.append(symbols[ready])
                done_words.append(word[ready])
                symbols, word, rank, lowest = symbols[~ready], word[~ready], rank[~ready], lowest[~ready]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == lowest)
            # of overlapping places, as in a run of one symbol, every second one counts, from the left
            nth = np.arange(len(places))
            runs = np.maximum.accumulate(np.where(np.append(True, np.diff(places) > 1), nth, 0))
            places = places[(nth - runs) % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            moved = places - np.arange(len(places))  # one symbol went after each earlier place
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            near = np.concatenate([moved, moved[moved > 0] - 1])
            rank[near] = self.ranks(symbols, word, near)
        if not done_words:
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        words_of = np.concatenate(done_words)
        order = np.argsort(words_of, kind="stable")
        return np.concatenate(done_symbols)[order], np.searchsorted(words_of[order], np.arange(len(words) + 1))

    def recall(self, words: set[str]) -> None:
        """Makes the tables hold all the words, merged; they start anew when they are full."""
        if len(self.ids) > REMEMBERED:
            self.ids, self.names = {}, {}
        self.ids |= {t: str(i) for t, i in self.special.items()}
        self.names |= {t: t for t in self.special}
        new = list(words.difference(self.ids))
        ids, starts = self.merge([w.encode() for w in new])
        numbers, names = list(map(str, ids.tolist())), list(map(self.tokens.__getitem__, ids.tolist()))
        bounds = starts.tolist()
        for w, a, b in zip(new, bounds, bounds[1:]):
            self.ids[w] = " ".join(numbers[a:b])
            self.names[w] = " ".join(names[a:b])


def lowered(text: str) -> str:
    """Composed and in lower case, character by character: a capital sigma has one small form wherever it stands."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split_words(text: str, special: dict[str, int], found=regex.compile(WORDS).findall) -> list[str]:
    """The words of a text in order; special tokens come through as they stand."""
    if not special:
        return found(lowered(text))
    words = []
    for at, piece in enumerate(regex.split("(" + "|".join(map(regex.escape, special)) + ")", text)):
        words += [piece] if at % 2 else found(lowered(piece))
    return words


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """By code point: 0 blank, 1 letter, 2 digit, 3 other; as the pattern sees them."""
    classes = np.full(0x110000, 3, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (0, r"\s")):
        classes[[ord(c) for c in regex.findall(pattern, points)]] = kind
    return classes


def split_plain(texts: list[str]) -> list[list[str]]:
    """``split_words`` for many texts without apostrophes and special tokens: words part where the class changes."""
    low = [lowered(t) for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le"), np.uint32)
    kind = character_classes()[codes]
    begins = (kind != 0) & ((kind == 2) | np.append(True, kind[1:] != kind[:-1]))
    inside = np.flatnonzero(kind)
    spread = np.full(len(inside) + int(begins.sum()), 32, np.uint32)
    spread[np.arange(len(inside)) + np.cumsum(begins[inside])] = codes[inside]
    words = spread[1:].tobytes().decode("utf-32-le").split(" ") if len(inside) else []
    ends = np.cumsum(begins)[np.cumsum([len(t) + 1 for t in low]) - 1].tolist()
    return [words[a:b] for a, b in zip([0, *ends], ends)]


def words_of(texts: list[str | None], special: dict[str, int]) -> list[list[str]]:
    """The words of each text; null has none."""
    odd = {i for i, t in enumerate(texts) if t and ("'" in t or any(s in t for s in special))}
    out = split_plain(["" if t is None or i in odd else t for i, t in enumerate(texts)])
    for i in odd:
        out[i] = split_words(texts[i], special)
    return out


def encode_texts(texts: list[str | None], vocabulary: Vocabulary) -> Iterator[tuple[str, str]]:
    """(ids joined by one space, tokens joined by one space) of each text."""
    for at in range(0, len(texts), 256):
        listed = words_of(texts[at : at + 256], vocabulary.special)
        vocabulary.recall(set().union(*listed))
        ids, names = vocabulary.ids.__getitem__, vocabulary.names.__getitem__
        for words in listed:
            yield " ".join(map(ids, words)), " ".join(map(names, words))


def encoded(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text), and ``ids`` if asked for.

    ``path`` names the vocabulary file; it is read once, on the driver, and its tables go to the tasks.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                counts, ids_sha, text_sha, lists = [], [], [], []
                for ids, text in encode_texts(part.column(1).to_pylist(), vocabulary.value):
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        lists.append(list(map(int, ids.split())))
                columns = [part.column(0).cast(pa.int64()), counts, ids_sha, text_sha, *[lists] * keep_ids]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields]
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of a list of ids: their tokens joined by one space, as a vocabulary without a decoder defines it."""
    return " ".join(vocabulary.tokens[i] for i in ids)
