"""Byte-level BPE: encode whole texts with a given vocabulary file, and decode ids to text.

Words are cut out by the vocabulary's pattern. The words of a slice that are not known yet go into one flat
symbol array, and numpy merge rounds run over all of them at once: every pair's rank is found by binary search
over sorted pair keys, each word merges all places of its lowest-ranked pair, and finished words drop out.

The vocabulary file is read on the driver and broadcast; files larger than MAX_VOCABULARY_BYTES are refused.

Defined cases: null text counts as empty and has no tokens; repeated rows come out once each; a special token's
string in a text is that token; ids outside the vocabulary decode to nothing; bytes that aren't UTF-8 decode to
U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stayline.llm.common import batch_texts, narrow, slices

MAX_VOCABULARY_BYTES = 64_000_000
KNOWN_WORDS = 500_000  # words a task remembers; a memory bound only
LONG_WORD = 256  # longer ones are not remembered

# Code points that are letters or numbers to the regex library but not yet to the vocabulary's own.
LATER = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱"
    r"꭬-꭭\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)


def _pattern(letter: str, number: str) -> regex.Pattern:
    other = rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]" if "--" in letter else r"[^\s\p{L}\p{N}]"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if visible, else 256 and up in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Sorted pair keys with their ranks and results, token bytes, and special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], _byte_letters()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)[order]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"vocabulary files may have {MAX_VOCABULARY_BYTES} bytes at most")
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by merge rounds over all words at once."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        none = len(self.keys)
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            found = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(found, self.ranks[at], none), none)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(word)))
            if (over := least == none).any():
                for h in np.flatnonzero(over):
                    out[word[heads[h]]] = symbols[heads[h] : heads[h] + sizes[h]]
            live = np.repeat(~over, sizes)
            hit = live & (rank == np.repeat(least, sizes))
            # of overlapping places ("aaa") every other one merges, from the left
            places = np.flatnonzero(hit)
            first = np.append(True, np.diff(places) != 1)
            step = np.arange(len(places)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(places) else places
            places = places[step % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self.made[at[places]]
            live[places + 1] = False
            symbols, word = symbols[live], word[live]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids if 0 <= i < len(table)]).decode("utf-8", "replace")


class Encoder:
    """Encodes texts of one task, remembering a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, list[int]] = {}
        self.plain = _pattern(r"\p{L}", r"\p{N}")
        self.later = regex.compile(f"[{LATER}]")
        self.exact = _pattern(rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]")
        self.special = vocabulary.special and regex.compile(
            "(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")"
        )

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            pattern = self.plain
        except UnicodeEncodeError:
            pattern = self.exact if self.later.search(text) else self.plain
        if not any(s in text for s in self.vocabulary.special):
            return pattern.findall(text)
        parts = self.special.split(text)
        return [w for p in parts for w in ([p] if p in self.vocabulary.special else pattern.findall(p))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known, special = self.known, self.vocabulary.special
        new = set().union(*split).difference(known)
        fresh = [w for w in new if w not in special]
        known.update(zip(fresh, map(np.ndarray.tolist, self.vocabulary.encode_words([w.encode() for w in fresh]))))
        known.update((w, [special[w]]) for w in new if w in special)
        coded = [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]
        for w in fresh:
            if len(w) > LONG_WORD:
                del known[w]
        return coded


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = pa.array(encoder.encode(batch_texts(part, "text")), pa.list_(pa.int32()))
                yield pa.record_batch([part.column("doc"), ids], names=["doc", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return narrow(docs, doc=id_col, text=text_col).mapInArrow(run, f"doc {kind}, ids array<int>").withColumnRenamed("doc", "doc_id")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from token ids; null ids give an empty text."""
    shared = _shared(coded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc"), pa.array(texts, pa.string())], names=["doc", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return narrow(coded, doc=id_col, ids=ids_col).mapInArrow(run, f"doc {kind}, text string").withColumnRenamed("doc", "doc_id")


def encode_checked(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, exact) of every row; exact says that the ids decode to the text."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = batch_texts(part, "text")
                coded = encoder.encode(texts)
                same = [shared.value.decode(ids) == text for ids, text in zip(coded, texts)]
                yield pa.record_batch(
                    [
                        part.column("doc"), pa.array(coded, pa.list_(pa.int32())), pa.array(map(len, coded), pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc", "ids", "n_tokens", "exact"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, ids array<int>, n_tokens long, exact boolean"
    return narrow(docs, doc=id_col, text=text_col).mapInArrow(run, schema).withColumnRenamed("doc", "doc_id")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, only digests leave the task."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder, digits = Encoder(vocabulary), [str(i) for i in range(len(vocabulary.bytes))]
        for batch in batches:
            for part in slices(batch, "text"):
                coded = encoder.encode(batch_texts(part, "text"))
                sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
                yield pa.record_batch(
                    [
                        part.column("doc"), pa.array([len(ids) for ids in coded], pa.int64()),
                        pa.array([sha(",".join([digits[i] for i in ids])) for ids in coded], pa.string()),
                        pa.array([sha(vocabulary.decode(ids)) for ids in coded], pa.string()),
                    ],
                    names=["doc", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return narrow(docs, doc=id_col, text=text_col).mapInArrow(run, schema).withColumnRenamed("doc", "doc_id")
