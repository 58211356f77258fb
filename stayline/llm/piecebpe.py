"""SentencePiece BPE: encode whole texts with a given model file, and decode ids to text.

Merges of this kind take any two neighbouring tokens whose joined text is a piece, the best score first and the
leftmost on ties. Such an encoding is determined by its neighbours: a sequence of tokens is the encoding of its text
exactly if every two neighbours are what their joined text is merged to. So each prefix of a text has one last token,
namely the only piece that ends there (an automaton lists them) and is compatible with the last token of the prefix
before it. The table of last tokens is filled from left to right; ids are read from it backwards. The work is linear in
the text, whatever its longest word.

Where every piece has its space marks in front, no token crosses the start of a run of them, so texts are cut there, and between
characters that are neighbours in no piece. The ids of short parts are remembered, up to a bound on memory. Other models get
one table per stretch between such characters.

The model file is read on the driver and broadcast; files larger than MAX_MODEL_BYTES are refused, as are models other
than BPE with byte fallback and the identity normalizer.

Defined cases: null text counts as empty and has no ids but begin and end; repeated rows come out once each; the strings of
control, unknown and byte pieces in a text are ordinary text; characters outside the model become their bytes; when decoding,
bytes that aren't UTF-8 become U+FFFD one by one, ids outside the model and null lists give nothing.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stayline.llm.common import batch_texts, narrow, slices

MAX_MODEL_BYTES = 64_000_000
KNOWN_PARTS = 500_000  # parts a task remembers; a memory bound only
KNOWN_PAIRS = 2_000_000
LONG_PART = 64  # longer ones are not remembered
SPACE = "▁"

# Fixed values of the public model format: field numbers and piece types.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK = 3, 35
NORMALIZER_NAME, CHARACTER_MAP, DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES = 1, 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message: numbers as int, everything else as bytes."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            if key & 7 == 2:
                size, at = _number(data, at)
            else:
                size = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and settings of a model file."""

    def __init__(self, data: bytes):
        self._encoder: PieceEncoder | None = None
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for field, value in _fields(data):
            if field == PIECES:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                rules = dict(_fields(value))
        plain = rules.get(NORMALIZER_NAME, b"identity") == b"identity" and not rules.get(CHARACTER_MAP)
        whole = not rules.get(TRIM_SPACES, 1) and rules.get(ESCAPE_SPACES, 1)
        if trainer.get(MODEL_TYPE) != 2 or not trainer.get(BYTE_FALLBACK) or not plain or not whole:
            raise ValueError("only BPE models with byte fallback, the identity normalizer and untrimmed spaces are read")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.prefix = SPACE if rules.get(DUMMY_PREFIX, 1) else ""
        ids = {(kind, piece): i for i, (kind, piece) in enumerate(zip(self.kinds, self.pieces))}
        self.begin, self.end = ids.get((CONTROL, "<s>")), ids.get((CONTROL, "</s>"))
        self.sizes = [len(piece) for piece in self.pieces]
        self.control = {i for i, kind in enumerate(self.kinds) if kind == CONTROL}
        self.bytes = [ids[BYTE, f"<0x{b:02X}>"] for b in range(256)]
        self.known = {piece: i for (kind, piece), i in ids.items() if kind == NORMAL}
        self.cut = not any(SPACE in piece.lstrip(SPACE) for piece in self.known)
        self.reached = {piece: i for piece, i in self.known.items() if self.merged(piece) == [i]}
        self.together = {piece[i : i + 2] for piece in self.reached for i in range(len(piece) - 1)}
        self.surface = [
            {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(SPACE, " ").encode())
            for kind, piece in zip(self.kinds, self.pieces)
        ]
        for b, i in enumerate(self.bytes):
            self.surface[i] = bytes([b])

    def encoder(self) -> PieceEncoder:
        """The encoder of this process; the tasks it runs share what is remembered."""
        if self._encoder is None:
            self._encoder = PieceEncoder(self)
        return self._encoder

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_encoder": None}

    def merged(self, text: str) -> list[int]:
        """Ids of a short text of known characters by merging pair after pair; -1 is an unknown character."""
        parts, known, scores = list(text), self.known, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                joined = known.get(parts[i] + parts[i + 1])
                if joined is not None and (best is None or scores[joined] > best):
                    best, at = scores[joined], i
            if best is None:
                return [known.get(part, -1) for part in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def decode(self, ids: Iterable[int] | None) -> str:
        ids = [i for i in ids or () if 0 <= i < len(self.pieces)]
        out = list(map(self.surface.__getitem__, ids))
        if self.prefix:
            first = next((k for k, i in enumerate(ids) if self.kinds[i] != CONTROL), None)
            if first is not None and self.pieces[ids[first]].startswith(SPACE):
                out[first] = out[first][1:]
        try:
            if self.control.isdisjoint(ids[1:-1]):  # a control piece ends a run of bytes
                return b"".join(out).decode()
        except UnicodeDecodeError:
            pass
        runs = groupby(zip(ids, out), key=lambda pair: self.kinds[pair[0]] == BYTE)
        return "".join(
            _lenient(b"".join(part for _, part in run)) if raw else b"".join(part for _, part in run).decode()
            for raw, run in runs
        )


def _lenient(data: bytes) -> str:
    """UTF-8 characters of bytes; every byte that belongs to none is one U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Parts(dict):
    """Ids of parts, computed when they are first asked for."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.cut_part(part))
        if len(part) <= LONG_PART:
            if len(self) >= KNOWN_PARTS:
                for old in list(islice(self, KNOWN_PARTS // 2)):  # the oldest half
                    del self[old]
            self[part] = ids
        return ids


class PieceEncoder:
    """Encodes texts with one model; parts and pairs seen before are remembered."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for piece, i in model.reached.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.single = {piece for piece in model.reached if len(piece) == 1}
        self.pairs: dict[int, bool] = {}  # by both ids in one number
        self.parts = _Parts(self)
        joined = set().union(*model.together)
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined)  # no token joins these to others
        between = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if model.cut else f"[^{alone}]+"
        self.cutter = re.compile(f"{between}|[{alone}]" if alone else between)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their joined text is encoded."""
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        pieces = self.model.pieces
        found = self.pairs[left << 32 | right] = self.model.merged(pieces[left] + pieces[right]) == [left, right]
        return found

    def last_tokens(self, text: str) -> list[int]:
        """The prefix table: the last token of the encoding of each prefix of a text of known characters."""
        last, seen = [-1] * len(text), self.pairs.get
        for end, (size, token) in self.automaton.iter(text):
            if last[end] < 0:
                if end + 1 == size:
                    last[end] = token
                else:
                    before = last[end - size]
                    apart = seen(before << 32 | token)
                    if apart or apart is None and self.compatible(before, token):
                        last[end] = token
        return last

    def cut_part(self, part: str) -> list[int]:
        """Ids of a part. No token crosses two characters that are neighbours in no piece, so it is cut there first."""
        together = self.model.together
        cuts = [i for i, pair in enumerate(map(add, part, part[1:]), 1) if pair not in together]
        if not cuts:
            return self.part(part)
        ids: list[int] = []
        for start, end in zip([0, *cuts], [*cuts, len(part)]):
            ids += self.parts[part[start:end]]
        return ids

    def part(self, text: str) -> list[int]:
        """Ids of a text of known characters, or of one unknown character, by one prefix table."""
        if text not in self.single and not self.single.issuperset(text):
            return [self.model.bytes[b] for b in text.encode()]
        last, sizes = self.last_tokens(text), self.model.sizes
        ids, at = [], len(text) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the begin and end ids the model has."""
        marked = self.model.prefix + text.replace(" ", SPACE) if text else ""
        ids = chain.from_iterable(map(self.parts.__getitem__, self.cutter.findall(marked)))
        ends = [[i] if i is not None else [] for i in (self.model.begin, self.model.end)]
        return [*ends[0], *ids, *ends[1]]


def _shared(df: DataFrame, path: str):
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"the model is larger than {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(PieceModel(file.read()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = pa.array(map(encoder.encode, batch_texts(part, "text")), pa.list_(pa.int32()))
                yield pa.record_batch([part.column("doc"), ids], names=["doc", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return narrow(docs, doc=id_col, text=text_col).mapInArrow(run, f"doc {kind}, ids array<int>").withColumnRenamed("doc", "doc_id")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids."""
    shared = _shared(coded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(map(shared.value.decode, batch.column("ids").to_pylist()), pa.string())
            yield pa.record_batch([batch.column("doc"), texts], names=["doc", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return narrow(coded, doc=id_col, ids=ids_col).mapInArrow(run, f"doc {kind}, text string").withColumnRenamed("doc", "doc_id")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, only digests leave the task."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in batches:
            for part in slices(batch, "text"):
                coded = [encoder.encode(text) for text in batch_texts(part, "text")]
                yield pa.record_batch(
                    [
                        part.column("doc"), pa.array(map(len, coded), pa.int64()),
                        pa.array([hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for ids in coded], pa.string()),
                        pa.array([hashlib.sha256(shared.value.decode(ids).encode()).hexdigest() for ids in coded], pa.string()),
                    ],
                    names=["doc", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return narrow(docs, doc=id_col, text=text_col).mapInArrow(run, schema).withColumnRenamed("doc", "doc_id")
