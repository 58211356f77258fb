"""Cross-entropy difference scores: bigram models of a target set and of the whole corpus.

Both models share one vocabulary (words seen `min_count` times in the corpus; others are one unknown word), one order
and one smoothing: p(w | h) = (c(h, w) + k p(w)) / (c(h) + k), p(w) = (c(w) + a) / (N + a V). Background counts are
scaled to the target's size, so that smoothing weighs alike. A document's score is the mean of
log p_background - log p_target over its words: below zero is nearer to the target.

Every document is scored by models that have not seen it: its own counts are taken from those of the corpus, and from those of
the target if it belongs to it. Copies of it elsewhere stay in.

Nothing is capped: every word and word pair of all documents is counted. Documents become chunks where they are read: a chunk's
row holds its distinct words and each word's place among them, so texts are neither shuffled nor cut into words again. A chunk
sends its distinct keys, with counts of a byte each and a list of larger ones, in key ranges to the tasks that add them up. It gets
back a bit for each key, and the sums of those keys that other chunks have too. The number of ranges follows
spark.sql.shuffle.partitions, not the number of chunks. A frequent pair travels once per chunk, no group is larger than a
range's share, and only the places of target documents are broadcast, if they are counted to be few.

Defined cases: null or empty text has no words and scores 0; repeated rows are counted and come out each, with a null or repeated
id too; a null id is never a target; without target documents, both models are equal and all scores are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import SLICE_BYTES, batch_texts, mixed, narrow, shuffle_parts, slices, word_hashes, work_table

CHUNK_BYTES = 4_000_000
RANGES_PER_PARTITION = 2
BROADCAST_PLACES = 4_000_000
MIN_COUNT = 2
PRIOR, FLOOR = 8.0, 0.5
_ONE = np.uint64(1)
_LARGE = 255  # counts from here on are listed apart


@dataclass
class Totals:
    """Words, unknown words and vocabulary size; target first."""

    words: tuple[int, int]
    unknown: tuple[int, int]
    vocabulary: int


def packed_tokens(places: np.ndarray) -> bytes:
    """Places in a vocabulary by frequency, byte by byte of each place: the higher bytes are mostly zero."""
    return zlib.compress(places.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_tokens(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, docs, ends, vocabulary, tokens): one row per chunk of (doc, text) rows.

    `vocabulary` has the chunk's distinct word hashes, frequent ones first, `tokens` each word's place there, `ends` where texts end.
    """

    def row(number: int, docs: list, found: list) -> pa.RecordBatch:
        words = np.concatenate([w for w, _ in found]) | _ONE
        sizes = np.concatenate([np.diff(e, prepend=0) for _, e in found])
        vocabulary, tokens, many = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-many, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return pa.record_batch(
            [
                pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([np.cumsum(sizes).astype(np.int64).tobytes()], pa.binary()),
                pa.array([vocabulary[order].tobytes()], pa.binary()), pa.array([packed_tokens(rank[tokens])], pa.binary()),
            ],
            names=["chunk", "docs", "ends", "vocabulary", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs: list = []
        found: list = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text", min(SLICE_BYTES, chunk_bytes)):
                texts = [t.encode() for t in batch_texts(part, "text")]
                docs += part.column("doc").to_pylist()
                found.append(word_hashes(texts))
                held += sum(map(len, texts))
                if held >= chunk_bytes:
                    yield row(number, docs, found)
                    docs, found, held, number = [], [], 0, number + 1
        if docs:
            yield row(number, docs, found)

    return rows.select("doc", "text").mapInArrow(run, "chunk long, docs array<long>, ends binary, vocabulary binary, tokens binary")


class Chunk:
    """A chunk's sorted keys (odd for words, even for pairs), and the place of each word and of the pair that ends with it."""

    def __init__(self, ends: bytes, vocabulary: bytes, tokens: bytes, aims: list[int] | None):
        words, self.ends = np.frombuffer(vocabulary, np.uint64), np.frombuffer(ends, np.int64)
        places = unpacked_tokens(tokens)
        self.sizes = np.diff(self.ends, prepend=0)
        self.owner = np.repeat(np.arange(len(self.ends)), self.sizes)
        self.inner = np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1  # words with a word before them
        local, pair_at = np.unique(places[self.inner - 1] * len(words) + places[self.inner], return_inverse=True)
        first, second = (words[i] for i in np.divmod(local, max(len(words), 1)))
        pairs = mixed(first * np.uint64(0x9E3779B97F4A7C15) + second) & ~_ONE
        keys = np.concatenate([words, pairs])
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.keys, self.word_at, self.pair_at = keys[order], rank[places], rank[len(words) + pair_at]
        self.aim = np.zeros(len(self.ends), bool)
        self.aim[np.array(aims or [], np.int64)] = True

    def counts(self) -> list[np.ndarray]:
        """Counts of the keys in the chunk's target documents, and in all."""
        aim, n = self.aim[self.owner], len(self.keys)
        use = (self.word_at[aim], self.pair_at[aim[self.inner]]), (self.word_at, self.pair_at)
        return [np.bincount(w, minlength=n) + np.bincount(p, minlength=n) for w, p in use]

    def cuts(self, ranges: int) -> np.ndarray:
        """Where the keys of each range start, and where the last ends."""
        starts = np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - (ranges.bit_length() - 1))
        return np.concatenate(([0], np.searchsorted(self.keys, starts), [len(self.keys)]))


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and steps of six bytes each; (place, rest) of the steps that need more stand ahead."""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[:1] = 0
    large = np.flatnonzero(steps >> np.uint64(48))
    rest = np.stack([large.astype(np.uint64), steps[large] >> np.uint64(48)])
    head = np.array([len(large), keys[0] if len(keys) else 0], np.uint64)
    return head.tobytes() + rest.tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    many, first = np.frombuffer(data, np.uint64, 2)
    place, rest = np.frombuffer(data, np.uint64, 2 * int(many), 16).reshape(2, -1)
    body = np.frombuffer(data, np.uint8, offset=16 + 16 * int(many)).reshape(-1, 6)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :6] = body
    steps = steps.view(np.uint64).ravel()
    steps[place.astype(np.int64)] |= rest << np.uint64(48)
    return np.cumsum(steps, dtype=np.uint64) + first


def packed_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """A byte for each count, and (place, count) of those that need more."""
    large = np.flatnonzero(counts >= _LARGE)
    return np.minimum(counts, _LARGE).astype(np.uint8).tobytes(), np.stack([large, counts[large]]).astype(np.int64).tobytes()


def unpacked_counts(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    place, count = np.frombuffer(large, np.int64).reshape(2, -1)
    out[place] = count
    return out


_SENT = ("target", "target_large", "whole", "whole_large")


def chunk_counts(chunks: DataFrame, ranges: int) -> DataFrame:
    """(part, chunk, keys, and counts in target and whole): the distinct keys of each chunk by key range."""
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    names = ["part", "chunk", "keys", *_SENT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["ends"], row["vocabulary"], row["tokens"], row["aims"])
                chosen, whole = chunk.counts()
                cuts, out = chunk.cuts(ranges), []
                for part in range(ranges):
                    cut = slice(cuts[part], cuts[part + 1])
                    if cuts[part] < cuts[part + 1]:
                        out.append((part, row["chunk"], packed_keys(chunk.keys[cut]), *packed_counts(chosen[cut]), *packed_counts(whole[cut])))
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return chunks.mapInArrow(run, "part int, chunk long, keys binary, " + ", ".join(f"{c} binary" for c in _SENT))


def summed_counts(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(part, chunk, differs, and sums in target and whole): for each chunk a bit per key, set where others have the key, and
    those keys' sums, packed as the counts are.

    Chunk -1 has the totals of the range.
    """

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        own = [unpacked_keys(k) for k in rows.column("keys").to_pylist()]
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")  # merges the sorted runs of the chunks
        ordered = every[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        at = np.empty(len(every), np.int64)
        at[order] = np.cumsum(new) - 1
        keys = ordered[new]
        mine = [
            np.concatenate([unpacked_counts(s, o) for s, o in zip(rows.column(c).to_pylist(), rows.column(f"{c}_large").to_pylist())])
            for c in ("target", "whole")
        ]
        sums = [np.bincount(at, m, len(keys)).astype(np.int64) for m in mine]
        word = (keys & _ONE).astype(bool)
        known = word & (sums[1] >= min_count)
        totals = np.array([*(s[word].sum() for s in sums), *(s[word & ~known].sum() for s in sums), known.sum()], np.int64)
        out = [(part, -1, b"", totals.tobytes(), b"", b"", b"")]
        ends = np.cumsum([len(k) for k in own])
        for chunk, start, end in zip(rows.column("chunk").to_pylist(), ends - [len(k) for k in own], ends):
            told = [s[at[start:end]] for s in sums]
            differs = told[1] != mine[1][start:end]  # then no other chunk has the key
            out.append((part, chunk, np.packbits(differs).tobytes(), *[x for t in told for x in packed_counts(t[differs])]))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "chunk", "differs", *_SENT])

    return counts.groupBy("part").applyInArrow(run, "part int, chunk long, differs binary, " + ", ".join(f"{c} binary" for c in _SENT))


def _corpus_counts(chunk: Chunk, told: list[dict], ranges: int) -> list[np.ndarray]:
    """The corpus's counts of the chunk's keys: its own, but for keys that other chunks have."""
    sums = [c.astype(np.float64) for c in chunk.counts()]
    cuts = chunk.cuts(ranges)
    for row in told:
        start, end = cuts[row["part"]], cuts[row["part"] + 1]
        places = start + np.flatnonzero(np.unpackbits(np.frombuffer(row["differs"], np.uint8), count=end - start))
        for total, name in zip(sums, ("target", "whole")):
            total[places] = unpacked_counts(row[name], row[f"{name}_large"])
    return sums


def _own(owner: np.ndarray, at: np.ndarray, keys: int) -> np.ndarray:
    """How often the key of each entry occurs in the document of the entry."""
    _, same, many = np.unique(owner * keys + at, return_inverse=True, return_counts=True)
    return many[same]


def document_losses(chunk: Chunk, sums: list[np.ndarray], totals: Totals, min_count: int) -> list[np.ndarray]:
    """Mean loss per document under the target's model and the background's, without the document itself."""
    n_docs, owner, inner, words = len(chunk.ends), chunk.owner, chunk.inner, chunk.word_at
    own_word = _own(owner, words, len(chunk.keys))
    own_pair = _own(owner[inner], chunk.pair_at, len(chunk.keys))
    known = sums[1][words] >= min_count
    own_unknown = np.bincount(owner, ~known, n_docs)
    usable = known[inner] & known[inner - 1]
    scale = totals.words[0] / totals.words[1] if totals.words[0] else 1.0
    out = []
    for side, weight in ((0, 1.0), (1, scale)):
        if not totals.words[side]:
            out.append(None)
            continue
        taken = chunk.aim if side == 0 else np.ones(n_docs, bool)
        count = (sums[side][words] - taken[owner] * own_word) * weight
        n = (totals.words[side] - taken * chunk.sizes) * weight
        unknown = (totals.unknown[side] - taken * own_unknown) * weight
        p = (np.where(known, count, unknown[owner]) + FLOOR) / (n + FLOOR * (totals.vocabulary + 1))[owner]
        pair = (sums[side][chunk.pair_at] - taken[owner[inner]] * own_pair) * weight
        p[inner] = np.where(usable, (pair + PRIOR * p[inner]) / (count[inner - 1] + PRIOR), p[inner])
        out.append(np.bincount(owner, -np.log(p), n_docs) / np.maximum(chunk.sizes, 1))
    background = out[1] if out[1] is not None else np.zeros(n_docs)
    return [out[0] if out[0] is not None else background, background]


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of every row; `target` holds ids of target documents."""
    rows = narrow(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    chunks = work_table(chunked(rows, chunk_bytes))
    ranges = 1 << max(5, (RANGES_PER_PARTITION * shuffle_parts(docs) - 1).bit_length())
    ids = narrow(target, doc=id_col).select(F.col("doc").cast("long").alias("doc")).filter("doc is not null").distinct()
    listed = chunks.select("chunk", F.posexplode("docs").alias("place", "doc")).filter("doc is not null")
    aims = work_table(listed.join(ids, "doc").groupBy("chunk").agg(F.collect_list("place").alias("aims")))
    few = (aims.agg(F.sum(F.size("aims"))).first()[0] or 0) <= BROADCAST_PLACES  # four bytes each
    aimed = chunks.join(F.broadcast(aims) if few else aims, "chunk", "left")
    sums = work_table(summed_counts(chunk_counts(aimed, ranges), min_count))
    found = [np.frombuffer(r["target"], np.int64) for r in sums.filter("chunk = -1").select("target").collect()]  # one per range
    t = sum(found, np.zeros(5, np.int64)).tolist()
    totals = Totals((t[0], t[1]), (t[2], t[3]), t[4])

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "target_loss", "background_loss", "score"]
        row = own.to_pylist()[0]
        chunk = Chunk(row["ends"], row["vocabulary"], row["tokens"], row["aims"])
        aim, background = document_losses(chunk, _corpus_counts(chunk, told.to_pylist(), ranges), totals, min_count)
        return pa.table(
            [pa.array(row["docs"], pa.int64()), pa.array(chunk.sizes, pa.int64()), pa.array(aim), pa.array(background), pa.array(aim - background)],
            names=names,
        )

    return aimed.groupBy("chunk").cogroup(sums.filter("chunk >= 0").groupBy("chunk")).applyInArrow(
        run, "doc_id long, n_words long, target_loss double, background_loss double, score double"
    )
