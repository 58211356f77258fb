"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its hashed words, word shapes, and repeats of near words; tf-idf weights of a bounded labelled
sample give a truncated singular value decomposition. The sample's vectors (at most `max_rows`, `dims` floats each) are
broadcast; every document is projected and compared with all of them by exact blocked cosine products, and the
labels of its `neighbours` nearest vote with their similarity.

Defined cases: texts without a term (null, empty) get the sample's share of ones; repeated rows come out once
each; without labels of both kinds every score is that share, or 0.5 with no labels at all.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import batch_texts, narrow, slices

MAX_ROWS = 4000
WORD_BINS, SHAPE_BINS, REPEAT_BINS = 512, 256, 16
DIMS = 48
NEIGHBOURS = 25
STYLE_WEIGHT = 3.0
BLOCK = 512
_SIZE = WORD_BINS + SHAPE_BINS + REPEAT_BINS


def shape(word: str) -> str:
    """The word's kinds of characters without repeats, as X (upper), x, 9, or the sign itself."""
    out = ""
    for c in word:
        kind = ("X" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c
        if not out.endswith(kind):
            out += kind
    return out[:6]


class Terms:
    """Term counts of texts; remembers a bounded number of words."""

    def __init__(self):
        self.bins: dict[str, tuple[int, int]] = {}

    def row(self, text: str) -> np.ndarray:
        words = text.split()
        if len(self.bins) > 300_000:
            self.bins = {}
        counts = np.zeros(_SIZE, np.float32)
        if not words:
            return counts
        tally = Counter(words)
        for word, n in tally.items():
            at = self.bins.get(word)
            if at is None:
                at = zlib.crc32(word.lower().encode()) % WORD_BINS, WORD_BINS + zlib.crc32(shape(word).encode()) % SHAPE_BINS
                if len(word) < 64:
                    self.bins[word] = at
            counts[at[0]] += n
            counts[at[1]] += n
        # how often a word equals one of the few before it, and how few words make up the text
        near = [sum(a == b for a, b in zip(words, words[d:])) / len(words) for d in (1, 2, 3)]
        spare = 1 - len(tally) / len(words)
        base = WORD_BINS + SHAPE_BINS
        for i, share in enumerate((*near, max(0.0, spare - 0.3))):
            counts[base + i] = share * len(words)
        return counts

    def rows(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.row(t) for t in texts]) if texts else np.zeros((0, _SIZE), np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Relative frequencies on a square-root scale, times idf; shapes and repeats count STYLE_WEIGHT times."""
    total = np.maximum(counts[:, :WORD_BINS].sum(axis=1, keepdims=True), 1)
    x = np.sqrt(counts / total) * idf
    x[:, WORD_BINS:] *= STYLE_WEIGHT
    return x


@dataclass
class Model:
    share: float
    idf: np.ndarray | None = None
    axes: np.ndarray | None = None
    vectors: np.ndarray | None = None
    labels: np.ndarray | None = None

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        out = np.full(len(counts), self.share)
        rows = np.flatnonzero(counts.any(axis=1)) if self.vectors is not None else ()
        for start in range(0, len(rows), BLOCK):
            block = rows[start : start + BLOCK]
            near = self.project(counts[block]) @ self.vectors.T
            k = min(neighbours, near.shape[1])
            top = np.argpartition(near, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** 8 + 1e-6
            out[block] = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return out


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS, dims: int = DIMS,
) -> Model:
    """Vectors of at most `max_rows` labelled rows, half of each label where there are enough; hash-ordered."""
    rows = narrow(labels, doc=id_col, label=label_col).filter("label in (0, 1) and doc is not null").groupBy("doc").agg(
        F.max("label").cast("int").alias("label")
    )
    order = (F.xxhash64("doc"), F.col("doc"))
    chosen = [rows.filter(F.col("label") == v).orderBy(*order).limit(max_rows // 2) for v in (0, 1)]
    sample = narrow(docs, doc=id_col, text=text_col).join(F.broadcast(chosen[0].union(chosen[1])), "doc").select("doc", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for part in slices(batch, "text"):
                counts = [r.tobytes() for r in terms.rows(batch_texts(part, "text"))]
                yield pa.record_batch([part.column("doc"), part.column("label"), pa.array(counts, pa.binary())], names=["doc", "label", "counts"])

    # at most max_rows rows of _SIZE floats come to the driver
    found = sorted(sample.mapInArrow(run, "doc long, label int, counts binary").collect())
    marks = np.array([r["label"] for r in found], np.float32)
    if not len(marks):
        return Model(0.5)
    if marks.min() == marks.max():
        return Model(float(marks.mean()))
    counts = np.frombuffer(b"".join(r["counts"] for r in found), np.float32).reshape(len(found), _SIZE)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = weighted(counts, idf)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))  # right singular vectors of x
    axes = vectors[:, ::-1][:, :dims].astype(np.float32)
    model = Model(float(marks.mean()), idf, axes)
    model.vectors, model.labels = model.project(counts), marks
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return scored(narrow(docs, doc=id_col, text=text_col), model, "text", neighbours, f"doc {kind}, text string").select(
        F.col("doc").alias("doc_id"), "score"
    )


def scored(
    docs: DataFrame, model: Model, text_col: str, neighbours: int = NEIGHBOURS, schema: str | None = None, out: str = "score"
) -> DataFrame:
    """The rows with a column `out`, which none of theirs may be named."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for part in slices(batch, text_col):
                votes = shared.value.vote(terms.rows(batch_texts(part, text_col)), neighbours)
                yield part.append_column(out, pa.array(votes, pa.float64()))

    return docs.mapInArrow(run, f"{schema}, `{out}` double")
