"""Benchmark passages in documents: q-gram lemma filter, then banded alignment.

An occurrence of a passage of length m with at most k edits shares at least m + 1 - q - k*q of its character q-grams
with the passage, on diagonals (text position minus passage position) at most k apart. Shared q-grams are counted
in overlapping bands of diagonals; bands that reach the bound are aligned by banded edit distance, and stay
if the distance is at most k.

Both sides are compared in lower case with every run of white space as one space. Passages are broadcast;
a benchmark above MAX_BENCHMARK_CHARS is refused.

Defined cases: null or empty texts hold nothing; null or empty passages, and passages too short for the bound to say
anything, are matched exactly if at least q long, else not at all; repeated passages are reported under each of their
ids; repeated documents come out once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import narrow, slices

Q = 8
ERROR_RATE = 0.08  # edits per passage character
MAX_BENCHMARK_CHARS = 50_000_000
_A = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = {w: np.uint64(pow(int(_A), w, 1 << 64)) for w in (1, 2, 4)}
_BITS = 22


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(code: np.ndarray) -> np.ndarray:
    """Hashes of all runs of eight characters, by doubling the width three times."""
    h = (code.astype(np.uint64) + np.uint64(1)) * _A
    h ^= h >> np.uint64(29)
    for width in (1, 2, 4):
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * _FACTORS[width] + h[width:]
    return (h ^ (h >> np.uint64(31))) * _A


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


class Passages:
    """Sorted q-grams of all passages with passage and position, and a bitmap in front of them."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = ERROR_RATE):
        texts: dict[str, list[int]] = {}
        for item, text in rows:
            if len(t := plain(text)) >= Q:
                texts.setdefault(t, []).append(item)
        self.texts, self.items = list(texts), list(texts.values())
        self.codes = [codes(t) for t in self.texts]
        grams = [qgrams(c) for c in self.codes]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.size, self.edits = size, np.floor(rate * size).astype(np.int64)
        # fewer edits where the bound would be empty
        self.edits = np.maximum(0, np.minimum(self.edits, (size - Q) // Q))
        self.least = size + 1 - Q - self.edits * Q
        self.band = self.edits + 1
        all_grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(all_grams, kind="stable")
        self.grams, self.owner, self.place = all_grams[order], owner[order], place[order]
        self.present = np.zeros(1 << _BITS, bool)
        self.present[slot(self.grams)] = True

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text positions, passages and passage positions of all shared q-grams."""
        grams = qgrams(code)
        at = np.flatnonzero(self.present[slot(grams)])
        left = np.searchsorted(self.grams, grams[at], "left")
        many = np.searchsorted(self.grams, grams[at], "right") - left
        at, left, many = at[many > 0], left[many > 0], many[many > 0]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(left, many) + step
        return np.repeat(at, many), self.owner[entry], self.place[entry]

    def bands(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and the diagonals at which a band of width 2 * edits + 2 begins that reaches the bound."""
        at, owner, place = self.hits(code)
        width, diagonal = self.band[owner], at - place + int(self.size.max(initial=0))
        # bands of two half-bands overlap by one half, so any `edits` + 1 diagonals lie in one of them
        key = np.concatenate([owner << 44 | diagonal // width, owner << 44 | (diagonal // width - 1)])
        key, count = np.unique(key, return_counts=True)
        who = key >> 44
        good = count >= self.least[who]
        return who[good], (key[good] & ((1 << 44) - 1)) * self.band[who[good]] - int(self.size.max(initial=0))

    def matches(self, code: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, passage, start, end, distance) of the best alignment in each region that reaches the bound.

        `begins` and `ends` bound the texts in `code`; a region that touches several is aligned in each by itself.
        """
        found: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for who, first in zip(*(x.tolist() for x in self.bands(code))):
            edits, size = int(self.edits[who]), int(self.size[who])
            lo, hi = first - edits, first + 2 * int(self.band[who]) + size + edits
            for text in range(int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(begins, hi, "left"))):
                left, right = max(lo, int(begins[text])), min(hi, int(ends[text]))
                best = align(self.codes[who], code[left:right], edits) if right - left >= size - edits else None
                if best is not None:
                    found.setdefault((who, left + best[1]), (text, who, left + best[0], left + best[1], best[2]))
        return sorted(found.values())


def align(passage: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the region's part nearest to the passage, or None beyond `edits`.

    One numpy step per passage character over all starting offsets of the region, which is only a few
    edits longer than the passage; insertions run along a row as a running minimum.
    """
    n, m = len(region), len(passage)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    offsets = np.arange(n + 1)
    for i in range(m):
        take = row[:-1] + (region != passage[i])
        skip = row + 1
        new, begun = skip.copy(), start.copy()
        better = take <= skip[1:]
        new[1:][better], begun[1:][better] = take[better], start[:-1][better]
        # leaving text characters out: value at j is the least of new[j'] + (j - j') for j' <= j
        lowered = new - offsets
        reach = np.minimum.accumulate(lowered)
        source = np.maximum.accumulate(np.where(lowered == reach, offsets, 0))
        row, start = reach + offsets, begun[source]
        if row.min() > edits:
            return None
    end = int(np.argmin(row))
    return (int(start[end]), end, int(row[end])) if row[end] <= edits else None


def passages_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", rate: float = ERROR_RATE) -> Passages:
    """Read the benchmark to the driver, after a check of its size."""
    rows = narrow(benchmark, item=item_col, text=text_col).filter("item is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > MAX_BENCHMARK_CHARS:
        raise ValueError(f"the benchmark has {chars} characters; {MAX_BENCHMARK_CHARS} are the most")
    return Passages([(r["item"], r["text"]) for r in rows.collect()], rate)


def _found(batch: pa.RecordBatch, passages: Passages, text_col: str) -> Iterator[list[tuple[int, int, int, int]]]:
    """Matches of each row; rows are searched together, but each is aligned by itself."""
    texts = [plain(t) for t in batch.column(text_col).to_pylist()]
    if not passages.texts:
        yield from ([] for _ in texts)
        return
    sizes = np.array([len(t) for t in texts])
    code = codes(("\x00" * Q).join(texts))
    begins = np.cumsum(sizes + Q) - sizes - Q
    out: list[list] = [[] for _ in texts]
    for row, who, start, end, distance in passages.matches(code, begins, begins + sizes):
        out[row].append((who, start - int(begins[row]), end - int(begins[row]), distance))
    yield from out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, start, end, distance): every passage found; positions are in the folded text."""
    shared = docs.sparkSession.sparkContext.broadcast(passages_of(benchmark, rate=rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [
                    (doc, item, start, end, distance)
                    for doc, found in zip(part.column("doc").to_pylist(), _found(part, passages, "text"))
                    for who, start, end, distance in found for item in passages.items[who]
                ]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "distance"])

    rows = narrow(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    return rows.mapInArrow(run, "doc_id long, item_id long, start long, end long, distance long")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows that hold no passage, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(passages_of(benchmark, rate=rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array([not found for found in _found(part, shared.value, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
