"""Periodic runs: stretches of words that repeat with a period, found at every scale, and texts without the repeats.

A run is a maximal stretch x[start : start + length] in which words `period` apart are identical, `period` is the smallest
such number, and length >= max(least, times * period). Its equal pairs x[i] = x[i + period] fill one interval of i, and that is
what is searched, octave by octave: periods in [B, 2B), those below the smallest B with its octave. In a run such an interval
is at least 2B - 1 long, so it holds a whole block [h, h + B) that starts at a boundary, a multiple of B.

1. Screen, in place: equal hashes of the blocks at h and h + q name the boundaries where a period of the octave may be.
2. Each document is exploded into overlapping tiles per octave, which hold the words around their boundaries; tiles
   without such a boundary have nothing to solve and aren't made. Tiles are dealt by document, octave and place, so a long
   document is solved by many tasks.
3. Each tile is solved alone: the Z-functions to the right and to the left of a boundary give, for all periods of the
   octave, how far equality reaches, 2B and B words at most. Periods that a smaller one divides are told from the
   same values and left out. Touching intervals are merged in the tile.
4. Intervals are shuffled by document and period, and touching ones are stitched.

Words are whole words, compared as such; hashes only screen. Words are runs of bytes other than space and 0x09-0x0D.

Defined cases: null text counts as empty, with no words and no runs; repeated rows come out once each, also with null ids; a
text shorter than `least` words has no runs; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import batch_texts, mixed, narrow, shuffle_parts, slices, work_table

LEAST, TIMES = 24, 3
TILE_WORDS = 8192  # boundaries of a tile span this many words, or one block if that is more
BATCH_BYTES = 8_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # bytes are split at space and 0x09-0x0D


def first_places(words: list[bytes]) -> np.ndarray:
    """For each word the place of its first occurrence: equal numbers are equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count()), np.int32, len(words))


def z_function(x: list[int]) -> list[int]:
    """z[i]: how many items from i on equal those from the start; z[0] is the length."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        lo, hi = i, i + k
    return z


def octaves(n: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(block, first period, last period) of each octave that a text of n words can have runs in."""
    block = 1 << (max(1, (least + 2) // 3).bit_length() - 1)
    low = 1
    while n >= least and low <= n // times:
        yield block, low, min(2 * block - 1, n // times)
        block *= 2
        low = block


def screened(ids: np.ndarray, least: int, times: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, boundaries) at which the block equals one a period of the octave later, by hash."""
    n, width = len(ids), 1
    hashes = mixed(ids.astype(np.uint64) + _GOLD)  # of the `width` words from each place on
    for block, low, high in octaves(n, least, times):
        while width < block:
            hashes = mixed(hashes[:-width] * _GOLD + hashes[width:])
            width *= 2
        places = np.arange(0, n - block - low + 1, block)
        if not len(places):
            continue
        after = np.concatenate((hashes, np.zeros(high + 1, np.uint64)))
        view = np.lib.stride_tricks.sliding_window_view(after[low:], high - low + 1)[places]
        hit = (view == hashes[places][:, None]).any(axis=1)
        if hit.any():
            yield block, places[hit]


def reaches(words: list[int], at: int, block: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(period, words to the left, words to the right) around boundary `at` for which equality fills its block."""
    right = z_function(words[at : at + 4 * block])
    last = min(high, len(right) - block)
    found = [q for q in range(low, last + 1) if right[q] >= block]
    if not found:
        return
    back = words[max(0, at - block) : at][::-1]
    left = z_function(back + [-1] + words[max(0, at - block) : at + 2 * block][::-1])
    end = min(len(words), at + 2 * block)
    smaller, shortest = 0, []  # how far a period below q carries the words from the boundary on
    for q in range(1, min(block, high) + 1):
        shortest.append(smaller)
        smaller = max(smaller, right[q] + q if q < len(right) else 0)
    shortest.append(smaller)
    for q in found:
        if shortest[min(block, q - 1)] < q + block:
            yield q, min(left[len(back) + 1 + end - at - q], block) if back else 0, min(right[q], 2 * block)


def merged(intervals: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(period, from, to) with touching intervals of one period put together."""
    out: list[tuple[int, int, int]] = []
    for period, start, end in sorted(intervals):
        if out and out[-1][0] == period and start <= out[-1][2]:
            out[-1] = (period, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((period, start, end))
    return out


def tiled(docs: DataFrame, least: int = LEAST, times: int = TIMES, tile_words: int = TILE_WORDS) -> DataFrame:
    """One row per (doc, text) with its words joined by a space, and the tiles of texts that need any.

    Rows of texts have block 0; `key` names id and text, `found` says that tiles exist.
    """
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("key", pa.string()), ("block", pa.int32()), ("n", pa.int64()), ("found", pa.bool_()), ("text", pa.string()),
            ("first", pa.int64()), ("words", pa.binary()), ("places", pa.list_(pa.int64())),
        ])

        def tiles(key: str, ids: np.ndarray) -> Iterator[tuple]:
            n = len(ids)
            for block, places in screened(ids, least, times):
                stride = max(block, tile_words // block * block)
                cuts = np.flatnonzero(np.diff(places // stride)) + 1
                for own in np.split(places, cuts):
                    start = max(0, int(own[0]) - block)
                    yield key, block, n, None, None, start, ids[start : int(own[-1]) + 4 * block].tobytes(), own.tolist()

        for batch in batches:
            for part in slices(batch, "text"):
                names, rows, held = [], [], 0
                for doc, text in zip(part.column("doc"), batch_texts(part, "text")):
                    words = words_of(text)
                    key = hashlib.blake2b(f"{doc.as_py()}|{text}".encode(), digest_size=16).hexdigest()
                    found = False
                    for tile in tiles(key, first_places(words)) if len(words) >= least else ():
                        found = True
                        names.append(doc), rows.append(tile)
                        held += len(tile[6])
                        if held >= BATCH_BYTES:
                            yield _batch(names, rows, schema)
                            names, rows, held = [], [], 0
                    names.append(doc)
                    rows.append((key, 0, len(words), found, b" ".join(words).decode(), None, None, None))
                yield _batch(names, rows, schema)

    def _batch(names: list, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema]
        ids = pa.array([d.as_py() for d in names], names[0].type) if names else pa.nulls(0)
        return pa.record_batch([ids, *columns], names=["doc", *schema.names])

    return docs.mapInArrow(
        run,
        f"doc {kind}, key string, block int, n long, found boolean, text string, first long, words binary, places array<long>",
    )


def intervals(tiles: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(key, period, lo, hi): words i and i + period are equal for lo <= i < hi, tile by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
        for batch in batches:
            for key, block, n, first, words, places in zip(*(batch.column(c) for c in ("key", "block", "n", "first", "words", "places"))):
                block, n, first = block.as_py(), n.as_py(), first.as_py()
                low, high = next((a, b) for size, a, b in octaves(n, least, times) if size == block)
                ids = np.frombuffer(words.as_py(), np.int32).tolist()
                rows = merged([
                    (q, at - left, at + right)
                    for at in places.as_py() for q, left, right in reaches(ids, at - first, block, low, high)
                ])
                if rows:
                    period, lo, hi = zip(*rows)
                    yield pa.record_batch([[key.as_py()] * len(rows), period, lo, hi], schema=schema)

    return tiles.mapInArrow(run, "key string, period long, lo long, hi long")


def stitched(parts: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(key, start, length, period) of all runs, from the intervals of the tiles."""
    order = Window.partitionBy("key", "period").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("lo") <= F.col("before"), 0).otherwise(1)).over(order)
    whole = (
        parts.distinct().withColumn("before", before).withColumn("group", group)
        .groupBy("key", "period", "group").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    )
    equal = F.col("hi") - F.col("start")
    return whole.filter((equal >= (times - 1) * F.col("period")) & (equal + F.col("period") >= least)).select(
        "key", "start", (equal + F.col("period")).alias("length"), "period"
    )


def without_repeats(rows: DataFrame) -> DataFrame:
    """(doc, n, runs, text) with the text of the words that no run repeats, for rows of (doc, n, text, runs)."""
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch_texts(batch, "text"), batch.column("runs")):
                words = words_of(text)
                edges = np.zeros(len(words) + 1, np.int64)
                for r in runs.as_py():
                    edges[r["start"] + r["period"]] += 1
                    edges[r["start"] + r["length"]] -= 1
                texts.append(b" ".join(compress(words, np.cumsum(edges)[:-1] == 0)).decode())
            yield pa.record_batch(
                [batch.column("doc"), batch.column("n"), batch.column("runs"), pa.array(texts, pa.string())],
                names=["doc", "n", "runs", "text"],
            )

    return rows.select("doc", "n", "runs", "text").mapInArrow(run, f"doc {kind}, n long, runs {RUNS}, text string")


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
    tile_words: int = TILE_WORDS,
) -> DataFrame:
    """(doc_id, n_words, runs, text) of every row: its runs by start, then period, and its words but those that a run
    repeats (all of the run's after its first `period`), joined by one space."""
    if times < 3 or least < 1:
        raise ValueError("runs repeat at least three times and have at least one word")
    made = work_table(tiled(narrow(docs, doc=id_col, text=text_col), least, times, tile_words))
    tiles = made.filter("block > 0").select("key", "block", "n", "first", "words", "places")
    dealt = tiles.repartition(shuffle_parts(docs), "key", "block", "first")
    runs = stitched(intervals(dealt, least, times), least, times)
    each = runs.groupBy("key").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("start", "period", "length"))),
            lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")),
        ).alias("runs")
    )
    texts = made.filter("block = 0")
    none = F.array().cast(RUNS)
    plain = texts.filter("not found").select("doc", "n", none.alias("runs"), "text")
    joined = texts.filter("found").select("doc", "key", "n", "text").join(each, "key", "left")
    edited = without_repeats(joined.withColumn("runs", F.coalesce("runs", none)))
    return plain.union(edited).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_words"), "runs", "text")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where documents chosen by the checksum of their id repeat a part of their words to the end.

    Let h be the crc32 of the decimal id and g = floor(h / 10). If 10 divides h, each word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id changes nothing.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def changed(doc: int | None, text: str) -> str:
        if doc is None or (h := zlib.crc32(str(doc).encode())) % 10 or not (words := words_of(text)):
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [changed(d.as_py(), t) for d, t in zip(part.column("doc"), batch_texts(part, "text"))]
                yield pa.record_batch([part.column("doc"), pa.array(texts, pa.string())], names=["doc", "text"])

    return narrow(docs, doc=id_col, text=text_col).mapInArrow(run, f"doc {kind}, text string").withColumnRenamed("doc", "doc_id")


def strongest(runs: Column) -> Column:
    """The run of greatest length / period; ties go to the smallest start, then period."""

    def order(a: Column, b: Column) -> Column:
        power = b["length"] * a["period"] - a["length"] * b["period"]
        other = F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(F.when(power != 0, power).otherwise(other)).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))
