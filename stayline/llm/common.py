"""Shared helpers: narrow inputs, work tables, and text hashing inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stayline.session import shared_folder

SLICE_BYTES = 2_000_000


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names; other columns can't clash."""
    return docs.select(*[docs[f"`{source}`"].alias(name) for name, source in columns.items()])


def free_name(name: str, columns: Iterable[str]) -> str:
    """`name`, with underscores added until no column has it (names don't differ by case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def work_table(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends there."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.__dict__["_work_folder"] = folder
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a work table that nothing reads any more; other frames are left alone."""
    folder = table.__dict__.pop("_work_folder", None)
    if folder is not None:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose text is about `limit` bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start, total = np.cumsum(sizes), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, total + limit, side="right")))
        yield batch.slice(start, stop - start)
        total, start = int(ends[stop - 1]), stop


def batch_texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of a 64-bit integer hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _TABLES["up"], _TABLES["down"] = _powers(n, _BASE), _powers(n, inverse)
    return _TABLES["up"], _TABLES["down"]


def word_hashes(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, and the end of each text's words among them.

    A-Z count as a-z; words are runs of bytes other than space and 0x09-0x0D. One vectorised pass: word
    hashes are differences of a running polynomial sum, shifted back to the word's start.
    """
    texts = list(texts)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = _LOWER[data]
    space = np.concatenate(([True], _SPACE[data], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, np.cumsum(lengths + 1), side="left")


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `k` words; fewer words count as one run, none give an empty set."""
    if not len(words):
        return words
    width = min(k, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - width + 1 + i])
    return np.unique(total if width == k else mixed(total + np.uint64(width)))
