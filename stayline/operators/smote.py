"""Synthetic minority rows between exact nearest neighbours.

Neighbours are found cell by cell. Rows belong to the nearest of a set of centres, which are fitted on a bounded sample, so that
cells follow the data's clusters; a cell with many rows is cut into slots. A row looks inside its own slot first. The distance r of
its k-th hit there rules out every cell whose centre is farther away than r plus the cell's radius, or farther than its own centre by
more than 2 r, as no row of such a cell is nearer than r. Slots that lie together form blocks, larger where rows ask for many cells, and a row goes once to
every block that holds a remaining cell, its own included; each visit hands back k rows, not pairs.
The result is exact whatever the centres are. How many cells remain depends on the data: few where rows lie in clusters, all where
distances are all alike, as they tend to be in many dimensions without clusters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.hashing import hash32, unit
from stayline.functions.ordering import dense_rank_by_hash
from stayline.operators.codes import small_table
from stayline.operators.sampling import draws, minority_sizes
from stayline.session import cut_lineage

CENTRES = 4096  # at most; with the next bound the size of what is broadcast
CENTRE_NUMBERS = 4_000_000
SAMPLE_PER_CENTRE = 64
BLOCK_NUMBERS = 2_000_000  # of the vectors of a block
LEAST_BLOCKS = 8
VISIT_SAMPLE = 2000  # rows, about, that tell how many cells a row asks for
PAIR_BLOCK = 2_000_000  # distances held at a time in a task
FOUND = "key long, neighbor long, dist double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def nearest_of(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """(query place, point place, distance) of the k nearest points of each query, ties by id; its own id is left out.

    Products of blocks give candidates, and their distances are then taken exactly.
    """
    squares = (points * points).sum(axis=1)
    step = max(1, PAIR_BLOCK // max(1, len(points)))
    for start in range(0, len(queries), step):
        block = queries[start : start + step]
        size = (block * block).sum(axis=1)[:, None]
        rough = size + squares[None, :] - 2 * block @ points.T
        rough[own[start : start + step, None] == ids[None, :]] = np.inf
        few = min(k, len(points))
        least = np.partition(rough, few - 1, axis=1)[:, few - 1 : few]
        slack = 1e-9 * (size + squares.max(initial=0.0)) + 1e-12
        at, to = np.nonzero((rough <= least + slack) & np.isfinite(rough))
        dist = np.sqrt(((block[at] - points[to]) ** 2).sum(axis=1))
        order = np.lexsort((ids[to], dist, at))
        at, to, dist = at[order], to[order], dist[order]
        first = np.searchsorted(at, np.arange(len(block)))
        keep = np.arange(len(at)) - first[at] < k
        yield at[keep] + start, to[keep], dist[keep]


def _visits(visitors: DataFrame, members: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """(key, neighbor, dist) of the k nearest members of each visited slot.

    A slot with many visitors is handled in several tasks, each with its own copy of the members.
    """
    # one row per slot, joined by slot; known beforehand, so that visitors are moved once
    crowd = small_table(cut_lineage(
        visitors.groupBy("cell", "slot").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("chunks"))
    ))
    left = visitors.join(crowd, ["cell", "slot"]).withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    right = members.join(crowd, ["cell", "slot"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["cell", "slot", "chunk"]

    def visit(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and rows.num_rows:
            points, ids = _matrix(rows.column(1)), rows.column(0).to_numpy()
            own = queries.column(0).to_numpy()
            parts = list(nearest_of(points, ids, _matrix(queries.column(1)), own, k))
            out = [np.concatenate([f(p) for p in parts]) for f in (lambda p: own[p[0]], lambda p: ids[p[1]], lambda p: p[2])]
        return pa.table([pa.array(c) for c in out], names=["key", "neighbor", "dist"])

    def grouped(df: DataFrame, side: str):
        # both sides stem from one frame: fresh column names keep them apart
        fresh = df.select(F.col("key").alias("key"), F.col("vec").alias("vec"), *[F.col(c).alias(f"{side}{c}") for c in keys])
        return fresh.groupBy(*[f"{side}{c}" for c in keys])

    return grouped(left, "l").cogroup(grouped(right, "r")).applyInArrow(visit, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each key, in order; a key has at most k rows per visited slot."""
    pairs = F.sort_array(F.collect_list(F.struct("dist", "neighbor")))
    return found.groupBy("key").agg(F.slice(pairs, 1, k).alias("near"))


def centres_of(rows: DataFrame, n: int, cell_rows: int) -> np.ndarray:
    """Centres of about n / cell_rows cells, fitted on a bounded sample of the rows."""
    dims = rows.select(F.size("vec")).first()[0]
    wanted = min(CENTRES, max(1, CENTRE_NUMBERS // max(dims, 1)), math.ceil(n / cell_rows))
    share = min(1.0, wanted * SAMPLE_PER_CENTRE / n)
    sample = rows.filter(unit("key", seed="centres") < share).select(array_to_vector("vec").alias("features"))
    model = KMeans(k=max(2, wanted), seed=42, maxIter=5).fit(cut_lineage(sample))
    return np.array([list(c) for c in model.clusterCenters()])


def in_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with the nearest centre's number and distance."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                points = _matrix(part.column("vec"))
                found = list(nearest_of(shared.value, np.arange(len(shared.value)), points, np.full(len(points), -1), 1))
                cell, away = (np.concatenate([p[i] for p in found]) for i in (1, 2))
                yield pa.record_batch(
                    [part.column("key"), part.column("vec"), pa.array(cell, pa.int32()), pa.array(away)], names=["key", "vec", "cell", "away"]
                )

    return rows.select("key", "vec").mapInArrow(run, "key long, vec array<double>, cell int, away double")


def blocks_of(centres: np.ndarray, sizes: dict[int, int], slots: dict[int, int], block_rows: int) -> list[tuple[int, int, int]]:
    """(cell, slot, block): slots of neighbouring cells, along the main axis of the centres, in blocks of about `block_rows` rows."""
    cells = np.array(sorted(sizes))
    middle = centres[cells] - centres[cells].mean(axis=0)
    axis = np.linalg.svd(middle, full_matrices=False)[2][0]
    out, before = [], 0.0
    for cell in cells[np.argsort(middle @ axis, kind="stable")].tolist():
        for slot in range(slots[cell]):
            out.append((cell, slot, int(before / block_rows)))
            before += sizes[cell] / slots[cell]
    return out


def blocks_to_visit(bounded: DataFrame, centres: np.ndarray, radius: dict[int, float], blocks: list[tuple[int, int, int]]) -> DataFrame:
    """(key, vec, block) of every block that may hold a row within `reach` (null: any); the row's own block is one of them."""
    numbers = sorted(radius)
    held = {c: set() for c in numbers}
    for cell, _, block in blocks:
        held[cell].add(block)
    first, last = (np.array([f(held[c]) for c in numbers]) for f in (min, max))  # the slots of a cell follow each other
    known = centres[numbers], np.array([radius[c] for c in numbers]), first, last, 1 + max(b for _, _, b in blocks)
    shared = bounded.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                middle, wide, lo, hi, n_blocks = shared.value
                points = _matrix(part.column("vec"))
                away = np.stack([np.sqrt(((p - middle) ** 2).sum(axis=1)) for p in points])
                reach = pc.fill_null(part.column("reach"), np.inf).to_numpy(zero_copy_only=False)[:, None]
                own = part.column("away").to_numpy(zero_copy_only=False)[:, None]
                slack = 1e-9 * (1 + away)
                at, to = np.nonzero((away - wide[None] <= reach + slack) & (away - own <= 2 * reach + slack))
                each = hi[to] - lo[to] + 1
                offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                asked = np.zeros((len(points), n_blocks), bool)
                asked[np.repeat(at, each), np.repeat(lo[to], each) + offset] = True
                at, block = np.nonzero(asked)
                for cut in range(0, len(at), 4096):
                    rows = pa.array(at[cut : cut + 4096])
                    yield pa.record_batch(
                        [part.column("key").take(rows), part.column("vec").take(rows), pa.array(block[cut : cut + 4096], pa.int32())],
                        names=["key", "vec", "block"],
                    )

    return bounded.select("key", "vec", "away", "reach").mapInArrow(run, "key long, vec array<double>, block int")


def nearest_neighbors(df: DataFrame, key: str, vector: str, k: int = 5, cell_rows: int = 2048) -> DataFrame:
    """(key, near): the k nearest other rows as structs (dist, neighbor), exact, ties by key.

    `key` is a unique long, `vector` an array of doubles, of one length in all rows.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "key long, near array<struct<dist:double,neighbor:long>>")
    if n <= cell_rows:  # a single cell has seen all rows
        members = rows.withColumns({"cell": F.lit(0), "slot": F.lit(0)})
        return _best(_visits(members, members, k, cell_rows), k)
    centres = centres_of(rows, n, cell_rows)
    placed = cut_lineage(in_cells(rows, centres))
    found = placed.groupBy("cell").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("slots")).collect()
    radius, slots = {r["cell"]: r["r"] for r in found}, {r["cell"]: r["slots"] for r in found}  # at most CENTRES rows
    sizes = {r["cell"]: r["n"] for r in found}
    table = df.sparkSession.createDataFrame(list(slots.items()), "cell int, slots int")
    members = cut_lineage(
        placed.join(F.broadcast(table), "cell").withColumn("slot", F.pmod(F.xxhash64("key"), "slots").cast("int")).drop("slots")
    )
    own = cut_lineage(_best(_visits(members, members, k, cell_rows), k))
    reach = F.when(F.size("near") >= k, F.element_at("near", -1)["dist"])
    bounded = members.join(own, "key", "left").withColumn("reach", reach)
    # the more cells some rows ask for, the larger the blocks; the result is the same
    few = cut_lineage(bounded.filter(unit("key", seed="visits") < VISIT_SAMPLE / n))
    asked = blocks_to_visit(few, centres, radius, blocks_of(centres, sizes, slots, cell_rows)).count() / max(1, few.count())
    most = min(BLOCK_NUMBERS // max(1, centres.shape[1]), math.ceil(n / LEAST_BLOCKS), int(cell_rows * asked / 4))
    block_rows = max(cell_rows, most)
    blocks = blocks_of(centres, sizes, slots, block_rows)
    visitors = blocks_to_visit(bounded, centres, radius, blocks)
    numbered = df.sparkSession.createDataFrame(blocks, "cell int, slot int, block int")
    inside = members.select("key", "vec", "cell", "slot").join(F.broadcast(numbered), ["cell", "slot"])
    as_slots = lambda rows: rows.select("key", "vec", F.col("block").alias("cell"), F.lit(0).alias("slot"))
    return _best(_visits(as_slots(visitors), as_slots(inside), k, block_rows), k)


def smote(
    df: DataFrame, key: str, label: str, vector: str, ratio: float = 0.5, k: int = 5, seed: int = 42,
    minority: int = 1, cell_rows: int = 2048,
) -> DataFrame:
    """(key, label, vector, draw): all rows, and synthetic minority rows (key NULL) up to ratio * majority.

    A synthetic row lies between a drawn minority row and one of its k nearest minority rows.
    """
    vec = F.col(vector).cast("array<double>").alias(vector)
    base = df.select(F.col(key).cast("long").alias(key), label, vec)
    m, largest = minority_sizes(base, label, minority)
    target = int(ratio * largest)
    kept = base.withColumn("draw", F.lit(None).cast("long"))
    if target <= m:
        return kept
    k = min(k, m - 1)
    if k < 1:
        raise ValueError("a minority of fewer than two rows has no neighbours; copy rows instead")
    rare = cut_lineage(base.filter(F.col(label) == minority))
    near = nearest_neighbors(rare, key, vector, k, cell_rows)
    numbered = dense_rank_by_hash(rare.withColumn("_h", hash32(key, seed=seed)), "_h", key, "_rank").drop("_h")
    chosen = (
        draws(df.sparkSession, target - m, m, seed)
        .join(numbered, "_rank")
        .join(near.withColumnRenamed("key", key), key)
        .withColumn("_j", F.pmod(hash32("draw", seed=f"{seed}n"), F.lit(k)) + 1)
        .withColumn("_neighbor", F.element_at("near", F.col("_j").cast("int"))["neighbor"])
        .withColumn("_u", unit("draw", seed=f"{seed}u"))
    )
    other = rare.select(F.col(key).alias("_neighbor"), F.col(vector).alias("_other"))
    synthetic = chosen.join(other, "_neighbor").select(
        F.lit(None).cast("long").alias(key), F.col(label),
        F.zip_with(vector, "_other", lambda a, b: a + F.col("_u") * (b - a)).alias(vector),
        "draw",
    )
    return kept.unionByName(synthetic)


