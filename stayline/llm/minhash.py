"""Near-duplicate groups: fast similarity sketches, banding, exact verification and connected components.

Sketch (after Dahlgaard, Knudsen and Thorup, 2017): in round i every element of the set is thrown into one of t
bins with a value i + u, u uniform in [0, 1); a bin keeps its smallest value. From round t on, all elements go to
bin i - t, so every bin is filled after 2t rounds at most, and after O(log t) throws per bin with high
probability. Equal bins estimate the Jaccard similarity with the concentration of t independent samples.

Every bucket's members are compared with one pivot, which links most of what belongs together. Documents of buckets that still
hold several components are searched exactly, without a pair of a bucket being made:

* A shingle is live if documents of different components have it. Links between components rest on live shingles alone, so
  documents with too few of them are left out, and what is live is told again.
* Two sets with 100 * intersection >= percent * union share one of their n - ceil(percent * n / 100) + 1 first shingles in any common
  order; with the rarest first and those that aren't live ahead of all, these are few and rare. Documents are grouped by them.
* In a group only members outside its largest component look for partners: they are dealt into chunks, all members
  into blocks of bounded size, and each chunk meets each block in one task, where sizes and sketches are compared. Documents with
  a close sketch in another component are then compared on whole sets, dealt in the same way.

Defined cases: null text counts as empty; empty sets are linked with nothing; repeated rows come out once each; an id with
several texts has a row for each, linked by its own text; rows with a null id are linked with nothing and have a null component.
A-Z are lower-cased, words are runs of bytes other than space and 0x09-0x0D, and a text with fewer than k words is one shingle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import discard, mixed, narrow, shingle_set, slices, word_hashes, work_table

BINS, ROWS = 200, 5  # 40 bands of 5: a pair of similarity 0.8 shares no band with probability 1.3e-7
LEAST_ESTIMATE = 0.14  # below the threshold by this much in the sketch (5 deviations at 0.8) needs no texts
GROUP_ROWS = 2048  # members of a block or chunk whose sketches meet in a task
GROUP_SHINGLES = 1_000_000  # the same for whole sets
LIVE_ROUNDS = 2
SALTS = 64
HOT_KEY = 2048  # rows of a key that may meet in one task
BROADCAST_ROWS = 100_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def fast_sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """`bins` values of a non-empty set of 64-bit hashes."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    empty = out[0]
    step = max(1, math.ceil(bins * (math.log(bins) + 2) / len(items)))
    first = 0
    while first < 2 * bins and (out == empty).any():
        rounds = np.arange(first, min(first + step, 2 * bins), dtype=np.uint64)
        x = mixed(items[None, :] + ((rounds + np.uint64(1)) * _GOLD)[:, None])
        where = (((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        forced = rounds >= bins
        where[forced] = (rounds[forced] - np.uint64(bins)).astype(np.int64)[:, None]
        np.minimum.at(out, where.ravel(), ((rounds << np.uint64(32))[:, None] | (x & np.uint64(0xFFFFFFFF))).ravel())
        first += step
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    table = sketch.reshape(-1, rows)
    key = np.arange(1, len(table) + 1, dtype=np.uint64) * _GOLD
    for i in range(rows):
        key = mixed(key * np.uint64(31) + table[:, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(doc, mark, n, digest, sketch, bands) for rows of (doc, mark, text); digest names the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()),
            ("bands", pa.list_(pa.int64())),
        ])
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, ends = word_hashes((t or "").encode() for t in part.column("text").to_pylist())
                n, digest, low, bands, start = [], [], [], [], 0
                for end in ends:
                    items = shingle_set(hashes[start:end], words)
                    start = end
                    n.append(len(items))
                    if not len(items):
                        digest.append(b""), low.append(b""), bands.append([])
                        continue
                    sketch = fast_sketch(items, bins)
                    digest.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    low.append(sketch.astype(np.uint8).tobytes())
                    bands.append(band_keys(sketch, rows))
                yield pa.record_batch([part.column("doc"), part.column("mark"), n, digest, low, bands], schema=schema)

    return docs.mapInArrow(run, "doc long, mark long, n long, digest binary, sketch binary, bands array<long>")


def few_rows(table: DataFrame) -> bool:
    """Whether a narrow table is counted to be small enough to be broadcast."""
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def with_key_values(
    rows: DataFrame, key: str, per_key: DataFrame, by: str = "node", narrow: bool = True, size: str | None = None
) -> DataFrame:
    """Rows joined with one row per key.

    A narrow table of few keys is broadcast. If its column `size` tells the rows of each key, hot keys are broadcast and the others'
    rows are moved once. Else the rows of a hot key are dealt over SALTS tasks, which read the key's row once each.
    """
    if narrow:
        per_key = work_table(per_key)
        if few_rows(per_key):
            return rows.join(F.broadcast(per_key), key)
    if size is not None:
        hot = per_key.filter(F.col(size) > HOT_KEY)
        if hot.isEmpty():
            return rows.join(per_key, key)
        if few_rows(hot):
            cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.filter(F.col(size) <= HOT_KEY), key)
            return cold.union(rows.join(F.broadcast(hot), key))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    named = salted.select(key, "salt").distinct().join(per_key, key)
    return salted.join(named, [key, "salt"]).drop("salt")


def one_per_node(rows: DataFrame) -> DataFrame:
    """A work table with one of the rows of each node, which are alike. Only nodes with several rows are moved."""
    table = work_table(rows)
    many = work_table(table.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("node"))
    if many.isEmpty():
        return table
    if few_rows(many):
        many = F.broadcast(many)
    several = table.join(many, "node", "left_semi").dropDuplicates(["node"])
    out = work_table(table.join(many, "node", "left_anti").union(several))
    discard(table)
    return out


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (doc, mark, node), written once. Few wanted rows meet the texts where these are read."""
    found = rows.join(F.broadcast(wanted) if few_rows(wanted) else wanted, ["doc", "mark"]).select("node", "text")
    return one_per_node(found)


def likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes whose sketches and sizes don't rule out the threshold."""
    side = lambda s: reps.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    # many pairs may share one pivot, b
    both = with_key_values(pairs.join(side("a"), "a"), "b", side("b"), by="a", narrow=False).filter(
        F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    )

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in ("sketch_a", "sketch_b")]
                same = (x[0] == x[1]).reshape(batch.num_rows, -1).mean(axis=1)
                yield batch.filter(pa.array(same >= threshold - LEAST_ESTIMATE)).select(["a", "b"])

    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def whole_sets(texts: list, words: int) -> list[np.ndarray]:
    hashes, ends = word_hashes((t or "").encode() for t in texts)
    return [shingle_set(hashes[s:e], words) for s, e in zip([0, *ends[:-1]], ends)]


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of nodes whose whole sets have 100 * intersection >= percent * union."""
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
    both = with_key_values(pairs.join(side("a"), "a"), "b", side("b"), by="a", narrow=False)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a", 500_000):
                keep = []
                for x, y in zip(*[whole_sets(part.column(c).to_pylist(), words) for c in ("text_a", "text_b")]):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc, label) of all linked documents: the smallest document they can reach.

    Alternating large-star and small-star steps (Kiveris and others, 2014) until every document has one smaller
    neighbour, which has none.
    """
    edges = work_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = work_table(edges.union(back).groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"),
            F.count_if(F.col("v") > F.col("u")).alias("above"),
        ))
        if low.filter("below > 1 or (below = 1 and above > 0)").isEmpty():
            return low.select(F.col("u").alias("doc"), F.col("m").alias("label"))
        large = edges.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = work_table(small.union(least.select("u", F.col("m").alias("v"))).distinct())


def live_prefixes(
    members: DataFrame, sizes: DataFrame, texts: DataFrame, words: int, percent: int, rounds: int = LIVE_ROUNDS
) -> DataFrame:
    """(key, node, label, n, reach): the live shingles that a member must share with any partner in another component.

    A partner has `reach` shingles at most. Rows are (node, label) of members whose partners are among the members; `sizes` has
    (node, n).
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = whole_sets(part.column("text").to_pylist(), words)
                take = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                items = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.record_batch([part.column("node").take(take), part.column("label").take(take), pa.array(items)], names=["node", "label", "item"])

    texts_in = members.join(texts, "node").select("node", "label", "text")
    items = table = work_table(texts_in.mapInArrow(run, "node long, label long, item long"))
    enough = F.col("live") * 100 >= F.col("n") * percent
    for _ in range(rounds):
        shared = items.groupBy("item").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("many"))
        left = work_table(items.join(shared.filter("lo <> hi").select("item", "many"), "item"))
        discard(table)
        table = left
        counts = left.groupBy("node").agg(F.count(F.lit(1)).alias("live")).join(sizes, "node")
        items = left.join(counts.filter(enough).select("node"), "node", "left_semi").select("node", "label", "item")
    left = left.join(sizes, "node")
    each = left.groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("many", "item"))).alias("items"))
    live = F.size("items")
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    return each.filter(live >= least).select(
        F.explode(F.slice("items", F.lit(1), live - least + 1)["item"]).alias("key"), "node", "label", "n",
        # 100 * live >= percent * (partner + n - live), as the common part is live and the rest of both is in the union
        F.floor((live * (100 + percent) - F.col("n") * percent) / percent).alias("reach"),
    )


def met(members: DataFrame, weight: F.Column, most: int) -> DataFrame:
    """Members of groups `key` dealt so that each pair of different labels meets: columns (key, block, chunk, visitor) are added.

    Residents are all members, in blocks; visitors are those outside the group's heaviest label, in chunks. A block or
    chunk weighs about `most`. Groups of one label are left out.
    """
    weighed = members.withColumn("weight", weight)
    labels = weighed.groupBy("key", "label").agg(F.sum("weight").alias("w"))
    per_key = labels.groupBy("key").agg(
        F.max_by("label", F.struct("w", "label")).alias("main"), F.sum("w").alias("all"), F.max("w").alias("top"),
        F.count(F.lit(1)).alias("labels"),
    ).filter("labels > 1").select(
        "key", "main", F.ceil(F.col("all") / most).cast("int").alias("blocks"),
        F.ceil((F.col("all") - F.col("top")) / most).cast("int").alias("chunks"),
    )
    placed = with_key_values(weighed, "key", per_key)
    number = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = members.columns
    residents = placed.select(*columns, number("blocks").alias("block"), every("chunks").alias("chunk"), F.lit(False).alias("visitor"))
    visitors = placed.filter(F.col("label") != F.col("main")).select(
        *columns, every("blocks").alias("block"), number("chunks").alias("chunk"), F.lit(True).alias("visitor")
    )
    return residents.union(visitors)


def joined_labels(pairs: np.ndarray) -> list[tuple[int, int]]:
    """(larger, smallest) of the labels that rows of (label, label) connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in np.unique(pairs, axis=0).tolist():
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return [(x, find(x)) for x in root if find(x) != x]


def _links_of(groups: DataFrame, judge) -> DataFrame:
    """(a, b) of the labels that each group connects, and (node, null) of the members that do so.

    `judge` gets the visitors and the residents of a group and returns which of them are linked, as a matrix.
    """

    def run(batches):
        for batch in batches:
            edges, nodes = [], []
            for members in batch.column("members"):
                table = pa.RecordBatch.from_struct_array(members.values)
                role = table.column("visitor")
                visitors, residents = table.filter(role), table.filter(pc.invert(role))
                if not visitors.num_rows or not residents.num_rows:
                    continue
                own, other = (t.column("label").to_numpy(zero_copy_only=False) for t in (visitors, residents))
                near = judge(visitors, residents) & (own[:, None] != other[None, :])
                i, j = np.nonzero(near)
                edges += joined_labels(np.stack([own[i], other[j]], axis=1))
                for table, hit in ((visitors, near.any(axis=1)), (residents, near.any(axis=0))):
                    nodes += table.column("node").to_numpy(zero_copy_only=False)[hit].tolist()
            yield pa.record_batch(
                [pa.array([a for a, _ in edges] + nodes, pa.int64()), pa.array([b for _, b in edges] + [None] * len(nodes), pa.int64())],
                names=["a", "b"],
            )

    return groups.mapInArrow(run, "a long, b long").distinct()


def _gathered(dealt: DataFrame, *columns: str) -> DataFrame:
    return dealt.groupBy("key", "block", "chunk").agg(
        F.collect_list(F.struct("node", "label", "visitor", *columns)).alias("members")
    ).select("members")


def close_sketches(members: DataFrame, reps: DataFrame, threshold: float, most: int = GROUP_ROWS) -> DataFrame:
    """Edges and nodes of different labels in one group whose sizes and sketches are close."""
    dealt = met(members, F.lit(1), most).join(reps.select("node", "sketch"), "node")

    def judge(visitors: pa.RecordBatch, residents: pa.RecordBatch) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (visitors, residents))
        (n, far), (m, far_m) = ([t.column(c).to_numpy(zero_copy_only=False) for c in ("n", "reach")] for t in (visitors, residents))
        near = (m[None, :] <= far[:, None]) & (n[:, None] <= far_m[None, :])
        for i in range(0, len(n), 32):
            rows = near[i : i + 32]
            of = np.flatnonzero(rows.any(axis=0))
            rows[:, of] &= (x[i : i + 32, None] == y[None, of]).mean(axis=2) >= threshold - LEAST_ESTIMATE
        return near

    return _links_of(_gathered(dealt, "n", "reach", "sketch"), judge)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of sets of two lists, by products of incidence matrices a few columns at a time."""
    sides = [np.concatenate(sets) for sets in (left, right)]
    shared = np.intersect1d(*sides)
    places = []
    for sets, items in zip((left, right), sides):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, items)
        use = at < len(shared)
        use[use] = shared[at[use]] == items[use]
        order = np.argsort(at[use], kind="stable")
        places.append((row[use][order], at[use][order]))
    total = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, len(shared), 4096):
        parts = []
        for sets, (row, at) in zip((left, right), places):
            lo, hi = np.searchsorted(at, [start, start + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[lo:hi], at[lo:hi] - start] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total


def exact_links(clusters: DataFrame, texts: DataFrame, words: int, percent: int, most: int = GROUP_SHINGLES) -> DataFrame:
    """Edges and nodes of different labels in one cluster that are linked on whole sets. Rows are (key, node, label, n)."""
    weight = F.greatest(F.col("n"), F.lit(math.ceil(most / GROUP_ROWS)))
    dealt = met(clusters, weight, most).join(texts, "node")

    def judge(visitors: pa.RecordBatch, residents: pa.RecordBatch) -> np.ndarray:
        left, right = (whole_sets(t.column("text").to_pylist(), words) for t in (visitors, residents))
        common = common_counts(left, right)
        n, m = (np.array([len(x) for x in sets]) for sets in (left, right))
        return 100 * common >= percent * (n[:, None] + m[None, :] - common)

    return _links_of(_gathered(dealt, "text"), judge)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    bins: int = BINS, rows: int = ROWS, group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row; links have 100 * intersection >= percent * union.

    Equal sets are one class with one node. `text_hash` tells the rows of an id with several texts apart.
    """
    rows_in = narrow(docs, doc=id_col, text=text_col).select(
        F.col("doc").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text"
    )
    table = work_table(sketches(rows_in, words, bins, rows))
    linkable = table.filter("n > 0 and doc is not null")
    classes = linkable.groupBy("digest").agg(F.min(F.struct("doc", "mark")).alias("first")).select("digest", "first.*")
    # a node is named by the smallest id of its class; classes that contest an id are named below all ids by their digest
    contested = classes.groupBy("doc").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("doc", F.lit(True).alias("contested"))
    name = F.when(F.col("contested"), F.xxhash64("digest").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("doc")).alias("node")
    nodes = work_table(classes.join(contested, "doc", "left").select("digest", "doc", "mark", name))
    reps = one_per_node(linkable.join(nodes, ["digest", "doc", "mark"]))
    of_reps = reps.select("doc", "mark", "node")
    spread = reps.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).filter("size > 1")
    spokes = work_table(with_key_values(spread, "key", shared, size="size").select("key", "node", "pivot"))

    # one pivot per bucket links most of what belongs together
    pairs = spokes.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = work_table(likely(pairs, reps, percent / 100))
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts_of(rows_in, of_reps.join(ends, "node"))
    labels = components(verified(near, texts, words, percent)).withColumnRenamed("doc", "node")
    discard(texts)

    # members of buckets that hold several components besides the pivot's links are searched in full
    label = F.coalesce("label", "node").alias("label")
    named = work_table(spokes.filter("node <> pivot").join(labels, "node", "left").select("key", "node", label))
    open_keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    members = work_table(with_key_values(named, "key", open_keys).select("node", "label").distinct())
    if not members.isEmpty():
        texts = texts_of(rows_in, of_reps.join(members, "node").select("doc", "mark", "node"))
        groups = work_table(live_prefixes(members, reps.select("node", "n"), texts, words, percent))
        found = work_table(close_sketches(groups, reps, percent / 100, group_rows))
        clusters = components(found.filter("b is not null")).select(F.col("doc").alias("label"), F.col("label").alias("key"))
        close = found.filter("b is null").select(F.col("a").alias("node")).join(members, "node").join(clusters, "label")
        close = close.join(reps.select("node", "n"), "node").select("key", "node", "label", "n")
        edges = exact_links(close, texts, words, percent, group_shingles).filter("b is not null")
        merged = components(edges).select(F.col("doc").alias("label"), F.col("label").alias("final"))
        discard(texts)
        labels = reps.select("node").join(labels, "node", "left").select("node", label).join(merged, "label", "left").select(
            "node", F.coalesce("final", "label").alias("label")
        )
    of_class = nodes.join(labels, "node", "left").select("digest", "doc", F.coalesce("label", "node").alias("label"))
    least = of_class.groupBy("label").agg(F.min("doc").alias("component"))
    names = of_class.join(least, "label").select("digest", "component")
    named = linkable.select("doc", "mark", "n", "digest").join(names, "digest").select("doc", "mark", "n", "component")
    alone = table.filter("n = 0 or doc is null").select("doc", "mark", "n", F.col("doc").alias("component"))
    return named.union(alone).select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"), F.col("mark").alias("text_hash"),
    )
