"""Order-dependent work without an unbounded window group.

A window over one key runs in one task. The helpers here split such work by value ranges first: each range
gets its own small window, and what one range needs from the others comes from a table of one row per
range. Results are exact. Bounded facts (hot keys, range edges) are read by a small job while planning.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.columns import as_col, as_list
from stayline.session import cut_lineage

HOT_ROWS = 5_000_000
PARTS = 1024
RANGE_SAMPLES = 16  # sampled rows per range of a hot key
BROADCAST_KEYS = 10_000
TOTALS_ROWS = 500_000  # most rows of a broadcast table of ranges
SLICE_ROWS = 500_000
SUSPECTS, TRACKED = 10_000, 100_000  # frequent keys listed and followed by a sketch


def same_key(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> tuple[DataFrame, Column]:
    """`right` with its keys renamed, and the condition that joins it to `left`; a null key equals a null key."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    return renamed, reduce(and_, (left[k].eqNullSafe(F.col(f"_same_{k}")) for k in keys))


_COOL: dict[tuple, None] = {}  # tables known to have no hot key


def _plan_of(df: DataFrame, keys: list[str], weight: Column | None, threshold: float) -> tuple[DataFrame, tuple]:
    one = df.select(*keys, (F.lit(1) if weight is None else weight).alias("_size"))
    return one, (df.sparkSession.sparkContext.applicationId, one.semanticHash(), float(threshold))


def suspected_keys(df: DataFrame, keys: list[str], weight: Column | None, threshold: float) -> list[int] | None:
    """Hashes of all keys that may exceed the threshold; None if there is no telling.

    One aggregate without keys: it counts the rows and sketches the frequent keys, so one row per task is sent
    on. Most tables are too small for a hot key, or have none; that is remembered per plan, so the operators on a table share it. Hot keys
    only decide how rows are dealt, so a table that changes meanwhile costs time and not rows.
    """
    one, known = _plan_of(df, keys, weight, threshold)
    if known in _COOL:
        return []
    if weight is not None:  # the sketch counts rows: the weights of all keys are added up at once
        return None
    top = F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(SUSPECTS), F.lit(TRACKED))
    # the list is read only where it matters: small tables have as many frequent keys as rows
    frequent = F.when(F.col("total") > threshold, F.filter("top", lambda t: t["count"] > threshold))
    seen = one.agg(F.count(F.lit(1)).alias("total"), top.alias("top")).select("total", frequent.alias("top")).first()
    total = seen["total"] or 0
    if total <= threshold:
        found: list[int] | None = []
    elif total / threshold > TRACKED / 10:  # the sketch misses no key above 3.5 / TRACKED of the rows
        found = None
    else:
        found = [r["item"] for r in seen["top"]]
        found = None if len(found) == SUSPECTS else found
    if found == []:
        _remember(known)
    return found


def _remember(known: tuple) -> None:
    if len(_COOL) > 10_000:
        _COOL.clear()
    _COOL[known] = None


def hot_edges(df: DataFrame, keys, order, *, weight: Column | None = None, threshold: float = HOT_ROWS) -> DataFrame | None:
    """(keys, _edges) of every key above `threshold` rows (or summed weight); None if there is none.

    `_edges` are ascending cut points on the whole order, ties included, that split the key's rows into ranges of
    about half the threshold. They come from a random sample of the key's rows, written once, so every later
    reading sees the same cuts. Their number rises with the key; there is no limit on keys or ranges.
    """
    keys = as_list(keys)
    suspects = suspected_keys(df, keys, weight, threshold)
    if suspects == []:
        return None
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    rows = df if suspects is None else df.filter(F.xxhash64(*keys).isin(suspects))
    heavy = cut_lineage(
        rows.groupBy(*keys).agg(size.alias("_n"), F.count(F.lit(1)).alias("_rows")).filter(F.col("_n") > threshold)
        .withColumn("_ranges", F.ceil(F.col("_n") * 2 / threshold).cast("int"))
    )
    if heavy.isEmpty():
        _remember(_plan_of(df, keys, weight, threshold)[1])
        return None
    rank = F.struct(*[as_col(c).alias(f"_{i}") for i, c in enumerate(as_list(order))])
    right, same = same_key(df, heavy.select(*keys, "_ranges", "_rows"), keys)
    few = heavy.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    picked = df.join(F.broadcast(right) if few else right, same).filter(
        F.rand(7) < F.col("_ranges") * RANGE_SAMPLES / F.col("_rows")
    )
    sample = picked.select(*[df[k] for k in keys], rank.alias("_rank"), "_ranges").groupBy(*keys, "_ranges").agg(
        F.sort_array(F.collect_list("_rank")).alias("_sample")
    )
    at = lambda i: F.floor(i * F.size("_sample") / F.col("_ranges")).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), F.col("_ranges") - 1), lambda i: F.get(F.col("_sample"), at(i)))
    return cut_lineage(sample.select(*keys, cuts.alias("_edges")))


def in_ranges(df: DataFrame, keys, order, edges: DataFrame, name: str) -> DataFrame:
    """Add `_hot`, and the number of cut points of the row's key below its order (0 for ordinary keys)."""
    keys = as_list(keys)
    most, count = edges.agg(F.max(F.size("_edges")), F.count(F.lit(1))).first()
    right, same = same_key(df, edges.withColumn("_hot", F.lit(True)), keys)
    rank = F.struct(*[as_col(c).alias(f"_{i}") for i, c in enumerate(as_list(order))])
    # steps of a bisection: a cut beyond the last is null and moves nothing
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(int(most).bit_length()))])
    move = lambda at, step: F.when(F.get("_edges", at + step - 1) < F.col("_rank"), at + step).otherwise(at)
    few = count <= BROADCAST_KEYS and count * most <= PARTS * BROADCAST_KEYS
    return (
        df.join(F.broadcast(right) if few else right, same, "left").withColumn("_rank", rank)
        .withColumn(name, F.when(F.col("_hot"), F.aggregate(steps, F.lit(0), move)).otherwise(F.lit(0)))
        .drop("_rank", "_edges", *[f"_same_{k}" for k in keys])
    )


def number_array(values: Iterable[float]) -> Column:
    """A constant array that stays one small expression until it is folded to a single literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def range_cuts(value, parts: int = PARTS) -> Column:
    """Aggregate: parts-1 ascending cut points that split the rows into ranges of about equal size."""
    probs = number_array(i / parts for i in range(1, parts))
    return F.percentile_approx(as_col(value).cast("double"), probs, 10 * parts)


def quantile_edges(df: DataFrame, value, parts: int = PARTS) -> list[float]:
    return list(df.agg(range_cuts(value, parts).alias("e")).first()["e"] or [])


def range_index(value, edges: list[float] | Column, parts: int, inclusive: bool = False) -> Column:
    """How many of the parts-1 ascending cut points lie below the value (or at it, if inclusive).

    Bisection, so `parts` is a power of two.
    """
    if isinstance(edges, list):
        if not edges:
            return F.lit(0)
        edges = number_array(edges)
    v = as_col(value).cast("double")
    steps = [parts >> i for i in range(1, parts.bit_length())]

    def move(pos: Column, step: Column) -> Column:
        edge = F.element_at(edges, pos + step)
        return F.when((edge <= v) if inclusive else (edge < v), pos + step).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), move)


def split_hot(
    df: DataFrame, keys, order, *, weight: Column | None = None, threshold: float = HOT_ROWS, name: str = "_part"
) -> DataFrame:
    """Add a part number that is 0 for ordinary keys and rises with `order` inside hot keys."""
    edges = hot_edges(df, keys, order, weight=weight, threshold=threshold)
    if edges is None:
        return df.withColumn(name, F.lit(0))
    return in_ranges(df, keys, order, edges, name).drop("_hot")


def next_value(df: DataFrame, keys, order, value: Column, out: str, *, threshold: float = HOT_ROWS) -> DataFrame:
    """For each row the non-null `value` of the nearest later row of the same key.

    `order` lists ascending columns. One descending window per key serves ordinary keys. Rows of a hot key, null
    included, are cut into ranges of the whole order; rows whose range holds no later value take the first
    value of the next range that has one.
    """
    keys, order = as_list(keys), as_list(order)
    descending = [F.col(c).desc() for c in order]
    later = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_v", value)
    edges = hot_edges(df, keys, order, threshold=threshold)
    if edges is None:
        w = Window.partitionBy(*keys).orderBy(*descending)
        return df.withColumn(out, F.last("_v", ignorenulls=True).over(later(w))).drop("_v")

    tagged = in_ranges(df, keys, order, edges, "_part")
    inside = Window.partitionBy(*keys, "_part").orderBy(*descending)
    inner = tagged.withColumn("_in", F.last("_v", ignorenulls=True).over(later(inside)))
    rank = F.struct(*[F.col(c) for c in order])
    firsts = (
        tagged.filter("_hot").groupBy(*keys, "_part")
        .agg(F.min_by(F.when(F.col("_v").isNotNull(), F.col("_v")), F.when(F.col("_v").isNotNull(), rank)).alias("_first"))
    )
    across = later(Window.partitionBy(*keys).orderBy(F.col("_part").desc()))
    following = firsts.select(
        *keys, "_part", F.last("_first", ignorenulls=True).over(across).alias("_out")
    )
    right, same = same_key(inner, following, [*keys, "_part"])
    return (
        inner.join(right, same, "left")
        .withColumn(out, F.coalesce("_in", "_out"))
        .drop("_v", "_in", "_out", "_part", "_hot", *[f"_same_{k}" for k in [*keys, "_part"]])
    )


def running_totals(
    df: DataFrame, order: str, sums: Mapping[str, Column], *, by=(), descending: bool = False, parts: int = PARTS,
    edges: list[float] | None = None,
) -> DataFrame:
    """Inclusive running sums along `order` inside each `by` group.

    `df` holds one row per (by, order) value, so ties are already merged. Each group has its own cut points, parts-1 numbers in a
    table that its rows meet by the group; the table and the one of range totals are broadcast if they are counted small.
    Without groups, `edges` may hand in cut points that are known already.
    """
    by = as_list(by)
    few = True
    if by:
        cuts = cut_lineage(df.groupBy(*by).agg(range_cuts(order, parts).alias("_edges")))
        few = cuts.limit(TOTALS_ROWS // parts + 1).count() <= TOTALS_ROWS // parts
        right, same = same_key(df, cuts, by)
        joined = df.join(F.broadcast(right) if few else right, same).drop(*[f"_same_{k}" for k in by])
        cut = joined.withColumn("_b", range_index(order, F.col("_edges"), parts)).drop("_edges")
    else:
        cut = df.withColumn("_b", range_index(order, quantile_edges(df, order, parts) if edges is None else edges, parts))

    direction = F.desc if descending else F.asc
    group = [F.col(c) for c in by] or [F.lit(0)]
    per_range = cut.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(direction("_b")).rowsBetween(Window.unboundedPreceding, -1)
    base = per_range.select(
        *by, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*by, "_b").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()])
    # base has at most `parts` rows per group
    right, same = same_key(inner, base, [*by, "_b"])
    joined = inner.join(F.broadcast(right) if few else right, same)
    for n in sums:
        joined = joined.withColumn(n, F.col(f"_i_{n}") + F.col(f"_o_{n}"))
    return joined.drop("_b", *[f"_same_{k}" for k in [*by, "_b"]], *[f"_i_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def dense_rank_by_hash(
    df: DataFrame, hash_col: str, ties, out: str, *, by=(), bits: int | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Exact row number 1..n in (hash, ties) order inside each `by` group, without an unbounded window.

    The hash is uniform in [0, 2^32): its top bits cut each group into even slices, as many as the rows ask for. Offsets of the
    slices are a table of one row per slice and group, broadcast if it is counted small. With few rows there is one slice.
    """
    by, ties = as_list(by), as_list(ties)
    if bits is None:
        bits = min(28, max(0, math.ceil(math.log2(max(1, df.count()) / slice_rows))))
    group = [F.col(c) for c in by] or [F.lit(0)]
    if not bits:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(hash_col, *ties)).cast("long"))
    cut = df.withColumn("_slice", F.shiftright(F.col(hash_col), 32 - bits))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = cut_lineage(cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))).select(
        *by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    few = base.limit(TOTALS_ROWS + 1).count() <= TOTALS_ROWS
    inside = Window.partitionBy(*by, "_slice").orderBy(hash_col, *ties)
    numbered = cut.withColumn("_rn", F.row_number().over(inside))
    right, same = same_key(numbered, base, [*by, "_slice"])
    return (
        numbered.join(F.broadcast(right) if few else right, same).withColumn(out, F.col("_rn") + F.col("_base"))
        .drop("_slice", "_rn", "_base", *[f"_same_{k}" for k in [*by, "_slice"]])
    )


def clean(column: str) -> Column:
    """The column as a double, NaN as NULL."""
    v = F.col(column).cast("double")
    return F.when(~F.isnan(v), v)


@dataclass
class _Search:
    """Interval [low, high] that holds the wanted ranks of one column, with `below` rows under it."""

    column: str
    prob: int
    first: int
    last: int
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf

    def within(self) -> Column:
        v = clean(self.column)
        return F.when((v >= self.low) & (v <= self.high), v)


def exact_quantiles(
    df: DataFrame, cols: Iterable[str], probs: Iterable[float], accuracy: int = 10_000, small: int = 50_000
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, as {column: [one value per prob]}.

    Sketches bracket each quantile, counts check the bracket, and only values inside it are sorted, so the
    data is scanned a few times and hardly shuffled. `percentile` would hold all values in one task.
    """
    cols, probs = list(dict.fromkeys(cols)), list(probs)
    margin = 2.0 / accuracy
    around = number_array(x for q in probs for x in (max(0.0, q - margin), min(1.0, q + margin)))
    first = df.agg(
        *[F.count(clean(c)).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.percentile_approx(clean(c), around, accuracy).alias(f"c{i}") for i, c in enumerate(cols)],
    ).first()
    searches, cuts = [], []
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        for j, q in enumerate(probs):
            if n:
                at = (n - 1) * q
                searches.append(_Search(c, j, math.floor(at), math.ceil(at), n))
                cuts.append((first[f"c{i}"][2 * j], first[f"c{i}"][2 * j + 1]))
    wide = [k for k, s in enumerate(searches) if s.inside > small]
    todo = _confirm(df, [searches[k] for k in wide], [cuts[k] for k in wide], small)
    while todo:
        todo = _confirm(df, todo, _sketch(df, todo, accuracy), small)
    found = _values_at(df, searches)
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for s in searches:
        lo, hi = found[(s.column, s.prob)]
        at = (first[f"n{cols.index(s.column)}"] - 1) * probs[s.prob]
        out[s.column][s.prob] = lo + (hi - lo) * (at - s.first)
    return out


def _grouped(searches: list[_Search]) -> list[list[_Search]]:
    """Searches that share an interval."""
    by_interval: dict[tuple[str, float, float], list[_Search]] = {}
    for s in searches:
        by_interval.setdefault((s.column, s.low, s.high), []).append(s)
    return list(by_interval.values())


def _sketch(df: DataFrame, searches: list[_Search], accuracy: int) -> list[tuple[float, float]]:
    """Narrower brackets from one sketch per interval."""
    margin = 2.0 / accuracy
    groups = _grouped(searches)
    aggs = []
    for g, group in enumerate(groups):
        around = [
            x for s in group
            for x in (max(0.0, (s.first - s.below) / s.inside - margin), min(1.0, (s.last - s.below + 1) / s.inside + margin))
        ]
        aggs.append(F.percentile_approx(group[0].within(), number_array(around), accuracy).alias(f"c{g}"))
    row = df.agg(*aggs).first()
    cuts = {
        id(s): (row[f"c{g}"][2 * k], row[f"c{g}"][2 * k + 1]) for g, group in enumerate(groups) for k, s in enumerate(group)
    }
    return [cuts[id(s)] for s in searches]


def _confirm(df: DataFrame, searches: list[_Search], cuts: list[tuple[float, float]], small: int) -> list[_Search]:
    """Count the rows below and inside each bracket, take it over, and return the searches still too wide."""
    if not searches:
        return []
    counts = []
    for i, (s, (lo, hi)) in enumerate(zip(searches, cuts)):
        v = s.within()
        counts.append(F.count(F.when(v < lo, 1)).alias(f"b{i}"))
        counts.append(F.count(F.when((v >= lo) & (v <= hi), 1)).alias(f"i{i}"))
    seen = df.agg(*counts).first()
    wide = []
    for i, (s, (lo, hi)) in enumerate(zip(searches, cuts)):
        under, inside = seen[f"b{i}"], seen[f"i{i}"]
        over = s.inside - under - inside
        low, high, below, held = lo, hi, s.below + under, inside
        if below > s.first:  # the sketch cut too high: keep the old lower end
            low, below, held = s.low, s.below, held + under
        if s.last >= s.below + under + inside:  # or too low: keep the old upper end
            high, held = s.high, held + over
        shrunk = held < s.inside
        s.low, s.high, s.below, s.inside = low, high, below, held
        # a bracket of one repeated value is settled; one that no longer shrinks is settled by grouping
        if held > small and shrunk and low < high:
            wide.append(s)
    return wide


def _values_at(df: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], tuple[float, float]]:
    """The values at the wanted ranks, from counts per distinct value inside each bracket."""
    found = {(s.column, s.prob): (s.low, s.low) for s in searches if s.low == s.high}
    groups = _grouped([s for s in searches if s.low < s.high])
    if not groups:
        return found
    names = [f"v{g}" for g in range(len(groups))]
    inside = df.select(*[group[0].within().alias(n) for n, group in zip(names, groups)])
    counts = inside.unpivot([], names, "g", "v").filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    # brackets hold few distinct values by now
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("cum", F.sum("n").over(w))
    aggs = []
    for g, group in enumerate(groups):
        for k, s in enumerate(group):
            for name, rank in (("a", s.first), ("z", s.last)):
                hit = (F.col("g") == names[g]) & (F.col("cum") > rank - s.below)
                aggs.append(F.min(F.when(hit, F.col("v"))).alias(f"{name}{g}_{k}"))
    row = ranked.agg(*aggs).first()
    for g, group in enumerate(groups):
        for k, s in enumerate(group):
            found[(s.column, s.prob)] = (row[f"a{g}_{k}"], row[f"z{g}_{k}"])
    return found
