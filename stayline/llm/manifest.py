"""Merkle manifests of datasets: a hash tree per source, a tree over their roots, inclusion proofs and verification.

Nodes are labelled with the interval [lo, hi) of leaf ranks they cover, so the trees need no pointers. A node of level k + 1
is made of the run of nodes whose intervals start in one bucket of 16^(k + 1) ranks. From the roots down, runs are joined
with their parents by source and bucket, where the parent's interval contains theirs; a member's siblings are those
members of the run whose intervals lie in the parent's interval before or after its own. What a node passes on to its run
is its path: the digests left and right of it on every level up to the root.

Ranks come from one sort into ranges of (source, id, digest), so a source of any size is spread over many tasks; the rows a
source has in earlier ranges are counted and joined by range and source. Runs are at most 16 rows. Digests are hex text.

Defined cases: a null in any column has a notation of its own; null sources come first and are one source; null ids come first
in their source; rows of equal ids are ordered by digest, and repeated rows are leaves of their own; an empty table has no
leaves and the root None; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import shuffle_parts, work_table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def notation(value: Column) -> Column:
    """`-` for null, else the byte count of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(*[notation(v) for v in values])


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `rank` from 0 inside each tree, and the tree's `size`. Rows are written sorted, so ranks don't change later."""
    keys = [F.col(c) for c in ("tree", *order)]
    parts = shuffle_parts(rows)
    at = F.monotonically_increasing_id()
    dealt = work_table(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", at))
    cut = dealt.withColumn("part", F.shiftright("at", 33))
    counts = cut.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    earlier = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"), "first", F.coalesce(earlier, F.lit(0)).alias("base"),
        F.sum("n").over(tree).alias("size"),
    )
    same = (F.col("part") == F.col("_part")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return cut.join(base, same).withColumn("rank", F.col("at") - F.col("first") + F.col("base")).drop(
        "at", "part", "first", "base", "_tree", "_part"
    )


@dataclass
class Forest:
    """Hash trees of one kind. `runs[k]` holds the runs of level k: (tree, size, bucket, lo, hi, members), each member with its
    interval, digest and whatever the leaves carry; `roots` holds (tree, size, level, digest), `alone` the trees of one leaf."""

    runs: list[DataFrame]
    roots: DataFrame
    alone: DataFrame
    carried: tuple[str, ...]

    def nodes(self) -> DataFrame:
        """(tree, level, lo, hi, digest) of every node, from leaves to roots."""
        out = self.roots.select("tree", "level", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"), "digest")
        for level, runs in enumerate(self.runs):
            each = runs.select("tree", F.explode("members").alias("m"))
            out = out.union(each.select("tree", F.lit(level), "m.lo", "m.hi", "m.digest"))
        return out

    def paths(self, above: DataFrame) -> list[DataFrame]:
        """Per level of runs, from 0: its members with `path`, and the columns that `above` gives each tree besides its path."""
        given = [c for c in above.columns if c not in ("tree", "path")]
        tops = self.roots.withColumnRenamed("tree", "_tree").join(above, F.col("_tree").eqNullSafe(F.col("tree"))).drop("_tree")
        tops = tops.select("tree", "level", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"), "path", *given)
        out: list[DataFrame] = []
        below = None
        for level in reversed(range(len(self.runs))):
            width = FANOUT ** (level + 1)
            parents = tops.filter(F.col("level") == level + 1).drop("level")
            if below is not None:
                parents = parents.unionByName(below.select("tree", "lo", "hi", "path", *given))
            parents = parents.select(
                F.col("tree").alias("_tree"), F.floor(F.col("lo") / width).alias("_bucket"), F.col("lo").alias("_lo"),
                F.col("hi").alias("_hi"), "path", *given,
            )
            inside = (
                F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("bucket") == F.col("_bucket"))
                & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            )
            met = self.runs[level].join(parents, inside).select("tree", "path", "members", *given, F.explode("members").alias("m"))
            side = lambda test: F.array_join(F.transform(F.filter("members", test), lambda s: s["digest"]), "")
            step = F.struct(
                side(lambda s: s["hi"] <= F.col("m")["lo"]).alias("left"), side(lambda s: s["lo"] >= F.col("m")["hi"]).alias("right")
            )
            below = met.select("tree", "m.*", F.concat(F.array(step), "path").alias("path"), *given)
            out.insert(0, below)
        return out

    def leaves(self, above: DataFrame) -> DataFrame:
        """Every leaf with its path, and what `above` gives its tree; a tree of one leaf has none of its own."""
        given = [c for c in above.columns if c not in ("tree", "path")]
        lone = self.alone.join(above.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree"))).select(
            "tree", *self.carried, "path", *given
        )
        found = self.paths(above)
        return lone.unionByName(found[0].select("tree", *self.carried, "path", *given)) if found else lone



def forest(rows: DataFrame, carried: Sequence[str] = ()) -> Forest:
    """Trees over ranked rows of (tree, rank, size, digest) and the columns `carried`; runs of every level are written."""
    carried = ("digest", *carried)
    leaves = rows.select("tree", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), *carried)
    leaves = work_table(leaves)
    most = leaves.agg(F.max("size")).first()[0] or 0
    alone = leaves.filter("size = 1")
    roots = alone.select("tree", "size", F.lit(0).alias("level"), "digest")
    runs: list[DataFrame] = []
    level, names, nodes = 0, ("lo", "hi", *carried), leaves.filter("size > 1")
    while FANOUT**level < most:
        bucket = F.floor(F.col("lo") / FANOUT ** (level + 1)).alias("bucket")
        made = work_table(
            nodes.groupBy("tree", "size", bucket).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("members"))
            .select("tree", "size", "bucket", F.col("members")[0]["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi"), "members")
        )
        runs.append(made)
        level, names = level + 1, ("lo", "hi", "digest")
        parents = made.select(
            "tree", "size", "lo", "hi", digest(F.array_join(F.transform("members", lambda m: m["digest"]), "")).alias("digest")
        )
        whole = (F.col("lo") == 0) & (F.col("hi") == F.col("size"))
        roots = roots.union(parents.filter(whole).select("tree", "size", F.lit(level), "digest"))
        nodes = parents.filter(~whole)
    return Forest(runs, work_table(roots), alone, carried)


@dataclass
class Manifest:
    """The trees of all sources, the tree over their roots, and its root."""

    sources: Forest
    top: Forest
    root: str | None

    def nodes(self) -> DataFrame:
        return self.sources.nodes()

    def leaves(self) -> DataFrame:
        """Every leaf's carried columns with `tree` (its source), `subroot` and `path`, siblings from its run up to the root."""
        empty = F.array().cast(f"array<{STEP}>")
        above = self.top.roots.select("tree", empty.alias("path"))
        subroots = self.top.leaves(above).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
        return self.sources.leaves(subroots)


def manifest(leaves: DataFrame, carried: Sequence[str] = ()) -> Manifest:
    """The manifest of leaves (tree, id, digest) and the columns `carried`."""
    kept = ("id", *carried)
    sources = forest(ranked(work_table(leaves.select("tree", "digest", *kept)), ["id", "digest"]), kept)
    named = sources.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest")
    top = forest(ranked(named, ["name"]), ["name"])
    root = top.roots.first()
    return Manifest(sources, top, root["digest"] if root else None)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda d, s: digest(s["left"], d, s["right"]))


def verified(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every row, and whether a copy whose text is lower-cased in every fifth row still proves to be in it."""
    value = {c: docs[f"`{c}`"] for c in COLUMNS}
    touched = F.crc32(value["doc_id"].cast("string").cast("binary")) % 5 == 0
    changed = {**value, "text": F.translate(value["text"], UPPER, LOWER)}
    own = leaf_digest(list(value.values()))
    leaves = docs.select(
        value["source"].alias("tree"), value["doc_id"].alias("id"), own.alias("digest"),
        F.when(touched, leaf_digest(list(changed.values()))).alias("altered"),
    )
    made = manifest(leaves, ["altered"])
    return made.leaves().select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(made.root).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6, top_levels: int = 3) -> str:
    """The same for DuckDB, unrolled: at most 16^levels rows a source and 16^top_levels sources."""
    note = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    leaf = lambda text: "sha256(" + " || ".join([note(c) for c in COLUMNS[:-1]] + [note(text)]) + ")"
    shift = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, 3988292384 * (x % 2)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: {shift}), 4294967295)"
    parts = [
        f"a0 AS (SELECT doc_id, source AS g, {leaf('text')} AS d, {crc} % 5 = 0 AS hit, {leaf(lower)} AS low FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM a0)",
    ]

    def climb(name: str, count: int) -> None:
        for k in range(count):
            group = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            parts.append(
                f"{name}s{k} AS (SELECT g, i, n, coalesce(string_agg(d, '') OVER ({group} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(d, '') OVER ({group} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
            parts.append(
                f"{name}{k + 1} AS (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) "
                f"ELSE max(d) END AS d FROM {name}{k} GROUP BY g, i // 16, n)"
            )

    climb("t", levels)
    parts.append(
        f"u0 AS (SELECT 0 AS g, g AS name, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t{levels})"
    )
    climb("u", top_levels)
    source = "FROM t0 LEFT JOIN u0 ON t0.g IS NOT DISTINCT FROM u0.name "
    source += " ".join(f"LEFT JOIN ts{k} ON ts{k}.g IS NOT DISTINCT FROM t0.g AND ts{k}.i = t0.i // {FANOUT**k}" for k in range(levels))
    source += " " + " ".join(f"LEFT JOIN us{k} ON us{k}.i = u0.i // {FANOUT**k}" for k in range(top_levels))
    steps = [f"ts{k}" for k in range(levels)] + [f"us{k}" for k in range(top_levels)]
    parts.append(
        "j AS (SELECT t0.doc_id, t0.d AS leaf, u0.d AS subroot, CASE WHEN t0.hit THEN t0.low ELSE t0.d END AS f0, "
        + ", ".join(f"{s}.n AS n{k}, {s}.l AS l{k}, {s}.r AS r{k}" for k, s in enumerate(steps)) + f" {source})"
    )
    for k in range(len(steps)):
        before = "j" if k == 0 else f"f{k}"
        parts.append(f"f{k + 1} AS (SELECT *, CASE WHEN n{k} > 1 THEN sha256(l{k} || f{k} || r{k}) ELSE f{k} END AS f{k + 1} FROM {before})")
    proof = " || ".join(f"CASE WHEN n{k} > 1 THEN l{k} || r{k} ELSE '' END" for k in range(len(steps)))
    last = len(steps)
    return (
        "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{last} AS folded_root, "
        f"f{last} = root AS verified FROM f{last}, (SELECT d AS root FROM u{top_levels})"
    )


SQL = _sql()
