"""Manifests against a tree built in Python, proofs by folding them, and the dealt query's odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stayline.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, rank int, lo int, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    """(root, path of every leaf), a path being (left, right) texts per level."""
    nodes, paths = [(d, [i]) for i, d in enumerate(digests)], [[] for _ in digests]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 16):
            run = nodes[k : k + 16]
            for j, (_, leaves) in enumerate(run):
                for i in leaves:
                    paths[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            above.append((sha(*[d for d, _ in run]), [i for _, leaves in run for i in leaves]))
        nodes = above
    return (nodes[0][0] if nodes else None), paths


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in by[name]])
    root, above = tree([trees[n][0] for n in names])
    out = []
    for n, up in zip(names, above):
        for row, path in zip(by[n], trees[n][1]):
            path = path + up
            low = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                low = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            fold = leaf(low)
            for a, b in path:
                fold = sha(a, fold, b)
            out.append((row[0], leaf(row), trees[n][0], root, sha(*[x for s in path for x in s]), fold, fold == root))
    return sorted(out, key=str)


def documents(sizes):
    rows, i = [], 0
    for source, size in sizes:
        for _ in range(size):
            i += 7
            rows.append((i, source, "en" if i % 3 else None, i if i % 4 else None, f"Text {i} É" if i % 2 else f"plain {i}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "d", 1, 2, "p") for r in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [
    [("a", 1)], [("a", 16)], [("a", 17)], [("a", 300), ("b", 1), (None, 2), ("é", 257), ("", 5)],
    [(f"s{i}", 1 + i % 3) for i in range(40)],
])
def test_manifest_equals_a_tree_built_in_python(spark, sizes):
    rows = documents(sizes)
    got = manifest.verified(frame(spark, rows)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (None, "a", "", 0, ""), (3, "a", "", 0, "X"), (3, "a", "", 0, "X"),
        (3, "a", "", 0, "other"), (-5, "a", "-", -1, "-"), (10, "b", "1:x", None, "Aé€"),
    ]
    got = manifest.verified(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert manifest.verified(frame(spark, [])).count() == 0


def test_nodes_cover_their_intervals(spark):
    rows = documents([("a", 300), ("b", 40), ("c", 1)])
    docs = frame(spark, rows)
    leaves = docs.select(F.col("source").alias("tree"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    made = manifest.manifest(leaves)
    nodes = [tuple(r) for r in made.nodes().collect()]
    sizes = {"a": [300, 19, 2, 1], "b": [40, 3, 1], "c": [1]}
    for name, counts in sizes.items():
        for level, n in enumerate(counts):
            spans = sorted((lo, hi) for t, k, lo, hi, _ in nodes if t == name and k == level)
            assert len(spans) == n and spans[0][0] == 0 and spans[-1][1] == counts[0]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(nodes) == sum(map(sum, sizes.values()))


def test_a_changed_row_no_longer_proves(spark):
    rows = documents([("a", 50), ("b", 20)])
    leaves = frame(spark, rows).select(F.col("source").alias("tree"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    made = manifest.manifest(leaves)
    again = made.leaves().withColumn("right", manifest.folded(F.col("digest"), F.col("path")) == made.root).withColumn(
        "wrong", manifest.folded(F.sha2(F.lit("x"), 256), F.col("path")) == made.root
    )
    assert again.filter("right and not wrong").count() == 70
