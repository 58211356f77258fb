"""Clashing names, null ids, repeated rows and plain searches beside the operators' own."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stayline.llm import bpe, fingerprint, linededup, quality, tokencounts, toxicity, warc
from stayline.llm.queries import byte_bpe, table, training
from stayline.session import shared_folder
from tests.llm.test_operators import ODD, frame

SF = "/root/testdata/sf0.001"


def test_line_dedup_lets_columns_of_any_name_through(spark):
    rows = [(i, f"common line\nown {i}", f"s{i}", -1, "r", "g", "a", "b", 5, 6) for i in range(12)]
    names = ["doc_id", "text", "source", "n_lines", "_row", "_gone", "row1", "h1", "n_removed", "own"]
    docs = spark.createDataFrame(rows, names)
    out = linededup.dedup_lines(docs)
    assert out.columns == [*names, "n_lines_", "n_removed_"]
    got = out.orderBy("doc_id").collect()
    assert [tuple(r[c] for c in names if c != "text") for r in got] == [tuple(v for c, v in zip(names, r) if c != "text") for r in rows]
    assert [(r["text"], r["n_lines_"], r["n_removed_"]) for r in got][:2] == [("common line\nown 0", 2, 0), ("own 1", 2, 1)]


def test_sketches_come_from_lines(spark):
    """The sketch's aggregate reads lines, and sites are counted apart for lines near the threshold alone."""
    rows = [(i, f"many\nfew {i // 7}\nnear\nown {i}" if i < 8 else f"many\nfew {i // 7}", f"s{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = linededup._lines(docs.select(
        F.col("doc_id").alias("doc"), F.lit(0).alias("row1"), F.lit(0).alias("row2"), F.xxhash64("source").alias("site"), "text"
    ))
    found = linededup.boilerplate(lines)
    names = {F_: n for n, F_ in ((r["line"], (r["h1"], r["h2"])) for r in spark.createDataFrame([("many",), ("near",), ("few 1",)], "line string")
             .select("line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")).collect())}
    assert {names[r["h1"], r["h2"]] for r in found.collect()} == {"many", "near"}


def test_pipeline_stages_let_clashing_columns_through(spark):
    docs = table(spark, SF, "documents").withColumns({
        "score": F.lit(-1.0), "n_lines": F.lit(-2), "n_removed": F.lit(-3), "text_hash": F.lit(-4), "component_id": F.lit(-5)
    })
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.filter("score <> -1 or n_lines <> -2 or n_removed <> -3 or text_hash <> -4 or component_id <> -5").isEmpty()
        assert out.count() > 0


def naive_density(matcher_weights, text):
    """Every pattern looked for at every place of both foldings."""
    best, spaces = {}, 0
    for fold in toxicity.folded(text):
        spaces = max(spaces, fold.count(" "))
        covered = [(i, i + len(p) + 1) for p in toxicity.EXCEPTIONS for i in range(len(fold)) if fold.startswith(f" {p} ", i)]
        for term, weight in matcher_weights.items():
            for i in range(len(fold)):
                if fold.startswith(term, i) and not any(a <= i < b for a, b in covered):
                    word = fold[: i + 1].count(" ")
                    best[word] = max(best.get(word, 0.0), weight)
    return sum(best.values()) / math.log2(1 + max(spaces, 1))


def test_density_equals_a_naive_search():
    weights = {" idiot ": 4.0, " trash ": 3.0, " clown ": 2.0, " tras": 1.0, " scum ": 2.5, " 1ine ": 1.0}
    matcher = toxicity.Matcher(weights)
    r = random.Random(8)
    words = ["idiot", "1diot", "trash", "can", "bin", "clown", "fish", "pond", "scum", "line", "tr4shy", "a", "Ünï", "іdiоt", "!diot", "l1ne", "."]
    for _ in range(300):
        text = " ".join(r.choices(words, k=r.randrange(0, 25)))
        assert matcher.density(text) == pytest.approx(naive_density(weights, text)), text


def test_matching_long_texts_is_linear():
    import time

    matcher = toxicity.Matcher({" idiot ": 4.0, " trash ": 3.0})
    start = time.time()
    matcher.density("idiot trash can " * 60_000)
    assert time.time() - start < 5


def test_votes_equal_a_full_sort(spark):
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, training(table(spark, SF, "labels")), "quality", max_rows=60)
    terms = quality.Terms()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, neighbours=7).collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        counts = terms.rows([text or ""])
        if not counts.any():
            assert got[doc] == pytest.approx(model.share)
            continue
        near = (model.project(counts) @ model.vectors.T)[0]
        top = np.argsort(-near, kind="stable")[:7]
        weight = np.maximum(near[top], 0) ** 8 + 1e-6
        assert got[doc] == pytest.approx(float((weight * model.labels[top]).sum() / weight.sum()), abs=1e-3)


def test_copies_count_once_whatever_their_ids(spark):
    rows = [(3, "a b"), (None, "a b"), (None, "a b"), (5, "a b"), (None, "x y z"), (None, "x y z"), (7, "q #"), (9, "q #"), (11, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string")
    rollup = tokencounts.Rollup(spark, shared_folder(spark))
    got = {r["version"]: (r["n_docs"], r["n_tokens"]) for r in tokencounts.maintained(docs, rollup).collect()}
    # 3 stays of the first text, both rows of the second, 7 of the third (revised to one token), 11 of the empty ones
    assert got == {"words-1": (5, 2 + 6 + 1), "words-2": (5, 2 + 6 + 1)}
    empty = tokencounts.maintained(docs.limit(0), tokencounts.Rollup(spark, shared_folder(spark)))
    assert empty.count() == 0


def test_revisits_name_records_that_exist(spark):
    pages = spark.createDataFrame(
        [(i, f"http://h/{i % 2}", "same " * 60 if i < 5 else f"other {i}") for i in range(9)] + [(0, "http://z", "same " * 60)],
        "page_id long, url string, html string",
    )
    folder = shared_folder(spark)
    warc.write_archives(pages, folder)
    records = warc.read_records(spark, folder).collect()
    names = {r["record"] for r in records if r["kind"] == "response"}
    refers = [r["refers"] for r in records if r["kind"] == "revisit"]
    assert len(refers) == 4 and set(refers) <= names and len({r["record"] for r in records}) == 10


def test_repeated_pages_in_segments_come_out_each(spark):
    rows = [(1, "u", "long page " * 3000)] * 3 + [(None, "u", "other page " * 3000)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_folder(spark)
    warc.write_archives(pages, folder, segment_bytes=8000)
    got = warc.reassemble(warc.read_records(spark, folder)).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1"] * 3 + ["None"] * 2
    assert not any(r["error"] for r in got)


def test_empty_tables(spark):
    docs = frame(spark, ODD).limit(0)
    assert bpe.round_trip(docs, byte_bpe()).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, labels, "quality")).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels, "toxic")).count() == 0


def test_sums_reach_the_modulus_and_come_back(spark):
    """Wide numbers wrap around, evenly spread, and taking paragraphs away in another order gives the rest's sums."""
    parts = [f"paragraph {i}" for i in range(400)]
    shuffled = random.Random(3).sample(parts, len(parts))
    one = spark.createDataFrame([("\n".join(parts), "\n".join(shuffled), "\n".join(parts[:150]), "\n".join(reversed(parts[150:])))], "a string, b string, c string, d string")
    row = one.select(*[fingerprint.vector(F.col(c)).alias(c) for c in one.columns]).withColumns({
        "both": fingerprint.add_vectors(F.col("c"), F.col("d")), "rest": fingerprint.take_vectors(F.col("b"), F.col("d")),
    }).first()
    assert row["a"] == row["b"] == row["both"] and row["rest"] == row["c"]
    wide = row["a"][-fingerprint.WIDE :]
    assert max(wide) > fingerprint.POWER // 2 > min(wide) and len(set(wide)) == fingerprint.WIDE
    assert len(row["a"]) == 1 + fingerprint.LANES + fingerprint.WIDE
