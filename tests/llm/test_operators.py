"""The text operators against brute force, round trips and held-out labels, on small frames and the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayline.llm import bpe, decontaminate, fingerprint, linededup, minhash, quality, tokencounts, toxicity, warc
from stayline.llm.common import shingle_set, word_hashes
from stayline.llm.queries import QUERIES, byte_bpe
from stayline.session import shared_folder

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, doc string, label string, key int"


def frame(spark, texts, first=0):
    """Documents with extra columns whose names operators use themselves."""
    rows = [(first + i if i is not None else None, t, "en", f"s{i % 3}", 0, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " \n\t", "one", "one two three four five", "one two three four five", "ünï ñ €\n\nx", "a" * 5000, "word " * 3000]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_groups(texts, k, percent):
    sets, root = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(n, seed=3):
    """A chain of edits, copies, and texts that share a passage only."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        words = base[:]
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(words))
    out += [" ".join(base[:60] + [f"p{r.randrange(10**6)}" for _ in range(70)]) for _ in range(n)]
    return out


def test_near_groups_equal_brute_force(spark):
    texts = ODD + near_copies(60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(frame(spark, texts), words=4).collect()}
    assert got == brute_groups(dict(enumerate(texts)), 4, 80)


def test_near_groups_of_null_ids_repeated_rows_and_no_rows(spark):
    docs = frame(spark, ["a b c d e f"] * 2).union(frame(spark, ["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = minhash.near_groups(docs.union(docs)).collect()
    assert len(rows) == 6 and {r["component_id"] for r in rows} == {0, None}
    assert minhash.near_groups(frame(spark, ["x"]).limit(0)).count() == 0


def test_components_of_chains_rings_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (9, 7), (3, 9), (9, 3), (5, 5)] + [(200, i) for i in range(150, 230)]
    rng = random.Random(4)
    links += [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(45)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    rows = minhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    alone = {x for x in parent if all(a == b for a, b in links if x in (a, b))}
    assert len(rows) == len(parent) - len(alone)
    assert {r["doc"]: r["label"] for r in rows} == {x: root(x) for x in parent if x not in alone}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_fills_every_bin_and_estimates_similarity():
    r = np.random.default_rng(0)
    items = r.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = minhash.fast_sketch(items[:900]), minhash.fast_sketch(items[100:])
    assert (a != np.iinfo(np.uint64).max).all() and abs((a == b).mean() - 0.8) < 0.12
    assert (minhash.fast_sketch(items[:1]) != np.iinfo(np.uint64).max).all()


def test_word_hashes_keep_to_words():
    hashes, ends = word_hashes([b"A b", b"", b" a\tB \n", b"ab"])
    assert ends.tolist() == [2, 2, 4, 5] and hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[4] not in hashes[:4]
    assert len(shingle_set(hashes[:2], 5)) == 1 and len(shingle_set(hashes[:0], 5)) == 0


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(byte_bpe())
    r = random.Random(1)
    texts = ODD + ["aaa'll 's 've'd", "<|endoftext|>a <|endoftext|>", "՘֋1\U000323b0中"] + [
        "".join(chr(r.choice([r.randrange(32, 127), r.randrange(1, 0x3000), 32, 10])) for _ in range(80)) for _ in range(200)
    ]
    got = {x["doc_id"]: x for x in bpe.round_trip(frame(spark, texts), byte_bpe()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)))
        assert tuple(got[i])[1:] == want
    coded = bpe.encode(frame(spark, texts), byte_bpe())
    back = {x["doc_id"]: x["text"] for x in bpe.decode(coded, byte_bpe()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode_checked(frame(spark, texts), byte_bpe()).filter("not exact").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_passages_with_edits_are_found(spark):
    r = random.Random(5)
    letters = "abcdefghij klmnop "
    passage = "".join(r.choice(letters) for _ in range(150)).strip()
    noise = lambda: "".join(r.choice(letters) for _ in range(300))

    def edited(n):
        out = list(passage)
        for _ in range(n):
            at = r.randrange(len(out))
            out[at : at + r.randrange(2)] = [r.choice("xyz")] * r.randrange(2)
        return "".join(out)

    texts = ODD + [noise() + edited(i % 11) + noise() for i in range(40)] + [noise(), passage[:70] + noise()]
    items = spark.createDataFrame([(1, passage), (2, passage), (3, None), (4, "")], "item_id long, text string")
    found = decontaminate.find(frame(spark, texts), items).collect()
    hit = {x["doc_id"] for x in found}
    assert hit == set(range(len(ODD), len(ODD) + 40)) and {x["item_id"] for x in found} == {1, 2}
    for x in found:
        region = decontaminate.plain(texts[x["doc_id"]])[x["start"] : x["end"]]
        assert distance(decontaminate.plain(passage), region) == x["distance"] <= 0.08 * len(passage)
    kept = decontaminate.clean(frame(spark, texts), items)
    assert kept.count() == len(texts) - 40 and kept.columns == frame(spark, texts).columns
    assert decontaminate.find(frame(spark, texts), items.limit(0)).count() == 0


def lines_of_one_hash():
    """Two printable lines of 16 characters whose xxhash64 with Spark's seed is the same."""
    p1, p2, p4, p5, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, (1 << 64) - 1
    turn = lambda x, n: (x << n | x >> 64 - n) & full
    mix = lambda k: turn(k * p2 & full, 31) * p1 & full
    back = lambda y: turn(y * pow(p1, -1, 1 << 64) & full, 33) * pow(p2, -1, 1 << 64) & full
    state = lambda k: (turn((42 + p5 + 16) & full ^ mix(int.from_bytes(k, "little")), 27) * p1 + p4) & full
    first = b"commonlinecommon"
    for i in range(10**6):
        head = f"{i:08d}".encode()
        tail = back(state(head) ^ state(first[:8]) ^ mix(int.from_bytes(first[8:], "little"))).to_bytes(8, "little")
        if all(33 <= c < 127 for c in tail):
            return first.decode(), (head + tail).decode()


def test_a_line_with_the_hash_of_boilerplate_stays(spark):
    common, clean = lines_of_one_hash()
    lines = spark.createDataFrame([(common, clean)], "a string, b string")
    assert common != clean and lines.filter(F.xxhash64("a") == F.xxhash64("b")).count() == 1
    docs = frame(spark, [f"{common}\nown {i}" for i in range(12)] + [f"{clean}\nown"]).withColumn("source", F.col("doc_id").cast("string"))
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert out[11] == "own 11" and out[12] == f"{clean}\nown"


def test_passages_stay_in_their_document():
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage = noise(200)
    items = decontaminate.Passages([(1, passage)])
    texts = [t for cut in (1, 2, 4, 8, 16) for t in (noise(300), passage[cut:] + noise(300), noise(300) + passage[:-cut])]
    texts += ["", passage[:100], passage[100:], noise(300) + passage[:96], "", passage[104:] + noise(300)]
    batch = pa.record_batch({"text": texts})
    together = list(decontaminate._found(batch, items, "text"))
    assert [len(found) > 0 for found in together] == [False, True, True] * 5 + [False] * 6
    assert together == [next(decontaminate._found(batch.slice(i, 1), items, "text")) for i in range(len(texts))]
    for text, found in zip(texts, together):
        for _, start, end, edits in found:
            assert 0 <= start < end <= len(text) and distance(passage, text[start:end]) == edits


def test_lines_of_many_sites_stay_once(spark):
    rows = [(i, f"common line\nown {i}\n", "en", f"s{i}", 0) for i in range(12)] + [
        (20 + i, f"one site\nb {i}", "en", "hot", 0) for i in range(30)
    ] + [(None, "common line", "en", None, 0), (60, None, "en", "s1", 0), (61, "", "en", "s2", 0), (61, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = linededup.dedup_lines(docs).collect()
    text = {x["doc_id"]: x["text"] for x in out}
    assert text[0] == "common line\nown 0\n" and all(text[i] == f"own {i}\n" for i in range(1, 12))
    assert text[None] == "" and text[25] == "one site\nb 5" and text[60] == "" and len(out) == len(rows)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = ODD + ["p1\np2\np3", "p3\np1\np2", "p1\np2\np4"]
    rows = {x["doc_id"]: x for x in fingerprint.edited_fingerprints(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    n = len(ODD)
    assert rows[n]["fingerprint"] == rows[n + 1]["fingerprint"] != rows[n + 2]["fingerprint"]
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"] and rows[0]["near_edited"] == 1 and rows[n + 2]["near_next"] > 0.3
    one = spark.createDataFrame([("a\nb", "a", "b")], "ab string, a string, b string")
    v = {c: fingerprint.vector(F.col(c)) for c in one.columns}
    both, less = fingerprint.add_vectors(v["a"], v["b"]), fingerprint.take_vectors(v["ab"], v["b"])
    assert one.filter((both == v["ab"]) & (less == v["a"])).count() == 1
    assert fingerprint.edited_fingerprints(frame(spark, texts).limit(0)).count() == 0


def test_likeness_follows_shared_paragraphs_at_any_length(spark):
    def text(side, n, shared):
        return "\n\n".join([f"both {n} {i}" for i in range(int(n * shared))] + [f"{side} {n} {i}" for i in range(int(n * shared), n)])

    sizes, shares = (4, 40, 400, 4000), (0.0, 0.25, 0.5, 0.75, 1.0)
    rows = [(n, s, text("a", n, s), text("b", n, s)) for n in sizes for s in shares]
    pairs = spark.createDataFrame(rows, "n int, share double, a string, b string")
    vectors = pairs.select("n", "share", fingerprint.vector(F.col("a")).alias("a"), fingerprint.vector(F.col("b")).alias("b"))
    for r in vectors.withColumn("near", fingerprint.likeness(F.col("a"), F.col("b"))).collect():
        assert r["near"] == (pytest.approx(r["share"], abs=0.2) if r["share"] < 1 else 1), r["n"]
    same = spark.createDataFrame([("a", ""), ("", "\n"), ("a\nb", "a\n\nb"), ("a", "b")], "a string, b string")
    vectors = same.select(fingerprint.vector(F.col("a")).alias("a"), fingerprint.vector(F.col("b")).alias("b"))
    found = [(r["a"] == r["b"], r["near"]) for r in vectors.withColumn("near", fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    assert found[:3] == [(False, 0), (False, 1), (False, 1)] and not found[3][0] and found[3][1] < 0.3


def test_batches_count_once(spark):
    store = tokencounts.Rollup(spark, shared_folder(spark))
    docs = frame(spark, ODD)
    counts = tokencounts.counted(docs)
    assert store.totals().count() == 0
    assert store.commit("b1", tokencounts.inserts(counts)) and not store.commit("b1", tokencounts.inserts(counts))
    total = lambda v: store.totals().filter(F.col("version") == v).agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    words = sum(len((t or "").split()) for t in ODD)
    assert tuple(total("words-1")) == (len(ODD), words)
    store.commit("b2", tokencounts.deletes(counts.filter("doc_id = 4")))
    store.commit("b3", tokencounts.revisions(counts.filter("doc_id = 3 and version = 'words-1'").withColumn("old_tokens", F.lit(0))))
    assert tuple(total("words-1")) == (len(ODD) - 1, words - 5 + 1)


def test_archives_round_trip(spark):
    big = "é€x" * 40_000
    htmls = [None, "", "small", "small", "long " * 50, "long " * 50, big, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, big]
    rows = [(i, "http://h/\r\nWARC/1.1", h, "clash") for i, h in enumerate(htmls)] + [(None, None, "z" * 200, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = shared_folder(spark)
    warc.write_archives(pages, folder, segment_bytes=10_000)
    records = warc.read_records(spark, folder)
    assert records.filter("kind = 'continuation'").count() > 10 and records.filter("error is not null").count() == 0
    got = {x["page_id"]: x for x in warc.reassemble(records).collect()}
    assert len(got) == len(rows) and not any(x["error"] for x in got.values())
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: x["refers_to"] for i, x in got.items() if x["record_type"] == "revisit"} == {5: 4, 8: 6}
    lost = warc.reassemble(records.filter("number is null or number <> 2")).filter("error is not null")
    assert lost.count() == 1
    assert warc.unframed(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


def test_toxicity_folding_and_exceptions():
    matcher = toxicity.Matcher({" idiot ": 4.0, " clown ": 3.0, " trash ": 3.0, " moro": 2.0})
    for text in ("an idiot", "1D10T!", "c1own", "іdiоt", "TRASH.", "morons"):
        assert matcher.density(text) > 0, text
    for text in ("", "idiotic", "the trash can is full", "a clown fish", "1 2 3"):
        assert matcher.density(text) == 0, text
    assert matcher.density("idiot") > matcher.density("idiot " + "fine " * 50) > 0


def test_classifiers_on_odd_input(spark):
    docs, labels = frame(spark, ODD), spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for module, column in ((toxicity, "toxic"), (quality, "quality")):
        for marks in (labels, labels.limit(0)):
            scores = module.score(docs, module.fit(docs, marks, column)).collect()
            assert len(scores) == len(ODD) and all(0 <= x["score"] <= 1 for x in scores)


@pytest.mark.parametrize("name,column,least", [("op6_toxicity", "toxic", 0.85), ("op9_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, column, least):
    sf = SF.replace("0.001", "0.01")
    rows = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 for x in rows)
    assert np.mean([x["predicted"] == x[column] for x in rows]) >= least


def test_pipeline_keeps_its_promises(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs = after
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = brute_groups(texts, 5, 80)
    assert all(root == i for i, (n, root) in groups.items() if n)
    final = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in final} == set(texts) and all(r["exact"] for r in final)
