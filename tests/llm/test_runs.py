"""Periodic runs against a search of all periods, and the tiles against each other."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from stayline.llm import runs
from stayline.llm.common import narrow
from stayline.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(x, least=24, times=3):
    """(start, length, period) of all runs of a word list, by trying every period."""
    out, n = [], len(x)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                part = x[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(x, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return [w for i, w in enumerate(x) if i not in gone]


def repeating(seed, n):
    """Words with runs of several periods, in and beside each other."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        block = [r.choice("abcdefgh") + str(r.randrange(r.choice([1, 3, 50]))) for _ in range(r.choice([1, 2, 5, 8, 15, 16, 17, 40, 64, 100]))]
        out += (block * 12)[: r.randrange(1, 5 * len(block) + 30)]
        if r.random() < 0.2:
            out += out[-r.randrange(1, len(out)) :] * r.randrange(1, 4)
    return out[:n]


TEXTS = [
    *[" ".join(repeating(s, n)) for s, n in enumerate([10, 23, 24, 60, 100, 250, 400, 700, 900, 1200] * 4)],
    "a " * 23, "a " * 24, "a " * 25, "a\n\tb " * 500, " ".join(f"w{i % 341}" for i in range(1023)),
    " ".join(f"w{i % 341}" for i in range(1022)), " ".join(f"w{i % 7}" for i in range(5000)), "ünï € ñ " * 30, "A a " * 12, "x" * 9000,
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, key string, n long, runs string"
    )


def result(df):
    return sorted(
        ((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, *r)
    )


def expected(rows, least=24, times=3):
    out = []
    for i, t in rows:
        x = words(t)
        found = brute(x, least, times)
        out.append((i, len(x), found, " ".join(kept(x, found))))
    return sorted(out, key=lambda r: (r[0] is not None, *r))


def test_runs_equal_a_search_of_all_periods(spark):
    rows = list(enumerate(TEXTS))
    assert result(runs.collapse_runs(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("least, times", [(1, 3), (6, 3), (12, 4), (40, 5)])
def test_other_lengths_and_powers(spark, least, times):
    rows = list(enumerate(TEXTS[:24]))
    assert result(runs.collapse_runs(frame(spark, rows), least=least, times=times)) == expected(rows, least, times)


def test_small_tiles_are_stitched(spark):
    rows = list(enumerate(TEXTS[20:]))
    made = runs.tiled(narrow(frame(spark, rows), doc="doc_id", text="text"), tile_words=8).filter("block > 0").collect()
    assert len(made) > 5 * len(rows)
    assert result(runs.collapse_runs(frame(spark, rows), tile_words=8)) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, None), (None, "a " * 30), (1, ""), (2, " \n\t"), (3, "b c " * 20), (3, "b c " * 20), (3, "other"), (None, "a " * 30)]
    assert result(runs.collapse_runs(frame(spark, rows))) == expected(rows)
    assert runs.collapse_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(frame(spark, rows), times=2)


def test_z_function():
    r = random.Random(1)
    for _ in range(200):
        x = [r.randrange(2) for _ in range(r.randrange(0, 40))]
        same = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
        assert runs.z_function(x) == same


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc, text in docs:
        x = words(text)
        n, h = len(x), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x, planted = [w if i < a else x[a + (i - a) % p] for i, w in enumerate(x)], planted + 1
        found = brute(x) if n < 1500 else fast(x)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[doc] == {
            "doc_id": doc, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if found else None,
            "runs_sha256": sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
            "collapsed_sha256": sha(" ".join(kept(x, found))),
        }
    assert planted > 5


def fast(x):
    """The same for long texts: equality of all pairs at once, period by period."""
    ids = np.unique(np.array(x), return_inverse=True)[1]
    out = []
    for q in range(1, len(x) // 3 + 1):
        same = np.concatenate(([False], ids[:-q] == ids[q:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            if j - i + q >= max(24, 3 * q) and not any(x[i + d : j + q] == x[i : j + q - d] for d in range(1, q)):
                out.append((i, j - i + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))
