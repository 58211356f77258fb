"""Toxicity scores: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length.

Folding: lower case, compatibility forms and look-alike letters of other scripts become Latin letters, and digits or
signs that stand before a letter inside a word become the letter they imitate (both letters where two fit).
Patterns begin at a word's start and are whole words or stems; of the patterns at one word the heaviest counts.
Matches inside an exception phrase don't count. A text's score rises from 0 with the sum of weights divided by
log2(2 + words); 0.5 is where the labelled rows part best.

The lexicon is learned from at most `max_rows` labelled rows (hash-ordered, a bound on fitting only): words and stems
far more frequent in toxic rows, in enough different neighbourhoods that copies of one text can't make one.

Defined cases: null or empty text scores 0; repeated rows come out once each; without labels of both kinds the
seed lexicon alone is used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import batch_texts, narrow, slices, work_table

MAX_ROWS = 20_000
STEMS = (4, 5, 6)
SURPRISE = 16.0  # log-likelihood ratio a lexicon term needs: four toxic rows, say, where one row in eight is toxic
SEED = ("idiot", "moron", "stupid", "pathetic", "scum", "loser", "worthless", "disgusting")
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clown car", "clown nose", "stupid simple",
    "scum line", "pond scum", "soap scum", "sore loser",
)
# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнгпαβεικνορτυχγωρ", "aeopcyxijsdhkmtbhrnabeiknoptuxywp"))
IMITATED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
_FOLD = str.maketrans(LOOKALIKES)
_FIRST, _SECOND = str.maketrans(IMITATED), str.maketrans(IMITATED | {"1": "l", "!": "l", "|": "l"})
_IMITATION = re.compile(r"[0-9@$!|]+(?=[^\W\d_])")
_GAPS = re.compile(r"[\W\d_]+")


def folded(text: str) -> list[str]:
    """One or two foldings of a text: words between single spaces, with a space at both ends."""
    text = text.lower()
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFKC", text).lower().translate(_FOLD)
    first = _IMITATION.sub(lambda m: m[0].translate(_FIRST), text)
    out = [first]
    if first != text and any(c in text for c in "1!|"):
        second = _IMITATION.sub(lambda m: m[0].translate(_SECOND), text)
        out += [second] if second != first else []
    return [f" {_GAPS.sub(' ', t).strip()} " for t in out]


def terms_of(word: str) -> list[str]:
    """Patterns a word gives: itself, and its stems."""
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) > n)]


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def density(self, text: str) -> float:
        """Sum of the heaviest match per word, over log2(2 + words)."""
        best: dict[int, float] = {}
        spaces = 0
        for fold in folded(text) if self.any else ():
            spaces = max(spaces, fold.count(" "))
            found, covered = [], []
            for end, (size, weight) in self.automaton.iter(fold):
                (covered.append((end - size + 1, end)) if weight is None else found.append((end - size + 1, weight)))
            found.sort()
            covered.sort()
            words = read = span = reach = 0  # one pass over matches and spans, both by their start
            for at, weight in found:
                words += fold.count(" ", read, at + 1)  # both foldings number the words alike
                read = at + 1
                while span < len(covered) and covered[span][0] <= at:
                    reach = max(reach, covered[span][1])
                    span += 1
                if at >= reach:
                    best[words] = max(best.get(words, 0.0), weight)
        return sum(best.values()) / math.log2(1 + max(spaces, 1))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch_texts(batch, "text"), batch.column("label").to_pylist()):
            words = set(folded(text)[0].split())
            counts[label].update({t for w in words for t in terms_of(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch(
            [pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in counts)],
            names=["term", "clean", "toxic"],
        )


def _surprise(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of a term's two counts against one common rate."""
    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-9) / expected)

    both = toxic + clean
    share = n_toxic / (n_toxic + n_clean)
    return 2 * (part(toxic, both * share) + part(clean, both * (1 - share)))


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS,
) -> tuple[dict[str, float], float]:
    """The lexicon and the density that scores 0.5."""
    spark = docs.sparkSession
    seed = {f" {w} ": 4.0 for w in SEED}
    chosen = (
        narrow(labels, doc=id_col, label=label_col).filter("label in (0, 1) and doc is not null")
        .groupBy("doc").agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc"), "doc").limit(max_rows)
    )
    # at most max_rows texts, written once and read by each step below
    sample = work_table(narrow(docs, doc=id_col, text=text_col).join(F.broadcast(chosen), "doc").select("text", "label"))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return seed, 1.0
    counted = sample.mapInArrow(_count_terms, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    least = max(3, round(SURPRISE / (2 * math.log((n_clean + n_toxic) / n_toxic))) if n_toxic < n_clean else 3)
    rows = counted.filter((F.col("toxic") >= least) & (F.col("toxic") * n_clean >= 8 * F.col("clean") * n_toxic)).orderBy(
        F.desc("toxic"), "term"
    ).collect()  # terms of at least three texts of the bounded sample
    toxic, clean = (np.array([r[c] for r in rows], float) for c in ("toxic", "clean"))
    strong = {r["term"] for r, s in zip(rows, _surprise(toxic, clean, n_toxic, n_clean) if rows else ()) if s >= SURPRISE}
    shared = spark.sparkContext.broadcast(strong)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch_texts(batch, "text"):
                words = ["", *folded(text)[0].split(), ""]
                for before, word, after in zip(words, words[1:], words[2:]):
                    seen.update((t, f"{before} {after}") for t in terms_of(word) if t in shared.value)
            yield pa.record_batch([pa.array([s[i] for s in seen], pa.string()) for i in (0, 1)], names=["term", "near"])

    spread = {
        r["term"]: r["n"] for r in sample.filter("label = 1").mapInArrow(contexts, "term string, near string").distinct()
        .groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    weights = dict(seed)
    for row in rows:
        if row["term"] in strong and spread.get(row["term"], 0) >= max(least, 0.5 * row["toxic"]):
            weights[row["term"]] = math.log((row["toxic"] + 0.5) / (n_toxic + 1)) - math.log((row["clean"] + 0.5) / (n_clean + 1))
    table = spark.sparkContext.broadcast(weights)

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(table.value)
        for batch in batches:
            values = [matcher.density(t) for t in batch_texts(batch, "text")]
            yield pa.record_batch([pa.array(values, pa.float64()), batch.column("label")], names=["x", "label"])

    pairs = sorted((r["x"], r["label"]) for r in sample.mapInArrow(densities, "x double, label int").collect())
    values, marks = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    edges = np.flatnonzero(np.diff(values) > 0)  # cut between unequal neighbours
    if not len(edges):
        return weights, 1.0
    wrong = np.cumsum(marks)[edges] + (len(marks) - 1 - edges) - (marks.sum() - np.cumsum(marks)[edges])
    at = edges[int(np.argmin(wrong))]
    return weights, float(values[at] + values[at + 1]) / 2


def score(
    docs: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text",
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> DataFrame:
    """(doc_id, score): x / (x + cut) of each whole text's density x."""
    weights, cut = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, exceptions)
        for batch in batches:
            for part in slices(batch, "text"):
                x = [matcher.density(t) for t in batch_texts(part, "text")]
                yield pa.record_batch([part.column("doc"), pa.array([v / (v + cut) for v in x], pa.float64())], names=["doc", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return narrow(docs, doc=id_col, text=text_col).mapInArrow(run, f"doc {kind}, score double").withColumnRenamed("doc", "doc_id")
