"""Matching coded events against pattern tables, flags and scores."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.scalars import normalize_code
from stayline.operators.limits import union_all
from stayline.session import cut_lineage

MAX_BROADCAST_ROWS = 100_000
MAX_PATTERNS = 10_000
MAX_PREFIXES = 10_000  # of one alternative


def small_table(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the table is small; else leave the choice to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _alternatives(body: str) -> list[tuple[str, bool]] | None:
    """(text, whole) of alternatives made of plain characters and character classes."""
    out: list[tuple[str, bool]] = []
    for alternative in body.split("|"):
        whole = alternative.endswith("$") and not alternative.endswith("\\$")
        texts, at = [""], 0
        stop = len(alternative) - whole
        while at < stop:
            char = alternative[at]
            if char == "\\" and at + 1 < stop and not alternative[at + 1].isalnum():
                choices, at = alternative[at + 1], at + 2
            elif char == "[":
                found = re.match(r"\[((?:[A-Za-z0-9,_ ]-[A-Za-z0-9]|[A-Za-z0-9,_ ])+)\]", alternative[at:stop])
                if not found:
                    return None
                spans = re.findall(r"(.)(?:-(.))?", found[1])
                choices = "".join(chr(c) for a, b in spans for c in range(ord(a), ord(b or a) + 1))
                at += len(found[0])
            elif re.match(r"[A-Za-z0-9,_ -]", char):
                choices, at = char, at + 1
            else:
                return None
            texts = [t + c for t in texts for c in dict.fromkeys(choices)]
            if len(texts) > MAX_PREFIXES:
                return None
        out += [(t, whole) for t in texts]
    return out


def literal_prefixes(pattern: str) -> list[tuple[str, bool]] | None:
    """The texts that a code must start with, or equal if whole, to match the pattern; None if it says more than that.

    Such patterns are anchored at the start and have one level of alternatives. Codes don't end in a line feed.
    """
    found = re.fullmatch(r"\^\(([^()]*)\)(\$?)", pattern) or re.fullmatch(r"\^([^()|]*?)(\$?)", pattern)
    texts = _alternatives(found[1]) if found else None
    return None if texts is None else [(t, whole or bool(found[2])) for t, whole in texts]


def prefix_table(patterns: DataFrame, version: str = "icd_version") -> tuple[DataFrame | None, list[int], DataFrame | None]:
    """Patterns as (version, _key, ...) rows with the lengths of their prefixes, and the patterns that stay regular expressions.

    A whole code's key ends with a dollar sign. Tables of more than MAX_PATTERNS rows stay as they are.
    """
    spark, extra = patterns.sparkSession, [c for c in patterns.columns if c not in (version, "pattern")]
    rows = patterns.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        return None, [], patterns
    plain, lengths, rest = {}, set(), []
    for row in rows:
        texts = literal_prefixes(row["pattern"]) if row["pattern"] is not None and row[version] is not None else []
        if texts is None or len(plain) + len(texts) > MAX_BROADCAST_ROWS:
            rest.append(row)
            continue
        for text, whole in texts:
            plain[(int(row[version]), text + "$" * whole, *[row[c] for c in extra])] = None
            lengths |= set() if whole else {len(text)}
    schema = T.StructType([T.StructField(version, T.IntegerType()), T.StructField("_key", T.StringType()), *[patterns.schema[c] for c in extra]])
    table = spark.createDataFrame(list(plain), schema) if plain else None
    return table, sorted(lengths), spark.createDataFrame(rest, patterns.schema) if rest else None


def match_patterns(
    events: DataFrame, patterns: DataFrame, key="hadm_id", code="icd_code", version="icd_version", distinct: bool = True
) -> DataFrame:
    """(key, group, ...) rows for codes that match a pattern of their version, once per key and group.

    Patterns that only list how codes start are a table of prefixes: each event meets it by its own prefixes of the lengths in
    the table, which is broadcast, so events are read once and not shuffled. Other patterns are matched once per distinct
    code. Without `distinct` the rows repeat per event, which max() ignores.
    """
    extra = [c for c in patterns.columns if c not in (version, "pattern")]
    norm = events.select(key, F.col(version).cast("int").alias(version), normalize_code(code).alias("_code"))
    table, lengths, rest = prefix_table(patterns, version)
    found = []
    if table is not None:
        keys = [F.when(F.length("_code") >= n, F.substring("_code", 1, n)) for n in lengths] + [F.concat("_code", F.lit("$"))]
        each = norm.select(key, version, F.explode(F.array(*keys)).alias("_key")).filter("_key is not null")
        found.append(each.join(F.broadcast(table), [version, "_key"]).select(key, *extra))  # at most MAX_BROADCAST_ROWS rows
    if rest is not None or not found:
        found.append(_match_expressions(norm, patterns if rest is None else rest, key, version, extra))
    out = union_all(*found)
    return out.distinct() if distinct else out


def _match_expressions(norm: DataFrame, patterns: DataFrame, key: str, version: str, extra: list[str]) -> DataFrame:
    """Matches of regular expressions: each distinct code is matched once, and the matches are joined back to the events."""
    codes = norm.select(version, "_code").distinct()
    ref = small_table(patterns).alias("p")
    hits = (
        codes.alias("c")
        .join(ref, (F.col(f"c.{version}") == F.col(f"p.{version}")) & F.expr("c._code rlike p.pattern"))
        .select(f"c.{version}", "c._code", *[f"p.{c}" for c in extra])
        .distinct()
    )
    # the matched codes are the small side; the events stream past them without a shuffle
    return norm.join(small_table(cut_lineage(hits)), [version, "_code"]).select(key, *extra)


def group_flags(matches: DataFrame, flags: Mapping[str, str], key="hadm_id") -> DataFrame:
    """One 0/1 column per group. Keys without any match have no row, hence NULL after a left join."""
    return matches.groupBy(key).agg(
        *[F.max(F.when(F.col("group_name") == g, 1).otherwise(0)).alias(name) for g, name in flags.items()]
    )


def distinct_weight_score(weights: Mapping[str, int], flags: Mapping[str, str]) -> Column:
    """Sum of the distinct weights of the flagged groups, from the flag columns."""
    by_weight: dict[int, list[Column]] = {}
    for group, weight in weights.items():
        if group in flags:
            by_weight.setdefault(weight, []).append(F.col(flags[group]))
    total = F.lit(0)
    for weight, cols in by_weight.items():
        total = total + F.lit(weight) * (F.greatest(*cols) if len(cols) > 1 else cols[0])
    return total.cast("long")


def weighted_score(weights: Mapping[str, int], flags: Mapping[str, str]) -> Column:
    """Sum of the weights of the flagged groups; a group without a weight adds 0."""
    total = F.lit(0)
    for group, name in flags.items():
        total = total + F.lit(weights.get(group, 0)) * F.col(name)
    return total.cast("long")


def flags_and_score(
    events: DataFrame, patterns: DataFrame, flags: Mapping[str, str], weights: Mapping[str, int], score: str,
    distinct_weights: bool = False, key="hadm_id", code="icd_code", version="icd_version",
) -> DataFrame:
    """Flags and score of each key from one aggregate."""
    matches = match_patterns(events, patterns, key, code, version, distinct=False)
    wide = group_flags(matches, flags, key)
    rule = distinct_weight_score if distinct_weights else weighted_score
    return wide.withColumn(score, rule(weights, flags))


@dataclass(frozen=True)
class CodeSystem:
    """A pattern table with its flag names, weights and score column."""

    patterns: DataFrame
    flags: Mapping[str, str]
    weights: Mapping[str, int]
    score: str
    distinct_weights: bool = False


def score_systems(
    events: DataFrame, systems: Iterable[CodeSystem], key="hadm_id", code="icd_code", version="icd_version"
) -> DataFrame:
    """Flags and scores of several code systems from one match and one aggregate.

    The flags of a system are NULL for keys that match nothing in it.
    """
    systems = list(systems)
    tables = [
        s.patterns.select(F.lit(i).alias("_sys"), "group_name", version, "pattern") for i, s in enumerate(systems)
    ]
    matches = match_patterns(events, union_all(*tables), key, code, version, distinct=False)
    aggs = []
    for i, s in enumerate(systems):
        here = F.col("_sys") == i
        aggs.append(F.count(F.when(here, 1)).alias(f"_any{i}"))
        aggs += [
            F.max(F.when(here & (F.col("group_name") == g), 1).otherwise(0)).alias(name) for g, name in s.flags.items()
        ]
    wide = matches.groupBy(key).agg(*aggs)
    cols = [F.col(key)]
    for i, s in enumerate(systems):
        rule = distinct_weight_score if s.distinct_weights else weighted_score
        some = F.col(f"_any{i}") > 0
        cols += [F.when(some, F.col(name)).alias(name) for name in s.flags.values()]
        cols.append(F.when(some, rule(s.weights, s.flags)).alias(s.score))
    return wide.select(*cols)


def flag_names(groups: Iterable[str], prefix: str) -> dict[str, str]:
    return {g: f"{prefix}{g}" for g in groups}
