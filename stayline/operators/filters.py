"""Row filters and column selection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions import scalars as S
from stayline.functions.columns import as_col, ordered_unique


def valid_stays(df: DataFrame, start="admittime", end="dischtime", death="deathtime") -> DataFrame:
    """Stays with both times and no death inside the stay."""
    return df.filter(as_col(start).isNotNull() & as_col(end).isNotNull() & as_col(death).isNull())


def died_within(dod, end, days: int = 30) -> Column:
    """True if the death date lies in [date(end), date(end)+days]; False for a NULL date."""
    day = F.to_date(as_col(end))
    d = as_col(dod)
    return d.isNotNull() & d.between(day, F.date_add(day, days))


def exclude_event_window(
    stays: DataFrame, people: DataFrame, key="subject_id", dod="dod", end="dischtime", days: int = 30
) -> DataFrame:
    """Drop stays whose person died within `days` after the end. One row per person in `people`."""
    joined = stays.join(people.select(key, F.col(dod).alias("_dod")), key, "left")
    return joined.filter(~died_within("_dod", end, days)).drop("_dod")


def label_in_list(facts: DataFrame, dim: DataFrame, on: str, label: str, labels: Iterable[str]) -> DataFrame:
    """Facts whose dimension label is listed; the dimension is filtered before the join."""
    return facts.join(dim.filter(F.col(label).isin(*labels)).select(on, label), on)


def nonblank_text(df: DataFrame, text="text") -> DataFrame:
    return df.filter(S.nonblank(text))


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def keep_columns(df: DataFrame, *groups: Iterable[str]) -> DataFrame:
    """Columns in the order listed, each once, skipping names the frame does not have."""
    have = set(df.columns)
    return df.select(*[c for c in ordered_unique(n for g in groups for n in g) if c in have])


def dup_column_names(df: DataFrame) -> dict[str, int]:
    return {n: k for n, k in Counter(df.columns).items() if k > 1}


def first_of_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first column of each repeated name."""
    seen, keep, names = set(), [], []
    for i, name in enumerate(df.columns):
        names.append(f"_c{i}")
        if name not in seen:
            seen.add(name)
            keep.append((f"_c{i}", name))
    return df.toDF(*names).select(*[F.col(a).alias(b) for a, b in keep])


def prefix_columns(df: DataFrame, prefix: str, names: Iterable[str] | None = None) -> DataFrame:
    names = list(names) if names is not None else df.columns
    return df.withColumnsRenamed({n: f"{prefix}{n}" for n in names})


def row_grain(df: DataFrame, stay="stay_id", hadm="hadm_id") -> DataFrame:
    """Mark rows that carry a unit stay, and name each row."""
    s = as_col(stay)
    return df.select(
        F.when(s.isNull(), "ADMISSION_ONLY").otherwise("ICU_STAY").alias("row_grain"),
        F.coalesce(s.cast("string"), F.concat(F.lit("HADM_"), as_col(hadm).cast("string"))).alias("grain_id"),
        "*",
    )


def drop_nonpositive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)


def fill_from_column(df: DataFrame, columns: Iterable[str], source: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, source) for c in columns})


def rows_for_entity(df: DataFrame, key: str, value) -> DataFrame:
    """All rows of one entity without the columns that are constant there (NULL counts as a value)."""
    rows = df.filter(F.col(key) == value)
    varying = rows.agg(*[(varies(c)).alias(c) for c in df.columns]).first()
    return rows.select(*[c for c in df.columns if varying[c]])


def varies(c: str) -> Column:
    """Aggregate: true if the column has two distinct values, NULL counted as one."""
    mixed = (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
    return F.coalesce(F.min(c) < F.max(c), F.lit(False)) | mixed


def derived_features(
    df: DataFrame, start="admittime", end="dischtime", text="note_text", birth="birth_date", sex="sex"
) -> DataFrame:
    """Stay length in whole hours and days, text flag, age at start and sex."""
    return df.select(
        "*",
        S.whole_hours(start, end).alias("los_hours"),
        S.whole_days(start, end).alias("los_days"),
        F.when(S.nonblank(text), 1).otherwise(0).alias("has_text"),
        S.age_years(birth, start).alias("age_at_admission"),
        as_col(sex).alias("sex_at_admission"),
    )
