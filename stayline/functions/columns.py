"""Small helpers on column arguments."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_list(names: str | Column | Iterable[str]) -> list[str]:
    return [names] if isinstance(names, (str, Column)) else list(names)


def ordered_unique(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))
