"""Stable hashes of keys, for sampling that does not depend on partitioning or run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayline.functions.columns import as_col

SPACE = 1 << 32


def hash32(*cols, seed: int | str | None = None) -> Column:
    """The first 32 bits of md5 over the text form of the columns; always in [0, 2^32)."""
    parts = [as_col(c).cast("string") for c in cols]
    if seed is not None:
        parts = [F.lit(str(seed)), *parts]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def unit(*cols, seed: int | str | None = None) -> Column:
    """Uniform number in [0, 1)."""
    return hash32(*cols, seed=seed) / F.lit(float(SPACE))
