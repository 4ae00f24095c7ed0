"""Keep long expression chains from being copied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, *columns: str) -> DataFrame:
    """Compute the given columns once per row, whatever is filtered on later.

    A filter is pushed below the projections it refers to, and takes a full copy of their
    expressions along; chains whose steps use earlier steps several times then grow exponentially.
    Nothing is copied through a generator, so the columns pass through one that yields one row.
    """
    others = [c for c in df.columns if c not in columns]
    packed = F.explode(F.array(F.struct(*columns))).alias("_once")
    return df.select(*others, packed).select(*others, "_once.*")
