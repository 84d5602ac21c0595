"""Unit vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_normalize(vector: Column) -> Column:
    """Unit vector in doubles; null for a vector of length zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    # Held in a row, else the norm would be added up again for each component.
    held = F.array(F.struct(wide.alias("wide"), norm.alias("norm")))
    return F.transform(held, lambda h: F.when(h["norm"] > 0, F.transform(h["wide"], lambda x: x / h["norm"])))[0]
