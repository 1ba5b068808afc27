"""Description-length arithmetic on integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_log2(n: Column) -> Column:
    """The bits that tell n things apart: 0 up to one, else the bit length of n - 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def margin(collisions: Column, sources: Column) -> Column:
    return ceil_log2(collisions) + F.greatest(sources - 1, F.lit(0))


def certificate(manual: Column, shared: Column, axes: Column, residual: Column, collisions: Column, sources: Column) -> dict[str, Column]:
    """Before, after, margin and savings of replacing ``manual`` objects by one shared object, its axes and residual ones."""
    after = shared + axes + residual
    saved = manual - after - margin(collisions, sources)
    return {"before": manual, "after": after, "margin": margin(collisions, sources), "savings": saved, "pays_rent": saved > 0}


def load_score(n: Column, detectors: Column, files: Column, loc: Column, savings: Column) -> Column:
    return n * 100 + detectors * 25 + files * 10 + F.least(loc, F.lit(100)) + F.least(savings, F.lit(100))
