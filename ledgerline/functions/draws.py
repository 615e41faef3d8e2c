"""Reproducible draws that any engine can repeat: numbers from the MD5 of keys and a seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws lie in 0 .. RANGE - 1.
RANGE = 1 << 60


def draw(*keys: Column | str, seed: int) -> Column:
    """A number of 60 bits for the keys and the seed; nulls among the keys are left out."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", *(c.cast("string") for c in columns), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw_sql(*keys: str, seed: int) -> str:
    """The same number in DuckDB's SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(keys)}, {seed})), 1, 15) AS BIGINT)"
