"""Bounded samples for fitting: rows whose hashed id lies under a threshold set from the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F


def bounded(rows: DataFrame, id_col: str, cols: list, n: int, seed: int) -> list[Row]:
    """About ``n`` rows (all, if there are fewer), the same for the same ids; only they leave their tasks."""
    total = rows.count()
    if not total:
        return []
    part = min(1.0, n / total)
    key = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40))
    kept = rows.where(key < int(part * (1 << 40))) if part < 1 else rows
    return sorted(kept.select(key.alias("_key"), *cols).collect(), key=lambda r: tuple((x is not None, x) for x in r))
