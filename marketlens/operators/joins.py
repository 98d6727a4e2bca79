"""Join helpers: broadcast only behind a size check, shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast bound in rows for dimension-like sides (markets, catalogs).
# Rows of those tables are a few hundred bytes after projection, so this
# keeps a broadcast under roughly 100 MB per executor.
BROADCAST_MAX_ROWS = 500_000


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``small`` has at most ``max_rows`` rows.

    Counts at most ``max_rows + 1`` rows, so the check stays cheap even when
    the side turns out to be large.
    """
    return small.limit(max_rows + 1).count() <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_MAX_ROWS, fits: bool | None = None) -> DataFrame:
    """``big`` join ``small``: broadcast ``small`` when its row count is within
    the bound, otherwise a shuffle (sort-merge) join that AQE may still turn
    into a broadcast at runtime or split when skewed. ``fits`` passes a check
    already made on the same table (or one at least as large)."""
    if fits is None:
        fits = fits_broadcast(small, max_rows)
    if fits:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
