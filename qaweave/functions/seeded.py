"""Seeded draws that do not change when a task is run again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def draw(seed: int, *keys) -> Column:
    """A whole number in [0, 2^32) fixed by the seed and the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def unit_draw(seed: int, *keys) -> Column:
    return draw(seed, *keys) / F.lit(float(DRAW_RANGE))
