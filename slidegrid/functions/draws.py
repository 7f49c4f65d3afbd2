"""Deterministic pseudorandom draws: the same key gives the same number in any engine, partition and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: Column | str) -> Column:
    """A whole number below 2^32 from an md5 hash of the seed and the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *keys)), 1, 8), 16, 10).cast("bigint")


def draw_sql(seed: int | str, *keys: str) -> str:
    """The same in the oracle's dialect."""
    return f"('0x' || substr(md5(concat_ws('/', '{seed}', {', '.join(keys)})), 1, 8))::bigint"
