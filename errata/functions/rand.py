"""Deterministic per-row randomness.

``u(seed, id, salt) = int(md5(seed|id|salt)[0:8], 16)`` - a 32-bit draw that
depends only on the row's id and a salt, never on processing order, so every
partition and every re-execution after a lost executor draws the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
# 2**32 + 1: uniform in (0, 1) as (u + 1) / U_DENOM
U_DENOM = 4294967297.0


def draw(id_col: Column | str, salt: Column | str, seed: int = SEED) -> Column:
    """32-bit md5 draw as BIGINT."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    saltc = F.lit(salt) if isinstance(salt, str) else salt
    key = F.concat_ws("|", F.lit(str(seed)), idc.cast("string"), saltc.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def uniform(id_col: Column | str, salt: Column | str, seed: int = SEED) -> Column:
    """Uniform double in (0, 1)."""
    return (draw(id_col, salt, seed) + F.lit(1)) / F.lit(U_DENOM)


def pick_index(id_col: Column | str, salt: Column | str, n: Column) -> Column:
    """Index in [0, n) chosen by the draw."""
    return F.pmod(draw(id_col, salt), n)
