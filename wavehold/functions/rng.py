"""Counter-based draws: a uniform depends only on its key, so any partitioning gives it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(str(x))


def uniform(*parts) -> Column:
    """Uniform in [0, 1) from the md5 of the '|'-joined key parts."""
    key = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_order(*parts) -> Column:
    """Deterministic shuffle key that does not depend on input order."""
    return F.sha2(F.concat_ws("|", *[_col(p).cast("string") for p in parts]), 256)


def normal_pair(*parts) -> tuple[Column, Column]:
    """Two independent standard normals by Box-Muller."""
    u = F.greatest(uniform(*parts, "a"), F.lit(2.0**-33))
    v = uniform(*parts, "b")
    radius = F.sqrt(-2.0 * F.log(u))
    angle = 2.0 * F.lit(3.141592653589793) * v
    return radius * F.cos(angle), radius * F.sin(angle)


def sql_uniform(*parts: str) -> str:
    """The same draw as DuckDB text."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"
