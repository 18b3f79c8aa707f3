"""Small column and join helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Column from a name, a Column or a Python literal."""
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    if isinstance(c, int) and not isinstance(c, bool):
        return F.lit(c).cast("long")   # ms arithmetic must not overflow INT
    return F.lit(c)


def key_struct(cols: list[str]) -> Column:
    """One non-NULL key column for ``cols``.  Struct equality treats NULL
    fields as equal, so joins on it are null-safe while staying plain
    equi-joins (hash partitioning on it can be reused by later stages)."""
    if not cols:
        return F.struct(F.lit(0).alias("_"))
    return F.struct(*[F.col(c) for c in cols])


def join_nullsafe(left: DataFrame, right: DataFrame, cols: list[str],
                  how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` treating NULL keys as equal (stream keys may
    be NULL); the right copies of the key columns are dropped."""
    k = key_struct(cols)
    # struct keys only compare equal field type for field type: align the
    # right side's key types to the left's
    ltypes = {f.name: f.dataType for f in left.schema.fields}
    right = right.select(*[F.col(c).cast(ltypes[c]).alias(c) if c in cols else F.col(c)
                           for c in right.columns])
    r = right.select(k.alias("__jk"), F.xxhash64(k).alias("__jh"),
                     *[c for c in right.columns if c not in cols])
    # the key hash leads the join keys so sort-merge joins get a sort prefix
    out = left.select("*", k.alias("__jk"), F.xxhash64(k).alias("__jh")) \
        .join(r, ["__jh", "__jk"], how)
    return out.drop("__jk", "__jh")
