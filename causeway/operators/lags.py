"""Lag columns and sums of products: what every least-squares operator is made of.

All lags of all channels share one window specification, hence one sort. Sums of products combine before
their shuffle, so a block of a series costs one short row however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("series_id",)


#: Samples of a series that are sorted together.
BLOCK = 1 << 18


def lagged(df: DataFrame, names: Sequence[str], order: int, keys: Sequence[str] = KEYS, first: int = 1, block: int = BLOCK) -> DataFrame:
    """``df`` with ``<name>_<k>``, k from ``first`` to ``order``, on a grid of whole times with one row each.

    Rows are left out of which a sample or a lag is null, or of which one of the times up to ``order`` before is missing. A series is cut into blocks of
    ``block`` times, each with a halo of the ``order`` before it: a long one is many tasks.
    """
    if block <= order:
        raise ValueError("a block must be longer than the order")
    home = F.floor(F.col("t") / block)
    # the last samples of a block also go to the next one
    halo = F.when(F.pmod(F.col("t"), F.lit(block)) >= block - order, F.array(home, home + 1)).otherwise(F.array(home))
    w = Window.partitionBy(*keys, "_block").orderBy("t")
    out = df.withColumn("_block", F.explode(halo))
    out = out.withColumns({f"{c}_{k}": F.lag(c, k).over(w) for k in range(first, order + 1) for c in names} | {"_t": F.lag("t", order).over(w)})
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*names, *lag_names(names, order, first)]))
    return out.where((F.col("_block") == home) & (F.col("t") - F.col("_t") == order) & whole).drop("_block", "_t")


def lag_names(names: Sequence[str], order: int, first: int = 1) -> list[str]:
    """Lag by lag, all channels each."""
    return [f"{c}_{k}" for k in range(first, order + 1) for c in names]


class Moments:
    """Sums of products of columns (and the constant "1"), as one array column of its upper triangle."""

    def __init__(self, names: Sequence[str]):
        self.names = ["1", *names]

    def column(self, where: Column | None = None) -> Column:
        def total(a: str, b: str) -> Column:
            value = F.lit(1.0) if b == "1" else F.col(b) if a == "1" else F.col(a) * F.col(b)
            return F.sum(value if where is None else F.when(where, value))

        return F.array(*(total(a, b) for i, a in enumerate(self.names) for b in self.names[i:]))

    def index(self, a: str, b: str) -> int:
        i, j = sorted((self.names.index(a), self.names.index(b)))
        return i * len(self.names) - i * (i - 1) // 2 + j - i

    def __call__(self, a: str, b: str) -> Column:
        return F.col("moments")[self.index(a, b)]

    def of(self, df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
        """(keys, moments), one row for each group."""
        return df.groupBy(*keys).agg(self.column().alias("moments"))
