"""Recursive least squares: coefficients that follow a changing system."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import algebra as G
from causeway.functions import matrices as M
from causeway.operators.lags import lagged
from causeway.sources.series import channels


def rls(df: DataFrame, order: int = 1, forgetting: float = 0.99) -> DataFrame:
    """(series_id, k, t, theta array<double>) after each update k = 0, 1, ...: theta is (n, n * order), row by row. One task holds one series."""
    names = channels(df)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        history = M.rls(pdf[names].to_numpy(), order, forgetting)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "k": np.arange(len(history)), "t": pdf["t"].to_numpy()[order:], "theta": list(history.reshape(len(history), -1))})

    return df.select("series_id", "t", *names).groupBy("series_id").applyInPandas(run, "series_id string, k long, t long, theta array<double>")


def rls_coefficients(history: DataFrame, n: int, order: int) -> DataFrame:
    """``history`` with theta as coef, matrix by matrix."""
    order_of = [r * n * order + k * n + c for k in range(order) for r in range(n) for c in range(n)]
    return history.withColumn("coef", F.array(*(F.col("theta")[i] for i in order_of))).drop("theta")


def last_theta(history: DataFrame) -> DataFrame:
    return history.groupBy("series_id").agg(F.max_by("theta", "t").alias("theta"))


def discounted(df: DataFrame, target: str, regressors: tuple[str, str], forgetting: float = 0.99, block: int = 4096) -> DataFrame:
    """(series_id, k, t, b0, b1): the recursion's closed form for one target and two lag-1 regressors, in columns.

    After k updates it is the ridge solution of exponentially discounted sums. Weights are
    rebased in each block of ``block`` updates, so that they neither overflow nor vanish: a block's own sums are a
    window within it; what it inherits is carried once over the blocks' last rows, a task for each series. Times are a grid without gaps.
    """
    a, b = regressors
    start = df.groupBy("series_id").agg(F.min("t").alias("start"))
    rows = lagged(df, list(dict.fromkeys(regressors)), 1).join(start, "series_id").withColumn("k", F.col("t") - F.col("start") - 1).drop("start")
    a1, b1 = F.col(f"{a}_1"), F.col(f"{b}_1")
    products = {"g00": a1 * a1, "g01": a1 * b1, "g11": b1 * b1, "c0": a1 * F.col(target), "c1": b1 * F.col(target)}
    rows = rows.withColumns({"blk": F.floor(F.col("k") / block), "at": F.col("k") % block})
    weight = F.pow(F.lit(forgetting), -F.col("at").cast("double"))
    inner = Window.partitionBy("series_id", "blk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s_{c}": F.sum(v * weight).over(inner) * F.pow(F.lit(forgetting), F.col("at").cast("double")) for c, v in products.items()})
    ends = rows.groupBy("series_id", "blk").agg(F.count("*").alias("n"), *(F.max_by(f"s_{c}", "k").alias(f"e_{c}") for c in products))

    sums = list(products)  # names alone, for the tasks

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        """What a block inherits: the discounted sums at the ends of the blocks before it."""
        pdf = pdf.sort_values("blk")
        held, out = np.zeros(len(sums)), np.empty((len(pdf), len(sums)))
        for k, (n, e) in enumerate(zip(pdf["n"].to_numpy(), pdf[[f"e_{c}" for c in sums]].to_numpy(), strict=True)):
            out[k] = held
            held = held * forgetting ** float(n) + e
        return pd.DataFrame({"series_id": pdf["series_id"].to_numpy(), "blk": pdf["blk"].to_numpy()} | {f"p_{c}": out[:, k] for k, c in enumerate(sums)})

    past = ends.groupBy("series_id").applyInPandas(carried, f"series_id {df.schema['series_id'].dataType.simpleString()}, blk long, " + ", ".join(f"p_{c} double" for c in sums))
    rows = rows.join(past, ["series_id", "blk"])
    faded = F.pow(F.lit(forgetting), F.col("at").cast("double") + 1)
    total = {c: F.col(f"s_{c}") + F.col(f"p_{c}") * faded for c in products}
    ridge = F.pow(F.lit(forgetting), F.col("k").cast("double") + 1) / 1000.0
    b0, b1_ = G.solve([[total["g00"] + ridge, total["g01"]], [total["g01"], total["g11"] + ridge]], [total["c0"], total["c1"]])
    return rows.select("series_id", F.col("k").cast("long").alias("k"), "t", b0.alias("b0"), b1_.alias("b1"))


def overflow_after(forgetting: float) -> int:
    """After so many updates weights without rebasing would leave the range of doubles."""
    return int(709 / -math.log(forgetting))
