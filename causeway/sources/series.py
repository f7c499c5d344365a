"""Regularly sampled series out of tables: wide rows (series_id, t, x0, x1, ...), gaps filled with zero.

Times become integer buckets, sums of money are exact decimals before they are doubles, and a
series' grid comes from its first and last bucket, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
RETURN_FLAGS = ["A", "N", "R"]
HOUR, DAY = 3600, 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(ts: Column, seconds: int, origin: str) -> Column:
    """The number of whole spans of ``seconds`` since ``origin``; the session's time zone must be UTC for zoned times."""
    return F.floor((F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.lit(origin).cast("timestamp"))) / seconds).cast("long")


def regular(rows: DataFrame, keys: list[str], channel: str, names: list, value: Column, first: int | None = None, last: int | None = None) -> DataFrame:
    """Sums of ``value`` by ``keys``, bucket ``t`` and channel, one column for each of ``names``, on each t of a series.

    A series goes from its first to its last bucket, and from ``first`` and to ``last`` if these are beyond; no row is left out. Two partial aggregations on the same keys; the grid is
    generated, not collected.
    """
    sums = [F.coalesce(F.sum(F.when(F.col(channel) == n, value.cast("decimal(18,4)"))), F.lit(0)).cast("double").alias(f"x{k}") for k, n in enumerate(names)]
    wide = rows.groupBy(*keys, "t").agg(*sums)
    ends = rows.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    low, high = (F.col("a") if first is None else F.least("a", F.lit(first))), (F.col("b") if last is None else F.greatest("b", F.lit(last)))
    grid = ends.select(*keys, F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("t"))
    return grid.join(wide, [*keys, "t"], "left").select(*keys, "t", *(F.coalesce(f"x{k}", F.lit(0.0)).alias(f"x{k}") for k in range(len(names))))


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of events' values, a channel for each type; from 2024-01-01, or the first event if that is before, to the last."""
    rows = table(spark, sf_dir, "events").select(F.lit("events").alias("series_id"), bucket(F.col("ts"), HOUR, "2024-01-01").alias("t"), "event_type", "value")
    return regular(rows, ["series_id"], "event_type", EVENT_TYPES, F.col("value"), 0)


def events_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lit("events").alias("series_id"), bucket(F.col("ts"), DAY, "2024-01-01").alias("t"), "event_type")
    return regular(rows, ["series_id"], "event_type", EVENT_TYPES, F.lit(1), 0)


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of orders' prices by priority, from 1995-01-01 or before."""
    rows = table(spark, sf_dir, "orders").select(F.lit("orders").alias("series_id"), bucket(F.col("o_orderdate"), DAY, "1995-01-01").alias("t"), "o_orderpriority", "o_totalprice")
    return regular(rows, ["series_id"], "o_orderpriority", PRIORITIES, F.col("o_totalprice"), 0)


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue by return flag, from 1995-01-02 or before."""
    revenue = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    rows = table(spark, sf_dir, "lineitem").select(F.lit("ships").alias("series_id"), bucket(F.col("l_shipdate"), DAY, "1995-01-02").alias("t"), "l_returnflag", revenue.alias("revenue"))
    return regular(rows, ["series_id"], "l_returnflag", RETURN_FLAGS, F.col("revenue"), 0)


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short series for each user: an event's value and the seconds since the event before."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("x0"), seconds.alias("s"))
    rows = rows.withColumn("t", F.row_number().over(w).cast("long") - 1).withColumn("x1", F.coalesce(F.col("s") - F.lag("s").over(w), F.lit(0.0)))
    return rows.select(F.col("user_id").cast("string").alias("series_id"), "t", "x0", "x1")


def embedding_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as trials of 64 samples of two channels: even and odd places; grouped by label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("series_id"), F.col("vec_id").alias("trial_id"), F.posexplode("embedding").alias("place", "v"))
    pair = [F.max(F.when(F.col("place") % 2 == k, F.col("v").cast("double"))).alias(f"x{k}") for k in range(2)]
    return rows.groupBy("series_id", "trial_id", F.floor(F.col("place") / 2).cast("long").alias("t")).agg(*pair)


def channels(df: DataFrame) -> list[str]:
    """The channel columns x0, x1, ... in order."""
    return sorted((c for c in df.columns if c[:1] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def to_long(wide: DataFrame) -> DataFrame:
    """(series_id, t, channel, value)."""
    names = channels(wide)
    pairs = F.explode(F.array(*(F.struct(F.lit(int(c[1:])).alias("channel"), F.col(c).alias("value")) for c in names)))
    return wide.select("series_id", "t", pairs.alias("p")).select("series_id", "t", "p.channel", "p.value")


def to_wide(long: DataFrame, n: int) -> DataFrame:
    """The reverse: channels 0 to n - 1."""
    return long.groupBy("series_id", "t").agg(*(F.max(F.when(F.col("channel") == k, F.col("value"))).alias(f"x{k}") for k in range(n)))


def to_vectors(wide: DataFrame) -> DataFrame:
    """(series_id, t, y array<double>)."""
    return wide.select("series_id", "t", F.array(*channels(wide)).alias("y"))


def from_vectors(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.select("series_id", "t", *(F.col("y")[k].alias(f"x{k}") for k in range(n)))


def reader(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Any source Spark reads (parquet, orc, csv, json, jdbc, ...), with the schema given for text formats."""
    source = spark.read.format(kind).options(**options)
    return (source.schema(schema) if schema else source).load(path)


def writer(df: DataFrame, path: str, kind: str = "parquet", keys: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """``df`` in any format Spark writes, partitioned by ``keys``."""
    out = df.write.format(kind).mode(mode)
    (out.partitionBy(*keys) if keys else out).save(path)


def show(df: DataFrame, rows: int = 20) -> None:
    """The first rows on standard output."""
    df.show(rows, truncate=False)
