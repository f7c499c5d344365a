import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.operators import adaptive, ssm
from causeway.streaming import online


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Two series in three files, samples of each file out of order, and a last row that moves the watermark."""
    top = tmp_path_factory.mktemp("stream")
    r = np.random.default_rng(1)
    n = 60
    frames = []
    for k in ("a", "b"):
        t = np.arange(n)
        frames.append(pd.DataFrame({"series_id": k, "event_time": pd.Timestamp("2024-01-01") + pd.to_timedelta(t, "h"), "t": t, "x0": r.normal(size=n), "x1": r.normal(size=n), "u0": r.normal(size=n)}))
    all_ = pd.concat(frames)
    for i in range(3):
        part = all_[(all_.t >= 20 * i) & (all_.t < 20 * i + 20)].sample(frac=1, random_state=i)
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(f"{top}/in")
    spark.createDataFrame(all_[all_.t == 0].assign(event_time=pd.Timestamp("2025-01-01"), t=9999)).coalesce(1).write.mode("append").parquet(f"{top}/in")
    return f"{top}/in", all_


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, stream, name, tmp_path):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def source(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_rls_is_the_batch(spark, rows, tmp_path):
    path, data = rows
    got = run(spark, online.stream_rls(source(spark, path).drop("u0"), 2, 0.98, "100 days"), "rls", tmp_path).where("t < 9999").orderBy("series_id", "t").toPandas()
    want = adaptive.rls(spark.createDataFrame(data).drop("event_time", "u0"), 2, 0.98).orderBy("series_id", "t").toPandas()
    assert len(got) == len(want) == 116 and np.allclose(np.stack(got.theta), np.stack(want.theta))


def test_streamed_filter_is_the_batch(spark, rows, tmp_path):
    path, data = rows
    p = ([[0.6, 0.3], [0, 0.55]], [[0.5], [0.4]], 0.15 * np.eye(2), 0.6 * np.eye(2))
    named = lambda df: df.withColumnsRenamed({"x0": "y0", "x1": "y1"})
    got = run(spark, online.stream_kalman(named(source(spark, path)), *p, delay="100 days"), "kalman", tmp_path).where("t < 9999").orderBy("series_id", "t").toPandas()
    want = ssm.kalman_smoother(named(spark.createDataFrame(data).drop("event_time")), *p).orderBy("series_id", "t").toPandas()
    assert len(got) == len(want) and np.allclose(np.stack(got.x_filt), np.stack(want.x_filt))


def test_streamed_series_and_moments(spark, rows, tmp_path):
    path, data = rows
    events = source(spark, path).withColumn("kind", F.when(F.col("t") % 2 == 0, "even").otherwise("odd"))
    got = run(spark, online.stream_series(events, "kind", ["even", "odd"], "x0", "4 hours", "100 days"), "series", tmp_path / "s").toPandas()
    assert len(got) == 30 and abs(got[["x0", "x1"]].to_numpy().sum() - data.x0.sum()) < 1e-9
    m = run(spark, online.stream_moments(source(spark, path), ["x0", "x1"], "1 day", "100 days"), "moments", tmp_path / "m").toPandas()
    assert abs(sum(v[3] for v in m.moments) - (data.x0**2).sum()) < 1e-9
