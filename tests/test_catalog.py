"""Registered queries against DuckDB on the shared tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = ["series_ship_daily", "gc_pairwise_lag1", "gc_per_user", "gc_sliding", "varx_gc_ridge", "var_fit_order2", "geweke_integral", "rls_discounted", "interp_join", "kalman_scalar", "model_gc_2x2", "hrf_convolve"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return c


def test_entry_has_all_ordered_pairs(spark):
    assert entry.entry(spark).count() == 20


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_is_its_sql(spark, duck, name):
    mine, other = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns) and len(mine) == len(other) > 0
    rows = [sorted(map(tuple, d[columns].astype({c: float for c in columns if d[c].dtype.kind in "iuf"}).itertuples(index=False, name=None))) for d in (mine, other)]
    assert all(p == pytest.approx(q, abs=2e-6) if not isinstance(p, str) else p == q for a, b in zip(*rows) for p, q in zip(a, b))


LARGE = "/root/testdata/sf0.1"  # its hourly sums have a root of 0.966
FACTORED = ["factorized_gc", "reconstruct_from_factor", "reconstruct_from_transfer", "wilson_covariance"]


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="the shared tables are not here")
@pytest.mark.parametrize("name", FACTORED)
def test_factorization_is_its_sql_at_long_memory(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{LARGE}/events.parquet')")
    mine, other = entry.queries()[name](spark, LARGE).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    keys = [k for k in ("series_id", "f_idx", "row", "col") if k in mine]
    mine, other = (d.sort_values(keys)[sorted(d.columns)].reset_index(drop=True) for d in (mine, other))
    assert len(mine) > 0 and mine.equals(other.astype(mine.dtypes))


@pytest.mark.parametrize("name", ["em_ssm", "em_ssm_known_c"])
def test_em_runs_until_it_stops_by_itself(spark, name):
    for r in entry.queries()[name](spark, DATA).collect():
        last = r.log_likelihoods[-2:]
        assert len(r.log_likelihoods) == 50 or abs(last[1] - last[0]) < 1e-4
