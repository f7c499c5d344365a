"""The registered queries over the shared tables, and the same rows in DuckDB's SQL.

Doubles are rounded, since the engines add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import algebra as G
from causeway.functions.algebra import Sql
from causeway.operators import adaptive, gc_spectral, gc_time, report, signal, spectral, ssm, var
from causeway.operators.lags import lag_names
from causeway.plans import sql as Q
from causeway.sources import series as R
from causeway.sources import simulate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
N = 64  # points of a frequency grid
SHORT = 129


def query(oracle: str | Q.Rel | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = str(oracle)
        return f

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _round(rel: Q.Rel, *keep: str, **digits: int) -> Q.Rel:
    return rel.pick(*keep, **{c: f"round({c}, {d})" for c, d in digits.items()})


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as channel 0, clicks as channel 1, views as an input, in hundreds."""
    e = R.events_hourly(spark, sf_dir)
    return e.select("series_id", "t", (F.col("x2") / 100.0).alias("x0"), (F.col("x0") / 100.0).alias("x1"), (F.col("x4") / 100.0).alias("u0"))


def pair_model(spark: SparkSession, sf_dir: str, order: int = 1) -> DataFrame:
    return var.fit_var(pair(spark, sf_dir).drop("u0"), order)


# sources


def _register_series(name: str, build: Callable, rel: Q.Rel, n: int) -> None:
    def run(spark, sf_dir):
        return rounded(build(spark, sf_dir), **{f"x{k}": 4 for k in range(n)})

    run.__name__ = name
    query(_round(rel, "series_id", "CAST(t AS BIGINT) AS t", **{f"x{k}": 4 for k in range(n)}))(run)


for _name, _build, _rel, _n in (
    ("series_events_hourly", R.events_hourly, Q.EVENTS, 5),
    ("series_events_daily_counts", R.events_daily_counts, Q.COUNTS, 5),
    ("series_orders_daily", R.orders_daily, Q.ORDERS, 5),
    ("series_ship_daily", R.ship_daily, Q.SHIPS, 3),
    ("series_user_panel", R.user_panel, Q.USERS, 2),
):
    _register_series(_name, _build, _rel, _n)


@query("SELECT CAST(label AS VARCHAR) AS series_id, vec_id AS trial_id, CAST((p - 1) // 2 AS BIGINT) AS t, round(max(CASE WHEN (p - 1) % 2 = 0 THEN CAST(embedding[p] AS DOUBLE) END), 6) AS x0, round(max(CASE WHEN (p - 1) % 2 = 1 THEN CAST(embedding[p] AS DOUBLE) END), 6) AS x1 FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) GROUP BY ALL")
def series_embedding_trials(spark, sf_dir):
    return rounded(R.embedding_trials(spark, sf_dir), x0=6, x1=6)


@query(Q.Rel(" UNION ALL ".join(f"SELECT series_id, CAST(t AS BIGINT) AS t, {k} AS channel, round(x{k}, 3) AS value FROM ({Q.COUNTS})" for k in range(5))))
def series_long_form(spark, sf_dir):
    return rounded(R.to_long(R.events_daily_counts(spark, sf_dir)), value=3)


@query(_round(Q.COUNTS, "series_id", "CAST(t AS BIGINT) AS t", x0=3, x1=3, x2=3, x3=3, x4=3))
def series_round_trip(spark, sf_dir):
    wide = R.events_daily_counts(spark, sf_dir)
    return rounded(R.to_wide(R.to_long(R.from_vectors(R.to_vectors(wide), 5)), 5), **{f"x{k}": 3 for k in range(5)})


# time domain

_GC = {"sigma_full": 4, "sigma_reduced": 4, "gc": 6}


def _lagged(order: int) -> Q.Rel:
    return Q.lagged(Q.PAIR, ["x0", "x1", "u0"], order)


def _pair_sums(order: int, extra: tuple[str, ...] = ()) -> Q.Rel:
    return Q.moments(_lagged(order), ["x0", "x1", *lag_names(["x0", "x1"], order), *extra])


@query(_round(Q.gc(_pair_sums(1), "x0", ["x0_1"], ["x0_1", "x1_1"]), "series_id", "n_obs", **_GC))
def gc_pairwise_lag1(spark, sf_dir):
    return rounded(gc_time.pairwise_gc(pair(spark, sf_dir), "x1", "x0", 1), **_GC)


@query(_round(Q.gc(_pair_sums(1), "x0", ["x0_1"], ["x0_1", "x1_1"]), "series_id", "n_obs", **_GC))
def gc_time_domain(spark, sf_dir):
    return rounded(gc_time.time_domain_gc(pair(spark, sf_dir), "x1", "x0", 1), **_GC)


@query(_round(Q.gc(_pair_sums(2), "x0", ["x0_1", "x0_2"], lag_names(["x0", "x1"], 2)), "series_id", "n_obs", **_GC))
def gc_pairwise_lag2(spark, sf_dir):
    return rounded(gc_time.pairwise_gc(pair(spark, sf_dir), "x1", "x0", 2), **_GC)


_SCALED = Q.scaled(Q.EVENTS, 100.0, [f"x{k}" for k in range(5)])


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.events_hourly(spark, sf_dir)
    return e.withColumns({f"x{k}": F.col(f"x{k}") / 100.0 for k in range(5)})


def _all_pairs_sql() -> str:
    names = [f"x{k}" for k in range(5)]
    sums = Q.moments(Q.lagged(_SCALED, names, 1), [*names, *lag_names(names, 1)])
    parts = [_round(Q.gc(sums, f"x{t}", [f"x{t}_1"], [f"x{t}_1", f"x{s}_1"]), "series_id", f"{s} AS source", f"{t} AS target", "n_obs", **_GC) for t in range(5) for s in range(5) if s != t]
    return " UNION ALL ".join(map(str, parts))


@query(_all_pairs_sql())
def gc_all_pairs(spark, sf_dir):
    return rounded(gc_time.all_pairs_gc(hourly(spark, sf_dir), 1), **_GC)


@query(_round(Q.gc(Q.moments(Q.lagged(_SCALED, ["x0", "x1", "x2"], 1), ["x2", "x2_1", "x0_1", "x1_1"]), "x2", ["x2_1", "x1_1"], ["x2_1", "x0_1", "x1_1"]), "series_id", "n_obs", **_GC))
def gc_conditional_lag1(spark, sf_dir):
    return rounded(gc_time.conditional_gc(hourly(spark, sf_dir), "x0", "x2", ["x1"], 1), **_GC)


_USERS = Q.Rel(f"SELECT series_id, t, x0 / 100.0 AS x0, x1 / 10000.0 AS x1 FROM ({Q.USERS})")


@query(_round(Q.gc(Q.moments(Q.lagged(_USERS, ["x0", "x1"], 1), ["x0", "x0_1", "x1_1"]), "x0", ["x0_1"], ["x0_1", "x1_1"]), "series_id", "n_obs", **_GC))
def gc_per_user(spark, sf_dir):
    users = R.user_panel(spark, sf_dir).withColumns({"x0": F.col("x0") / 100.0, "x1": F.col("x1") / 10000.0})
    return rounded(gc_time.pairwise_gc(users, "x1", "x0", 1), **_GC)


#: users by the last digit of their number: as they are, with a zero, a constant, a repeated and a combined channel, a constant target
_DEGENERATE = Q.Rel(f"""SELECT series_id, t, CASE WHEN k = 5 THEN 3.0 ELSE x0 END AS x0, CASE k WHEN 1 THEN 0.0 WHEN 2 THEN 7.0 WHEN 3 THEN 2 * x0 ELSE x1 END AS x1,
    CASE WHEN k = 4 THEN x0 - x1 ELSE x0 * x1 END AS x2 FROM (SELECT *, CAST(series_id AS BIGINT) % 6 AS k FROM ({_USERS}))""")


def degenerate_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = R.user_panel(spark, sf_dir).withColumns({"x0": F.col("x0") / 100.0, "x1": F.col("x1") / 10000.0})
    k = F.col("series_id").cast("long") % 6
    return users.select(
        "series_id", "t", F.when(k == 5, 3.0).otherwise(F.col("x0")).alias("x0"), F.when(k == 1, 0.0).when(k == 2, 7.0).when(k == 3, 2 * F.col("x0")).otherwise(F.col("x1")).alias("x1"),
        F.when(k == 4, F.col("x0") - F.col("x1")).otherwise(F.col("x0") * F.col("x1")).alias("x2"),
    )


_PANEL_GC = {"sigma_full": 4, "sigma_reduced": 4, "gc": 5}


def _panel(rel: Q.Rel) -> Q.Rel:
    return rel.pick("series_id", "n_obs", sigma_full="round(sigma_full, 4)", sigma_reduced="round(sigma_reduced, 4)", gc="round(gc, 5) + 0.0")  # no negative zeros


def _panel_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, **_PANEL_GC).withColumn("gc", F.col("gc") + 0.0)


@query(_panel(Q.guarded_gc(Q.moments(Q.lagged(_DEGENERATE, ["x0", "x1", "x2"], 1), ["x0", "x0_1", "x2_1", "x1_1"]), "x0", ["x0_1", "x2_1"], ["x0_1", "x1_1", "x2_1"])))
def gc_degenerate_panel(spark, sf_dir):
    """Constant, zero, repeated and collinear channels among ordinary ones."""
    return _panel_rounded(gc_time.conditional_gc(degenerate_panel(spark, sf_dir), "x1", "x0", ["x2"], 1))


@query(_panel(Q.guarded_gc(Q.moments(Q.lagged(_DEGENERATE, ["x0", "x1"], 1), ["x0", "x0_1", "x1_1"]), "x0", ["x0_1"], ["x0_1", "x1_1"])))
def gc_degenerate_pairwise(spark, sf_dir):
    return _panel_rounded(gc_time.pairwise_gc(degenerate_panel(spark, sf_dir), "x1", "x0", 1))


_SHIPS = Q.scaled(Q.SHIPS, 1e5, ["x0", "x1", "x2"])
_WINDOWS = Q.Rel(f"SELECT l.*, w.range AS w FROM ({Q.lagged(_SHIPS, ['x0', 'x1'], 1)}) l JOIN (SELECT unnest(range(0, (max(t) + 1 - 500) // 100 + 1)) AS range FROM ({_SHIPS})) w ON l.t BETWEEN w.range * 100 + 1 AND w.range * 100 + 499")


@query(Q.gc(Q.moments(_WINDOWS, ["x0", "x0_1", "x1_1"], "series_id, w"), "x0", ["x0_1"], ["x0_1", "x1_1"]).pick("series_id", w="CAST(w AS BIGINT)", window_start="CAST(w * 100 AS BIGINT)", center="CAST(w * 100 + 250 AS BIGINT)", gc="round(gc, 6)"))
def gc_sliding(spark, sf_dir):
    ships = R.ship_daily(spark, sf_dir).withColumns({f"x{k}": F.col(f"x{k}") / 1e5 for k in range(3)})
    return rounded(gc_time.sliding_gc(ships, "x1", "x0", 500, 100), gc=6)


@query(_round(Q.gc(_pair_sums(1, ("u0",)), "x0", ["x0_1", "u0"], ["x0_1", "x1_1", "u0"]), "series_id", "n_obs", **_GC))
def varx_gc(spark, sf_dir):
    return rounded(gc_time.varx_gc(pair(spark, sf_dir), ["u0"], "x1", "x0", 1, 1), **_GC)


@query(_round(Q.gc(_pair_sums(1, ("u0",)), "x0", ["x0_1", "u0"], ["x0_1", "x1_1", "u0"], 10.0), "series_id", "n_obs", **_GC))
def varx_gc_ridge(spark, sf_dir):
    return rounded(gc_time.varx_gc(pair(spark, sf_dir), ["u0"], "x1", "x0", 1, 1, 10.0), **_GC)


@query(_round(Q.gc(_pair_sums(1, ("u0",)), "x0", ["x0_1", "u0"], ["x0_1", "x1_1", "u0"]), "series_id", "n_obs", **_GC))
def varx_gc_joined(spark, sf_dir):
    """The input out of another table, met by an equi-join on series and time."""
    both = pair(spark, sf_dir)
    return rounded(gc_time.varx_gc(gc_time.with_inputs(both.drop("u0"), both.select("series_id", "t", "u0")), ["u0"], "x1", "x0", 1, 1), **_GC)


@query(_round(Q.gc(_pair_sums(1), "x0", ["x0_1"], ["x0_1", "x1_1"]), "series_id", "n_obs", **_GC))
def varx_gc_without_input(spark, sf_dir):
    """The ordinary model for comparison."""
    return rounded(gc_time.ordinary_gc(pair(spark, sf_dir), "x1", "x0", 1), **_GC)


def _varx_sql() -> str:
    x = ["x0_1", "x1_1", "u0"]
    rel = Q.moments(_lagged(1), ["x0", "x1", *x])
    for y in ("x0", "x1"):
        rel = Q.fitted(rel, y, x, f"v_{y}")
    cells = [(r, name, f"v_x{r}_b{k}") for r in range(2) for k, name in enumerate(x)]
    return " UNION ALL ".join(f"SELECT series_id, {r} AS target, '{name}' AS regressor, round({v}, 6) AS value FROM ({rel})" for r, name, v in cells)


@query(_varx_sql())
def varx_fit(spark, sf_dir):
    m = gc_time.fit_varx(pair(spark, sf_dir), ["u0"], 1, 1)
    cells = [F.struct(F.lit(r).alias("target"), F.lit(n).alias("regressor"), F.col("a")[2 * r + k].alias("value")) for r in range(2) for k, n in enumerate(("x0_1", "x1_1"))]
    cells += [F.struct(F.lit(r).alias("target"), F.lit("u0").alias("regressor"), F.col("b")[r].alias("value")) for r in range(2)]
    return rounded(m.select("series_id", F.explode(F.array(*cells)).alias("v")).select("series_id", "v.*"), value=6)


# models

MODEL1, MODEL2 = Q.model(Q.PAIR, 1), Q.model(Q.PAIR, 2)


def _coefficients_sql(rel: Q.Rel, order: int) -> str:
    return " UNION ALL ".join(f"SELECT series_id, {k} AS lag, {r} AS row, {c} AS col, round(c{k}{r}{c}, 6) AS value FROM ({rel})" for k in range(1, order + 1) for r in range(2) for c in range(2))


@query(_coefficients_sql(MODEL1, 1))
def var_fit_order1(spark, sf_dir):
    return rounded(var.coefficients(pair_model(spark, sf_dir), 2), value=6)


@query(_coefficients_sql(MODEL2, 2))
def var_fit_order2(spark, sf_dir):
    return rounded(var.coefficients(pair_model(spark, sf_dir, 2), 2), value=6)


@query(_coefficients_sql(MODEL1, 1))
def var_fit_factorized(spark, sf_dir):
    """The path for collinear series, taken by all."""
    return rounded(var.coefficients(var.fit_var_exact(pair(spark, sf_dir).drop("u0"), 1), 2), value=6)


@query(_round(Q.Rel(f"SELECT series_id, n_obs, s00, s01, s11 FROM ({MODEL1})"), "series_id", "n_obs", s00=4, s01=4, s11=4))
def var_residual_cov(spark, sf_dir):
    m = pair_model(spark, sf_dir)
    return rounded(m.select("series_id", "n_obs", *(F.col("sigma")[i].alias(n) for i, n in ((0, "s00"), (1, "s01"), (3, "s11")))), s00=4, s01=4, s11=4)


_RESIDUALS = Q.Rel(f"SELECT l.series_id, l.t, x0 - c100 * x0_1 - c101 * x1_1 AS r0, x1 - c110 * x0_1 - c111 * x1_1 AS r1 FROM ({_lagged(1)}) l JOIN ({MODEL1}) m ON l.series_id = m.series_id")


@query(_round(_RESIDUALS, "series_id", "CAST(t AS BIGINT) AS t", r0=5, r1=5))
def var_residuals(spark, sf_dir):
    df = pair(spark, sf_dir).drop("u0")
    return rounded(var.residuals(df, var.fit_var(df, 1), 1), r0=5, r1=5)


_ACF_LAGS = 10


def _acf_sql() -> str:
    lags = ", ".join(f"lag(r{c}, {k}) OVER w AS r{c}_{k}" for c in range(2) for k in range(1, _ACF_LAGS + 1))
    rel = f"SELECT *, {lags} FROM ({_RESIDUALS}) WINDOW w AS (PARTITION BY series_id ORDER BY t)"
    return " UNION ALL ".join(f"SELECT series_id, {c} AS channel, {k} AS lag, round(corr(r{c}, r{c}_{k}), 6) AS acf FROM ({rel}) GROUP BY series_id" for c in range(2) for k in range(1, _ACF_LAGS + 1))


@query(_acf_sql())
def residual_acf(spark, sf_dir):
    df = pair(spark, sf_dir).drop("u0")
    return rounded(var.autocorrelation(var.residuals(df, var.fit_var(df, 1), 1), _ACF_LAGS), acf=6)


@query(MODEL1.stage(radius=G.spectral_radius_2x2(*(Sql(f"c1{r}{c}") for r in range(2) for c in range(2)))).pick("series_id", spectral_radius="round(radius, 6)", stable="radius < 1"))
def var_stability(spark, sf_dir):
    return rounded(var.stability(pair_model(spark, sf_dir), 2).select("series_id", "spectral_radius", "stable"), spectral_radius=6)


def _criteria_sql(order: int) -> Q.Rel:
    n, k = f"(n_obs + {order})", 4 * order
    logdet = "ln(s00 * s11 - s01 * s01)"
    return Q.model(Q.PAIR, order).pick("series_id", p=order, aic=f"round({logdet} + 2.0 * {k} / {n}, 6)", bic=f"round({logdet} + ln({n}) * {k} / {n}, 6)")


@query(_criteria_sql(1))
def information_criteria(spark, sf_dir):
    return rounded(var.criteria(pair_model(spark, sf_dir), 2, F.col("n_obs") + F.col("p")), aic=6, bic=6)


_MOST = 10


def _orders_sql(most: int) -> str:
    out = []
    for p in range(1, most + 1):
        n, k = f"(n_obs + {p})", 4 * p
        logdet = "ln(s00 * s11 - s01 * s01)"
        out.append(str(Q.eliminated_model(Q.PAIR, p).pick("series_id", p=p, aic=f"round({logdet} + 2.0 * {k} / {n}, 6)", bic=f"round({logdet} + ln({n}) * {k} / {n}, 6)")))
    return " UNION ALL ".join(out)


_ORDERS = _orders_sql(_MOST)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(var.select_order(pair(spark, sf_dir).drop("u0"), _MOST), aic=6, bic=6)


@query(_ORDERS)
def order_selection(spark, sf_dir):
    return orders(spark, sf_dir)


@query(f"SELECT series_id, p, aic, bic FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY bic, p) AS k FROM ({_ORDERS})) WHERE k = 1")
def best_order(spark, sf_dir):
    return var.best_order(orders(spark, sf_dir))


@query(f"SELECT series_id, CAST(2 * 2 * {2} AS INTEGER) AS n_parameters FROM ({MODEL2})")
def parameter_count(spark, sf_dir):
    return pair_model(spark, sf_dir, 2).select("series_id", F.lit(var.count_parameters(2, 2)).alias("n_parameters"))


@query(" UNION ALL ".join(f"SELECT series_id, {i} AS i, round({v}, 6) AS value FROM ({MODEL2})" for i, v in enumerate(("c100", "c101", "c200", "c201", "c110", "c111", "c210", "c211"))))
def stacked_coefficients(spark, sf_dir):
    """[A1 A2] row by row."""
    m = var.stacked(pair_model(spark, sf_dir, 2), 2)
    return rounded(m.select("series_id", F.posexplode("theta").alias("i", "value")), value=6)


# frequency domain

SPECTRUM = {"omega": 6, "re": 5, "im": 5}


def _spectrum(rel: Q.Rel) -> Q.Rel:
    # no negative zeros
    return rel.pick("series_id", "f_idx", "row", "col", omega="round(omega, 6)", re="round(re, 5) + 0.0", im="round(im, 5) + 0.0")


def _plain(df: DataFrame) -> DataFrame:
    out = rounded(df.select("series_id", "f_idx", "row", "col", "omega", "re", "im"), **SPECTRUM)
    return out.withColumns({"re": F.col("re") + 0.0, "im": F.col("im") + 0.0})


@query(_spectrum(Q.long_form(Q.transfer(MODEL1, 1, N), "a")))
def lag_polynomial(spark, sf_dir):
    return _plain(spectral.lag_polynomials(pair_model(spark, sf_dir), 2, N))


@query(_spectrum(Q.long_form(Q.transfer(MODEL1, 1, N), "h")))
def transfer_function(spark, sf_dir):
    return _plain(spectral.long_form(spectral.transfer_pair(pair_model(spark, sf_dir), 1, N), "h"))


@query(_spectrum(Q.long_form(Q.transfer(MODEL2, 2, N), "h")))
def transfer_function_general(spark, sf_dir):
    """The path for any number of channels."""
    return _plain(spectral.transfer_functions(pair_model(spark, sf_dir, 2), 2, N))


DENSITY = Q.long_form(Q.density(MODEL1, 1, N), "s")


def pair_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.long_form(spectral.density_pair(pair_model(spark, sf_dir), 1, N), "s")


@query(_spectrum(DENSITY))
def var_spectral_density(spark, sf_dir):
    return _plain(pair_density(spark, sf_dir))


_POWER = DENSITY.where("row = 0 AND col = 0").pick("series_id", "f_idx", omega="round(omega, 6)", value="round(re, 5)")


@query(_POWER)
def power_spectrum(spark, sf_dir):
    return rounded(spectral.power(pair_density(spark, sf_dir), 0), omega=6, value=5)


@query(f"SELECT series_id, f_idx, omega, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, f_idx) AS k FROM ({_POWER})) WHERE k = 1")
def dominant_frequency(spark, sf_dir):
    return spectral.dominant(rounded(spectral.power(pair_density(spark, sf_dir), 0), omega=6, value=5))


@query(f"SELECT series_id, f_idx, omega, round(value / max(value) OVER (PARTITION BY series_id), 6) AS value FROM ({_POWER})")
def normalized_spectrum(spark, sf_dir):
    return rounded(spectral.normalized(rounded(spectral.power(pair_density(spark, sf_dir), 0), omega=6, value=5)), value=6)


_CURVE = {"omega": 6, "gc": 6}


@query(_round(Q.plain_gc(MODEL1, 1, N), "series_id", "f_idx", **_CURVE))
def spectral_gc(spark, sf_dir):
    return rounded(gc_spectral.spectral_gc(pair_model(spark, sf_dir), 1, N), **_CURVE)


@query(_round(Q.geweke_gc(MODEL1, 1, N), "series_id", "f_idx", **_CURVE))
def geweke_gc(spark, sf_dir):
    return rounded(gc_spectral.geweke_gc(pair_model(spark, sf_dir), 1, N), **_CURVE)


@query(f"SELECT series_id, round(sum(part) / {math.pi!r}, 6) AS integral FROM (SELECT series_id, (gc + lag(gc) OVER w) / 2 * (omega - lag(omega) OVER w) AS part FROM ({Q.geweke_gc(MODEL1, 1, N)}) WINDOW w AS (PARTITION BY series_id ORDER BY f_idx)) GROUP BY series_id")
def geweke_integral(spark, sf_dir):
    return rounded(spectral.integral(gc_spectral.geweke_gc(pair_model(spark, sf_dir), 1, N)), integral=6)


_eig = G.eigen_hermitian(Sql("s00_re"), Sql("s11_re"), Sql("s01_re"), Sql("s01_im"))


@query(Q.density(MODEL1, 1, N).stage(low=_eig[0], high=_eig[1]).pick("series_id", "f_idx", min_eigenvalue="round(low, 4)", condition="round(greatest(high, 1e-15) / greatest(low, 1e-15), 4)"))
def spectrum_diagnostics(spark, sf_dir):
    e = spectral.eigenvalues(pair_density(spark, sf_dir))
    return rounded(e.select("series_id", "f_idx", "min_eigenvalue", "condition"), min_eigenvalue=4, condition=4)


@query(f"SELECT series_id, round(median(high / low), 4) AS condition FROM (SELECT series_id, greatest(high, 1e-15) AS high, greatest(low, 1e-15) AS low FROM ({Q.density(MODEL1, 1, N).stage(low=_eig[0], high=_eig[1])})) GROUP BY series_id")
def median_condition(spark, sf_dir):
    return rounded(spectral.median_condition(spectral.eigenvalues(pair_density(spark, sf_dir))), condition=4)


@query(f"SELECT series_id, round(max(sqrt(pow(s01_re - s10_re, 2) + pow(s01_im + s10_im, 2))), 6) AS hermitian_error FROM ({Q.density(MODEL1, 1, N)}) GROUP BY series_id")
def hermitian_error(spark, sf_dir):
    return rounded(spectral.hermitian_error(pair_density(spark, sf_dir)), hermitian_error=6)


@query(_spectrum(Q.Rel(f"SELECT * REPLACE (re + CASE WHEN row = col THEN 0.5 ELSE 0 END AS re) FROM ({DENSITY})")))
def spectrum_regularized(spark, sf_dir):
    return _plain(spectral.regularized(pair_density(spark, sf_dir), 0.5))


_TRACE = f"SELECT *, sum(CASE WHEN row = col THEN re END) OVER (PARTITION BY series_id, f_idx) * 0.01 / 2 AS load FROM ({DENSITY})"


@query(_spectrum(Q.Rel(f"SELECT * REPLACE (re + CASE WHEN row = col THEN load ELSE 0 END AS re) FROM ({_TRACE})")))
def spectrum_regularized_relative(spark, sf_dir):
    return _plain(spectral.regularized_relative(pair_density(spark, sf_dir), 0.01))


@query(_spectrum(Q.Rel(f"SELECT * REPLACE (re + load + CASE WHEN row = col THEN 1.0 ELSE 0 END AS re) FROM ({_TRACE})")))
def spectrum_regularized_as_coded(spark, sf_dir):
    return _plain(spectral.regularized_relative(pair_density(spark, sf_dir), 0.01, as_coded=True))


_HERMITIAN = f"SELECT a.series_id, a.f_idx, a.omega, a.row, a.col, (a.re + b.re) / 2 + CASE WHEN a.row = a.col THEN 0.25 ELSE 0 END AS re, (a.im - b.im) / 2 AS im FROM ({DENSITY}) a JOIN ({DENSITY}) b ON a.f_idx = b.f_idx AND a.row = b.col AND a.col = b.row"


@query(_spectrum(Q.Rel(_HERMITIAN)))
def spectrum_hermitian(spark, sf_dir):
    return _plain(spectral.hermitian(pair_density(spark, sf_dir), 0.25))


@query(_spectrum(DENSITY.where("TRUE").pick("series_id", "f_idx", "omega", "re", "im", row="1 - row", col="1 - col")))
def spectrum_submatrix(spark, sf_dir):
    """Channels in the reverse order."""
    return _plain(spectral.submatrix(pair_density(spark, sf_dir), [1, 0]))


_DENSITY_SHORT = Q.long_form(Q.density(MODEL1, 1, SHORT), "s")
_TWO_SIDED = f"SELECT series_id, f_idx, omega, row, col, re, im FROM ({_DENSITY_SHORT}) UNION ALL SELECT series_id, {2 * SHORT - 2} - f_idx, {2 * math.pi!r} - omega, row, col, re, -im FROM ({_DENSITY_SHORT}) WHERE f_idx BETWEEN 1 AND {SHORT - 2}"


def _short_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.long_form(spectral.density_pair(pair_model(spark, sf_dir), 1, SHORT), "s")


@query(_spectrum(Q.Rel(_TWO_SIDED)))
def two_sided_spectrum(spark, sf_dir):
    return _plain(spectral.two_sided(_short_density(spark, sf_dir)))


@query(_spectrum(_DENSITY_SHORT))
def one_sided_spectrum(spark, sf_dir):
    return _plain(spectral.one_sided(spectral.two_sided(_short_density(spark, sf_dir)), 2 * SHORT - 2))


_ROUGH = {"omega": 6, "re": 3, "im": 3}
_BACK = _DENSITY_SHORT.pick("series_id", "f_idx", "row", "col", omega="round(omega, 6)", re="round(re, 3) + 0.0", im="round(im, 3) + 0.0") if isinstance(_DENSITY_SHORT, Q.Rel) else ""


def _back(df: DataFrame) -> DataFrame:
    out = rounded(df.select("series_id", "f_idx", "row", "col", "omega", "re", "im"), **_ROUGH)
    return out.withColumns({"re": F.col("re") + 0.0, "im": F.col("im") + 0.0})


@query(_BACK)
def reconstruct_from_factor(spark, sf_dir):
    """The product of the factors is the spectrum that was factorized."""
    return _back(spectral.reconstruct_from_factor(spectral.wilson_factor(_short_density(spark, sf_dir), 200, 1e-11, 1e-12)))


@query(_BACK)
def reconstruct_from_transfer(spark, sf_dir):
    return _back(spectral.reconstruct_from_transfer(spectral.wilson_factor(_short_density(spark, sf_dir), 200, 1e-11, 1e-12)))


@query(f"SELECT series_id, round(max(sqrt(gap) / (sqrt(size) + 1e-12)), 6) AS error FROM (SELECT series_id, f_idx, sum(CASE WHEN row = col THEN 0.25 ELSE 0 END) AS gap, sum(re * re + im * im) AS size FROM ({DENSITY}) GROUP BY 1, 2) GROUP BY 1")
def max_relative_error(spark, sf_dir):
    s = pair_density(spark, sf_dir)
    return rounded(spectral.max_relative_error(s, spectral.regularized(s, 0.5)), error=6)


@query(MODEL1.where("TRUE").pick("series_id", row="0", col="0", value="round(s00, 3)"))
def wilson_covariance(spark, sf_dir):
    """The factorization of a model's spectrum gives back the innovations' variance."""
    w = spectral.wilson_factor(_short_density(spark, sf_dir), 200, 1e-9, 1e-10)
    return w.where("f_idx = 0 AND row = 0 AND col = 0").select("series_id", "row", "col", F.round(F.col("covariance")[0], 3).alias("value"))


@query()
def wilson_factor(spark, sf_dir):
    return spectral.wilson_factor(_short_density(spark, sf_dir))


@query(_round(Q.geweke_gc(MODEL1, 1, SHORT), "series_id", "f_idx", omega=4, gc=4))
def factorized_gc(spark, sf_dir):
    """Geweke's measure out of a factorized model spectrum is that of the model."""
    s = _short_density(spark, sf_dir)
    return rounded(gc_spectral.factor_gc(spectral.wilson_factor(s, 200, 1e-11, 1e-12), s), omega=4, gc=4)


@query()
def multitaper_csd(spark, sf_dir):
    return spectral.multitaper_csd(hourly(spark, sf_dir), n_fft=1024)


@query()
def multitaper_trials(spark, sf_dir):
    return spectral.multitaper_csd_trials(R.embedding_trials(spark, sf_dir), n_fft=64)


@query()
def nonparametric_gc(spark, sf_dir):
    return gc_spectral.nonparametric_gc(spectral.multitaper_csd(pair(spark, sf_dir).drop("u0"), n_fft=1024, time_bandwidth=10.0, tapers=9), 0, 1)


@query()
def conditional_spectral_gc(spark, sf_dir):
    return gc_spectral.conditional_spectral_gc(hourly(spark, sf_dir).drop("x3", "x4"), "x1", "x0", ["x2"], 1, N)


# adaptive


def _rls_sql() -> str:
    ff = 0.99
    x = "SELECT series_id, t, x0, x0_1 AS a, x1_1 AS b, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS k FROM (" + str(_lagged(1)) + ")"
    sums = ", ".join(f"sum({v} * pow({ff}, -CAST(k AS DOUBLE))) OVER w * pow({ff}, CAST(k AS DOUBLE)) AS {n}" for n, v in (("g00", "a * a"), ("g01", "a * b"), ("g11", "b * b"), ("c0", "a * x0"), ("c1", "b * x0")))
    rel = Q.Rel(f"SELECT series_id, t, k, {sums}, pow({ff}, k + 1) / 1000.0 AS rd FROM ({x}) WINDOW w AS (PARTITION BY series_id ORDER BY k)")
    b = G.solve([[Sql("g00") + Sql("rd"), Sql("g01")], [Sql("g01"), Sql("g11") + Sql("rd")]], [Sql("c0"), Sql("c1")])
    return str(rel.stage(b0=b[0], b1=b[1]).pick("series_id", k="CAST(k AS BIGINT)", t="CAST(t AS BIGINT)", b0="round(b0, 6)", b1="round(b1, 6)"))


@query(_rls_sql())
def rls_discounted(spark, sf_dir):
    return rounded(adaptive.discounted(pair(spark, sf_dir), "x0", ("x0", "x1"), 0.99, 256), b0=6, b1=6)


@query(_rls_sql())
def rls_recursion(spark, sf_dir):
    """The recursion itself against its closed form."""
    h = adaptive.rls(pair(spark, sf_dir).drop("u0"), 1, 0.99)
    return rounded(h.select("series_id", "k", "t", F.col("theta")[0].alias("b0"), F.col("theta")[1].alias("b1")), b0=6, b1=6)


@query(f"SELECT series_id, b0, b1 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS n FROM ({_rls_sql()})) WHERE n = 1")
def rls_last(spark, sf_dir):
    h = adaptive.last_theta(adaptive.rls(pair(spark, sf_dir).drop("u0"), 1, 0.99))
    return rounded(h.select("series_id", F.col("theta")[0].alias("b0"), F.col("theta")[1].alias("b1")), b0=6, b1=6)


def _rls_rel(order: int, ff: float, base: Q.Rel = Q.PAIR) -> Q.Rel:
    """series_id, t, k, b<target>_<regressor>: the closed form for two channels, by elimination of discounted sums."""
    x = lag_names(["x0", "x1"], order)
    rows = f"SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS k FROM ({Q.lagged(base, ['x0', 'x1'], order)})"
    cells = sorted({tuple(sorted(c)) for c in [(a, b) for a in x for b in x] + [(a, y) for a in x for y in ("x0", "x1")]})
    sums = ", ".join(f"sum({a} * {b} * pow({ff}, -CAST(k AS DOUBLE))) OVER w * pow({ff}, CAST(k AS DOUBLE)) AS {Q.moment(a, b)}" for a, b in cells)
    rel = Q.Rel(f"SELECT series_id, t, k, {sums}, pow({ff}, k + 1) / 1000.0 AS rd FROM ({rows}) WINDOW w AS (PARTITION BY series_id ORDER BY k)")
    moment = lambda a, b: Q.moment(a, b) if "1" not in (a, b) else Sql("1.0")
    for a, b in zip(*(G.elimination(moment, f"x{r}", x, Sql, f"e{r}", Sql("rd"))[:-2] for r in range(2)), strict=True):
        rel = rel.stage(**(a | b))
    return rel.pick("series_id", "t", "k", *(f"e{r}_b{j} AS b{r}_{j}" for r in range(2) for j in range(len(x))))


@query(" UNION ALL ".join(f"SELECT series_id, CAST(k AS BIGINT) AS k, CAST(t AS BIGINT) AS t, {r * 4 + j} AS i, round(b{r}_{j}, 5) + 0.0 AS value FROM ({_rls_rel(2, 0.995)})" for r in range(2) for j in range(4)))
def rls_order2(spark, sf_dir):
    h = adaptive.rls(pair(spark, sf_dir).drop("u0"), 2, 0.995)
    return rounded(h.select("series_id", "k", "t", F.posexplode("theta").alias("i", "value")), value=5).withColumn("value", F.col("value") + 0.0)


def _surface(rel: Q.Rel, n_freqs: int) -> Q.Rel:
    return Q.transfer(rel, 1, n_freqs).stage(gc=G.plain_spectral_gc(Q._named("h"), Q._sigma)).pick("series_id", "t", "f_idx", "omega", "gc")


_EVERY = Q.Rel(f"SELECT series_id, t, b0_0 AS c100, b0_1 AS c101, b1_0 AS c110, b1_1 AS c111, 1.0 AS s00, 0.0 AS s01, 1.0 AS s11 FROM ({_rls_rel(1, 0.99)}) WHERE k % 20 = 0")


@query(_round(_surface(_EVERY, SHORT), "series_id", "CAST(t AS BIGINT) AS t", "f_idx", omega=5, gc=5))
def adaptive_gc_surface(spark, sf_dir):
    h = adaptive.rls_coefficients(adaptive.rls(pair(spark, sf_dir).drop("u0"), 1, 0.99), 2, 1)
    return rounded(gc_spectral.adaptive_surface(h, 1, 20, SHORT), omega=5, gc=5)


_OWN_GRID = [0.05, 0.3, 0.31, 1.0, 2.5, 3.1]


@query(_round(_surface(_EVERY, _OWN_GRID), "series_id", "CAST(t AS BIGINT) AS t", "f_idx", omega=5, gc=5))
def adaptive_gc_on_own_grid(spark, sf_dir):
    """Over time at the caller's frequencies."""
    h = adaptive.rls_coefficients(adaptive.rls(pair(spark, sf_dir).drop("u0"), 1, 0.99), 2, 1)
    return rounded(gc_spectral.adaptive_surface(h, 1, 20, _OWN_GRID), omega=5, gc=5)


# signals

_HRF_FINE = "SELECT range AS i, pow(range * 0.1, 5) * exp(-range * 0.1) / 120.0 - pow(range * 0.1, 15) * exp(-range * 0.1) / 1307674368000.0 / 6 AS v FROM range(320)"
_HRF = f"SELECT CAST(k AS BIGINT) AS k, v / sum(v) OVER () AS weight FROM (SELECT i // 10 AS k, v FROM ({_HRF_FINE}) WHERE i % 10 = 0)"


@query(f"SELECT k, round(weight, 8) AS weight FROM ({_HRF})")
def hrf_kernel(spark, sf_dir):
    return rounded(signal.hrf_kernel(spark, 1.0), weight=8)


@query(f"SELECT e.series_id, CAST(e.t AS BIGINT) AS t, round(sum(b.x0 * h.weight), 6) AS x0 FROM ({Q.PAIR}) e JOIN ({_HRF}) h ON h.k <= e.t JOIN ({Q.PAIR}) b ON b.t = e.t - h.k GROUP BY ALL")
def hrf_convolve(spark, sf_dir):
    out = signal.convolve(pair(spark, sf_dir).select("series_id", "t", "x0"), signal.hrf_kernel(spark, 1.0), ["x0"])
    return rounded(out.select("series_id", "t", "x0"), x0=6)


@query(f"SELECT series_id, CAST(t AS BIGINT) AS t, round((x0 - avg(x0) OVER ()) / (stddev_pop(x0) OVER () + 1e-12), 6) AS x0_z FROM ({Q.PAIR})")
def zscore(spark, sf_dir):
    return rounded(signal.zscore(pair(spark, sf_dir), ["x0"]).select("series_id", "t", "x0_z"), x0_z=6)


@query(f"SELECT series_id, CAST(t // 6 AS BIGINT) AS t, round(x0, 4) AS x0 FROM ({Q.PAIR}) WHERE t % 6 = 0")
def downsample(spark, sf_dir):
    return rounded(signal.downsample(pair(spark, sf_dir), 6).select("series_id", "t", "x0"), x0=4)


@query(f"SELECT series_id, CAST(t AS BIGINT) AS t, round(x0, 4) AS x0 FROM ({Q.PAIR}) WHERE t < 100")
def first_samples(spark, sf_dir):
    return rounded(signal.prefix(pair(spark, sf_dir), 100).select("series_id", "t", "x0"), x0=4)


@query(f"SELECT a.series_id, round(g.range * 2.5, 1) AS x, round(a.x0 + (coalesce(b.x0, a.x0) - a.x0) * (least(g.range * 2.5, a.top) - a.t), 6) AS v FROM range(300) g JOIN (SELECT *, max(t) OVER () AS top FROM ({Q.PAIR})) a ON a.t = floor(least(g.range * 2.5, a.top)) LEFT JOIN ({Q.PAIR}) b ON b.t = a.t + 1")
def interp_join(spark, sf_dir):
    curve = pair(spark, sf_dir).select("series_id", F.col("t").cast("double").alias("x"), F.col("x0").alias("v"))
    at = spark.range(300).select(F.lit("events").alias("series_id"), (F.col("id") * 2.5).alias("x"))
    return rounded(signal.interpolate(curve, at, "x", "v"), x=1, v=6)


# state space

_A, _B, _QQ, _RR = 0.8, 0.1, 1.0, 4.0
_KALMAN = f"""
WITH RECURSIVE d AS (SELECT t, x0 AS y, u0 AS u FROM ({Q.PAIR})), k AS (
    SELECT t, 0.0::DOUBLE + 100.0 / (100.0 + {_RR}) * y AS x, 100.0 * {_RR} / (100.0 + {_RR}) AS p FROM d WHERE t = 0
    UNION ALL
    SELECT t, m + v / (v + {_RR}) * (y - m), v * {_RR} / (v + {_RR}) FROM (
        SELECT d.t, d.y, {_A} * k.x + {_B} * d.u AS m, {_A} * {_A} * k.p + {_QQ} AS v FROM k JOIN d ON d.t = k.t + 1))
SELECT 'events' AS series_id, CAST(t AS BIGINT) AS t, round(x, 6) AS x_filt, round(p, 6) AS p_filt FROM k"""


def _observed(spark: SparkSession, sf_dir: str, n: int = 1) -> DataFrame:
    return pair(spark, sf_dir).select("series_id", "t", *(F.col(f"x{k}").alias(f"y{k}") for k in range(n)), "u0")


@query(_KALMAN)
def kalman_scalar(spark, sf_dir):
    f = ssm.kalman_smoother(_observed(spark, sf_dir), [[_A]], [[_B]], [[_QQ]], [[_RR]])
    return rounded(f.select("series_id", "t", F.col("x_filt")[0].alias("x_filt"), F.col("p_filt")[0].alias("p_filt")), x_filt=6, p_filt=6)


@query()
def kalman_smoother(spark, sf_dir):
    return ssm.kalman_smoother(_observed(spark, sf_dir, 2), [[0.6, 0.3], [0, 0.55]], [[0.5], [0.4]], 0.15 * np.eye(2), 0.6 * np.eye(2))


@query()
def em_ssm(spark, sf_dir):
    return ssm.em(_observed(spark, sf_dir, 2))


@query()
def em_ssm_known_c(spark, sf_dir):
    return ssm.em(_observed(spark, sf_dir, 2), c=[[1, 0.35], [0.25, 1]])


_INV = np.linalg.pinv(np.array([[1, 0.35], [0.25, 1]]))


@query(f"SELECT series_id, CAST(t AS BIGINT) AS t, round({_INV[0, 0]!r} * x0 + {_INV[0, 1]!r} * x1, 6) AS x0, round({_INV[1, 0]!r} * x0 + {_INV[1, 1]!r} * x1, 6) AS x1 FROM ({Q.PAIR})".replace("np.float64(", "(") )
def latent_proxy(spark, sf_dir):
    return rounded(ssm.latent_proxy(_observed(spark, sf_dir, 2).drop("u0"), [[1, 0.35], [0.25, 1]]), x0=6, x1=6)


@query(f"SELECT series_id, round(avg((pow(x0 - x1, 2) + pow(x1 - u0, 2)) / 2), 4) AS mse FROM ({Q.PAIR}) GROUP BY series_id")
def mean_squared_error(spark, sf_dir):
    return rounded(ssm.mean_squared_error(pair(spark, sf_dir), ["x0", "x1"], ["x1", "u0"]), mse=4)


_p = G.stationary_2x2(lambda r, c: Sql(f"c1{r}{c}"), lambda r, c: Sql(f"s{r}{c}"))


@query(MODEL1.stage(p00=_p[0], p01=_p[1], p11=_p[2]).pick("series_id", p00="round(p00, 4)", p01="round(p01, 4)", p11="round(p11, 4)"))
def lyapunov_2x2(spark, sf_dir):
    return rounded(ssm.stationary_pair(pair_model(spark, sf_dir)), p00=4, p01=4, p11=4)


@query(MODEL1.stage(p00=_p[0], p01=_p[1], p11=_p[2]).pick("series_id", p00="round(p00, 4)", p01="round(p01, 4)", p11="round(p11, 4)"))
def lyapunov_general(spark, sf_dir):
    c = ssm.stationary_covariance(pair_model(spark, sf_dir), 2)
    return rounded(c.select("series_id", *(F.col("covariance")[i].alias(n) for i, n in ((0, "p00"), (1, "p01"), (3, "p11")))), p00=4, p01=4, p11=4)


_MODEL_GC = f"""
WITH RECURSIVE m AS ({MODEL1.stage(p00=_p[0], p01=_p[1], p11=_p[2])}), r AS (
    SELECT 0 AS i, series_id, p00, p01, p11 FROM m
    UNION ALL
    SELECT r.i + 1, r.series_id, c101 * c101 * e + s00, c101 * c111 * e + s01, c111 * c111 * e + s11
    FROM (SELECT *, p11 - p01 * p01 / p00 AS e FROM r) r JOIN m ON m.series_id = r.series_id WHERE r.i < 200)
SELECT r.series_id, round(ln(p00 / m.s00), 6) AS gc FROM (SELECT * FROM r WHERE i = 200) r JOIN (SELECT series_id, s00 FROM m) m ON m.series_id = r.series_id"""


@query(_MODEL_GC)
def model_gc_2x2(spark, sf_dir):
    return rounded(ssm.model_gc(pair_model(spark, sf_dir), 2, 1, 0), gc=6)


@query()
def model_gc_matrix(spark, sf_dir):
    return ssm.model_gc_matrix(var.fit_var(hourly(spark, sf_dir), 1), 5)


# simulators


@query()
def simulate_var(spark, sf_dir):
    return simulate.var_data(spark, [[[0.5, 0.8], [0, 0.8]]], np.eye(2), 5000)


@query()
def simulate_piecewise_var(spark, sf_dir):
    return simulate.piecewise_var(spark, [[[[0.5, 0.8], [0, 0.8]]], [[[0.5, 0.1], [0, 0.8]]]], [5000], np.eye(2), 10_000)


@query()
def simulate_smooth_var(spark, sf_dir):
    return simulate.smooth_var(spark, np.eye(2), 5000)


@query()
def simulate_resonant_var2(spark, sf_dir):
    return simulate.smooth_var(spark, np.eye(2), 5000, resonant=True)


@query()
def simulate_colored_input(spark, sf_dir):
    return simulate.colored_input(spark, 5000)


@query()
def simulate_varx(spark, sf_dir):
    return simulate.varx_data(spark, [[[0.5, 0.3], [0, 0.5]]], [[[0], [0.9]], [[0], [0]], [[0.9], [0]]], 0.5 * np.eye(2), 5000, 0.95)


@query()
def simulate_ssm(spark, sf_dir):
    return simulate.ssm_data(spark, [[0.6, 0.3], [0, 0.55]], [[0.5], [0.4]], 0.15 * np.eye(2), 0.6 * np.eye(2), 3000)


@query()
def simulate_fmri(spark, sf_dir):
    return simulate.fmri_data(spark, [[[0.5, 0.3], [0, 0.5]]], [[[0], [0.8]], [[0], [0]], [[0.8], [0]]], 0.5 * np.eye(2), 5000)


# charts


def _points(chart: str, rel, series: str, x: str, y: str, z: str | None = None) -> str:
    last = f", round({z}, 4) + 0.0 AS z" if z else ""
    return f"SELECT '{chart}' AS chart, {series} AS series, round(CAST({x} AS DOUBLE), 4) + 0.0 AS x, round(CAST({y} AS DOUBLE), 4) + 0.0 AS y{last} FROM ({rel})"


def _named(text: str) -> str:
    return f"'{text}'"


def _sliding_sql(rel: Q.Rel, window: int, step: int) -> Q.Rel:
    """series_id, center, gc of two channels at lag 1."""
    some = f"SELECT unnest(range(0, (max(t) + 1 - {window}) // {step} + 1)) AS range FROM ({rel})"
    rows = Q.Rel(f"SELECT l.*, w.range AS w FROM ({Q.lagged(rel, ['x0', 'x1'], 1)}) l JOIN ({some}) w ON l.t BETWEEN w.range * {step} + 1 AND w.range * {step} + {window - 1}")
    return Q.gc(Q.moments(rows, ["x0", "x0_1", "x1_1"], "series_id, w"), "x0", ["x0_1"], ["x0_1", "x1_1"]).pick("series_id", "gc", center=f"w * {step} + {window // 2}")


def _smooth_sql(base: str, a: float, b: float, q: float, r: float) -> str:
    """t, x of a scalar filter and smoother over t, y, u."""
    return f"""WITH RECURSIVE d AS ({base}), k AS (
        SELECT t, 100.0::DOUBLE / (100.0 + {r}) * y AS x, 100.0::DOUBLE * {r} / (100.0 + {r}) AS p, 0.0::DOUBLE AS m, 100.0::DOUBLE AS v FROM d WHERE t = 0
        UNION ALL SELECT t, m + v / (v + {r}) * (y - m), v * {r} / (v + {r}), m, v FROM (SELECT d.t, d.y, {a} * k.x + {b} * d.u AS m, {a} * {a} * k.p + {q} AS v FROM k JOIN d ON d.t = k.t + 1)),
        s AS (SELECT t, x FROM k WHERE t = (SELECT max(t) FROM d)
        UNION ALL SELECT k.t, k.x + k.p * {a} / n.v * (s.x - n.m) FROM s JOIN k ON k.t = s.t - 1 JOIN k n ON n.t = s.t)
        SELECT * FROM s"""


_COUPLED = Q.Rel(f"SELECT series_id, t, c * coalesce(lag(x1) OVER (PARTITION BY series_id ORDER BY t), 0.0) + u0 AS x0, x1, c AS coupling FROM (SELECT *, 0.8 - 0.7 * t / max(t) OVER (PARTITION BY series_id) AS c FROM ({Q.PAIR}))")
_FEW = 48
_DENSITY_FEW = Q.long_form(Q.density(MODEL1, 1, _FEW), "s")
_NOISY = f"SELECT t, x0 + x1 - u0 AS y, u0 AS u FROM ({Q.PAIR})"
_MIX = np.linalg.inv(np.array(report.MIXING))
_MIXED = f"SELECT series_id, t, {report.MIXING[0][0]} * x0 + {report.MIXING[0][1]} * x1 + 0.5 * u0 AS y0, {report.MIXING[1][0]} * x0 + {report.MIXING[1][1]} * x1 AS y1 FROM ({Q.PAIR})"
_PROXY = f"SELECT t, {float(_MIX[0, 0])!r} * y0 + {float(_MIX[0, 1])!r} * y1 AS y, 0.0 AS u FROM ({_MIXED})"
_BOLD = f"SELECT e.t, sum(b.x0 * h.weight) AS v FROM ({Q.PAIR}) e JOIN ({_HRF}) h ON h.k <= e.t JOIN ({Q.PAIR}) b ON b.t = e.t - h.k WHERE e.t % 6 = 0 GROUP BY e.t"
_SURFACE = Q.Rel(f"SELECT series_id, t, b0_0 AS c100, b0_1 AS c101, b1_0 AS c110, b1_1 AS c111, 1.0 AS s00, 0.0 AS s01, 1.0 AS s11 FROM ({_rls_rel(1, 0.99)}) WHERE k % 40 = 0")


_omega = f"omega / {math.pi!r}"
_scaled_power = lambda k: f"SELECT *, re / max(re) OVER (PARTITION BY series_id) AS part FROM ({_DENSITY_FEW}) WHERE row = {k} AND col = {k}"
CHARTS = {
    "spectral_gc": _points("spectral_gc", Q.plain_gc(MODEL1, 1, _FEW), "series_id", _omega, "gc"),
    "residual_acf": _points("residual_acf", f"SELECT * FROM ({_acf_sql()}) WHERE lag <= 5", "'channel ' || channel", "lag", "acf"),
    "information_criteria": " UNION ALL ".join(_points("information_criteria", _orders_sql(5), _named(c), "p", c) for c in ("aic", "bic")),
    "power_spectrum": _points("power_spectrum", f"SELECT * FROM ({_DENSITY_FEW}) WHERE row = 0 AND col = 0", "series_id", _omega, "re"),
    "gc_evolution": _points("gc_evolution", _sliding_sql(Q.PAIR, 240, 48), "series_id", "center", "gc"),
    "true_vs_estimated": _points("true_vs_estimated", _COUPLED, _named("true"), "t", "coupling") + " UNION ALL " + _points("true_vs_estimated", _sliding_sql(_COUPLED, 240, 48), _named("estimated"), "center", "gc"),
    "adaptive_coupling": _points("adaptive_coupling", _COUPLED, _named("true"), "t", "coupling") + " UNION ALL " + _points("adaptive_coupling", _rls_rel(1, 0.99, _COUPLED), _named("estimated"), "t", "b0_1"),
    "parameter_convergence": _points("parameter_convergence", _rls_rel(1, 0.99), "series_id", "t", "b0_1"),
    "gc_surface": _points("gc_surface", _surface(_SURFACE, 17), "series_id", "t", "omega", "gc"),
    "spectrum_comparison": " UNION ALL ".join(_points("spectrum_comparison", _scaled_power(k), _named(n), _omega, "part") for k, n in enumerate(("target", "source"))),
    "gc_comparison": _points("gc_comparison", Q.plain_gc(MODEL1, 1, _FEW), _named("plain"), _omega, "gc") + " UNION ALL " + _points("gc_comparison", Q.geweke_gc(MODEL1, 1, _FEW), _named("geweke"), _omega, "gc"),
    "latent_vs_observed": _points("latent_vs_observed", f"SELECT t // 6 AS t, x0 FROM ({Q.PAIR}) WHERE t % 6 = 0", _named("latent"), "t", "x0") + " UNION ALL " + _points("latent_vs_observed", f"SELECT t // 6 AS t, (v - avg(v) OVER ()) / (stddev_pop(v) OVER () + 1e-12) AS z FROM ({_BOLD})", _named("observed"), "t", "z"),
    "smoothing": " UNION ALL ".join(_points("smoothing", f"SELECT * FROM ({rel}) WHERE t < 200", _named(n), "t", v) for n, rel, v in (("true", Q.PAIR, "x0"), ("observed", _NOISY, "y"), ("smoothed", _smooth_sql(_NOISY, 0.8, 0.1, 1.0, 4.0), "x"))),
    "mixed_observation": " UNION ALL ".join(_points("mixed_observation", f"SELECT * FROM ({rel}) WHERE t < 200", _named(n), "t", v) for n, rel, v in (("true", Q.PAIR, "x0"), ("proxy", _PROXY, "y"), ("smoothed", _smooth_sql(_PROXY, 0.6, 0.0, 0.15, 0.6), "x"))),
    "method_bars": " UNION ALL ".join(
        _points("method_bars", rel, _named(n), "0", "gc")
        for n, rel in (
            ("var", Q.gc(_pair_sums(1), "x0", ["x0_1"], ["x0_1", "x1_1"])),
            ("varx", Q.gc(_pair_sums(1, ("u0",)), "x0", ["x0_1", "u0"], ["x0_1", "x1_1", "u0"])),
            ("varx ridge", Q.gc(_pair_sums(1, ("u0",)), "x0", ["x0_1", "u0"], ["x0_1", "x1_1", "u0"], 10.0)),
            ("model", _MODEL_GC),
        )
    ),
}
report.register(query, pair, pair_model, CHARTS)

