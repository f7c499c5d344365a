"""The engine against analytic values of simulated systems, dense linear algebra, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import algebra as G
from causeway.functions import matrices as M
from causeway.operators import adaptive, gc_spectral, gc_time, lags, signal, spectral, ssm, var
from causeway.sources import series, simulate

A1, A2 = 2 * 0.95 * math.cos(0.3 * math.pi), -(0.95**2)
F1 = [[[0.5, 0.8], [0, 0.8]]]
F3 = [[[0.5, 0.4], [0, 0.8]]]
F4_SIGMA = [[1, 0.3], [0.3, 1]]
F8 = [[[0.5, 0.3], [0, 1.2]], [[0, 0], [0, -0.5]]]
F9 = [[[0.5, 0.3], [0, A1]], [[0, 0], [0, A2]]]
CHAIN = [[[0.5, 0, 0.4], [0, 0.8, 0], [0, 0.5, 0.5]]]


def models(spark, coefs, sigma=None):
    coefs = np.asarray(coefs, float)
    sigma = np.eye(coefs.shape[-1]) if sigma is None else np.asarray(sigma, float)
    return spark.createDataFrame([("s", len(coefs), 1000, coefs.ravel().tolist(), sigma.ravel().tolist())], "series_id string, p int, n_obs long, coef array<double>, sigma array<double>")


@pytest.fixture(scope="module")
def chain(spark):
    df = simulate.var_data(spark, CHAIN, np.eye(3), 5000, ids=("a", "b"))
    return spark.createDataFrame(df.toPandas(), df.schema)


@pytest.fixture(scope="module")
def pair(spark):
    df = simulate.var_data(spark, F1, np.eye(2), 5000, ids=("a", "b", "c"))
    return spark.createDataFrame(df.toPandas(), df.schema)


def data_of(df, series_id):
    return df.where(F.col("series_id") == series_id).orderBy("t").select(*series.channels(df)).toPandas().to_numpy()


# time domain


def test_pairwise_matches_population_and_factorization(pair):
    there = {r.series_id: r for r in gc_time.pairwise_gc(pair, "x1", "x0").collect()}
    back = {r.series_id: r.gc for r in gc_time.pairwise_gc(pair, "x0", "x1").collect()}
    assert abs(np.mean([r.gc for r in there.values()]) - 0.672553) < 0.04
    for k, r in there.items():
        assert r.n_obs == 4999 and back[k] < 15 / 4999
        assert abs(r.gc - M.gc_of(data_of(pair, k), 1, 0, [], 1)) < 1e-9


@pytest.mark.parametrize("order", [1, 2, 3])
def test_conditional_explains_the_chain(chain, order):
    pairwise = gc_time.pairwise_gc(chain, "x1", "x0", order).toPandas().set_index("series_id").gc
    given = gc_time.conditional_gc(chain, "x1", "x0", ["x2"], order).toPandas().set_index("series_id").gc
    for k in pairwise.index:
        assert pairwise[k] > 0.05 and given[k] < 30 / 5000
        assert abs(given[k] - M.gc_of(data_of(chain, k), 1, 0, [2], order)) < 1e-9


@pytest.mark.parametrize("order", [1, 2])
def test_all_pairs_are_the_single_ones(chain, order):
    got = {(r.series_id, r.source, r.target): r.gc for r in gc_time.all_pairs_gc(chain, order).collect()}
    assert len(got) == 12
    for (k, s, t), gc in got.items():
        assert abs(gc - M.gc_of(data_of(chain, k), s, t, [], order)) < 1e-9


@pytest.mark.parametrize("order", [1, 2])
def test_sliding_windows_are_refits(pair, order):
    got = gc_time.sliding_gc(pair, "x1", "x0", 1000, 300, order).where("series_id = 'a'").orderBy("w").collect()
    x = data_of(pair, "a")
    assert [r.window_start for r in got] == list(range(0, 4001, 300)) and got[0].center == 500
    for r in got:
        assert abs(r.gc - M.gc_of(x[r.window_start : r.window_start + 1000], 1, 0, [], order)) < 1e-9
    whole = gc_time.sliding_gc(pair, "x1", "x0", 5000, 5000, order).where("series_id = 'a'").first()
    assert abs(whole.gc - M.gc_of(x, 1, 0, [], order)) < 1e-9


def test_causality_ignores_scale_and_partitions(pair):
    once = gc_time.pairwise_gc(pair, "x1", "x0").toPandas().set_index("series_id").gc
    other = gc_time.pairwise_gc(pair.repartition(7).withColumn("x0", F.col("x0") * 1000).withColumn("x1", F.col("x1") / 7), "x1", "x0").toPandas().set_index("series_id").gc
    assert np.allclose(once.sort_index(), other.sort_index(), atol=1e-9)


def test_lags_in_blocks_are_lags(pair):
    a = lags.lagged(pair, ["x0", "x1"], 2).orderBy("series_id", "t").toPandas()
    b = lags.lagged(pair, ["x0", "x1"], 2, block=64).orderBy("series_id", "t").toPandas()
    assert a.equals(b) and len(a) == pair.count() - 2 * pair.select("series_id").distinct().count()


def test_nulls_and_gaps_are_left_out(spark):
    rows = [("s", t, None if t == 7 else float(t), 1.0) for t in range(20) if t != 13]
    got = lags.lagged(spark.createDataFrame(rows, "series_id string, t long, x0 double, x1 double"), ["x0", "x1"], 2)
    assert sorted(r.t for r in got.collect()) == [2, 3, 4, 5, 6, 10, 11, 12, 16, 17, 18, 19]
    assert lags.lagged(got.limit(0).select("series_id", "t", "x0"), ["x0"], 1).count() == 0


def test_degenerate_series_have_their_least_squares(spark):
    r = np.random.default_rng(4)
    data = {}
    for name in ("plain", "zero source", "constant source", "equal", "combined", "constant target", "short"):
        x = r.normal(size=(40, 3)).cumsum(axis=0) * 0.3
        if name == "zero source":
            x[:, 1] = 0
        if name == "constant source":
            x[:, 1] = 5
        if name == "equal":
            x[:, 1] = x[:, 0]
        if name == "combined":
            x[:, 2] = 2 * x[:, 0] - x[:, 1]
        if name == "constant target":
            x[:, 0] = 3
        data[name] = x[:4] if name == "short" else x
    rows = [(k, t, *map(float, v), float(t % 3)) for k, x in data.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, t long, x0 double, x1 double, x2 double, u0 double")

    def variance(x, y, regressors):
        rest = y - regressors @ np.linalg.lstsq(regressors, y, rcond=1e-10)[0]
        v = rest.var()
        return v if v > 1e-12 * (y**2).mean() else 0.0

    def expected(x, conditioning, order):
        y = x[order:, 0]
        design = lambda c: np.column_stack([x[order - k : len(x) - k, j] for k in range(1, order + 1) for j in c])
        a, b = variance(x, y, design([0, 1, *conditioning])), variance(x, y, design([0, *conditioning]))
        return np.log(b / a) if a > 0 and b > 0 else None

    for conditioning, order in (([], 1), ([2], 1), ([], 2), ([2], 2)):
        got = {r.series_id: r.gc for r in gc_time.conditional_gc(df, "x1", "x0", [f"x{k}" for k in conditioning], order).collect()}
        for k, x in data.items():
            if k != "short":
                assert got[k] == (pytest.approx(v, abs=1e-7) if (v := expected(x, conditioning, order)) is not None else None), (k, conditioning, order)
    pairs = {(r.series_id, r.source, r.target): r.gc for r in gc_time.all_pairs_gc(df).collect()}
    assert len(pairs) == 6 * len(data) and all(pairs[k, 1, 0] == (pytest.approx(v, abs=1e-7) if (v := expected(x, [], 1)) is not None else None) for k, x in data.items() if k != "short")
    assert gc_time.sliding_gc(df, "x1", "x0", 20, 5).where("series_id = 'zero source'").agg(F.count("*"), F.max(F.abs("gc"))).first() == (5, 0.0)
    assert abs(gc_time.varx_gc(df.drop("x2"), ["u0"], "x1", "x0").where("series_id = 'zero source'").first().gc) < 1e-9


def test_plan_has_one_window_and_short_rows_to_shuffle(pair):
    plan = gc_time.all_pairs_gc(pair)._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    assert initial.count("Window [") == 1 and initial.count("Exchange hashpartitioning") == 2 and "Python" not in initial  # samples once, then a row for each block


# models


@pytest.mark.parametrize("order", [1, 2])
def test_fit_is_the_factorization(pair, order):
    quick = var.fit_var(pair, order).orderBy("series_id").collect()
    exact = var.fit_var_exact(pair, order).orderBy("series_id").collect()
    for a, b in zip(quick, exact, strict=True):
        assert np.allclose(a.coef, b.coef, atol=1e-9) and np.allclose(a.sigma, b.sigma, atol=1e-9) and a.n_obs == b.n_obs and not a.singular


def test_collinear_series_take_the_exact_path(spark, pair):
    twin = pair.where("series_id = 'a'").withColumn("x1", F.col("x0") * 2)
    assert var.fit_var(twin, 1).first().singular
    r = var.fit_var_safe(twin.unionByName(pair.where("series_id = 'b'")), 1).where("series_id = 'a'").first()
    coef, sigma, _ = M.fit_var(data_of(twin, "a"), 1)
    assert np.allclose(r.coef, coef.ravel(), atol=1e-6) and np.allclose(r.sigma, sigma.ravel(), atol=1e-6)


def test_residuals_and_their_correlation(pair):
    res = var.residuals(pair, var.fit_var(pair, 2), 2)
    x = data_of(pair, "a")
    _, sigma, want = M.fit_var(x, 2)
    got = res.where("series_id = 'a'").orderBy("t").select("r0", "r1").toPandas().to_numpy()
    assert np.allclose(got, want, atol=1e-9)
    acf = {(r.channel, r.lag): r.acf for r in var.autocorrelation(res, 5).where("series_id = 'a'").collect()}
    for (c, k), v in acf.items():
        assert abs(v - np.corrcoef(want[:-k, c], want[k:, c])[0, 1]) < 1e-9 and abs(v) < 0.06


def test_order_selection(spark):
    df = simulate.var_data(spark, F8, np.eye(2), 6000)
    table = var.select_order(df, 4)
    assert var.best_order(table).first().p == 2
    x = df.orderBy("t").select("x0", "x1").toPandas().to_numpy()
    for r in table.collect():
        _, sigma, _ = M.fit_var(x, r.p)
        k = var.count_parameters(2, r.p)
        assert abs(r.aic - (np.log(np.linalg.det(sigma)) + 2 * k / 6000)) < 1e-8 and abs(r.bic - (np.log(np.linalg.det(sigma)) + np.log(6000) * k / 6000)) < 1e-8
    one = var.fit_var(df.select("series_id", "t", "x0"), 1)
    assert var.criteria(one, 1, F.lit(6000)).first().aic is not None


def test_stability_of_known_systems(spark):
    for coefs, radius in ((F1, 0.8), (F8, 0.707107), (F9, 0.95)):
        r = var.stability(models(spark, coefs), 2).first()
        assert abs(r.spectral_radius - radius) < 1e-6 and r.stable
    assert M.companion(np.asarray(F9)).shape == (4, 4)
    for a in ([[0.5, 0.8], [0, 0.8]], [[0.3, -0.9], [0.9, 0.3]]):
        assert abs(G.spectral_radius_2x2(*a[0], *a[1]) - np.abs(np.linalg.eigvals(a)).max()) < 1e-12


def test_stacked_and_long_coefficients(spark):
    m = models(spark, F8)
    theta = np.reshape(var.stacked(m, 2).first().theta, (2, 4))
    assert np.allclose(theta, np.hstack(F8))
    assert all(r.value == F8[r.lag - 1][r.row][r.col] for r in var.coefficients(m, 2).collect())


def test_varx(spark):
    a, b = [[[0.5, 0.3], [0, 0.5]]], [[[0], [0.9]], [[0], [0]], [[0.9], [0]]]
    df = simulate.varx_data(spark, a, b, 0.5 * np.eye(2), 6000, 0.95)
    m = gc_time.fit_varx(df, ["u0"], 1, 3).first()
    assert np.allclose(np.reshape(m.a, (2, 2)), a[0], atol=0.06) and np.allclose(np.reshape(m.b, (3, 2)), np.array(b)[:, :, 0], atol=0.08)
    back = gc_time.varx_gc(df, ["u0"], "x0", "x1", 1, 3).first()
    assert back.gc < 15 / 6000 < gc_time.pairwise_gc(df, "x0", "x1").first().gc < gc_time.varx_gc(df, ["u0"], "x1", "x0", 1, 3, 1e-3).first().gc + 1
    small = gc_time.varx_gc(df, ["u0"], "x1", "x0", 1, 1, 5.0).first()
    x = df.orderBy("t").select("x0", "x1", "u0").toPandas().to_numpy()
    z, y = np.column_stack([x[:-1, 0], x[:-1, 1], x[1:, 2]]), x[1:, 0]
    spread = lambda z: np.var(y - z @ np.linalg.solve(z.T @ z + 5 * np.eye(z.shape[1]), z.T @ y))
    assert abs(small.gc - np.log(spread(z[:, [0, 2]]) / spread(z))) < 1e-9


# frequency domain


@pytest.mark.parametrize(("coefs", "sigma", "gc", "peak"), [(F1, None, 0.66893523, 0.0), (F3, None, 0.27178937, 0.0), (F3, F4_SIGMA, 0.20942659, 0.0), (F8, None, 0.23848630, 0.14286), (F9, None, 0.29463057, 0.29941)])
def test_geweke_integral_and_peak(spark, coefs, sigma, gc, peak):
    curve = gc_spectral.geweke_gc(models(spark, coefs, sigma), len(coefs), 512)
    assert abs(spectral.integral(curve).first().integral - gc) < 1e-6
    assert abs(spectral.dominant(curve, "gc").first().omega / math.pi - peak) < 1e-4
    a = np.array(coefs[0])
    if len(coefs) == 1:
        assert abs(M.model_gc(a, np.eye(2) if sigma is None else np.array(sigma), 1, 0) - gc) < 1e-6


def test_columns_are_the_dense_algebra(spark):
    m = models(spark, F9, F4_SIGMA)
    pairs = [(spectral.long_form(spectral.transfer_pair(m, 2, 17), "h"), spectral.transfer_functions(m, 2, 17)), (spectral.long_form(spectral.density_pair(m, 2, 17), "s"), spectral.spectral_densities(m, 2, 17)), (spectral.long_form(spectral.transfer_pair(m, 2, 17), "a"), spectral.lag_polynomials(m, 2, 17))]
    for a, b in pairs:
        assert np.allclose(spectral.matrices(a.toPandas())[1], spectral.matrices(b.toPandas())[1], atol=1e-10)


def test_spectrum_tools(spark):
    s = spectral.spectral_densities(models(spark, F9, F4_SIGMA), 2, 33)
    omega, m = spectral.matrices(s.toPandas())
    assert abs(spectral.hermitian_error(s).first().hermitian_error) < 1e-12
    e = spectral.eigenvalues(s).orderBy("f_idx").toPandas()
    assert np.allclose(e.min_eigenvalue, np.linalg.eigvalsh(m)[:, 0]) and (e.condition >= 1).all()
    assert np.allclose(spectral.matrices(spectral.two_sided(s).toPandas())[1], M.two_sided(m))
    assert spectral.one_sided(spectral.two_sided(s), 64).count() == s.count()
    assert np.allclose(spectral.matrices(spectral.hermitian(s, 0.5).toPandas())[1], m + 0.5 * np.eye(2))
    assert np.allclose(spectral.matrices(spectral.regularized(s, 0.1).toPandas())[1], m + 0.1 * np.eye(2))
    load = 0.01 * np.trace(m, axis1=1, axis2=2).real[:, None, None] / 2
    assert np.allclose(spectral.matrices(spectral.regularized_relative(s, 0.01).toPandas())[1], m + load * np.eye(2))
    assert np.allclose(spectral.matrices(spectral.regularized_relative(s, 0.01, True).toPandas())[1], m + load + np.eye(2))
    assert np.allclose(spectral.matrices(spectral.submatrix(s, [1, 0]).toPandas())[1], m[:, ::-1, ::-1])
    assert abs(spectral.normalized(spectral.power(s, 1)).agg(F.max("value")).first()[0] - 1) < 1e-12
    peak = spectral.dominant(spectral.power(spectral.spectral_densities(models(spark, F9), 2, 1024), 1)).first()
    assert abs(peak.omega / math.pi - 0.30010) < 1e-4


def test_three_channels_have_eigenvalues_too(spark):
    s = spectral.spectral_densities(models(spark, CHAIN), 3, 9)
    _, m = spectral.matrices(s.toPandas())
    assert np.allclose(spectral.eigenvalues(s, 3).orderBy("f_idx").toPandas().min_eigenvalue, np.linalg.eigvalsh(m)[:, 0])


@pytest.mark.parametrize(("n", "nw", "k"), [(64, 3, 5), (301, 10, 9)])
def test_tapers(n, nw, k):
    v = M.dpss(n, nw, k, periodic=False)
    assert np.allclose(v @ v.T, np.eye(k), atol=1e-9)
    d = np.arange(n)[:, None] - np.arange(n)
    inside = np.where(d == 0, 2 * nw / n, np.sin(2 * np.pi * nw / n * d) / (np.pi * np.where(d == 0, 1, d)))
    assert np.allclose(np.diag(v @ inside @ v.T), np.linalg.eigvalsh(inside)[::-1][:k], atol=1e-9)
    assert M.dpss(n, nw, k).shape == (k, n)


def test_multitaper_and_trials(spark):
    df = simulate.var_data(spark, F9, np.eye(2), 2000)
    s = spectral.multitaper_csd(df, n_fft=4096, time_bandwidth=10.0, tapers=9)
    assert spectral.hermitian_error(s).first().hermitian_error < 1e-9
    assert abs(spectral.dominant(spectral.power(s, 1)).first().omega / math.pi - 0.3) < 0.03
    trials = df.withColumn("trial_id", F.floor(F.col("t") / 500))
    mean = spectral.multitaper_csd_trials(trials, n_fft=512)
    x = df.orderBy("t").select("x0", "x1").toPandas().to_numpy().reshape(4, 500, 2)
    want = np.mean([M.multitaper(t, n_fft=512)[1] for t in x], axis=0)
    assert np.allclose(spectral.matrices(mean.toPandas())[1], want)
    for bad in (lambda: M.multitaper(x, 1.0), lambda: M.multitaper(x[0], n_fft=10)):
        with pytest.raises(ValueError):
            bad()


def test_wilson(spark):
    for coefs, sigma in ((F1, np.eye(2)), (F9, np.array(F4_SIGMA)), (CHAIN, np.eye(3))):
        omega = np.linspace(0, np.pi, 513)
        w = M.wilson(M.spectral_density(np.asarray(coefs, float), sigma, omega), tolerance=1e-10, regularization=1e-12)
        assert w["converged"] and np.allclose(w["covariance"], sigma, atol=1e-6)
        assert np.allclose(w["transfer"], M.transfer(np.asarray(coefs, float), omega)[1], atol=1e-5)
    with pytest.raises(ValueError):
        M.wilson(np.ones((4, 2)))


NEAR_UNIT = [[[0.469, 0.5286], [0.4453, 0.5556]]]  # radius 0.9994, as of hourly sums of some millions of events


def near_unit(spark):
    return models(spark, NEAR_UNIT, [[1275.0, 367.0], [367.0, 1195.0]])


def test_wilson_of_long_memory_gives_the_spectrum_back(spark):
    w = spectral.wilson_factor(spectral.spectral_densities(near_unit(spark), 2, 129)).toPandas()
    assert len(w) == 516 and w.converged.all() and w.error.max() < 1e-5


def test_factor_gives_a_near_unit_spectrum_back_to_its_last_digits(spark):
    s = spectral.spectral_densities(near_unit(spark), 2, 129)
    back = spectral.reconstruct_from_factor(spectral.wilson_factor(s, 200, 1e-11, 1e-12))
    assert spectral.max_relative_error(s, back).first().error < 5e-14


def test_transfer_and_covariance_give_a_near_unit_spectrum_back_to_its_last_digits(spark):
    s = spectral.spectral_densities(near_unit(spark), 2, 129)
    back = spectral.reconstruct_from_transfer(spectral.wilson_factor(s, 200, 1e-11, 1e-12))
    assert spectral.max_relative_error(s, back).first().error < 5e-14


def test_causality_of_a_factor_is_the_models_at_a_near_unit_root(spark):
    m = near_unit(spark)
    s = spectral.spectral_densities(m, 2, 129)
    got = gc_spectral.factor_gc(spectral.wilson_factor(s, 200, 1e-11, 1e-12), s).orderBy("f_idx").toPandas().gc
    assert np.allclose(got, gc_spectral.geweke_gc(m, 1, 129).orderBy("f_idx").toPandas().gc, atol=1e-6)


def test_wilson_on_a_finer_grid_takes_spectrum_or_inverse_as_they_are():
    omega = np.linspace(0, np.pi, 65)
    a, inverse = M.transfer(np.array([[[0.98, 0.0], [0.3, 0.5]]]), omega)
    for h in (a, inverse):  # short memory with a near unit zero, and long memory
        w = M.wilson(h @ np.array(F4_SIGMA) @ M._star(h), tolerance=1e-10, regularization=0.0)
        assert w["converged"] and np.allclose(w["covariance"], F4_SIGMA, atol=1e-8) and np.allclose(w["transfer"], h, atol=1e-6)


def test_wilson_of_a_rough_spectrum_converges(spark):
    x = simulate.var_data(spark, NEAR_UNIT, np.eye(2), 700).orderBy("t").select("x0", "x1").toPandas().to_numpy()
    w = M.wilson(M.multitaper(x, n_fft=1024)[1], tolerance=1e-9)
    assert w["converged"] and w["iterations"] < 50


def test_nonparametric_causality(spark):
    m = models(spark, F3, F4_SIGMA)
    s = spectral.spectral_densities(m, 2, 257)
    got = gc_spectral.nonparametric_gc(s, 0, 1, tolerance=1e-10).orderBy("f_idx").toPandas().gc
    want = gc_spectral.geweke_gc(m, 1, 257).orderBy("f_idx").toPandas().gc
    assert np.allclose(got, want, atol=1e-5)
    w = spectral.wilson_factor(s, tolerance=1e-10, regularization=1e-12)
    assert np.allclose(gc_spectral.factor_gc(w, s).orderBy("f_idx").toPandas().gc, want, atol=1e-5)
    for back in (spectral.reconstruct_from_factor(w), spectral.reconstruct_from_transfer(w)):
        assert spectral.max_relative_error(s, back).first().error < 1e-8
    with pytest.raises(NotImplementedError):
        gc_spectral.factor_gc(w, s, "0->1")


def test_conditional_spectrum_is_a_misfit_curve(chain):
    curve = gc_spectral.conditional_spectral_gc(chain, "x1", "x0", ["x2"], 1, 33).where("series_id = 'a'").toPandas().gc
    assert len(curve) == 33 and abs(curve.mean()) < 0.1


# adaptive and state space


@pytest.mark.parametrize("block", [50, 4096])
def test_recursion_is_its_closed_form(spark, block):
    df = simulate.smooth_var(spark, np.eye(2), 700).drop("coupling")
    a = adaptive.rls(df, 1, 0.97).orderBy("k").toPandas()
    b = adaptive.discounted(df, "x0", ("x0", "x1"), 0.97, block).orderBy("k").toPandas()
    theta = np.stack(a.theta)
    assert np.allclose(theta[:, 0], b.b0, atol=1e-8) and np.allclose(theta[:, 1], b.b1, atol=1e-8) and (a.t == b.t).all()
    assert 141_000 < adaptive.overflow_after(0.995) < 142_000


def test_recursion_tracks_the_ramp_and_order_two(spark):
    df = simulate.smooth_var(spark, np.eye(2), 4000)
    h = adaptive.rls(df.drop("coupling"), 1, 0.995).join(df.select("t", "coupling"), "t").where("t > 500").toPandas()
    assert np.abs(np.stack(h.theta)[:, 1] - h.coupling).mean() < 0.12
    two = adaptive.rls(simulate.var_data(spark, F8, np.eye(2), 5000), 2, 0.999)
    assert np.allclose(np.reshape(adaptive.last_theta(two).first().theta, (2, 4)), np.hstack(F8), atol=0.12)
    c = adaptive.rls_coefficients(two, 2, 2).orderBy(F.desc("k")).first().coef
    assert np.allclose(np.reshape(c, (2, 2, 2)), F8, atol=0.12)
    surface = gc_spectral.adaptive_surface(adaptive.rls_coefficients(adaptive.rls(df.drop("coupling"), 1, 0.995), 2, 1), 1, 200, 9)
    assert surface.count() == 20 * 9


def test_models_imply_their_causality(spark):
    a, q = np.array([[0.6, 0.3], [0, 0.55]]), 0.15 * np.eye(2)
    m = models(spark, [a], q)
    assert abs(ssm.model_gc(m, 2, 1, 0).first().gc - 0.11615856) < 1e-6
    assert np.allclose(ssm.stationary_covariance(m, 2).first().covariance, [0.2944074988, 0.0529610014, 0.0529610014, 0.2150537634], atol=1e-9)
    assert np.allclose(list(ssm.stationary_pair(m).first())[1:], [0.2944074988, 0.0529610014, 0.2150537634], atol=1e-9)
    got = {(r.source, r.target): r.gc for r in ssm.model_gc_matrix(models(spark, CHAIN), 3).collect()}
    assert abs(got[1, 0] - 0.14824121) < 1e-6 and abs(ssm.model_gc(models(spark, CHAIN), 3, 1, 0, [2]).first().gc) < 1e-6
    coded = {(r.source, r.target): r.gc for r in ssm.model_gc_matrix(models(spark, CHAIN), 3, as_coded=True).collect()}
    assert coded[1, 0] == coded[2, 0]


@pytest.fixture(scope="module")
def latent(spark):
    df = simulate.ssm_data(spark, [[0.6, 0.3], [0, 0.55]], [[0.5], [0.4]], 0.15 * np.eye(2), 0.6 * np.eye(2), 1500)
    return spark.createDataFrame(df.toPandas(), df.schema)


def test_smoother_beats_observation(latent):
    s = ssm.kalman_smoother(latent.drop("x0", "x1"), [[0.6, 0.3], [0, 0.55]], [[0.5], [0.4]], 0.15 * np.eye(2), 0.6 * np.eye(2))
    both = latent.join(s.select("t", F.col("x_smooth")[0].alias("s0"), F.col("x_smooth")[1].alias("s1"), F.col("x_filt")[0].alias("f0"), F.col("x_filt")[1].alias("f1")), "t")
    raw, filtered, smoothed = (ssm.mean_squared_error(both, ["x0", "x1"], c).first().mse for c in (["y0", "y1"], ["f0", "f1"], ["s0", "s1"]))
    assert smoothed < filtered < raw


@pytest.mark.parametrize("c", [None, [[1, 0.35], [0.25, 1]]])
def test_em_raises_the_likelihood(spark, c):
    df = simulate.ssm_data(spark, [[0.6, 0.3], [0, 0.55]], [[0.5], [0.4]], 0.15 * np.eye(2), 0.6 * np.eye(2), 600, c=c)
    obs = df.select("series_id", "t", "y0", "y1", "u0")
    e = ssm.em(obs, c=c, most=12, tolerance=1e-3).first()
    gains = np.diff(e.log_likelihoods)
    assert (gains > -1e-3).all() and gains[0] > 0
    states = ssm.em_states(obs, c=c, most=12, tolerance=1e-3).select("t", F.col("x_smooth")[0].alias("s0"), F.col("x_smooth")[1].alias("s1"))
    proxy = ssm.latent_proxy(obs, np.eye(2) if c is None else c).select("t", F.col("x0").alias("p0"), F.col("x1").alias("p1"))
    both = df.join(states, "t").join(proxy, "t")
    assert ssm.mean_squared_error(both, ["x0", "x1"], ["s0", "s1"]).first().mse < ssm.mean_squared_error(both, ["x0", "x1"], ["p0", "p1"]).first().mse


# signals


def test_haemodynamic_response(spark):
    fine = [r.weight for r in signal.hrf_kernel(spark, 0.1).orderBy("k").collect()]
    assert len(fine) == 320 and abs(sum(fine) - 1) < 1e-12 and np.argmax(fine) == 50 and np.argmin(fine) == 157
    assert abs(max(fine) - 0.02105008) < 1e-8 and abs(min(fine) + 0.00187136) < 1e-8
    slow = [r.weight for r in signal.hrf_kernel(spark, 1.0).orderBy("k").collect()]
    assert len(slow) == 32 and np.allclose(slow[:8], [0, 0.00367824, 0.04330079, 0.12096432, 0.18752100, 0.21049781, 0.19254063, 0.15257498], atol=1e-8)


def test_transforms(spark, pair):
    x = data_of(pair, "a")
    kernel = signal.hrf_kernel(spark, 1.0)
    got = signal.convolve(pair, kernel, ["x0", "x1"]).where("series_id = 'a'").orderBy("t").select("x0", "x1").toPandas().to_numpy()
    w = [r.weight for r in kernel.orderBy("k").collect()]
    assert np.allclose(got[:, 0], np.convolve(x[:, 0], w)[: len(x)])
    z = signal.zscore(pair, ["x0"]).where("series_id = 'b'").agg(F.avg("x0_z"), F.stddev_pop("x0_z")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9
    down = signal.downsample(pair, 7).where("series_id = 'a'").orderBy("t").toPandas()
    assert np.array_equal(down.x0, x[::7, 0]) and down.t.tolist() == list(range(len(down)))
    assert signal.prefix(pair, 10).count() == 30
    curve = spark.createDataFrame([("s", float(k), float(k * k)) for k in range(5)], "series_id string, x double, v double")
    at = spark.createDataFrame([("s", v) for v in (-1.0, 0.0, 0.5, 2.25, 4.0, 9.0)], "series_id string, x double")
    got = {r.x: r.v for r in signal.interpolate(curve, at, "x", "v").collect()}
    assert got == {v: np.interp(v, range(5), [k * k for k in range(5)]) for v in got}


def test_simulators(spark):
    p = simulate.piecewise_var(spark, [F1, [[[0.5, 0.1], [0, 0.8]]]], [2500], np.eye(2), 5000)
    gc = [gc_time.pairwise_gc(p.where(c), "x1", "x0").first().gc for c in ("t < 2500", "t >= 2500")]
    assert abs(gc[0] - 0.6726) < 0.1 and abs(gc[1] - 0.0265) < 0.03
    with pytest.raises(ValueError):
        simulate.piecewise_var(spark, [F1], [10], np.eye(2), 100)
    with pytest.raises(ValueError):
        simulate.fmri_data(spark, F1, [[[0], [0]]], np.eye(2), 100, 0.4, 1.0)
    f = simulate.fmri_data(spark, [[[0.5, 0.3], [0, 0.5]]], [[[0], [0.8]]], 0.5 * np.eye(2), 1000)
    assert f.count() == 100 and abs(f.agg(F.avg("x0")).first()[0]) < 1e-9
    r = simulate.smooth_var(spark, np.eye(2), 300, resonant=True)
    assert r.count() == 300 and r.orderBy("t").first().coupling == 0.8
    u = simulate.colored_input(spark, 4000).toPandas().u0
    assert abs(np.corrcoef(u[1:], u[:-1])[0, 1] - 0.9) < 0.03
    again = simulate.var_data(spark, F1, np.eye(2), 50, ids=("q",))
    assert again.toPandas().equals(again.repartition(3).orderBy("t").toPandas())


def test_simulators_take_the_callers_input(spark):
    rows = [(i, t, float(t % 5), 1.0) for i in ("a", "b") for t in range(10, 60)]
    u = spark.createDataFrame(rows, "series_id string, t long, u0 double, u1 double")
    b, still = [[[1.0, 0.0], [0.0, 2.0]], [[0.5, 0.0], [0.0, 0.0]]], np.zeros((2, 2))
    got = simulate.varx_data(spark, np.zeros((1, 2, 2)), b, still, inputs=u).orderBy("series_id", "t").collect()
    assert [(r.series_id, r.t) for r in got] == [(r[0], r[1]) for r in sorted(rows)] and all(r.u0 == r.t % 5 for r in got)
    assert all(abs(r.x0 - (r.t % 5 + (0.5 * ((r.t - 1) % 5) if r.t > 10 else 0))) < 1e-9 and abs(r.x1 - 2) < 1e-9 for r in got)
    s = simulate.ssm_data(spark, [[0.5]], [[1.0, 0.0]], [[0.0]], [[0.0]], x0=[8.0], inputs=u.where("series_id = 'a'")).orderBy("t").collect()
    assert s[0].x0 == 8 and s[1].x0 == 4 + 11 % 5 and all(abs(r.y0 - r.x0) < 1e-9 for r in s)
    seen, neural = simulate.fmri_data(spark, np.zeros((1, 2, 2)), b, np.eye(2), inputs=u, tr_neural=0.5, tr=1.0, neural=True)
    assert neural.count() == 100 and seen.count() == 50 and seen.columns == ["series_id", "t", "x0", "x1", "u0", "u1"]


def test_order_moments_are_the_sums(spark):
    x = np.random.default_rng(1).normal(size=(23, 2))
    for most in (4, 9):
        sums = np.array([x[h:].T @ x[: len(x) - h] for h in range(most + 1)])
        for p, m in M.order_moments(len(x), x.sum(axis=0), sums, x[:most], x[-most:]):
            z = np.hstack([np.ones((23 - p, 1)), *(x[p - k : 23 - k] for k in range(p + 1))])
            assert np.allclose(m, z.T @ z)


def test_order_selection_in_blocks(spark, monkeypatch):
    df = simulate.var_data(spark, [[[0.5, 0.3], [0, 1.2]], [[0, 0], [0, -0.5]]], np.eye(2), 900, ids=("a", "b")).where("series_id = 'a' or t < 37")
    whole = var.select_order(df, 6).orderBy("series_id", "p").toPandas()
    monkeypatch.setattr(var, "BLOCK", 16)
    parts = var.select_order(df, 6).orderBy("series_id", "p").toPandas()
    assert len(whole) == 12 and np.allclose(whole[["aic", "bic"]], parts[["aic", "bic"]], atol=1e-9)
    for p in (1, 6):
        sigma = M.fit_var(data_of(df, "b"), p)[1]
        assert abs(whole[(whole.series_id == "b") & (whole.p == p)].aic.iloc[0] - np.linalg.slogdet(sigma)[1] - 8 * p / 37) < 1e-9


def test_series_forms(spark, pair):
    a = pair.orderBy("series_id", "t").toPandas()
    for b in (series.to_wide(series.to_long(pair), 2), series.from_vectors(series.to_vectors(pair), 2)):
        assert a.equals(b.orderBy("series_id", "t").toPandas())


def test_readers_and_writers(spark, pair, tmp_path):
    for kind in ("parquet", "orc", "json"):
        series.writer(pair, f"{tmp_path}/{kind}", kind, ("series_id",))
        assert series.reader(spark, f"{tmp_path}/{kind}", kind, "t long, x0 double, x1 double, series_id string").count() == pair.count()
    series.show(pair, 1)
