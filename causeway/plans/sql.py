"""DuckDB SQL for the catalog: series, lags, sums of products, models and spectra as nested selects."""

from __future__ import annotations

import math
from collections.abc import Sequence

from causeway.functions import algebra as G
from causeway.functions.algebra import Sql
from causeway.operators.lags import lag_names
from causeway.sources import series as R


class Rel:
    """A select that others nest in."""

    def __init__(self, sql: str):
        self.sql = sql

    def stage(self, **columns) -> Rel:
        return Rel(f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM ({self.sql})")

    def pick(self, *columns: str, **named) -> Rel:
        return Rel(f"SELECT {', '.join([*columns, *(f'{v} AS {k}' for k, v in named.items())])} FROM ({self.sql})")

    def where(self, condition: str) -> Rel:
        return Rel(f"SELECT * FROM ({self.sql}) WHERE {condition}")

    def __str__(self) -> str:
        return self.sql


def _regular(table: str, name: str, ts: str, seconds: int, origin: str, channel: str, names: list, value: str) -> Rel:
    t = f"CAST(floor((epoch({ts}) - epoch(TIMESTAMP '{origin}')) / {seconds}) AS BIGINT)"
    sums = ", ".join(f"CAST(sum(CASE WHEN {channel} = '{n}' THEN CAST({value} AS DECIMAL(18,4)) END) AS DOUBLE) AS x{k}" for k, n in enumerate(names))
    filled = ", ".join(f"coalesce(w.x{k}, 0.0) AS x{k}" for k in range(len(names)))
    return Rel(f"SELECT '{name}' AS series_id, g.t AS t, {filled} FROM (SELECT unnest(range(least(0, min({t})), max({t}) + 1)) AS t FROM {table}) g LEFT JOIN (SELECT {t} AS t, {sums} FROM {table} GROUP BY 1) w ON g.t = w.t")


EVENTS = _regular("events", "events", "ts", R.HOUR, "2024-01-01", "event_type", R.EVENT_TYPES, "value")
COUNTS = _regular("events", "events", "ts", R.DAY, "2024-01-01", "event_type", R.EVENT_TYPES, "1")
ORDERS = _regular("orders", "orders", "o_orderdate", R.DAY, "1995-01-01", "o_orderpriority", R.PRIORITIES, "o_totalprice")
SHIPS = _regular("lineitem", "ships", "l_shipdate", R.DAY, "1995-01-02", "l_returnflag", R.RETURN_FLAGS, "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))")
USERS = Rel("""SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER w - 1 AS t, value AS x0,
    coalesce(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w, 0.0) AS x1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")


def scaled(rel: Rel, by: float, names: Sequence[str]) -> Rel:
    return Rel(f"SELECT * REPLACE ({', '.join(f'{c} / {by} AS {c}' for c in names)}) FROM ({rel})")


#: purchases as channel 0, clicks as channel 1, views as an input, in hundreds
PAIR = Rel(f"SELECT series_id, t, x2 / 100.0 AS x0, x0 / 100.0 AS x1, x4 / 100.0 AS u0 FROM ({EVENTS})")


def lagged(rel: Rel, names: Sequence[str], order: int, keys: str = "series_id") -> Rel:
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}_{k}" for k in range(1, order + 1) for c in names)
    return Rel(f"SELECT *, {lags}, row_number() OVER w AS rn FROM ({rel}) WINDOW w AS (PARTITION BY {keys} ORDER BY t)").where(f"rn > {order}")


def moment(a: str, b: str) -> Sql:
    a, b = sorted((a, b))
    return Sql(f'"m_{a}_{b}"')


def moments(rel: Rel, names: Sequence[str], keys: str = "series_id", where: str = "TRUE") -> Rel:
    names = ["1", *names]
    sums = []
    for i, a in enumerate(names):
        for b in names[i:]:
            value = "1.0" if a == b == "1" else b if a == "1" else f"{a} * {b}"
            sums.append(f"CAST(sum({value}) AS DOUBLE) AS {moment(a, b)}")
    return Rel(f"SELECT {keys}, {', '.join(sums)} FROM ({rel}) WHERE {where} GROUP BY {keys}")


def fitted(rel: Rel, y: str, regressors: Sequence[str], out: str, ridge: float = 0.0) -> Rel:
    """Columns <out>_b0, ... and <out>, the residual variance."""
    b = G.fit(moment, y, regressors, ridge)
    rel = rel.stage(**{f"{out}_b{k}": v for k, v in enumerate(b)})
    names = [Sql(f"{out}_b{k}") for k in range(len(b))]
    return rel.stage(**{out: G.residual_covariance(moment, y, y, regressors, names, names)})


def gc(rel: Rel, target: str, own: Sequence[str], full: Sequence[str], ridge: float = 0.0) -> Rel:
    rel = fitted(fitted(rel, target, full, "sigma_full", ridge), target, own, "sigma_reduced", ridge)
    return rel.stage(gc="ln(sigma_reduced / sigma_full)", n_obs=f"CAST({moment('1', '1')} AS BIGINT)")


def guarded_gc(rel: Rel, target: str, own: Sequence[str], full: Sequence[str], ridge: float = 0.0) -> Rel:
    """gc() for sums of any rank, by elimination."""
    for out, names in (("sigma_full", full), ("sigma_reduced", own)):
        for step in G.elimination(moment, target, names, Sql, out, ridge):
            rel = rel.stage(**step)
    return rel.stage(gc="CASE WHEN sigma_full > 0 AND sigma_reduced > 0 THEN ln(sigma_reduced / sigma_full) END", n_obs=f"CAST({moment('1', '1')} AS BIGINT)")


def eliminated_model(rel: Rel, order: int) -> Rel:
    """A two-channel model of any order by elimination: b0_<k>, b1_<k> (regressor by regressor) and s00, s01, s11, n_obs."""
    names = ["x0", "x1"]
    x = lag_names(names, order)
    out = moments(lagged(rel, names, order), [*names, *x])
    steps = [G.elimination(moment, y, x, Sql, f"e{r}") for r, y in enumerate(names)]
    for a, b in zip(*steps, strict=True):
        out = out.stage(**(a | b))
    b = [[Sql(f"e{r}_b{k}") for k in range(len(x))] for r in range(2)]
    cross = {f"s{r}{c}": G.residual_covariance(moment, f"x{r}", f"x{c}", x, b[r], b[c]) for r, c in ((0, 0), (0, 1), (1, 1))}
    return out.stage(n_obs=f"CAST({moment('1', '1')} AS BIGINT)", **cross).pick("series_id", "n_obs", *(f"{v} AS b{r}_{k}" for r in range(2) for k, v in enumerate(b[r])), "s00", "s01", "s11")


def model(rel: Rel, order: int = 1, keys: str = "series_id") -> Rel:
    """A two-channel model: c<k><r><c> and s00, s01, s11, n_obs."""
    names = ["x0", "x1"]
    x = lag_names(names, order)
    out = moments(lagged(rel, names, order, keys), [*names, *x], keys)
    b = {r: [Sql(f"c{k}{r}{c}") for k in range(1, order + 1) for c in range(2)] for r in range(2)}
    for r in range(2):
        out = out.stage(**dict(zip(map(str, b[r]), G.fit(moment, f"x{r}", x), strict=True)))
    s = {f"s{r}{c}": G.residual_covariance(moment, f"x{r}", f"x{c}", x, b[r], b[c]) for r, c in ((0, 0), (0, 1), (1, 1))}
    return out.stage(n_obs=f"CAST({moment('1', '1')} AS BIGINT)", **s).pick(keys, "n_obs", *(f"c{k}{r}{c}" for k in range(1, order + 1) for r in range(2) for c in range(2)), "s00", "s01", "s11")


def _sigma(r: int, c: int) -> Sql:
    return Sql(f"s{min(r, c)}{max(r, c)}")


def _stage(rel: Rel, prefix: str, m: list[list[G.Complex]]) -> Rel:
    return rel.stage(**{f"{prefix}{r}{c}_{p}": getattr(m[r][c], p) for r in range(2) for c in range(2) for p in ("re", "im")})


def _named(prefix: str) -> list[list[G.Complex]]:
    return [[G.Complex(Sql(f"{prefix}{r}{c}_re"), Sql(f"{prefix}{r}{c}_im")) for c in range(2)] for r in range(2)]


def transfer(rel: Rel, order: int, n_freqs: int | Sequence[float]) -> Rel:
    if not isinstance(n_freqs, int):
        points = ", ".join(f"({k}, {float(w)!r})" for k, w in enumerate(n_freqs))
        grid = Rel(f"SELECT m.*, CAST(f.k AS INTEGER) AS f_idx, CAST(f.w AS DOUBLE) AS omega FROM ({rel}) m CROSS JOIN (VALUES {points}) f(k, w)")
    else:
        grid = Rel(f"SELECT m.*, CAST(f.range AS INTEGER) AS f_idx, f.range * {math.pi / (n_freqs - 1)!r} AS omega FROM ({rel}) m CROSS JOIN range({n_freqs}) f")
    out = _stage(grid, "a", G.lag_polynomial(lambda k, r, c: Sql(f"c{k}{r}{c}"), order, Sql("omega")))
    return _stage(out, "h", G.inverse(_named("a")))


def density(rel: Rel, order: int, n_freqs: int) -> Rel:
    out = transfer(rel, order, n_freqs)
    # the products of H and Sigma first, so that expressions stay short
    h = _named("h")
    out = _stage(out, "p", [[h[r][0].times(_sigma(0, c)) + h[r][1].times(_sigma(1, c)) for c in range(2)] for r in range(2)])
    p = _named("p")
    return _stage(out, "s", [[p[r][0] * h[c][0].conj() + p[r][1] * h[c][1].conj() for c in range(2)] for r in range(2)])


def long_form(rel: Rel, prefix: str) -> Rel:
    return Rel(" UNION ALL ".join(f"SELECT series_id, f_idx, omega, {r} AS row, {c} AS col, {prefix}{r}{c}_re AS re, {prefix}{r}{c}_im AS im FROM ({rel})" for r in range(2) for c in range(2)))


def plain_gc(rel: Rel, order: int, n_freqs: int) -> Rel:
    return transfer(rel, order, n_freqs).stage(gc=G.plain_spectral_gc(_named("h"), _sigma)).pick("series_id", "f_idx", "omega", "gc")


def geweke_gc(rel: Rel, order: int, n_freqs: int) -> Rel:
    return transfer(rel, order, n_freqs).stage(gc=G.geweke_gc(_named("h"), _sigma)).pick("series_id", "f_idx", "omega", "gc")
