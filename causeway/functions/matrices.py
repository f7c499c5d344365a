"""Dense numerics of one series, for grouped functions: NumPy alone, any number of channels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np


def moment_matrix(flat, size: int) -> np.ndarray:
    """The symmetric matrix whose upper triangle is ``flat``, row by row."""
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = flat
    return m + np.triu(m, 1).T


def solve_moments(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Coefficients (regressors x targets) from sums of products, of least norm where regressors are collinear; columns are scaled first."""
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    scaled = g / np.outer(scale, scale)
    return np.linalg.lstsq(scaled, c / scale[:, None], rcond=1e-13)[0] / scale[:, None]


def ill_conditioned(g: np.ndarray) -> bool:
    """Whether sums of products are too near to singular for a fit through them."""
    d = np.diag(g)
    if len(d) == 0 or (d <= 0).any():
        return len(d) > 0
    return np.linalg.det(g / np.sqrt(np.outer(d, d))) < 1e-10


def residual_covariance(m: np.ndarray, targets: list[int], regressors: list[int], b: np.ndarray) -> np.ndarray:
    """Covariance of residuals about their means; index 0 of ``m`` is the constant."""
    n = m[0, 0]
    y, x = np.ix_(targets, targets), np.ix_(regressors, regressors)
    cross = m[np.ix_(regressors, targets)]
    squares = m[y] - b.T @ cross - cross.T @ b + b.T @ m[x] @ b
    mean = (m[0, targets] - m[0, regressors] @ b) / n
    return squares / n - np.outer(mean, mean)


def order_moments(size: int, total: np.ndarray, sums: np.ndarray, head: np.ndarray, tail: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the sums of products of (1, samples, lags) over its usable rows, without the rows themselves.

    ``sums[h]`` is that of x(s) x(s - h)' over a series of ``size`` samples, ``head`` and ``tail`` are its first and last ones.
    A product of lags a <= b over the rows from p on is sums[b - a] without its first p - a and last a samples.
    """
    most, n = len(sums) - 1, len(total)
    first = np.zeros((most + 1, most + 1, n, n))  # [h, m]: of the samples s < m
    last = np.zeros((most + 1, most + 1, n, n))  # [h, a]: of the last a samples
    for h in range(most + 1):
        for m in range(1, min(most, len(head)) + 1):
            first[h, m] = first[h, m - 1] + (np.outer(head[m - 1], head[m - 1 - h]) if m - 1 >= h else 0)
        for a in range(1, len(tail) - h + 1):
            last[h, a] = last[h, a - 1] + np.outer(tail[-a], tail[len(tail) - a - h])
    starts = np.concatenate([np.zeros((1, n)), np.cumsum(head, axis=0)])
    ends = np.concatenate([np.zeros((1, n)), np.cumsum(tail[::-1], axis=0)])
    for p in range(1, most + 1):
        if size - p <= n * p:
            return
        m = np.zeros((1 + n * (p + 1),) * 2)
        m[0, 0] = size - p
        for a in range(p + 1):
            rows = slice(1 + n * a, 1 + n * (a + 1))
            m[0, rows] = m[rows, 0] = total - starts[p - a] - ends[a]
            for b in range(a, p + 1):
                h, columns = b - a, slice(1 + n * b, 1 + n * (b + 1))
                m[rows, columns] = sums[h] - first[h, p - a] - last[h, a]
                m[columns, rows] = m[rows, columns].T
        yield p, m


def lag_matrix(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets and the lags 1..order of all channels, lag by lag."""
    t = len(data)
    return data[order:], np.hstack([data[order - k : t - k] for k in range(1, order + 1)])


def fit_var(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (order, n, n), covariance and residuals by an orthogonal factorization."""
    y, x = lag_matrix(data, order)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ b
    n = data.shape[1]
    return b.reshape(order, n, n).transpose(0, 2, 1), np.atleast_2d(np.cov(r.T, bias=True)), r


def gc_of(data: np.ndarray, source: int, target: int, conditioning: list[int], order: int) -> float:
    """Conditional causality of one series, by an orthogonal factorization."""

    def spread(channels: list[int]) -> float:
        y, x = data[order:, target], lag_matrix(data[:, channels], order)[1]
        return float(np.var(y - x @ np.linalg.lstsq(x, y, rcond=None)[0]))

    return math.log(spread([target, *conditioning]) / spread([target, source, *conditioning]))


def companion(coefs: np.ndarray) -> np.ndarray:
    """The block companion matrix of (order, n, n) coefficients."""
    p, n, _ = coefs.shape
    c = np.zeros((n * p, n * p))
    c[:n] = np.concatenate(list(coefs), axis=1)
    c[n:, :-n] = np.eye(n * (p - 1))
    return c


def transfer(coefs: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A(w) and H(w) = A(w)^-1 on a grid, (F, n, n) each."""
    p, n, _ = coefs.shape
    turn = np.exp(-1j * np.outer(omega, np.arange(1, p + 1)))
    a = np.eye(n) - np.einsum("fk,kij->fij", turn, coefs)
    return a, np.linalg.inv(a)


def spectral_density(coefs: np.ndarray, sigma: np.ndarray, omega: np.ndarray) -> np.ndarray:
    h = transfer(coefs, omega)[1]
    return h @ sigma @ h.conj().transpose(0, 2, 1)


def lyapunov(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """P = A P A' + Q."""
    n = len(a)
    return np.linalg.solve(np.eye(n * n) - np.kron(a, a), q.ravel()).reshape(n, n)


def reduced_innovation(a: np.ndarray, q: np.ndarray, observed: list[int], most: int = 5000, tolerance: float = 1e-10) -> np.ndarray:
    """Innovation covariance of the observed states alone, by iterating their Riccati equation from the stationary covariance."""
    try:
        p = lyapunov(a, q)
    except np.linalg.LinAlgError:
        p = np.eye(len(a))
    before = None
    for _ in range(most):
        s = p[np.ix_(observed, observed)]
        if before is not None and np.linalg.norm(s - before) / (np.linalg.norm(before) + 1e-12) < tolerance:
            break
        before = s
        gain = p[:, observed] @ np.linalg.pinv(s)
        left = p - gain @ p[observed]
        p = a @ left @ a.T + q
        p = (p + p.T) / 2
    return p[np.ix_(observed, observed)]


def model_gc(a: np.ndarray, q: np.ndarray, source: int, target: int, conditioning: list[int] | None = None, clip: bool = True, as_coded: bool = False) -> float:
    """Causality that a model implies, with the infinite past.

    ``as_coded`` takes the innovation of all states as the full model's, as if all of them were given;
    by default it is that of target, source and conditioning. Tiny negative values become 0 if ``clip``.
    """
    conditioning = list(conditioning or [])
    reduced = reduced_innovation(a, q, [target, *conditioning])[0, 0]
    whole = sorted({target, source, *conditioning}) == list(range(len(a)))
    full = q[target, target] if as_coded or whole else reduced_innovation(a, q, [target, source, *conditioning])[0, 0]
    gc = math.log(reduced / full)
    return 0.0 if clip and -1e-8 < gc < 0 else gc


def dpss(n: int, time_bandwidth: float, tapers: int, periodic: bool = True) -> np.ndarray:
    """Slepian tapers (tapers, n) of unit energy, from the commuting tridiagonal matrix (Slepian 1978).

    ``periodic`` makes them one sample longer and drops the last. Eigenvectors come from inverse
    iteration on the tridiagonal matrix, so that nothing of size n x n is built.
    """
    m = n + 1 if periodic else n
    w = time_bandwidth / m
    k = np.arange(m)
    diagonal = ((m - 1 - 2 * k) / 2.0) ** 2 * math.cos(2 * math.pi * w)
    beside = k[1:] * (m - k[1:]) / 2.0
    values = _largest_eigenvalues(diagonal, beside, tapers)
    out = np.zeros((tapers, m))
    for j, value in enumerate(values):
        v = np.random.default_rng(j).normal(size=m)
        shift = value + 1e-10 * abs(value)
        for _ in range(4):
            for before in out[:j]:
                v -= (before @ v) * before
            v = _tridiagonal_solve(diagonal - shift, beside, v)
            v /= np.linalg.norm(v)
        sign = v.sum() if j % 2 == 0 else ((m - 1 - 2 * k) * v).sum()
        out[j] = v if sign >= 0 else -v
    return out[:, :n]


def _largest_eigenvalues(d: np.ndarray, e: np.ndarray, count: int) -> list[float]:
    """By bisection on Sturm counts, all candidates at once."""
    radius = np.abs(np.concatenate(([0], e))) + np.abs(np.concatenate((e, [0])))
    low = np.full(count, (d - radius).min())
    high = np.full(count, (d + radius).max())
    wanted = len(d) - np.arange(count)  # so many eigenvalues lie at or below the j-th largest one
    squares = np.concatenate(([0.0], e * e))
    for _ in range(64):
        middle = (low + high) / 2
        below, q = np.zeros(count, np.int64), np.ones(count)
        for i in range(len(d)):
            q = d[i] - middle - squares[i] / np.where(np.abs(q) < 1e-300, 1e-300, q)
            below += q < 0
        up = below < wanted
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return ((low + high) / 2).tolist()


def _tridiagonal_solve(d: np.ndarray, e: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaussian elimination with row exchanges of a symmetric tridiagonal system."""
    n = len(d)
    a, c, f, x = d.astype(float).tolist(), [*e.tolist(), 0.0], [0.0] * n, b.tolist()
    under = e.tolist()
    for i in range(n - 1):
        if abs(a[i]) >= abs(under[i]):
            t = under[i] / (a[i] or 1e-300)
            a[i + 1] -= t * c[i]
            x[i + 1] -= t * x[i]
        else:
            t = a[i] / under[i]
            a[i], a[i + 1], c[i] = under[i], c[i] - t * a[i + 1], a[i + 1]
            if i + 1 < n - 1:
                f[i], c[i + 1] = c[i + 1], -t * c[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - t * x[i + 1]
    for i in range(n - 1, -1, -1):
        s = x[i] - (c[i] * x[i + 1] if i + 1 < n else 0) - (f[i] * x[i + 2] if i + 2 < n else 0)
        x[i] = s / (a[i] or 1e-300)
    return np.array(x)


def multitaper(data: np.ndarray, fs: float = 1.0, time_bandwidth: float = 3.0, tapers: int | None = None, n_fft: int | None = None, demean: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies in radians a sample and cross-spectra (F, n, n), averaged over tapers."""
    if data.ndim != 2:
        raise ValueError("data must have the shape (time, channels)")
    n = len(data)
    tapers = tapers or int(2 * time_bandwidth - 1)
    n_fft = n_fft or n
    if n_fft < n:
        raise ValueError("n_fft must not be smaller than the number of samples")
    if demean:
        data = data - data.mean(axis=0)
    x = np.fft.rfft(dpss(n, time_bandwidth, tapers)[:, :, None] * data[None], n_fft, axis=1)
    s = np.einsum("kfi,kfj->fij", x, x.conj()) / tapers
    return 2 * np.pi * np.fft.rfftfreq(n_fft, 1 / fs) / fs, (s + s.conj().transpose(0, 2, 1)) / 2


def two_sided(s: np.ndarray) -> np.ndarray:
    """A one-sided spectrum of an even number of points, with its mirror."""
    return np.concatenate([s, s[-2:0:-1].conj()])


def _star(m: np.ndarray) -> np.ndarray:
    return m.conj().transpose(0, 2, 1)


def _finer(full: np.ndarray, size: int) -> np.ndarray:
    """A spectrum around the circle at ``size`` points, by its own autocovariances."""
    c, half = np.fft.ifft(full, axis=0), len(full) // 2
    out = np.zeros((size, *full.shape[1:]), complex)
    out[:half], out[size - half + 1 :] = c[:half], c[half + 1 :]
    out[half] += c[half] / 2
    out[size - half] += c[half] / 2
    return np.fft.fft(out, axis=0)


def _tail(full: np.ndarray) -> float:
    """The largest coefficient in the half of the circle that is farthest from lag 0, as a share of the largest of all."""
    size = np.linalg.norm(np.fft.ifft(full, axis=0), axis=(1, 2))
    return float(size[len(size) // 4 : len(size) - len(size) // 4].max() / size.max())


def _wilson_start(full: np.ndarray, regularization: float = 0.0) -> np.ndarray:
    root = np.linalg.cholesky(full.mean(axis=0).real + regularization * np.eye(full.shape[1]))
    return np.tile(root.astype(complex), (len(full), 1, 1))


def _wilson_step(full: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, float]:
    """The next factor, and how far psi^-1 S psi^-* of this one is from the identity.

    What is added comes from S - psi psi*: the step then loses no more than a rounding of S, while psi^-1 S psi^-* itself loses its condition's digits.
    Coefficient ``half`` is lag half as well as lag -half: both sides get one half of it, as of lag 0. Without it no factor
    of a spectrum with long memory gives the spectrum back, and the iteration stands still.
    """
    n, half = full.shape[1], len(full) // 2
    back = np.linalg.inv(psi)
    g = back @ (full - psi @ _star(psi)) @ _star(back)
    gap = float(np.linalg.norm(g, axis=(1, 2)).max())
    g = np.fft.ifft(g, axis=0)
    g[0] = np.tril(g[0])
    g[0][np.diag_indices(n)] /= 2
    g[half] /= 2
    g[half + 1 :] = 0
    return psi + psi @ np.fft.fft(g, axis=0), gap


def _wilson_smooth(full: np.ndarray, most: int, short: float = 1e-6, alias: float = 1e-8, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Factor, its coefficient of lag 0 and steps taken, if the autocovariances of the spectrum or of its inverse end within the grid.

    Those (of an autoregression the inverse's, however near to a unit root) say what the spectrum is between its points, so the iteration
    may run on a grid that is fine enough for the factor's inverse, which has a long memory: ``cells`` numbers at most.
    """
    n = full.shape[1]
    turned = np.linalg.inv(full).conj()
    tails = _tail(full), _tail(turned)
    inverse = tails[0] > max(tails[1], 1e-13)
    if tails[inverse] > short:
        return None
    points = turned if inverse else full
    size, best, steps = len(full), None, 0
    while best is None or size * n * n <= cells:
        fine = _finer(points, size) if size > len(full) else points
        fine = (fine + _star(fine)) / 2
        if not np.linalg.eigvalsh(fine).min() > 0:
            break
        psi, last = _wilson_start(fine), math.inf
        for _ in range(most):
            psi, gap = _wilson_step(fine, psi)
            steps += 1
            if gap < 1e-10 or last <= gap < 1e-3:
                break
            last = gap
        best = psi
        if max(_tail(psi), _tail(np.linalg.inv(psi))) < alias:
            break
        size *= 4
    if best is None:
        return None
    r0 = np.fft.ifft(best, axis=0)[0].real
    best = best[:: len(best) // len(full)]
    return (np.linalg.inv(best.transpose(0, 2, 1)), np.linalg.inv(r0.T), steps) if inverse else (best, r0, steps)


def wilson(s: np.ndarray, most: int = 200, tolerance: float = 1e-5, regularization: float = 1e-8) -> dict:
    """Minimum-phase factorization of a one-sided spectrum (F, n, n) by Wilson's iteration (1972).

    It starts from the factor on a finer grid where the spectrum tells what is between its points, else from a constant.
    """
    if s.ndim != 3 or most < 1 or len(s) < 2:
        raise ValueError("a spectrum (frequency, n, n) and an iteration at least are needed")
    f, n, _ = s.shape
    full = two_sided((s + _star(s)) / 2 + regularization * np.eye(n))
    try:
        start = _wilson_smooth(full, most)
    except np.linalg.LinAlgError:  # singular to the last digit
        start = None
    psi, r0, steps = start or (_wilson_start(full, regularization), None, 0)
    errors, converged = [], False
    for _ in range(most):
        psi, _ = _wilson_step(full, psi)
        again = psi @ _star(psi)
        errors.append(float((np.linalg.norm(full - again, axis=(1, 2)) / (np.linalg.norm(full, axis=(1, 2)) + 1e-12)).max()))
        if errors[-1] < tolerance:
            converged = True
            break
    r0 = np.fft.ifft(psi, axis=0)[0].real if r0 is None else r0
    h, covariance = psi @ np.linalg.inv(r0), r0 @ r0.T
    return {"transfer": h[:f], "covariance": covariance, "factor": h[:f] @ np.linalg.cholesky(covariance), "errors": errors, "converged": converged, "iterations": steps + len(errors)}


def geweke_from_factor(s: np.ndarray, h: np.ndarray, sigma: np.ndarray, clip: bool = True) -> np.ndarray:
    """Geweke's measure 1 -> 0 with the empirical spectrum of the target."""
    own = h[:, 0, 0] + sigma[0, 1] / sigma[0, 0] * h[:, 0, 1]
    gc = np.log(s[:, 0, 0].real / (sigma[0, 0] * np.abs(own) ** 2))
    return np.where((gc > -1e-8) & (gc < 0), 0.0, gc) if clip else gc


def rls(data: np.ndarray, order: int, forgetting: float) -> np.ndarray:
    """The coefficients (T - order, n, n * order) after each update of recursive least squares."""
    t, n = data.shape
    theta, p = np.zeros((n, n * order)), 1000.0 * np.eye(n * order)
    out = np.empty((max(0, t - order), n, n * order))
    for s in range(order, t):
        phi = data[s - order : s][::-1].ravel()
        theta, p = rls_step(theta, p, phi, data[s], forgetting)
        out[s - order] = theta
    return out


def rls_step(theta: np.ndarray, p: np.ndarray, phi: np.ndarray, y: np.ndarray, forgetting: float) -> tuple[np.ndarray, np.ndarray]:
    pushed = p @ phi
    gain = pushed / (forgetting + phi @ pushed)
    return theta + np.outer(y - theta @ phi, gain), (p - np.outer(gain, pushed)) / forgetting


def kalman(y, u, a, b, q, r, c=None, d=None, mean0=None, cov0=None) -> dict:
    """Filter of x_t = A x_{t-1} + B u_t + w, y_t = C x_t + D u_t + v; covariances in Joseph's form. The first prediction ignores u_0."""
    t, n = len(y), len(a)
    c = np.eye(n) if c is None else c
    d = np.zeros((len(c), u.shape[1])) if d is None else d
    mean = np.zeros(n) if mean0 is None else mean0
    cov = 100.0 * np.eye(n) if cov0 is None else cov0
    out = {k: np.zeros((t, n)) for k in ("x_pred", "x_filt")} | {k: np.zeros((t, n, n)) for k in ("p_pred", "p_filt")}
    total = 0.0
    for s in range(t):
        if s:
            mean, cov = a @ mean + b @ u[s], a @ cov @ a.T + q
        out["x_pred"][s], out["p_pred"][s] = mean, cov
        miss, spread = y[s] - c @ mean - d @ u[s], c @ cov @ c.T + r
        gain = np.linalg.solve(spread.T, c @ cov.T).T
        mean = mean + gain @ miss
        keep = np.eye(n) - gain @ c
        cov = keep @ cov @ keep.T + gain @ r @ gain.T
        out["x_filt"][s], out["p_filt"][s] = mean, cov
        sign, size = np.linalg.slogdet(spread)
        if sign > 0:
            total -= 0.5 * (len(miss) * math.log(2 * math.pi) + size + miss @ np.linalg.solve(spread, miss))
    return out | {"log_likelihood": total}


def smooth(f: dict, a: np.ndarray) -> dict:
    """Rauch-Tung-Striebel smoother of what kalman() returned."""
    x, p = f["x_filt"].copy(), f["p_filt"].copy()
    t, n = x.shape
    lag, j = np.zeros((t, n, n)), np.zeros((t, n, n))
    for s in range(t - 2, -1, -1):
        j[s] = f["p_filt"][s] @ a.T @ np.linalg.pinv(f["p_pred"][s + 1])
        x[s] += j[s] @ (x[s + 1] - f["x_pred"][s + 1])
        p[s] += j[s] @ (p[s + 1] - f["p_pred"][s + 1]) @ j[s].T
        p[s] = (p[s] + p[s].T) / 2
    lag[1:] = p[1:] @ j[:-1].transpose(0, 2, 1)
    return {"x_smooth": x, "p_smooth": p, "p_lag_one": lag}


def em(y, u, c=None, d=None, most: int = 50, tolerance: float = 1e-4, ridge: float = 1e-6, q_floor: float = 1e-8, r_floor: float = 1e-8) -> dict:
    """Expectation-maximization of A, B, Q and R; with C (and D) known, from the pseudo-inverse of the observations."""
    known = c is not None
    m, o = u.shape[1], y.shape[1]
    c = np.eye(o) if c is None else np.asarray(c, float)
    n = c.shape[1]
    d = np.zeros((o, m)) if d is None else np.asarray(d, float)
    proxy = (y - u @ d.T) @ np.linalg.pinv(c).T if known else y
    z = np.hstack([proxy[:-1], u[1:]])
    theta = np.linalg.lstsq(z, proxy[1:], rcond=None)[0].T
    a, b = theta[:, :n], theta[:, n:]
    spread = np.atleast_2d(np.cov((proxy[1:] - z @ theta.T).T, bias=True))
    q = (spread if known else 0.5 * spread) + q_floor * np.eye(n)
    if known:
        r = np.atleast_2d(np.cov((y - proxy @ c.T - u @ d.T).T, bias=True)) + (0.1 + r_floor) * np.eye(o)
    else:
        r = 0.5 * np.diag(np.var(y, axis=0)) + r_floor * np.eye(o)
    likelihood: list[float] = []
    for _ in range(most):
        f = kalman(y, u, a, b, q, r, c, d)
        s = smooth(f, a)
        likelihood.append(f["log_likelihood"])
        if len(likelihood) > 1 and abs(likelihood[-1] - likelihood[-2]) < tolerance:
            break
        x, p, lag = s["x_smooth"], s["p_smooth"], s["p_lag_one"]
        phi = np.hstack([x[:-1], u[1:]])
        s_phi = phi.T @ phi
        s_phi[:n, :n] += p[:-1].sum(axis=0)
        s_cross = x[1:].T @ phi
        s_cross[:, :n] += lag[1:].sum(axis=0)
        s_x = x[1:].T @ x[1:] + p[1:].sum(axis=0)
        theta = s_cross @ np.linalg.pinv(s_phi + ridge * np.eye(n + m))
        a, b = theta[:, :n], theta[:, n:]
        q = (s_x - theta @ s_cross.T) / (len(y) - 1)
        q = (q + q.T) / 2 + q_floor * np.eye(n)
        miss = y - x @ c.T - u @ d.T
        r = (miss.T @ miss + (c @ p @ c.T).sum(axis=0)) / len(y)
        r = (r + r.T) / 2 + r_floor * np.eye(o)
    f = kalman(y, u, a, b, q, r, c, d)
    return {"a": a, "b": b, "q": q, "r": r, "log_likelihoods": likelihood} | f | smooth(f, a)


def simulate_var(coefs: np.ndarray, sigma: np.ndarray, n: int, burn_in: int, rng: np.random.Generator) -> np.ndarray:
    """A stationary process from zeros; ``coefs`` is (order, k, k), or (burn_in + n, order, k, k) where it changes."""
    varying = coefs.ndim == 4
    order, k = coefs.shape[-3], coefs.shape[-1]
    noise = rng.multivariate_normal(np.zeros(k), sigma, burn_in + n)
    x = np.zeros((burn_in + n, k))
    for t in range(order, burn_in + n):
        now = coefs[t] if varying else coefs
        x[t] = noise[t] + sum(now[j] @ x[t - 1 - j] for j in range(order))
    return x[burn_in:]
