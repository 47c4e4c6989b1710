"""Signal kernels over one trial's arrays, in numpy."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, cutoff: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass b, a: prewarped poles, bilinear transform, unit gain at 0 Hz."""
    warped = 2 * fs * np.tan(np.pi * cutoff / fs)
    k = np.arange(1, order + 1)
    poles = warped * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    z = (2 * fs + poles) / (2 * fs - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of the filter after a long unit step."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[1:, :-1] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 64) -> np.ndarray:
    """The filter over rows of x (all columns together), BLOCK rows at a time.

    In state form s' = A s + B x, y = C s + D x. Over a block the output is what the
    state alone gives (C A^i s) and the impulse response against the block's rows.
    """
    n = len(a) - 1
    step = np.zeros((n, n))
    step[:-1, 1:] = np.eye(n - 1)
    step[:, 0] -= a[1:]
    enter = b[1:] - a[1:] * b[0]
    powers = [np.eye(n)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    free = np.stack([m[0] for m in powers[:block]])
    response = np.concatenate([[b[0]], free[:-1] @ enter])
    lag = np.arange(block)[:, None] - np.arange(block)
    driven = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    enters = np.stack([m @ enter for m in powers[:block]], axis=1)
    y, s = np.empty_like(x), state.copy()
    for i in range(0, len(x), block):
        part = x[i : i + block]
        m = len(part)
        y[i : i + m] = free[:m] @ s + driven[:m, :m] @ part
        s = powers[m] @ s + enters[:, :m][:, ::-1] @ part
    return y


def zero_phase(x: np.ndarray, cutoff: float, fs: float, order: int = 4) -> np.ndarray:
    """Forward and backward filter of columns; 15 or fewer rows come back unchanged, columns with gaps too."""
    x = np.asarray(x, np.float64)
    cols = x.reshape(len(x), -1)
    b, a = butterworth(order, cutoff, fs)
    pad = 3 * max(len(a), len(b))
    good = np.isfinite(cols).all(axis=0)
    if len(x) <= pad or not good.any():
        return x.copy()
    v = cols[:, good]
    ext = np.concatenate([2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]])
    zi = _steady(b, a)[:, None]
    y = _run(b, a, ext, zi * ext[0])[::-1]
    y = _run(b, a, y, zi * y[0])[::-1]
    out = cols.copy()
    out[:, good] = y[pad:-pad]
    return out.reshape(x.shape)


def uniform(t: np.ndarray, x: np.ndarray, least: int = 8):
    """Signal columns on a uniform grid of the median step, up to half a step beyond the last time: grid, values, rate; None if it can't be."""
    x = np.asarray(x, np.float64).reshape(len(t), -1)
    ok = np.isfinite(t) & np.isfinite(x).all(axis=1)
    t, x = np.asarray(t, np.float64)[ok], x[ok]
    order = np.argsort(t, kind="stable")
    t, x = t[order], x[order]
    keep = np.concatenate([[True], np.diff(t) > 0]) if len(t) else np.zeros(0, bool)
    t, x = t[keep], x[keep]
    if min(len(t), int(keep.sum())) < least:
        return None
    step = float(np.median(np.diff(t)))
    if not step > 0:
        return None
    grid = np.arange(t[0], t[-1] + 0.5 * step, step)
    return grid, np.stack([np.interp(grid, t, x[:, j]) for j in range(x.shape[1])], axis=1), 1 / step


def speed(t: np.ndarray, x: np.ndarray, cutoff: float = 10.0):
    """Filtered speed of a point (several columns) or of an angle (one): values and rate, or None."""
    got = uniform(t, x)
    if got is None or len(got[0]) <= 15 or cutoff >= got[2] / 2:
        return None
    _, v, fs = got
    return np.linalg.norm(zero_phase(np.gradient(v, 1 / fs, axis=0), cutoff, fs), axis=1), fs


def sparc(v: np.ndarray, fs: float, top: float = 10.0, floor: float = 0.05) -> float | None:
    """Spectral arc length of a speed profile, the smoother the nearer to 0."""
    x = float(arc_lengths(np.asarray(v, np.float64)[None], fs, top, floor)[0])
    return x if np.isfinite(x) else None


def arc_lengths(windows: np.ndarray, fs: float, top: float = 10.0, floor: float = 0.05) -> np.ndarray:
    """Spectral arc lengths of rows of speeds, NaN where there is none: one transform for all rows."""
    n, length = windows.shape
    out = np.full(n, np.nan)
    if length < 4:
        return out
    size = int(2 ** np.ceil(np.log2(length)) + 4)
    f = np.arange(size) * fs / size
    low = f <= top
    rows = np.flatnonzero(np.isfinite(windows).all(axis=1) & windows.any(axis=1))
    for a in range(0, len(rows), 4096):
        at = rows[a : a + 4096]
        m = np.abs(np.fft.fft(windows[at], size, axis=1))
        most = m.max(axis=1)
        m = m[:, low] / np.where(most > 0, most, 1)[:, None]
        up = m >= floor
        first, last = up.argmax(axis=1), up.shape[1] - 1 - up[:, ::-1].argmax(axis=1)
        span = f[last] - f[first]
        good = (most > 0) & up.any(axis=1) & (last > first)
        k = np.arange(m.shape[1] - 1)
        inside = (k >= first[:, None]) & (k < last[:, None])
        arcs = np.sqrt((fs / size / np.where(span > 0, span, 1))[:, None] ** 2 + np.diff(m, axis=1) ** 2)
        out[at] = np.where(good, -(arcs * inside).sum(axis=1), np.nan)
    return out


def window_sparc(v: np.ndarray, fs: float, size_s: float = 2.0, hop_s: float = 0.1) -> tuple[float | None, int]:
    """Median over full sliding windows, and their number."""
    size, hop = round(size_s * fs), max(1, round(hop_s * fs))
    if size < 1 or len(v) < size:
        return None, 0
    got = arc_lengths(np.lib.stride_tricks.sliding_window_view(np.asarray(v, np.float64), size)[::hop], fs)
    got = got[np.isfinite(got)]
    return (float(np.median(got)), len(got)) if len(got) else (None, 0)


def peaks(x: np.ndarray, distance: int) -> np.ndarray:
    """Interior strict maxima (middle of flat tops), from the highest down none nearer than `distance` to a kept one."""
    x = np.asarray(x, np.float64)
    if len(x) < 3:
        return np.zeros(0, int)
    edge = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(x) - 1]])
    v = x[starts]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    at = (starts[top] + ends[top]) // 2
    keep = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep[near] = False
    return at[keep]


def strokes(v: np.ndarray, fs: float, least_s: float = 0.1, least_path: float = 0.0) -> list[tuple[int, int]]:
    """Ranges between speed minima that last and travel enough; none in a profile shorter than the shortest stroke."""
    if len(v) < int(least_s * fs) + 2:
        return []
    low = peaks(-np.asarray(v), max(1, int(0.10 * fs)))
    bounds = np.unique(np.concatenate([[0], low, [len(v) - 1]])).astype(int)
    return [(int(a), int(z)) for a, z in zip(bounds[:-1], bounds[1:], strict=True) if (z - a) / fs >= least_s and v[a:z].sum() / fs >= least_path]


def log_jerk(v: np.ndarray, fs: float) -> float | None:
    """Logarithmic dimensionless jerk of a stroke's speed."""
    v = np.asarray(v, np.float64)
    if len(v) < 4 or not np.isfinite(v).all() or not v.max() > 0:
        return None
    jerk = np.diff(v, 2) * fs * fs
    total = (jerk * jerk).sum() / fs
    return float(-np.log((len(v) / fs) ** 3 * total / v.max() ** 2)) if total > 0 else None


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 42) -> float:
    """Nearest-neighbour estimate for a number and a class, floored at 0; classes of one are left out."""
    x, y = np.asarray(x, np.float64), np.asarray(y)
    n_all = len(x)
    _, back, size = np.unique(y, return_inverse=True, return_counts=True)
    ok = size[back] > 1
    x, back = x[ok], back[ok]
    n = len(x)
    if n < 2 or not n_all:
        return 0.0
    sd = x.std()
    x = x / sd if sd > 0 else x
    x = x + 1e-10 * max(1.0, float(np.abs(x).mean())) * np.random.default_rng(seed).standard_normal(n)
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])
    psi = lambda m: harmonic[np.maximum(m, 1) - 1] - 0.5772156649015329
    order = np.argsort(x, kind="stable")
    every, m, kk, nx = x[order], np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    for c in np.unique(back):
        at = np.flatnonzero(back == c)
        own = np.sort(x[at])
        near = min(k, len(at) - 1)
        p = np.searchsorted(own, x[at])
        d = np.full(len(at), np.inf)
        for lo in range(-near, 1):  # the k nearest lie in one of the k+1 runs around each value
            a, z = p + lo, p + lo + near
            fits = (a >= 0) & (z < len(own))
            span = np.maximum(x[at][fits] - own[a[fits]], own[z[fits]] - x[at][fits])
            d[fits] = np.minimum(d[fits], span)
        lo, hi = np.searchsorted(every, x[at] - d, "left"), np.searchsorted(every, x[at] + d, "right")
        while (out := np.abs(every[lo] - x[at]) >= d).any() and (lo[out] < hi[out] - 1).any():  # strictly nearer ones only
            lo = lo + (out & (lo < hi - 1))
        while (out := np.abs(every[hi - 1] - x[at]) >= d).any() and (lo[out] < hi[out] - 1).any():
            hi = hi - (out & (lo < hi - 1))
        m[at] = hi - lo
        nx[at], kk[at] = len(at), near
    return float(max(0.0, psi(np.array([n]))[0] + psi(kk).mean() - psi(nx).mean() - psi(m).mean()))


def digamma(m) -> np.ndarray:
    """Of whole numbers from 1."""
    m = np.asarray(m, np.float64)
    far = np.maximum(m, 64.0)
    table = np.concatenate([[0.0], np.cumsum(1 / np.arange(1.0, 64))]) - 0.5772156649015329
    return np.where(m < 64, table[np.clip(m, 1, 64).astype(int) - 1], np.log(far) - 1 / (2 * far) - 1 / (12 * far**2) + 1 / (120 * far**4))


def slice_neighbours(x: np.ndarray, y: np.ndarray, near: np.ndarray, k: int, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sorted numbers of a slice of a feature, with classes y and the neighbours `near` that count in each class:
    how many of all lie strictly nearer than the last of these; which numbers need other slices to tell; and each
    number's distances to the k of its class before and after it (inf: not in the slice)."""
    n = len(x)
    sides = np.full((n, 2 * k), np.inf)
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        own = x[at]
        for j in range(1, k + 1):
            sides[at[j:], j - 1] = own[j:] - own[:-j]
            sides[at[:-j], k + j - 1] = own[j:] - own[:-j]
    d = np.take_along_axis(np.sort(sides, axis=1), near[y][:, None] - 1, axis=1)[:, 0]
    open_ = (~np.isfinite(d)) | ((not first) & (x - d <= x[0])) | ((not last) & (x + d >= x[-1]))
    d = np.where(open_, 0.0, d)
    lo, hi = np.searchsorted(x, x - d, "left"), np.searchsorted(x, x + d, "right")
    while ((out := np.abs(x[lo] - x) >= d) & (lo < hi - 1)).any():  # strictly nearer ones only
        lo = lo + (out & (lo < hi - 1))
    while ((out := np.abs(x[hi - 1] - x) >= d) & (lo < hi - 1)).any():
        hi = hi - (out & (lo < hi - 1))
    return hi - lo, open_, sides


def first_loading(x: np.ndarray, least_sd: float = 1e-9) -> np.ndarray | None:
    """First principal direction of standardized columns; still columns get 0."""
    sd = x.std(axis=0)
    live = sd > least_sd
    if live.sum() < 2 or len(x) < 2:
        return None
    z = (x[:, live] - x[:, live].mean(axis=0)) / sd[live]
    _, vec = np.linalg.eigh(z.T @ z / len(z))
    out = np.zeros(x.shape[1])
    v = vec[:, -1]
    out[live] = v * (1 if v[np.argmax(np.abs(v))] >= 0 else -1)
    return out


class Recurrent:
    """Two-layer GRU or LSTM with a linear output on the last state; Adam, weighted cross-entropy, early stop."""

    def __init__(self, inputs: int, classes: int, kind: str = "gru", hidden: int = 64, layers: int = 2, dropout: float = 0.3, seed: int = 42):
        self.kind, self.hidden, self.layers, self.dropout = kind, hidden, layers, dropout
        self.rng = np.random.default_rng(seed)
        gates, scale = (3 if kind == "gru" else 4), 1 / np.sqrt(hidden)
        self.p = {}
        for k in range(layers):
            n = inputs if k == 0 else hidden
            self.p |= {f"W{k}": self.rng.uniform(-scale, scale, (n, gates * hidden)), f"U{k}": self.rng.uniform(-scale, scale, (hidden, gates * hidden)), f"b{k}": np.zeros(gates * hidden)}
        self.p |= {"O": self.rng.uniform(-scale, scale, (hidden, classes)), "o": np.zeros(classes)}

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def forward(self, x: np.ndarray, lens: np.ndarray, train: bool = False):
        """x: batch, time, channels, zero-padded; a state stays as it is after a sequence's end."""
        b, n, _ = x.shape
        h_n, tape, seq = self.hidden, [], x
        for k in range(self.layers):
            w, u, bias = self.p[f"W{k}"], self.p[f"U{k}"], self.p[f"b{k}"]
            h, c, steps, out = np.zeros((b, h_n)), np.zeros((b, h_n)), [], np.zeros((b, n, h_n))
            drive = seq @ w + bias
            for t in range(n):
                live = (t < lens)[:, None]
                if self.kind == "gru":
                    rec = h @ u
                    r, z = self._sigmoid(drive[:, t, :h_n] + rec[:, :h_n]), self._sigmoid(drive[:, t, h_n : 2 * h_n] + rec[:, h_n : 2 * h_n])
                    cand = np.tanh(drive[:, t, 2 * h_n :] + r * rec[:, 2 * h_n :])
                    new = (1 - z) * cand + z * h
                    steps.append((h, None, r, z, cand, rec[:, 2 * h_n :], live))
                    h = np.where(live, new, h)
                else:
                    g = drive[:, t] + h @ u
                    i, f, o = (self._sigmoid(g[:, j * h_n : (j + 1) * h_n]) for j in (0, 1, 3))
                    cand = np.tanh(g[:, 2 * h_n : 3 * h_n])
                    nc = f * c + i * cand
                    steps.append((h, c, i, f, cand, (o, nc), live))
                    h, c = np.where(live, o * np.tanh(nc), h), np.where(live, nc, c)
                out[:, t] = h
            mask = None
            if k + 1 < self.layers and train and self.dropout:
                mask = (self.rng.random(out.shape) >= self.dropout) / (1 - self.dropout)
            tape.append((seq, steps, mask))
            seq = out * mask if mask is not None else out
        if train and self.dropout:
            drop = (self.rng.random(h.shape) >= self.dropout) / (1 - self.dropout)
            return (h * drop) @ self.p["O"] + self.p["o"], (h, drop), tape
        return h @ self.p["O"] + self.p["o"], (h, None), tape

    def gradients(self, x, lens, y, weight):
        logits, (last, drop), tape = self.forward(x, lens, train=True)
        q = np.exp(logits - logits.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        w = weight[y]
        loss = float(-(w * np.log(q[np.arange(len(y)), y] + 1e-12)).sum() / w.sum())
        d = q.copy()
        d[np.arange(len(y)), y] -= 1
        d *= (w / w.sum())[:, None]
        g = {"O": (last if drop is None else last * drop).T @ d, "o": d.sum(axis=0)}
        h_n, n = self.hidden, x.shape[1]
        above = np.zeros((len(y), n, h_n))
        final = d @ self.p["O"].T * (1 if drop is None else drop)
        for k in reversed(range(self.layers)):
            seq, steps, mask = tape[k]
            u = self.p[f"U{k}"]
            dh, dc = (final if k + 1 == self.layers else np.zeros_like(final)), np.zeros_like(final)
            ddrive, du = np.zeros((len(y), n, u.shape[1])), np.zeros_like(u)
            for t in reversed(range(n)):
                h, c, a1, a2, cand, extra, live = steps[t]
                dh = dh + above[:, t]
                now, keep = np.where(live, dh, 0), np.where(live, 0, dh)
                if self.kind == "gru":
                    r, z = a1, a2
                    dcand, dz = now * (1 - z) * (1 - cand * cand), now * (h - cand) * z * (1 - z)
                    dr = dcand * extra * r * (1 - r)
                    ddrive[:, t] = np.concatenate([dr, dz, dcand], axis=1)
                    drec = np.concatenate([dr, dz, dcand * r], axis=1)
                    dh = keep + now * z + drec @ u.T
                else:
                    (o, nc), i, f = extra, a1, a2
                    tanh = np.tanh(nc)
                    dnc = now * o * (1 - tanh * tanh) + np.where(live, dc, 0)
                    drec = np.concatenate([dnc * cand * i * (1 - i), dnc * c * f * (1 - f), dnc * i * (1 - cand * cand), now * tanh * o * (1 - o)], axis=1)
                    ddrive[:, t] = drec
                    dc = np.where(live, dnc * f, dc)
                    dh = keep + drec @ u.T
                du += h.T @ drec
            g[f"W{k}"] = np.einsum("bti,btj->ij", seq, ddrive)
            g[f"U{k}"], g[f"b{k}"] = du, ddrive.sum(axis=(0, 1))
            above = ddrive @ self.p[f"W{k}"].T
            if k and tape[k - 1][2] is not None:
                above = above * tape[k - 1][2]
        return loss, g

    def fit(self, xs, ys, val, classes: int, epochs: int = 20, batch: int = 16, rate: float = 1e-3, patience: int = 5, decay: float = 1e-4):
        ys = np.asarray(ys)
        count = np.bincount(ys, minlength=classes)
        weight = len(ys) / (classes * np.maximum(count, 1))
        m, s, t, best, kept, bad = {}, {}, 0, -1.0, None, 0
        for _ in range(epochs):
            order = self.rng.permutation(len(xs))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                x, lens = padded([xs[j] for j in rows])
                by = np.argsort([-len(xs[j]) for j in rows], kind="stable")
                _, g = self.gradients(x, lens, ys[rows[by]], weight)
                norm = np.sqrt(sum((v * v).sum() for v in g.values()))
                t += 1
                for k, v in g.items():
                    v = v * min(1.0, 5 / (norm + 1e-12)) + decay * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * v
                    s[k] = 0.999 * s.get(k, 0) + 0.001 * v * v
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
            score = balanced_accuracy(np.asarray(val[1]), self.predict(val[0]), classes)
            if score > best:
                best, kept, bad = score, {k: v.copy() for k, v in self.p.items()}, 0
            else:
                bad += 1
                if bad >= patience:
                    break
        self.p = kept or self.p
        return best

    def predict(self, xs) -> np.ndarray:
        out = np.zeros(len(xs), int)
        for i in range(0, len(xs), 64):
            part = list(range(i, min(i + 64, len(xs))))
            x, lens = padded([xs[j] for j in part])
            by = np.argsort([-len(xs[j]) for j in part], kind="stable")
            out[np.array(part)[by]] = self.forward(x, lens)[0].argmax(axis=1)
        return out


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, the longest first, filled with zeros behind; and their lengths."""
    xs = sorted(xs, key=lambda x: -len(x))
    lens = np.array([len(x) for x in xs])
    out = np.zeros((len(xs), int(lens.max()), xs[0].shape[1]))
    for i, x in enumerate(xs):
        out[i, : len(x)] = x
    return out, lens


def balanced_accuracy(y: np.ndarray, p: np.ndarray, classes: int) -> float:
    got = [float((p[y == c] == c).mean()) for c in range(classes) if (y == c).any()]
    return float(np.mean(got)) if got else 0.0
