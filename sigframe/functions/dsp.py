"""Signal kernels in NumPy: FIR and Butterworth filters, resampling, Welch spectra, FastICA.

All of them work on the last axis of real arrays and have no state.
"""

from __future__ import annotations

import itertools

import numpy as np


def firwin(kind: str, sfreq: float, *, l_freq: float | None = None, h_freq: float | None = None, notch: float | None = None, width: float | None = None) -> np.ndarray:
    """Taps of a Hamming-windowed sinc filter of odd length; its transition is a quarter of the lowest edge, within 1 and 4 Hz."""
    edges = [f for f in (l_freq, h_freq, notch) if f]
    trans = width or float(np.clip(0.25 * min(edges), 1.0, 4.0))
    n = int(np.ceil(3.3 * sfreq / trans)) // 2 * 2 + 1
    t = np.arange(n) - n // 2

    def low(f: float) -> np.ndarray:
        h = np.sinc(2 * f / sfreq * t) * np.hamming(n)
        return h / h.sum()

    delta = (t == 0).astype(float)
    if kind == "lowpass":
        return low(h_freq)
    if kind == "highpass":
        return delta - low(l_freq)
    if kind == "bandpass":
        return low(h_freq) - low(l_freq)
    return delta - (low(notch + trans) - low(max(notch - trans, trans / 4)))


def fir_with_halo(before, mid, after, taps: np.ndarray, half: int) -> np.ndarray:
    """``mid`` filtered with the neighbouring samples; beyond the recording's ends the signal is reflected oddly."""
    mid = np.asarray(mid, float)
    left, right = np.asarray(before, float)[-half:], np.asarray(after, float)[:half]
    x = np.concatenate([left, mid, right])
    need_l, need_r = half - len(left), half - len(right)
    if need_l:
        k = min(need_l, len(x) - 1)
        x = np.concatenate([np.full(need_l - k, 2 * x[0] - x[k]), 2 * x[0] - x[k:0:-1], x])
    if need_r:
        k = min(need_r, len(x) - 1)
        x = np.concatenate([x, 2 * x[-1] - x[-2 : -k - 2 : -1], np.full(need_r - k, 2 * x[-1] - x[-k - 1])])
    return np.convolve(x, taps, "valid")


def butter_sections(order: int, low: float, high: float, sfreq: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a digital Butterworth band-pass, by the bilinear transform of the analogue prototype."""
    fs2 = 2.0
    warp = fs2 * 2 * np.tan(np.pi * np.array([low, high]) / sfreq)
    bw, w0 = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    p = poles * bw / 2
    p = np.concatenate([p + np.sqrt(p * p - w0 * w0), p - np.sqrt(p * p - w0 * w0)])
    k = bw**order
    z = np.zeros(order)
    fs = 2 * fs2
    pd, zd = (fs + p) / (fs - p), (fs + z) / (fs - z)
    gain = np.real(k * np.prod(fs - z) / np.prod(fs - p))
    zd = np.concatenate([zd, -np.ones(len(pd) - len(zd))])
    upper = sorted(pd[pd.imag >= 0], key=lambda c: abs(c))
    zeros = sorted(zd.real)
    out = []
    for i, q in enumerate(upper[:order]):
        b = np.poly([zeros[i], zeros[-1 - i]]).real
        a = np.poly([q, q.conjugate()]).real
        out.append((b, a))
    out[0] = (out[0][0] * gain, out[0][1])
    return out


def _sosfilt(sections, x: np.ndarray) -> np.ndarray:
    y = np.array(x, float)
    for b, a in sections:
        z0, z1 = np.zeros(y.shape[:-1]), np.zeros(y.shape[:-1])
        out = np.empty_like(y)
        for i in range(y.shape[-1]):
            v = y[..., i]
            o = b[0] * v + z0
            z0 = b[1] * v - a[1] * o + z1
            z1 = b[2] * v - a[2] * o
            out[..., i] = o
        y = out
    return y


def butter_bandpass_filter(x: np.ndarray, low: float, high: float, sfreq: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band-pass: forward and backward over an oddly extended signal."""
    if not 0 < low < high < sfreq / 2:
        raise ValueError("0 < low < high < half the rate")
    sections = butter_sections(order, low, high, sfreq)
    x = np.asarray(x, float)
    pad = min(x.shape[-1] - 1, 3 * (2 * order + 1))
    ext = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1) if pad > 0 else x
    y = _sosfilt(sections, _sosfilt(sections, ext)[..., ::-1])[..., ::-1]
    return y[..., pad : pad + x.shape[-1]]


def resample(x: np.ndarray, n_new: int) -> np.ndarray:
    """``n_new`` samples by the Fourier method."""
    x = np.asarray(x, float)
    n = x.shape[-1]
    spec = np.fft.rfft(x, axis=-1)
    m = min(n, n_new)
    out = np.zeros((*x.shape[:-1], n_new // 2 + 1), complex)
    k = m // 2 + 1
    out[..., :k] = spec[..., :k]
    if m % 2 == 0 and n_new != n:
        out[..., m // 2] *= 0.5 if n_new > n else 2.0
        if n_new < n:
            out[..., m // 2] = out[..., m // 2].real
    return np.fft.irfft(out, n_new, axis=-1) * (n_new / n)


def welch(x: np.ndarray, sfreq: float, nperseg: int = 1024, noverlap: int | None = None, nfft: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided power spectral density): mean of Hann-windowed, mean-free segments."""
    x = np.atleast_2d(np.asarray(x, float))
    nperseg = min(nperseg, x.shape[-1])
    step = nperseg - (nperseg // 2 if noverlap is None else noverlap)
    nfft = nfft or nperseg
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    starts = range(0, x.shape[-1] - nperseg + 1, step)
    acc = 0.0
    for s in starts:
        seg = x[..., s : s + nperseg]
        acc = acc + np.abs(np.fft.rfft((seg - seg.mean(axis=-1, keepdims=True)) * win, nfft, axis=-1)) ** 2
    p = acc / (len(starts) * sfreq * (win * win).sum())
    p[..., 1 : (-1 if nfft % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(nfft, 1 / sfreq), p


BANDS = {"delta": (0.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}


def band_power(freqs: np.ndarray, psd: np.ndarray) -> np.ndarray:
    """Mean density in each of ``BANDS``, along the last axis."""
    return np.stack([psd[..., (freqs >= a) & (freqs < b)].mean(axis=-1) for a, b in BANDS.values()], axis=-1)


def dominant_frequency(x: np.ndarray, sfreq: float) -> np.ndarray:
    """Frequency of the largest Fourier amplitude without the mean."""
    spec = np.abs(np.fft.rfft(np.asarray(x, float), axis=-1))
    spec[..., 0] = 0
    return np.fft.rfftfreq(np.shape(x)[-1], 1 / sfreq)[spec.argmax(axis=-1)]


def mixing(x: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """(channels, components): how much of each component, which have unit variance, every channel holds."""
    x = np.asarray(x, float) - np.mean(x, axis=-1, keepdims=True)
    return x @ np.swapaxes(sources, -1, -2) / x.shape[-1]


def excess_kurtosis(x: np.ndarray) -> np.ndarray:
    """Excess kurtosis along the last axis, 0 for a constant row."""
    d = x - x.mean(axis=-1, keepdims=True)
    v = (d * d).mean(axis=-1)
    return np.where(v > 0, (d * d * d * d).mean(axis=-1) / np.where(v > 0, v * v, 1.0) - 3, 0.0)


#: tanh at the points of a grid, for ``_tanh``; beyond its end it is 1 in double precision.
_GRID, _GRID_END = 512, 20
#: Values that are handled at a time, so that they stay in the cache.
_BLOCK = 32768
_TANH = np.tanh(np.arange(-_GRID * _GRID_END, _GRID * _GRID_END + 1) / _GRID)


def _tanh(x: np.ndarray) -> np.ndarray:
    """tanh of a contiguous array that is given in steps of the grid, in its place, to the rounding of doubles, by its addition theorem from the next point of a grid;
    several times as fast as np.tanh without AVX-512."""
    flat = x.reshape(-1)
    room = min(len(flat), _BLOCK)
    step, at, over, place = np.empty(room), np.empty(room), np.empty(room), np.empty(room, np.intp)
    for i in range(0, len(flat), room or 1):
        d = flat[i : i + room]
        n, v, u, j = (b[: len(d)] for b in (step, at, over, place))
        np.rint(d, out=n)
        d -= n
        np.add(n, _GRID * _GRID_END, out=j, casting="unsafe")
        _TANH.take(j, mode="clip", out=v)
        np.multiply(d, d, out=u)
        u *= -1 / (3 * _GRID**3)
        u += 1 / _GRID
        u *= d
        np.multiply(v, u, out=d)
        d += 1
        v += u
        np.divide(v, d, out=d)
    return x


def _steps(least: float = 1e-4) -> list[tuple[float, float, float]]:
    """Weights of Halley steps x (a + b x'x) / (1 + c x'x) that bring singular values from ``least`` on to 1 in the fewest steps (Nakatsukasa, Bai, Gygi)."""
    out = []
    while 1 - least > 1e-15 and len(out) < 20:
        q = least * least
        d = (4 * (1 - q) / (q * q)) ** (1 / 3)
        a = float(np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - q) / (q * np.sqrt(1 + d))) / 2)
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        least = min(1.0, least * (a + b * q) / (1 + c * q))
        out.append((a, b, c))
    return out


_STEPS = _steps()


def _orthogonal(w: np.ndarray) -> np.ndarray:
    """The orthogonal polar factors of square matrices (matrices, k, k).

    Small ones go through weighted Halley steps side by side, larger ones and those of nearly lost rank through LAPACK. Each
    gets the same bits whatever stands beside it.
    """
    k = w.shape[1]
    if k > 7:
        u, _, v = np.linalg.svd(w)
        return u @ v
    out = np.empty_like(w)
    some = max(1, _BLOCK // 2 // (k * k))
    for i in range(0, len(w), some):
        out[i : i + some] = _halley(w[i : i + some])
    return out


def _halley(w: np.ndarray) -> np.ndarray:
    k = w.shape[1]
    if len(w) == 1:  # einsum sums in another order then
        return _halley(np.repeat(w, 2, axis=0))[:1]
    x = w / np.maximum(np.sqrt((w * w).sum(axis=(1, 2), keepdims=True)), 1e-300)
    x = np.ascontiguousarray(x.transpose(1, 2, 0))
    m, s = np.empty((k, 2 * k, x.shape[2])), np.empty_like(x)
    for a, b, c in _STEPS:
        np.einsum("ijb,kjb->ikb", x, x, out=s)
        np.multiply(s, c, out=m[:, :k])
        m[range(k), range(k)] += 1
        m[:, k:] = x
        for p in range(k):  # Gauss-Jordan of a positive definite matrix
            row = m[p, p + 1 :]
            row /= m[p, p]
            for rest in (m[:p], m[p + 1 :]):
                if len(rest):
                    rest[:, p + 1 :] -= rest[:, p, None] * row
        x *= b / c
        m[:, k:] *= a - b / c
        x += m[:, k:]
    poor = ~(np.abs(s - np.eye(k)[:, :, None]).max(axis=(0, 1)) < 1e-4)  # before the last step, which leaves the third power
    out = np.ascontiguousarray(x.transpose(2, 0, 1))
    if poor.any():
        u, _, v = np.linalg.svd(w[poor])
        out[poor] = u @ v
    return out


#: Damped rounds after which a step becomes shorter (1/2, 1/3, 1/4 ...), and rounds after which the signs of the contrast stay.
_SHORTER, _SETTLED = 200, 500


def _damped(turn: np.ndarray, w: np.ndarray, sign: np.ndarray | None, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the matrices after ``step`` of the rotation towards a stationary contrast, 1 - cos of the whole rotation, signs of the contrast).

    The rotation is that of a FastICA update to first order, and leaves the same contrast stationary. The signs, +1 for components flatter than the normal
    distribution, are those of ``turn`` unless given.
    """
    m = turn @ w.transpose(0, 2, 1)
    own = np.einsum("bii->bi", m)
    sign = np.where(own < 0, -1.0, 1.0) if sign is None else sign
    bend = np.abs(own)
    m = sign[:, :, None] * m
    way = (m - m.transpose(0, 2, 1)) / np.maximum(bend[:, :, None] + bend[:, None, :], 1e-3)
    return _orthogonal(w + step * (way @ w)), (way * way).sum(axis=2).max(axis=1) / 2, sign


def fast_ica_many(x: np.ndarray, n_components: int | None = None, seed: int = 0, whole: int = 20, tol: float = 1e-4) -> list[tuple[np.ndarray, np.ndarray]]:
    """``fast_ica`` of equally large recordings (recordings, channels, samples), each with rounds of its own until it converges.

    A pair (positions of recordings, their components as (recordings, components, samples)) for each number of components. The first ``whole``
    rounds are plain updates, which on short recordings may go round in circles for ever; from then on steps are damped. There
    is no last round: steps shorten, but their sum has no bound, and the signs stay in the end, so that the contrast becomes stationary.
    """
    x = np.asarray(x, float) - np.mean(x, axis=2, keepdims=True)
    dev = x.std(axis=2, keepdims=True)
    x = x / np.where(dev > 0, dev, 1.0)
    u, s, _ = np.linalg.svd(x @ x.transpose(0, 2, 1) / x.shape[2])
    live = ((s > s[:, :1] * 1e-12) & (s[:, :1] > 0)).sum(axis=1)
    count = np.minimum(n_components or live, live)
    out = []
    for k in np.unique(count).tolist():
        at = np.flatnonzero(count == k)
        if k == 0:
            out.append((at, np.zeros((len(at), 0, x.shape[2]))))
            continue
        white = (u[at, :, :k] / np.sqrt(s[at, None, :k])).transpose(0, 2, 1) @ x[at]
        found = np.repeat(_orthogonal(np.random.default_rng(seed).normal(size=(1, k, k))), len(at), axis=0)
        z, w, left, moving, sign = white, found.copy(), np.arange(len(at)), np.ones(len(at), bool), np.zeros((len(at), k))
        some = max(1, _BLOCK // white[0].size)
        for r in itertools.count():
            turn = np.empty_like(w)
            for i in range(0, len(z), some):
                y, v = z[i : i + some], w[i : i + some]
                g = _tanh((v * _GRID) @ y)
                slope = 1 - np.einsum("bit,bit->bi", g, g) / y.shape[2]
                turn[i : i + some] = g @ y.transpose(0, 2, 1) / y.shape[2] - slope[:, :, None] * v
            if r < whole:
                new = _orthogonal(turn)
                change = np.max(np.abs(np.abs(np.einsum("bij,bij->bi", new, w)) - 1), axis=1)
            else:
                new, change, sign = _damped(turn, w, None if r - whole < _SETTLED else sign, 1 / (2 + (r - whole) // _SHORTER))
            w = new
            done = moving & ~(change >= tol)
            if done.any():
                found[left[done]] = w[done]
                moving &= ~done
                if not moving.any():
                    break
                if moving.mean() < 31 / 32:  # those that are done go now and then, for the sake of copying
                    z, w, left, sign, moving = z[moving], w[moving], left[moving], sign[moving], moving[moving]
        out.append((at, found @ white))
    return out


def fast_ica(x: np.ndarray, n_components: int | None = None, seed: int = 0, whole: int = 20, tol: float = 1e-4) -> np.ndarray:
    """Independent components (components, samples) by symmetric FastICA with a tanh contrast.

    Channels are scaled to unit deviation first, so that one of a far larger scale does not make the others count as rank lost.
    """
    return fast_ica_many(np.asarray(x, float)[None], n_components, seed, whole, tol)[0][1][0]


