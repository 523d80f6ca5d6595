"""Signal kernels on NumPy arrays; rows of a matrix are chunks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ORDER = 5


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Fourier resampling of one-dimensional samples; dtype is kept."""
    if x.ndim != 1:
        raise ValueError("only one channel can be resampled")
    if rate == target:
        return x
    n, m = len(x), round(len(x) / rate * target)
    spectrum, keep = np.fft.rfft(x.astype(np.float64)), min(n, m)
    out = np.zeros(m // 2 + 1, dtype=complex)
    out[: keep // 2 + 1] = spectrum[: keep // 2 + 1]
    if keep % 2 == 0 and n != m:  # the bin at half the lower rate
        out[keep // 2] *= 2.0 if m < n else 0.5
    return (np.fft.irfft(out, m) * (m / n)).astype(x.dtype)


def butterworth(low: float | None, high: float | None, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth filter.

    ``low`` and ``high`` are cut-offs as parts of half the sample rate: with
    ``low`` alone it is a high-pass, with ``high`` alone a low-pass.
    """
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    zeros = np.zeros(0, complex)
    warp = lambda w: 4.0 * np.tan(np.pi * w / 2)
    if low is None:
        w = warp(high)
        gain, poles = w**order, poles * w
    elif high is None:
        w = warp(low)
        gain = np.real(1 / np.prod(-poles))
        poles, zeros = w / poles, np.zeros(order, complex)
    else:
        w1, w2 = warp(low), warp(high)
        width, centre = w2 - w1, np.sqrt(w1 * w2)
        gain, half = width**order, poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros = np.concatenate([half + root, half - root]), np.zeros(order, complex)
    degree = len(poles) - len(zeros)
    gain = gain * np.real(np.prod(4.0 - zeros) / np.prod(4.0 - poles))
    z = np.concatenate([(4.0 + zeros) / (4.0 - zeros), -np.ones(degree)])
    p = (4.0 + poles) / (4.0 - poles)
    return np.real(gain * np.poly(z)), np.real(np.poly(p))


@lru_cache(maxsize=8)
def _response(low: float | None, high: float | None, n: int) -> np.ndarray:
    """Spectrum of the filter's first ``n`` output samples for an impulse."""
    b, a = butterworth(low, high)
    order, h = len(a) - 1, np.zeros(n)
    state = [0.0] * (order + 1)
    b, a = b.tolist(), a.tolist()
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(n):
            x = 1.0 if t == 0 else 0.0
            y = b[0] * x + state[0]
            for k in range(order):
                state[k] = b[k + 1] * x + state[k + 1] - a[k + 1] * y
            h[t] = y
    if not np.isfinite(h).all():
        raise ValueError("the filter is not stable for this band")
    return np.fft.rfft(h, 2 * n)


def filtered(chunks: np.ndarray, rate: int, fmin: float, fmax: float, low: float, high: float) -> np.ndarray:
    """Each row through the filter that the band asks for, from a state of rest,
    as float32.

    One pass of the recursion over a chunk equals its convolution with the
    impulse response, which the Fourier transform does for all rows at once.
    """
    if fmin > low and fmax == high:
        cut = (fmin / (rate / 2), None)
    elif fmin == low and fmax < high:
        cut = (None, fmax / (rate / 2))
    elif fmin > low and fmax < high:
        cut = (fmin / (rate / 2), fmax / (rate / 2))
    else:
        return chunks.astype(np.float32)
    n = chunks.shape[1]
    spectrum = np.fft.rfft(chunks.astype(np.float64), 2 * n, axis=1) * _response(*cut, n)
    return np.fft.irfft(spectrum, 2 * n, axis=1)[:, :n].astype(np.float32)
