import numpy as np
import pytest

from wavegrid.functions import dsp


def gain(b, a, w):
    z = np.exp(-1j * np.pi * w)
    return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


@pytest.mark.parametrize(("low", "high", "at", "stop"), [(0.4, None, [0.4], 0.05), (None, 0.4, [0.4], 0.95), (0.2, 0.4, [0.2, 0.4], 0.9)])
def test_cut_offs_are_3_db_down(low, high, at, stop):
    b, a = dsp.butterworth(low, high)
    for w in at:
        assert gain(b, a, w) == pytest.approx(2**-0.5, abs=1e-5)
    assert gain(b, a, stop) < 1e-3


def test_filter_equals_the_recursion():
    b, a = dsp.butterworth(5000 / 24000, 10000 / 24000)
    x = np.random.default_rng(0).standard_normal((3, 400))
    want = np.zeros_like(x)
    for r in range(3):
        for t in range(400):
            past = sum(b[k] * x[r, t - k] for k in range(len(b)) if t >= k)
            want[r, t] = past - sum(a[k] * want[r, t - k] for k in range(1, len(a)) if t >= k)
    got = dsp.filtered(x, 48_000, 5000, 10000, 0, 15_000)
    assert got.dtype == np.float32 and np.abs(got - want).max() < 1e-5


@pytest.mark.parametrize(("fmin", "fmax"), [(0, 15_000), (5000, 16_000)])
def test_no_filter(fmin, fmax):
    x = np.random.default_rng(0).standard_normal((1, 50))
    assert np.array_equal(dsp.filtered(x, 48_000, fmin, fmax, 0, 15_000), x.astype(np.float32))


@pytest.mark.parametrize(("rate", "seconds"), [(44_100, 3), (22_050, 3), (96_000, 3), (11_025, 2)])
def test_resample_keeps_a_sine(rate, seconds):
    x = np.sin(2 * np.pi * 440 * np.arange(rate * seconds) / rate).astype(np.float32)
    y = dsp.resample(x, rate, 48_000)
    assert y.dtype == np.float32 and len(y) == 48_000 * seconds
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(len(y)) / 48_000)).max() < 1e-3


def test_resample_edges():
    x = np.ones(7, np.float32)
    assert dsp.resample(x, 48_000, 48_000) is x
    assert len(dsp.resample(np.ones(33_076, np.float32), 11_025, 48_000)) == 144_004
    with pytest.raises(ValueError):
        dsp.resample(np.ones((2, 2)), 1, 2)
