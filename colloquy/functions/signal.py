"""Signal transforms on numpy arrays, vectorised over frames. They run inside Arrow-batched Python stages.

Frames are rows of a matrix, so a whole segment is one call: correlations and spectra of all its frames come
from one FFT, and no loop runs over frames except for polynomial roots.
"""

from __future__ import annotations

import numpy as np

#: Below this, energy counts as none.
TINY = 1e-12
ORDER = 12
BANDS, CEPSTRA = 22, 13


def cut(signal: np.ndarray, start: float, end: float, rate: int) -> np.ndarray:
    """Samples of [start, end) seconds, both truncated to whole samples."""
    return signal[max(0, int(start * rate)) : max(0, min(len(signal), int(end * rate)))]


def frames(signal: np.ndarray, rate: int, frame_ms: float, hop_ms: float) -> np.ndarray:
    """Overlapping frames as rows; a signal shorter than a frame is one row, an empty one none."""
    size, hop = max(16, int(rate * frame_ms / 1000.0)), max(1, int(rate * hop_ms / 1000.0))
    signal = np.asarray(signal, np.float64)
    if len(signal) < size:
        return signal[None, :] if len(signal) else np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(signal, size)[::hop]


def rms(x: np.ndarray) -> np.ndarray:
    """Along the last axis; 0 where that is empty."""
    return np.sqrt(np.mean(x**2, axis=-1)) if x.shape[-1] else np.zeros(x.shape[:-1])


def zero_crossings(x: np.ndarray) -> float:
    """Share of neighbours of different sign; zero is a sign of its own."""
    return float(np.mean(np.diff(np.sign(x)) != 0)) if len(x) > 1 else 0.0


def crest(x: np.ndarray) -> float:
    level = float(rms(x)) if len(x) else 0.0
    return float(np.abs(x).max()) / level if level > 0 else 0.0


def energy_levels(signal: np.ndarray, rate: int, frame_s: float = 0.025, hop_s: float = 0.010) -> np.ndarray:
    """Decibels of each whole frame, in the precision of the signal."""
    size, hop = int(frame_s * rate), int(hop_s * rate)
    if len(signal) < size:
        return np.zeros(0)
    rows = np.lib.stride_tricks.sliding_window_view(signal, size)[::hop]
    return 20 * np.log10(np.sqrt(np.mean(rows**2, axis=1) + 1e-10) + 1e-10)


def spectrum_shape(x: np.ndarray, rate: int, split_hz: float = 1000.0) -> tuple[float, float, float]:
    """(centroid in Hz, flatness, energy from split_hz up over that below); zeros under 16 samples or without energy."""
    if len(x) < 16:
        return 0.0, 0.0, 0.0
    power = np.abs(np.fft.rfft(x)) ** 2
    hz, total = np.fft.rfftfreq(len(x), 1.0 / rate), float(power.sum())
    if total <= 0:
        return 0.0, 0.0, 0.0
    low = float(power[hz < split_hz].sum())
    flat = float(np.exp(np.log(power + TINY).mean())) / float(power.mean())
    return float(hz @ power) / total, flat, float(power[hz >= split_hz].sum()) / low if low > 0 else 0.0


def pink_slope(x: np.ndarray, rate: int) -> float:
    """Slope of log power over log frequency, 500 to 3000 Hz; 0 under 64 samples or 4 bins."""
    if len(x) < 64:
        return 0.0
    hz = np.fft.rfftfreq(len(x), 1.0 / rate)
    inside = (hz >= 500.0) & (hz <= 3000.0)
    if inside.sum() < 4:
        return 0.0
    u, v = np.log(hz[inside]), np.log(np.abs(np.fft.rfft(x))[inside] ** 2 + TINY)
    u = u - u.mean()
    return float(u @ v / (u @ u))


def autocorrelations(rows: np.ndarray, lags: int) -> np.ndarray:
    """Of each row less its mean, for lags 0 to lags."""
    centred = rows - rows.mean(axis=1, keepdims=True)
    n = 1 << int(2 * rows.shape[1] - 1).bit_length()
    return np.fft.irfft(np.abs(np.fft.rfft(centred, n, axis=1)) ** 2, n, axis=1)[:, : lags + 1]


def pitches(rows: np.ndarray, rate: int, low_hz: float = 70.0, high_hz: float = 400.0) -> tuple[np.ndarray, np.ndarray]:
    """(pitch in Hz, harmonic-to-noise ratio in dB) of each row: the lag of greatest autocorrelation; no voicing test.

    Zeros where there are too few samples or lags, or no energy; the ratio also where the peak is not
    between 1e-6 and 0.999 of the energy, and under 64 samples.
    """
    size = rows.shape[1]
    first, last = max(1, int(rate / high_hz)), min(size - 1, int(rate / low_hz))
    nothing = np.zeros(len(rows))
    if size < 16 or last <= first or not len(rows):
        return nothing, nothing
    corr = autocorrelations(rows, size - 1)
    lag = corr[:, first : last + 1].argmax(axis=1) + first
    sound = corr[:, 0] > TINY
    f0 = np.where(sound, rate / lag, 0.0)
    peak = np.where(sound, corr[np.arange(len(rows)), np.rint(rate / np.where(sound, f0, 1.0)).astype(int).clip(0, size - 1)] / np.where(sound, corr[:, 0], 1.0), 0.0)
    clear = sound & (peak > 1e-6) & (peak < 0.999) & (size >= 64)
    safe = np.where(clear, peak, 0.5)
    return f0, np.where(clear, 10 * np.log10(safe / (1 - safe)), 0.0)


def predictors(corr: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Linear prediction by the Durbin recursion, all rows at once; column 0 is 1, rows without energy are otherwise 0."""
    out = np.zeros((len(corr), order + 1))
    out[:, 0] = 1.0
    left = corr[:, 0].copy()
    going = left > TINY
    for i in range(1, order + 1):
        going = going & (left > TINY)
        inner = (out[:, 1:i] * corr[:, i - 1 : 0 : -1]).sum(axis=1)
        k = np.where(going, (corr[:, i] - inner) / np.where(going, left, 1.0), 0.0)
        out[:, 1:i] = out[:, 1:i] - k[:, None] * out[:, i - 1 : 0 : -1] if i > 1 else out[:, 1:i]
        out[:, i] = k
        left = np.where(going, left * (1 - k * k), left)
    return out


def formants(rows: np.ndarray, rate: int, corrected: bool = False) -> np.ndarray:
    """The three lowest resonances of each row in Hz, 0 where there are fewer.

    By default the roots are those of 1 + sum(a z^-i), as published figures were made; corrected takes the
    prediction error filter 1 - sum(a z^-i) instead. Conjugate roots both count.
    """
    out = np.zeros((len(rows), 3))
    size = rows.shape[1]
    if size < ORDER + 2 or not len(rows):
        return out
    sharp = np.concatenate([rows[:, :1], rows[:, 1:] - 0.97 * rows[:, :-1]], axis=1) * np.hamming(size)
    polynomials = predictors(autocorrelations(sharp, ORDER))
    if corrected:
        polynomials[:, 1:] *= -1
    # roots of all polynomials at once, as eigenvalues of their companion matrices
    companions = np.zeros((len(rows), ORDER, ORDER))
    companions[:, np.arange(1, ORDER), np.arange(ORDER - 1)] = 1.0
    companions[:, 0, :] = -polynomials[:, 1:]
    roots = np.linalg.eigvals(companions)
    hz = np.abs(np.angle(roots)) * rate / (2 * np.pi)
    hz = np.sort(np.where((np.abs(roots.imag) >= 1e-3) & (hz >= 90.0) & (hz <= rate / 2 - 50), hz, np.inf), axis=1)[:, :3]
    out[:] = np.where(np.isfinite(hz), hz, 0.0)
    return out


def cepstra(rows: np.ndarray, rate: int) -> np.ndarray:
    """Linear-frequency cepstral coefficients: the real FFT of the log energies of equal bands, Nyquist left out.

    An FFT of 22 numbers has 12 coefficients, so there are no more, though CEPSTRA are asked for.
    """
    if rows.shape[1] < 32:
        energies = np.zeros((len(rows), BANDS))
    else:
        hz = np.fft.rfftfreq(rows.shape[1], 1.0 / rate)
        band = np.searchsorted(np.linspace(0.0, rate / 2, BANDS + 1), hz, "right") - 1
        power = np.abs(np.fft.rfft(rows, axis=1)) ** 2
        energies = np.stack([power[:, band == b].sum(axis=1) for b in range(BANDS)], axis=1)
    return np.fft.rfft(np.log(energies + TINY), axis=1).real[:, :CEPSTRA]


def deltas(track: np.ndarray) -> np.ndarray:
    """Half the difference of a row's neighbours, the ends standing in for what is beyond them."""
    if len(track) < 2:
        return np.zeros_like(track)
    held = np.concatenate([track[:1], track, track[-1:]])
    return (held[2:] - held[:-2]) / 2.0


def wobble(values: np.ndarray) -> float:
    """Mean step between neighbouring positive values over their mean: jitter of pitch, shimmer of loudness."""
    values = values[values > 0]
    return float(np.abs(np.diff(values)).mean() / values.mean()) if len(values) > 1 else 0.0


def lagged_peak(later: np.ndarray, earlier: np.ndarray, rate: int, low_ms: float = 5.0, high_ms: float = 200.0, block: int = 1 << 15) -> float:
    """Greatest absolute correlation of later with earlier shifted by a lag in the range.

    Block by block of earlier: a block meets only the samples of later that some lag brings to it, so transforms have the size of a
    block and the longest lag, however long the signals are. Cross spectra of all blocks are added up before one inverse transform.
    """
    if min(len(later), len(earlier)) < 64:
        return 0.0
    low, high = max(1, int(rate * low_ms / 1000.0)), min(len(later) // 4, int(rate * high_ms / 1000.0))
    means = [float(np.mean(x, dtype=np.float64)) for x in (later, earlier)]
    block = min(block, 1 << (len(earlier) - 1).bit_length())
    n, squares, cross = 1 << int(block + max(high, 1)).bit_length(), np.zeros(2), 0
    for at in range(0, max(len(earlier), len(later)), block):
        a, b = np.asarray(later[at : at + block + high], np.float64) - means[0], np.asarray(earlier[at : at + block], np.float64) - means[1]
        squares += (a[:block] @ a[:block], b @ b)
        if high > low and len(b):
            cross = cross + np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n))
    scale = float(np.sqrt(squares[0]) * np.sqrt(squares[1]))
    if high <= low or scale <= TINY:
        return 0.0
    return float(np.abs(np.fft.irfft(cross, n)[low : high + 1]).max() / scale)


def envelope_correlation(a: np.ndarray, b: np.ndarray, rate: int) -> float:
    """Correlation of the loudness of two signals over their common frames; 0 under 3 frames or where one is even."""
    x, y = (rms(frames(s, rate, 20.0, 10.0)) for s in (a, b))
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    return float(np.corrcoef(x, y)[0, 1]) if n >= 3 and x.std() > TINY and y.std() > TINY else 0.0


def yield_decay_db(signal: np.ndarray, at: float, rate: int, window_ms: float = 150.0) -> float:
    """Level of the last quarter of the window after at over its first quarter; 0 under 8 samples or from silence."""
    start = int(at * rate)
    part = np.asarray(signal[start : min(len(signal), start + int(rate * window_ms / 1000.0))], np.float64)
    if len(part) < 8:
        return 0.0
    quarter = max(1, len(part) // 4)
    early, late = float(rms(part[:quarter])), float(rms(part[-quarter:]))
    return 20.0 * float(np.log10(max(late, TINY) / early)) if early > TINY else 0.0


def is_breath(signal: np.ndarray, rate: int, start: float, end: float) -> bool:
    """A quiet, noisy, falling frame of 40 to 450 ms in a gap of at least 40 ms.

    Frames are 30 ms, so none qualifies: published features of it are all 0, and stay so here.
    """
    gap = cut(signal, start, end, rate)
    if len(gap) < int(0.04 * rate):
        return False
    rows = frames(gap, rate, 30.0, 15.0)
    if not 0.04 <= rows.shape[1] / rate <= 0.45:
        return False
    return any(0.003 <= float(rms(x)) <= 0.06 and zero_crossings(x) >= 0.08 and pink_slope(x, rate) < -0.5 for x in rows)
