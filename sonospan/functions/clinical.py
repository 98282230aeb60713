"""Voice measures of one recording: NumPy in, a number or a record out.

A measure that the signal cannot carry (too short, no voice) is NaN; callers
keep the reason in a status column instead of failing the whole query.
"""

from __future__ import annotations

import numpy as np

from sonospan.functions import dsp
from sonospan.functions.columns import hann

LEAST_PULSES = 7


def voiced_median(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 600.0) -> float:
    """Upper median of f0 over frames with voicing of 0.45 or more."""
    p = dsp.pitch_windowed(x, rate, lo, hi)
    f = np.sort(p["hz"][(p["voicing"] >= 0.45) & (p["hz"] > 0)])
    return float(f[len(f) // 2]) if len(f) else float("nan")


def next_pulse(x: np.ndarray, at: int, period: int, least: float) -> tuple[int, int]:
    """Where the search goes on after the period from ``at``, and its pulse: the highest sample, -1 where that is too low."""
    best = at + int(np.argmax(x[at : at + period]))
    return (best + max(1, int(0.7 * period)), best) if x[best] >= least else (at + period, -1)


def pulse_at(x: np.ndarray, best: int) -> tuple[float, float]:
    """Place and height of a pulse between samples."""
    lo, hi = max(best - 1, 0), min(best + 1, len(x) - 1)
    d, top = dsp.parabolic(x[lo], x[best], x[hi]) if lo < best < hi else (0.0, x[best])
    return best + float(d), float(top)


def pulses(x: np.ndarray, rate: int, f0: float) -> tuple[np.ndarray, np.ndarray]:
    """Times and heights of glottal pulses: the highest sample of each period, then on by 0.7 periods."""
    period = int(rate / f0)
    least, at = 0.2 * np.abs(x).max(initial=0), 0
    found = []
    while at + period <= len(x):
        at, best = next_pulse(x, at, period, least)
        if best >= 0:
            found.append(pulse_at(x, best))
    return np.array([t for t, _ in found]) / rate, np.array([h for _, h in found])


def quotient(v: np.ndarray, m: int) -> float:
    """Mean distance of values from the mean of the m around them, over full windows, divided by the mean."""
    if len(v) < m or v.mean() == 0:
        return float("nan")
    h = m // 2
    return float(np.abs(v[h : len(v) - h] - np.convolve(v, np.ones(m) / m, "valid")).mean() / v.mean())


def perturbation(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 600.0) -> dict[str, float]:
    names = ("jitter_local", "jitter_rap", "jitter_ppq5", "shimmer_local", "shimmer_local_db", "shimmer_apq3", "shimmer_apq5", "period_sd")
    f0 = voiced_median(x, rate, lo, hi)
    if not f0 > 0:
        return dict.fromkeys(names, float("nan")) | {"f0": f0, "n_pulses": 0}
    t, a = pulses(x, rate, f0)
    if len(t) < LEAST_PULSES:
        return dict.fromkeys(names, float("nan")) | {"f0": f0, "n_pulses": len(t)}
    p = np.diff(t)
    local = lambda v: float(np.abs(np.diff(v)).mean() / v.mean())
    both = (a[:-1] > 0) & (a[1:] > 0)
    db = float(np.abs(20 * np.log10(a[1:][both] / a[:-1][both])).sum() / (len(a) - 1))
    return {"jitter_local": local(p), "jitter_rap": quotient(p, 3), "jitter_ppq5": quotient(p, 5), "shimmer_local": local(a), "shimmer_local_db": db, "shimmer_apq3": quotient(a, 3), "shimmer_apq5": quotient(a, 5), "period_sd": float(p.std(ddof=1)), "f0": f0, "n_pulses": len(t)}


def hnr_frames(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 600.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean power and harmonics-to-noise ratio in dB of each frame: its best normalised correlation with itself one period on."""
    most, least = int(rate / lo), max(1, int(rate / hi))
    size, hop = 2 * most, max(1, int(0.01 * rate))
    f = dsp.framed(x, size + most, hop)
    if not len(f):
        return np.zeros(0), np.zeros(0)
    head = f[:, :size]
    n = 1 << (2 * size + most).bit_length()
    cross = np.fft.irfft(np.conj(np.fft.rfft(head, n, axis=1)) * np.fft.rfft(f, n, axis=1), n, axis=1)[:, : most + 1]
    square = np.concatenate([np.zeros((len(f), 1)), np.cumsum(f * f, axis=1)], axis=1)
    lags = np.arange(most + 1)
    energy = np.sqrt(np.maximum(square[:, size : size + 1] * (square[:, lags + size] - square[:, lags]), 1e-30))
    r = np.clip((cross / energy)[:, least:].max(axis=1), 1e-6, 1 - 1e-6)
    return (f * f).mean(axis=1), 10 * np.log10(r / (1 - r))


def hnr(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 600.0) -> float:
    """Harmonics-to-noise ratio in dB, of frames with a hundredth of the greatest power or more."""
    power, db = hnr_frames(x, rate, lo, hi)
    return float(db[power >= 0.01 * power.max()].mean()) if len(power) else float("nan")


def robust_lines(y: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and intercepts of lines through y[:, lo:hi]: five rounds of bisquare weights."""
    x, v = np.arange(lo, hi, dtype=float), y[:, lo:hi]
    w, slope, level = np.ones(v.shape), np.zeros(len(v)), np.zeros(len(v))
    for _ in range(5):
        total = w.sum(axis=1)
        some = np.where(total > 0, total, 1)
        mx, my = (w @ x) / some, (w * v).sum(axis=1) / some
        dx = x - mx[:, None]
        spread = (w * dx * dx).sum(axis=1)
        a = (w * dx * (v - my[:, None])).sum(axis=1) / np.where(spread > 0, spread, 1)
        slope, level = np.where(total > 0, a, slope), np.where(total > 0, my - a * mx, level)
        e = v - (slope[:, None] * x + level[:, None])
        c = 4.685 * 1.4826 * np.median(np.abs(e), axis=1, keepdims=True)
        w = np.where(c > 0, np.where(np.abs(e) < c, (1 - (e / np.where(c > 0, c, 1)) ** 2) ** 2, 0.0), 1.0)
    return slope, level


def cepstral_peaks(x: np.ndarray, rate: int, lo: float = 60.0, hi: float = 330.0) -> np.ndarray:
    """Smoothed cepstral peak prominence of each frame in dB."""
    n = 4096
    width = max(1, int(round(0.00015 * rate)) | 1)
    fit = int(0.001 * rate), min(int(0.05 * rate), n // 2)
    search = int(rate / hi), min(int(rate / lo), n // 2 - 1)
    frames, found = dsp.framed(x, n, max(1, int(0.005 * rate))), []
    for at in range(0, len(frames), 200):
        db = 10 * np.log10(np.abs(np.fft.rfft(frames[at : at + 200] * np.array(hann(n)), axis=1)) ** 2 + 1e-12)
        c = 10 * np.log10(np.abs(np.fft.irfft(db, n, axis=1)[:, : n // 2]) ** 2 + 1e-12)
        padded, ones = (np.pad(m, ((0, 0), (width // 2, width // 2))) for m in (c, np.ones((1, n // 2))))
        c, count = (sum(m[:, k : k + n // 2] for k in range(width)) for m in (padded, ones))
        c = c / count
        slope, level = robust_lines(c, *fit)
        k = search[0] + c[:, search[0] : search[1] + 1].argmax(axis=1)
        found.append(c[np.arange(len(c)), k] - (slope * k + level))
    return np.concatenate(found) if found else np.zeros(0)


def cpps(x: np.ndarray, rate: int, lo: float = 60.0, hi: float = 330.0) -> float:
    """Smoothed cepstral peak prominence in dB."""
    found = cepstral_peaks(x, rate, lo, hi)
    return float(found.mean()) if len(found) else float("nan")


def peak_near(power: np.ndarray, width: float, hz: float) -> float:
    a, b = int(0.85 * hz / width), int(np.ceil(1.15 * hz / width)) + 1
    return float(power[a:b].max(initial=0.0))


def h1_h2_frames(x: np.ndarray, rate: int, f0: float) -> list[float]:
    n = 4096
    spectra = np.abs(np.fft.rfft(dsp.framed(x, n, n // 2) * np.array(hann(n)), axis=1))
    return [20 * np.log10(a / b) for a, b in ((peak_near(s, rate / n, f0), peak_near(s, rate / n, 2 * f0)) for s in spectra) if a > 0 and b > 0]


def h1_h2(x: np.ndarray, rate: int) -> float:
    """Level of the first harmonic over the second, dB."""
    f0 = voiced_median(x, rate)
    values = h1_h2_frames(x, rate, f0) if f0 > 0 else []
    return float(np.mean(values)) if values else float("nan")


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / scale) if scale > 0 else 0.0


def gne(x: np.ndarray, rate: int) -> float:
    """Glottal-to-noise excitation: the best correlation between envelopes of bands half a bandwidth or more apart."""
    y = dsp.resample(x, rate, 10_000)
    if len(y) < 300:
        return float("nan")
    a = dsp.lpc_autocorrelation((y * np.array(hann(len(y))))[None], 13)[0]
    residual = np.convolve(y, a)[: len(y)]
    spectrum, hz = np.fft.fft(residual), np.fft.fftfreq(len(residual), 1 / 10_000)
    envelopes = []
    for centre in np.arange(500, 4501, 300):
        inside = np.abs(hz - centre) <= 500
        shape = np.where(inside, 0.5 * (1 + np.cos(np.pi * (hz - centre) / 500)), 0)
        envelopes.append((centre, np.abs(np.fft.ifft(2 * spectrum * shape))))
    return max(correlation(p, q) for i, (f, p) in enumerate(envelopes) for g, q in envelopes[i + 1 :] if g - f >= 500)


def hfno(x: np.ndarray, rate: int) -> float:
    """Level of 0-6 kHz over 6-10 kHz, dB; needs a rate of 20 kHz."""
    if rate < 20_000:
        return float("nan")
    centres, power = dsp.ltas(x, rate)
    return -dsp.slope_db(centres, power, (0, 6000), (6000, 10_000))


def hnr_d(x: np.ndarray, rate: int) -> float:
    """Power at harmonics over power between them, 500-1500 Hz, dB."""
    f0 = voiced_median(x, rate)
    if not f0 > 0 or len(x) < 4096:
        return float("nan")
    return harmonics_over_valleys(*dsp.welch(x, rate, 4096), f0)


def harmonics_over_valleys(power: np.ndarray, width: float, f0: float) -> float:
    ks = [k for k in range(1, int(1500 / f0) + 1) if k * f0 >= 500]
    peaks = [peak_near(power, width, k * f0) for k in ks]
    valleys = [float(power[int((k + 0.5) * f0 / width)]) for k in ks]
    return float(10 * np.log10(np.mean(peaks) / max(np.mean(valleys), 1e-30))) if ks else float("nan")


def measures(x: np.ndarray, rate: int) -> dict[str, list]:
    """All measures as one-row columns."""
    centres, power = dsp.ltas(x, rate)
    out = perturbation(x, rate) | {"hnr_db": hnr(x, rate), "cpps_db": cpps(x, rate), "h1_h2_db": h1_h2(x, rate), "gne": gne(x, rate), "hfno_db": hfno(x, rate), "hnr_d_db": hnr_d(x, rate)}
    out |= {"ltas_slope_db": dsp.slope_db(centres, power, (0, 1000), (1000, 10_000)), "ltas_tilt": dsp.tilt_db_per_khz(centres, power, 0, 10_000)}
    return {k: [float(v)] for k, v in out.items()}
