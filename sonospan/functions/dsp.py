"""NumPy kernels: one recording's samples in, frames out.  Vectorised over frames."""

from __future__ import annotations

import numpy as np

from sonospan.functions.columns import hann
from sonospan.functions.swipe import pitch_swipe


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames of ``size`` every ``hop``, without padding."""
    if len(x) < size or size <= 0:
        return np.zeros((0, max(size, 0)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def sizes(rate: int, frame_seconds: float, hop_seconds: float) -> tuple[int, int]:
    return int(round(frame_seconds * rate)), max(1, int(round(hop_seconds * rate)))


def intensity(x: np.ndarray, rate: int, frame_seconds: float = 0.025, hop_seconds: float = 0.010) -> dict:
    size, hop = sizes(rate, frame_seconds, hop_seconds)
    f = framed(x, size, hop)
    r = np.sqrt((f * f).mean(axis=1)) if len(f) else np.zeros(0)
    with np.errstate(divide="ignore"):
        db = np.where(r > 0, 20 * np.log10(r), -200.0)
    return {"t": np.arange(len(r)) * hop / rate + size / (2 * rate), "rms": r, "db": np.maximum(db, -200.0)}


def stft(x: np.ndarray, window: np.ndarray, hop: int) -> np.ndarray:
    """Spectra, a row for each frame."""
    return np.fft.rfft(framed(x, len(window), hop) * window, axis=1)


def power_spectrogram(spectra: np.ndarray) -> np.ndarray:
    """Power with frequencies as rows."""
    return (spectra.real**2 + spectra.imag**2).T


def welch(x: np.ndarray, rate: int, n: int) -> tuple[np.ndarray, float]:
    """Mean periodogram of half-overlapping Hann frames and the bin width."""
    f = framed(x if len(x) >= n else np.pad(x, (0, n - len(x))), n, n // 2)
    return (np.abs(np.fft.rfft(f * np.array(hann(n)), axis=1)) ** 2).mean(axis=0), rate / n


def ltas(x: np.ndarray, rate: int, bin_hz: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """Band centres in Hz and their mean powers."""
    power, width = welch(x, rate, 2048)
    return banded(power, width, bin_hz)


def banded(power: np.ndarray, width: float, bin_hz: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """Band centres in Hz and the mean powers of their bins."""
    band = (np.arange(len(power)) * width / bin_hz).astype(int)
    n = np.bincount(band)
    mean = np.bincount(band, power) / np.maximum(n, 1)
    return (np.arange(len(n)) + 0.5)[n > 0] * bin_hz, mean[n > 0]


def band_power(centres: np.ndarray, power: np.ndarray, lo: float, hi: float) -> float:
    use = (centres >= lo) & (centres < hi)
    return float(power[use].mean()) if use.any() else 0.0


def slope_db(centres: np.ndarray, power: np.ndarray, low: tuple[float, float], high: tuple[float, float]) -> float:
    a, b = band_power(centres, power, *low), band_power(centres, power, *high)
    return float(10 * np.log10(max(b, 1e-30) / max(a, 1e-30)))


def tilt_db_per_khz(centres: np.ndarray, power: np.ndarray, lo: float, hi: float) -> float:
    use = (centres >= lo) & (centres <= hi) & (power > 0)
    return float(np.polyfit(centres[use] / 1000, 10 * np.log10(power[use]), 1)[0]) if use.sum() > 1 else 0.0


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Band-limited resampling of the whole signal."""
    n = int(round(len(x) * to / rate))
    if n == len(x) or not len(x):
        return x.copy()
    spectrum = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, dtype=complex)
    k = min(len(spectrum), len(out))
    out[:k] = spectrum[:k]
    return np.fft.irfft(out, n) * (n / len(x))


def lpc_autocorrelation(frames: np.ndarray, order: int) -> np.ndarray:
    """Prediction polynomials by Levinson and Durbin, for all frames at once."""
    n = frames.shape[1]
    return levinson(np.stack([(frames[:, : n - k] * frames[:, k:]).sum(axis=1) for k in range(order + 1)], axis=1))


def levinson(r: np.ndarray) -> np.ndarray:
    """The same from autocorrelations, a row for each frame."""
    order = r.shape[1] - 1
    a, e = np.zeros((len(r), order + 1)), r[:, 0].copy()
    a[:, 0] = 1
    for i in range(1, order + 1):
        acc = r[:, i] + (a[:, 1:i] * r[:, i - 1 : 0 : -1]).sum(axis=1)
        k = np.where(e > 0, -acc / np.where(e > 0, e, 1), 0.0)
        before = a[:, 1:i].copy()
        a[:, 1:i] = before + k[:, None] * before[:, ::-1]
        a[:, i] = k
        e *= 1 - k * k
    return a


def lpc_burg(frames: np.ndarray, order: int) -> np.ndarray:
    """Prediction polynomials by Burg's method, for all frames at once."""
    f, b = frames[:, 1:].copy(), frames[:, :-1].copy()
    a = np.zeros((len(frames), order + 1))
    a[:, 0] = 1
    for i in range(1, order + 1):
        energy = (f * f).sum(axis=1) + (b * b).sum(axis=1)
        k = np.where(energy > 0, -2 * (f * b).sum(axis=1) / np.where(energy > 0, energy, 1), 0.0)
        before = a[:, : i + 1].copy()
        a[:, : i + 1] = before + k[:, None] * before[:, ::-1]
        f, b = (f + k[:, None] * b)[:, 1:], (b + k[:, None] * f)[:, :-1]
    return a


def roots(polynomials: np.ndarray) -> np.ndarray:
    """Roots of monic polynomials as eigenvalues of their companion matrices, all rows in one call."""
    n = polynomials.shape[1] - 1
    companion = np.zeros((len(polynomials), n, n))
    companion[:, 0, :] = -polynomials[:, 1:] / polynomials[:, :1]
    companion[:, np.arange(1, n), np.arange(n - 1)] = 1
    return np.linalg.eigvals(companion)


def formants(x: np.ndarray, rate: int, n_formants: int = 5, frame_seconds: float = 0.025, hop_seconds: float = 0.010, pre: float = 0.97, method: str = "burg") -> dict:
    """t, frequencies and bandwidths of each frame, ascending; lists may be empty."""
    size, hop = sizes(rate, frame_seconds, hop_seconds)
    y = np.concatenate([x[:1], x[1:] - pre * x[:-1]]) if len(x) else x
    f = framed(y, size, hop)
    return {"t": np.arange(len(f)) * hop / rate + size / (2 * rate), **emphasised_formants(f, rate, n_formants, method)}


def window_formants(windows: np.ndarray, rate: int, n_formants: int = 5, pre: float = 0.97, method: str = "burg") -> dict:
    """frequencies and bandwidths of windows, a row each, that know nothing of each other."""
    return emphasised_formants(np.concatenate([windows[:, :1], windows[:, 1:] - pre * windows[:, :-1]], axis=1), rate, n_formants, method)


def emphasised_formants(frames: np.ndarray, rate: int, n_formants: int, method: str) -> dict:
    if not len(frames):
        return {"frequencies": [], "bandwidths": []}
    f = frames * np.array(hann(frames.shape[1]))
    live = (f * f).sum(axis=1) > 0
    a = (lpc_burg if method == "burg" else lpc_autocorrelation)(f, 2 * n_formants + 2)
    z = roots(a)
    size_z, angle = np.abs(z), np.angle(z)
    with np.errstate(divide="ignore"):
        hz, bw = angle * rate / (2 * np.pi), -np.log(size_z) * rate / np.pi
    ok = (size_z < 1 - 1e-9) & (angle > 0) & (hz >= 50) & (hz <= rate / 2 - 50) & (bw <= 1000) & live[:, None]
    out_f, out_b = [], []
    for row in range(len(f)):
        k = np.flatnonzero(ok[row])
        k = k[np.argsort(hz[row, k])][:n_formants]
        out_f.append(hz[row, k].tolist())
        out_b.append(bw[row, k].tolist())
    return {"frequencies": out_f, "bandwidths": out_b}


def mel_slaney(hz):
    hz = np.asarray(hz, dtype=float)
    return np.where(hz >= 1000, 15 + np.log(np.maximum(hz, 1e-9) / 1000) / (np.log(6.4) / 27), hz * 3 / 200)


def hz_slaney(mel):
    mel = np.asarray(mel, dtype=float)
    return np.where(mel >= 15, 1000 * np.exp((mel - 15) * np.log(6.4) / 27), mel * 200 / 3)


def mel_htk(hz):
    return 2595 / np.log(10) * np.log1p(np.asarray(hz, dtype=float) / 700)


def hz_htk(mel):
    return 700 * np.expm1(np.asarray(mel, dtype=float) * np.log(10) / 2595)


def triangles(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit-peak triangles between successive points, evaluated at ``at``."""
    lo, mid, hi = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.maximum(0, np.minimum((at - lo) / (mid - lo), (hi - at) / (hi - mid)))


def dct(n_out: int, n: int, ortho: bool = True) -> np.ndarray:
    m = np.cos(np.pi * np.arange(n_out)[:, None] * (np.arange(n) + 0.5) / n)
    if ortho:
        m *= np.sqrt(2 / n)
        m[0] /= np.sqrt(2)
    return m


def mel_power(x: np.ndarray, rate: int, n_fft: int, hop: int, n_mels: int, f_min: float, f_max: float, reflect: bool = False) -> np.ndarray:
    """Slaney mel powers of centred periodic-Hann frames, a row for each frame."""
    return mel_of_frames(np.pad(x, n_fft // 2, mode="reflect" if reflect and len(x) > n_fft // 2 else "constant"), rate, n_fft, hop, n_mels, f_min, f_max)


def mel_of_frames(y: np.ndarray, rate: int, n_fft: int, hop: int, n_mels: int, f_min: float, f_max: float) -> np.ndarray:
    """The same of frames that begin with ``y``, which is not padded."""
    power = np.abs(stft(y, np.array(hann(n_fft, periodic=True)), hop)) ** 2
    points = hz_slaney(np.linspace(mel_slaney(f_min), mel_slaney(f_max), n_mels + 2))
    bank = triangles(points, np.arange(n_fft // 2 + 1) * rate / n_fft) * (2 / (points[2:] - points[:-2]))[:, None]
    return power @ bank.T


def mel_db(x: np.ndarray, rate: int, frame_seconds: float = 0.025, hop_seconds: float = 0.010, n_mels: int = 40, f_min: float = 0.0, f_max: float | None = None) -> np.ndarray:
    """Mel levels in dB, a row for each frame."""
    return decibels(mel_power(x, rate, *sizes(rate, frame_seconds, hop_seconds), n_mels, f_min, f_max or rate / 2))


def decibels(power: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum(power, 1e-10))


def cepstra(db: np.ndarray, loudest: float | np.ndarray, n_mfcc: int = 13) -> np.ndarray:
    """Cepstra of mel levels, which are cut 80 dB below the greatest level of their recording."""
    return np.maximum(db, np.reshape(loudest, (-1, 1)) - 80) @ dct(n_mfcc, db.shape[1]).T


def mfcc(x: np.ndarray, rate: int, frame_seconds: float = 0.025, hop_seconds: float = 0.010, n_mels: int = 40, n_mfcc: int = 13, f_min: float = 0.0, f_max: float | None = None, method: str = "librosa") -> np.ndarray:
    """Cepstra, a row for each frame."""
    size, hop = sizes(rate, frame_seconds, hop_seconds)
    f_max = f_max or rate / 2
    if method == "librosa":
        db = mel_db(x, rate, frame_seconds, hop_seconds, n_mels, f_min, f_max)
        return cepstra(db, db.max(), n_mfcc) if len(db) else np.zeros((0, n_mfcc))
    if method == "kaldi":
        f = framed(x, size, hop)
        f = f - f.mean(axis=1, keepdims=True)
        f = np.concatenate([f[:, :1] * (1 - 0.97), f[:, 1:] - 0.97 * f[:, :-1]], axis=1) * np.array(hann(size)) ** 0.85
        n = 1 << (size - 1).bit_length()
        power = np.abs(np.fft.rfft(f, n, axis=1)[:, : n // 2]) ** 2
        bank = triangles(np.linspace(mel_htk(f_min), mel_htk(f_max), n_mels + 2), mel_htk(np.arange(n // 2) * rate / n))
        c = np.log(np.maximum(power @ bank.T, np.finfo(np.float32).eps)) @ dct(n_mfcc, n_mels).T
        return c * (1 + 11 * np.sin(np.pi * np.arange(n_mfcc) / 22))
    if method == "praat":
        n = 2 * size
        f = framed(x, n, hop)
        phase = (np.arange(n) + 0.5) / n - 0.5
        edge = np.exp(-12.0)
        window = (np.exp(-48 * phase**2) - edge) / (1 - edge)
        n_fft = 1 << (n - 1).bit_length()
        power = np.abs(np.fft.rfft(f * window, n_fft, axis=1)) ** 2 * 2 / (n_fft * n) / (window**2).mean()
        top = float(mel_htk(f_max))
        count = max(1, int(round((top - 100) / 100)))
        points = hz_htk(np.minimum(np.arange(count + 2) * 100.0, top))  # centres every 100 mel
        bank = triangles(points, np.arange(n_fft // 2 + 1) * rate / n_fft)
        return 10 * np.log10(np.maximum(power @ bank.T, np.finfo(float).tiny) / 4e-10) @ dct(n_mfcc, count, ortho=False).T
    raise ValueError(f"unknown method {method!r}")


def log_mel(x: np.ndarray, rate: int, n_fft: int = 400, hop: int = 160, n_mels: int = 80, f_min: float = 0.0, f_max: float | None = None) -> np.ndarray:
    return np.log(np.maximum(mel_power(x, rate, n_fft, hop, n_mels, f_min, f_max or rate / 2), 1e-10))


def log_mel_whisper(x: np.ndarray, rate: int, n_fft: int = 400, hop: int = 160, n_mels: int = 80, frames: int | None = None) -> np.ndarray:
    """Log-mel as speech recognisers of that family expect it: floor 8 below the global maximum, then (v + 4) / 4."""
    if frames is not None:
        x = np.pad(x, (0, max(0, frames * hop - len(x))))[: frames * hop]
    v = np.log10(np.maximum(mel_power(x, rate, n_fft, hop, n_mels, 0.0, rate / 2, reflect=True)[:-1], 1e-10))
    return (np.maximum(v, v.max(initial=-np.inf) - 8) + 4) / 4


def parabolic(left, mid, right):
    """Offset of the vertex through three equally spaced values, and its height."""
    bend = left - 2 * mid + right
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(np.abs(bend) > 1e-12, 0.5 * (left - right) / np.where(bend == 0, 1, bend), 0.0)
    d = np.clip(d, -0.5, 0.5)
    return d, mid - 0.25 * (left - right) * d


def autocorrelations(f: np.ndarray, most: int) -> np.ndarray:
    n = 1 << (f.shape[1] + most).bit_length()
    return np.fft.irfft(np.abs(np.fft.rfft(f, n, axis=1)) ** 2, n, axis=1)[:, : most + 1]


def pitch_frames(rate: int, n: int, size: int, hop: int) -> np.ndarray:
    return (np.arange(n) * hop + size // 2) / rate


def pitch_autocorrelation(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 500.0, frame_seconds: float = 0.03, hop_seconds: float = 0.01) -> dict:
    """f0 by the first maximal lag; voicing is R(lag) / R(0)."""
    size, hop = sizes(rate, frame_seconds, hop_seconds)
    f = framed(x, size, hop)
    a, b = int(round(rate / hi)), min(int(round(rate / lo)), size - 1)
    if not len(f) or b < a:
        return {"t": np.zeros(0), "hz": np.zeros(0), "voicing": np.zeros(0)}
    r = autocorrelations(f, b)
    lag = a + r[:, a:].argmax(axis=1)
    v = np.where(r[:, 0] > 0, r[np.arange(len(f)), lag] / np.where(r[:, 0] > 0, r[:, 0], 1), 0.0)
    return {"t": pitch_frames(rate, len(f), size, hop), "hz": rate / lag, "voicing": np.clip(v, 0, 1)}


def normalised(x: np.ndarray, rate: int, lo: float, frame_seconds: float, hop_seconds: float, periods: float) -> tuple[np.ndarray, int, int]:
    """Autocorrelation of Hann frames over that of the window, at least ``periods`` of the lowest pitch long."""
    size, hop = sizes(rate, max(frame_seconds, periods / lo), hop_seconds)
    f = framed(x, size, hop)
    w = np.array(hann(size))
    most = min(int(np.ceil(rate / lo)) + 2, size - 1)
    if not len(f):
        return np.zeros((0, most + 1)), size, hop
    r = autocorrelations((f - f.mean(axis=1, keepdims=True)) * w, most)
    rw = autocorrelations(w[None], most)[0]
    zero = r[:, :1] > 1e-18
    return np.where(zero, r / np.where(zero, r[:, :1], 1), 0) / (rw / rw[0]), size, hop


def pitch_windowed(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 500.0, frame_seconds: float = 0.03, hop_seconds: float = 0.01) -> dict:
    r, size, hop = normalised(x, rate, lo, frame_seconds, hop_seconds, 3)
    a, b = max(1, int(np.ceil(rate / hi))), min(int(rate / lo), r.shape[1] - 2)
    k = np.arange(len(r))
    lag = a + r[:, a : b + 1].argmax(axis=1) if len(r) else np.zeros(0, dtype=int)
    d, top = parabolic(r[k, lag - 1], r[k, lag], r[k, lag + 1]) if len(r) else (np.zeros(0), np.zeros(0))
    return {"t": pitch_frames(rate, len(r), size, hop), "hz": rate / (lag + d), "voicing": np.clip(top, 0, 1)}


def viterbi(local: np.ndarray, step) -> np.ndarray:
    """Cheapest path; ``step(i)`` gives the transition costs from frame i - 1 (rows) to frame i (columns)."""
    n, k = local.shape
    cost, back = local[0].copy(), np.zeros((n, k), dtype=int)
    for i in range(1, n):
        total = cost[:, None] + step(i)
        back[i] = total.argmin(axis=0)
        cost = total[back[i], np.arange(k)] + local[i]
    path = np.zeros(n, dtype=int)
    path[-1] = cost.argmin()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def pitch_boersma(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 500.0, frame_seconds: float = 0.03, hop_seconds: float = 0.01, candidates: int = 15, voicing: float = 0.45, silence: float = 0.03, octave: float = 0.01, jump: float = 0.35, switch: float = 0.14) -> dict:
    """Autocorrelation candidates and the cheapest path through them."""
    peak, f, s, v, size, hop = boersma_candidates(x, rate, lo, hi, frame_seconds, hop_seconds, candidates, octave)
    n = len(peak)
    if not n:
        return {"t": np.zeros(0), "hz": np.zeros(0), "voicing": np.zeros(0)}
    local, logf = boersma_costs(peak, float(np.abs(x - x.mean()).max()), f, s, voicing, silence)
    path = viterbi(local, lambda i: boersma_step(logf[i - 1], logf[i], hop / rate, jump, switch))
    return {"t": pitch_frames(rate, n, size, hop)} | boersma_chosen(path, f, s, v)


def boersma_candidates(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 500.0, frame_seconds: float = 0.03, hop_seconds: float = 0.01, candidates: int = 15, octave: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Each frame's peak, and frequencies, strengths (-inf: none) and correlations of its candidates; what a frame holds does not hang on others."""
    r, size, hop = normalised(x, rate, lo, frame_seconds, hop_seconds, 3)
    n = len(r)
    if not n:
        return np.zeros(0), *[np.zeros((0, 0))] * 3, size, hop
    peak = np.abs(framed(x, size, hop) - framed(x, size, hop).mean(axis=1, keepdims=True)).max(axis=1)
    a, b = max(1, int(np.ceil(rate / hi))), min(int(rate / lo), r.shape[1] - 2)
    mid = r[:, a : b + 1]
    is_peak = (mid > r[:, a - 1 : b]) & (mid >= r[:, a + 1 : b + 2]) & (mid > 0)
    d, top = parabolic(r[:, a - 1 : b], mid, r[:, a + 1 : b + 2])
    hz = rate / (np.arange(a, b + 1) + d)
    top = np.clip(top, 0, 1)
    strength = np.where(is_peak, top + octave * np.log2(hz / lo), -np.inf)
    k = min(candidates, strength.shape[1])
    best = np.argsort(-strength, axis=1, kind="stable")[:, :k]
    row = np.arange(n)[:, None]
    return peak, hz[row, best], strength[row, best], top[row, best], size, hop


def boersma_costs(peak: np.ndarray, overall: float | np.ndarray, f: np.ndarray, s: np.ndarray, voicing: float = 0.45, silence: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Costs of each frame's states, the first of which is unvoiced, and their log frequencies (NaN: unvoiced).  ``overall``: the recording's peak."""
    usable = np.isfinite(s)
    quiet = voicing + np.maximum(0, 2 - (peak / np.maximum(overall, 1e-12)) / silence / (1 + voicing))
    local = np.concatenate([-quiet[:, None], np.where(usable, -s, 1e9)], axis=1)
    return local, np.concatenate([np.full((len(f), 1), np.nan), np.log2(np.where(usable, f, 1))], axis=1)


def boersma_step(before: np.ndarray, after: np.ndarray, hop_seconds: float, jump: float = 0.35, switch: float = 0.14) -> np.ndarray:
    """Costs of the ways from the states of one frame (rows) to those of the next (columns)."""
    p, q = before[:, None], after[None, :]
    both = ~np.isnan(p) & ~np.isnan(q)
    return 0.01 / hop_seconds * np.where(both, jump * np.abs(np.where(both, p - q, 0)), np.where(np.isnan(p) & np.isnan(q), 0, switch))


def boersma_chosen(path: np.ndarray, f: np.ndarray, s: np.ndarray, v: np.ndarray) -> dict:
    unvoiced, at = path == 0, np.arange(len(path))
    pick = np.where(unvoiced, 0, path - 1)
    return {"hz": np.where(np.isfinite(s[at, pick]), f[at, pick], 0.0), "voicing": np.where(unvoiced, 0.0, v[at, pick])}


def difference(f: np.ndarray, most: int) -> np.ndarray:
    """Squared differences over n - lag terms, and their cumulative mean normalised form."""
    n = f.shape[1]
    energy = np.concatenate([np.zeros((len(f), 1)), np.cumsum(f * f, axis=1)], axis=1)
    lags = np.arange(most + 1)
    d = energy[:, n - lags] + (energy[:, -1:] - energy[:, lags]) - 2 * autocorrelations(f, most)
    d = np.maximum(d, 0)
    d[:, 0] = 0
    total = np.cumsum(d, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(total > 0, d * lags / np.where(total > 0, total, 1), 1.0)
    out[:, 0] = 1
    return out


def yin_frames(x: np.ndarray, rate: int, lo: float, hi: float, frame_seconds: float, hop_seconds: float) -> tuple[np.ndarray, int, int, int, int]:
    most = int(np.ceil(rate / lo))
    size, hop = sizes(rate, frame_seconds, hop_seconds)
    size = max(size, 2 * most)
    return difference(framed(x, size, hop), most), max(2, int(np.floor(rate / hi))), most, size, hop


def pitch_yin(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 500.0, frame_seconds: float = 0.03, hop_seconds: float = 0.01, threshold: float = 0.1) -> dict:
    """First local minimum of the normalised difference below the threshold, else the least."""
    d, a, b, size, hop = yin_frames(x, rate, lo, hi, frame_seconds, hop_seconds)
    if not len(d):
        return {"t": np.zeros(0), "hz": np.zeros(0), "voicing": np.zeros(0)}
    mid = d[:, a:b]
    dip = (mid < threshold) & (mid <= d[:, a - 1 : b - 1]) & (mid < d[:, a + 1 : b + 1])
    lag = a + np.where(dip.any(axis=1), dip.argmax(axis=1), mid.argmin(axis=1))
    k = np.arange(len(d))
    off, low = parabolic(d[k, lag - 1], d[k, lag], d[k, lag + 1])
    return {"t": pitch_frames(rate, len(d), size, hop), "hz": rate / (lag + off), "voicing": np.clip(1 - low, 0, 1)}


def pitch_pyin(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 500.0, frame_seconds: float = 0.03, hop_seconds: float = 0.01, thresholds: int = 100, per_semitone: int = 20) -> dict:
    """Votes of beta(2, 18)-weighted thresholds for pitch bins, then the likeliest path of voiced and unvoiced states."""
    votes, size, hop = pyin_votes(x, rate, lo, hi, frame_seconds, hop_seconds, thresholds, per_semitone)
    n, bins = votes.shape
    if not n:
        return {"t": np.zeros(0), "hz": np.zeros(0), "voicing": np.zeros(0)}
    score, back = pyin_advanced(None, votes, per_semitone)
    state = int(score.reshape(-1).argmax())
    path = np.zeros(n, dtype=int)
    for i in range(n - 1, -1, -1):
        path[i] = state
        state = int(back[i, state])
    return {"t": pitch_frames(rate, n, size, hop)} | pyin_chosen(path, votes[np.arange(n), path % bins], bins, lo, per_semitone)


def pyin_bins(lo: float = 75.0, hi: float = 500.0, per_semitone: int = 20) -> int:
    return int(round(12 * np.log2(hi / lo))) * per_semitone


def pyin_votes(x: np.ndarray, rate: int, lo: float = 75.0, hi: float = 500.0, frame_seconds: float = 0.03, hop_seconds: float = 0.01, thresholds: int = 100, per_semitone: int = 20) -> tuple[np.ndarray, int, int]:
    """Each frame's weights of the pitch bins; what a frame holds does not hang on others."""
    d, a, b, size, hop = yin_frames(x, rate, lo, hi, frame_seconds, hop_seconds)
    level = (np.arange(thresholds) + 0.5) / thresholds
    weight = 342 * level * (1 - level) ** 17
    weight /= weight.sum()
    bins = pyin_bins(lo, hi, per_semitone)
    votes = np.zeros((len(d), bins))
    for i in range(len(d)):
        mid = d[i, a:b]
        dips = np.flatnonzero((mid <= d[i, a - 1 : b - 1]) & (mid < d[i, a + 1 : b + 1]))
        if not len(dips):
            continue
        below = mid[dips][None, :] < level[:, None]
        some = below.any(axis=1)
        lag = a + dips
        off, _ = parabolic(d[i, lag - 1], d[i, lag], d[i, lag + 1])
        at = (12 * per_semitone * np.log2(rate / (lag + off) / lo)).astype(int)[below.argmax(axis=1)]
        some &= (at >= 0) & (at < bins)
        votes[i] = np.bincount(at[some], weight[some], bins)
    return votes, size, hop


def pyin_advanced(score: np.ndarray | None, votes: np.ndarray, per_semitone: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Scores after frames, from those before them (None: the recording begins), and the state (voiced bins, then unvoiced) that each state of each frame came from."""
    n, bins = votes.shape
    sigma = 0.5 * per_semitone
    reach = int(np.ceil(4 * sigma))
    kernel = np.log(np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2))
    kernel -= np.log(np.exp(kernel).sum())
    voiced = np.log(votes + 1e-12)
    quiet = np.log(np.maximum(1 - votes.sum(axis=1), 1e-12) / bins)
    stay, change = np.log(0.99), np.log(0.01)
    back = np.zeros((n, 2, bins), dtype=np.int16)
    index = np.arange(bins)
    for i in range(n):
        if score is None:
            score = np.stack([voiced[0], np.full(bins, quiet[0])])
            continue
        best, arg = [], []
        for s in (0, 1):
            pad = np.pad(score[s], reach, constant_values=-np.inf)
            view = np.lib.stride_tricks.sliding_window_view(pad, 2 * reach + 1) + kernel
            k = view.argmax(axis=1)
            best.append(view[index, k])
            arg.append(np.clip(index + k - reach, 0, bins - 1))
        new = np.empty_like(score)
        for s in (0, 1):
            keep, swap = best[s] + stay, best[1 - s] + change
            new[s] = np.maximum(keep, swap)
            back[i, s] = np.where(keep >= swap, s * bins + arg[s], (1 - s) * bins + arg[1 - s])
        score = new + np.stack([voiced[i], np.full(bins, quiet[i])])
    return score, back.reshape(n, 2 * bins)


def pyin_chosen(path: np.ndarray, own: np.ndarray, bins: int, lo: float = 75.0, per_semitone: int = 20) -> dict:
    """``own``: the votes of each frame for the bin that the path takes."""
    return {"hz": lo * 2 ** ((path % bins + 0.5) / (12 * per_semitone)), "voicing": np.where(path < bins, own, 0.0)}


PITCH = {"autocorrelation": pitch_autocorrelation, "windowed": pitch_windowed, "boersma": pitch_boersma, "yin": pitch_yin, "pyin": pitch_pyin, "swipe": pitch_swipe}


def pitch(x: np.ndarray, rate: int, method: str = "boersma", **config) -> dict:
    if method not in PITCH:
        raise ValueError(f"unknown method {method!r}")
    return PITCH[method](x, rate, **config)
