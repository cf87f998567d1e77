"""Array kernels over a batch of windows ``x[N, W]`` (complex). Spark supplies the batches."""

from __future__ import annotations

import numpy as np

FLOOR = 1e-8


def frame_batch(x, frame, hop):
    """[N, T, frame] view of every window's frames; short windows are zero-padded."""
    if x.shape[1] < frame:
        x = np.pad(x, ((0, 0), (0, frame - x.shape[1])))
    return np.lib.stride_tricks.sliding_window_view(x, frame, axis=1)[:, ::hop]


def frame_spectra(x, frame, hop):
    return np.fft.fft(frame_batch(x, frame, hop) * np.hanning(frame), axis=2)


def interpolation(old, new):
    """[new, old] linear-interpolation weights between two grids on [0, 1]."""
    at = np.linspace(0.0, 1.0, new) * (old - 1)
    return np.maximum(0.0, 1.0 - np.abs(at[:, None] - np.arange(old)))


def resize(maps, height, width):
    rows = interpolation(maps.shape[1], height)
    columns = interpolation(maps.shape[2], width)
    return rows @ maps @ columns.T


def stft_power(x, frame=128, hop=32):
    """[N, frequency, time] power with centred zero frequency."""
    spectra = np.fft.fftshift(frame_spectra(x, frame, hop), axes=2)
    return (np.abs(spectra) ** 2).transpose(0, 2, 1)


def log_stft(x, bins, frame=128, hop=32):
    return resize(np.log1p(stft_power(x, frame, hop)), bins, bins)


def energy(x, bins, frame=128, hop=32):
    power = (np.abs(frame_batch(x, frame, hop)) ** 2).mean(axis=2)
    return resize(np.repeat(power[:, :, None], 2, axis=2), bins, bins)


def effective_shift(alpha, frame):
    return int(np.clip(np.floor(alpha * frame + 0.5), 1, frame - 1))


def coherence(x, alphas, frame=128, hop=32):
    """[N, alpha, frequency] spectral correlation coherence on the native grid."""
    spectra = frame_spectra(x, frame, hop)
    out = np.empty((len(x), len(alphas), frame))
    for k, alpha in enumerate(alphas):
        shift = effective_shift(alpha, frame)
        upper = np.roll(spectra, shift // 2, axis=2)
        lower = np.roll(spectra, shift // 2 - shift, axis=2)
        cross = np.abs((upper * lower.conj()).mean(axis=1))
        energy_product = (np.abs(upper) ** 2).mean(axis=1) * (np.abs(lower) ** 2).mean(axis=1)
        out[:, k] = cross / np.sqrt(energy_product + FLOOR)
    return out


def coherence_map(x, alphas, bins, frame=128, hop=32):
    return resize(np.fft.fftshift(coherence(x, alphas, frame, hop), axes=2), bins, bins)


def morlet(n, center, bandwidth):
    """Analytic zero-mean Morlet response on the DFT grid, unit L1 norm in time."""
    f = np.fft.fftfreq(n)
    width = max(bandwidth, FLOOR)
    bell = lambda d: np.exp(-0.5 * (d / width) ** 2)
    response = np.where(f > 0, bell(f - center) - bell(center) * bell(f), 0.0)
    return response / max(np.abs(np.fft.ifft(response)).sum(), FLOOR)


def scattering(x, j, q, bins):
    """Order 1 and 2 analytic scattering, block-averaged in time, log1p, resized."""
    n = x.shape[1]
    first_centers = 0.45 * 2.0 ** (-np.arange(j * q) / q)
    second_centers = 0.45 * 2.0 ** (-np.arange(float(j)))
    first_bank = np.stack([morlet(n, c, max(c / q, 1.0 / n)) for c in first_centers])
    second_bank = np.stack([morlet(n, c, max(c, 1.0 / n)) for c in second_centers])
    first = np.abs(np.fft.ifft(np.fft.fft(x)[:, None, :] * first_bank, axis=2))
    paths = [first]
    spectra = np.fft.fft(first, axis=2)
    for k in range(len(first_centers)):
        later = second_bank[k // q + 1:]
        if len(later):
            paths.append(np.abs(np.fft.ifft(spectra[:, k, None, :] * later, axis=2)))
    stacked = np.concatenate(paths, axis=1)
    block = n // bins
    if block:
        pooled = stacked[:, :, : block * bins].reshape(len(x), -1, bins, block).mean(axis=3)
    else:
        pooled = stacked.mean(axis=2, keepdims=True)
    return resize(np.log1p(pooled), bins, bins)


def raw_iq(x, bins):
    """I and Q maps, stacked on the channel axis."""
    return np.stack([resize(part[:, None, :], bins, bins) for part in (x.real, x.imag)], axis=1)


# An atom's standard deviation in scales, and its reach in standard deviations.
GABOR_WIDTH = 1.5
GABOR_REACH = 4.5


def cwt_time(x, bins, scales=16):
    """Gabor correlation at geometric scales, aligned with the window, log1p."""
    n = x.shape[1]
    rows = []
    for scale in np.geomspace(2.0, min(256.0, max(2.0, n / 2.0)), scales):
        radius = max(4, int(np.ceil(GABOR_REACH * GABOR_WIDTH * scale)))
        t = np.arange(-radius, radius + 1)
        atom = np.exp(2j * np.pi * t / scale - 0.5 * (t / (GABOR_WIDTH * scale)) ** 2)
        atom /= max(np.linalg.norm(atom), 1e-12)
        size = n + 2 * radius
        product = np.fft.fft(x, size, axis=1) * np.fft.fft(atom.conj()[::-1], size)
        rows.append(np.abs(np.fft.ifft(product, axis=1))[:, radius : radius + n])
    return resize(np.log1p(np.stack(rows, axis=1)), bins, bins)


def cwt_frequency(x, bins, scales=16):
    """Gaussian band filters at geometric centers, log1p of the band envelope."""
    f = np.fft.fftfreq(x.shape[1])
    centers = np.geomspace(0.02, 0.45, scales)[:, None]
    width = np.maximum(centers / 4.0, 0.008)
    bank = np.where(f >= 0, np.exp(-0.5 * ((f - centers) / width) ** 2), 0.0)
    bands = np.abs(np.fft.ifft(np.fft.fft(x)[:, None, :] * bank, axis=2))
    return resize(np.log1p(bands), bins, bins)


def zigzag(size):
    """Cells of a square grid along alternating anti-diagonals."""
    cells = [(r, c) for r in range(size) for c in range(size)]
    return sorted(cells, key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))


def dct_matrix(n):
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2.0 / n)
    m[0] /= np.sqrt(2.0)
    return m


def stft_dct(x, bins=16, kept=64, frame=128, hop=32):
    basis = dct_matrix(bins)
    coefficients = basis @ log_stft(x, bins, frame, hop) @ basis.T
    rows, columns = zip(*zigzag(bins)[:kept])
    return coefficients[:, list(rows), list(columns)]


# db4 analysis low-pass taps, as published with the wavelet.
DB4_LOW = (
    -0.010597401785069032,
    0.0328830116668852,
    0.030841381835560764,
    -0.18703481171888114,
    -0.027983769416859854,
    0.6308807679298587,
    0.7148465705529157,
    0.2303778133088965,
)


def convolve_same(x, taps):
    """Centred convolution along axis 1, as long as the longer operand."""
    n, m = x.shape[1], len(taps)
    full = np.zeros((len(x), n + m - 1), dtype=np.result_type(x, float))
    for k, tap in enumerate(taps):
        full[:, k : k + n] += tap * x
    start = (min(n, m) - 1) // 2
    return full[:, start : start + max(n, m)]


def packet_energy(x):
    """log1p mean power of the eight level-3 db4 packet nodes."""
    low = np.array(DB4_LOW)
    high = low[::-1] * np.where(np.arange(len(low)) % 2, -1.0, 1.0)
    nodes = [x]
    for _ in range(3):
        nodes = [convolve_same(node, taps)[:, ::2] for node in nodes for taps in (low, high)]
    return np.log1p(np.stack([(np.abs(node) ** 2).mean(axis=1) for node in nodes], axis=1))


def psd_sobel(x, bins=16):
    """Log spectrum tiled to a map, with its horizontal and vertical Sobel responses."""
    psd = np.log1p(np.abs(np.fft.fftshift(np.fft.fft(x), axes=1)) ** 2)
    base = resize(np.repeat(psd[:, None, :], bins, axis=1), bins, bins)
    edge = np.pad(base, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    dx = edge[:, :, 2:] - edge[:, :, :-2]
    dy = edge[:, 2:] - edge[:, :-2]
    horizontal = dx[:, :-2] + 2 * dx[:, 1:-1] + dx[:, 2:]
    vertical = dy[:, :, :-2] + 2 * dy[:, :, 1:-1] + dy[:, :, 2:]
    return np.stack([base, horizontal, vertical], axis=1)


def envelope_spectrum(x):
    """Power spectrum of the mean-free envelope."""
    envelope = np.abs(x)
    return np.abs(np.fft.rfft(envelope - envelope.mean(axis=1, keepdims=True), axis=1)) ** 2


def log_envelope_256(x):
    return np.log1p(np.abs(np.fft.rfft(np.abs(x), n=256, axis=1)))
