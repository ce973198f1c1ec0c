"""Flat fields and blending of warped frames."""

from __future__ import annotations

import numpy as np

from petroloom.functions import imaging as im


def _terms(w: int, h: int) -> np.ndarray:
    """The 15 products of powers up to degree 4, by pixel."""
    y, x = np.mgrid[:h, :w]
    u, v = 2 * x.ravel() / max(w - 1, 1) - 1, 2 * y.ravel() / max(h - 1, 1) - 1
    return np.stack([u**a * v**b for a in range(5) for b in range(5 - a)], axis=1)


def flat_field(thumbs: list[np.ndarray], mask: np.ndarray, dark: float = 25.0) -> np.ndarray | None:
    """Gains that even the lighting out, from medians of many frames' pixels; None if too few are usable."""
    if len(thumbs) < 8:
        return None
    levels = np.array([least_level(t, mask, dark) for t in thumbs])
    return gain_of(*middles(np.stack(thumbs).reshape(len(thumbs), -1, 3), levels, mask.ravel()), mask)


def least_level(thumb: np.ndarray, mask: np.ndarray, dark: float) -> float:
    """The gray below which a pixel of a frame is background."""
    return max(dark, 0.3 * float(np.percentile(im.gray(thumb)[mask], 95)))


def middles(pixels: np.ndarray, levels: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some pixels (frame, pixel, 3) of all frames: which are seen often enough, and their medians (0 for others)."""
    seen = (im.gray(pixels) >= levels[:, None]) & mask
    valid = (seen.sum(axis=0) >= max(5, 0.3 * len(pixels))) & mask
    out = np.zeros((len(valid), 3))
    if valid.any():
        out[valid] = np.nanmedian(np.where(seen[:, valid, None], pixels[:, valid].astype(np.float32), np.nan), axis=0)
    return valid, out


def gain_of(valid: np.ndarray, middle: np.ndarray, mask: np.ndarray) -> np.ndarray | None:
    """Gains from the medians of all pixels; None if too few pixels have one."""
    if valid.sum() < 0.5 * mask.sum():
        return None
    terms = _terms(mask.shape[1], mask.shape[0])
    fit = terms @ np.linalg.lstsq(terms[valid], middle[valid], rcond=None)[0]
    light = fit.reshape(*mask.shape, 3)
    light /= light[mask].mean(axis=0)
    return (1 / np.clip(light, 0.3, 3)).astype(np.float32)


def edge_distance(mask: np.ndarray) -> np.ndarray:
    """The exact distance from each pixel of a mask to the nearest one outside it; beyond the picture lies nothing. All
    infinite in a mask without an outside."""
    y = np.arange(len(mask), dtype=np.float64)[:, None]
    above = np.maximum.accumulate(np.where(mask, -np.inf, y), axis=0)
    below = np.minimum.accumulate(np.where(mask, np.inf, y)[::-1], axis=0)[::-1]
    square = np.minimum(y - above, below - y) ** 2  # within columns
    best, k = square.copy(), 1
    while k < mask.shape[1] and k * k < best.max():
        np.minimum(best[:, k:], square[:, :-k] + k * k, out=best[:, k:])
        np.minimum(best[:, :-k], square[:, k:] + k * k, out=best[:, :-k])
        k += 1
    return np.sqrt(best)


def edge_weight(mask: np.ndarray) -> np.ndarray:
    """The distance to the mask's edge as a share of the largest one."""
    distance = edge_distance(mask)
    return (mask if np.isinf(distance).any() else distance / max(float(distance.max()), 1e-6)).astype(np.float32)


def warp(img: np.ndarray, weight: np.ndarray, pose: tuple[float, float, float], centre: tuple[float, float], x0: int, y0: int, w: int, h: int, kernel: str = "cubic") -> tuple[np.ndarray, np.ndarray]:
    """A frame's crop and weight over the tile [x0, x0 + w) x [y0, y0 + h) of the mosaic. Only the part of the
    tile that the crop's corners can reach is sampled."""
    out, wt = np.zeros((h, w, 3), np.float32), np.zeros((h, w), np.float32)
    reach = float(np.hypot(max(centre[0], img.shape[1] - centre[0]), max(centre[1], img.shape[0] - centre[1]))) + 1
    (left, right), (top, bottom) = ((max(0, int(np.floor(p - reach - o))), min(n, int(np.ceil(p + reach - o)) + 1)) for p, o, n in ((pose[0], x0, w), (pose[1], y0, h)))
    if left >= right or top >= bottom:
        return out, wt
    xs, ys = np.meshgrid(np.arange(x0 + left, x0 + right) - pose[0], np.arange(y0 + top, y0 + bottom) - pose[1])
    c, s = np.cos(pose[2]), np.sin(pose[2])
    u, v = c * xs + s * ys + centre[0], c * ys - s * xs + centre[1]
    wt[top:bottom, left:right] = near = im.sample(weight, u, v)
    seen = near > 0
    if seen.any():
        pixels = img.astype(np.float32), u[seen], v[seen]
        out[top:bottom, left:right][seen] = im.sample(*pixels) if kernel == "linear" else _sampled(*pixels, TAPS[kernel])
    return out, wt


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four pixels around: cubic convolution (Keys 1981) with a = -3/4."""
    a = -0.75
    far = lambda d: a * (d**3 - 5 * d**2 + 8 * d - 4)
    near = lambda d: (a + 2) * d**3 - (a + 3) * d**2 + 1
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def _lanczos(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the eight pixels around: a sinc under a window four pixels wide on either side."""
    found = [np.sinc(t + k) * np.sinc((t + k) / 4) for k in range(3, -5, -1)]
    total = sum(found)
    return [x / total for x in found]


TAPS = {"cubic": _cubic, "lanczos": _lanczos}


def _sampled(img: np.ndarray, x: np.ndarray, y: np.ndarray, taps) -> np.ndarray:
    """Samples by separable weights of the pixels around; beyond the edge the last pixel repeats."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    wx, wy = taps(x - x0), taps(y - y0)
    (h, w), first = img.shape[:2], 1 - len(wx) // 2
    out = 0.0
    for j, b in enumerate(wy):
        row = np.clip(y0 + j + first, 0, h - 1)
        line = sum(a[:, None] * img[row, np.clip(x0 + i + first, 0, w - 1)] for i, a in enumerate(wx))
        out = out + b[:, None] * line
    return out


def simple(layers: list[tuple[np.ndarray, np.ndarray]], power: float | None) -> np.ndarray:
    """The pixel of largest weight, the first of equal ones (power None), or a weighted mean."""
    h, w = layers[0][1].shape
    out, total = np.zeros((h, w, 3), np.float64), np.zeros((h, w))
    for img, weight in layers:
        if power is None:
            wins = weight > total
            out[wins], total = img[wins], np.maximum(total, weight)
        else:
            k = weight.astype(np.float64) ** power
            out += k[..., None] * img
            total += k
    if power is not None:
        out /= np.maximum(total, 1e-12)[..., None]
    out[total <= 0] = 0
    return np.clip(out + 0.5, 0, 255).astype(np.uint8)


def _down(a: np.ndarray) -> np.ndarray:
    return im.blur(a, 1.0)[::2, ::2]


def _up(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    ys, xs = (np.clip(np.arange(n) / 2, 0, m - 1) for n, m in zip(shape, a.shape[:2], strict=True))
    return im.sample(a, *np.meshgrid(xs, ys)).astype(np.float32)


def _filled(img: np.ndarray, seen: np.ndarray, levels: int) -> np.ndarray:
    """Unseen pixels take averages of seen ones around, from coarser and coarser copies."""
    w = seen.astype(np.float32)[..., None]
    if levels == 0 or seen.all() or min(img.shape[:2]) < 4:
        mean = (img * w).sum(axis=(0, 1)) / max(float(w.sum()), 1.0)
        return np.where(seen[..., None], img, mean)
    n = _down(w[..., 0])
    low = _down(img * w) / np.maximum(n, 1e-6)[..., None]
    return np.where(seen[..., None], img, _up(_filled(low, n > 1e-3, levels - 1), img.shape[:2]))


def multiband(layers: list[tuple[np.ndarray, np.ndarray]], levels: int = 5) -> np.ndarray:
    """Laplacian pyramids of frames, each band blended by the blurred masks of where a frame wins."""
    weights = np.stack([w for _, w in layers])
    owner, any_ = weights.argmax(axis=0), weights.max(axis=0) > 0
    levels = max(1, min(levels, int(np.log2(max(2, min(any_.shape)))) - 1))
    bands: list = [0.0] * (levels + 1)
    norms: list = [0.0] * (levels + 1)
    for k, (img, weight) in enumerate(layers):
        wins = ((owner == k) & any_).astype(np.float32)
        if not wins.any():
            continue
        g, m = _filled(img.astype(np.float32), weight > 0, levels), wins
        for lvl in range(levels + 1):
            low = _down(g) if lvl < levels else None
            band = g - _up(low, g.shape[:2]) if lvl < levels else g
            bands[lvl] = bands[lvl] + m[..., None] * band
            norms[lvl] = norms[lvl] + m
            if lvl < levels:
                g, m = low, _down(m)
    if isinstance(norms[0], float):
        return np.zeros((*any_.shape, 3), np.uint8)
    out = None
    for band, n in zip(reversed(bands), reversed(norms), strict=True):
        band = band / np.maximum(n, 1e-6)[..., None]
        out = band if out is None else _up(out, band.shape[:2]) + band
    out[~any_] = 0
    return np.clip(out + 0.5, 0, 255).astype(np.uint8)
