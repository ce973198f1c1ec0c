"""Registration of frame pairs: masked correlation finds a shift, correlation ascent refines it.

A relative pose puts the moving frame j in the frame of the fixed one i: x_i = R(phi) x_j + d, both
about their fields' centres."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from petroloom.functions import imaging as im
from petroloom.functions.fov import FieldOfView
from petroloom.settings import Settings


def smooth_size(n: int) -> int:
    """The next length with no prime factor above 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


@dataclass
class Image:
    """A frame prepared for one search: values, squares and mask as spectra."""

    f: np.ndarray
    f2: np.ndarray
    m: np.ndarray


@dataclass
class Peak:
    sx: float
    sy: float
    peak: float
    second: float
    overlap: float


@dataclass
class Pose:
    dx: float
    dy: float
    phi: float
    quality: float
    ncc: float
    overlap: float


@dataclass
class Prepared:
    work: np.ndarray  # grey, at working scale
    fine: np.ndarray  # high-passed, at working scale
    mask: np.ndarray  # for the fine step
    coarse: Image
    sharpness: float
    content: float = 1.0


class MaskedCorrelation:
    """Normalised correlation of masked images for every shift (Padfield 2012). Content at p in the moving
    image is found at p + s in the fixed one."""

    def __init__(self, shape: tuple[int, int], least: float) -> None:
        self.h, self.w = shape
        self.size = tuple(smooth_size(2 * n - 1) for n in shape)
        self.least = max(least, 16.0)
        self.y, self.x = np.arange(1 - self.h, self.h)[:, None], np.arange(1 - self.w, self.w)[None]
        self._at = np.ix_(self.y[:, 0] % self.size[0], self.x[0] % self.size[1])

    def image(self, img: np.ndarray, mask: np.ndarray) -> Image:
        m = (mask > 0).astype(np.float64)
        f = img * m
        return Image(*(np.fft.rfft2(a, self.size) for a in (f, f * f, m)))

    def _against(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fft.irfft2(a * np.conj(b), self.size)[self._at]

    def __call__(self, a: Image, b: Image) -> tuple[np.ndarray, np.ndarray]:
        """Correlation by shift, and the pixels that overlap; shifts with too few are -inf."""
        n = np.rint(self._against(a.m, b.m))
        enough = n >= self.least
        n = np.maximum(n, 1)
        fa, fb = self._against(a.f, b.m), self._against(a.m, b.f)
        va = np.maximum(self._against(a.f2, b.m) - fa * fa / n, 0)
        vb = np.maximum(self._against(a.m, b.f2) - fb * fb / n, 0)
        spread = np.sqrt(va * vb)
        floor = 1e-4 * max(float(spread.max()), 1e-12)
        score = np.where(spread > floor, (self._against(a.f, b.f) - fa * fb / n) / np.maximum(spread, floor), 0.0)
        return np.where(enough, np.clip(score, -1, 1), -np.inf), n


def _vertex(left: float, middle: float, right: float) -> float:
    bend = left - 2 * middle + right
    return float(np.clip(0.5 * (left - right) / bend, -0.5, 0.5)) if np.isfinite(bend) and bend < 0 else 0.0


class Registrar:
    def __init__(self, fov: FieldOfView, settings: Settings) -> None:
        self.fov, self.st = fov, settings
        d = self.diameter = fov.diameter
        self.s_work = min(1.0, settings.work_diameter / d)
        self.s_coarse = min(self.s_work, settings.coarse_diameter / d)
        self.mask, self.mask_coarse = fov.mask(self.s_work), fov.mask(self.s_coarse)
        self.inner = fov.mask(self.s_work, 4)
        self.area = float(self.mask_coarse.sum())
        self.correlate = MaskedCorrelation(self.mask_coarse.shape, settings.min_overlap_area * self.area)
        self.sigma_work, self.sigma_coarse = max(2.0, d * self.s_work / 40), max(1.5, d * self.s_coarse / 40)
        self.d_coarse = d * self.s_coarse

    # Preparation

    def _coarse(self, work: np.ndarray) -> np.ndarray:
        return im.resize(work, self.s_coarse / self.s_work, self.fov.size(self.s_coarse))

    def prepare(self, crop: np.ndarray) -> Prepared:
        work = im.resize(im.gray(crop), self.s_work, self.fov.size(self.s_work))
        sharp = float(im.laplacian(work)[self.inner].var()) if self.inner.any() else 0.0
        coarse = im.highpass(self._coarse(work), self.mask_coarse, self.sigma_coarse)
        return Prepared(work, im.highpass(work, self.mask, self.sigma_work), self.mask, self.correlate.image(coarse, self.mask_coarse), sharp)

    def specimen(self, p: Prepared) -> Prepared:
        """The same frame with only the specimen in its masks: large dark regions and a band along them
        are left out; small dark spots belong to it."""
        st = self.st
        g = im.blur(p.work, 2.0)
        level = max(st.link_dark_level, 0.3 * float(np.percentile(g[self.mask], 95)))
        dark = im.dilate(im.erode((g < level) & self.mask, 1, True), 1, True)
        label, sizes = im.blobs(dark)
        large = sizes > 0.01 * self.mask.sum()
        large[0] = False
        ground = large[label]
        content = self.mask & ~ground
        core = im.erode(content & ~im.dilate(ground, max(2, round(st.link_edge_band * self.diameter * self.s_work))), 2, True) & content

        def within(img: np.ndarray, all_: np.ndarray, kept: np.ndarray, sigma: float) -> np.ndarray:
            out = im.highpass(img, all_, sigma) * kept
            sd = float(np.sqrt((out**2).sum() / max(kept.sum(), 1)))
            return out / sd if sd > 0 else out

        small = self._coarse(content.astype(np.float32)) > 0.5, self._coarse(core.astype(np.float32)) > 0.98
        coarse = within(self._coarse(p.work), *small, self.sigma_coarse)
        return Prepared(p.work, within(p.work, content, core, self.sigma_work), core, self.correlate.image(coarse, small[1]), p.sharpness, float(core.sum()) / max(float(self.mask.sum()), 1.0))

    # Search

    def coarse(self, a: Prepared, b: Prepared, near: tuple[float, float] | None = None, radius: float | None = None, strict: bool = False) -> Peak | None:
        """The best shift, if it stands out from any other far enough from it."""
        score, n = self.correlate(a.coarse, b.coarse)
        c = self.correlate
        if near is not None:
            score = np.where((c.x - near[0]) ** 2 + (c.y - near[1]) ** 2 <= radius**2, score, -np.inf)
        y, x = np.unravel_index(int(np.argmax(score)), score.shape)
        peak = float(score[y, x])
        if not np.isfinite(peak):
            return None
        sy, sx = int(c.y[y, 0]), int(c.x[0, x])
        away = (c.x - sx) ** 2 + (c.y - sy) ** 2 > max(3.0, 0.06 * self.d_coarse) ** 2
        second = max(0.0, float(score[away].max(initial=-np.inf)))
        if peak < self.st.min_ncc * (1.5 if strict else 1.0) or second > self.st.max_peak_ratio * (0.9 if strict else 1.0) * peak:
            return None
        dx = _vertex(*score[y, x - 1 : x + 2]) if 0 < x < score.shape[1] - 1 else 0.0
        dy = _vertex(*score[y - 1 : y + 2, x]) if 0 < y < score.shape[0] - 1 else 0.0
        return Peak(sx + dx, sy + dy, peak, second, float(n[y, x]) / self.area)

    def refine(self, a: Prepared, b: Prepared, found: Peak) -> Pose | None:
        """Ascent of the enhanced correlation coefficient (Evangelidis and Psarakis 2008)."""
        st, f = self.st, self.s_work / self.s_coarse
        rotate = st.max_rotation_deg > 0
        shift = np.array([-found.sx, -found.sy]) * f  # from fixed to moving pixels
        h, w = self.mask.shape
        y, x = np.mgrid[:h, :w].astype(np.float32)
        wear = 3 + math.ceil(math.radians(st.max_rotation_deg) * self.diameter * self.s_work / 2)
        moved = im.sample(a.mask.astype(np.float32), x - np.float32(shift[0]), y - np.float32(shift[1])) > 0.5
        valid = im.erode(moved & b.mask, wear)  # in moving pixels
        overlap = float(valid.sum()) / max(float(self.mask.sum()), 1.0)
        if overlap < 0.7 * st.min_overlap_area or valid.sum() < 16:
            return None
        fixed, moving = im.blur(a.fine, 0.8), im.blur(b.fine, 0.8)
        gy, gx = np.gradient(moving)
        layers = np.stack([moving, gx, gy, valid.astype(np.float32)], axis=2)
        ys, xs = np.nonzero(valid)
        lo = np.floor([xs.min() - shift[0] - 4, ys.min() - shift[1] - 4]).astype(int)
        hi = np.ceil([xs.max() - shift[0] + 5, ys.max() - shift[1] + 5]).astype(int)
        part = slice(max(0, lo[1]), min(h, hi[1])), slice(max(0, lo[0]), min(w, hi[0]))
        y, x, fixed = y[part], x[part], fixed[part]
        theta, t, last = 0.0, shift.copy(), -2.0
        for _ in range(80):
            c, s = math.cos(theta), math.sin(theta)
            v = im.sample(layers, c * x - s * y + t[0], s * x + c * y + t[1])
            ok = v[..., 3] > 0.5
            if ok.sum() < 16:
                return None
            m, u, gx_, gy_ = v[..., 0][ok], fixed[ok], v[..., 1][ok], v[..., 2][ok]
            m, u = (m - m.mean()).astype(float), (u - u.mean()).astype(float)
            cols = [gx_, gy_]
            if rotate:
                cols.append(gy_ * (c * x[ok] - s * y[ok]) - gx_ * (s * x[ok] + c * y[ok]))
            jac = np.stack(cols, axis=1).astype(float)
            norm = math.sqrt(float(u @ u) * float(m @ m))
            if norm <= 0:
                return None
            rho = float(u @ m) / norm
            if abs(rho - last) < 1e-7:
                break
            last = rho
            hess, on_m, on_u = jac.T @ jac, jac.T @ m, jac.T @ u
            try:
                inv_m = np.linalg.solve(hess, on_m)
            except np.linalg.LinAlgError:
                return None
            under = float(u @ m) - float(on_u @ inv_m)
            gain = (float(m @ m) - float(on_m @ inv_m)) / under if under > 0 else 1.0
            step = np.linalg.solve(hess, jac.T @ (gain * u - m))
            t = t + step[:2]
            theta += float(step[2]) if rotate else 0.0
            if not np.isfinite(t).all() or np.abs(t - shift).max() > self.diameter:
                return None
        middle = np.array([xs.mean(), ys.mean()]) - shift
        c, s = math.cos(theta), math.sin(theta)
        turn = np.array([[c, -s], [s, c]])
        if abs(math.degrees(theta)) > st.max_rotation_deg and rotate or np.hypot(*(turn @ middle + t - middle - shift)) > max(4.0, 2.5 * f) or last < st.min_quality:
            return None
        centre = np.array(self.fov.centre(self.s_work))
        d = -turn.T @ (turn @ centre + t - centre) / self.s_work
        return Pose(float(d[0]), float(d[1]), -theta, last, found.peak, overlap)

    def register(self, a: Prepared, b: Prepared, near: tuple[float, float] | None = None, radius: float | None = None, strict: bool = False) -> tuple[Peak | None, Pose | None]:
        """near and radius in frame pixels and diameters."""
        at = None if near is None else (near[0] * self.s_coarse, near[1] * self.s_coarse)
        found = self.coarse(a, b, at, None if radius is None else max(2.0, radius * self.d_coarse), strict)
        return found, self.refine(a, b, found) if found else None
