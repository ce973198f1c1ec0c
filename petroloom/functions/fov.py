"""The circular field of view: detection, crops and masks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from petroloom.functions import imaging as im


@dataclass(frozen=True)
class FieldOfView:
    cx: float
    cy: float
    radius: float
    frame_w: int
    frame_h: int
    margin: float = 0.04

    @property
    def r_eff(self) -> float:
        return self.radius * (1 - self.margin)

    @property
    def diameter(self) -> float:
        return 2 * self.r_eff

    @property
    def box(self) -> tuple[int, int, int, int]:
        """x0, y0, x1, y1 of the crop, within the frame."""
        r = self.r_eff
        x0, y0 = max(0, int(np.floor(self.cx - r))), max(0, int(np.floor(self.cy - r)))
        x1, y1 = min(self.frame_w, int(np.ceil(self.cx + r)) + 1), min(self.frame_h, int(np.ceil(self.cy + r)) + 1)
        if min(x1 - x0, y1 - y0) < 8:
            raise ValueError("the field of view lies outside the frame")
        return x0, y0, x1, y1

    def crop(self, frame: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = self.box
        return frame[y0:y1, x0:x1]

    def centre(self, scale: float = 1.0) -> tuple[float, float]:
        """The centre in a scaled crop."""
        x0, y0, *_ = self.box
        return (self.cx - x0 + 0.5) * scale - 0.5, (self.cy - y0 + 0.5) * scale - 0.5

    def size(self, scale: float = 1.0) -> tuple[int, int]:
        x0, y0, x1, y1 = self.box
        return max(1, round((x1 - x0) * scale)), max(1, round((y1 - y0) * scale))

    def mask(self, scale: float = 1.0, shrink: float = 0) -> np.ndarray:
        """The disc in a scaled crop; shrunk, it also keeps clear of the crop's edges."""
        (w, h), (cx, cy) = self.size(scale), self.centre(scale)
        y, x = np.ogrid[:h, :w]
        m = (x - cx) ** 2 + (y - cy) ** 2 <= max(0.0, self.r_eff * scale - shrink) ** 2
        k = int(np.ceil(shrink))
        if k:
            m[:k] = m[-k:] = m[:, :k] = m[:, -k:] = False
        return m


def kasa(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    s = np.linalg.lstsq(np.stack([x, y, np.ones(len(x))], axis=1), x * x + y * y, rcond=None)[0]
    cx, cy = s[0] / 2, s[1] / 2
    return float(cx), float(cy), float(np.sqrt(max(0.0, s[2] + cx * cx + cy * cy)))


def otsu(img: np.ndarray) -> int:
    n = np.bincount(np.clip(img, 0, 255).astype(np.uint8).ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2
    return int(np.nanargmax(np.where(w1 > 0, between, np.nan))) if (w1 > 0).any() and (w0[:-1] > 0).any() else 0


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by the monotone chain."""
    pts = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def brightest(frames: Iterable[np.ndarray]) -> np.ndarray | None:
    """The largest value of each pixel; partial results of partitions combine the same way."""
    most = None
    for f in frames:
        g = im.blur(im.gray(f), 1.1)
        most = g if most is None else np.maximum(most, g)
    return most


def enclosing(points: np.ndarray) -> tuple[float, float, float]:
    """The smallest circle that holds all points: the smallest of those on two or three corners that do."""
    p = hull(*points.T) if len(points) > 2 else points
    if len(p) < 2:
        return float(p[0, 0]), float(p[0, 1]), 0.0
    far = np.linalg.norm(p[:, None] - p[None], axis=2)
    i, j = np.unravel_index(int(far.argmax()), far.shape)
    centre, r = (p[i] + p[j]) / 2, float(far[i, j]) / 2
    held = [i, j]
    while True:  # the farthest point outside joins the circle, which only grows
        away = np.linalg.norm(p - centre, axis=1)
        k = int(away.argmax())
        if away[k] <= r + 1e-9:
            return float(centre[0]), float(centre[1]), r
        held = [*held, k]
        found = []
        for m in (2, 3):
            for some in combinations(held, m):
                q = p[list(some)]
                if m == 2:
                    c = q.mean(axis=0)
                else:
                    sides = 2 * (q[1:] - q[0])
                    if abs(np.linalg.det(sides)) < 1e-9:
                        continue
                    c = np.linalg.solve(sides, (q[1:] ** 2).sum(axis=1) - (q[0] ** 2).sum())
                radius = float(np.linalg.norm(q[0] - c))
                if (np.linalg.norm(p[held] - c, axis=1) <= radius + 1e-9).all():
                    found.append((radius, some, c))
        r, held, centre = min(found, key=lambda x: x[0])
        held = list(held)


def rim(blob: np.ndarray, reach: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, y) of a blob's outline: the ends of its rows and columns, but for those that lie deeper
    than `reach` inside its hull; and the hull's corners."""
    ends = []
    for lines in (blob, blob.T):
        at = np.flatnonzero(lines.any(axis=1))
        first, last = lines[at].argmax(axis=1), lines.shape[1] - 1 - lines[at, ::-1].argmax(axis=1)
        both = np.stack([np.concatenate([first, last]), np.concatenate([at, at])], axis=1)
        ends.append(both if lines is blob else both[:, ::-1])
    points = np.unique(np.concatenate(ends), axis=0).astype(float)
    corners = hull(*points.T)
    if len(corners) < 3:
        return points, corners
    side = np.roll(corners, -1, axis=0) - corners
    normal = np.stack([-side[:, 1], side[:, 0]], axis=1) / np.linalg.norm(side, axis=1, keepdims=True)
    depth = np.abs(np.einsum("pck,ck->pc", points[:, None] - corners[None], normal))
    return points[depth.min(axis=1) <= reach], corners


# Fixed values of detection, in pixels of the small image or levels: the least level above black and above
# the 5th percentile, the width of the frame's edge, the points a fit needs, the least tolerance of a fit.
DARK, ABOVE, EDGE, POINTS, TOLERANCE = 12.0, 8.0, 3, 20, 2.0


def steady_circle(points: np.ndarray, rounds: int = 40) -> tuple[float, float, float]:
    """The circle that most points lie on, by distance: Gauss-Newton steps on the distances themselves, in which
    a point's weight falls smoothly to nothing (Tukey's biweight) as it lies farther from the circle."""
    x, y = points.T
    found = np.array(kasa(x, y))
    for _ in range(rounds):
        away = points - found[:2]
        length = np.maximum(np.hypot(*away.T), 1e-9)
        error = length - found[2]
        reach = max(TOLERANCE, 4.685 * 1.4826 * float(np.median(np.abs(error))))
        weight = np.clip(1 - (error / reach) ** 2, 0, None)
        slopes = np.column_stack([-away / length[:, None], -np.ones(len(points))])
        step = np.linalg.lstsq(slopes * weight[:, None], -error * weight, rcond=None)[0]
        found = found + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, found))


def lit(small: np.ndarray) -> np.ndarray | None:
    """The largest region brighter than the background, smoothed; None if there is none."""
    floor = max(DARK, float(np.percentile(small, 5)) + ABOVE, float(otsu(small)))
    opened = im.dilate(im.erode(small > floor, 4), 4)
    label, sizes = im.blobs(im.erode(im.dilate(opened, 4), 4))
    return label == 1 + int(np.argmax(sizes[1:])) if len(sizes) > 1 else None


def circle_of(blob: np.ndarray) -> tuple[float, float, float] | None:
    """The circle of a region whose rim the frame may cut: points at the frame's edge are no rim. Where too few
    others are left, the circle around the region."""
    points, corners = rim(blob)
    if len(corners) < 3:
        return None
    clear = np.minimum(points, np.array(blob.shape[::-1]) - 1 - points).min(axis=1) > EDGE
    return steady_circle(points[clear]) if clear.sum() >= POINTS else enclosing(corners)


def detect(most: np.ndarray, margin: float = 0.04, working: int = 800) -> FieldOfView:
    """The circle of a brightest image; the circle around the frame if none stands out."""
    h, w = most.shape
    scale = min(1.0, working / max(h, w))
    blob = lit(im.resize(most, scale))
    circle = None if blob is None else circle_of(blob)
    if circle is None:
        return FieldOfView(w / 2, h / 2, float(np.hypot(w, h) / 2), w, h, margin)
    x, y, r = circle
    return FieldOfView((x + 0.5) / scale - 0.5, (y + 0.5) / scale - 0.5, r / scale, w, h, margin)
