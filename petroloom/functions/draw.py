"""Pictures for the reports: the detected field of view, and matches laid over each other."""

from __future__ import annotations

import numpy as np

from petroloom.functions import imaging as im
from petroloom.functions.fov import FieldOfView


def ring(shape: tuple[int, int], cx: float, cy: float, radius: float, width: float = 1.5) -> np.ndarray:
    y, x = np.ogrid[: shape[0], : shape[1]]
    return np.abs(np.hypot(x - cx, y - cy) - radius) <= width


def field_of_view(frame: np.ndarray, fov: FieldOfView) -> np.ndarray:
    """A frame with the detected circle in green and the one that is used in yellow (BGR)."""
    out = frame.copy()
    out[ring(frame.shape[:2], fov.cx, fov.cy, fov.radius)] = (0, 255, 0)
    out[ring(frame.shape[:2], fov.cx, fov.cy, fov.r_eff)] = (0, 255, 255)
    return out


def overlay(main: np.ndarray, segment: np.ndarray, fov: FieldOfView, dx: float, dy: float, phi: float, most: int = 640) -> np.ndarray:
    """Two crops in the main one's frame: main magenta, segment green, so that what agrees is grey."""
    h, w = main.shape[:2]
    cx, cy = fov.centre()
    y, x = np.mgrid[:h, :w]
    c, s = np.cos(phi), np.sin(phi)
    u, v = x - cx - dx, y - cy - dy
    a = im.gray(main)
    b = im.sample(im.gray(segment), c * u + s * v + cx, c * v - s * u + cy)
    out = np.stack([a, b, a], axis=2)
    out[ring((h, w), cx, cy, fov.r_eff)] = (255, 0, 255)
    out[ring((h, w), cx + dx, cy + dy, fov.r_eff)] = (0, 255, 0)
    return np.clip(np.rint(im.resize(out, min(1.0, most / max(h, w)))), 0, 255).astype(np.uint8)
