"""NumPy kernels: signatures of vectors and measures of small rasters (uint8, height x width x BGR).

Image libraries are not needed; smoothing and borders are defined here, so results are consistent with
each other rather than with any library.
"""

from __future__ import annotations

import numpy as np


def _z(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64).ravel()
    sd = v.std()
    return (v - v.mean()) / sd if sd > 1e-12 else np.zeros_like(v)


def gray(image: np.ndarray) -> np.ndarray:
    return image[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in [0, 180), saturation and value in [0, 255]."""
    b, g, r = (image[..., i].astype(np.float64) for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = np.where(v > low, v - low, 1.0)
    h = np.where(v == r, (g - b) / d % 6, np.where(v == g, (b - r) / d + 2, (r - g) / d + 4)) * 30
    return np.where(v > low, h, 0.0), np.where(v > 0, 255 * (v - low) / np.maximum(v, 1), 0.0), v


def _shifted(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    padded = np.pad(x, 1, mode="reflect" if min(x.shape) > 1 else "edge")
    return padded[1 + dy : 1 + dy + x.shape[0], 1 + dx : 1 + dx + x.shape[1]]


def laplacian_variance(g: np.ndarray) -> float:
    return float((_shifted(g, -1, 0) + _shifted(g, 1, 0) + _shifted(g, 0, -1) + _shifted(g, 0, 1) - 4 * g).var())


def sobel_share(g: np.ndarray, least: float = 25.0) -> float:
    at = lambda dy, dx: _shifted(g, dy, dx)
    x = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    y = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    return float(((np.abs(x) + np.abs(y)) / 2 > least).mean())


def box_resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average; exact also where sizes do not divide."""
    def along(x: np.ndarray, size: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        edge = np.linspace(0, len(x), size + 1)
        whole = np.minimum(edge.astype(int), len(x) - 1)
        part = (edge - whole).reshape(-1, *[1] * (x.ndim - 1))
        at = total[whole] + x[whole] * part
        return np.diff(at, axis=0) * (size / len(x))

    return np.swapaxes(along(np.swapaxes(along(x.astype(np.float64), height), 0, 1), width), 0, 1)


def skin_mask(image: np.ndarray) -> np.ndarray:
    h, s, v = hsv(image)
    return ((h <= 25) | (h >= 165)) & (s >= 30) & (s <= 180) & (v >= 60)


def frame_metrics(image: np.ndarray, before: np.ndarray | None = None) -> dict[str, float]:
    """The cheap measures of a sampled frame; motion against the frame before it."""
    g = gray(image)
    _, s, v = hsv(image)
    bottom = g[int(0.7 * len(g)) :]
    motion = float(np.abs(g - gray(before)).mean() / 255) if before is not None and before.shape == image.shape else 0.0
    return {
        "paper_ratio": float(((v > 110) & (s < 70)).mean()), "bright_mean": float(v.mean()), "sat_mean": float(s.mean()),
        "blur": laplacian_variance(g), "edge_density": sobel_share(g), "motion": motion,
        "skin": float(skin_mask(image).mean()), "bottom_dark": float((bottom < 80).mean()) if bottom.size else 0.0,
    }


def image_hash(image: np.ndarray, side: int = 16) -> np.ndarray:
    """side x side difference bits of a (side + 1)-wide area thumbnail, in 64-bit words."""
    small = box_resize(gray(image), side, side + 1)
    bits = (np.diff(small, axis=1) > 0).ravel()
    return np.packbits(bits, bitorder="little").view(np.int64) if bits.size % 64 == 0 else np.packbits(bits, bitorder="little").astype(np.int64)


def row_profile(image: np.ndarray, size: int = 128) -> np.ndarray:
    """z-scores of the ink of rows."""
    g = gray(image)
    ink = (g < np.median(g) - 20).mean(axis=1)
    return _z(box_resize(ink[:, None], size, 1)[:, 0])


def thumbnail(image: np.ndarray, side: int = 32) -> np.ndarray:
    small = box_resize(gray(image), side, side)
    return (small > np.median(small)).astype(np.uint8)


def visual_metrics(image: np.ndarray) -> dict[str, float]:
    """What clean_visual_score, gray_penalty and finger_penalty read."""
    _, s, v = hsv(image)
    skin, low = skin_mask(image), int(0.75 * len(v))
    block = box_resize(v, 8, 8)
    return {
        "paper_ratio": float(((v > 110) & (s < 70)).mean()), "v_mean": float(v.mean()), "bottom_v": float(v[low:].mean()),
        "skin": float(skin.mean()), "bottom_skin": float(skin[low:].mean()), "blotch": float(block.std()),
        "text_edge": 100 * sobel_share(gray(image)),
    }


def footer_signature(image: np.ndarray, band: float = 0.09, centre: float = 0.60) -> dict:
    """Ink share, column and row profiles and 64-bit hash of the centre of the bottom band."""
    h, w = image.shape[:2]
    part = image[int(h * (1 - band)) :, int(w * (0.5 - centre / 2)) : max(1, int(w * (0.5 + centre / 2)))]
    g = gray(part)
    ink = g < g.mean() - 25
    bits = np.diff(box_resize(g, 8, 9), axis=1) > 0
    return {"ink": float(ink.mean()), "cols": _z(ink.mean(axis=0)), "rows": _z(ink.mean(axis=1)), "hash": int(np.packbits(bits.ravel(), bitorder="little").view(np.int64)[0])}


def ordered_quad(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left, by sums and differences of coordinates."""
    p = np.asarray(points, np.float64).reshape(4, 2)
    s, d = p.sum(axis=1), p[:, 1] - p[:, 0]
    return p[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def perspective(quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The 3 x 3 matrix from the corners of a width x height raster to a quad."""
    src = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], np.float64)
    rows, right = [], []
    for (x, y), (u, v) in zip(src, ordered_quad(quad)):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(right)), 1.0).reshape(3, 3)


def warp(image: np.ndarray, quad: np.ndarray, long_side: int = 1800) -> np.ndarray:
    """The quad's content as an upright raster of the given long side, bilinear."""
    q = ordered_quad(quad)
    w = max(np.linalg.norm(q[1] - q[0]), np.linalg.norm(q[2] - q[3]))
    h = max(np.linalg.norm(q[3] - q[0]), np.linalg.norm(q[2] - q[1]))
    scale = long_side / max(w, h, 1e-9)
    width, height = max(2, round(w * scale)), max(2, round(h * scale))
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    u, v, k = perspective(q, width, height) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    u, v = np.clip(u / k, 0, image.shape[1] - 1), np.clip(v / k, 0, image.shape[0] - 1)
    i, j = np.minimum(v.astype(int), image.shape[0] - 2), np.minimum(u.astype(int), image.shape[1] - 2)
    a, b = (v - i)[:, None], (u - j)[:, None]
    im = image.astype(np.float64)
    out = (im[i, j] * (1 - b) + im[i, j + 1] * b) * (1 - a) + (im[i + 1, j] * (1 - b) + im[i + 1, j + 1] * b) * a
    return out.reshape(height, width, -1).round().astype(np.uint8)


def page_quad(image: np.ndarray) -> np.ndarray | None:
    """Corners of the bright, unsaturated region, from its extreme points; None if it is under 5%."""
    _, s, v = hsv(image)
    ys, xs = np.nonzero((v > 110) & (s < 70))
    if len(ys) < 0.05 * v.size:
        return None
    p = np.stack([xs, ys], axis=1)
    return p[[(xs + ys).argmin(), (ys - xs).argmin(), (xs + ys).argmax(), (ys - xs).argmax()]].astype(np.float64)


def blank_page(image: np.ndarray, long_side: int = 1800) -> np.ndarray:
    """A blank page's raster: its quad made upright or, where none is found, the centre of the image (15 to 85 % of
    the width, 10 to 90 % of the height) at the long side. Neither straightened nor enhanced: it has no lines."""
    quad = page_quad(image)
    if quad is not None:
        return warp(image, quad, long_side)
    h, w = image.shape[:2]
    part = image[int(h * 0.10) : int(h * 0.90), int(w * 0.15) : int(w * 0.85)]
    scale = long_side / max(part.shape[:2])
    size = [max(1, round(n * scale)) for n in part.shape[:2]]
    return np.stack([box_resize(part[:, :, c].astype(np.float64), *size) for c in range(3)], axis=2).round().astype(np.uint8)


def skew_angle(image: np.ndarray, most: float = 18.0, step: float = 0.5) -> float:
    """Degrees by which rows must turn for their ink to be most uneven."""
    g = gray(image)
    ink = (g < np.median(g) - 20).astype(np.float64)
    ys, xs = np.nonzero(ink)
    if len(ys) < 10:
        return 0.0
    best, found = -1.0, 0.0
    for angle in np.arange(-most, most + step / 2, step):
        rows = np.round(ys * np.cos(np.radians(angle)) - xs * np.sin(np.radians(angle))).astype(int)
        score = float((np.bincount(rows - rows.min()).astype(np.float64) ** 2).sum())
        if score > best + 1e-9:
            best, found = score, float(angle)
    return found


def trim_borders(image: np.ndarray, most: float = 0.05) -> np.ndarray:
    """Without uniform rows and columns at the edges, up to a share of each side."""
    g = gray(image)
    h, w = g.shape
    def cut(lines: np.ndarray, limit: int) -> int:
        n = 0
        while n < limit and lines[n].std() < 3:
            n += 1
        return n
    t, b = cut(g, int(most * h)), cut(g[::-1], int(most * h))
    left, r = cut(g.T, int(most * w)), cut(g.T[::-1], int(most * w))
    return image[t : h - b, left : w - r]


def enhance(image: np.ndarray) -> np.ndarray:
    """Background flattened by a coarse maximum, contrast stretched between the 1st and 99th percentile."""
    g = gray(image)
    coarse = box_resize(g, max(1, min(16, g.shape[0])), max(1, min(16, g.shape[1])))
    back = np.kron(coarse, np.ones((-(-g.shape[0] // coarse.shape[0]), -(-g.shape[1] // coarse.shape[1]))))[: g.shape[0], : g.shape[1]]
    flat = image.astype(np.float64) * (np.maximum(back.max(), 1) / np.maximum(back, 1))[..., None]
    lo, hi = np.percentile(flat, 1), np.percentile(flat, 99)
    return np.clip((flat - lo) / max(1e-6, hi - lo) * 255, 0, 255).astype(np.uint8)
