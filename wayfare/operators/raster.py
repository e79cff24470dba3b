"""Raster statistics of small images: background, ink, components, logo region, dominant colour.

Images are RGBA bytes with width and height, one a row, worked on with NumPy in Arrow batches.
"""

from __future__ import annotations

import numpy as np

from ..functions.udf import on_arrow

INK = 48.0


def pixels(rgba: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def distance(image: np.ndarray, colour) -> np.ndarray:
    d = image[..., :3].astype(float) - np.asarray(colour, float)
    return np.sqrt((d * d * (2, 4, 3)).sum(-1))


def background(image: np.ndarray) -> tuple[int, int, int]:
    """The most common colour of the border, four bits a channel; the mean of its pixels."""
    edge = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])[:, :3]
    key = (edge >> 4).astype(int) @ (256, 16, 1)
    top = np.bincount(key).argmax()
    return tuple(int(x) for x in edge[key == top].mean(0).round())


def ink_mask(image: np.ndarray, back, limit: float = INK) -> np.ndarray:
    """Opaque pixels further than ``limit`` from the background; squares of whole numbers, so nothing is rounded."""
    d = image[..., :3].astype(np.int32) - np.asarray(back, np.int32)
    d *= d
    return (2 * d[..., 0] + 4 * d[..., 1] + 3 * d[..., 2] > limit * limit) & (image[..., 3] > 127)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Ink spread by a square of a radius."""
    for axis in (0, 1):
        out = mask.copy()
        for k in range(1, radius + 1):
            a, b = [slice(None)] * 2, [slice(None)] * 2
            a[axis], b[axis] = slice(k, None), slice(None, -k)
            out[tuple(a)] |= mask[tuple(b)]
            out[tuple(b)] |= mask[tuple(a)]
        mask = out
    return mask


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, pixels) of 4-connected regions: runs of rows, found at once, joined by union-find."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    step = padded[:, 1:] - padded[:, :-1]
    ys, los = np.nonzero(step == 1)
    runs = list(zip(ys.tolist(), los.tolist(), np.nonzero(step == -1)[1].tolist(), strict=True))
    parent, above, here, row = list(range(len(runs))), [], [], -1

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (y, lo, hi) in enumerate(runs):
        if y != row:
            above, here, row = here if y == row + 1 else [], [], y
        for a, b, j in above:
            if a < hi and lo < b:
                parent[find(i)] = find(j)
        here.append((lo, hi, i))
    boxes: dict[int, list[int]] = {}
    for i, (y, lo, hi) in enumerate(runs):
        b = boxes.setdefault(find(i), [lo, y, hi, y + 1, 0])
        b[0], b[2], b[3], b[4] = min(b[0], lo), max(b[2], hi), y + 1, b[4] + hi - lo
    return sorted((x, y, r - x, b - y, n) for x, y, r, b, n in boxes.values())


def transition_rate(mask: np.ndarray) -> float:
    """Changes between ink and none along rows, for each pixel."""
    return float(np.count_nonzero(mask[:, 1:] != mask[:, :-1]) / max(1, mask.size))


def candidate_score(box, width: int, height: int, rate: float) -> float:
    """How much a region looks like a logo: high up, of middling size and shape, not like text or a barcode."""
    x, y, w, h, n = box
    share, ratio = w * h / (width * height), w / max(h, 1)
    fill = n / max(1, w * h)
    return 30 * (y < 0.25 * height) + 20 * (0.005 < share < 0.15) + 15 * (0.5 <= ratio <= 6) + 10 * (0.15 < fill < 0.95) + 10 * (x < 0.2 * width or abs(x + w / 2 - width / 2) < 0.1 * width) - 40 * (rate > 0.25) - 30 * (share > 0.4)


def logo_region(image: np.ndarray, least: float = 42) -> tuple[int, int, int, int] | None:
    return _logo_of(ink_mask(image, background(image)), least)


def _logo_of(mask: np.ndarray, least: float = 42) -> tuple[int, int, int, int] | None:
    height, width = mask.shape
    found = []
    for box in components(dilate(mask, max(1, width // 100))):
        x, y, w, h, _ = box
        if w >= 8 and h >= 8:
            found.append((candidate_score(box, width, height, transition_rate(mask[y : y + h, x : x + w])), (x, y, w, h)))
    best = max(found, default=(0, None), key=lambda f: f[0])
    return best[1] if best[0] >= least else None


def tight_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """The smallest box around all ink."""
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return (int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)) if len(ys) else None


def dominant_colour(image: np.ndarray, least: int = 12) -> int | None:
    """0xRRGGBB of the most common coloured bucket, or null under so many pixels."""
    rgb = image[..., :3].reshape(-1, 3).astype(int)
    r, g, b = rgb.T
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    some = rgb[(4 * (high - low) > np.maximum(high, 1)) & (image[..., 3].reshape(-1) > 127)]
    if not len(some):
        return None
    key = (some >> 4) @ (256, 16, 1)
    counts = np.bincount(key)
    top = counts.argmax()
    if counts[top] < least:
        return None
    r, g, b = some[key == top].mean(0).round().astype(int)
    return int(r << 16 | g << 8 | b)


def looks_like_barcode(image: np.ndarray) -> bool:
    """Little colour, few midtones, many changes on most rows."""
    r, g, b = (image[..., k].astype(np.int32) for k in range(3))
    if (np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b) > 64).mean() > 0.02:
        return False
    grey = r + g + b  # three times as much
    if ((grey > 3 * 64) & (grey < 3 * 192)).mean() > 0.35:
        return False
    dark = grey < 3 * 128
    crossings = (dark[:, 1:] != dark[:, :-1]).sum(1)
    return bool(np.median(crossings) >= 6 and (crossings >= 4).mean() >= 0.75)


def summary(rgba: bytes, width: int, height: int) -> dict:
    """Background, dominant colour, share of ink, number of regions, logo and barcode of one image."""
    image = pixels(rgba, int(width), int(height))
    back = background(image)
    mask = ink_mask(image, back)
    box = _logo_of(mask)
    return {
        "background": back[0] << 16 | back[1] << 8 | back[2], "dominant": dominant_colour(image), "ink": float(mask.mean()), "n_components": len(components(mask)),
        "logo": dict(zip(("x", "y", "width", "height"), map(int, box), strict=True)) if box else None, "barcode": looks_like_barcode(image),
    }


@on_arrow(f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in ['background int', 'dominant int', 'ink double', 'n_components int', 'logo struct<x:int,y:int,width:int,height:int>', 'barcode boolean'])}>")
def raster_stats(rgba, width, height):
    return summary(rgba, width, height)
