"""Run-length masks and pixel kernels in numpy, for use inside Arrow or pandas functions."""

from __future__ import annotations

import numpy as np


def encode(mask: np.ndarray) -> list[int]:
    """Column-major run lengths, the first of zeros."""
    flat = np.asarray(mask, bool).ravel(order="F")
    cuts = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], cuts, [len(flat)]]))
    return [0, *runs.tolist()] if len(flat) and flat[0] else runs.tolist()


def decode(counts: list[int], h: int, w: int) -> np.ndarray:
    values = np.arange(len(counts)) % 2 == 1
    return np.repeat(values, counts).reshape((h, w), order="F")


def area(counts: list[int]) -> int:
    return int(sum(counts[1::2]))


def tight_box(mask: np.ndarray) -> tuple[int, int, int, int]:
    """(x1, y1, x2, y2) half-open; zeros for an empty mask."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else (0, 0, 0, 0)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    union = int((a | b).sum())
    return int((a & b).sum()) / union if union else 0.0


def intrusion(own: np.ndarray, box: tuple[int, int, int, int], others: list[np.ndarray]) -> np.ndarray:
    """The union of other masks that have a pixel inside the box, without the own mask."""
    x1, y1, x2, y2 = box
    out = np.zeros_like(own)
    for m in others:
        if m[y1:y2, x1:x2].any():
            out |= m
    return out & ~own


def remainder(cached: list[np.ndarray], painted: np.ndarray) -> np.ndarray:
    """What is left to blur: in a cached mask and not painted."""
    out = np.zeros_like(painted)
    for m in cached:
        out |= m
    return out & ~painted


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """True within a square of this size."""
    r, out = size // 2, mask.copy()
    for axis in (0, 1):
        grown = out.copy()
        for s in range(1, r + 1):
            a = np.roll(out, s, axis)
            b = np.roll(out, -s, axis)
            edge = [slice(None)] * 2
            edge[axis] = slice(0, s)
            a[tuple(edge)] = False
            edge[axis] = slice(-s, None)
            b[tuple(edge)] = False
            grown |= a | b
        out = grown
    return out


def gaussian(img: np.ndarray, size: int) -> np.ndarray:
    """Separable Gaussian of an odd size; its sigma follows the size, borders are reflected."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-0.5 * ((np.arange(size) - size // 2) / sigma) ** 2)
    k /= k.sum()
    out, r = np.asarray(img, float), size // 2
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, r)
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > r else "edge")
        out = sum(np.take(wide, np.arange(i, i + out.shape[axis]), axis) * w for i, w in enumerate(k))
    return out


def blurred(frame: np.ndarray, mask: np.ndarray, kernel: int, dilate: int = 5, feather: int = 5) -> np.ndarray:
    """The frame with the dilated mask blurred and its edge feathered."""
    if not mask.any():
        return frame.copy()
    soft = gaussian(dilated(mask, dilate).astype(float), feather | 1)[..., None]
    mixed = frame * (1 - soft) + gaussian(frame, kernel) * soft
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def composite(frame: np.ndarray, patches: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(frame, painted) after patches (z, y0, x0, rgb, mask) in order of z: the first writes all of its patch where nothing is painted, later ones their mask alone."""
    out, painted = frame.copy(), np.zeros(frame.shape[:2], bool)
    for i, p in enumerate(sorted(patches, key=lambda q: q["z"])):
        h, w = p["mask"].shape
        at = slice(p["y0"], p["y0"] + h), slice(p["x0"], p["x0"] + w)
        where = np.ones((h, w), bool) if i == 0 else p["mask"]
        out[at][where] = p["rgb"][where]
        painted[at] |= p["mask"]
    return out, painted


def match_colour(x: np.ndarray, mean: np.ndarray, std: np.ndarray, to_mean: np.ndarray, to_std: np.ndarray, chroma_only: bool = False) -> np.ndarray:
    """Each channel moved from one mean and spread to another; chroma only leaves the first channel and never widens."""
    scale = to_std / np.maximum(std, 1e-3)
    if chroma_only:
        scale = np.minimum(scale, 1.0)
    out = (x - mean) * scale + to_mean
    if chroma_only:
        out[..., 0] = x[..., 0]
    return out


def compressed(counts: list[int]) -> str:
    """Run lengths as the printable code of the COCO annotation format: each from the third on as the difference to the one
    two before it, in groups of five bits, lowest first; 32 marks that more follow, and the last group carries the sign."""
    out = []
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        while True:
            group, x = x & 31, x >> 5
            last = x == (-1 if group & 16 else 0)
            out.append(chr(48 + (group if last else group | 32)))
            if last:
                break
    return "".join(out)


def expanded(code: str) -> list[int]:
    counts: list[int] = []
    x = shift = 0
    for ch in code:
        group = ord(ch) - 48
        x |= (group & 31) << shift
        shift += 5
        if not group & 32:
            if group & 16:
                x -= 1 << shift
            counts.append(x + counts[-2] if len(counts) > 2 else x)
            x = shift = 0
    return counts


def shrunk(mask: np.ndarray, factor: float) -> np.ndarray:
    """The mask at a smaller scale: each pixel is that of the place it stands for."""
    h, w = (max(1, int(round(s * factor))) for s in mask.shape)
    return resized(mask, w, h)


def resized(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Nearest neighbour: pixel i of n shows pixel floor(i * m / n) of m."""
    ys, xs = np.arange(h) * img.shape[0] // h, np.arange(w) * img.shape[1] // w
    return img[ys][:, xs]


def ellipse(r: int) -> np.ndarray:
    """The structuring element of a dilation by r pixels: rows of a circle, half widths rounded."""
    dy = np.arange(-r, r + 1)
    half = np.rint(np.sqrt(np.maximum(r * r - dy * dy, 0))).astype(int)
    return np.abs(np.arange(-r, r + 1))[None, :] <= half[:, None]


def gated(points: np.ndarray, scores: np.ndarray, mask: np.ndarray, dilate: int) -> np.ndarray:
    """Scores with zero for points (x, y) that don't fall on the mask grown by an ellipse, or are outside of the image."""
    h, w = mask.shape
    grown = np.zeros((h + 2 * dilate, w + 2 * dilate), bool)
    for dy, row in enumerate(ellipse(dilate) if dilate else np.ones((1, 1), bool)):
        for dx in np.flatnonzero(row):
            grown[dy : dy + h, dx : dx + w] |= mask
    grown = grown[dilate : dilate + h, dilate : dilate + w]
    x, y = np.rint(points[:, 0]).astype(int), np.rint(points[:, 1]).astype(int)
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    inside[inside] = grown[y[inside], x[inside]]
    return np.where(inside, scores, 0.0)


def patch_box(changed: np.ndarray, painted: np.ndarray) -> tuple[int, int, int, int]:
    """(y0, x0, y1, x1) of what differs from the source or is painted; zeros if nothing is."""
    x1, y1, x2, y2 = tight_box(changed | painted)
    return y1, x1, y2, x2


def overlaid(source: np.ndarray, crop: tuple[int, int, int, int], patch: tuple[int, int, int, int], rgb: np.ndarray) -> np.ndarray:
    """The crop (y0, x0, y1, x1) of the source with a stored patch over it where both meet."""
    y0, x0, y1, x1 = crop
    out = source[y0:y1, x0:x1].copy()
    a, b = np.maximum(crop[:2], patch[:2]), np.minimum(crop[2:], patch[2:])
    if (b > a).all():
        out[a[0] - y0 : b[0] - y0, a[1] - x0 : b[1] - x0] = rgb[a[0] - patch[0] : b[0] - patch[0], a[1] - patch[1] : b[1] - patch[1]]
    return out


def neighbour_crop(frame: np.ndarray, box: tuple[int, int, int, int], remove: np.ndarray | None) -> np.ndarray:
    """The box (x1, y1, x2, y2) of a frame, clipped to it, black where a neighbour is to be left out."""
    x1, y1, x2, y2 = (max(0, v) for v in box)
    out = frame[y1:y2, x1:x2].copy()
    if remove is not None:
        out[remove[y1:y2, x1:x2]] = 0
    return out


def on_canvas(img: np.ndarray, rect: tuple[int, int, int, int], w: int, h: int, fill: int = 0) -> np.ndarray:
    """A rectangle (y0, x0, y1, x1) that may stick out of the image, filled there, at the size of the canvas."""
    y0, x0, y1, x1 = rect
    whole = np.full((y1 - y0, x1 - x0, *img.shape[2:]), fill, img.dtype)
    a, b = (max(0, y0), max(0, x0)), (min(img.shape[0], y1), min(img.shape[1], x1))
    if b[0] > a[0] and b[1] > a[1]:
        whole[a[0] - y0 : b[0] - y0, a[1] - x0 : b[1] - x0] = img[a[0] : b[0], a[1] : b[1]]
    return resized(whole, w, h)


def centred(img: np.ndarray, box: tuple[float, ...], w: int, h: int, share: float = 0.8, fill: int = 255) -> np.ndarray:
    """A canvas with the box's centre in its middle and the box as high as a share of it."""
    x1, y1, x2, y2 = box
    scale = share * h / max(1.0, y2 - y1)
    big = resized(img, max(1, round(img.shape[1] * scale)), max(1, round(img.shape[0] * scale)))
    left, top = round((x1 + x2) / 2 * scale - w / 2), round((y1 + y2) / 2 * scale - h / 2)
    return on_canvas(big, (top, left, top + h, left + w), w, h, fill)


def pasted(frame: np.ndarray, rect: tuple[int, int, int, int], canvas: np.ndarray, mask: np.ndarray, feather: int = 0) -> np.ndarray:
    """The frame with a rendered canvas put back into its rectangle where the mask (of the rectangle) is, its edge soft over ``feather`` pixels."""
    y0, x0, y1, x1 = rect
    new, out = resized(canvas, x1 - x0, y1 - y0).astype(float), frame.copy()
    alpha = mask.astype(float) if feather <= 0 else np.where(mask, 1.0, gaussian(mask.astype(float), 2 * feather + 1))
    mixed = frame[y0:y1, x0:x1] * (1 - alpha[..., None]) + new * alpha[..., None]
    out[y0:y1, x0:x1] = np.clip(np.rint(mixed), 0, 255).astype(frame.dtype)
    return out


_BYTE = np.arange(256) / 255
_LINEAR = np.where(_BYTE <= 0.04045, _BYTE / 12.92, ((_BYTE + 0.055) / 1.055) ** 2.4)


def lab(rgb: np.ndarray) -> np.ndarray:
    """8-bit sRGB to L*a*b* under D65, all three channels on a scale of 255: L by 2.55, a and b from 128."""
    linear = _LINEAR[np.asarray(rgb, np.uint8)]
    to_xyz = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    t = linear @ to_xyz.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    x, y, z = f[..., 0], f[..., 1], f[..., 2]
    light = np.where(t[..., 1] > 0.008856, 116 * y - 16, 903.3 * t[..., 1])
    return np.stack([light * 2.55, 500 * (x - y) + 128, 200 * (y - z) + 128], axis=-1)
