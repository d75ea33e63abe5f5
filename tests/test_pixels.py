"""Pixel kernels against direct restatements of their rules."""

import numpy as np
import pytest

from larkspur.functions import masks, options

RNG = np.random.default_rng(5)


def _mask(h=24, w=31, share=0.4):
    return RNG.random((h, w)) < share


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_run_lengths_and_their_code(share):
    m = _mask(share=share)
    runs = masks.encode(m)
    assert (masks.decode(runs, *m.shape) == m).all() and sum(runs) == m.size and masks.area(runs) == m.sum()
    assert masks.expanded(masks.compressed(runs)) == runs


def test_code_golden():
    # 5 zeros, 40 ones, 3 zeros, 100000 ones: 40 takes two groups, the last is the difference to 40.
    assert masks.compressed([5, 40, 3]) == "5" + chr(48 + (8 | 32)) + "1" + "3"
    assert masks.expanded(masks.compressed([5, 40, 3, 100_000, 1])) == [5, 40, 3, 100_000, 1]


def test_dilation_by_square_and_ellipse():
    m = _mask(share=0.03)
    h, w = m.shape
    want = np.zeros_like(m)
    for y, x in np.argwhere(m):
        want[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3] = True
    assert (masks.dilated(m, 5) == want).all()
    points = np.array([(x, y) for y in range(-2, h + 2) for x in range(-2, w + 2)], float)
    kept = masks.gated(points, np.ones(len(points)), m, 3)
    half = {d: round((9 - d * d) ** 0.5) for d in range(-3, 4)}
    for (x, y), s in zip(points.astype(int).tolist(), kept.tolist(), strict=True):
        near = 0 <= x < w and 0 <= y < h and any(abs(y - b) <= 3 and abs(x - a) <= half[y - b] for b, a in np.argwhere(m).tolist())
        assert s == float(near)


def test_gaussian_and_blur_by_direct_convolution():
    img, size = RNG.random((15, 18, 3)) * 255, 5
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-0.5 * (np.arange(-2, 3) / sigma) ** 2)
    k = np.outer(k, k) / (k.sum() ** 2)
    wide = np.pad(img, ((2, 2), (2, 2), (0, 0)), mode="reflect")
    want = np.array([[(wide[y : y + 5, x : x + 5] * k[..., None]).sum(axis=(0, 1)) for x in range(18)] for y in range(15)])
    assert np.abs(masks.gaussian(img, size) - want).max() < 1e-9
    frame, m = img.astype(np.uint8), np.zeros((15, 18), bool)
    assert (masks.blurred(frame, m, 5) == frame).all()
    m[6:9, 7:10] = True
    soft = masks.gaussian(masks.dilated(m, 3).astype(float), 3)[..., None]
    want = np.clip(np.rint(frame * (1 - soft) + masks.gaussian(frame, 5) * soft), 0, 255)
    assert (masks.blurred(frame, m, 5, 3, 3) == want).all() and (masks.blurred(frame, m, 5, 3, 3)[0] == frame[0]).all()


def test_composite_layer_by_layer():
    frame = np.zeros((10, 12, 3), np.uint8)
    layers = [{"z": z, "y0": y, "x0": x, "rgb": np.full((4, 5, 3), z * 10, np.uint8), "mask": _mask(4, 5, 0.5)} for z, y, x in ((3, 2, 3), (1, 0, 0), (2, 3, 4))]
    want, painted = frame.copy(), np.zeros((10, 12), bool)
    for n, p in enumerate(sorted(layers, key=lambda p: p["z"])):
        for y in range(4):
            for x in range(5):
                if n == 0 or p["mask"][y, x]:
                    want[p["y0"] + y, p["x0"] + x] = p["rgb"][y, x]
                painted[p["y0"] + y, p["x0"] + x] |= p["mask"][y, x]
    got = masks.composite(frame, layers)
    assert (got[0] == want).all() and (got[1] == painted).all()
    cached = [_mask(10, 12), _mask(10, 12)]
    assert (masks.remainder(cached, painted) == ((cached[0] | cached[1]) & ~painted)).all()


def test_patches_crops_and_canvases():
    frame = RNG.integers(0, 255, (20, 30, 3), dtype=np.uint8)
    assert masks.patch_box(np.zeros((5, 5), bool), np.zeros((5, 5), bool)) == (0, 0, 0, 0)
    rgb = np.full((6, 7, 3), 9, np.uint8)
    got = masks.overlaid(frame, (5, 5, 15, 20), (10, 15, 16, 22), rgb)
    want = frame.copy()
    want[10:16, 15:22] = rgb
    assert (got == want[5:15, 5:20]).all() and (masks.overlaid(frame, (0, 0, 5, 5), (10, 15, 16, 22), rgb) == frame[:5, :5]).all()
    away = _mask(20, 30)
    crop = masks.neighbour_crop(frame, (-3, 2, 12, 9), away)
    assert crop.shape == (7, 12, 3) and (crop[away[2:9, :12]] == 0).all() and (crop[~away[2:9, :12]] == frame[2:9, :12][~away[2:9, :12]]).all()
    canvas = masks.on_canvas(frame, (-5, -5, 15, 15), 20, 20)
    assert (canvas[:5] == 0).all() and (canvas[5:, 5:] == frame[:15, :15]).all()
    assert (masks.resized(frame, 60, 40)[::2, ::2] == frame).all()
    mid = masks.centred(frame, (10, 5, 20, 15), 30, 20, share=0.5)
    assert (mid == frame).all() or mid.shape == (20, 30, 3)
    assert (masks.centred(frame, (0, 0, 2, 10), 30, 20, share=0.5)[0, 0] == 255).all()


def test_paste_hard_and_soft():
    frame, canvas = np.zeros((12, 12, 3), np.uint8), np.full((8, 8, 3), 200, np.uint8)
    m = np.zeros((8, 8), bool)
    m[2:6, 2:6] = True
    hard = masks.pasted(frame, (2, 2, 10, 10), canvas, m)
    assert (hard[4:8, 4:8] == 200).all() and hard.sum() == 16 * 3 * 200
    soft = masks.pasted(frame, (2, 2, 10, 10), canvas, m, 2)
    assert (soft[4:8, 4:8] == 200).all() and 0 < soft[3, 5, 0] < 200


def test_colours():
    known = masks.lab(np.array([[255, 255, 255], [0, 0, 0], [255, 0, 0]], np.uint8))
    assert np.abs(known - [[255, 128, 128], [0, 128, 128], [135.76, 208.1, 195.2]]).max() < 0.5
    x = RNG.random((50, 3)) * 255
    moved = masks.match_colour(x, x.mean(axis=0), x.std(axis=0), np.array([10.0, 20, 30]), np.array([1.0, 2, 3]))
    assert np.abs(moved.mean(axis=0) - [10, 20, 30]).max() < 1e-9 and np.abs(moved.std(axis=0) - [1, 2, 3]).max() < 1e-9
    chroma = masks.match_colour(x, x.mean(axis=0), x.std(axis=0), np.array([10.0, 20, 30]), x.std(axis=0) * 3, chroma_only=True)
    assert (chroma[:, 0] == x[:, 0]).all() and np.abs(chroma[:, 1:].std(axis=0) - x[:, 1:].std(axis=0)).max() < 1e-9


def test_registry():
    r = options.Registry()
    r.add("still", lambda size: ("poser", size))
    assert r.build("still", size=3) == ("poser", 3)
    with pytest.raises(ValueError, match="unknown kind 'other'"):
        r.build("other")
