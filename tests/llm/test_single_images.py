"""A GIF of one image is counted without being shown."""

import numpy as np

from cellweave.llm import gif_media as G


def shown(width, height, frames):
    seen = [x[x[..., 3] > 0][:, :3].astype(int) // 64 @ (16, 4, 1) for x in G.composed(width, height, frames)]
    return [np.bincount(x, minlength=64).tolist() for x in seen]


def test_counts_of_single_images(monkeypatch):
    rng = np.random.default_rng(7)
    pixels = rng.integers(0, 256, (20, 64)).astype(np.uint8)
    small = rng.integers(0, 8, (5, 6)).astype(np.uint8)
    cases = [G.read_gif(G.encode_gif(pixels.tobytes()))]
    for clear in (None, 0, 3):
        cases.append((64, 20, [G.Frame(0, 0, pixels, G.warm_palette(), 10, 2, clear)]))
        cases.append((10, 9, [G.Frame(4, 4, small, G.warm_palette()[:6], 10, 3, clear)]))
    expected = [shown(*case) for case in cases]
    outside = (8, 6, [G.Frame(4, 4, small, G.warm_palette(), 10, 1, None)])
    assert [x.tolist() for x in G.frame_histograms(*outside)] == shown(*outside)

    def composed(*_):
        raise AssertionError("a single image needs no canvas")

    monkeypatch.setattr(G, "composed", composed)
    assert [[x.tolist() for x in G.frame_histograms(*case)] for case in cases] == expected
