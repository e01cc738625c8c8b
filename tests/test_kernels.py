"""Array kernels against their definitions and the properties that image operators keep."""

import numpy as np
import pytest

from pixelweave.functions import kernels as k
from pixelweave.operators.components import sparse_roots
from pixelweave.operators.labels import assignment
from pixelweave.operators.psf import next_smooth
from pixelweave.operators.threshold import best_cuts


def blobs(n=64):
    y, x = np.mgrid[:n, :n]
    return sum(255 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 98) for a, b in ((16, 16), (16, 48), (48, 16), (48, 48), (32, 32)))


def test_morphology_orders_and_tophat():
    a = np.rint(blobs()).astype(int)
    assert (k.morphology(a, "erosion", 5) <= a).all() and (a <= k.morphology(a, "dilation", 5)).all()
    assert (k.morphology(a, "white_tophat", 5) == a - k.morphology(a, "opening", 5)).all()
    dot = np.zeros((33, 33), int)
    dot[16, 16] = 255
    sizes = [(k.morphology(dot, "dilation", 4, s) > 0).sum() for s in ("diamond", "ball", "box")]
    assert sizes[0] < sizes[1] < sizes[2] == 81
    with pytest.raises(ValueError):
        k.morphology(a, "erosion", 0)


def test_edge_filters_find_the_step():
    a = np.zeros((64, 64))
    a[:, 32:] = 100
    for kind in ("sobel", "scharr", "prewitt", "farid"):
        g = k.gradient(a, kind)
        assert g[10:-10, 31:33].min() > 10 * g[:, :28].max()
    assert k.roberts(a)[:, 32].min() > 0 and k.laplace(a)[5, 32] > 0


def test_smoothing_keeps_edges_and_lowers_noise():
    rng = np.random.default_rng(3)
    a = rng.normal(0, 5, (64, 64))
    a[:, 32:] += 100
    unit = lambda f: f((a - a.min()) / np.ptp(a)) * np.ptp(a) + a.min()
    for out in (k.kuwahara(a, 2), k.median(a, 2), unit(lambda u: k.bilateral(u, 0.1, 2)), unit(lambda u: k.total_variation(u, 0.1)), unit(lambda u: k.non_local_means(u, 5, 5, 0.1))):
        assert out[:, 40:].mean() - out[:, :24].mean() > 80
        assert out[8:-8, 40:56].std() < 0.8 * a[8:-8, 40:56].std()


def test_wavelet_inverts_and_shrinks():
    rng = np.random.default_rng(1)
    a = blobs() / 255
    for name in ("db1", "db2"):
        assert np.allclose(k.wavelet(a, "VisuShrink", "hard", name, sigma=0.0), a)
        noisy = a + rng.normal(0, 0.1, a.shape)
        assert np.abs(k.wavelet(noisy, wavelet_name=name) - a).mean() < np.abs(noisy - a).mean()


def test_ridges_light_up_a_line():
    a = np.zeros((96, 96))
    a[46:50, 8:88] = 100
    sigmas = k.scales(1, 4, 1)
    most = [x.max() for x in k.structure(a, sigmas, False)]
    norms = most[: len(sigmas)], most[len(sigmas) :]
    for kind in ("frangi", "sato", "meijering"):
        out = k.ridges(a, kind, sigmas, norms, black_ridges=False)
        assert out[47:49, 20:76].mean() > 5 * out[:30].mean()
    with pytest.raises(ValueError):
        k.scales(3, 1, 1)


def test_richardson_lucy_sharpens_and_returns_masked_pixels():
    points = np.zeros((64, 64))
    for y, x in ((16, 16), (16, 48), (48, 16), (48, 48), (32, 32)):
        points[y, x] = 100
    psf = np.outer(*[np.exp(-(np.arange(-7, 8) ** 2) / 8)] * 2)
    psf /= psf.sum()
    blurred = k.gaussian(points, 2)
    out = k.richardson_lucy(blurred, psf, 30)
    assert np.sqrt(((out - points) ** 2).mean()) < np.sqrt(((blurred - points) ** 2).mean()) and out.max() > blurred.max()
    hurt, mask = blurred.copy(), np.ones((64, 64))
    hurt[:5, :5], mask[:5, :5] = 9999, 0
    out = k.richardson_lucy(hurt, psf, 30, mask=mask)
    assert (out[:5, :5] == 9999).all() and out[10:, 10:].max() < 9999


def test_small_helpers():
    assert [next_smooth(n) for n in (1, 7, 11, 13, 127, 1000)] == [1, 7, 12, 14, 128, 1000]
    a = np.arange(63.0).reshape(7, 9)
    assert (k.crop_centred(k.pad_centred(a, (12, 10)), a.shape) == a).all()
    assert best_cuts(np.array([0.0, 120, 240]), np.array([50.0, 5, 5]), 3) == [0.0, 120.0] and best_cuts(np.array([1.0]), np.array([1.0]), 2) is None
    rng = np.random.default_rng(0)
    import itertools

    for n, m in ((3, 3), (2, 4), (4, 2)):
        s = rng.random((n, m))
        r, c = assignment(s)
        best = max(sum(s[i, p[i]] for i in range(n)) if n <= m else sum(s[p[j], j] for j in range(m)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert len(set(r)) == len(set(c)) == min(n, m) and abs(s[r, c].sum() - best) < 1e-9


def test_sparse_roots_against_flood_fill():
    rng = np.random.default_rng(5)
    mask = rng.random((40, 50)) < 0.45
    points = np.argwhere(mask)
    for full in (True, False):
        seen, n = np.zeros(mask.shape, int), 0
        for y, x in points:
            if seen[y, x]:
                continue
            n += 1
            stack = [(y, x)]
            seen[y, x] = n
            while stack:
                a, b = stack.pop()
                for dy, dx in [(p, q) for p in (-1, 0, 1) for q in (-1, 0, 1) if full or p * q == 0]:
                    c, d = a + dy, b + dx
                    if 0 <= c < 40 and 0 <= d < 50 and mask[c, d] and not seen[c, d]:
                        seen[c, d] = n
                        stack.append((c, d))
        roots = sparse_roots(points, full)
        _, ranked = np.unique(roots, return_inverse=True)
        assert (ranked + 1 == seen[mask]).all()


def test_best_cuts_take_the_least_of_equal_scores_as_sql_does():
    """A vector of check_l: two lower cuts have the same sum of all three classes, but one is ahead by rounding until the last is added."""
    places = np.array([
        0, 5, 7, 8, 30, 42, 51, 52, 57, 61, 62, 66, 68, 72, 75, 78, 81, 89, 91, 93, 94, 97, 102, 107, 113, 114, 115, 121, 127, 132, 133, 136, 139, 140, 141, 142, 143,
        147, 148, 151, 154, 155, 159, 164, 165, 175, 177, 180, 190, 195, 199, 201, 209, 224, 227, 235, 252, 255,
    ])
    b, n = -0.24599233269691467 + (places + 0.5) * 0.0019748270278796554, np.ones(len(places))
    n[[8, 9, 39, 45, 53]] = 3, 2, 2, 2, 2
    s, c = np.cumsum(n * b), np.cumsum(n)
    scores = {}
    for i in range(len(b)):
        for j in range(i + 1, len(b) - 1):
            scores[i, j] = s[i] * s[i] / c[i] + (s[j] - s[i]) * (s[j] - s[i]) / (c[j] - c[i]) + (s[-1] - s[j]) * (s[-1] - s[j]) / (c[-1] - c[j])
    best = [k for k, x in scores.items() if x == max(scores.values())]
    assert len(best) == 2 and best_cuts(b, n, 3) == [b[best[0][0]], b[best[0][1]]]
    # without any rounding: {0}, {1}, {2, 3}, {4, 5} and five others are equal
    assert best_cuts(np.arange(6.0), np.ones(6), 4) == [0.0, 1.0, 3.0]
