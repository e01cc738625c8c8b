"""Array kernels on one plane or volume (numpy alone, no Spark)."""

from __future__ import annotations

import itertools
import math

import numpy as np


def offsets(radius: int, dims: int, shape: str = "ball") -> list[tuple[int, ...]]:
    """Offsets of a footprint: Euclid (ball), Chebyshev (box) or Manhattan (diamond) distance up to the radius."""
    if radius < 1:
        raise ValueError("radius is at least 1")
    size = {"ball": lambda o: sum(v * v for v in o) <= radius * radius, "box": lambda o: True, "diamond": lambda o: sum(map(abs, o)) <= radius}
    if shape not in size:
        raise ValueError(f"shape is ball, box or diamond, not {shape!r}")
    return [o for o in itertools.product(range(-radius, radius + 1), repeat=dims) if size[shape](o)]


def _shifted(padded: np.ndarray, offset: tuple[int, ...], radius: int, shape: tuple[int, ...]) -> np.ndarray:
    return padded[tuple(slice(radius + o, radius + o + n) for o, n in zip(offset, shape, strict=True))]


def _along(a: np.ndarray, taps: np.ndarray, axis: int, mode: str) -> np.ndarray:
    """Correlation with centred taps along one axis."""
    r = len(taps) // 2
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, len(taps) - 1 - r)
    padded, n = np.pad(a, pad, mode=mode), a.shape[axis]
    out = np.zeros(a.shape)
    for k, t in enumerate(taps):
        if t:
            out += t * np.take(padded, range(k, k + n), axis)
    return out


def gaussian_taps(sigma: float) -> np.ndarray:
    r = math.ceil(4 * sigma)
    u = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return u / u.sum()


def gaussian(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    a = a.astype(float)
    for axis in range(a.ndim):
        a = _along(a, gaussian_taps(sigma), axis, "edge")
    return a


def median(a: np.ndarray, radius: int = 1, shape: str = "ball") -> np.ndarray:
    padded = np.pad(a, radius, mode="edge")
    return np.median(np.stack([_shifted(padded, o, radius, a.shape) for o in offsets(radius, a.ndim, shape)]), axis=0)


def box_mean(a: np.ndarray, radius: int = 1, dims: int | None = None) -> np.ndarray:
    """With ``dims`` of a stack of images along the axes before the last ``dims``."""
    a = a.astype(float)
    for axis in range(a.ndim - (dims or a.ndim), a.ndim):
        a = _along(a, np.full(2 * radius + 1, 1 / (2 * radius + 1)), axis, "symmetric")
    return a


def kuwahara(a: np.ndarray, radius: int = 2) -> np.ndarray:
    """Mean of the corner window of least variance; the first of equals."""
    if radius < 0:
        raise ValueError("radius is at least 0")
    if radius == 0:
        return a.astype(float)
    # every window of radius + 1 along each axis; a pixel's corner windows begin radius before it or at it
    inner = tuple(range(-a.ndim, 0))
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(a.astype(float), radius, mode="reflect"), (radius + 1,) * a.ndim)
    means, spreads = windows.mean(axis=inner), windows.var(axis=inner)
    corners = [tuple(slice(b, b + s) for b, s in zip(begin, a.shape, strict=True)) for begin in itertools.product((0, radius), repeat=a.ndim)]
    # to nine digits, as windows of one content in another place are equal
    calm = np.stack([np.round(spreads[c], 9) for c in corners]).argmin(axis=0)
    return np.take_along_axis(np.stack([means[c] for c in corners]), calm[None], 0)[0]


def bilateral(a: np.ndarray, sigma_color: float = 0.1, sigma_spatial: float = 1.0, radius: int | None = None) -> np.ndarray:
    """On a plane scaled to [0, 1]."""
    r = radius if radius is not None else max(1, math.ceil(3 * sigma_spatial))
    padded, total, weight = np.pad(a.astype(float), r, mode="edge"), np.zeros(a.shape), np.zeros(a.shape)
    for o in itertools.product(range(-r, r + 1), repeat=a.ndim):
        there = _shifted(padded, o, r, a.shape)
        w = np.exp(-((there - a) ** 2) / (2 * sigma_color**2) - sum(v * v for v in o) / (2 * sigma_spatial**2))
        total += w * there
        weight += w
    return total / weight


def total_variation(a: np.ndarray, weight: float = 0.1, max_num_iter: int = 200, eps: float = 2e-4) -> np.ndarray:
    """Dual gradient projection; stops when the energy hardly changes."""
    a = a.astype(float)
    p = np.zeros((a.ndim, *a.shape))
    out, before, first = a, 0.0, 0.0
    for k in range(max_num_iter):
        if k:
            div = -p.sum(axis=0)
            for axis in range(a.ndim):
                low = [slice(None)] * a.ndim
                high = low.copy()
                low[axis], high[axis] = slice(1, None), slice(0, -1)
                div[tuple(low)] += p[axis][tuple(high)]
            out = a + div
            energy = (div**2).sum()
        else:
            energy = 0.0
        slope = np.zeros_like(p)
        for axis in range(a.ndim):
            at = [slice(None)] * a.ndim
            at[axis] = slice(0, -1)
            slope[axis][tuple(at)] = np.diff(out, axis=axis)
        norm = np.sqrt((slope**2).sum(axis=0))
        energy = (energy + weight * norm.sum()) / a.size
        step = 1 / (2 * a.ndim)
        p = (p - step * slope) / (1 + norm * step / weight)
        if k == 0:
            first = before = energy
        elif abs(before - energy) < eps * first:
            break
        else:
            before = energy
    return out


#: Low-pass filters of the wavelets (fixed values): Haar, and the four-tap filter of Daubechies.
_R3 = math.sqrt(3)
WAVELETS = {"db1": [2**-0.5, 2**-0.5], "db2": [(1 + _R3) / (4 * 2**0.5), (3 + _R3) / (4 * 2**0.5), (3 - _R3) / (4 * 2**0.5), (1 - _R3) / (4 * 2**0.5)]}
WAVELETS |= {"haar": WAVELETS["db1"], "sym2": WAVELETS["db2"]}


def _dwt(a: np.ndarray, low: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Periodic transform along an axis of even length."""
    high = low[::-1] * (-1) ** np.arange(len(low))
    n = a.shape[axis]
    at = (np.arange(0, n, 2)[:, None] + np.arange(len(low))) % n
    parts = np.take(a, at, axis)
    return tuple(np.tensordot(parts, f, axes=([axis + 1], [0])) for f in (low, high))


def _idwt(c: np.ndarray, d: np.ndarray, low: np.ndarray, axis: int) -> np.ndarray:
    high = low[::-1] * (-1) ** np.arange(len(low))
    c, d = np.moveaxis(c, axis, -1), np.moveaxis(d, axis, -1)
    n = 2 * c.shape[-1]
    out = np.zeros((*c.shape[:-1], n))
    for k in range(len(low)):
        at = (np.arange(0, n, 2) + k) % n
        out[..., at] += low[k] * c + high[k] * d
    return np.moveaxis(out, -1, axis)


def wavelet(a: np.ndarray, method: str = "BayesShrink", mode: str = "soft", wavelet_name: str = "db1", sigma: float | None = None) -> np.ndarray:
    """Shrinkage of the detail coefficients; the noise is estimated from the finest diagonal details."""
    low = np.array(WAVELETS[wavelet_name])
    a = a.astype(float)
    levels = max(1, min(int(math.log2(max(1, s / (len(low) - 1)))) for s in a.shape) - 3) if min(a.shape) > 1 else 0
    unit = 2**levels
    pad = [(0, -s % unit) for s in a.shape]
    approx, details = np.pad(a, pad, mode="symmetric"), []
    for _ in range(levels):
        bands = {"": approx}
        for axis in range(a.ndim):
            bands = {k + t: v for k, x in bands.items() for t, v in zip("ad", _dwt(x, low, axis), strict=True)}
        approx = bands.pop("a" * a.ndim)
        details.append(bands)
    if not details:
        return a
    noise = sigma if sigma is not None else np.median(np.abs(details[0]["d" * a.ndim])) / MEDIAN_OF_NORMAL
    universal = noise * math.sqrt(2 * math.log(a.size))
    for bands in details:
        for k, v in bands.items():
            t = universal
            if method == "BayesShrink":
                t = noise**2 / math.sqrt(max((v * v).mean() - noise**2, np.finfo(float).eps))
            elif method != "VisuShrink":
                raise ValueError(f"unknown method {method!r}")
            bands[k] = np.sign(v) * np.maximum(np.abs(v) - t, 0) if mode == "soft" else np.where(np.abs(v) >= t, v, 0)
    for bands in reversed(details):
        bands["a" * a.ndim] = approx
        for axis in reversed(range(a.ndim)):
            bands = {k: _idwt(bands[k + "a"], bands[k + "d"], low, axis) for k in {x[:-1] for x in bands}}
        approx = bands[""]
    return approx[tuple(slice(0, s) for s in a.shape)]


def non_local_means(
    a: np.ndarray, patch_size: int = 7, patch_distance: int = 11, h: float = 0.1, sigma: float | np.ndarray = 0.0, fast_mode: bool = True, dims: int | None = None
) -> np.ndarray:
    """For each shift once: squared differences, their mean over the patch, and the weight.

    In fast mode a patch's pixels weigh alike; else they weigh by a Gaussian of a quarter of the patch's reach.
    With ``dims`` of a stack of images of that many axes along a first axis, each with its own ``sigma``.
    """
    a, r, dims = a.astype(float), patch_size // 2, dims or a.ndim
    alone = a.ndim - dims
    sigma = np.asarray(sigma, float).reshape(-1, *(1,) * dims) if alone else sigma
    reach = patch_distance
    soft = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * max((patch_size - 1) / 4, 1e-9) ** 2))
    soft /= soft.sum()

    def over_patch(v: np.ndarray) -> np.ndarray:
        if fast_mode:
            return box_mean(v, r, dims)
        for axis in range(alone, v.ndim):
            v = _along(v, soft, axis, "symmetric")
        return v

    padded, total, weight = np.pad(a, [(0, 0)] * alone + [(reach, reach)] * dims, mode="symmetric"), np.zeros(a.shape), np.zeros(a.shape)
    for o in itertools.product(range(-reach, reach + 1), repeat=dims):
        there = padded[(..., *(slice(reach + v, reach + v + n) for v, n in zip(o, a.shape[alone:], strict=True)))]
        w = np.exp(-np.maximum(over_patch((there - a) ** 2) - 2 * sigma * sigma, 0) / (h * h))
        total += w * there
        weight += w
    return total / weight


#: Of normal noise, the median of the absolute values over the deviation (fixed value).
MEDIAN_OF_NORMAL = 0.6744897501960817


def diagonal_details(block: np.ndarray, begin: tuple[int, ...], inside: tuple[slice, ...]) -> np.ndarray:
    """Absolute finest details along all axes at once of the four-tap wavelet, of the 2 x 2 cells that begin inside.

    ``begin``: where the block lies in the whole, as cells begin at even places of the whole; at its far end the whole goes on mirrored.
    """
    low = np.array(WAVELETS["db2"])
    high = low[::-1] * (-1) ** np.arange(4)
    out = np.pad(block.astype(float), [(0, 3)] * block.ndim, mode="symmetric")
    for axis, (b, s) in enumerate(zip(begin, inside, strict=True)):
        at = np.arange(s.start + (b + s.start) % 2, s.stop, 2)
        out = sum(t * np.take(out, at + k, axis) for k, t in enumerate(high))
    return np.abs(out).ravel()


def butterworth(a: np.ndarray, cutoff: float = 0.05, order: float = 2, high_pass: bool = False) -> np.ndarray:
    """Over frequencies as shares of the sampling rate."""
    q = sum((np.fft.fftfreq(n).reshape([-1 if i == k else 1 for i in range(a.ndim)]) / cutoff) ** 2 for k, n in enumerate(a.shape))
    w = 1 / (1 + q**order)
    return np.fft.ifftn(np.fft.fftn(a.astype(float)) * ((1 - w) if high_pass else w)).real


#: Smoothing taps across a gradient, and the five-tap pair of Farid and Simoncelli (fixed values).
SMOOTH = {"sobel": [1 / 4, 2 / 4, 1 / 4], "scharr": [3 / 16, 10 / 16, 3 / 16], "prewitt": [1 / 3, 1 / 3, 1 / 3]}
FARID = ([0.0376593171958126, 0.249153396177344, 0.426374573253687, 0.249153396177344, 0.0376593171958126], [0.109603762960254, 0.276690988455557, 0.0, -0.276690988455557, -0.109603762960254])


def gradient(a: np.ndarray, kind: str = "sobel") -> np.ndarray:
    """Root mean square over the axes of smoothed central differences."""
    a = a.astype(float)
    smooth, slope = (np.array(FARID[0]), -np.array(FARID[1])) if kind == "farid" else (np.array(SMOOTH[kind]), np.array([-0.5, 0, 0.5]))
    total = np.zeros(a.shape)
    for axis in range(a.ndim):
        g = _along(a, slope, axis, "symmetric")
        for other in range(a.ndim):
            if other != axis:
                g = _along(g, smooth, other, "symmetric")
        total += g * g
    return np.sqrt(total / a.ndim)


def roberts(a: np.ndarray) -> np.ndarray:
    """Diagonal differences with the pixel above and to the left."""
    p = np.pad(a.astype(float), ((1, 0), (1, 0)), mode="symmetric")
    here, up, left, corner = p[1:, 1:], p[:-1, 1:], p[1:, :-1], p[:-1, :-1]
    return np.sqrt(((here - corner) ** 2 + (up - left) ** 2) / 2)


def laplace(a: np.ndarray, ksize: int = 3) -> np.ndarray:
    """Centre times the other taps, less their sum: positive on bright spots."""
    a, r = a.astype(float), ksize // 2
    total = np.zeros(a.shape)
    for axis in range(a.ndim):
        taps = np.zeros(2 * r + 1)
        taps[[0, -1]], taps[r] = -1, 2
        total += _along(a, taps, axis, "symmetric")
    return total


def difference_of_gaussians(a: np.ndarray, low_sigma: float = 1.0, high_sigma: float = 4.0) -> np.ndarray:
    if high_sigma <= low_sigma:
        raise ValueError("high_sigma is more than low_sigma")
    return gaussian(a, low_sigma) - gaussian(a, high_sigma)


def unsharp(a: np.ndarray, radius: float = 1.0, amount: float = 1.0) -> np.ndarray:
    return a + amount * (a - gaussian(a, radius))


def hessian_values(a: np.ndarray, sigma: float) -> np.ndarray:
    """Eigenvalues (last axis, ascending by size) of the scaled second derivatives of the smoothed image."""
    g = gaussian(a, sigma)
    first = [np.gradient(g, axis=i) if g.shape[i] > 1 else np.zeros_like(g) for i in range(a.ndim)]
    h = np.zeros((*a.shape, a.ndim, a.ndim))
    for i in range(a.ndim):
        for k in range(i, a.ndim):
            h[..., i, k] = h[..., k, i] = sigma**2 * (np.gradient(first[i], axis=k) if g.shape[k] > 1 else 0)
    values = np.linalg.eigvalsh(h)
    return np.take_along_axis(values, np.abs(values).argsort(axis=-1), -1)


def scales(sigma_min: float = 1, sigma_max: float = 10, step: float = 2) -> np.ndarray:
    if sigma_min <= 0 or sigma_max < sigma_min or step <= 0:
        raise ValueError(f"bad scales: {sigma_min} to {sigma_max} by {step}")
    # the end counts, also where the steps don't meet it
    return np.arange(sigma_min, sigma_max + step / 2, step)


def structure(a: np.ndarray, sigmas: np.ndarray, black_ridges: bool = True) -> list[np.ndarray]:
    """Structure, then ridge response, of each scale; the ridge filters divide by their largest."""
    values = [(1 if black_ridges else -1) * hessian_values(a, s) for s in sigmas]
    return [np.sqrt((v**2).sum(axis=-1)) for v in values] + [_neurite(v) for v in values]


def _neurite(values: np.ndarray) -> np.ndarray:
    """Largest of the modified eigenvalues, each with a share of the others, kept where it is positive."""
    n = values.shape[-1]
    mixed = values + (1 / (n + 1)) * -(values.sum(axis=-1, keepdims=True) - values)
    lead = np.take_along_axis(mixed, np.abs(mixed).argmax(axis=-1)[..., None], -1)[..., 0]
    return np.maximum(lead, 0)


def ridges(a: np.ndarray, kind: str, sigmas: np.ndarray, norms: tuple[list[float], list[float]], black_ridges: bool = True, alpha: float = 0.5, beta: float = 0.5) -> np.ndarray:
    """Vesselness (frangi), tubeness (sato) or neuriteness (meijering), the largest over the scales."""
    best = np.zeros(a.shape)
    for k, sigma in enumerate(sigmas):
        v = (1 if black_ridges else -1) * hessian_values(a, sigma)
        if kind == "sato":
            upper = np.maximum(v[..., 1:], 0)
            out = np.abs(np.prod(upper, axis=-1)) ** (1 / upper.shape[-1])
        elif kind == "meijering":
            out = _neurite(v) / (norms[1][k] or 1.0)
        elif kind == "frangi":
            c = norms[0][k] / 2 or 1.0
            small, large = np.abs(v[..., 0]), np.maximum(np.abs(v[..., -1]), 1e-10)
            blob = small / (large if a.ndim == 2 else np.sqrt(np.maximum(np.abs(v[..., 1] * v[..., 2]), 1e-20)))
            plate = 1.0 if a.ndim == 2 else 1 - np.exp(-((np.abs(v[..., 1]) / large) ** 2) / (2 * alpha**2))
            size = np.sqrt((v**2).sum(axis=-1))
            out = plate * np.exp(-(blob**2) / (2 * beta**2)) * (1 - np.exp(-(size**2) / (2 * c * c)))
            out = np.where((v[..., 1:] > 0).all(axis=-1), out, 0)
        else:
            raise ValueError(f"unknown filter {kind!r}")
        best = np.maximum(best, out)
    return best


def extreme(a: np.ndarray, largest: bool, radius: int = 1, shape: str = "ball") -> np.ndarray:
    """Least or largest value under the footprint; what is outside doesn't count."""
    pick = np.maximum if largest else np.minimum
    kind = np.iinfo(a.dtype) if a.dtype.kind in "iu" else np.finfo(a.dtype)
    outside = kind.min if largest else kind.max
    if shape == "box":  # separable
        offsets(radius, 1, shape)
        for axis in range(a.ndim):
            pad = [(0, 0)] * a.ndim
            pad[axis] = (radius, radius)
            padded, n = np.pad(a, pad, constant_values=outside), a.shape[axis]
            a = np.take(padded, range(n), axis)
            for k in range(1, 2 * radius + 1):
                a = pick(a, np.take(padded, range(k, k + n), axis))
        return a
    padded, out = np.pad(a, radius, constant_values=outside), None
    for o in offsets(radius, a.ndim, shape):
        there = _shifted(padded, o, radius, a.shape)
        out = there.copy() if out is None else pick(out, there)
    return out


def morphology(a: np.ndarray, kind: str, radius: int = 1, shape: str = "ball") -> np.ndarray:
    low = lambda x: extreme(x, False, radius, shape)
    high = lambda x: extreme(x, True, radius, shape)
    steps = {
        "erosion": lambda: low(a), "dilation": lambda: high(a), "opening": lambda: high(low(a)), "closing": lambda: low(high(a)),
        "white_tophat": lambda: a - high(low(a)), "black_tophat": lambda: low(high(a)) - a,
    }
    if kind not in steps:
        raise ValueError(f"unknown operation {kind!r}")
    return steps[kind]()


def pad_centred(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return np.pad(a, [(-(-(n - s) // 2), (n - s) // 2) for s, n in zip(a.shape, shape, strict=True)])


def crop_centred(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return a[tuple(slice(-(-(s - n) // 2), -(-(s - n) // 2) + n) for s, n in zip(a.shape, shape, strict=True))]


#: Floor of divisors and estimates in the deconvolution (fixed value).
DELTA = 1e-6


class Blur:
    """Circular convolution of a stack of images with one centred kernel, or one each, and its transpose, by real FFTs over the image axes."""

    def __init__(self, kernel: np.ndarray, dims: int | None = None):
        dims = dims or kernel.ndim
        self.shape, self.axes = kernel.shape[-dims:], tuple(range(-dims, 0))
        self.transfer = np.fft.rfftn(np.fft.ifftshift(kernel, axes=self.axes), axes=self.axes)

    def __call__(self, stack: np.ndarray, transposed: bool = False) -> np.ndarray:
        transfer = self.transfer.conj() if transposed else self.transfer
        return np.fft.irfftn(np.fft.rfftn(stack, axes=self.axes) * transfer, s=self.shape, axes=self.axes)


def frame_of(extent: tuple[int, ...], reach: tuple[int, ...], noncirc: bool) -> tuple[int, ...]:
    """Extents in which images of ``extent`` are deconvolved by a PSF of extents ``reach``."""
    from pixelweave.operators.psf import next_smooth

    return tuple(next_smooth(n + 2 * (p // 2)) if noncirc else max(n, p) for n, p in zip(extent, reach, strict=True))


def richardson_lucy(
    image: np.ndarray, psf: np.ndarray, num_iters: int = 10, noncirc: bool = False, mask: np.ndarray | None = None, start: float | None = None, blur: Blur | None = None, dims: int | None = None
) -> np.ndarray:
    """Iterative deconvolution of an image, or of a stack of them along a first axis, by a PSF of the image's dimensions.

    With ``dims`` the PSF may be a stack too, one for each image. Masked pixels count as unseen and
    come back unchanged. Divisors and estimates stay at ``DELTA`` or above. The first guess is flat, at
    the mean of the padded image or at ``start``. ``blur``: one made before for this PSF and frame.
    """
    dims = dims or psf.ndim
    stack = image.astype(float).reshape(-1, *image.shape[-dims:])
    seen = np.ones(stack.shape) if mask is None else np.broadcast_to(mask.astype(float), image.shape).reshape(stack.shape)
    extent, reach = stack.shape[1:], psf.shape[-dims:]
    size = frame_of(extent, reach, noncirc)
    blur, frame = blur or Blur(pad_centred(psf.astype(float), (*psf.shape[:-dims], *size)), dims), (len(stack), *size)
    observed, share = pad_centred(stack * seen, frame), blur(pad_centred(seen, frame), transposed=True)
    gain = 1.0 / np.where(share < DELTA, 1.0, share)

    def positive(x: np.ndarray, least: float) -> np.ndarray:
        return np.where(x < least, DELTA, x)

    first = observed.mean(axis=blur.axes, keepdims=True) if start is None else np.full((1,) * observed.ndim, start)
    guess = np.broadcast_to(first, frame)
    for _ in range(num_iters):
        excess = observed / positive(blur(guess), DELTA)
        guess = positive(guess * gain * positive(blur(excess, transposed=True), 0.0), 0.0)
    out = crop_centred(guess, stack.shape)
    return (out if mask is None else np.where(seen > 0, out * seen + stack * (1 - seen), stack)).reshape(image.shape)


def fade(low: int, high: int, ramp: int, whole: int) -> np.ndarray:
    """Weights of positions ``low`` - ramp to ``high`` + ramp (cut at 0 and ``whole``) of a block from ``low`` to ``high``: its neighbours' and its own add up to 1.

    They rise and fall over ``ramp`` pixels on both sides of a border with a neighbour; true borders have none.
    """
    x = np.arange(max(0, low - ramp), min(whole, high + ramp)) + 0.5
    w = np.ones(len(x))
    if ramp and low > 0:
        w = np.minimum(w, np.clip((x - (low - ramp)) / (2 * ramp), 0, 1))
    if ramp and high < whole:
        w = np.minimum(w, np.clip((high + ramp - x) / (2 * ramp), 0, 1))
    return w


def local_otsu(level: np.ndarray, radius: int) -> np.ndarray:
    """Pixels above the Otsu cut of the 8-bit levels in a disk around them, cut at the borders.

    One histogram a row moves along the columns: the disk's right rim comes in and its left
    rim goes, so memory is 256 levels a row whatever the radius, and time grows with it, not with its square.
    """
    h, w = level.shape
    half = [math.isqrt(radius * radius - dy * dy) for dy in range(-radius, radius + 1)]
    # level 256 is what lies outside
    padded = np.full((h + 2 * radius, w + 2 * radius + 1), 256, np.int64)
    padded[radius : radius + h, radius + 1 : radius + 1 + w] = level
    hist, rows, above = np.zeros((257, h), np.int32), np.arange(h), np.zeros((h, w), bool)
    levels = np.arange(256)[:, None]
    for x in range(-radius, w):
        for dy, reach in enumerate(half):
            strip = padded[dy : dy + h]
            if 0 <= x + reach < w:
                hist[strip[:, x + reach + radius + 1], rows] += 1
            if 0 <= x - 1 - reach < w:
                hist[strip[:, x - reach + radius], rows] -= 1
        if x < 0:
            continue
        n, s = np.cumsum(hist[:256], axis=0, dtype=np.int64), np.cumsum(hist[:256] * levels, axis=0)
        rest = (n[-1] - n) * n
        score = np.where(rest > 0, (s[-1] * n - n[-1] * s).astype(float) ** 2 / np.maximum(rest, 1), -1.0)
        cut = score.argmax(axis=0)
        one = score[cut, rows] < 0  # a single level in the disk
        cut[one] = (n == n[-1]).argmax(axis=0)[one]
        above[:, x] = level[:, x] > cut
    return above
