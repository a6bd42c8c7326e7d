"""Kernels on small planes that have no relational form: codecs, components, morphology, hulls. Used behind Arrow functions."""

from __future__ import annotations

import zlib

import numpy as np


def pack(mask: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(mask.astype(bool)).tobytes(), 6)


def unpack(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool)


def shifted(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    out = np.zeros_like(mask)
    h, w = mask.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
    return out


def dilate(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)])


def erode(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    return ~dilate(np.pad(~mask, radius, constant_values=True), radius)[radius:-radius, radius:-radius]


def opened(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    return dilate(erode(mask, radius), radius)


def closed(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    return erode(dilate(mask, radius), radius)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected components, 0 outside, in the order of their first pixels; of a stack of planes, each by itself.

    Runs of pixels join those they touch in the line above; the smallest run of all that are joined gives the label.
    """
    mask = mask.astype(bool)
    h, w = mask.shape[-2:]
    labels = np.zeros((mask.size // w if w else 0, w + 1), np.int64)  # a line ends outside, so no run passes into the next
    lines = np.zeros(labels.shape, bool)
    lines[:, :w] = mask.reshape(-1, w)
    bounds = np.flatnonzero(np.diff(lines.ravel(), prepend=False))
    starts, ends = bounds[::2], bounds[1::2]
    line = starts // (w + 1)
    first = np.searchsorted(ends, starts - (w + 1))
    touched = np.where(line % h > 0, np.searchsorted(starts, ends - (w + 1), "right") - first, 0)
    below = np.repeat(np.arange(len(starts)), touched)
    above = np.arange(len(below)) + np.repeat(first - touched.cumsum() + touched, touched)
    root = np.arange(len(starts))
    while (root[below] != root[above]).any():
        low, high = np.minimum(root[below], root[above]), np.maximum(root[below], root[above])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    tops = np.flatnonzero(root == np.arange(len(root)))
    label = np.searchsorted(tops, root) - np.searchsorted(line[tops] // h, line // h) + 1
    labels[lines] = np.repeat(label, ends - starts)
    return labels[:, :w].reshape(mask.shape)


def component_sums(labels: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """By label, the outside first, the number of pixels or the sum of their weights; of a stack, a row for each plane."""
    stack = labels.reshape(-1, labels.shape[-2] * labels.shape[-1])
    width = int(stack.max(initial=0)) + 1
    at = stack + np.arange(len(stack))[:, None] * width
    found = np.bincount(at.ravel(), None if weights is None else weights.ravel(), len(stack) * width)
    return found.reshape(*labels.shape[:-2], width)


def core_and_strays(mask: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of the largest component, and the share of all others; of a stack, an array of each."""
    sizes = component_sums(components(mask) if labels is None else labels)[..., 1:]
    core, whole = sizes.max(-1, initial=0), sizes.sum(-1)
    return core, np.where(whole > 0, 1 - core / np.maximum(whole, 1), 0.0)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    ordered = sorted(map(tuple, points.tolist()))

    def half(line: list) -> list:
        out: list = []
        for p in line:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(ordered) + half(ordered[::-1])) if len(ordered) > 2 else np.array(ordered)


def chain_area(xs: np.ndarray, ys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Twice the area between the y axis and the lower convex chain of each row's held points, which are in the order of ``ys``."""
    n = len(xs)
    px, py, top = np.zeros(xs.shape, np.int64), np.zeros(xs.shape, np.int64), np.zeros(n, np.int64)
    for at, y in enumerate(ys):
        new = np.flatnonzero(held[:, at])
        x, left = xs[:, at], new[top[new] > 1]
        while len(left):
            t = top[left]
            bx, by, ax, ay = px[left, t - 1], py[left, t - 1], px[left, t - 2], py[left, t - 2]
            left = left[(bx - ax) * (y - by) >= (x[left] - bx) * (by - ay)]
            top[left] -= 1
            left = left[top[left] > 1]
        px[new, top[new]], py[new, top[new]] = x[new], y
        top[new] += 1
    used = np.arange(1, xs.shape[1]) < top[:, None]
    return (np.diff(py) * (px[:, 1:] + px[:, :-1]) * used).sum(1)


def concavity(mask: np.ndarray) -> np.ndarray:
    """Share of the hull's area, over pixel corners, that the mask leaves empty; of a stack, an array of shares.

    Only the outermost corners of a line can be corners of the hull.
    """
    h, w = mask.shape[-2:]
    stack = mask.reshape(-1, h, w).astype(bool)
    lines = stack.any(2)
    low = np.where(lines, stack.argmax(2), w)
    high = np.where(lines, w - stack[:, :, ::-1].argmax(2), 0)
    low = np.minimum(np.pad(low, ((0, 0), (1, 0)), constant_values=w), np.pad(low, ((0, 0), (0, 1)), constant_values=w))
    high = np.maximum(np.pad(high, ((0, 0), (1, 0))), np.pad(high, ((0, 0), (0, 1))))
    area = -(chain_area(np.concatenate([low, -high]), np.arange(h + 1), np.tile(high > low, (2, 1))).reshape(2, -1).sum(0)) / 2
    pixels = stack.sum((1, 2))
    return np.where(pixels > 0, 1 - pixels / np.where(pixels > 0, area, 1), 0.0).reshape(mask.shape[:-2])


def depth(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel to the nearest one outside the mask; the picture's border isn't outside. Columns first, then rows; of a stack, each plane by itself."""
    h, w = mask.shape[-2:]
    far = (h + w) ** 2
    column = np.where(mask, h + w, 0).astype(np.int32 if 2 * far < 1 << 31 else np.int64)
    for y in range(1, h):
        column[..., y, :] = np.minimum(column[..., y, :], column[..., y - 1, :] + 1)
    for y in range(h - 2, -1, -1):
        column[..., y, :] = np.minimum(column[..., y, :], column[..., y + 1, :] + 1)
    column = np.minimum(column, h + w) ** 2
    across = ((np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2).astype(column.dtype)
    deep = np.full_like(column, far)
    for x in range(w):
        np.minimum(deep, column[..., x, None] + across[x], out=deep)
    return deep


def seeds(votes: np.ndarray, persons: np.ndarray | None = None, near: np.ndarray | None = None, least: int = 1500, on_person: float = 0.5) -> list[tuple[int, int, int] | None]:
    """By plane of a stack, ``x, y, area`` of the deepest point of the largest component that lies on a person, or else near the mat; None if it is too small."""
    labels, nth = components(votes), np.arange(len(votes))
    sizes = component_sums(labels)

    def largest(fit: np.ndarray) -> np.ndarray:
        areas = np.where(fit, sizes, 0)
        areas[:, 0] = 0
        return areas.argmax(1)

    best = np.zeros(len(votes), int)
    if persons is not None:
        best = np.where(persons.any((1, 2)), largest(component_sums(labels, persons) >= on_person * sizes), 0)
    chosen = (best > 0) & (sizes[nth, best] >= least)
    best = np.where(chosen, best, largest(component_sums(labels, near) > 0 if near is not None else sizes > 0))
    areas = sizes[nth, best]
    region = labels == best[:, None, None]
    if persons is not None:
        held = region & persons.astype(bool)
        region = np.where((chosen & held.any((1, 2)))[:, None, None], held, region)
    y, x = np.unravel_index(depth(region).reshape(-1, votes.shape[1] * votes.shape[2]).argmax(1), votes.shape[1:])
    fits = (best > 0) & (areas >= least)
    return [found if fit else None for fit, found in zip(fits.tolist(), zip(x.tolist(), y.tolist(), areas.tolist(), strict=True), strict=True)]


def seed(votes: np.ndarray, persons: np.ndarray | None = None, near: np.ndarray | None = None, least: int = 1500, on_person: float = 0.5) -> tuple[int, int, int] | None:
    """The seed of one plane."""
    return seeds(votes[None], None if persons is None else persons[None], None if near is None else near[None], least, on_person)[0]


def box_sums(plane: np.ndarray, size: int) -> np.ndarray:
    """Sums over squares about each pixel; beyond the border the plane is mirrored without its edge."""
    r = size // 2
    padded = np.pad(plane.astype(np.int64), r, mode="reflect")
    run = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return run[size:, size:] - run[:-size, size:] - run[size:, :-size] + run[:-size, :-size]


def flat_share(grey: np.ndarray, limit: float = 12.0, size: int = 9) -> float:
    """Share of pixels with hardly any detail about them, by the variance within a square."""
    n, grey = size * size, grey.astype(np.int64)
    return float((n * box_sums(grey * grey, size) - box_sums(grey, size) ** 2 < limit * n * n).mean())


def gradient(plane: np.ndarray) -> np.ndarray:
    """Sum of the absolute Scharr derivatives; the border is mirrored."""
    p = np.pad(plane.astype(np.int64), 1, mode="reflect")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    gx = 3 * across[:-2] + 10 * across[1:-1] + 3 * across[2:]
    gy = 3 * down[:, :-2] + 10 * down[:, 1:-1] + 3 * down[:, 2:]
    return np.abs(gx) + np.abs(gy)


def filled_hull(mask: np.ndarray) -> np.ndarray:
    """All pixels whose centres lie in the hull of the mask's pixel centres, its border included."""
    ys, xs = np.nonzero(mask)
    if len(xs) < 3:
        return mask.copy()
    corners = hull(np.stack([xs, ys], 1))
    if len(corners) < 3:
        return mask.copy()
    yy, xx = np.indices(mask.shape)
    inside = np.ones(mask.shape, bool)
    for (x0, y0), (x1, y1) in zip(corners, np.roll(corners, -1, 0), strict=True):
        inside &= (x1 - x0) * (yy - y0) - (y1 - y0) * (xx - x0) >= 0
    return inside


def mat_area(near: np.ndarray, close: int = 7) -> np.ndarray:
    """The mat from pixels of its colour: gaps closed, the largest component, and its hull, so that who stands on it counts as on it."""
    labels = components(closed(near, close) if close else near)
    sizes = np.bincount(labels.ravel())[1:]
    return filled_hull(labels == sizes.argmax() + 1) if len(sizes) else np.zeros_like(near)


def recoloured(lab: np.ndarray, mask: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The mask's pixels brought to another mean and deviation by channel; all others stay."""
    out, px = lab.astype(float).copy(), lab[mask].astype(float)
    if len(px):
        own = px.std(0)
        out[mask] = (px - px.mean(0)) * np.divide(spread, own, out=np.ones_like(own), where=own > 0) + mean
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
