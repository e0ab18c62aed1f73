"""Per-picture kernels in numpy: what is sequential within one picture. A task holds one picture at a time."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
_BESIDE = [(0, 1), (0, -1), (1, 0), (-1, 0)]


def shifted(grid: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """The grid's value at (y + dy, x + dx)."""
    out = np.full_like(grid, fill)
    h, w = grid.shape
    if abs(dy) >= h or abs(dx) >= w:
        return out
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = grid[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def components(labels: np.ndarray, corners: bool = True) -> np.ndarray:
    """Smallest flat position of the piece of equal labels that each pixel belongs to."""
    root = np.arange(labels.size).reshape(labels.shape)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if corners else [])
    links = []
    for dy, dx in steps:
        there, other = shifted(labels, dy, dx, -9), shifted(root, dy, dx, -1)
        hit = (there == labels) & (other >= 0)
        links.append((root[hit], other[hit]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    flat = root.ravel()
    while True:
        x, y = flat[a], flat[b]
        apart = x != y
        if not apart.any():
            return flat.reshape(labels.shape)
        a, b = a[apart], b[apart]
        np.minimum.at(flat, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := flat[flat], flat):
            flat[:] = up


def number_regions(labels: np.ndarray, colors: int) -> tuple[np.ndarray, np.ndarray]:
    """(region of each pixel or -1, colour of each region): 8-connected pieces in the order of their colours, then of the first
    block of 2 x 2 pixels they touch; labels outside 0 .. colors - 1 have no region."""
    piece = components(labels)
    h, w = labels.shape
    y, x = np.mgrid[:h, :w]
    block = (y // 2) * ((w + 1) // 2) + x // 2
    valid = (labels >= 0) & (labels < colors)
    names, at = np.unique(piece[valid], return_inverse=True)
    first = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(first, at, block[valid])
    color = labels.ravel()[names]
    order = np.lexsort((names, first, color))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    ids = np.full(labels.shape, -1)
    ids[valid] = rank[at]
    return ids, color[order]


def _compact(ids: np.ndarray, colors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used = np.unique(ids[ids >= 0])
    to = np.full(len(colors) + 1, -1)
    to[used] = np.arange(len(used))
    return to[ids], colors[used]


def merge_small(ids: np.ndarray, colors: np.ndarray, least: int, corners: bool = True, heavy: np.ndarray | None = None, sizes: np.ndarray | None = None, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Regions below `least` pixels join a neighbour, the smallest first and the lowest of equals; the neighbour is the one that
    owns most of the pixels around, the lowest of equals. One without a neighbour stays. A pixel counts as often as `heavy`
    says; `sizes` replaces the counted sizes. With `keep` regions keep their numbers."""
    h, w = ids.shape
    owner = ids.ravel().copy()
    order = np.argsort(owner, kind="stable")
    names, first = np.unique(owner[order], return_index=True)
    pixels = {int(r): p for r, p in zip(names, np.split(order, first[1:]), strict=True) if r >= 0}
    if sizes is not None:
        size = {r: int(sizes[r]) for r in pixels}
    elif heavy is None:
        size = {r: len(p) for r, p in pixels.items()}
    else:
        size = {r: int(heavy.ravel()[p].sum()) for r, p in pixels.items()}
    heap = [(n, r) for r, n in size.items() if n < least]
    heapq.heapify(heap)
    while heap:
        n, r = heapq.heappop(heap)
        if r not in pixels or size[r] != n:
            continue
        y, x = np.divmod(pixels[r], w)
        ring = []
        for dy, dx in _AROUND if corners else _BESIDE:
            inside = (y + dy >= 0) & (y + dy < h) & (x + dx >= 0) & (x + dx < w)
            ring.append(((y + dy) * w + x + dx)[inside])
        around = owner[np.unique(np.concatenate(ring))]
        around = around[(around >= 0) & (around != r)]
        if not len(around):
            continue
        found, counts = np.unique(around, return_counts=True)
        to = int(found[np.argmax(counts)])
        owner[pixels[r]] = to
        pixels[to] = np.concatenate([pixels[to], pixels.pop(r)])
        size[to] += size.pop(r)
        if size[to] < least:
            heapq.heappush(heap, (size[to], to))
    return (owner.reshape(h, w), colors) if keep else _compact(owner.reshape(h, w), colors)


def merge_same_color(ids: np.ndarray, colors: np.ndarray, corners: bool = True, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Touching regions of one colour become one, with the lowest number; with `keep` regions keep their numbers."""
    label = np.arange(len(colors))
    for dy, dx in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if corners else []):
        other = shifted(ids, dy, dx, -1)
        hit = (ids >= 0) & (other >= 0) & (ids != other)
        pairs = np.unique(np.stack([ids[hit], other[hit]], axis=1), axis=0)
        for a, b in pairs[colors[pairs[:, 0]] == colors[pairs[:, 1]]].tolist():
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            label[max(a, b)] = min(a, b)
    while not np.array_equal(up := label[label], label):
        label = up
    joined = np.where(ids >= 0, label[ids], -1)
    return (joined, colors) if keep else _compact(joined, colors)


def build_regions(labels: np.ndarray, colors: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Regions of a label map: pieces, then small ones join neighbours, then neighbours of one colour join."""
    ids, color = number_regions(labels, colors)
    ids, color = merge_small(ids, color, least)
    return merge_same_color(ids, color)


def squared_distance(inside: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel to the nearest pixel that is not inside; what lies off the picture is not inside."""
    padded = np.pad(inside, 1)
    h, w = padded.shape
    far = float(h * h + w * w)
    across = np.where(padded, far, 0.0)
    run = np.full(h, far)
    for columns in (range(w), range(w - 1, -1, -1)):  # distance along the row
        run[:] = far
        for x in columns:
            run = np.where(padded[:, x], run + 1, 0)
            across[:, x] = np.minimum(across[:, x], run)
    across = across**2
    out = across.copy()
    for dy in range(1, h):
        if dy * dy >= out.max():
            break
        out[dy:] = np.minimum(out[dy:], across[:-dy] + dy * dy)
        out[:-dy] = np.minimum(out[:-dy], across[dy:] + dy * dy)
    return out[1:-1, 1:-1]


def region_boxes(ids: np.ndarray) -> list[tuple[int, slice, slice]]:
    """(region, rows, columns) of the box of each region, from one pass over the picture."""
    y, x = np.nonzero(ids >= 0)
    names, at = np.unique(ids[y, x], return_inverse=True)
    low, high = np.full((len(names), 2), max(ids.shape)), np.full((len(names), 2), -1)
    for k, v in enumerate((y, x)):
        np.minimum.at(low[:, k], at, v)
        np.maximum.at(high[:, k], at, v)
    return [(int(r), slice(a, c + 1), slice(b, d + 1)) for r, (a, b), (c, d) in zip(names, low.tolist(), high.tolist(), strict=True)]


def middles(ids: np.ndarray, printed: np.ndarray | None = None) -> list[tuple[int, int, int, float, int]]:
    """(region, x, y, radius, area): the pixel of each region that is farthest from its edge, the first in reading order; printed
    pixels are edge too."""
    out = []
    for r, rows, columns in region_boxes(ids):
        own = ids[rows, columns] == r
        free = own if printed is None or not (own & ~printed[rows, columns]).any() else own & ~printed[rows, columns]
        room = squared_distance(free)
        at = np.unravel_index(np.argmax(room), room.shape)
        out.append((r, int(at[1]) + columns.start, int(at[0]) + rows.start, float(np.sqrt(room[at])), int(own.sum())))
    return out


def png(bgr: np.ndarray) -> bytes:
    """A picture (height x width x 3, blue first) as a PNG file."""
    h, w, _ = bgr.shape
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = bgr[:, :, ::-1].reshape(h, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
