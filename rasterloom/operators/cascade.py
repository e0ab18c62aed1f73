"""A boosted cascade of local binary patterns over the windows of a picture at many sizes. The trained cascade is an input file (XML
with stages of stumps); none comes with this library. Kernels over one picture."""

from __future__ import annotations

from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np

from .scores import grouped_windows

#: What stage thresholds are lowered by, and windows of a first row in a stripe.
EASE, STRIPE = np.float32(1e-5), 32


@dataclass(frozen=True)
class Cascade:
    """Stages of stumps: each reads the pattern of a feature (x, y, w, h: the top left of 3 x 3 blocks), and adds one of two values by
    whether the pattern's bit is set in its subset (256 bits)."""

    width: int
    height: int
    rects: np.ndarray
    stages: list[tuple[float, list[tuple[int, np.ndarray, float, float]]]]


def read_cascade(text: str) -> Cascade:
    """A cascade from its XML; one of another kind, with deeper trees, or whose features leave the window is an error."""
    root = ElementTree.fromstring(text).find("cascade")
    if root is None or (root.findtext("stageType"), root.findtext("featureType")) != ("BOOST", "LBP"):
        raise ValueError("not a boosted cascade of local binary patterns")
    words = (int(root.findtext("featureParams/maxCatCount")) + 31) // 32
    rects = np.array([f.findtext("rect").split()[:4] for f in root.find("features")], np.int64).reshape(-1, 4)
    width, height = int(root.findtext("width")), int(root.findtext("height"))
    x, y, w, h = rects.T
    if ((x < 0) | (y < 0) | (w < 1) | (h < 1) | (x + 3 * w > width) | (y + 3 * h > height)).any():
        raise ValueError("a feature leaves the window")
    stages = []
    for stage in root.find("stages"):
        stumps = []
        for weak in stage.find("weakClassifiers"):
            nodes, leaves = [int(v) for v in weak.findtext("internalNodes").split()], [float(v) for v in weak.findtext("leafValues").split()]
            if len(nodes) != 3 + words or len(leaves) != 2 or not 0 <= nodes[2] < len(rects):
                raise ValueError("a classifier is no stump, or reads a feature that is not there")
            bits = np.unpackbits(np.array(nodes[3:], np.int64).astype("<u4").view(np.uint8), bitorder="little").astype(bool)
            stumps.append((nodes[2], bits, np.float32(leaves[0]), np.float32(leaves[1])))
        stages.append((np.float32(float(stage.findtext("stageThreshold"))) - EASE, stumps))
    return Cascade(width, height, rects, stages)


def patterns(sums: np.ndarray, rect: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The pattern of a feature in windows at (y, x), from a picture's integral: a bit for each outer block at least as bright as the
    middle one, clockwise from the top left, which is the highest."""
    fx, fy, w, h = rect.tolist()
    corner = [[sums[y + fy + i * h, x + fx + j * w] for j in range(4)] for i in range(4)]
    block = lambda i, j: corner[i][j] - corner[i][j + 1] - corner[i + 1][j] + corner[i + 1][j + 1]
    middle, code = block(1, 1), np.zeros(len(y), np.int64)
    for i, j in ((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)):
        code = code << 1 | (block(i, j) >= middle)
    return code


def passing(gray: np.ndarray, cascade: Cascade, step: int, rows: int) -> np.ndarray:
    """(y, x) of the windows that every stage passes, of `rows` rows a step apart; a window that the first stage rejects lets the next
    one in its row be skipped."""
    sums = np.pad(np.cumsum(np.cumsum(gray.astype(np.int64), axis=0), axis=1), ((1, 0), (1, 0)))
    columns = np.arange(0, max(0, sums.shape[1] - cascade.width), step)
    at = np.stack(np.meshgrid(np.arange(rows) * step, columns, indexing="ij"), axis=-1).reshape(-1, 2)
    for k, (least, stumps) in enumerate(cascade.stages):
        total = np.zeros(len(at))
        for feature, bits, yes, no in stumps:
            total += np.where(bits[patterns(sums, cascade.rects[feature], at[:, 0], at[:, 1])], yes, no)
        good = total >= least
        if k == 0:
            grid, seen, skip = good.reshape(rows, len(columns)), np.zeros((rows, len(columns)), bool), np.zeros(rows, bool)
            for c in range(len(columns)):
                seen[:, c] = ~skip
                skip = ~skip & ~grid[:, c]
            good = (grid & seen).ravel()
        at = at[good]
    return at


def searched_rows(positions: int, step: int, stripes: int) -> int:
    """Rows of windows that are searched, dealt in stripes of whole steps: where they come out even the last row is left out."""
    each = max(-(-(positions // step) // stripes), 1) * step if stripes else 0
    return len(range(0, min(stripes * each, positions), step))


def shrunk(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture at another size, read between its pixels' middles."""
    out = gray.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        m = out.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.minimum(np.floor(at).astype(int), max(m - 2, 0))
        part = (at - low).reshape([-1 if a == axis else 1 for a in range(2)])
        out = out.take(low, axis) * (1 - part) + out.take(np.minimum(low + 1, m - 1), axis) * part
    return np.rint(out).astype(np.uint8)


def detect(gray: np.ndarray, cascade: Cascade, scale_step: float = 1.1, neighbors: int = 3) -> list[tuple[tuple[int, int, int, int], int]]:
    """(box, windows) of what a cascade finds at every size from its own on: windows are a pixel apart on pictures shrunk at least
    twofold, else two, and grouped; boxes are cut to the picture."""
    h, w = gray.shape
    if 255 * gray.size >= 1 << 31:
        raise ValueError("the picture is too large")
    found, stripes, scale = [], None, 1.0
    while round(cascade.width * scale) <= w and round(cascade.height * scale) <= h:
        small = shrunk(gray, round(w / scale), round(h / scale))
        step = 1 if scale >= 2 else 2
        stripes = -(-max(small.shape[1] + 1 - cascade.width, 0) // STRIPE) if stripes is None else stripes
        at = passing(small, cascade, step, searched_rows(max(small.shape[0] + 1 - cascade.height, 0), step, stripes))
        found += [(round(x * scale), round(y * scale), round(cascade.width * scale), round(cascade.height * scale)) for y, x in at.tolist()]
        scale *= scale_step
    out = []
    for (x, y, bw, bh), n in grouped_windows(np.array(found).reshape(-1, 4), neighbors):
        x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + bw, w), min(y + bh, h)
        if x1 > x0 and y1 > y0:
            out.append(((x0, y0, x1 - x0, y1 - y0), n))
    return out
