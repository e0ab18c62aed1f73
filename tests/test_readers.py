import struct

import numpy as np
import pytest

from rasterloom.operators import cascade as C
from rasterloom.sources import truetype

CASCADE = """<opencv_storage><cascade><stageType>BOOST</stageType><featureType>LBP</featureType><height>6</height><width>6</width>
<featureParams><maxCatCount>256</maxCatCount></featureParams><stages>
<_><stageThreshold>{0}</stageThreshold><weakClassifiers><_><internalNodes>0 -1 0 {1}</internalNodes><leafValues>-1.0 1.0</leafValues></_>
<_><internalNodes>0 -1 1 {2}</internalNodes><leafValues>0.5 -0.5</leafValues></_></weakClassifiers></_>
<_><stageThreshold>0.1</stageThreshold><weakClassifiers><_><internalNodes>0 -1 0 {2}</internalNodes><leafValues>1.0 -1.0</leafValues></_></weakClassifiers></_></stages>
<features><_><rect>0 0 2 2</rect></_><_><rect>1 2 1 1</rect></_></features></cascade></opencv_storage>"""


def words(seed):
    return " ".join(str(v) for v in np.random.default_rng(seed).integers(-(1 << 31), 1 << 31, 8))


def plain_hits(gray, cascade, step, rows):
    out = []
    for r in range(rows):
        x = 0
        while x < gray.shape[1] + 1 - cascade.width:
            ok, first = True, False
            for k, (least, stumps) in enumerate(cascade.stages):
                total = 0.0
                for feature, bits, yes, no in stumps:
                    fx, fy, w, h = cascade.rects[feature]
                    sums = [[gray[r * step + fy + i * h : r * step + fy + (i + 1) * h, x + fx + j * w : x + fx + (j + 1) * w].astype(int).sum() for j in range(3)] for i in range(3)]
                    ring = [sums[i][j] >= sums[1][1] for i, j in ((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0))]
                    total += yes if bits[int("".join("01"[int(v)] for v in ring), 2)] else no
                if total < least:
                    ok, first = False, k == 0
                    break
            if ok:
                out.append((r * step, x))
            x += step * (2 if first else 1)
    return out


@pytest.mark.parametrize("step", [1, 2])
def test_a_cascade_passes_what_plain_loops_pass(step):
    cascade = C.read_cascade(CASCADE.format(0.4, words(1), words(2)))
    gray = np.random.default_rng(3).integers(0, 256, (24, 31)).astype(np.uint8)
    rows = C.searched_rows(19, step, 1)
    want = plain_hits(gray, cascade, step, rows)
    assert sorted(map(tuple, C.passing(gray, cascade, step, rows).tolist())) == sorted(want) and want
    found = C.detect(np.kron(gray, np.ones((3, 3), np.uint8)), cascade, 1.2, 2)
    assert all(0 <= x and 0 <= y and x + w <= 93 and y + h <= 72 and n > 2 for (x, y, w, h), n in found)
    assert C.detect(gray[:5, :5], cascade) == []


def test_other_cascades_are_errors():
    for bad in (CASCADE.format(0, words(1), words(2)).replace("LBP", "HAAR"), CASCADE.format(0, words(1), "1 2"), CASCADE.format(0, words(1), words(2)).replace("1 2 1 1", "1 2 2 1")):
        with pytest.raises(ValueError, match="cascade|stump|window"):
            C.read_cascade(bad)


def test_rows_that_are_searched():
    assert [C.searched_rows(p, s, n) for p, s, n in ((10, 1, 1), (10, 2, 1), (11, 2, 1), (11, 2, 3), (0, 1, 1))] == [10, 5, 5, 6, 0]
    flat = np.full((9, 13), 77, np.uint8)
    assert (C.shrunk(flat, 5, 4) == 77).all() and C.shrunk(np.array([[0, 100]], np.uint8), 4, 1).tolist() == [[0, 25, 75, 100]]


def font(extra=b""):
    ends, starts, deltas = (0x39, 0x41, 0xFFFF), (0x30, 0x41, 0xFFFF), (-0x30 + 1, 0, 1)
    body = struct.pack(">HHHHHHH", 4, 0, 0, 6, 0, 0, 0) + struct.pack(">3H", *ends) + b"\0\0" + struct.pack(">3H", *starts) + struct.pack(">3h", *deltas) + struct.pack(">3H", 0, 4, 0) + struct.pack(">H", 12)
    parts = {
        b"head": b"\0" * 18 + struct.pack(">H", 1000) + b"\0" * 34, b"hhea": b"\0" * 4 + struct.pack(">hh", 800, -200) + b"\0" * 26 + struct.pack(">H", 3), b"maxp": struct.pack(">IH", 0x10000, 13),
        b"hmtx": struct.pack(">HhHhHh", 500, 0, 600, 0, 550, 0) + b"\0" * 20, b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + body,
    }
    out, at = struct.pack(">IHHHH", 0x10000, len(parts), 0, 0, 0), 12 + 16 * len(parts)
    for tag, data in parts.items():
        out += struct.pack(">4sIII", tag, 0, at, len(data))
        at += len(data)
    return out + b"".join(parts.values()) + extra


def test_a_font_says_how_wide_numbers_are():
    got = truetype.read_font(font())
    assert (got.units, got.ascent, got.descent, len(got.widths)) == (1000, 800, -200, 13)
    assert [got.glyphs[ord(c)] for c in "019A"] == [1, 2, 10, 12] and 0xFFFF not in got.glyphs
    assert got.width("01", 10) == pytest.approx(11.5) and got.width("?", 10) == 5.0
    for bad in (b"", font()[:150], font().replace(b"hmtx", b"xxxx")):
        with pytest.raises(ValueError, match="font|table"):
            truetype.read_font(bad)
