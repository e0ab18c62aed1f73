"""What a page needs of a TrueType font: its units, the width of each glyph, and which glyph a character has."""

from __future__ import annotations

import struct
from dataclasses import dataclass


@dataclass(frozen=True)
class Font:
    """units: of the em square; ascent, descent: of a line; widths: by glyph; glyphs: by code of the basic plane."""

    units: int
    ascent: int
    descent: int
    widths: tuple[int, ...]
    glyphs: dict[int, int]

    def width(self, text: str, size: float) -> float:
        """How wide a text is at a size; a character without a glyph has that of glyph 0."""
        return sum(self.widths[min(self.glyphs.get(ord(c), 0), len(self.widths) - 1)] for c in text) * size / self.units


def tables(data: bytes) -> dict[str, bytes]:
    """The tables of a font file by their tags; a file that ends early is an error."""
    if len(data) < 12:
        raise ValueError("not a font file")
    out = {}
    for k in range(struct.unpack_from(">H", data, 4)[0]):
        tag, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * k)
        if at + size > len(data):
            raise ValueError(f"table {tag!r} ends beyond the file")
        out[tag.decode("latin-1")] = data[at : at + size]
    return out


def character_map(table: bytes) -> dict[int, int]:
    """Glyphs by code, of the basic plane's segments (format 4) in a font's character map."""
    for k in range(struct.unpack_from(">H", table, 2)[0]):
        platform, encoding, at = struct.unpack_from(">HHI", table, 4 + 8 * k)
        if (platform, encoding) in ((3, 1), (0, 3)) and struct.unpack_from(">H", table, at)[0] == 4:
            break
    else:
        raise ValueError("the font has no character map of the basic plane")
    n = struct.unpack_from(">H", table, at + 6)[0] // 2
    read = lambda offset, kind: struct.unpack_from(f">{n}{kind}", table, at + offset)
    ends, starts, deltas, offsets = read(14, "H"), read(16 + 2 * n, "H"), read(16 + 4 * n, "h"), read(16 + 6 * n, "H")
    out = {}
    for k in range(n):
        for code in range(starts[k], min(ends[k], 0xFFFE) + 1):
            glyph = code
            if offsets[k]:  # where its glyph stands, counted from the offset itself
                glyph = struct.unpack_from(">H", table, at + 16 + 6 * n + 2 * k + offsets[k] + 2 * (code - starts[k]))[0]
                if not glyph:
                    continue
            if glyph := (glyph + deltas[k]) & 0xFFFF:
                out[code] = glyph
    return out


def read_font(data: bytes) -> Font:
    """A font from its file; one that lacks a table it needs is an error."""
    found = tables(data)
    if lacks := {"head", "hhea", "hmtx", "maxp", "cmap"} - found.keys():
        raise ValueError(f"the font lacks {', '.join(sorted(lacks))}")
    glyphs, metrics = struct.unpack_from(">H", found["maxp"], 4)[0], struct.unpack_from(">H", found["hhea"], 34)[0]
    widths = [struct.unpack_from(">H", found["hmtx"], 4 * k)[0] for k in range(metrics)]
    ascent, descent = struct.unpack_from(">hh", found["hhea"], 4)
    return Font(struct.unpack_from(">H", found["head"], 18)[0], ascent, descent, (*widths, *[widths[-1]] * (glyphs - metrics)), character_map(found["cmap"]))
