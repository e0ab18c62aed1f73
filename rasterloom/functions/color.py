"""Colour science as column expressions: sRGB to CIE Lab, CIEDE2000, luma, tints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB primaries to CIE XYZ (IEC 61966-2-1), rows X, Y, Z by red, green, blue.
XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))


def _linear(value: Column) -> Column:
    v = value.cast("double") / 255
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def lab(b: Column, g: Column, r: Column) -> Column:
    """struct(L, a, b) of an 8-bit sRGB colour, relative to the matrix's own white point; a and b to ten digits, so grays have none."""
    channels = [_linear(c) for c in (r, g, b)]

    def shaped(row):
        t = sum((F.lit(k) * c for k, c in zip(row, channels, strict=True)), F.lit(0.0)) / sum(row)
        return F.when(t > (6 / 29) ** 3, F.pow(t, F.lit(1 / 3))).otherwise(t * ((29 / 6) ** 2 / 3) + 4 / 29)

    x, y, z = (shaped(row) for row in XYZ)
    return F.struct((116 * y - 16).alias("L"), F.round(500 * (x - y), 10).alias("a"), F.round(200 * (y - z), 10).alias("b"))


def with_lab(df, to: str = "lab", b: str = "b", g: str = "g", r: str = "r"):
    return df.withColumn(to, lab(F.col(b), F.col(g), F.col(r)))


def _norm(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def _wheel(degrees: Column) -> Column:
    return F.when(degrees < 0, degrees + 360).otherwise(degrees)


def de00(df, first: str, second: str, to: str = "de00"):
    """`df` with the CIEDE2000 difference (Sharma, Wu and Dalal 2005) of two Lab structs, worked out column by column so
    that nothing is computed twice."""
    p, q = F.col(first), F.col(second)
    u = {n: f"_{to}_{n}" for n in ("g", "a1", "a2", "c1", "c2", "h1", "h2", "dh", "hb", "lb", "cb", "x", "y", "z", "rt")}
    c = {n: F.col(v) for n, v in u.items()}
    seventh = F.pow((_norm(p["a"], p["b"]) + _norm(q["a"], q["b"])) / 2, F.lit(7.0))
    out = df.withColumn(u["g"], 1.5 - 0.5 * F.sqrt(seventh / (seventh + 25.0**7)))
    out = out.withColumns({u["a1"]: c["g"] * p["a"], u["a2"]: c["g"] * q["a"]})
    out = out.withColumns({u["c1"]: _norm(c["a1"], p["b"]), u["c2"]: _norm(c["a2"], q["b"]), u["h1"]: _wheel(F.degrees(F.atan2(p["b"], c["a1"]))), u["h2"]: _wheel(F.degrees(F.atan2(q["b"], c["a2"])))})
    gray, turn, total = c["c1"] * c["c2"] == 0, c["h2"] - c["h1"], c["h1"] + c["h2"]
    out = out.withColumns({
        u["dh"]: F.when(gray, 0.0).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn),
        u["hb"]: F.when(gray, total).when(F.abs(turn) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2),
        u["lb"]: F.pow((p["L"] + q["L"]) / 2 - 50, F.lit(2.0)), u["cb"]: (c["c1"] + c["c2"]) / 2,
    })
    cos = lambda k, shift: F.cos(F.radians(k * c["hb"] + shift))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
    seventh = F.pow(c["cb"], F.lit(7.0))
    turned = F.radians(60 * F.exp(-F.pow((c["hb"] - 275) / 25, F.lit(2.0))))
    out = out.withColumns({
        u["x"]: (q["L"] - p["L"]) / (1 + 0.015 * c["lb"] / F.sqrt(20 + c["lb"])), u["y"]: (c["c2"] - c["c1"]) / (1 + 0.045 * c["cb"]),
        u["z"]: 2 * F.sqrt(c["c1"] * c["c2"]) * F.sin(F.radians(c["dh"] / 2)) / (1 + 0.015 * c["cb"] * t),
        u["rt"]: -2 * F.sin(turned) * F.sqrt(seventh / (seventh + 25.0**7)),
    })
    # rounding may push a sum of squares that is nothing just below zero
    square = c["x"] * c["x"] + c["y"] * c["y"] + c["z"] * c["z"] + c["rt"] * c["y"] * c["z"]
    return out.withColumn(to, F.sqrt(F.greatest(square, F.lit(0.0)))).drop(*u.values())


def luma(b: Column, g: Column, r: Column) -> Column:
    """Rec. 601 luma."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def number_fill(b: Column, g: Column, r: Column) -> Column:
    """Gray of a number printed on a colour: white on dark ones (fixed value: a luma below 140)."""
    return F.when(luma(b, g, r) < 140, 255).otherwise(0)


def tint(value: Column, share: float = 0.4) -> Column:
    """A channel washed towards white."""
    return F.rint(255 - share * (255 - value)).cast("int")


def paper_under(coverage: Column, gray: Column) -> Column:
    """What is left of white paper under ink of that gray and coverage (0 to 255)."""
    return F.rint(255 - coverage * (255 - gray) / 255).cast("int")


# ---- the same for whole arrays, in kernels and Arrow batches ---------------------------------------------------------


def lab_array(bgr: np.ndarray) -> np.ndarray:
    """Lab of 8-bit sRGB colours, blue first, along the last axis."""
    v = np.asarray(bgr, np.float64)[..., ::-1] / 255
    light = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    xyz = np.stack([light @ np.array(row) / sum(row) for row in XYZ], axis=-1)
    x, y, z = np.moveaxis(np.where(xyz > (6 / 29) ** 3, np.cbrt(xyz), xyz * ((29 / 6) ** 2 / 3) + 4 / 29), -1, 0)
    return np.stack([116 * y - 16, np.round(500 * (x - y), 10) + 0.0, np.round(200 * (y - z), 10) + 0.0], axis=-1)


def bgr_array(lab_: np.ndarray) -> np.ndarray:
    """The nearest 8-bit sRGB colours, blue first, of Lab values."""
    l, a, b = np.moveaxis(np.asarray(lab_, np.float64), -1, 0)
    y = (l + 16) / 116
    t = np.stack([y + a / 500, y, y - b / 200], axis=-1)
    xyz = np.where(t > 6 / 29, t**3, (t - 4 / 29) * 3 * (6 / 29) ** 2) * [sum(row) for row in XYZ]
    light = np.clip(xyz @ np.linalg.inv(np.array(XYZ)).T, 0, 1)
    v = np.where(light <= 0.0031308, 12.92 * light, 1.055 * light ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(255 * v), 0, 255).astype(np.uint8)[..., ::-1]


def de00_array(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """CIEDE2000 of Lab arrays that broadcast against each other."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(p, -1, 0), np.moveaxis(q, -1, 0)
    seventh = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    stretch = 1.5 - 0.5 * np.sqrt(seventh / (seventh + 25.0**7))
    a1, a2 = a1 * stretch, a2 * stretch
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    gray, turn, total = c1 * c2 == 0, h2 - h1, h1 + h2
    mean = np.where(gray, total, np.where(np.abs(turn) <= 180, total / 2, np.where(total < 360, total / 2 + 180, total / 2 - 180)))
    turn = np.where(gray, 0.0, turn - 360 * (turn > 180) + 360 * (turn < -180))
    angle = np.radians(mean)
    shape = 1 - 0.17 * np.cos(angle - np.radians(30)) + 0.24 * np.cos(2 * angle) + 0.32 * np.cos(3 * angle + np.radians(6)) - 0.20 * np.cos(4 * angle - np.radians(63))
    chroma, middle = (c1 + c2) / 2, ((l1 + l2) / 2 - 50) ** 2
    x = (l2 - l1) / (1 + 0.015 * middle / np.sqrt(20 + middle))
    y = (c2 - c1) / (1 + 0.045 * chroma)
    z = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * chroma * shape)
    twist = -2 * np.sin(np.radians(60 * np.exp(-(((mean - 275) / 25) ** 2)))) * np.sqrt(chroma**7 / (chroma**7 + 25.0**7))
    return np.sqrt(np.maximum(x * x + y * y + z * z + twist * y * z, 0))


def nearest_array(lab_: np.ndarray, palette: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the palette, distance) closest by CIEDE2000 to each Lab row, the first of those equal to nine digits."""
    row, far = np.zeros(len(lab_), np.int64), np.zeros(len(lab_))
    for at in range(0, len(lab_), 1 << 14):
        d = de00_array(lab_[at : at + (1 << 14), None], palette[None])
        best = np.round(d, 9).argmin(axis=1)
        row[at : at + len(d)] = best
        far[at : at + len(d)] = d[np.arange(len(d)), best]
    return row, far


# ---- the same as DuckDB macros, for the checking SQL ------------------------------------------------------------------


def sql_lab(alias: str) -> str:
    """L_, A_ and B_ of the columns b, g, r of `alias`, as a select list."""
    line = lambda c: f"(CASE WHEN {alias}.{c} / 255::DOUBLE <= 0.04045::DOUBLE THEN {alias}.{c} / 255::DOUBLE / 12.92::DOUBLE ELSE pow(({alias}.{c} / 255::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
    d = lambda x: f"{x!r}::DOUBLE"
    t = [f"(({d(k[0])} * {line('r')} + {d(k[1])} * {line('g')} + {d(k[2])} * {line('b')}) / {d(sum(k))})" for k in XYZ]
    f = [f"(CASE WHEN {x} > {d((6 / 29) ** 3)} THEN pow({x}, 1::DOUBLE / 3) ELSE {x} * {d((29 / 6) ** 2 / 3)} + {d(4 / 29)} END)" for x in t]
    return f"116 * {f[1]} - 16 AS L_, round(500 * ({f[0]} - {f[1]}), 10) + 0 AS A_, round(200 * ({f[1]} - {f[2]}), 10) + 0 AS B_"


def sql_de00(source: str, keep: str) -> str:
    """A subquery over `source` with columns l1, a1, b1, l2, a2, b2 that adds de00 to the columns `keep`."""
    return f"""(
  SELECT {keep}, sqrt(greatest(0, x * x + y * y + z * z + rt * y * z)) AS de00 FROM (
    SELECT *, (l2 - l1) / (1 + 0.015::DOUBLE * l50 / sqrt(20 + l50)) AS x, (c2 - c1) / (1 + 0.045::DOUBLE * cb) AS y,
      2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015::DOUBLE * cb * (1 - 0.17::DOUBLE * cos(radians(hb - 30)) + 0.24::DOUBLE * cos(radians(2 * hb))
        + 0.32::DOUBLE * cos(radians(3 * hb + 6)) - 0.2::DOUBLE * cos(radians(4 * hb - 63)))) AS z,
      -sin(radians(60 * exp(-pow((hb - 275) / 25, 2)))) * 2 * sqrt(pow(cb, 7) / (pow(cb, 7) + pow(25::DOUBLE, 7))) AS rt
    FROM (SELECT *, pow((l1 + l2) / 2 - 50, 2) AS l50, (c1 + c2) / 2 AS cb,
        CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
        CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hb
      FROM (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2,
          CASE WHEN degrees(atan2(b1, p1)) < 0 THEN degrees(atan2(b1, p1)) + 360 ELSE degrees(atan2(b1, p1)) END AS h1,
          CASE WHEN degrees(atan2(b2, p2)) < 0 THEN degrees(atan2(b2, p2)) + 360 ELSE degrees(atan2(b2, p2)) END AS h2
        FROM (SELECT *, k * a1 AS p1, k * a2 AS p2 FROM (SELECT *,
          1.5::DOUBLE - 0.5::DOUBLE * sqrt(pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) / (pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) + pow(25::DOUBLE, 7))) AS k FROM {source}))))))"""
