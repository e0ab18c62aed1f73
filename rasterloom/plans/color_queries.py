"""Queries of the colour operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.color import sql_de00, sql_lab
from ..operators import colors as K
from ..sources import fixtures as X

_NEAR = f"""few AS (SELECT b, g, r, count(*) AS n FROM mosaic GROUP BY 1, 2, 3),
fewl AS (SELECT *, {sql_lab('few')} FROM few), pall AS (SELECT *, {sql_lab('pal')} FROM pal),
near AS (SELECT * FROM (SELECT b, g, r, n, color, de00, row_number() OVER (PARTITION BY b, g, r ORDER BY round(de00, 9), color) AS k FROM {sql_de00(
    '(SELECT fewl.b, fewl.g, fewl.r, n, color, fewl.L_ AS l1, fewl.A_ AS a1, fewl.B_ AS b1, pall.L_ AS l2, pall.A_ AS a2, pall.B_ AS b2 FROM fewl CROSS JOIN pall)', 'b, g, r, n, color')}) WHERE k = 1)"""
_PAIRS = f"""pall AS (SELECT *, {sql_lab('pal')} FROM pal),
pairs AS (SELECT first, second, round(de00, 6) AS de00 FROM {sql_de00(
    '(SELECT p.color AS first, q.color AS second, p.L_ AS l1, p.A_ AS a1, p.B_ AS b1, q.L_ AS l2, q.A_ AS a2, q.B_ AS b2 FROM pall p JOIN pall q ON p.color < q.color)', 'first, second')})"""
_HIST = f"""few AS (SELECT b, g, r, count(*) AS n FROM mosaic GROUP BY 1, 2, 3), fewl AS (SELECT *, {sql_lab('few')} FROM few),
hist AS (SELECT CAST(floor(round(L_, 9) / 4) AS INTEGER) AS l, CAST(floor(round(A_, 9) / 4) AS INTEGER) AS a, CAST(floor(round(B_, 9) / 4) AS INTEGER) AS b, sum(n) AS n, round(sum(L_ * n) / sum(n), 6) AS L_mean FROM fewl GROUP BY 1, 2, 3)"""


def _quantised(px):
    level = lambda c: (F.floor(F.col(c) / 64) * 64 + 32).cast("int").alias(c)
    return px.select("image_id", "x", "y", level("b"), level("g"), level("r"))


QUERIES = {
    "legend_nearest_palette": lambda s, d: K.legend(X.mosaic(s, d), X.palette16(s)),
    "nearest_color": lambda s, d: K.nearest_color(X.mosaic(s, d), X.palette16(s)).withColumn("de00", F.round("de00", 5)),
    "palette_pairwise_de00": lambda s, d: K.pairwise_de00(X.palette16(s)),
    "palette_separation": lambda s, d: K.palette_separation(X.palette16(s), 25.0),
    "color_histogram": lambda s, d: K.color_histogram(X.mosaic(s, d)),
    "crowd27": lambda s, d: K.neighborhood(K.color_histogram(X.mosaic(s, d))),
    "ink_mixes": lambda s, d: K.ink_mixes(X.palette16(s)),
    "region_colors": lambda s, d: K.region_colors(X.mosaic_regions(s, d), "(x + y) % 3 = 0 and label <> 2"),
    "fidelity": lambda s, d: K.mean_de00(X.mosaic(s, d), _quantised(X.mosaic(s, d)), ["image_id", "x", "y"]),
    "flat_color_match": lambda s, d: K.flat_color_match(X.mosaic(s, d), X.palette16(s)),
    "legend_layout": lambda s, d: K.swatches(X.palette16(s)),
    "ink_gray": lambda s, d: K.ink_gray(X.supplier_raster(s, d), "b < 100"),
}

ORACLE = {
    "legend_nearest_palette": f"""WITH {X.MOSAIC}, {X.PALETTE}, {_NEAR},
      used AS (SELECT color, sum(n) AS pixels, sum(de00 * n) / sum(n) AS mean_de00 FROM near GROUP BY 1)
      SELECT row_number() OVER (ORDER BY round(L_, 9), color) AS number, color, b, g, r, CAST(pixels AS BIGINT) AS pixels,
        round(pixels / (sum(pixels) OVER ())::DOUBLE, 9) AS share, round(mean_de00, 6) AS mean_de00 FROM used JOIN pall USING (color)""",
    "nearest_color": f"WITH {X.MOSAIC}, {X.PALETTE}, {_NEAR} SELECT b, g, r, n, color, round(de00, 5) AS de00 FROM near",
    "palette_pairwise_de00": f"WITH {X.PALETTE}, {_PAIRS} SELECT * FROM pairs",
    "palette_separation": f"WITH {X.PALETTE}, {_PAIRS} SELECT min(de00) AS min_de00, count(*) FILTER (de00 < 25) AS close_pairs FROM pairs",
    "color_histogram": f"WITH {X.MOSAIC}, {_HIST} SELECT l, a, b, CAST(n AS BIGINT) AS n, L_mean FROM hist",
    "crowd27": f"""WITH {X.MOSAIC}, {_HIST} SELECT h.l, h.a, h.b, CAST(any_value(h.n) AS BIGINT) AS n, CAST(sum(o.n) AS BIGINT) AS near FROM hist h
      JOIN hist o ON abs(h.l - o.l) <= 1 AND abs(h.a - o.a) <= 1 AND abs(h.b - o.b) <= 1 GROUP BY 1, 2, 3""",
    "ink_mixes": f"""WITH {X.PALETTE} SELECT p.color AS first, q.color AS second, CAST(s AS INTEGER) AS step, p.b + (q.b - p.b) * s / 8::DOUBLE AS b, p.g + (q.g - p.g) * s / 8::DOUBLE AS g,
      p.r + (q.r - p.r) * s / 8::DOUBLE AS r FROM pal p JOIN pal q ON p.color < q.color, range(1, 8) AS t(s)""",
    "region_colors": f"""WITH {X.REGIONS} SELECT image_id, region_id, round(coalesce(avg(b) FILTER ((x + y) % 3 = 0 AND label <> 2), avg(b)), 6) AS b,
      round(coalesce(avg(g) FILTER ((x + y) % 3 = 0 AND label <> 2), avg(g)), 6) AS g, round(coalesce(avg(r) FILTER ((x + y) % 3 = 0 AND label <> 2), avg(r)), 6) AS r, count(*) AS n
      FROM px WHERE region_id >= 0 GROUP BY 1, 2""",
    "fidelity": f"""WITH {X.MOSAIC}, q AS (SELECT image_id, x, y, b // 64 * 64 + 32 AS b, g // 64 * 64 + 32 AS g, r // 64 * 64 + 32 AS r FROM mosaic),
      ml AS (SELECT *, {sql_lab('mosaic')} FROM mosaic), ql AS (SELECT *, {sql_lab('q')} FROM q)
      SELECT image_id, count(*) AS pixels, round(avg(de00), 6) AS de00_mean, round(quantile_cont(de00, 0.95), 6) AS de00_p95 FROM {sql_de00(
        '(SELECT ml.image_id, ml.L_ AS l1, ml.A_ AS a1, ml.B_ AS b1, ql.L_ AS l2, ql.A_ AS a2, ql.B_ AS b2 FROM ml JOIN ql USING (image_id, x, y))', 'image_id')} GROUP BY 1""",
    "flat_color_match": f"WITH {X.MOSAIC}, {X.PALETTE}, {_NEAR} SELECT count(*) AS flats, round(avg(de00), 6) AS de00_mean, round(max(de00), 6) AS de00_max FROM near",
    "legend_layout": f"""WITH {X.PALETTE}, k AS (SELECT *, row_number() OVER (ORDER BY color) - 1 AS i FROM pal)
      SELECT CAST(i + 1 AS INTEGER) AS number, CAST(i // 5 AS INTEGER) AS "row", CAST(i % 5 AS INTEGER) AS col, 3::DOUBLE + i % 5 * 15::DOUBLE AS x_mm, 3::DOUBLE + i // 5 * 15::DOUBLE AS y_mm, b, g, r,
      CAST(round_even(255 - 0.4::DOUBLE * (255 - b), 0) AS INTEGER) AS tint_b, CAST(round_even(255 - 0.4::DOUBLE * (255 - g), 0) AS INTEGER) AS tint_g, CAST(round_even(255 - 0.4::DOUBLE * (255 - r), 0) AS INTEGER) AS tint_r,
      CASE WHEN 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b < 140 THEN 255 ELSE 0 END AS text_gray FROM k""",
    "ink_gray": f"""WITH {X.SUPPLIERS} SELECT image_id, CAST(coalesce(floor(quantile_cont(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE), 0.5) FILTER (b < 100)), 0) AS INTEGER) AS gray
      FROM supp GROUP BY 1""",
}
