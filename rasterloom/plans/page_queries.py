"""Queries of print geometry, settings, similarity, text and polylines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import page as P
from ..operators import benchmark as B
from ..operators import signal as S
from ..session import table
from ..sources import fixtures as X
from .color_queries import _quantised


def _pictures(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("image_id"), (200 + F.col("c_custkey") * 37 % 4000).cast("int").alias("width"), (200 + F.col("c_custkey") * 91 % 3000).cast("int").alias("height"))


def _values(s, d):
    names = s.createDataFrame([(i, r[0]) for i, r in enumerate(P.SETTINGS)], "i int, name string")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 1000 / 10.0 - 10).alias("value"), (F.col("p_partkey") % 22).cast("int").alias("i")).join(F.broadcast(names), "i").drop("i")


#: What a reader of texts gets wrong: signs for others (some of them typographic), and a doubled letter for one.
_MISREAD = ("lO,'-", "1O，’—")


def _text_pairs(s, d):
    """Every benchmark item with a misreading of the whole of it."""
    read = F.regexp_replace(F.translate("text", *_MISREAD), "rr", "r")
    return table(s, d, "benchmark").select("item_id", F.col("text").alias("truth"), F.concat(F.lit("  "), F.regexp_replace(read, " ", " \n")).alias("read"))


def _chosen(s, d):
    """A choice of settings for each part: a preset, and for some of them a setting of their own."""
    names = s.createDataFrame([(i, n) for i, n in enumerate((*P.LEVEL_SETTINGS, "palette_margin_de00", "detail_weight", "sharpest_corner_deg"))], "i int, name string")
    levels = s.createDataFrame([(i, x[0]) for i, x in enumerate(P.LEVELS)], "k int, preset string")
    part = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).cast("int").alias("k"), (F.col("p_partkey") % 8).cast("int").alias("i"), (F.col("p_size") * 1.0).alias("value"))
    return part.join(F.broadcast(levels), "k").join(F.broadcast(names), "i", "left").select("id", "preset", "name", "value")


def _cases(s, d):
    """Sizes of benchmark cases: some of old sets, without the sizes of page or source."""
    key = F.col("c_custkey")
    return table(s, d, "customer").select(
        key.alias("case_id"), (900 + key * 7 % 900).cast("int").alias("asked"), *[F.when(key % 4 != 0, (v + key * 7 % 900).cast("int")).alias(n) for n, v in (("page_w", 890), ("page_h", 600))],
        *[F.when(key % 3 != 0, (v + key * 11 % 1200).cast("int")).alias(n) for n, v in (("source_w", 800), ("source_h", 700))],
    )


def _rings(s, d):
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return X.boxes(s, d).select(F.col("box_id").alias("ring_id"), F.array(at(x, y + 1), at(x + w, y), at(x + w + 1, y + h), at(x + 1, y + h + 2)).alias("pts"))


def _segments(s, d):
    return X.boxes(s, d).select(F.col("box_id").alias("segment_id"), *[F.col(c).cast("double").alias(n) for c, n in (("x", "x0"), ("y", "y0"))], (F.col("x") + F.col("w") * 1.25).alias("x1"), (F.col("y") + F.col("h") * 0.75).alias("y1"))


def _edge_pixels(s, d, least):
    return X.mosaic(s, d).where(f"g > {least}").select("image_id", "x", "y")


QUERIES = {
    "print_scale": lambda s, d: P.print_scale(_pictures(s, d)).select("image_id", "landscape", *[F.round(c, 6).alias(c) for c in ("px_per_mm", "printed_w_mm", "printed_h_mm", "dpi", "brush_px")], "export_edge", "working_edge", "min_area_px", "font_px"),
    "settings_clamp": lambda s, d: P.clamped(_values(s, d), P.settings(s)).select("id", "name", "value", "held"),
    "corner_tips_table": lambda s, d: s.range(5, 181, 5).select(F.col("id").alias("degrees"), F.round(P.tip_length(F.col("id")), 6).alias("length"), F.round(P.tip_depth(F.col("id")), 6).alias("depth")),
    "presets": lambda s, d: P.presets(s),
    "chosen_params": lambda s, d: P.params(_chosen(s, d), P.presets(s), P.settings(s)),
    "described_params": lambda s, d: P.described(P.params(_chosen(s, d), P.presets(s), P.settings(s))),
    "case_sizes": lambda s, d: B.case_sizes(_cases(s, d)),
    "preferred_fonts": lambda s, d: X.boxes(s, d).select("box_id", P.preferred_font(F.least("w", "h") * 7.3, F.lit(10)).alias("font_px")),
    "ssim_mean": lambda s, d: S.ssim(X.album(s, d), _quantised(X.album(s, d)), 40, 40),
    "otsu_contrast": lambda s, d: S.otsu_contrast(table(s, d, "orders"), "o_orderpriority", "o_totalprice"),
    "tones": lambda s, d: S.tones(table(s, d, "part"), "p_brand", "p_size", 24.9),
    "text_errors": lambda s, d: S.character_errors(_text_pairs(s, d).withColumnRenamed("item_id", "block")).withColumnRenamed("block", "item_id"),
    "text_cer": lambda s, d: S.character_error_rate(_text_pairs(s, d).withColumnRenamed("item_id", "block")),
    "ring_measures": lambda s, d: S.ring_measures(_rings(s, d)),
    "scaled_points": lambda s, d: S.ring_measures(S.scaled_points(_rings(s, d), 1.5, 0.75)),
    "pixels_along": lambda s, d: S.pixels_along(_segments(s, d)),
    "edge_alignment": lambda s, d: S.boundary_f1(_edge_pixels(s, d, 200), X.mosaic(s, d).where("r > 195").select("image_id", "x", "y"), 1),
    "page_diff": lambda s, d: S.page_diff(X.mosaic(s, d), _quantised(X.mosaic(s, d)).where("x % 7 <> 0")),
    "shrunk": lambda s, d: S.shrunk(X.album(s, d), 40, 40, 16, 12),
    "scaled_up": lambda s, d: S.scaled_up(X.album(s, d), 40, 40, 64, 50),
}

_SETTINGS = "setting AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, {str(w).lower()})" for i, (n, lo, hi, w, _) in enumerate(P.SETTINGS)) + ") AS s(i, name, lo, hi, whole))"
_PICTURES = "pic AS (SELECT c_custkey AS image_id, CAST(200 + c_custkey * 37 % 4000 AS INTEGER) AS width, CAST(200 + c_custkey * 91 % 3000 AS INTEGER) AS height FROM customer)"
_PAIRS = f"""pair AS (SELECT item_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS t, trim(regexp_replace(replace(translate(text, 'l,', '1,'), 'rr', 'r'), '[ \t\r\n]+', ' ', 'g')) AS r FROM benchmark)"""
_CHOSEN = "chosen AS (SELECT p_partkey AS id, p_partkey % 5 AS k, p_partkey % 8 AS i, p_size::DOUBLE AS value FROM part)"
_LEVELS = "preset AS (SELECT * FROM (VALUES " + ", ".join(f"('{x[0]}', '{n}', {float(v)!r}::DOUBLE)" for x in P.LEVELS for n, v in (*zip(P.LEVEL_SETTINGS, x[1:], strict=True), *P.SHARED)) + ", " + ", ".join(f"('Finest', '{n}', {v!r}::DOUBLE)" for n, v in P.FINEST) + ") AS v(preset, name, value))"
_OWN = "['num_colors', 'min_region_area_mm2', 'min_width_mm', 'blur_sigma', 'palette_margin_de00', 'detail_weight', 'sharpest_corner_deg'][c.i + 1]"
_WIDE = ", ".join(f"max(value) FILTER (name = '{n}') AS {n}" for n in (*P.LEVEL_SETTINGS, "palette_margin_de00", "detail_weight", "sharpest_corner_deg"))
_PARAMS = f"""{_CHOSEN}, {_LEVELS}, {{setting}}, params AS (SELECT c.id, p.name, CASE WHEN p.name = {_OWN} THEN CASE WHEN whole THEN round_even(least(greatest(c.value, lo), hi), 0) ELSE least(greatest(c.value, lo), hi) END ELSE p.value END AS value
  FROM chosen c JOIN preset p ON p.preset = ['Beginner', 'Easy', 'Medium', 'Hard', 'Realistic'][k + 1] JOIN setting t ON t.name = p.name)"""
_RINGS = "ring AS (SELECT box_id AS ring_id, [x::DOUBLE, x + w, x + w + 1, x + 1] AS xs, [y::DOUBLE + 1, y, y + h, y + h + 2] AS ys FROM box)"


def _ring_sql(xs: str, ys: str) -> str:
    return f"""WITH {X.BOXES}, {_RINGS}, s AS (SELECT ring_id, {xs} AS xs, {ys} AS ys FROM ring), e AS (SELECT ring_id, xs[i] AS a, ys[i] AS b, xs[i % 4 + 1] AS c, ys[i % 4 + 1] AS d FROM s, range(1, 5) AS t(i))
      SELECT ring_id, round(sum(a * d - c * b) / 2, 6) AS area, round(sum(sqrt((c - a) * (c - a) + (d - b) * (d - b))), 6) AS length FROM e GROUP BY 1"""


def _ssim_sql() -> str:
    raw = [math.exp(-(k * k) / 4.5) for k in range(-5, 6)]
    taps = "taps AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {w / sum(raw)!r}::DOUBLE)" for k, w in zip(range(-5, 6), raw, strict=True)) + ") AS t(k, w))"
    luma = lambda b, g, r: f"0.299::DOUBLE * {r} + 0.587::DOUBLE * {g} + 0.114::DOUBLE * {b}"
    five = lambda e: ", ".join(f"sum(w * {e(c)}) AS {c}" for c in ("p", "q", "pp", "qq", "pq"))
    mirror = lambda c: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 39 THEN 78 - ({c}) ELSE {c} END"
    return f"""WITH {X.ALBUM}, {taps}, lum AS (SELECT image_id, x, y, p, q, p * p AS pp, q * q AS qq, p * q AS pq FROM (SELECT image_id, x, y, {luma('b', 'g', 'r')} AS p, {luma('(b // 64 * 64 + 32)', '(g // 64 * 64 + 32)', '(r // 64 * 64 + 32)')} AS q FROM album)),
      rowed AS (SELECT a.image_id, a.x, a.y, {five(lambda c: f'o.{c}')} FROM (SELECT image_id, x, y, k, w, {mirror('x + k')} AS u FROM lum, taps) a JOIN lum o ON o.image_id = a.image_id AND o.y = a.y AND o.x = a.u GROUP BY 1, 2, 3),
      m AS (SELECT a.image_id, a.x, a.y, {five(lambda c: f'o.{c}')} FROM (SELECT image_id, x, y, k, w, {mirror('y + k')} AS v FROM lum, taps) a JOIN rowed o ON o.image_id = a.image_id AND o.x = a.x AND o.y = a.v GROUP BY 1, 2, 3)
      SELECT image_id, round(avg((2 * p * q + 6.5025::DOUBLE) * (2 * (pq - p * q) + 58.5225::DOUBLE) / ((p * p + q * q + 6.5025::DOUBLE) * (pp - p * p + qq - q * q + 58.5225::DOUBLE))), 6) AS ssim FROM m GROUP BY 1"""


ORACLE = {
    "print_scale": f"""WITH {_PICTURES}, a AS (SELECT *, width > height AS landscape, 1 / least(CASE WHEN width > height THEN 277::DOUBLE ELSE 190::DOUBLE END / width, CASE WHEN width > height THEN 190::DOUBLE ELSE 277::DOUBLE END / height) AS s FROM pic),
      b AS (SELECT *, width / s AS pw, height / s AS ph, least(greatest(width, height), CAST(round_even(greatest(width / s, height / s) * 300::DOUBLE / 25.4::DOUBLE, 0) AS INTEGER)) AS ee FROM a)
      SELECT image_id, landscape, round(s, 6) AS px_per_mm, round(pw, 6) AS printed_w_mm, round(ph, 6) AS printed_h_mm, round(s * 25.4::DOUBLE, 6) AS dpi, round(0.7::DOUBLE * s, 6) AS brush_px, ee AS export_edge,
        least(ee, greatest(1100, CAST(round_even(greatest(pw, ph) * (4.0::DOUBLE / 0.7::DOUBLE * 25.4::DOUBLE) / 25.4::DOUBLE, 0) AS INTEGER))) AS working_edge, greatest(4, CAST(round_even(6.0::DOUBLE * s * s, 0) AS INTEGER)) AS min_area_px,
        greatest(10, CAST(ceil(3.0::DOUBLE * s * 25.4::DOUBLE / 72.0::DOUBLE - 1e-9::DOUBLE) AS INTEGER)) AS font_px FROM b""",
    "settings_clamp": f"""WITH {_SETTINGS}, v AS (SELECT p_partkey AS id, p_partkey * 7 % 1000 / 10::DOUBLE - 10 AS value, p_partkey % 22 AS i FROM part)
      SELECT id, name, value, CASE WHEN whole THEN round_even(least(greatest(value, lo), hi), 0) ELSE least(greatest(value, lo), hi) END AS held FROM v JOIN setting USING (i)""",
    "corner_tips_table": """SELECT d AS degrees, CASE WHEN d >= 180 THEN 0 ELSE round(1 / sin(radians(d) / 2) - 1, 6) END AS length,
      CASE WHEN d >= 180 THEN 0 ELSE round((1 / tan(radians(d) / 2) - (pi() - radians(d)) / 2) / (pi() - radians(d)), 6) END AS depth FROM range(5, 181, 5) AS t(d)""",
    "presets": f"WITH {_LEVELS} SELECT * FROM preset",
    "chosen_params": f"WITH {_PARAMS.format(setting=_SETTINGS)} SELECT * FROM params",
    "described_params": f"""WITH {_PARAMS.format(setting=_SETTINGS)}, w AS (SELECT id, {_WIDE} FROM params GROUP BY 1), say AS (SELECT id, num_colors, min_region_area_mm2, detail_weight, sharpest_corner_deg,
        regexp_replace(format('{{:.4f}}', palette_margin_de00), '\\.?0+$', '') AS margin, regexp_replace(format('{{:.4f}}', min_width_mm), '\\.?0+$', '') AS width, regexp_replace(format('{{:.4f}}', sharpest_corner_deg), '\\.?0+$', '') AS corner FROM w)
      SELECT id, concat('Up to ', CAST(num_colors AS INTEGER), ' colors, at least ', margin, ' dE apart. Regions of at least ', CAST(round_even(min_region_area_mm2, 0) AS INTEGER), ' mm2 (',
        CASE detail_weight WHEN 1 THEN 'as much' WHEN 2 THEN 'half that' ELSE concat('1/', CAST(detail_weight AS INTEGER), ' of that') END, ' on faces and the subject) and ', width, ' mm wide on paper, ',
        CASE WHEN sharpest_corner_deg < 180 THEN concat('corners down to ', corner, ' degrees kept sharp') ELSE 'corners rounded to the brush' END, '.') AS text FROM say""",
    "case_sizes": """WITH c AS (SELECT c_custkey AS case_id, 900 + c_custkey * 7 % 900 AS asked, CASE WHEN c_custkey % 4 <> 0 THEN greatest(890, 600) + c_custkey * 7 % 900 END AS page, CASE WHEN c_custkey % 3 <> 0 THEN 800 + c_custkey * 11 % 1200 END AS source FROM customer)
      SELECT case_id, CAST(coalesce(page, asked) AS INTEGER) AS edge, CASE WHEN source IS NOT NULL THEN coalesce(page, asked) >= source ELSE asked > coalesce(page, asked) END AS unscaled,
        CASE WHEN CASE WHEN source IS NOT NULL THEN coalesce(page, asked) >= 0.99::DOUBLE * source ELSE asked >= 1375 END THEN 'export' ELSE 'preview' END AS size FROM c""",
    "preferred_fonts": f"WITH {X.BOXES} SELECT box_id, greatest(10, least(40, CAST(floor(least(w, h) * 7.3::DOUBLE * 0.85::DOUBLE) AS INTEGER))) AS font_px FROM box",
    "ssim_mean": _ssim_sql(),
    "otsu_contrast": """WITH s AS (SELECT o_orderpriority, row_number() OVER w AS k, sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) AS low, count(*) OVER p AS n, sum(o_totalprice) OVER p AS total FROM orders
        WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice), p AS (PARTITION BY o_orderpriority)),
      c AS (SELECT o_orderpriority, k, (total - low) / (n - k) - low / k AS contrast, k / n::DOUBLE * (1 - k / n::DOUBLE) * pow((total - low) / (n - k) - low / k, 2) AS spread FROM s WHERE k < n)
      SELECT o_orderpriority, round(contrast, 6) AS contrast FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY spread DESC, k) AS r FROM c) WHERE r = 1""",
    "tones": """WITH s AS (SELECT p_brand, row_number() OVER w AS k, sum(p_size) OVER (w ROWS UNBOUNDED PRECEDING) AS low, count(*) OVER p AS n, sum(p_size) OVER p AS total, lead(p_size) OVER w AS next, p_size FROM part
        WINDOW w AS (PARTITION BY p_brand ORDER BY p_size), p AS (PARTITION BY p_brand)),
      c AS (SELECT p_brand, p_size, (total - low) / (n - k) - low / k AS contrast, k * (n - k) * pow((total - low) / (n - k) - low / k, 2) AS spread FROM s WHERE k < n AND next > p_size),
      o AS (SELECT p_brand, round(contrast, 6) AS contrast FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY spread DESC, p_size) AS r FROM c) WHERE r = 1),
      e AS (SELECT p_brand, round(quantile_cont(p_size, 0.02), 6) AS dark, round(quantile_cont(p_size, 0.98), 6) AS light FROM part GROUP BY 1)
      SELECT p_brand, CASE WHEN contrast >= 24.9::DOUBLE AND light > dark THEN dark END AS dark, CASE WHEN contrast >= 24.9::DOUBLE AND light > dark THEN light END AS light FROM e JOIN o USING (p_brand)""",
    "text_errors": f"WITH {_PAIRS} SELECT item_id, levenshtein(t, r) AS errors, length(t) AS length FROM pair",
    "text_cer": f"WITH {_PAIRS} SELECT count(*) AS blocks, round(sum(levenshtein(t, r)) / sum(length(t))::DOUBLE, 6) AS cer FROM pair",
    "ring_measures": _ring_sql("xs", "ys"),
    "scaled_points": _ring_sql("list_transform(xs, lambda v: (v + 0.5::DOUBLE) * 1.5::DOUBLE - 0.5::DOUBLE)", "list_transform(ys, lambda v: (v + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE)"),
    "pixels_along": f"""WITH {X.BOXES}, s AS (SELECT box_id, x, y, x + w * 1.25::DOUBLE AS u, y + h * 0.75::DOUBLE AS v, greatest(1, CAST(ceil(2 * sqrt(pow(w * 1.25::DOUBLE, 2) + pow(h * 0.75::DOUBLE, 2))) AS INTEGER)) AS n FROM box)
      SELECT DISTINCT box_id AS segment_id, CAST(round_even(x + (u - x) * k / n, 0) AS INTEGER) AS x, CAST(round_even(y + (v - y) * k / n, 0) AS INTEGER) AS y FROM s, range(200) AS t(k) WHERE k <= n""",
    "edge_alignment": f"""WITH {X.MOSAIC}, p AS (SELECT x, y FROM mosaic WHERE g > 200), q AS (SELECT x, y FROM mosaic WHERE r > 195),
      a AS (SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM q WHERE (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 1) THEN 1::DOUBLE ELSE 0 END), 6) AS precision FROM p),
      b AS (SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM p WHERE (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 1) THEN 1::DOUBLE ELSE 0 END), 6) AS recall FROM q)
      SELECT 0 AS image_id, precision, recall, round(2 * precision * recall / (precision + recall), 5) AS f1 FROM a, b""",
    "page_diff": f"WITH {X.MOSAIC} SELECT image_id, round(avg(CASE WHEN x % 7 = 0 OR b <> b // 64 * 64 + 32 OR g <> g // 64 * 64 + 32 OR r <> r // 64 * 64 + 32 THEN 1::DOUBLE ELSE 0 END), 6) AS share FROM mosaic GROUP BY 1",
    "shrunk": f"""WITH {X.ALBUM}, t AS (SELECT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v FROM range(16) AS a(u), range(12) AS c(v)),
      o AS (SELECT image_id, u, v, b, g, r, (least(x + 1, (u + 1) * 2.5::DOUBLE) - greatest(x, u * 2.5::DOUBLE)) * (least(y + 1, (v + 1) * (40 / 12::DOUBLE)) - greatest(y, v * (40 / 12::DOUBLE))) AS w
        FROM t JOIN album ON x < (u + 1) * 2.5::DOUBLE AND x + 1 > u * 2.5::DOUBLE AND y + 1e-9::DOUBLE < (v + 1) * (40 / 12::DOUBLE) AND y + 1 > v * (40 / 12::DOUBLE) + 1e-9::DOUBLE)
      SELECT image_id, u AS x, v AS y, CAST(round_even(round(sum(b * w) / sum(w), 6), 0) AS INTEGER) AS b, CAST(round_even(round(sum(g * w) / sum(w), 6), 0) AS INTEGER) AS g, CAST(round_even(round(sum(r * w) / sum(w), 6), 0) AS INTEGER) AS r FROM o GROUP BY 1, 2, 3""",
    "scaled_up": f"""WITH {X.ALBUM}, t AS (SELECT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v FROM range(64) AS a(u), range(50) AS c(v))
      SELECT image_id, u AS x, v AS y, b, g, r FROM t JOIN album ON x = floor((u + 0.5::DOUBLE) * 40 / 64) AND y = floor((v + 0.5::DOUBLE) * 40 / 50)""",
}
