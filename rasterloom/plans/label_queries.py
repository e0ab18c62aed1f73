"""Queries of numbers, painting and detail operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.color import sql_lab
from ..operators import labels as L
from ..operators import regions as R
from ..sources import fixtures as X


_A = X.album_regions
#: Grays of the labels in the vote.
_GRAYS = [(v, v, v) for v in (96, 120, 136, 176)]


def _areas(s, d):
    return R.region_bounds(_A(s, d)).select("image_id", "region_id", "area")


def _labels(s, d):
    return X.boxes(s, d).select("image_id", (F.col("box_id") % 64).cast("int").alias("region_id"), (F.col("w") + F.col("h")).alias("font_px")).where("font_px > 9")


def _scored(s, d):
    return X.boxes(s, d).withColumn("score", (F.col("box_id") * 31 % 97).cast("int"))


def _masked(s, d):
    """Regions' pixels with whether they are slivers."""
    return R.slivers(_A(s, d), 1.5)


QUERIES = {
    "label_coverage": lambda s, d: L.label_coverage(_areas(s, d), _labels(s, d)),
    "unlabeled_regions": lambda s, d: L.unlabeled(_areas(s, d), _labels(s, d)),
    "unlabeled_figures": lambda s, d: L.unlabeled_figures(_areas(s, d), _labels(s, d), 1600),
    "label_sizes": lambda s, d: L.label_sizes(_labels(s, d), 2.5, 5.0),
    "labels_on_ink": lambda s, d: L.labels_on_ink(X.boxes(s, d), _A(s, d), "label = 3"),
    "gradient_slivers": lambda s, d: L.share_in_boxes(_masked(s, d), X.boxes(s, d), "sliver"),
    "tube_regions": lambda s, d: L.tube_regions(_A(s, d), "g > 128", 1.5),
    "suppressed_boxes": lambda s, d: L.suppressed(_scored(s, d)),
    "window_groups": lambda s, d: L.window_groups(X.boxes(s, d), 1, 1.0),
    "equalized": lambda s, d: L.equalized(X.mosaic(s, d), "g"),
    "page_pixels": lambda s, d: L.page_pixels(X.mosaic(s, d), "case when x % 5 = 0 then 255 when y % 7 = 0 then b else 0 end"),
    "completed_painting": lambda s, d: L.completed(X.mosaic(s, d), "case when x % 5 = 0 then 255 when y % 7 = 0 then r else 0 end", 40),
    "edge_vote": lambda s, d: L.edge_vote(_A(s, d), _GRAYS, 0.8, 10.0),
}

_L = "lab AS (SELECT image_id, CAST(box_id % 64 AS INTEGER) AS region_id, w + h AS font_px FROM box WHERE w + h > 9)"
_AREAS = f"{X.ALBUM_REGIONS}, {X.BOXES}, {_L}, area AS (SELECT image_id, region_id, count(*) AS area FROM px WHERE region_id >= 0 GROUP BY 1, 2), known AS (SELECT *, (image_id, region_id) IN (SELECT (image_id, region_id) FROM lab) AS h FROM area)"
_IN = "b.image_id = p.image_id AND b.x <= p.x + 0.5 AND p.x + 0.5 < b.x + b.w AND b.y <= p.y + 0.5 AND p.y + 0.5 < b.y + b.h"


def _vote_sql() -> str:
    seen = lambda a: f"round_even({a}.L_ * 2.55::DOUBLE, 0) / 2.55::DOUBLE AS l, round_even({a}.A_ + 128, 0) AS a, round_even({a}.B_ + 128, 0) AS b"
    grays = ", ".join(f"({i}, {b}, {g}, {r})" for i, (b, g, r) in enumerate(_GRAYS))
    return f"""WITH {X.ALBUM_REGIONS}, few AS (SELECT DISTINCT b, g, r FROM px), fl AS (SELECT *, {sql_lab('few')} FROM few), fs AS (SELECT b AS pb, g AS pg, r AS pr, {seen('fl')} FROM fl),
      pal AS (SELECT * FROM (VALUES {grays}) AS v(label, b, g, r)), pl AS (SELECT *, {sql_lab('pal')} FROM pal), ps AS (SELECT label, {seen('pl')} FROM pl),
      share AS (SELECT p.image_id, p.x, p.y, p.label, p.b AS pb, p.g AS pg, p.r AS pr, q.label AS other, sum(exp(-((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) / 1.28::DOUBLE)) AS w
        FROM px p JOIN px q ON q.image_id = p.image_id AND abs(p.x - q.x) <= 3 AND abs(p.y - q.y) <= 3 GROUP BY ALL),
      v AS (SELECT image_id, x, y, share.label, other, round(w * exp(-sqrt(pow(fs.l - ps.l, 2) + pow(fs.a - ps.a, 2) + pow(fs.b - ps.b, 2)) / 10), 9) AS score FROM share JOIN fs USING (pb, pg, pr) JOIN ps ON ps.label = other)
      SELECT image_id, x, y, CAST(other AS INTEGER) AS label FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY score DESC, (label = other) DESC, other) AS k FROM v) WHERE k = 1"""


ORACLE = {
    "label_coverage": f"""WITH {_AREAS} SELECT image_id, count(*) AS regions, count(*) FILTER (h) AS labeled, round(count(*) FILTER (h) / count(*)::DOUBLE, 6) AS region_share, round(coalesce(sum(area) FILTER (h), 0) / sum(area)::DOUBLE, 6) AS area_share
      FROM known GROUP BY 1""",
    "unlabeled_regions": f"WITH {_AREAS} SELECT image_id, region_id, area FROM known WHERE NOT h",
    "unlabeled_figures": f"WITH {_AREAS} SELECT image_id, count(*) FILTER (NOT h) AS unlabeled, round(coalesce(sum(area) FILTER (NOT h), 0) / 1600::DOUBLE, 6) AS area_share FROM known GROUP BY 1",
    "label_sizes": f"WITH {X.BOXES}, {_L} SELECT image_id, count(*) AS labels, round(avg(CASE WHEN font_px / 2.5::DOUBLE < 5 THEN 1::DOUBLE ELSE 0 END), 6) AS small_share, round(min(font_px / 2.5::DOUBLE), 6) AS least_pt FROM lab GROUP BY 1",
    "labels_on_ink": f"WITH {X.ALBUM_REGIONS}, {X.BOXES} SELECT p.image_id, box_id, count(*) AS inked FROM px p JOIN box b ON p.label = 3 AND {_IN} GROUP BY 1, 2",
    "gradient_slivers": f"""WITH {X.ALBUM_REGIONS}, {X.SLIVERS}, {X.BOXES}, i AS (SELECT p.image_id, p.x, p.y, box_id, CASE WHEN p.sliver THEN 1::DOUBLE ELSE 0 END AS hit FROM sliver p JOIN box b ON {_IN})
      SELECT image_id, share, worst FROM (SELECT image_id, round(avg(hit), 6) AS share FROM (SELECT DISTINCT image_id, x, y, hit FROM i) GROUP BY 1) JOIN (SELECT image_id, round(max(s), 6) AS worst FROM (SELECT image_id, avg(hit) AS s FROM i GROUP BY image_id, box_id) GROUP BY 1) USING (image_id)""",
    "tube_regions": f"""WITH {X.ALBUM_REGIONS}, {X.SLIVERS}, s AS (SELECT image_id, region_id, count(*) AS n, count(*) FILTER (g > 128) AS k FROM px WHERE region_id >= 0 GROUP BY 1, 2),
      t AS (SELECT px.image_id, round(avg(CASE WHEN coalesce(sliver, false) THEN 1::DOUBLE ELSE 0 END), 6) AS thin_ink FROM px LEFT JOIN sliver USING (image_id, x, y) WHERE px.g > 128 GROUP BY 1)
      SELECT image_id, count(*) FILTER (k * 2 >= n) AS tubes, any_value(thin_ink) AS thin_ink FROM s LEFT JOIN t USING (image_id) GROUP BY 1""",
    "equalized": f"""WITH {X.MOSAIC}, f AS (SELECT count(*) AS first FROM mosaic WHERE g = (SELECT min(g) FROM mosaic)), n AS (SELECT count(*) AS n FROM mosaic)
      SELECT image_id, x, y, CAST(round_even((upto - first) * 255 / (n - first)::DOUBLE, 0) AS INTEGER) AS value FROM (SELECT *, count(*) OVER (ORDER BY g RANGE UNBOUNDED PRECEDING) AS upto FROM mosaic), f, n""",
    "page_pixels": f"""WITH {X.MOSAIC}, c AS (SELECT *, CAST(round_even(255 - CASE WHEN x % 5 = 0 THEN 255 WHEN y % 7 = 0 THEN b ELSE 0 END * (255 - 89) / 255::DOUBLE, 0) AS INTEGER) AS paper FROM mosaic)
      SELECT image_id, x, y, paper, CAST((paper * CAST(round_even(255 - 0.4::DOUBLE * (255 - b), 0) AS INTEGER) + 127) // 255 AS INTEGER) AS b, CAST((paper * CAST(round_even(255 - 0.4::DOUBLE * (255 - g), 0) AS INTEGER) + 127) // 255 AS INTEGER) AS g,
        CAST((paper * CAST(round_even(255 - 0.4::DOUBLE * (255 - r), 0) AS INTEGER) + 127) // 255 AS INTEGER) AS r FROM c""",
    "completed_painting": f"""WITH {X.MOSAIC}, c AS (SELECT *, CASE WHEN x % 5 = 0 THEN 255 WHEN y % 7 = 0 THEN r ELSE 0 END / 255::DOUBLE AS k FROM mosaic)
      SELECT image_id, x, y, CAST(round_even(b + (40 - b) * k, 0) AS INTEGER) AS b, CAST(round_even(g + (40 - g) * k, 0) AS INTEGER) AS g, CAST(round_even(r + (40 - r) * k, 0) AS INTEGER) AS r FROM c""",
    "edge_vote": _vote_sql(),
}
