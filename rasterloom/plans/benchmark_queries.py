"""Queries of the benchmark analytics and of the box operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metric_catalog import metrics, sql_metrics
from ..operators import benchmark as B
from ..operators import boxes as O
from ..sources.files import CATEGORIES
from ..sources import fixtures as X

_Q = f"""{X.QUALITY}, {sql_metrics()},
v AS (SELECT q.*, m.job, m.better, m.ideal, m.limit_, m.relative_to, m.where_, m.relative, m.sigma_preview, m.sigma_export,
    CASE WHEN m.relative_to IS NULL THEN 0 ELSE r.value END AS base, CASE WHEN m.where_ IS NULL THEN 1 ELSE g.value END AS guard
  FROM quality q JOIN metric m USING (metric) LEFT JOIN quality r ON r.result_set = q.result_set AND r.case_id = q.case_id AND r.metric = m.relative_to
    LEFT JOIN quality g ON g.result_set = q.result_set AND g.case_id = q.case_id AND g.metric = m.where_ WHERE q.value IS NOT NULL),
missed AS (SELECT result_set, case_id, image, preset, size, metric, job, value,
    CASE WHEN ideal IS NOT NULL THEN abs(value - ideal) > limit_ + base WHEN better = 'higher' THEN value < limit_ + base ELSE value > limit_ + base END AS miss
  FROM v WHERE limit_ IS NOT NULL AND base IS NOT NULL AND coalesce(guard, 0) <> 0),
ch AS (SELECT a.case_id, a.metric, a.value AS before, b.value AS after,
    CASE WHEN a.relative THEN CASE WHEN a.value <> 0 THEN w / abs(a.value) END ELSE w END AS worse, CASE WHEN b.size = 'export' THEN b.sigma_export ELSE b.sigma_preview END AS sigma
  FROM (SELECT a.*, b.value AS bv, CASE WHEN a.ideal IS NOT NULL THEN abs(b.value - a.ideal) - abs(a.value - a.ideal) WHEN a.better = 'higher' THEN a.value - b.value ELSE b.value - a.value END AS w
      FROM v a JOIN v b ON a.case_id = b.case_id AND a.metric = b.metric AND a.result_set = 'base' AND b.result_set = 'cand') a
  JOIN v b ON a.case_id = b.case_id AND a.metric = b.metric AND b.result_set = 'cand')"""


def _args(s, d):
    return X.quality(s, d), metrics(s)


def _worse(s, d):
    """The quality with every value of the candidate 8 % larger."""
    return X.quality(s, d).withColumn("value", F.when(F.col("result_set") == "cand", F.col("value") * 1.08).otherwise(F.col("value")))


def _stages(s, d):
    stage = lambda name, e: (F.lit(name), F.expr(e))
    return X.case_stats(s, d).select("result_set", "case_id", F.create_map(*stage("quantize", "q / 100"), *stage("regions", "n / 1000"), *stage("render", "d + t")).alias("stages"))


def _shifted(s, d):
    return X.boxes(s, d).select("image_id", F.col("box_id"), (F.col("x") + F.col("box_id") % 4).alias("x"), (F.col("y") + F.col("box_id") % 3).alias("y"), "w", "h")


def _few(s, d):
    """A small box in the place of every box."""
    return X.boxes(s, d).select("image_id", "box_id", (F.col("x") / 2).cast("int").alias("x"), (F.col("y") / 2).cast("int").alias("y"), F.lit(2).alias("w"), F.lit(2).alias("h"))


def _points(s, d):
    """Points from the customers."""
    from ..session import table

    return table(s, d, "customer").select(F.floor(F.col("c_custkey") / 200).cast("int").alias("image_id"), F.col("c_custkey").alias("point_id"), (F.col("c_custkey") * 37 % 401 / 10).alias("x"), (F.col("c_custkey") * 53 % 403 / 10).alias("y"))


def _quads(s, d):
    b = X.boxes(s, d)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return b.select("image_id", F.col("box_id").alias("quad_id"), F.array(at(x, y + 1), at(x + w, y), at(x + w + 1, y + h), at(x + 1, y + h + 1)).alias("quad"))


_POINTS = "pt AS (SELECT CAST(c_custkey // 200 AS INTEGER) AS image_id, c_custkey AS point_id, (c_custkey * 37 % 401) / 10::DOUBLE AS x, (c_custkey * 53 % 403) / 10::DOUBLE AS y FROM customer)"


def _numbers(s, d):
    """The boxes of numbers."""
    return X.boxes(s, d).select("image_id", "box_id", (F.col("x") + F.col("box_id") % 11).alias("x"), (F.col("y") + F.col("box_id") % 7).alias("y"), F.lit(2).alias("w"), F.lit(1).alias("h"))

QUERIES = {
    "target_misses": lambda s, d: B.target_misses(*_args(s, d)).select("result_set", "case_id", "metric", F.round("value", 10).alias("value"), "miss"),
    "meets_targets": lambda s, d: B.meets_targets(*_args(s, d)).select("result_set", "case_id", "job", "targets", "missed", "met"),
    "changes": lambda s, d: B.changes(*_args(s, d)).select("case_id", "metric", F.round("worse", 6).alias("worse"), "sigma"),
    "regressions": lambda s, d: B.regressions(_worse(s, d), metrics(s), X.categories(s, d)),
    "target_changes": lambda s, d: B.target_changes(*_args(s, d)),
    "noise_sigma": lambda s, d: B.noise_sigmas(*_args(s, d), X.edges(s, d)),
    "category_means": lambda s, d: B.category_means(X.quality(s, d), X.categories(s, d)),
    "met_counts": lambda s, d: B.met_counts(*_args(s, d), X.categories(s, d)),
    "speedup_geomean": lambda s, d: B.speedups(X.case_stats(s, d).select("result_set", "case_id", "preset", (F.col("q") / 10).alias("seconds"))),
    "stage_totals": lambda s, d: B.stage_totals(_stages(s, d)),
    "drift_notes": lambda s, d: B.drift_notes(X.quality(s, d)),
    "quality_table": lambda s, d: B.quality_table(*_args(s, d)),
    "case_flags": lambda s, d: B.case_flags(_worse(s, d), metrics(s)),
    "misses": lambda s, d: B.misses(*_args(s, d)),
    "category_order": lambda s, d: B.category_order(X.categories(s, d), CATEGORIES),
    "sigma_overrides": lambda s, d: B.sigma_overrides(metrics(s).where("sigma_preview is not null").select(F.concat(F.lit(" "), "metric", F.lit(" = "), (F.length("metric") / 8).cast("string")).alias("item")), metrics(s)),
    "box_mask": lambda s, d: O.box_mask(X.album(s, d), X.boxes(s, d)),
    "overlapping_boxes": lambda s, d: O.overlaps(X.boxes(s, d)),
    "overlapping_labels": lambda s, d: O.overlapping(_numbers(s, d)),
    "labels_on_boxes": lambda s, d: O.labels_on_boxes(_numbers(s, d), X.boxes(s, d)),
    "found_recall": lambda s, d: O.found_recall(_shifted(s, d), X.boxes(s, d), 0.5, 0.5),
    "found_boxes_match": lambda s, d: O.best_matches(_shifted(s, d), X.boxes(s, d), 0.5, 0.5),
    "face_regions": lambda s, d: O.box_regions(X.album_regions(s, d), _few(s, d)),
    "region_density": lambda s, d: O.region_density(X.album_regions(s, d), _few(s, d), 4.0),
    "subject_detail": lambda s, d: O.density_ratio(X.album_regions(s, d), _few(s, d)),
    "scaled_boxes": lambda s, d: O.scaled_boxes(X.boxes(s, d), 1.5, 0.75, 55, 28),
    "points_in_quads": lambda s, d: O.in_quads(_points(s, d), _quads(s, d)),
    "near_another": lambda s, d: O.near_another(_points(s, d), 2.0),
    "outline_pixels": lambda s, d: O.outline_pixels(_quads(s, d).select(F.col("quad_id").alias("outline_id"), F.col("quad").alias("pts")), 200, 160),
}

_W = _Q.replace("quality AS (", "quality0 AS (", 1).replace("), cat AS (", "), quality AS (SELECT * EXCLUDE (value), CASE WHEN result_set = 'cand' THEN value * 1.08::DOUBLE ELSE value END AS value FROM quality0), cat AS (", 1)
_IN = f"{X.ALBUM}, {X.BOXES}, hit AS (SELECT DISTINCT m.image_id, m.x, m.y FROM album m JOIN box b ON b.image_id = m.image_id AND b.x <= m.x + 0.5 AND m.x + 0.5 < b.x + b.w AND b.y <= m.y + 0.5 AND m.y + 0.5 < b.y + b.h)"
_FEW = f"{X.ALBUM_REGIONS}, {X.BOXES}, few AS (SELECT image_id, x // 2 AS x, y // 2 AS y FROM box), hit AS (SELECT DISTINCT m.image_id, m.x, m.y FROM album m JOIN few b ON b.image_id = m.image_id AND m.x - b.x BETWEEN 0 AND 1 AND m.y - b.y BETWEEN 0 AND 1)"
_COVERED = f"{_FEW}, covered AS (SELECT p.image_id, region_id, count(*) AS area, count(hit.x) AS covered FROM px p LEFT JOIN hit USING (image_id, x, y) WHERE region_id >= 0 GROUP BY 1, 2)"
_NUMBERS = f"{X.BOXES}, num AS (SELECT image_id, box_id, x + box_id % 11 AS x, y + box_id % 7 AS y, 2 AS w, 1 AS h FROM box)"
_MEET = "least(p.x + p.w, q.x + q.w) > greatest(p.x, q.x) AND least(p.y + p.h, q.y + q.h) > greatest(p.y, q.y)"
_FOUND = f"""{X.BOXES}, f AS (SELECT image_id, box_id, x + box_id % 4 AS x, y + box_id % 3 AS y, w, h FROM box),
      o AS (SELECT p.image_id, p.box_id, q.box_id AS match, greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) AS m, p.w * p.h AS own, q.w * q.h AS other FROM box p JOIN f q USING (image_id)),
      r AS (SELECT image_id, box_id, match, round(m / own::DOUBLE, 9) AS cover, round(m / other::DOUBLE, 9) AS share, round(m / (own + other - m)::DOUBLE, 9) AS iou FROM o WHERE m > 0),
      k AS (SELECT *, cover >= 0.5::DOUBLE AND share >= 0.5::DOUBLE AS found, row_number() OVER (PARTITION BY box_id ORDER BY cover >= 0.5::DOUBLE AND share >= 0.5::DOUBLE DESC, iou DESC, match) AS k FROM r),
      best AS (SELECT box.image_id, box.box_id, match, coalesce(cover, 0) AS cover, coalesce(share, 0) AS share, coalesce(iou, 0) AS iou, coalesce(found, false) AS found FROM box LEFT JOIN k ON k.box_id = box.box_id AND k = 1)"""
_SIDES = "[(q[2].x - q[1].x) * (p.y - q[1].y) - (q[2].y - q[1].y) * (p.x - q[1].x), (q[3].x - q[2].x) * (p.y - q[2].y) - (q[3].y - q[2].y) * (p.x - q[2].x), (q[4].x - q[3].x) * (p.y - q[3].y) - (q[4].y - q[3].y) * (p.x - q[3].x), (q[1].x - q[4].x) * (p.y - q[4].y) - (q[1].y - q[4].y) * (p.x - q[4].x)]"
_QUADS = "quad AS (SELECT image_id, box_id AS quad_id, [{'x': x::DOUBLE, 'y': y::DOUBLE + 1}, {'x': x::DOUBLE + w, 'y': y::DOUBLE}, {'x': x::DOUBLE + w + 1, 'y': y::DOUBLE + h}, {'x': x::DOUBLE + 1, 'y': y::DOUBLE + h + 1}] AS q FROM box)"

ORACLE = {
    "target_misses": f"WITH {_Q} SELECT result_set, case_id, metric, round(value, 10) AS value, miss FROM missed",
    "meets_targets": f"WITH {_Q} SELECT result_set, case_id, job, count(*) AS targets, count(*) FILTER (miss) AS missed, NOT bool_or(miss) AS met FROM missed GROUP BY 1, 2, 3",
    "changes": f"WITH {_Q} SELECT case_id, metric, round(worse, 6) AS worse, sigma FROM ch",
    "regressions": f"""WITH {_W}, e AS (SELECT metric, category AS "group", worse, sigma FROM ch JOIN cat USING (case_id) UNION ALL SELECT metric, 'all', worse, sigma FROM ch),
      s AS (SELECT metric, "group", count(*) AS cases, avg(worse) AS change, 3 * sqrt(sum(sigma * sigma)) / count(*) AS allowed FROM e WHERE worse IS NOT NULL AND sigma IS NOT NULL GROUP BY 1, 2)
      SELECT metric, "group", cases, round(change, 6) AS change, round(allowed, 6) AS allowed FROM s WHERE change > allowed""",
    "target_changes": f"""WITH {_Q}, p AS (SELECT coalesce(a.metric, b.metric) AS metric, a.miss AS x, b.miss AS y FROM (SELECT * FROM missed WHERE result_set = 'base') a
        FULL JOIN (SELECT * FROM missed WHERE result_set = 'cand') b ON a.case_id = b.case_id AND a.metric = b.metric)
      SELECT metric, count(*) FILTER (x) AS before_missed, count(x) AS before_scored, count(*) FILTER (y) AS after_missed, count(y) AS after_scored, count(*) FILTER (NOT x AND y) AS newly_missed, count(*) FILTER (x AND NOT y) AS newly_met FROM p GROUP BY 1""",
    "noise_sigma": f"""WITH {_Q}, o AS (SELECT * FROM (SELECT q.image, q.preset, e.edge, q.metric, q.value, row_number() OVER (PARTITION BY q.image, q.preset, e.edge, q.metric ORDER BY q.result_set) AS k
        FROM quality q JOIN edge e USING (result_set, case_id) WHERE q.value IS NOT NULL) WHERE k = 1),
      c AS (SELECT a.metric, CASE WHEN m.ideal IS NOT NULL THEN abs(b.value - m.ideal) - abs(a.value - m.ideal) ELSE b.value - a.value END / CASE WHEN m.relative THEN abs(a.value) ELSE 1 END AS c
        FROM o a JOIN o b ON a.image = b.image AND a.preset = b.preset AND a.metric = b.metric AND b.edge > a.edge AND b.edge - a.edge <= 0.01::DOUBLE * a.edge JOIN metric m ON m.metric = a.metric AND m.sigma_preview IS NOT NULL)
      SELECT metric, count(*) AS pairs, round(sqrt(avg(c * c)), 6) AS sigma FROM c GROUP BY 1""",
    "category_means": f"""WITH {_Q}, done AS (SELECT * FROM quality WHERE case_id IN (SELECT case_id FROM stats GROUP BY 1 HAVING count(DISTINCT result_set) = 2))
      SELECT result_set, category, metric, count(value) AS cases, round(avg(value), 6) AS mean FROM done JOIN cat USING (case_id) GROUP BY 1, 2, 3
      UNION ALL SELECT result_set, NULL, metric, count(value), round(avg(value), 6) FROM done GROUP BY 1, 3""",
    "met_counts": f"""WITH {_Q}, j AS (SELECT result_set, case_id, job, NOT bool_or(miss) AS met FROM missed GROUP BY 1, 2, 3), e AS (SELECT category, job, result_set, met FROM j JOIN cat USING (case_id) UNION ALL SELECT 'all', job, result_set, met FROM j)
      SELECT category, job, result_set, count(*) FILTER (met) AS met, count(*) AS scored FROM e GROUP BY 1, 2, 3""",
    "speedup_geomean": f"""WITH {X.STATS} SELECT a.preset, count(*) AS cases, round(exp(avg(ln((a.q / 10) / (b.q / 10)))), 6) AS geomean, round(max(b.q / 10), 6) AS slowest
      FROM stats a JOIN stats b ON a.case_id = b.case_id AND a.result_set = 'base' AND b.result_set = 'cand' GROUP BY 1""",
    "stage_totals": f"""WITH {X.STATS}, done AS (SELECT * FROM stats WHERE case_id IN (SELECT case_id FROM stats GROUP BY 1 HAVING count(DISTINCT result_set) = 2)),
      e AS (SELECT result_set, 'quantize' AS stage, sum(q / 100) AS s FROM done GROUP BY 1 UNION ALL SELECT result_set, 'regions', sum(n / 1000) FROM done GROUP BY 1 UNION ALL SELECT result_set, 'render', sum(d + t) FROM done GROUP BY 1)
      SELECT result_set, stage, round(s, 6) AS seconds, round(s / sum(s) OVER (PARTITION BY result_set), 6) AS share FROM e""",
    "drift_notes": f"WITH {X.STATS} SELECT a.case_id, a.n AS before, b.n AS after FROM stats a JOIN stats b ON a.case_id = b.case_id AND a.result_set = 'base' AND b.result_set = 'cand' WHERE abs(b.n - a.n) / a.n > 0.15::DOUBLE",
    "quality_table": f"""WITH {_Q} SELECT b.case_id, b.metric, round(a.value, 10) AS before, round(b.value, 10) AS after, round(b.value - a.value, 10) AS delta FROM (SELECT * FROM quality WHERE result_set = 'cand') b
      LEFT JOIN (SELECT * FROM quality WHERE result_set = 'base') a ON a.case_id = b.case_id AND a.metric = b.metric WHERE b.metric IN (SELECT metric FROM metric)""",
    "box_mask": f"WITH {_IN} SELECT * FROM hit",
    "overlapping_boxes": f"""WITH {X.BOXES}, o AS (SELECT p.image_id, p.box_id AS a, q.box_id AS b, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x) AS w, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y) AS h FROM box p JOIN box q ON p.image_id = q.image_id AND p.box_id < q.box_id)
      SELECT image_id, a, b, w * h AS area FROM o WHERE w > 0 AND h > 0""",
    "overlapping_labels": f"WITH {_NUMBERS} SELECT image_id, count(*) AS boxes, count(*) FILTER (EXISTS (SELECT 1 FROM num q WHERE q.image_id = p.image_id AND q.box_id <> p.box_id AND {_MEET})) AS overlapping FROM num p GROUP BY 1",
    "labels_on_boxes": f"WITH {_NUMBERS} SELECT image_id, count(*) AS labels, count(*) FILTER (EXISTS (SELECT 1 FROM box q WHERE q.image_id = p.image_id AND {_MEET})) AS on_boxes FROM num p GROUP BY 1",
    "found_boxes_match": f"WITH {_FOUND} SELECT * FROM best",
    "found_recall": f"""WITH {_FOUND}, s AS (SELECT f.image_id, count(*) AS stray FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.match = f.box_id AND share >= 0.5::DOUBLE) GROUP BY 1)
      SELECT image_id, annotated, recall, coalesce(stray, 0) AS stray FROM (SELECT image_id, count(*) AS annotated, round(avg(CASE WHEN found THEN 1::DOUBLE ELSE 0 END), 6) AS recall FROM best GROUP BY 1) LEFT JOIN s USING (image_id)""",
    "face_regions": f"WITH {_COVERED} SELECT *, covered * 2 > area AS mostly FROM covered",
    "region_density": f"""WITH {_COVERED}, n AS (SELECT image_id, count(*) AS inside FROM hit GROUP BY 1)
      SELECT image_id, count(*) FILTER (covered * 2 > area) AS mostly, round(count(*) FILTER (covered * 2 > area) / (any_value(inside) / 160000::DOUBLE), 6) AS per_dm2, count(*) FILTER (covered = 0) AS background FROM covered LEFT JOIN n USING (image_id) GROUP BY 1""",
    "subject_detail": f"""WITH {_COVERED}, s AS (SELECT image_id, sum(covered / area::DOUBLE) / nullif(sum(covered), 0) AS i, sum(1 - covered / area::DOUBLE) / nullif(sum(area - covered), 0) AS o FROM covered GROUP BY 1)
      SELECT image_id, round(i, 9) AS inside, round(o, 9) AS outside, round(i / nullif(o, 0), 6) AS ratio FROM s""",
    "case_flags": f"""WITH {_W}, n AS (SELECT case_id, metric || ' worse' AS note FROM ch WHERE worse > 3 * sigma
        UNION ALL SELECT case_id, 'regions drifted' FROM ch WHERE metric = 'regions' AND before <> 0 AND abs(after - before) / before > 0.15::DOUBLE)
      SELECT c.case_id, coalesce(any_value(f.flags), 'ok') AS flags FROM (SELECT DISTINCT case_id FROM ch) c LEFT JOIN (SELECT case_id, string_agg(note, ', ' ORDER BY note) AS flags FROM n GROUP BY 1) f USING (case_id) GROUP BY 1""",
    "misses": f"""WITH {_Q}, c AS (SELECT result_set, case_id, concat(count(*) FILTER (miss), '/', count(*)) AS cell FROM missed GROUP BY 1, 2)
      SELECT a.case_id, CASE WHEN coalesce(b.cell, a.cell) = a.cell THEN a.cell ELSE concat(b.cell, ' -> ', a.cell) END AS misses FROM (SELECT * FROM c WHERE result_set = 'cand') a LEFT JOIN (SELECT * FROM c WHERE result_set = 'base') b USING (case_id)""",
    "category_order": f"""WITH {X.QUALITY}, o AS (SELECT DISTINCT category, coalesce(list_position({list(CATEGORIES)!r}, category), 99) AS k FROM cat) SELECT CAST(row_number() OVER (ORDER BY k, category) AS INTEGER) AS place, category FROM o""",
    "sigma_overrides": f"WITH {sql_metrics()} SELECT metric, length(metric) / 8::DOUBLE AS sigma FROM metric WHERE sigma_preview IS NOT NULL",
    "scaled_boxes": f"""WITH {X.BOXES}, s AS (SELECT image_id, box_id, greatest(0, floor(x * 1.5::DOUBLE + 1e-9::DOUBLE)) AS x0, greatest(0, floor(y * 0.75::DOUBLE + 1e-9::DOUBLE)) AS y0,
      least(55, ceil((x + w) * 1.5::DOUBLE - 1e-9::DOUBLE)) AS x1, least(28, ceil((y + h) * 0.75::DOUBLE - 1e-9::DOUBLE)) AS y1 FROM box)
      SELECT image_id, box_id, CAST(x0 AS INTEGER) AS x, CAST(y0 AS INTEGER) AS y, CAST(x1 - x0 AS INTEGER) AS w, CAST(y1 - y0 AS INTEGER) AS h FROM s""",
    "points_in_quads": f"""WITH {X.BOXES}, {_POINTS}, {_QUADS}, s AS (SELECT p.image_id, point_id, quad_id, {_SIDES} AS v FROM pt p JOIN quad USING (image_id))
      SELECT image_id, point_id, quad_id FROM s WHERE list_min(v) >= 0 OR list_max(v) <= 0""",
    "near_another": f"WITH {_POINTS} SELECT DISTINCT p.image_id, p.point_id FROM pt p JOIN pt q ON p.image_id = q.image_id AND p.point_id <> q.point_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) < 4",
    "outline_pixels": f"""WITH {X.BOXES}, {_QUADS}, inside AS (SELECT quad_id AS outline_id, y, x FROM quad, range(160) AS r(y), range(200) AS c(x), (SELECT 1)
        WHERE x + 1 >= q[1].x AND x <= q[3].x + 1 AND y >= q[2].y - 1 AND y <= q[4].y + 1 AND (
        SELECT count(*) % 2 = 1 FROM (VALUES (1, 2), (2, 3), (3, 4), (4, 1)) AS e(i, j)
        WHERE least(q[i].y, q[j].y) <= y + 0.5::DOUBLE AND y + 0.5::DOUBLE < greatest(q[i].y, q[j].y) AND q[i].x + (y + 0.5::DOUBLE - q[i].y) * (q[j].x - q[i].x) / (q[j].y - q[i].y) <= x + 0.5::DOUBLE)),
      g AS (SELECT *, x - row_number() OVER (PARTITION BY outline_id, y ORDER BY x) AS k FROM inside)
      SELECT outline_id, CAST(y AS INTEGER) AS y, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) + 1 AS INTEGER) AS x1 FROM g GROUP BY outline_id, y, k""",
}
