"""Queries of the region operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as N
from ..operators import regions as R
from ..operators import signal as S
from ..sources import fixtures as X

_R, _A = X.mosaic_regions, X.album_regions
#: Every two touching pixels once, by a join instead of windows.
_PAIRS = f"""{X.REGIONS}, step AS (SELECT * FROM (VALUES (1, 0), (0, 1), (1, 1), (-1, 1)) AS s(dx, dy)),
duo AS (SELECT p.image_id, p.x, p.y, p.region_id AS a, q.region_id AS b, p.label AS la, q.label AS lb, p.g AS ga, q.g AS gb, dx, dy
  FROM px p, step JOIN px q ON q.x = p.x + dx AND q.y = p.y + dy)"""
_EIGHT = f"""{X.REGIONS}, step AS (SELECT dx, dy FROM range(-1, 2) AS a(dx), range(-1, 2) AS b(dy) WHERE dx <> 0 OR dy <> 0),
around AS (SELECT p.image_id, p.x, p.y, p.region_id, p.label, p.b, p.g, p.r, dx, dy, q.region_id AS other, q.label AS lo, q.g AS go, q.x IS NULL AS off
  FROM px p CROSS JOIN step LEFT JOIN px q ON q.x = p.x + dx AND q.y = p.y + dy)"""


def _coarse(s, d):
    """The map with every two neighbouring blocks of columns joined."""
    return _R(s, d).withColumn("region_id", F.when(F.col("region_id") >= 0, F.floor(F.col("region_id") / 8) * 8 + F.col("label")).otherwise(-1))


def _halves(s, d):
    """The album's map with labels 0 and 1 as one."""
    return _A(s, d).withColumn("region_id", F.when(F.col("region_id") >= 0, F.col("region_id") - F.when(F.col("label") == 1, 1).otherwise(0)).otherwise(-1))


def _renumbered(s, d):
    return _R(s, d).withColumn("region_id", F.col("region_id") * 7 + 3)


QUERIES = {
    "region_bounds": lambda s, d: R.region_bounds(_R(s, d), "g > 150"),
    "region_census": lambda s, d: R.region_census(_R(s, d), "g > 150"),
    "contacts": lambda s, d: R.contacts(_R(s, d)),
    "contacts_sides": lambda s, d: R.contacts(_R(s, d), False),
    "strays": lambda s, d: R.strays(_R(s, d), R.contacts(_R(s, d), False)),
    "most_touched": lambda s, d: R.most_touched(_R(s, d)),
    "main_neighbor_ring": lambda s, d: R.ink_is_main_neighbor(_R(s, d)),
    "row_runs": lambda s, d: R.row_runs(_R(s, d)),
    "row_runs_suppliers": lambda s, d: R.row_runs(X.supplier_raster(s, d).withColumn("label", F.floor(F.col("b") / 64)), "label"),
    "crack_degree": lambda s, d: R.cracks(_R(s, d)),
    "boundary_pixels": lambda s, d: R.boundary_pixels(_R(s, d)),
    "same_color_boundary": lambda s, d: R.same_color_boundary(_R(s, d)),
    "compactness": lambda s, d: R.compactness(_R(s, d)),
    "thin_pixels": lambda s, d: R.thin_pixels(_R(s, d), "label = 3"),
    "claim_walls": lambda s, d: R.claim_walls(_R(s, d), "g > 150"),
    "settle_gaps": lambda s, d: R.settle_gaps(_R(s, d), "cast(floor(y / 16) * 13 + floor(x / 16) as int)", "case when label = 3 then -1 else label end", "cast(floor(y / 16) * 13 + floor(x / 16) as int) % 5 = 0"),
    "paint_gaps": lambda s, d: R.paint_gaps(_R(s, d), "g < 150"),
    "sliver_pixels": lambda s, d: R.slivers(_A(s, d), 1.5),
    "compactness_stats": lambda s, d: R.compactness_stats(_A(s, d)),
    "pocket_contacts": lambda s, d: R.pocket_contacts(_R(s, d), "region_id", "label = 3"),
    "regions_joined": lambda s, d: R.regions_joined(_R(s, d), _coarse(s, d)),
    "partition_identical": lambda s, d: R.same_partition(_R(s, d), _renumbered(s, d)),
    "partition_coarser": lambda s, d: R.same_partition(_R(s, d), _coarse(s, d)),
    "agreement": lambda s, d: R.same_partition(_A(s, d), _halves(s, d)).join(S.boundary_f1(R.boundary_pixels(_A(s, d)), R.boundary_pixels(_halves(s, d)), 1).select("image_id", F.col("f1").alias("boundary_f1")), "image_id"),
    "undersized_regions": lambda s, d: R.undersized(_R(s, d), 60),
    "paper_rings": lambda s, d: R.paper_rings(_R(s, d), "label = 3", "cast(floor(y / 16) * 13 + floor(x / 16) as int)"),
    "closed_breaks": lambda s, d: R.closed_breaks(_R(s, d), "g > 170", 3),
    "components4": lambda s, d: N.component_sizes(X.tile_map(s, d).withColumn("label", F.floor(F.col("label") / 4).cast("int"))),
    "components8": lambda s, d: N.component_sizes(X.tile_map(s, d).withColumn("label", F.floor(F.col("label") / 2).cast("int")), corners=True),
}


def _components(divisor: int, corners: bool) -> str:
    near = "abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1" if corners else "abs(p.x - q.x) + abs(p.y - q.y) = 1"
    return f"""WITH RECURSIVE {X.TILEMAP}, t AS (SELECT x, y, CAST(label // {divisor} AS INTEGER) AS value, CAST(y AS BIGINT) * 1048576 + x AS id FROM tile),
      e AS (SELECT p.id AS a, q.id AS b FROM t p JOIN t q ON p.value = q.value AND p.id <> q.id AND {near}),
      reach(a, b) AS (SELECT id, id FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
      SELECT 0 AS image_id, component, value, count(*) AS area FROM (SELECT a, min(b) AS component FROM reach GROUP BY a) JOIN t ON t.id = a GROUP BY 2, 3"""


ORACLE = {
    "region_bounds": f"WITH {X.REGIONS} SELECT image_id, region_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area, count(*) FILTER (g > 150) AS inside FROM px WHERE region_id >= 0 GROUP BY 1, 2",
    "region_census": f"""WITH {_EIGHT} SELECT image_id, region_id, count(DISTINCT y * 1000 + x) AS area, count(DISTINCT CASE WHEN NOT g > 150 THEN y * 1000 + x END) AS unprinted,
      coalesce(bool_or(other <> region_id AND other IS NOT NULL AND (other >= 0 OR true)), false) AS touched FROM around WHERE region_id >= 0 GROUP BY 1, 2""",
    "contacts": f"WITH {_PAIRS} SELECT DISTINCT image_id, least(a, b) AS a, greatest(a, b) AS b FROM duo WHERE a <> b",
    "contacts_sides": f"WITH {_PAIRS} SELECT DISTINCT image_id, least(a, b) AS a, greatest(a, b) AS b FROM duo WHERE a <> b AND dx * dy = 0",
    "strays": f"""WITH {_PAIRS}, ok AS (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM duo WHERE a <> b AND dx * dy = 0),
      bad AS (SELECT * FROM duo WHERE a <> b AND NOT EXISTS (SELECT 1 FROM ok WHERE lo = least(a, b) AND hi = greatest(a, b)))
      SELECT image_id, x, y FROM bad UNION SELECT image_id, x + dx, y + dy FROM bad""",
    "most_touched": f"""WITH {_EIGHT}, n AS (SELECT image_id, region_id, other AS neighbor, count(*) AS shared FROM around WHERE region_id >= 0 AND other >= 0 AND other <> region_id GROUP BY 1, 2, 3)
      SELECT image_id, region_id, neighbor, shared FROM (SELECT *, row_number() OVER (PARTITION BY image_id, region_id ORDER BY shared DESC, neighbor) AS k FROM n) WHERE k = 1""",
    "main_neighbor_ring": f"""WITH {_EIGHT}, ring AS (SELECT DISTINCT image_id, region_id, other, x + dx AS qx, y + dy AS qy FROM around WHERE region_id >= 0 AND other <> region_id),
      n AS (SELECT image_id, region_id, other, count(*) AS c FROM ring GROUP BY 1, 2, 3),
      o AS (SELECT image_id, region_id, CAST(coalesce(sum(c) FILTER (other < 0), 0) AS BIGINT) AS ink, coalesce(max(c) FILTER (other >= 0), 0) AS most FROM n GROUP BY 1, 2)
      SELECT *, ink > 0 AND ink >= most AS main FROM o""",
    "row_runs": f"""WITH {X.REGIONS} SELECT image_id, y, min(x) AS x0, max(x) + 1 AS x1, label AS value FROM (
      SELECT *, x - row_number() OVER (PARTITION BY y, label ORDER BY x) AS k FROM px) GROUP BY image_id, y, label, k""",
    "row_runs_suppliers": f"""WITH {X.SUPPLIERS} SELECT image_id, y, min(x) AS x0, max(x) + 1 AS x1, b // 64 AS value FROM (
      SELECT *, x - row_number() OVER (PARTITION BY image_id, y, b // 64 ORDER BY x) AS k FROM supp) GROUP BY image_id, y, b // 64, k""",
    "crack_degree": f"""WITH {X.REGIONS}, right_ AS (SELECT p.x + 1 AS j, p.y AS i FROM px p LEFT JOIN px q ON q.x = p.x + 1 AND q.y = p.y WHERE q.x IS NULL OR q.region_id <> p.region_id
        UNION ALL SELECT p.x, p.y FROM px p LEFT JOIN px q ON q.x = p.x - 1 AND q.y = p.y WHERE q.x IS NULL),
      down_ AS (SELECT p.x AS j, p.y + 1 AS i FROM px p LEFT JOIN px q ON q.x = p.x AND q.y = p.y + 1 WHERE q.x IS NULL OR q.region_id <> p.region_id
        UNION ALL SELECT p.x, p.y FROM px p LEFT JOIN px q ON q.x = p.x AND q.y = p.y - 1 WHERE q.x IS NULL)
      SELECT 0 AS image_id, i, j, count(*) AS degree FROM (SELECT i, j FROM right_ UNION ALL SELECT i + 1, j FROM right_ UNION ALL SELECT i, j FROM down_ UNION ALL SELECT i, j + 1 FROM down_) GROUP BY 2, 3""",
    "boundary_pixels": f"""WITH {X.REGIONS} SELECT p.image_id, p.x, p.y FROM px p WHERE EXISTS (SELECT 1 FROM px q WHERE q.x = p.x - 1 AND q.y = p.y AND q.region_id <> p.region_id)
      OR EXISTS (SELECT 1 FROM px q WHERE q.x = p.x AND q.y = p.y - 1 AND q.region_id <> p.region_id)""",
    "same_color_boundary": f"""WITH {_PAIRS}, c AS (SELECT *, CASE WHEN dx * dy = 0 THEN 1::DOUBLE ELSE sqrt(0.5::DOUBLE) END AS w FROM duo WHERE a <> b AND a >= 0 AND b >= 0)
      SELECT image_id, round(sum(CASE WHEN la = lb THEN w ELSE 0 END) / sum(w), 6) AS share FROM c GROUP BY 1""",
    "compactness": f"""WITH {_EIGHT}, c AS (SELECT image_id, region_id, count(*) // 8 AS area, sum(CASE WHEN off OR other <> region_id THEN CASE WHEN dx * dy = 0 THEN 1::DOUBLE ELSE sqrt(0.5::DOUBLE) END ELSE 0 END) AS crossed
        FROM around WHERE region_id >= 0 GROUP BY 1, 2)
      SELECT image_id, region_id, area, round(least(1, 4 * pi() * area / pow(pi() / 8 * crossed, 2)), 6) AS compactness FROM c""",
    "thin_pixels": f"""WITH {_EIGHT}, w AS (SELECT image_id, x, y, label = 3 AS ink, abs(dx) AS ax, CASE WHEN dx * dy < 0 THEN -1 ELSE 1 END * abs(dy) AS ay, bool_and(NOT off AND (lo = 3) <> (label = 3)) AS thin
        FROM around GROUP BY 1, 2, 3, 4, 5, 6)
      SELECT DISTINCT image_id, x, y, ink FROM w WHERE thin""",
    "claim_walls": f"""WITH {_PAIRS}, c AS (SELECT *, CASE WHEN (ga > 150) <> (gb > 150) THEN ga > 150 ELSE a > b END AS first FROM duo WHERE a <> b AND a >= 0 AND b >= 0)
      SELECT DISTINCT image_id, CASE WHEN first THEN x ELSE x + dx END AS x, CASE WHEN first THEN y ELSE y + dy END AS y FROM c""",
    "settle_gaps": f"""WITH {X.REGIONS}, v AS (SELECT image_id, CAST(y // 16 * 13 + x // 16 AS INTEGER) AS piece, label AS claim, count(*) AS pixels FROM px WHERE label <> 3 AND (y // 16 * 13 + x // 16) % 5 <> 0 GROUP BY 1, 2, 3)
      SELECT image_id, piece, claim, pixels FROM (SELECT *, row_number() OVER (PARTITION BY image_id, piece ORDER BY pixels DESC, claim) AS k FROM v) WHERE k = 1""",
    "pocket_contacts": f"""WITH {_EIGHT} SELECT image_id, region_id AS pocket, count(*) FILTER (off OR other <> region_id) AS contacts, count(*) FILTER (NOT off AND other <> region_id AND lo = 3) AS walls
      FROM around WHERE region_id >= 0 GROUP BY 1, 2""",
    "regions_joined": f"""WITH {X.REGIONS} SELECT image_id, CAST(region_id // 8 * 8 + label AS BIGINT) AS region_id, count(DISTINCT region_id) AS parts FROM px WHERE region_id >= 0 GROUP BY 1, 2 HAVING count(DISTINCT region_id) > 1""",
    "partition_identical": f"WITH {X.REGIONS} SELECT image_id, count(DISTINCT region_id) = count(DISTINCT region_id * 7 + 3) AS identical FROM px GROUP BY 1",
    "partition_coarser": f"""WITH {X.REGIONS}, c AS (SELECT image_id, region_id AS a, CASE WHEN region_id >= 0 THEN region_id // 8 * 8 + label ELSE -1 END AS b FROM px)
      SELECT image_id, count(DISTINCT a) = count(DISTINCT (a, b)) AND count(DISTINCT b) = count(DISTINCT (a, b)) AS identical FROM c GROUP BY 1""",
    "agreement": f"""WITH {X.ALBUM_REGIONS}, m AS (SELECT image_id, x, y, region_id AS a, CASE WHEN region_id >= 0 AND label = 1 THEN region_id - 1 ELSE region_id END AS b FROM px),
      e AS (SELECT p.image_id, p.x, p.y, bool_or(q.a <> p.a) AS ea, bool_or(q.b <> p.b) AS eb FROM m p JOIN m q ON q.image_id = p.image_id AND ((q.x = p.x - 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y - 1)) GROUP BY 1, 2, 3),
      n AS (SELECT p.image_id, p.x, p.y, any_value(p.ea) AS ea, any_value(p.eb) AS eb, bool_or(q.ea) AS na, bool_or(q.eb) AS nb FROM e p JOIN e q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3),
      f AS (SELECT image_id, round(avg(CASE WHEN nb THEN 1::DOUBLE ELSE 0 END) FILTER (ea), 6) AS p, round(avg(CASE WHEN na THEN 1::DOUBLE ELSE 0 END) FILTER (eb), 6) AS r FROM n GROUP BY 1),
      k AS (SELECT image_id, count(DISTINCT a) = count(DISTINCT (a, b)) AND count(DISTINCT b) = count(DISTINCT (a, b)) AS identical FROM m GROUP BY 1)
      SELECT image_id, identical, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5) AS boundary_f1 FROM k JOIN f USING (image_id)""",
    "undersized_regions": f"""WITH {_EIGHT}, c AS (SELECT image_id, region_id, count(DISTINCT y * 1000 + x) AS area, bool_or(other <> region_id) AS touched FROM around WHERE region_id >= 0 GROUP BY 1, 2)
      SELECT image_id, count(*) FILTER (area < 60 AND touched) AS undersized FROM c GROUP BY 1""",
    "paper_rings": f"""WITH {_EIGHT} SELECT image_id, CAST(y // 16 * 13 + x // 16 AS INTEGER) AS piece, min(other) AS least, max(other) AS most FROM around WHERE label = 3 AND NOT off AND lo <> 3 GROUP BY 1, 2""",
    "closed_breaks": f"""WITH {X.REGIONS}, m AS (SELECT x, y, g > 170 AS m FROM px),
      seg AS (SELECT p.x, p.y, l.dx, l.dy, l.n FROM m p, (VALUES (1, 0, 3), (0, 1, 3), (1, 1, 2), (-1, 1, 2)) AS l(dx, dy, n) WHERE p.m),
      br AS (SELECT s.x, s.y, s.dx, s.dy, k FROM seg s, range(2, 5) AS r(k) JOIN m q ON q.x = s.x + k * s.dx AND q.y = s.y + k * s.dy AND q.m WHERE k <= s.n + 1)
      SELECT 0 AS image_id, x, y FROM m WHERE m UNION SELECT 0, CAST(x + i * dx AS INTEGER), CAST(y + i * dy AS INTEGER) FROM br, range(1, 4) AS t(i) WHERE i < k""",
    "components4": _components(4, False),
    "components8": _components(2, True),
    "paint_gaps": f"WITH {_PAIRS} SELECT DISTINCT image_id, x, y FROM duo WHERE dx * dy = 0 AND ga < 150 AND gb < 150 AND a <> b",
    "sliver_pixels": f"WITH {X.ALBUM_REGIONS}, {X.SLIVERS} SELECT image_id, x, y, sliver FROM sliver",
    "compactness_stats": f"""WITH {X.ALBUM_REGIONS}, step AS (SELECT dx, dy FROM range(-1, 2) AS a(dx), range(-1, 2) AS b(dy) WHERE dx <> 0 OR dy <> 0),
      c AS (SELECT p.image_id, p.region_id, count(*) // 8 AS area, sum(CASE WHEN q.x IS NULL OR q.region_id <> p.region_id THEN CASE WHEN dx * dy = 0 THEN 1::DOUBLE ELSE sqrt(0.5::DOUBLE) END ELSE 0 END) AS crossed
        FROM px p CROSS JOIN step LEFT JOIN px q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy WHERE p.region_id >= 0 GROUP BY 1, 2),
      k AS (SELECT image_id, round(least(1, 4 * pi() * area / pow(pi() / 8 * crossed, 2)), 6) AS v FROM c)
      SELECT image_id, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10 FROM k GROUP BY 1""",
}
