import itertools

import numpy as np
import pytest

from rasterloom.functions import color
from rasterloom.operators import colors, components, regions

# Pairs of Lab colours with their CIEDE2000 difference, from Sharma, Wu and Dalal (2005).
SHARMA = (
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 3.1571, -77.2803), (50.0, 0.0, -82.7485), 2.8615), ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0),
    ((50.0, 2.5, 0.0), (50.0, 0.0, -2.5), 4.3065), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((22.7233, 20.0904, -46.694), (23.0331, 14.973, -42.5619), 2.0373), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
)


def test_published_color_differences(spark):
    rows = [(i, p, q, d) for i, (p, q, d) in enumerate(SHARMA)]
    df = spark.createDataFrame(rows, "i int, p struct<L:double,a:double,b:double>, q struct<L:double,a:double,b:double>, want double")
    for r in color.de00(df, "p", "q").collect():
        assert abs(r["de00"] - r["want"]) < 1e-4
    for r in color.de00(df, "q", "p").collect():
        assert abs(r["de00"] - r["want"]) < 1e-4


def test_grays_have_no_chroma(spark):
    df = color.with_lab(spark.range(0, 256).selectExpr("cast(id as int) as b", "cast(id as int) as g", "cast(id as int) as r"))
    rows = [r["lab"] for r in df.orderBy("b").collect()]
    assert all(abs(x["a"]) < 1e-9 and abs(x["b"]) < 1e-9 for x in rows) and abs(rows[255]["L"] - 100) < 1e-9 and rows[0]["L"] < 1e-9
    assert all(p["L"] < q["L"] for p, q in itertools.pairwise(rows))


def flood(grid, corners):
    """Components of a grid by plain flood filling, as sets of pixels."""
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    left, out = {(y, x) for y in range(grid.shape[0]) for x in range(grid.shape[1])}, set()
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            at = todo.pop()
            if at in left:
                left.discard(at)
                seen.add(at)
                todo += [(at[0] + dy, at[1] + dx) for dy, dx in steps if (at[0] + dy, at[1] + dx) in left and grid[at[0] + dy, at[1] + dx] == grid[at]]
        out.add(frozenset(seen))
    return out


@pytest.mark.parametrize("corners", [False, True])
def test_components_equal_flood_fill(spark, corners):
    rng = np.random.default_rng(8)
    grid = rng.integers(0, 2, (24, 70))
    grid[::2, 3:60] = 1
    px = spark.createDataFrame([(0, x, y, int(grid[y, x])) for y in range(24) for x in range(70)], "image_id int, x int, y int, label int")
    got = {}
    for r in components.label_components(px, corners=corners).collect():
        got.setdefault(r["component"], set()).add((r["y"], r["x"]))
    assert {frozenset(v) for v in got.values()} == flood(grid, corners)


def test_pictures_do_not_touch_each_other(spark):
    rows = [(i, x, y, (x + i) % 2) for i in range(3) for x in range(4) for y in range(3)]
    px = spark.createDataFrame(rows, "image_id int, x int, y int, region_id int")
    assert {(r["image_id"], r["a"], r["b"]) for r in regions.contacts(px).collect()} == {(i, 0, 1) for i in range(3)}
    assert regions.contacts(px.limit(0)).count() == 0


def test_a_palette_is_bounded(spark):
    big = spark.range(0, 65).selectExpr("cast(id as int) as color", "0 as b", "0 as g", "0 as r")
    with pytest.raises(ValueError, match="64"):
        colors.with_colors(big)


def test_a_tall_u_is_one_component(spark):
    px = spark.createDataFrame([(0, x, y, int(x != 1 or y == 299)) for y in range(300) for x in range(3)], "image_id int, x int, y int, label int")
    got = {(r["value"], r["component"]): r["area"] for r in components.component_sizes(px).collect()}
    assert got == {(1, 0): 601, (0, 1): 299}
