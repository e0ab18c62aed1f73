import json

import numpy as np

from rasterloom.operators import brush as B
from rasterloom.operators import grids as G
from rasterloom.operators import kernels as K
from rasterloom.operators import pictures
from rasterloom.sources import files


def blobs(seed, shape, colors):
    noise = np.random.default_rng(seed).random(shape)
    for _ in range(2):
        noise = sum(K.shifted(noise, dy, dx, 0.5) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9
    return np.searchsorted(np.quantile(noise, np.linspace(0, 1, colors + 1)[1:-1]), noise)


def test_distances_equal_brute_force():
    for seed in range(4):
        inside = blobs(seed, (17, 23), 3) > 0
        padded = np.pad(inside, 1)
        outside = np.argwhere(~padded)
        want = [[min((y + 1 - a) ** 2 + (x + 1 - b) ** 2 for a, b in outside) for x in range(23)] for y in range(17)]
        assert np.array_equal(K.squared_distance(inside), want)


def test_regions_keep_their_promises():
    for seed, shape, colors, least in ((1, (60, 80), 5, 20), (2, (1, 90), 4, 3), (3, (40, 50), 3, 1), (4, (30, 30), 8, 2000)):
        labels = blobs(seed, shape, colors)
        ids, color = K.build_regions(labels, colors, least)
        sizes = np.bincount(ids[ids >= 0], minlength=len(color))
        assert sizes.min() >= min(least, labels.size) and len(color) == ids.max() + 1
        again, kinds = K.merge_same_color(ids, color)
        assert np.array_equal(again, ids) and np.array_equal(kinds, color)
        if least == 1:
            assert np.array_equal(color[ids], labels)


def test_small_regions_join_the_owner_of_most_of_their_ring():
    labels = np.zeros((5, 6), int)
    labels[:, 3:] = 1
    labels[2, 3] = 2
    ids, color = K.number_regions(labels, 3)
    merged, kinds = K.merge_small(ids, color, 2)
    assert kinds.tolist() == [0, 1] and merged[2, 3] == 1


def test_numbers_go_by_colour_and_block():
    labels = np.array([[1, 1, 0, 9], [1, 9, 9, 9], [9, 9, 9, 0]])
    ids, color = K.number_regions(labels, 2)
    assert ids.tolist() == [[2, 2, 0, -1], [2, -1, -1, -1], [-1, -1, -1, 1]] and color.tolist() == [0, 0, 1]


def test_brush_and_slivers():
    ids = np.zeros((20, 30), int)
    ids[8:10, 10:] = 1
    fits = G.brush_fits(ids, 3)
    assert fits[4, 4] and not fits[1, 4] and not fits[8:10, 10:].any()
    thin = B.slivers(ids, 3)
    assert thin[8:10, 12:].all() and not thin[4, 4]


def test_pictures_written_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    planes = rng.integers(0, 256, (7, 9, 3))
    rows = [(1, x, y, *map(int, planes[y, x])) for y in range(7) for x in range(9)]
    px = spark.createDataFrame(rows, "image_id int, x int, y int, b int, g int, r int")
    found = pictures.png_files(px).first()
    (tmp_path / "a.png").write_bytes(bytes(found["png"]))
    got = {(r["x"], r["y"]): (r["b"], r["g"], r["r"]) for r in files.read_pixels(spark, str(tmp_path)).collect()}
    assert got == {r[1:3]: r[3:] for r in rows}


def test_regions_of_many_pictures(spark):
    maps = {i: blobs(i, (12 + i, 15), 4) for i in range(3)}
    rows = [(i, x, y, int(m[y, x])) for i, m in maps.items() for y in range(m.shape[0]) for x in range(15)]
    got = pictures.build_regions(spark.createDataFrame(rows, "image_id int, x int, y int, label int"), 4, 10).collect()
    for i, m in maps.items():
        ids, color = K.build_regions(m, 4, 10)
        assert {(r["x"], r["y"]): (r["region_id"], r["color"]) for r in got if r["image_id"] == i} == {(x, y): (ids[y, x], color[ids[y, x]]) for y in range(m.shape[0]) for x in range(15)}


def test_manifests(spark, tmp_path):
    good = {"size": [100, 80], "categories": ["face", "flat"], "faces": [{"kind": "human", "box": [10, 10, 20, 20], "features": []}], "flat_colors": ["#ff00aa"]}
    bad = {"size": [100, 80], "categories": ["text", "odd"], "areas": [{"kind": "texture", "box": [90, 10, 20, 20]}], "flat_colors": ["red"]}
    (tmp_path / "manifest.json").write_text(json.dumps({"schema": 1, "images": {"a": good, "b": bad}}))
    (tmp_path / "local.json").write_text(json.dumps({"schema": 1, "images": {"a": good | {"notes": "mine"}}}))
    read = files.overlaid(files.read_manifest(spark, str(tmp_path)), ["manifest.json", "local.json"])
    assert {r["name"]: r["notes"] for r in read.collect()} == {"a": "mine", "b": None}
    assert {(r["name"], r["problem"]) for r in files.problems(read).collect()} == {("b", p) for p in ("unknown category", "box outside", "no text", "bad colour")}
    assert [r["name"] for r in files.chosen(read, ["face"]).collect()] == ["a"]
