import math

import numpy as np

from rasterloom.llm import embeddings as E


def brute(rows, cosine=0.98):
    n, ok = len(rows), []
    for vec_id, v, label in rows:
        ok.append(label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v))
    unit = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(n)]
    return {r[0]: (len(near[i]), comp[i]) for i, r in enumerate(rows)}


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1) for i, v, c in rows], "vec_id long, embedding array<float>, label int, node string, cell int")


def test_links_equal_brute_force_in_small_cells_and_chunks(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for group in range(30):
        base = rng.standard_normal(64)
        for _ in range(1 + group % 9):
            v = base + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.12, 0.15])
            rows.append((k, [float(np.float32(x)) for x in v], int(group % 2)))
            k += 1
    want = brute(rows)
    for cell in (4, 64, 4096):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(table(spark, rows), cell=cell).collect()}
        assert got == want


def test_odd_vectors(spark):
    one = [1.0] + [0.0] * 7
    rows = [(1, one, 0), (2, one, 0), (3, [2.0] + [-0.0] * 7, 0), (4, one, 1), (5, one, None), (6, None, 0), (7, [0.0] * 8, 0), (8, [float("nan")] + one[1:], 0), (9, [float("inf")] + one[1:], 0), (10, [None] + one[1:], 0), (11, [1.0, 0.0], 0), (12, [], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_vectors(table(spark, rows)).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)} | {i: (0, i, True) for i in range(4, 13)}
    assert E.near_vectors(table(spark, [])).count() == 0


def test_threshold_of_the_count_keeps_what_it_promises():
    count, hit = E.least_count(), math.erf(E.WIDTH / math.sqrt(2))
    lost = sum(math.comb(E.PROJECTIONS, k) * hit**k * (1 - hit) ** (E.PROJECTIONS - k) for k in range(count))
    assert lost < E.LOSS and count > E.PROJECTIONS / 2


def test_any_number_of_lengths(spark):
    rows = [(2 * d + k, [1.0] * d + [0.01 * k], 0) for d in range(1, 1201) for k in (0, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(table(spark, rows)).collect()}
    assert got == {2 * d + k: (1, 2 * d) for d in range(1, 1201) for k in (0, 1)}


def test_counters_equal_dense_comparison():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (70, 130), (300, 64)):
        left, right = rng.standard_normal((n, 32)), rng.standard_normal((m, 32))
        want = (np.abs(left[:, None] - right[None]) <= 1.2).sum(axis=2)
        for count in (0, 13, 19, 32):
            x, y = E._colliding(left, right, 1.2, count)
            pairs = [(i, j) for i, j in zip(x.tolist(), y.tolist()) if j < m]
            assert sorted(pairs) == sorted(map(tuple, np.argwhere(want >= count).tolist()))
