"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so along a random direction of an orthonormal set their projections
differ by a normal variate of deviation sqrt((2 - 2c) / dimensions). The vectors of a cell are sorted along each of
PROJECTIONS directions. A query's window is its own projection plus or minus WIDTH deviations (of a pair just at the
threshold), so it is a range of ranks, and the vectors in it are a set of bits: that of the ranks below its end less that
of the ranks below its start. The sets of all directions are added up in bit-sliced counters, 64 pairs to a word. Pairs at
the threshold collide in a direction with probability 0.89, so their count is binomial, and the count a pair must reach is
the largest that loses fewer than LOSS of them. Pairs that pass are verified by their cosine in double precision.

Vectors are dealt out by label, by length, and by the signs of further directions, taken from as many as the table's size
asks for. A vector that lies within MARGIN deviations of a plane is sent to both sides, so two vectors across the plane
meet unless both lie farther from it, which pairs at the threshold do with a probability below 3e-5 a direction. Cells that
are still large (a dense region) are cut in chunks, and each pair of chunks is a task of its own.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components
from .simhash import merge_labels

COSINE, PROJECTIONS, WIDTH, LOSS, MARGIN = 0.98, 32, 1.6, 1e-5, 1.6
#: Vectors in a cell before planes or chunks divide it, and the most planes.
CELL, PLANES = 8192, 16
#: Queries whose counters are held at once.
QUERIES_AT_ONCE = 2048


@lru_cache(maxsize=64)
def directions(dimensions: int, count: int, seed: int) -> np.ndarray:
    """`count` unit rows, orthonormal in groups of at most `dimensions`."""
    rng, out = np.random.default_rng(seed), []
    while (have := sum(len(x) for x in out)) < count:
        out.append(np.linalg.qr(rng.standard_normal((dimensions, min(dimensions, count - have))))[0].T)
    return np.concatenate(out)


def least_count(projections: int = PROJECTIONS, width: float = WIDTH, loss: float = LOSS) -> int:
    """The largest count that a pair at the threshold misses with a probability below `loss`."""
    hit = math.erf(width / math.sqrt(2))
    missed = 0.0
    for count in range(projections + 1):
        missed += math.comb(projections, count) * hit**count * (1 - hit) ** (projections - count)
        if missed >= loss:
            return count
    return projections


def _can_link() -> Column:
    """Whether a vector can link: it has a label and an id, and nothing null, zero throughout or non-finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine, F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(nodes: DataFrame, planes: int, cosine: float, seed: int) -> DataFrame:
    """Each vector with the cells it belongs to: (cell, node, weight, embedding, label, size, sides, near); sides has its own
    signs, near the planes it is close to. Vectors of few dimensions have fewer planes."""

    def signs(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
        normals = directions(size, max(1, min(planes, size)), seed)[:planes]
        at = _units(_matrix(vectors)) @ normals.T
        bits = 1 << np.arange(len(normals), dtype=np.int64)
        return (at > 0) @ bits, (np.abs(at) <= MARGIN * math.sqrt((2 - 2 * cosine) / size)) @ bits

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(4).to_numpy()
            own, close = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                own[at], close[at] = signs(batch.column(2).take(pa.array(at)), size)
            rows, cells = [], []
            for i, (o, c) in enumerate(zip(own.tolist(), close.tolist(), strict=True)):
                sub = c
                while True:  # every subset of the close planes
                    rows.append(i)
                    cells.append(o ^ sub)
                    if not sub:
                        break
                    sub = (sub - 1) & c
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(batch.column(i).take(take) for i in range(5)), pa.array(own[rows]), pa.array(close[rows])], ["cell", "node", "weight", "embedding", "label", "size", "sides", "near"])

    kind, vector = (nodes.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    return nodes.select("node", "weight", "embedding", "label", "size").mapInArrow(run, f"cell long, node long, weight long, embedding {vector}, label {kind}, size int, sides long, near long")


def _below(order: np.ndarray) -> np.ndarray:
    """Row r: the set of bits of the first r positions of an order."""
    n = len(order)
    sets = np.zeros((n + 1, -(-n // 64)), np.uint64)
    sets[np.arange(1, n + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    return np.bitwise_or.accumulate(sets, axis=0, out=sets)


def _colliding(left: np.ndarray, right: np.ndarray, window: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of left, row of right) of all pairs that are within the window along `count` directions (columns) or more."""
    found = [np.empty((2, 0), np.int64)]
    for first in range(0, len(left), QUERIES_AT_ONCE):
        queries = left[first : first + QUERIES_AT_ONCE]
        planes = np.zeros((left.shape[1].bit_length(), len(queries), -(-len(right) // 64)), np.uint64)
        for j in range(left.shape[1]):
            order = np.argsort(right[:, j], kind="stable")
            keys, sets = right[order, j], _below(order)
            add = sets[np.searchsorted(keys, queries[:, j] + window, side="right")] ^ sets[np.searchsorted(keys, queries[:, j] - window)]
            for plane in planes[: (j + 1).bit_length()]:  # the counters' bits, the lowest first
                carry = plane & add
                plane ^= add
                add = carry
        above, level = np.zeros(planes.shape[1:], np.uint64), np.full(planes.shape[1:], ~np.uint64(0))
        for k in range(len(planes) - 1, -1, -1):
            if count >> k & 1:
                level &= planes[k]
            else:
                above |= level & planes[k]
                level &= ~planes[k]
        above |= level
        row, word = np.nonzero(above)
        bits = np.unpackbits(above[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        found.append(np.stack([row[at] + first, word[at] * 64 + bit]))
    return tuple(np.concatenate(found, axis=1))


def _pairs(a: dict, b: dict | None, cell: int, projections: np.ndarray, cosine: float):
    """Verified pairs of positions within a, or between a and b, that belong to this cell; in blocks."""
    window, other = WIDTH * math.sqrt((2 - 2 * cosine) / a["unit"].shape[1]), a if b is None else b
    x, y = _colliding(a["unit"] @ projections.T, other["unit"] @ projections.T, window, least_count(len(projections)))
    if b is None:
        x, y = x[x < y], y[x < y]
    # of the cells that two vectors share, one has the pair: for planes that part them, the upper side if the lower vector is close
    parted = a["sides"][x] ^ other["sides"][y]
    lower_near = (a["near"][x] & ~a["sides"][x]) | (other["near"][y] & ~other["sides"][y])
    mine = ((a["sides"][x] & other["sides"][y]) | (parted & lower_near)) == cell
    x, y = x[mine], y[mine]
    for part in np.array_split(np.arange(len(x)), max(1, len(x) >> 16)):
        near = (a["unit"][x[part]] * other["unit"][y[part]]).sum(axis=1) >= cosine
        yield x[part][near], y[part][near]


def _link_cell(group: pa.Table, seed: int, cosine: float) -> pa.Table:
    """For one cell, or one pair of its chunks: (node, root, links): how many vectors each node links with, and a spanning star."""
    projections = directions(group["size"][0].as_py(), PROJECTIONS, seed)
    chunk = group["chunk"].to_numpy()
    order = np.lexsort((group["node"].to_numpy(), chunk))
    node, weight = group["node"].to_numpy()[order], group["weight"].to_numpy()[order]
    data = {"unit": _units(_matrix(group["embedding"])[order]), "sides": group["sides"].to_numpy()[order], "near": group["near"].to_numpy()[order]}
    cell, split = int(group["cell"][0].as_py()), int((chunk[order] == chunk.min()).sum())
    pick = lambda s: {k: v[s] for k, v in data.items()}
    if group["pair_low"][0].as_py() == group["pair_high"][0].as_py():
        found, shift = _pairs(data, None, cell, projections, cosine), 0
    elif split == len(node):  # the other chunk is empty
        found, shift = [], 0
    else:
        found, shift = _pairs(pick(slice(0, split)), pick(slice(split, None)), cell, projections, cosine), split
    # positions by node, so that the smallest position of a group is its smallest node
    rank = np.empty(len(node), np.int64)
    rank[np.argsort(node, kind="stable")] = np.arange(len(node))
    label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
    for x, y in found:
        y = y + shift
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        merge_labels(label, rank[x], rank[y])
    by_rank = np.sort(node)
    root = by_rank[label[rank]]
    keep = links > 0
    return pa.table({"node": node[keep], "root": root[keep], "links": links[keep]})


def vector_links(nodes: DataFrame, cosine: float = COSINE, cell: int = CELL, seed: int = 7) -> DataFrame:
    """(node, root, links) from every task: partial numbers of linked vectors, and a star over each group it saw.

    nodes: a written table (node long, weight long, embedding array, size int, label) of different usable vectors; size is
    a vector's length, and weight says how many vectors a node stands for.
    """
    most = nodes.groupBy("label", "size").count().agg(F.max("count")).first()[0]
    schema = "node long, root long, links long"
    if most is None:
        return nodes.sparkSession.createDataFrame([], schema)
    cells = _cells(nodes, min(PLANES, max(0, math.ceil(math.log2(most / cell)))), cosine, seed)
    keys = ["label", "size", "cell"]
    chunks = cells.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (2 * cell)).cast("int").alias("chunks")).where("chunks > 1")
    cells = cells.join(cut(chunks, "cell-chunks"), keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(F.least(i, F.col("chunk")).alias("low"), F.greatest(i, F.col("chunk")).alias("high")))
    dealt = cells.withColumn("pair", F.explode(others)).select("*", F.col("pair.low").alias("pair_low"), F.col("pair.high").alias("pair_high")).drop("pair", "chunks")
    return dealt.groupBy(*keys, "pair_low", "pair_high").applyInArrow(lambda group: _link_cell(group, seed + 1, cosine), schema)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector with an id.

    Two vectors link if their labels are equal and not null and their cosine is `cosine` or more. Null, zero and
    non-finite vectors, and those without a label, link with nothing. Equal vectors of a label are one node with a
    weight, so copies cost one row each; for the result rows meet their node by 128 bits of hash. Vectors of different
    lengths do not link; any number of lengths is searched at once. Rows that repeat a vec_id are separate vectors of the
    same component. Other columns are not read; an empty table gives an empty result.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    plus = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind)).alias("embedding"), "label")  # -0.0 becomes 0.0
    nodes = cut(plus.where(_can_link()).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")).withColumn("size", F.size("embedding")), "vectors")
    found = cut(vector_links(nodes, cosine, cell), "vector-links")
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    hashes = [F.xxhash64(F.lit(seed), "embedding", "label").alias(f"h{seed}") for seed in (1, 2)]
    classes = nodes.select("node", "weight", *hashes).join(links, "node", "left").join(groups, "node", "left")
    classes = cut(classes.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")).where("n_links > 0"), "vector-classes")
    everything = plus.where("vec_id is not null").select("vec_id", *[F.when(_can_link(), h).alias(f"h{i}") for i, h in enumerate(hashes, 1)])
    out = everything.join(classes, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
