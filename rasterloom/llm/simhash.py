"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank (the position of a bit pattern in the reflected Gray code), so neighbours in the
order differ in few bits. Runs of neighbours share the bits in which all of them agree; that masked pattern is factored
out into an upper node. A query walks down from the top, adds the differences it finds in each node's masked pattern,
and drops a whole group as soon as the sum passes the radius.

The top of the hierarchy is dealt out over the cluster. Two fingerprints within the radius agree in one of radius + 1
blocks of bits, so there is a hierarchy for each block, in which the fingerprints are turned so that the block comes
first; its top nodes are masked patterns of as many leading bits of the block as the table's size asks for. A top node
that still has too many members is split by further bits, again and again: a fingerprint is a member of the child of its
own bits and a visitor of the larger children within the radius, with the differences so far carried along. No task gets
more than a bounded part of the table.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, field
from .graph import components

#: Members of a top node before it is split, and bits by which it is split.
BLOCK, SPLIT_BITS = 8192, 4
#: Fingerprints below one upper node, and upper nodes below the next.
FANOUT = 16
#: Shingles counted at once in one text.
CHUNK = 1 << 16


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def shingles(text: bytes | None, size: int) -> list[bytes]:
    """Word shingles of a text, repeats included; the whole sequence where it has fewer words; none without words.

    Words are runs of other bytes than blanks (0x20, 0x09 to 0x0D) after A-Z are lower-cased.
    """
    words = (text or b"").lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def majority(digests: bytes) -> bytes:
    """The 8 bytes whose bits are set in over half of the 8-byte digests; zero where there are none."""
    n, ones = len(digests) // 8, np.zeros(64, np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(rows[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> bytes:
    """SimHash of a whole text: 8 bytes, most significant first."""
    return majority(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), shingles(text, size))))


def with_fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every document with an id; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            got = b"".join(fingerprint(x, size, seed) for x in batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(got, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, "doc_id long, fp long")


# ---- the index within one task --------------------------------------------------------------------------------------


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The rank of each pattern in the reflected Gray code."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of masked patterns over fingerprints in Gray order; level 0 is the fingerprints themselves."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        low = fps[self.order]
        masks, patterns = [np.full(len(low), ~np.uint64(0))], [low]
        while len(patterns[-1]) > 2 * FANOUT:
            starts = np.arange(0, len(patterns[-1]), FANOUT)
            first = np.repeat(patterns[-1][starts], np.diff([*starts, len(patterns[-1])]))
            differs = np.bitwise_or.reduceat((first ^ patterns[-1]) | ~masks[-1], starts)
            masks.append(~differs)
            patterns.append(patterns[-1][starts] & ~differs)
        self.masks, self.patterns = masks, patterns

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query position, fingerprint position) of all pairs within the radius."""
        top = len(self.patterns) - 1
        found = np.bitwise_count((queries[:, None] ^ self.patterns[top][None, :]) & self.masks[top][None, :])
        q, node = np.nonzero(found <= radius)
        sums = found[q, node].astype(np.int16)
        for level in range(top - 1, -1, -1):
            width = np.minimum(FANOUT, len(self.patterns[level]) - node * FANOUT)
            child = np.repeat(node * FANOUT, width) + _ramps(width)
            q, parent, sums = np.repeat(q, width), np.repeat(node, width), np.repeat(sums, width)
            fresh = self.masks[level][child] & ~self.masks[level + 1][parent]  # bits that the upper node has not counted
            sums = sums + np.bitwise_count((queries[q] ^ self.patterns[level][child]) & fresh)
            keep = sums <= radius
            q, node, sums = q[keep], child[keep], sums[keep]
        return q, self.order[node]


def _ramps(widths: np.ndarray) -> np.ndarray:
    """0, 1, .. of each width in turn."""
    ends = np.cumsum(widths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - widths, widths)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i]; `label` has the smallest position of each group, in place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _links(group: pa.Table, radius: int) -> pa.Table:
    """Links of one top node: each node of a group to the smallest of it."""
    member = group["member"].to_numpy(zero_copy_only=False)
    order = np.argsort(group["node"].to_numpy(), kind="stable")  # so that a smaller position is a smaller node
    order = np.concatenate([order[member[order]], order[~member[order]]])
    count = int(member.sum())
    nodes, fps = group["node"].to_numpy()[order], group["fp"].to_numpy().astype(np.int64).view(np.uint64)[order]
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not count:
        return empty
    index, label = GrayIndex(fps[:count]), np.arange(len(nodes))
    step = max(16, (1 << 21) // max(1, count))
    for at in range(0, len(nodes), step):
        q, m = index.search(fps[at : at + step], radius)
        q = q + at
        keep = q != m
        merge_labels(label, q[keep], m[keep])
    linked = label != np.arange(len(nodes))
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    linked |= least[label] != nodes
    return pa.table({"a": nodes[linked], "b": least[label][linked]})


# ---- the index over the cluster -------------------------------------------------------------------------------------


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in on) for r in range(min(radius, bits) + 1) for on in combinations(range(bits), r)]


def _turned(radius: int) -> list[int]:
    """Where the radius + 1 blocks of bits begin, from the most significant; two fingerprints within the radius agree in one."""
    return [64 * i // (radius + 1) for i in range(radius + 1)]


def fingerprint_links(nodes: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all nodes of each group whose fingerprints are chained by `radius` or fewer differing bits.

    nodes: a written table (node long, fp long, tab int); tab numbers independent fingerprint tables. Each fingerprint
    is dealt out radius + 1 times, however large the table. A task returns the links of a spanning star for each group
    it sees, never all pairs of a group.
    """
    n = nodes.groupBy("tab").count().agg(F.max("count")).first()[0] or 0
    depth = min(64 // (radius + 1), max(0, math.ceil(math.log2(max(1, n) / block))))
    turn = lambda k: F.shiftleft("fp", k).bitwiseOR(F.shiftrightunsigned("fp", 64 - k)) if k else F.col("fp")
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), turn(k).alias("fp")) for i, k in enumerate(_turned(radius))])
    rows = nodes.withColumn("t", F.explode(turns)).select("tab", F.col("t.turn").alias("turn"), F.col("t.fp").alias("fp"), "node")
    cell = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    rows = rows.select("tab", "turn", cell.alias("cell"), "node", "fp", F.lit(0).alias("diff"), F.lit(True).alias("member"))
    keys, parts = ["tab", "turn", "cell"], []
    while True:
        members = rows.where("member").groupBy(*keys).count().where(F.col("count") > 4 * block).select(*keys)
        large = cut(members, "large-cells")
        split = depth < 64 and not large.isEmpty()
        done = rows.join(large, keys, "left_anti") if split else rows
        parts.append(done.groupBy(*keys).applyInArrow(lambda group: _links(group, radius), "a long, b long"))
        if not split:
            break
        bits = min(SPLIT_BITS, 64 - depth)
        depth += bits
        below = F.shiftrightunsigned("fp", 64 - depth).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        rows = (
            rows.join(large, keys, "left_semi")
            .withColumn("own", below)
            .withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(bits, radius)])))
            .withColumn("more", F.col("diff") + F.bit_count("mask").cast("int"))
            .withColumn("part", F.col("own").bitwiseXOR(F.col("mask")))
            # a visitor goes on to every child in reach, a member beside its own only to larger ones, so a pair meets once
            .where(f"more <= {radius} and (not member or part >= own)")
            .select("tab", "turn", (F.shiftleft("cell", bits).bitwiseOR(F.col("part"))).alias("cell"), "node", "fp", F.col("more").alias("diff"), (F.col("member") & (F.col("mask") == 0)).alias("member"))
        )
        rows = cut(rows, "cells")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document with an id.

    Documents link where their fingerprints differ in `radius` or fewer bits; component_id is the smallest doc_id that
    links reach. Equal fingerprints are one node of the index, so exact copies cost one row each. Null and empty texts
    have fingerprint zero and link like any other; rows without doc_id have no result; columns but doc_id and text are
    not read; rows that repeat a doc_id each get a result. An empty table gives an empty result.
    """
    fps = cut(with_fingerprints(docs, size, seed), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).withColumn("tab", F.lit(0)), "nodes")
    groups = components(fingerprint_links(nodes, radius))
    classes = cut(nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "classes")
    out = fps.join(classes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- similar texts --------------------------------------------------------------------------------------------------

#: Keys of a text, and least values of its shingles in a key: of texts of similarity 0.8, 2.2e-4 share no key.
KEYS, PER_KEY = 16, 4
#: Parts of the range of hashes; the least shingle of each leaves 4 bits in the sketch of a text.
BINS = 512
#: Deviations by which an estimate from sketches may fall short: loses 1e-5 at the similarity asked for.
SLACK = 4.3
#: Bits by which fingerprints of five-word shingles may differ for the first look.
RADIUS = 3
#: Shingles of the texts of one block that are held against each other in one task.
CHUNK_SHINGLES = 1 << 17
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_FACTORS = np.random.default_rng(5).integers(1 << 62, 1 << 63, KEYS * PER_KEY, np.uint64) * np.uint64(2) + np.uint64(1)
_NIBBLES = np.uint64(0x1111111111111111)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Hashes of the different shingles of `size` words of a text, sorted; of the whole sequence where it has fewer words."""
    words = (text or b"").lower().split()
    codes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    width = min(size, len(codes))
    runs = np.zeros(len(codes) - width + 1 if len(codes) else 0, np.uint64)
    for i in range(width):
        runs = (runs ^ (runs >> np.uint64(32))) * _MIX[i % len(_MIX)] + codes[i : i + len(runs)]
    runs = (runs ^ (runs >> np.uint64(32))) * _MIX[0]
    return np.unique(runs ^ (runs >> np.uint64(29)))


def sketch_of(codes: np.ndarray) -> bytes:
    """4 bits for each of BINS parts of the range of hashes: 0 where a text has no shingle there, else 1 to 15 by the least one."""
    bins = (codes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    nibbles = np.zeros(BINS, np.uint8)
    nibbles[bins[first]] = 1 + (codes[first] * _MIX[1] >> np.uint64(40)) % np.uint64(15)
    return (nibbles[::2] << 4 | nibbles[1::2]).tobytes()


def signature(text: bytes | None, size: int = 5) -> tuple[np.ndarray, int, bytes, bytes, bytes]:
    """(KEYS keys, number of different shingles, fingerprint, sketch, digest of the word sequence) of a whole text; no keys
    without words."""
    codes = shingle_set(text, size)
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(codes), CHUNK >> 4):
        np.minimum(least, (codes[at : at + (CHUNK >> 4), None] * _FACTORS[None, :]).min(axis=0), out=least)
    keys = np.arange(KEYS, dtype=np.uint64)
    for part in least.reshape(KEYS, PER_KEY).T:
        keys = (keys ^ (keys >> np.uint64(32))) * _MIX[0] + (part ^ (part >> np.uint64(31))) * _MIX[1]
    words = xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split()))
    return keys if len(codes) else keys[:0], len(codes), majority(codes.astype(">u8").tobytes()), sketch_of(codes), words


def likeness(n: np.ndarray, sketch: np.ndarray, m: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Estimated similarity of texts with n and m shingles by their sketches (rows of 64-bit words); -1 where they can't have
    the similarity asked for: the parts in which they differ are then SLACK deviations too many."""
    either, apart = sketch | other, sketch ^ other
    some, differ = (np.bitwise_count((x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & _NIBBLES).sum(axis=1, dtype=np.float64) for x in (either, apart))
    far = (1 - similarity) * some + SLACK * np.sqrt(some * similarity * (1 - similarity))
    fits = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (differ <= far)
    return np.where(fits, 1 - differ / np.maximum(some, 1), -1.0)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


class _Texts:
    """Texts of one block, or of a part of one, and what their pairs are judged by."""

    def __init__(self, rows: pa.Table, size: int, similarity: float):
        self.size, self.similarity = size, similarity
        self.node, self.n, self.label, self.side = (rows[c].to_numpy() for c in ("node", "n", "label", "side"))
        self.n, self.fp = self.n.astype(np.float64), rows["fp"].to_numpy().view(np.uint64)
        self.keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(len(self.node), -1)
        self.sketch, self.texts, self.sets = _sketches(rows["sketch"]), rows["text"].cast(pa.binary()).to_pylist(), {}

    def _set(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = shingle_set(self.texts[i], self.size)
        return self.sets[i]

    def similar(self, i: int, j: int) -> bool:
        """Whether two texts share that part of their different shingles, counted exactly."""
        x, y = self._set(i), self._set(j)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared >= self.similarity * (len(x) + len(y) - shared) - 1e-9

    def links(self) -> list[tuple[int, int]]:
        """Similar pairs of nodes that join the groups of label; where side 1 has texts, those of side 0 are held against them
        alone.

        A text is held against those it is not joined to yet, that share a key with it or have a fingerprint within RADIUS
        bits, and whose sketches may be that similar, the likeliest first.
        """
        out, label, after = [], self.label.copy(), self.side == 1
        apart = bool(after.any())
        for i in np.flatnonzero(self.side == 0).tolist():
            rest = np.flatnonzero((label != label[i]) & after) if apart else i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            rest = rest[(self.keys[rest] == self.keys[i]).any(axis=1) | (np.bitwise_count(self.fp[rest] ^ self.fp[i]) <= RADIUS)]
            if not len(rest):
                continue
            like = likeness(self.n[i], self.sketch[i], self.n[rest], self.sketch[rest], self.similarity)
            for j in rest[np.argsort(-like, kind="stable")[: int((like >= 0).sum())]].tolist():
                if label[j] != label[i] and self.similar(i, j):
                    label[label == label[j]] = label[i]
                    out.append((int(self.node[i]), int(self.node[j])))
        return out


def _linked(rows: DataFrame, by: list[str], size: int, similarity: float) -> DataFrame:
    """(a, b): similar texts that join the groups (label) of each block, as far as its rows are dealt to one task."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending"), ("node", "ascending")])
        block, found = group["block"].to_numpy(), []
        for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            found += _Texts(group.slice(int(part[0]), len(part)), size, similarity).links()
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select(*[c for c in by if c != "block"], "block", "node", "label", "side", "n", "fp", "keys", "sketch", "text").groupBy(*by).applyInArrow(run, "a long, b long")


def _chunk(chunks, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "node"), chunks).cast("int")


def _block_links(held: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all similar texts of each block. held: a written table (block, node, n, fp, keys, sketch, text).

    Small blocks go to tasks whole. The texts of a large one are dealt to chunks at random, twice, which joins most of a
    large group at a cost in proportion to it; then the texts outside its largest group are held against all others.
    """
    held = held.withColumn("label", F.col("node")).withColumn("side", F.lit(0))
    sums = cut(held.groupBy("block").agg(F.sum("n").alias("shingles")), "block-sizes")
    cells = max(1, math.ceil((sums.agg(F.sum("shingles")).first()[0] or 0) / CHUNK_SHINGLES))
    chunked = cut(sums.where(F.col("shingles") > CHUNK_SHINGLES).select("block", F.ceil(F.col("shingles") / CHUNK_SHINGLES).alias("chunks")), "large-blocks")
    if chunked.isEmpty():
        return _linked(held.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(cells))), ["deal"], size, similarity)
    small = held.join(chunked, "block", "left_anti").withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(cells)))
    links = cut(_linked(small, ["deal"], size, similarity), "similar-pairs")
    large = cut(held.join(chunked, "block"), "large-block-texts")
    for seed in (1, 2):
        links = links.union(cut(_linked(large.withColumn("deal", _chunk(F.col("chunks"), seed)), ["block", "deal"], size, similarity).select("a", "b"), "similar-pairs"))
    groups = components(links)
    labelled = cut(large.drop("label").join(groups.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")), "large-block-groups")
    main = labelled.groupBy("block", "label").agg(F.sum("n").alias("held")).groupBy("block").agg(F.max(F.struct("held", "label")).alias("top")).select("block", F.col("top.label").alias("main"))
    rest = labelled.join(cut(main, "main-groups"), "block").where("label <> main").drop("main")
    few = cut(rest.groupBy("block").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).alias("rests")), "rest-sizes")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    low = rest.join(few, "block").withColumn("low", _chunk(F.col("rests"), 3)).withColumn("high", spread("chunks"))
    high = labelled.join(few, "block").withColumn("high", _chunk(F.col("chunks"), 4)).withColumn("low", spread("rests")).withColumn("side", F.lit(1))
    last = _linked(low.unionByName(high), ["block", "low", "high"], size, similarity)
    return links.union(cut(last, "similar-pairs"))


def similar_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every document with an id: groups of texts chained by similarity 0.8 or more, the shared
    part of their different shingles of five words.

    Two looks find what may be similar. The Gray index links SimHash fingerprints of the shingles within RADIUS bits, which
    takes near copies together at a small cost, but of texts of similarity 0.8 fewer than one pair in a hundred has
    fingerprints that close. So a text also has KEYS keys, each of PER_KEY least shingles under as many hashes, and two
    texts share a given key with probability similarity ** PER_KEY wherever their words differ. Chains of either make
    blocks, found from one link a text and key. Within a block, pairs with a common key or close fingerprints whose sketches
    may be that similar are verified by all their shingles, unless the two are joined already. Tasks return the links that
    join their groups, never all pairs. Texts with the same words are one node. Null and empty texts are alike.
    """

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                keys, n, fps, sketches, words = zip(*[signature(x, size) for x in some.column(2).cast(pa.binary()).to_pylist()], strict=True)
                listed = pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64()))
                columns = [some.column(0), some.column(1), listed, pa.array(n, pa.int32()), pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64)), pa.array(sketches, pa.binary()), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "keys", "n", "fp", "sketch", "words"])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string")).where("doc_id is not null")
    found = cut(texts.mapInArrow(run, "doc_id long, text_key long, keys array<long>, n int, fp long, sketch binary, words binary"), "signatures")
    nodes = found.groupBy("words").agg(F.min(F.struct("doc_id", "text_key", "n", "fp", "sketch", "keys")).alias("x"))
    nodes = cut(nodes.select("words", F.col("x.doc_id").alias("node"), "x.text_key", "x.n", "x.fp", "x.sketch", "x.keys"), "texts")
    sized = nodes.where("n > 0")
    # fingerprints: those that are equal, and those that the index links
    marks = cut(sized.groupBy("fp").agg(F.min("node").alias("node")).withColumn("tab", F.lit(0)), "fingerprints")
    same = sized.select("fp", F.col("node").alias("b")).join(marks.select("fp", F.col("node").alias("a")), "fp").where("a < b").select("a", "b")
    near = fingerprint_links(marks, RADIUS)
    # keys that several texts have: each text is linked to the first
    entries = sized.select("node", F.explode("keys").alias("key"))
    shared = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("first")).where("held > 1").select("key", "first"), "shared-keys")
    keyed = entries.join(shared, "key").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    chained = cut(components(same.union(near).union(keyed).distinct()), "chains")
    blocks = chained.select("node", F.col("component").alias("block")).union(chained.select("component", "component").distinct())
    held = sized.drop("words").join(cut(blocks, "blocks"), "node")
    whole = texts.select(F.col("doc_id").alias("node"), "text_key", "text").join(held.select("node", "text_key").distinct(), ["node", "text_key"], "left_semi")
    held = cut(held.join(whole.dropDuplicates(["node", "text_key"]), ["node", "text_key"]), "block-texts")
    groups = components(cut(_block_links(held, size, similarity), "similar-pairs"))
    classes = cut(nodes.join(groups, "node", "left").select("words", F.coalesce("component", "node").alias("component_id")), "classes")
    return found.select("doc_id", "words").join(classes, "words").select("doc_id", "component_id")


def one_of_each_group(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, without those of documents that are similar to one with a smaller doc_id in their
    group. Of rows that repeat a doc_id one stays, any. Rows without an id stay."""
    loser, again = field("loser_id", docs), field("again_id", docs)
    groups = similar_documents(docs, size, similarity)
    losers = cut(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(loser)).distinct(), "losers")
    kept = docs.join(losers, F.col("doc_id").cast("long") == F.col(loser), "left_anti")
    repeats = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(again)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(again)
    repeats = cut(repeats, "repeated-ids")
    if repeats.isEmpty():
        return kept
    single = kept.join(repeats, F.col("doc_id") == F.col(again), "left_anti")
    return single.union(kept.join(repeats, F.col("doc_id") == F.col(again), "left_semi").dropDuplicates(["doc_id"]))
