"""Benchmark decontamination by SimHash windows of an item's size, verified by exact weighted-shingle similarity.

Each window of a document as long (in words) as a benchmark item gets TABLES SimHashes of its 5-word shingles, of 64 bits
each. A multi-index finds the items with a fingerprint within RADIUS bits: fingerprints are cut into BLOCKS blocks, and two
that differ in at most RADIUS bits have some block that differs in at most RADIUS // BLOCKS bits, so a table of items by
block value and its near values loses none. Candidates are verified by the weighted Jaccard similarity of their shingles
(weight: how often a shingle occurs), which must reach 0.8. Windows without any shingle of an item of their size have
similarity zero with it and are not fingerprinted.

At similarity 0.8 two fingerprints differ in 9.7 bits on average with a deviation of 2.9, so 97.3 % of pairs at the
threshold are within 15 bits in one table, 99.93 % in one of two, and more above. Of unrelated fingerprints one in 80,000
is that close, and the blocks of a table pass a quarter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import cached_property
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, SIMILARITY, RADIUS, BLOCKS, TABLES = 5, 0.8, 15, 8, 2
#: Items whose index is sent to the executors at once; a larger benchmark is searched block by block.
ITEMS_AT_ONCE = 20_000
_WORD = re.compile(r"\w+")
#: Signs that no word has, to strip before a closer look.
_EDGES = ".,;:!?()[]{}<>|/%&$#*+-='" + '"'
_BITS = 22


def words_of(text: str | None) -> list[str]:
    """Words of a text in lower case: runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str], size: int = SIZE) -> list[str]:
    """Word shingles, repeats included; the whole sequence where there are fewer words."""
    if len(words) <= size:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger ones; 0 without shingles."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def signs(shingles: list[str]) -> np.ndarray:
    """A row of 64 signs in each table for every shingle: +1 where its hash has a 1."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles)), np.uint8).reshape(-1, 8 * TABLES)
    return np.unpackbits(raw, axis=1).astype(np.int8) * 2 - 1


class _Numbers(dict):
    """Number of each blank-separated token of a lower-cased text: that of its one word, 0 for a word that no item has,
    NO_WORD for a token without a word, MANY for one of several words. Keeps what it has seen, up to a bound."""

    NO_WORD, MANY, KEPT = 1 << 40, 1 << 41, 250_000

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def __missing__(self, token: str) -> int:
        word = token.strip(_EDGES)
        if word.isalnum():
            value = self.numbers.get(word, 0)
        else:
            found = _WORD.findall(token)
            value = self.numbers.get(found[0], 0) if len(found) == 1 else self.MANY if found else self.NO_WORD
        if len(self) >= self.KEPT:
            self.clear()
        self[token] = value
        return value


class ItemIndex:
    """What a task needs of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = SIZE):
        self.size, self.ids, self.counts, self.lengths = size, [], [], []
        fps = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                found = shingles_of(words, size)
                self.ids.append(item_id)
                self.counts.append(Counter(found))
                self.lengths.append(len(words))
                fps.append(np.packbits(signs(found).sum(axis=0, dtype=np.int32) > 0))
        fps = np.array(fps, np.uint8).reshape(-1, 8 * TABLES)
        self.by_shingle: dict[str, list[int]] = defaultdict(list)
        for i, count in enumerate(self.counts):
            for shingle in count:
                self.by_shingle[shingle].append(i)
        #: Numbers for the words of the items; a text's other words are 0.
        self.numbers = {w: n for n, w in enumerate(sorted({w for x in self.by_shingle for w in x.split(" ")}), 1)}
        self.tokens = _Numbers(self.numbers)
        self.short = sorted({n for n in self.lengths if n < size})
        self.known = np.zeros(1 << _BITS, bool)
        for x in self.by_shingle:
            numbers = np.array([self.numbers[w] for w in x.split(" ")], np.uint64)
            self.known[(_codes(numbers, len(numbers)) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        #: Multi-index: by item size, the items, their fingerprints, and by block and block value who is near.
        self.sizes = {}
        flips = [sum(1 << i for i in on) for r in range(RADIUS // BLOCKS + 1) for on in combinations(range(8), r)]
        for length in set(self.lengths):
            items_ = np.array([i for i, n in enumerate(self.lengths) if n == length])
            near = np.zeros((BLOCKS * TABLES, 256, len(items_)), bool)
            for flip in flips:
                near[np.arange(BLOCKS * TABLES)[:, None], fps[items_].T ^ flip, np.arange(len(items_))] = True
            self.sizes[length] = (items_, fps[items_], near)

    def lookup(self, size: int, fps: np.ndarray) -> list[tuple[int, int]]:
        """(row of fps, item) of all windows with a fingerprint (8 bytes in each table) within RADIUS bits of an item of that size."""
        items, own, near = self.sizes[size]
        found = np.zeros((len(fps), len(items)), bool)
        for table in range(TABLES):
            at = BLOCKS * table
            close = near[at][fps[:, at]]
            for block in range(at + 1, at + BLOCKS):
                close = close | near[block][fps[:, block]]
            row, k = np.nonzero(close)
            keep = np.bitwise_count(fps[row, at : at + BLOCKS] ^ own[k, at : at + BLOCKS]).sum(axis=1, dtype=np.int32) <= RADIUS
            found[row[keep], k[keep]] = True
        row, k = np.nonzero(found)
        return list(zip(row.tolist(), items[k].tolist(), strict=True))

    def numbered(self, text: str) -> tuple[list[str], np.ndarray]:
        """Tokens of a text, one word or more in each, and the numbers of the words."""
        tokens = text.lower().split()
        numbers = np.fromiter(map(self.tokens.__getitem__, tokens), np.uint64, len(tokens))
        if len(numbers) and (top := numbers.max()) >= _Numbers.NO_WORD:
            if top >= _Numbers.MANY:
                tokens = words_of(text)
                numbers = np.fromiter(map(self.numbers.get, tokens, repeat(0)), np.uint64, len(tokens))
            else:
                worded = numbers < _Numbers.NO_WORD
                tokens, numbers = [t for t, w in zip(tokens, worded.tolist(), strict=True) if w], numbers[worded]
        return tokens, numbers

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item position, similarity, first word, words) of the best window for each item found in a text."""
        tokens, numbers = self.numbered(text or "")
        unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
        spots = []
        for n in [self.size, *self.short]:
            at = np.flatnonzero(unknown[n:] == unknown[:-n]) if len(numbers) >= n else []
            if len(at):
                codes = _codes(numbers, n)[at]
                spots += [(n, x) for x in at[self.known[(codes >> np.uint64(64 - _BITS)).astype(np.int64)]].tolist()]
        if not spots:
            return []
        words = words_of(text)
        starts: dict[int, set[int]] = defaultdict(set)  # window starts to look at, by window size
        for n, at in spots:
            for i in self.by_shingle.get(" ".join(words[at : at + n]), ()):
                size = self.lengths[i]
                if n == self.size or n == size:
                    first, last = max(0, at + n - size), min(at, max(0, len(words) - size))
                    starts[size].update(range(first, last + 1))
        best: dict[int, tuple] = {}
        for size, found in starts.items():
            where = np.array(sorted(found))
            for run in np.split(where, np.flatnonzero(np.diff(where) > 1) + 1):
                shingles = shingles_of(words[run[0] : run[-1] + size], min(size, self.size))
                width = max(1, min(size, len(words)) - self.size + 1)
                sums = np.concatenate([np.zeros((1, 64 * TABLES), np.int32), np.cumsum(signs(shingles), axis=0, dtype=np.int32)])
                low = run - run[0]
                fps = np.packbits(sums[np.minimum(low + width, len(shingles))] - sums[low] > 0, axis=1)
                for row, i in self.lookup(size, fps):
                    similarity = weighted_similarity(Counter(shingles[low[row] : low[row] + width]), self.counts[i])
                    at = int(run[row])
                    if similarity >= SIMILARITY and (i not in best or (-similarity, at) < best[i][:2]):
                        best[i] = (-similarity, at, min(size, len(words)))
        return [(i, -x[0], x[1], x[2]) for i, x in sorted(best.items())]


def _codes(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for every run of n word numbers."""
    code = np.zeros(max(0, len(numbers) - n + 1), np.uint64)
    for i in range(n):
        code = (code + numbers[i : i + len(code)]) * np.uint64(0x9E3779B97F4A7C15) ^ (code >> np.uint64(29))
    return code * np.uint64(0xD6E8FEB86659FD93)


class Items:
    """A block of benchmark items, and their index once a process asks for it."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.rows = rows

    @cached_property
    def index(self) -> ItemIndex:
        return ItemIndex(self.rows)

    def __getstate__(self):
        return {"rows": self.rows}


def _blocks(benchmark: DataFrame, at_once: int):
    """Benchmark items in blocks, in the order of their ids, without holding more than a block on the driver."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id").toLocalIterator()
    while block := [(r[0], r[1]) for r in islice(rows, at_once)]:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, words): every document and item with a window of the item's size that is
    similar to it by 0.8 or more, with the most similar window, the first of equals.

    An item of fewer than five words is one shingle and must occur as it is. Null and empty texts, and rows without an
    id, match nothing; rows that repeat an id are separate; other columns are not read. An empty table on either side
    gives an empty result. The benchmark is the stated query set: its index is broadcast `at_once` items at a time, and
    the documents are searched once for each such block.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, similarity double, first_word long, words long"
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in _blocks(benchmark, at_once):
        shared = spark.sparkContext.broadcast(Items(block))

        def search(batches, shared=shared):
            index = shared.value.index
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(doc_id, index.ids[i], s, at, n) for i, s, at, n in index.matches(text)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "words"])
            index.tokens.clear()  # the process goes on to other tasks, of other stages too

        part = texts.mapInArrow(search, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of `docs`, all columns, whose text has no window like a benchmark item (see `contaminated`)."""
    at, schema = docs.columns.index("text"), docs.schema
    for block in _blocks(benchmark, at_once):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block))

        def clean(batches, shared=shared):
            index = shared.value.index
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(x) for x in batch.column(at).to_pylist()], pa.bool_()))
            index.tokens.clear()

        docs = docs.mapInArrow(clean, schema)
    return docs
