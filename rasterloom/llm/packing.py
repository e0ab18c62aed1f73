"""Packing documents into training sequences as a cutting-stock problem, solved by column generation.

Documents are cut at multiples of the sequence length; what is left of each is an item. Items fall into classes of UNIT
tokens, so the histogram of the whole corpus has at most length / UNIT rows, whatever the corpus. Over the histogram a
linear program finds how often to use which pattern (so many items of each class in a sequence); new patterns are priced
by dynamic programming over a knapsack. Whole uses are kept, the rest of each class is packed best fit decreasing, and the
resulting patterns are assigned to the items by their rank within their class, which is arithmetic on a small table.
"""

from __future__ import annotations

import codecs
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LENGTH, UNIT, END = 4096, 8, 2
#: The linear program stops within this share of its lower bound, or after so many new patterns.
GAP, ROUNDS = 2e-4, 4000
#: New words after which a task forgets those that it has not met since as many before.
KEPT = 300_000
#: Bytes of text whose words are looked up at once, each of them one time; a longer text is looked up alone.
SPAN = 1 << 23
#: Texts with other characters than these are given to the tokenizer whole: ASCII but for four that may pass for blanks,
#: Latin letters but for the dotted capital I, and common signs; and texts with what could begin a special token.
_ODD = "[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f\u2010-\u2027\u20ac]|<\\|"
# How a tokenizer file says that it lower-cases texts and cuts them into parts which it merges alone. For one
# that says anything else, texts are encoded whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_CUTTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _CUT}, "behavior": "Removed", "invert": True}, _BYTES]}
_BLANKS = {"type": "CharDelimiterSplit", "delimiter": " "}
_PARTS = regex.compile(_CUT)
#: The character that stands for each byte in a byte-level vocabulary: its own where that is printed, else one from 256 on. Blanks stay.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = "".join(" " if b == 32 else chr(b if b in _PRINTED else 256 + b - sum(p < b for p in _PRINTED)) for b in range(256))
#: Signs at the end of a word that are one part of it.
_EDGES = ".,;:!?*%$#()[]{}+-=/&"


def _strings(kind: pa.DataType, stops: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    """The array of strings that lie one after another in `data`."""
    return pa.Array.from_buffers(kind, len(stops) - 1, [None, pa.py_buffer(stops), data or pa.py_buffer(b"")])


def _stops(strings: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], kind)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, kind)


class WordIds(dict):
    """Token ids (little-endian, 4 bytes each) of words without the signs at their ends, and of such signs, for a tokenizer that no token crosses a blank of."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.before = Tokenizer.from_file(path), {}
        says = json.loads(self.tokenizer.to_str())
        self.by_word = says["normalizer"] == _NORMALIZER and says["pre_tokenizer"] == _CUTTER and says["post_processor"] is None and says["model"].get("end_of_word_suffix") == "</w>"
        if self.by_word:
            self.plain = Tokenizer.from_str(json.dumps(says | {"normalizer": None, "pre_tokenizer": _BLANKS}))
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, parts: list[str]) -> None:
        """Ids of new parts: many are encoded in one call, and its ids cut at the word ends."""
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            signs = codecs.charmap_decode(" ".join(some).encode(), "strict", _SIGNS)[0]
            ids = np.array(self.plain.encode_batch_fast([signs], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, begin = ids.tobytes(), 0
                for part, stop in zip(some, (4 * stops).tolist(), strict=True):
                    self[part] = raw[begin:stop]
                    begin = stop
            else:  # some part has signs that the vocabulary lacks
                self.update((part, self._whole(part)) for part in some)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: of their parts, one after another."""
        if len(self) > KEPT:
            self.before = dict(self)
            self.clear()
        cuts, fresh = [], []
        for w, ids in zip(words, map(self.before.get, words), strict=True):
            if ids is not None:
                self[w] = ids
            elif w.isalpha():
                fresh.append(w)
            else:
                cuts.append((w, _PARTS.findall(w)))
        for p in {p for _, parts in cuts for p in parts if p not in self}.difference(fresh):
            if p in self.before:
                self[p] = self.before[p]
            else:
                fresh.append(p)
        self._encode(fresh)
        for w, parts in cuts:
            self[w] = b"".join([self[p] for p in parts])

    def _look_up(self, words: list[str]) -> list[bytes]:
        found = list(map(self.get, words))
        if fresh := [i for i, ids in enumerate(found) if ids is None]:
            missing = [words[i] for i in fresh]
            self._learn(missing)
            for i, w in zip(fresh, missing, strict=True):
                found[i] = self[w]
        return found

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of different words. Letters and the signs after them are looked up apart; the two have no part in common."""
        stops = _stops(words, np.int32)
        cores = pc.utf8_rtrim(words, characters=_EDGES)
        cut = np.where(pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False), stops[:-1] + pc.binary_length(cores).to_numpy(), stops[1:])
        halves = np.empty(2 * len(words) + 1, np.int32)
        halves[::2], halves[1::2] = stops, cut
        met = _strings(pa.string(), halves, words.buffers()[2]).dictionary_encode()
        ids = pa.array(self._look_up(met.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(met.indices)
        return _strings(pa.large_binary(), _stops(ids, np.int64)[::2].copy(), ids.buffers()[2])

    def _encode_span(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts, whose different words are looked up one time each."""
        odd = pc.match_substring_regex(texts, _ODD) if self.by_word else pa.array(np.ones(len(texts), bool))
        words = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        met = words.flatten().dictionary_encode()
        ids = self._of_words(met.dictionary).take(met.indices)
        raw, stops = memoryview(ids.buffers()[2] or b""), _stops(ids, np.int64)[words.offsets.to_numpy()].tolist()
        found = [raw[a:b].tobytes() for a, b in zip(stops, stops[1:], strict=False)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            found[i] = self._whole(texts[i].as_py())
        return found

    def encode_each(self, texts: pa.Array) -> Iterator[bytes]:
        """Token ids of whole texts (null: none), one after another."""
        stops = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // SPAN
        edges = [0, *(np.flatnonzero(np.diff(stops)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                yield from self._encode_span(pc.fill_null(texts.slice(a, b - a).cast(pa.string()), ""))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return list(self.encode_each(pa.array(texts, pa.string())))


#: What a worker process has learned, for the tasks it runs one after another.
_LEARNED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LEARNED:
        _LEARNED.clear()
        _LEARNED[path] = WordIds(path)
    return _LEARNED[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, class, place[, ids]): documents cut at multiples of `length`.

    class is the length in units, rounded up; place numbers a class's pieces within the task `part`. The tokenizer at
    `path` has to be on every executor.
    """
    path, end = path or tokenizer_path(), np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "class", "place"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        words, part, placed = word_ids(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode_each(batch.column(1)), strict=True):
                ids = ids + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    own = ids[4 * start : 4 * (start + length)]
                    n = len(own) // 4
                    kind = -(-n // unit)
                    rows.append((doc_id, start, n, zlib.crc32(own), total, part, kind, placed[kind]) + ((np.frombuffer(own, "<u4").astype(np.int32),) if with_ids else ()))
                    placed[kind] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, class int, place long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


# ---- the linear program ---------------------------------------------------------------------------------------------


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items (sizes ascending) that fits, and how many of each it has."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], pick[room] = best[room - 1], -1
        if k := fits[room]:
            gain = values[:k] + best[room - sizes[:k]]
            if gain[i := int(np.argmax(gain))] > best[room] + 1e-12:
                best[room], pick[room] = gain[i], i
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """(pattern, uses) of a linear program that covers the demand for each size with few sequences of that capacity."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    uses = inverse @ demand
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        value, pattern = _knapsack(np.maximum(dual, 0), sizes, capacity)
        if value <= 1 + gap:  # uses.sum() / value is a lower bound
            break
        move = inverse @ pattern
        up = move > 1e-9
        ratio = np.where(up, uses / np.where(up, move, 1), np.inf)
        out = int(np.argmin(ratio))
        step = max(0.0, ratio[out])
        uses = uses - step * move
        uses[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        columns[:, out] = pattern
    return [(columns[:, i].astype(np.int64), float(max(0.0, uses[i]))) for i in range(m)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(items of each class, number of sequences) that use exactly the items of a histogram by class."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    out: Counter = Counter()
    for pattern, uses in sorted(cutting_stock(sizes, left.astype(float), capacity), key=lambda x: -x[1]):
        times = int(min([uses + 1e-6, *(left[pattern > 0] // pattern[pattern > 0])])) if pattern.any() else 0
        if times:
            left -= times * pattern
            out[tuple(zip(sizes[pattern > 0].tolist(), pattern[pattern > 0].tolist(), strict=True))] += times
    rooms: dict[int, list[Counter]] = {}  # sequences by the room they have left
    for i in range(len(sizes) - 1, -1, -1):
        size = int(sizes[i])
        for _ in range(int(left[i])):
            room = min((r for r in rooms if r >= size and rooms[r]), default=None)
            sequence = rooms[room].pop() if room is not None else Counter()
            sequence[size] += 1
            rooms.setdefault((capacity if room is None else room) - size, []).append(sequence)
    for found in rooms.values():
        for sequence in found:
            out[tuple(sorted(sequence.items()))] += 1
    return [(dict(k), n) for k, n in sorted(out.items())]


class Assignment:
    """Which sequence, and which slot in it, an item gets by class and rank."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        self.by_class: dict[int, tuple] = {}
        rows: dict[int, list] = {}
        first, given = 0, Counter()
        for pattern, times in patterns:
            slot = 0
            for kind in sorted(pattern, reverse=True):
                rows.setdefault(kind, []).append((given[kind], first, pattern[kind], slot))
                given[kind] += times * pattern[kind]
                slot += pattern[kind]
            first += times
        for kind, found in rows.items():
            self.by_class[kind] = tuple(np.array(x, np.int64) for x in zip(*found, strict=True))
        self.sequences = first

    def place(self, kinds: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64)
        for kind in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == kind)
            starts, firsts, counts, slots = self.by_class[kind]
            p = np.searchsorted(starts, ranks[at], side="right") - 1
            within = ranks[at] - starts[p]
            sequence[at], slot[at] = firsts[p] + within // counts[p], slots[p] + within % counts[p]
        return sequence, slot


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece of every row of docs.

    A document's ids are those of the tokenizer at `path` and then END, so null and empty texts have one. Sequences hold at
    most `length` ids; in each, offsets run from 0 without gaps. Rows that repeat an id, or have none, are documents of
    their own; other columns are not read; an empty table gives an empty result. ids_crc32 is the CRC-32 of a piece's
    ids as unsigned little-endian 32-bit numbers.
    """
    found = cut(pieces(docs, path, length, unit, with_ids), "pieces")
    counts = cut(found.groupBy("part", "class").count(), "class-counts")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("count").alias("n")).collect()}  # length / unit rows at most
    shared = docs.sparkSession.sparkContext.broadcast(plan(histogram, length // unit))
    order = Window.partitionBy("class").orderBy("part")
    before = cut(counts.select(F.col("part").alias("p"), F.col("class").alias("c"), (F.sum("count").over(order) - F.col("count")).alias("before")), "class-ranks")
    ranked = found.join(before.hint("merge"), (F.col("part") == F.col("p")) & (F.col("class") == F.col("c"))).withColumn("rank", F.col("before") + F.col("place"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    ranked = ranked.select(*kept, "class", "rank")

    def assign(batches):
        assignment = Assignment(shared.value)
        for batch in batches:
            sequence, slot = assignment.place(batch.column(len(kept)).to_numpy(), batch.column(len(kept) + 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(sequence), pa.array(slot)], [*kept, "sequence_id", "slot"])

    schema = ranked.select(*kept).schema.add("sequence_id", "long").add("slot", "long")
    placed = ranked.mapInArrow(assign, schema)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
