"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over running labelled text. A text is parsed into the longest phrases that
occur there, across words, from left to right; each phrase costs the logarithm of the automaton's text (a pointer into
it), and the language with the smallest cost wins. Texts are lower-cased and what is not a letter counts as a blank; the
automata read UTF-8 bytes, so their tables have a bounded width in any script.

A process parses many texts at once: they are cut in blocks of BLOCK bytes, and all blocks go on by a byte together, in
each language. A phrase does not go on beyond its block, which adds the same to the cost of every language.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the sample to learn from: documents of each language, by the order of a hash of their ids, characters of each
#: of those, characters of each language, the same number for every one, and characters of all languages together.
SAMPLE_DOCS, DOC_CHARS, SAMPLE_CHARS, ALL_CHARS = 200, 1_000, 60_000, 600_000
#: Bytes of a text that are parsed in a row, and bytes that are parsed at once.
BLOCK, AT_ONCE = 512, 1 << 23
_RUN, _REST = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]+")


class SuffixAutomaton:
    """All substrings of a text, as bytes: transitions by state."""

    def __init__(self, text: str):
        self.text = text.encode("utf-8", "replace")
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in self.text:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] != length[p] + 1:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = clone
                    q = clone
                link[state] = q
            last = state

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each byte, next state by state and symbol): states are given times the number of symbols, 0 is none."""
        have = sorted(set(self.text))
        symbol = np.full(256, len(have), np.int32)
        symbol[have] = np.arange(len(have))
        width = len(have) + 1
        flat = [(state * width + symbol[c], to * width) for state, steps in enumerate(self.next) for c, to in steps.items()]
        out = np.zeros(len(self.next) * width, np.int32)
        at, to = np.array(flat or [(0, 0)], np.int64).T
        out[at] = to
        return symbol, out


class CrossParser:
    """Costs of texts under each learned language."""

    def __init__(self, texts: dict[str, str]):
        self.langs = list(texts)
        tables = [SuffixAutomaton(texts[x]).table() for x in self.langs]
        self.symbols, self.steps = [s for s, _ in tables], [t for _, t in tables]
        self.unit = np.array([math.log2(max(2, len(texts[x].encode("utf-8", "replace")))) for x in self.langs])

    def phrases(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases (languages x blocks) of the blocks of data, the longest blocks first; a byte that a language lacks is one."""
        state, count = np.zeros((len(self.langs), len(starts)), np.int32), np.zeros((len(self.langs), len(starts)), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # blocks with more than t bytes
            byte = data[starts[:n] + t]
            for k, (symbols, steps) in enumerate(zip(self.symbols, self.steps, strict=True)):
                symbol, now = symbols[byte], state[k, :n]
                then = steps[now + symbol]
                stop = np.flatnonzero(then == 0)
                if len(stop):
                    again = steps[symbol[stop]]
                    count[k, stop] += (now[stop] != 0).astype(np.int64) + (again == 0)
                    then[stop] = again
                state[k, :n] = then
        return count + (state != 0)

    def costs(self, texts: list[str]) -> np.ndarray:
        """Cost of each text (in the form that `letters` gives) under each language."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        out, first = np.zeros((len(texts), len(self.langs))), 0
        while first < len(raw):
            last, size = first, 0
            while last < len(raw) and (last == first or size + len(raw[last]) <= AT_ONCE):
                size += len(raw[last])
                last += 1
            lengths = np.array([len(x) for x in raw[first:last]])
            blocks = -(-lengths // BLOCK)
            owner = np.repeat(np.arange(len(lengths)), blocks)
            within = BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            sizes, starts = np.minimum(BLOCK, lengths[owner] - within), (np.cumsum(lengths) - lengths)[owner] + within
            order = np.argsort(-sizes, kind="stable")
            found = self.phrases(np.frombuffer(b"".join(raw[first:last]), np.uint8), starts[order], sizes[order])
            for k in range(len(self.langs)):
                out[first:last, k] = np.bincount(owner[order], found[k], len(lengths)) * self.unit[k]
            first = last
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of each text the language, and 1 minus its cost over the second's; ('und', 0.0) without a letter."""
        clean = [letters(t) for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        costs = self.costs(clean)
        best = np.argmin(costs, axis=1)
        least = costs[np.arange(len(texts)), best]
        second = np.partition(costs, 1, axis=1)[:, 1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        score = np.clip(1 - least / np.maximum(second, 1e-9), 0, 1)
        return [(self.langs[b], s) if t else ("und", 0.0) for t, b, s in zip(clean, best.tolist(), score.tolist(), strict=True)]


def letters(text: str | None) -> str:
    """The letters of a text in lower case, a blank for whatever lies between and at both ends; empty without a letter."""
    found = _REST.sub(" ", (text or "").lower()).strip()
    return f" {found} " if any(map(str.isalpha, found)) else ""


class Learned:
    """Texts by language, and their parser once a process asks for it."""

    def __init__(self, texts: dict[str, str]):
        self.texts = texts

    @cached_property
    def parser(self) -> CrossParser:
        return CrossParser(self.texts)

    def __getstate__(self):
        return {"texts": self.texts}


def learn(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Running text of each language of labelled (doc_id, text, lang): from at most `docs` documents of each, by the order
    of a hash of their ids, at most DOC_CHARS characters of each document and `chars` of the language, and fewer where
    there are so many languages that ALL_CHARS would be passed. Of rows that repeat an id and language one counts, that
    with the least text. The languages come in the order of how many rows they have."""
    known = labelled.where("lang is not null and text is not null and doc_id is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a document per language and one of 4,096 hash classes first, so that the ranking sees a bounded number of rows
    firsts = known.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(4096)).alias("part")).agg(F.min("doc_id").alias("doc_id"))
    chosen = firsts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs).select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang"), "rank")
    some = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang")))
    rows = some.groupBy("lang", "rank").agg(F.min(F.substring("text", 1, DOC_CHARS)).alias("text")).collect()
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    pieces: dict[str, list] = {r["lang"]: [] for r in common}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        pieces[r["lang"]].append(letters(r["text"])[1:])
    limit = min(chars, ALL_CHARS // max(1, len(pieces)))
    found = {lang: (" " + "".join(x))[:limit] for lang, x in pieces.items()}
    return {lang: x for lang, x in found.items() if x.strip()}


def identify(docs: DataFrame, learned: dict[str, str]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs (doc_id, text), by text alone.

    lang_pred is a learned language, or 'und' with score 0 for texts that are null or have no letter and where nothing
    was learned; of equal costs the language learned first wins. Score is 1 minus the winner's cost over the second's.
    Repeated rows each get a row; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Learned(learned))

    def run(batches):
        parser = shared.value.parser
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                found = parser.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out_languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): languages learned from the rows whose crc32(doc_id) mod `folds` is not `held`.
    A row without an id is in no fold: it is predicted, but neither learned from nor held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    learned = learn(docs.where(fold != held).select("doc_id", "text", "lang"))
    out = identify(docs, learned)
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
