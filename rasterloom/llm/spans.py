"""Substring dedup by sliding sentence spans: runs of consecutive sentences are hashed and joined globally, and sentences
covered by a repeated run that is not its first occurrence are removed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, field

#: A run starts or ends at any sentence and is the shortest with so many sentences and so many words.
SENTENCES, WORDS = 2, 20
#: Sentences end after . ! ? and a blank, and at line feeds; the blanks belong to the sentence before.
_END = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text with the blanks after them; joined they are the text. Blanks alone are no sentence."""
    out, start = [], 0
    for end in _END.finditer(text or ""):
        out.append(text[start : end.end()])
        start = end.end()
    if text and start < len(text):
        out.append(text[start:])
    if len(out) > 1 and not out[0].strip():
        out[:2] = [out[0] + out[1]]
    return out


_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_INVERSE = np.array([pow(int(m), -1, 1 << 64) for m in _ODD], np.uint64)


def _powers(base: np.ndarray, count: int) -> np.ndarray:
    """Rows base ** 0, base ** 1, .. (modulo 2 ** 64) for two bases."""
    out = np.ones((count, 2), np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out, axis=0)


def runs(parts: list[str], least: int = SENTENCES, words: int = WORDS, ends_too: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (a row of two 64-bit numbers), first sentence and number of sentences of the shortest run that starts at each
    sentence, and with `ends_too` of the shortest that ends there, as far as runs fit in; by first sentence, each run once.

    A run's hash is a polynomial in the 128-bit hashes of its sentences, two halves at a time, so all runs come from the
    sums of one pass.
    """
    clean = [p.split() for p in parts]
    sizes = np.cumsum([0, *map(len, clean)])
    at = np.arange(len(parts))
    ends = np.maximum(np.searchsorted(sizes, sizes[:-1] + words), at + least)
    fits = ends <= len(parts)
    pairs = at[fits] * (len(parts) + 1) + ends[fits]
    if ends_too:
        starts = np.minimum(np.searchsorted(sizes, sizes[1:] - words, side="right") - 1, at + 1 - least)
        back = starts >= 0
        pairs = np.unique(np.concatenate([pairs, starts[back] * (len(parts) + 1) + at[back] + 1]))
    first, stop = np.divmod(pairs, len(parts) + 1)
    raw = b"".join([xxhash.xxh3_128_digest(" ".join(c).encode("utf-8", "surrogatepass")) for c in clean])
    digests = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
    sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(digests * _powers(_ODD, len(parts)), axis=0, dtype=np.uint64)])
    mixed = (sums[stop] - sums[first]) * _powers(_INVERSE, len(parts) + 1)[first] + (stop - first).astype(np.uint64)[:, None]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64), first, (stop - first).astype(np.int32)


def _spans(docs: DataFrame, least: int, words: int, ends_too: bool) -> DataFrame:
    """(doc_id, text_key, first, size, h1, h2) of every run of every document."""
    names = ["doc_id", "text_key", "first", "size", "h1", "h2"]

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                found = [runs(sentences(t), least, words, ends_too) for t in batch.column(2).to_pylist()]
                row = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for _, f, _ in found]))
                hashes = np.concatenate([h for h, _, _ in found])
                first, size = (np.concatenate([f[i] for f in found]).astype(np.int32) for i in (1, 2))
                columns = [batch.column(0).take(row), batch.column(1).take(row), *map(pa.array, (first, size, hashes[:, 0].copy(), hashes[:, 1].copy()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, text_key long, first int, size int, h1 long, h2 long")


def repeated(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, ends_too: bool = False) -> DataFrame:
    """(doc_id, text_key, spans array<struct<first, size>>): the runs of each document that are not the first of their kind;
    text_key is the text's xxhash64.

    The first is the one with the smallest (doc_id, text_key, first, size). Runs are hashed once and written. Counts
    combine before their shuffle, and a run that a third of the documents share is spread by adaptive execution when
    occurrences join the repeated hashes; a list is no longer than its own document.
    """
    every = cut(_spans(docs, least, words, ends_too), "spans")
    place = F.struct("doc_id", "text_key", "first", "size")
    firsts = every.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin")).where("n > 1").select("h1", "h2", "origin")
    later = every.join(cut(firsts, "repeated-spans"), ["h1", "h2"]).where(place != F.col("origin"))
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("first", "size"))).alias("spans"))


def drop_repeated(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, ends_too: bool = False) -> DataFrame:
    """All columns of `docs` with repeated sentences taken out of `text`, and n_sentences and n_removed beside them.

    A null text stays null with 0 sentences, an empty one empty; a document that only repeats others keeps an empty text.
    Texts too short for a run are left alone, as are rows without doc_id. Rows that repeat a doc_id and text are the
    same occurrence and are treated alike. Columns named n_sentences or n_removed in the input are replaced. An empty
    table gives an empty result. Runs are equal if 128 bits of hash are.
    """
    key, text_key, listed = field("span_doc", docs), field("span_text", docs), field("span_list", docs)
    kept = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    found = repeated(docs, least, words, ends_too).select(F.col("doc_id").alias(key), F.col("text_key").alias(text_key), F.col("spans").alias(listed))
    joined = docs.select(*kept).join(cut(found, "span-lists"), (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64("text") == F.col(text_key)), "left").select(*kept, listed)
    schema = docs.select(*kept).schema.add("n_sentences", "long").add("n_removed", "long")
    text_at = kept.index("text")

    def clean(batches):
        for batch in batches:
            texts, before, after = [], [], []
            for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                parts = sentences(text)
                gone = np.zeros(len(parts) + 1, np.int64)
                for x in spans or ():
                    gone[x["first"]] += 1
                    gone[x["first"] + x["size"]] -= 1
                removed = np.cumsum(gone)[:-1] > 0
                n = int(removed.sum())
                texts.append(text if not n else "".join(p for p, g in zip(parts, removed.tolist(), strict=True) if not g))
                before.append(len(parts))
                after.append(n)
            columns = [batch.column(i) for i in range(len(kept))]
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(after, pa.int64())], [*kept, "n_sentences", "n_removed"])

    return joined.mapInArrow(clean, schema)


def substring_dedup(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, ends_too: bool = False) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) of every document after repeated sentences are taken out."""
    return drop_repeated(docs.select("doc_id", "text"), least, words, ends_too)
