"""WARC archives: written with deduplicated payloads, and read in splits by boundary-chain verification.

Archives are written as plain WARC/1.0 files; those of version 1.1 are read too. Reading deals them out in splits of any size (spark.sql.files.maxPartitionBytes), cut
at the record magic. A task can't tell a record from the same magic inside a payload, so every place with the magic is a
candidate: its header gives a length and with it the offset of its successor. Tasks emit these candidate-to-successor
offsets, and where the chain from each candidate leaves the task's split. Pointer jumping over those exits, from offset
0 of each file, finds the one candidate at which the chain enters each split; what the chain reaches from there is a
record, everything else is payload.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch

#: What every record starts with, before its minor version and a line end; and what parts header, payload and next record.
MAGIC, GAP, VERSIONS = b"WARC/1.", b"\r\n\r\n", (b"0", b"1")
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Records in one archive at most.
RECORDS = 20_000

_HEADERS = {b"warc-type": "record_type", b"warc-record-id": "record_id", b"warc-target-uri": "uri", b"warc-refers-to": "refers_to", b"warc-payload-digest": "digest_header", b"x-payload-length": "length_header"}
_TEXTS = list(_HEADERS.values())


# ---- writing --------------------------------------------------------------------------------------------------------


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, records: int = RECORDS) -> None:
    """Writes a record for each row of pages (page_id, url, html) to archives below `path`.

    Of rows with equal payloads of at least `revisit_bytes` bytes, those with the largest page_id become response
    records and the others revisit records without payload that name it; smaller payloads, and rows without a page_id,
    are all response. A null html is an empty payload, a null url has no target line; line ends in a url are escaped.
    Other columns are not read; an empty table writes no record.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    winners = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    winners = cut(winners.select(F.col("digest").alias("first_digest"), "first_id"), "payload-owners")
    joined = rows.join(winners, F.col("digest") == F.col("first_digest"), "left")
    revisit = F.coalesce(F.col("first_id") != F.col("page_id"), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    some = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        some(F.col("page_id").isNotNull(), line("WARC-Record-ID", urn("page_id"))),
        some(F.col("url").isNotNull(), line("WARC-Target-URI", url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        some(revisit, line("WARC-Refers-To", urn("first_id"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(header.cast("binary"), body).cast("string")
    joined.select(record.alias("value")).write.option("lineSep", GAP.decode()).option("maxRecordsPerFile", records).text(path)


# ---- reading --------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """A seed with which the hashes of all paths of archives differ, and (file, name): those hashes and the paths."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("name"))
    names = cut(names, "archive-names")
    for seed in range(100):
        named = names.select(F.xxhash64(F.lit(seed), "name").alias("file"), "name")
        if named.groupBy("file").count().where("count > 1").isEmpty():
            return seed, named
    raise RuntimeError("no seed tells the archives apart")


def _segments(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(file, block, value binary): archives cut at the magic, in the order of each split."""
    return spark.read.option("lineSep", MAGIC.decode()).option("recursiveFileLookup", "true").text(path).select(
        F.xxhash64(F.lit(seed), F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def parse_header(value: bytes) -> tuple[dict, int, int] | None:
    """Fields, header length and content length of what follows a magic; None if that is no header."""
    end = value.find(GAP)
    if end < 0:
        return None
    fields, length = {}, None
    version, *lines = value[:end].split(b"\r\n")
    if version not in VERSIONS:
        return None
    for line in lines:
        name, colon, rest = line.partition(b":")
        if not colon:
            return None
        name, rest = name.strip().lower(), rest.strip()
        if name == b"content-length":
            if not rest.isdigit():
                return None
            length = int(rest)
        elif name in _HEADERS:
            fields[_HEADERS[name]] = rest.decode("utf-8", "replace")
    return None if length is None else (fields, end + len(GAP), length)


_SCHEMA = "file long, block long, rel long, after long, exit long, total long, body long, " + ", ".join(f"{c} string" for c in _TEXTS) + ", payload_bytes long, payload_digest string, payload binary"


def _scan(keep_payload: bool):
    """Candidates of each split (held until it ends, so no more than maxPartitionBytes and a record): rel (of the magic), after (its successor, or -1), exit (where its chain leaves the split);
    a last row for each split has its total length instead."""

    def flush(file, block, found, total):
        at = {x["rel"]: x for x in found}
        for x in reversed(found):
            x["exit"] = at[x["after"]]["exit"] if x["after"] in at else x["after"]
        return [*found, {"file": file, "block": block, "total": total}]

    def run(batches):
        key, found, rel, first = None, [], 0, True
        for batch in batches:
            out = []
            for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != key:
                    if key:
                        out += flush(*key, found, rel)
                    key, found, rel, first = (file, block), [], 0, block == 0
                if first:  # what stands before the first magic of a file
                    first, rel = False, rel + len(value) + len(MAGIC)
                    continue
                start = rel - len(MAGIC)
                rel += len(value) + len(MAGIC)
                if parsed := parse_header(value):
                    fields, head, length = parsed
                    payload = value[head : head + length] if head + length <= len(value) else None
                    row = fields | {"file": file, "block": block, "rel": start, "after": start + len(MAGIC) + head + length + len(GAP), "body": start + len(MAGIC) + head}
                    row["payload_bytes"] = length
                    if payload is not None:
                        row |= {"payload_digest": hashlib.sha1(payload).hexdigest()} | ({"payload": payload} if keep_payload else {})
                    found.append(row)
            if out:
                yield _batch(out)
        if key:
            yield _batch(flush(*key, found, rel))

    return run


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in _SCHEMA.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates (file, block, rel, after, exit, total, ..) that the chain from the start of their file reaches, with
    `start`, their offset in the file.

    Only places that some chain leaves a split for, and the starts of files, can be entries, so jumps are kept for those
    alone: some for each split, however many records it holds.
    """
    splits = candidates.where("total is not null").select("file", "block", "total")
    order = Window.partitionBy("file").orderBy("block")
    # the text before the first magic belongs to the first split; a split's first magic ends just before its first segment
    bases = cut(splits.select("file", "block", (F.sum("total").over(order) - F.col("total")).alias("base")), "split-bases")
    found = candidates.where("total is null").drop("total").join(bases, ["file", "block"])
    found = found.withColumn("start", F.col("base") + F.col("rel"))
    every = found.select("file", "start", (F.col("base") + F.col("exit")).alias("to"))
    places = every.select("file", F.col("to").alias("start")).union(bases.select("file", F.lit(0).cast("long"))).distinct()
    jump = cut(every.join(cut(places, "places"), ["file", "start"]).select("file", "start", "to"), "jumps")
    entered = cut(bases.select("file", F.lit(0).cast("long").alias("start")).distinct(), "entries")
    have = entered.count()
    while True:  # entries double their reach with each round, as jumps are composed with themselves
        more = entered.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
        entered = cut(entered.union(more).distinct(), "entries")
        now = entered.count()
        if now == have:
            break
        have = now
        onward = jump.select(F.col("file").alias("f"), F.col("start").alias("s"), F.col("to").alias("further"))
        jump = cut(jump.join(onward, (F.col("file") == F.col("f")) & (F.col("to") == F.col("s")), "left").select("file", "start", F.coalesce("further", "to").alias("to")), "jumps")
    marked = found.select("file", "block", "start", (F.col("base") + F.col("after")).alias("next")).join(entered.withColumn("entry", F.lit(True)), ["file", "start"], "left")

    def follow(split: pa.Table) -> pa.Table:
        split = split.sort_by("start")
        starts, nexts = split["start"].to_numpy(), split["next"].to_numpy()
        on = split["entry"].fill_null(False).to_numpy().copy()
        then = np.searchsorted(starts, nexts)
        linked = np.flatnonzero((then < len(starts)) & (starts[np.minimum(then, len(starts) - 1)] == nexts))
        for i, j in zip(linked.tolist(), then[linked].tolist(), strict=True):  # in order of offsets, and a successor comes later
            if on[i]:
                on[j] = True
        return split.filter(pa.array(on)).select(["file", "block", "start"])

    chain = marked.select("file", "block", "start", "next", "entry").groupBy("file", "block").applyInArrow(follow, "file long, block long, start long")
    return found.join(chain.hint("merge"), ["file", "block", "start"])


def _stitched(spark: SparkSession, path: str, seed: int, broken: DataFrame) -> DataFrame:
    """(file, start, whole, whole_digest) of records whose payload holds the magic, put together from the segments of their
    files.

    broken: (file, start, body, payload_bytes). A task holds the segments of one such record; the window that finds whose
    a segment is sees offsets, not bytes.
    """

    def place(batches):
        key, rel, first = None, 0, True
        for batch in batches:
            rows = []
            for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != key:
                    key, rel, first = (file, block), 0, block == 0
                rows.append((file, block, -1 if first else rel - len(MAGIC), len(value) + len(MAGIC), value if first else MAGIC + value))  # -1: before every record
                rel, first = rel + len(value) + len(MAGIC), False
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "rel", "size", "bytes"])

    files = cut(broken.select("file").distinct(), "stitched-files")
    pieces = cut(_segments(spark, path, seed).mapInArrow(place, "file long, block long, rel long, size long, bytes binary").join(files, "file", "left_semi"), "pieces")
    order = Window.partitionBy("file").orderBy("block")
    bases = pieces.groupBy("file", "block").agg(F.sum("size").alias("total")).select("file", "block", (F.sum("total").over(order) - F.col("total")).alias("base"))
    placed = pieces.join(bases, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel"))
    owner = broken.select("file", F.col("start").alias("at"), F.struct("start", "body", "payload_bytes").alias("record"))
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = placed.select("file", "block", "rel", "at").join(owner, ["file", "at"], "left").withColumn("record", F.last("record", ignorenulls=True).over(so_far))
    offsets = cut(offsets.where(F.col("at") < F.col("record.body") + F.col("record.payload_bytes")).select("file", "block", "rel", "at", "record"), "stitched-offsets")
    owned = pieces.join(offsets, ["file", "block", "rel"]).select("file", "record.start", "record.body", "record.payload_bytes", "at", "bytes")

    def whole(record: pa.Table) -> pa.Table:
        record = record.sort_by("at")
        start, body, size = (record[c][0].as_py() for c in ("start", "body", "payload_bytes"))
        payload = b"".join(record["bytes"].to_pylist())[body - start : body - start + size]
        return pa.table({"file": record["file"][:1], "start": record["start"][:1], "whole": pa.array([payload], pa.binary()), "whole_digest": [hashlib.sha1(payload).hexdigest()]})

    return owned.groupBy("file", "start").applyInArrow(whole, "file long, start long, whole binary, whole_digest string")


def read_warc(spark: SparkSession, path: str, payload: bool = True, named: bool = True) -> DataFrame:
    """(file, start, record_type, record_id, uri, refers_to, payload_bytes, payload_digest[, payload]) of the records of
    all archives below `path`.

    payload_bytes and payload_digest (bare lower-case hexadecimal SHA-1) are those of the payload as read; for revisit
    records, which carry none, those that the header names for the payload they refer to. What a header lacks is null.
    `file` is the path of the archive, or null without `named`. Payloads with the magic inside are put together, one record
    to a task. A chain that breaks off (a damaged header or length) ends that file's records. Files without a record give no row.
    """
    seed, names = _files(spark, path)
    candidates = cut(_segments(spark, path, seed).mapInArrow(_scan(payload), _SCHEMA), "candidates")
    records = cut(reachable(candidates), "records")
    broken = records.where("payload_digest is null").select("file", "start", (F.col("base") + F.col("body")).alias("body"), "payload_bytes")
    if not broken.isEmpty():
        late = cut(_stitched(spark, path, seed, broken), "stitched")
        records = records.join(late, ["file", "start"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "whole_digest")).withColumn("payload", F.coalesce("payload", "whole"))
    revisit = F.col("record_type") == "revisit"
    shown = (records.join(names, "file") if named else records.withColumn("name", F.lit(None).cast("string"))).select(
        F.col("name").alias("file"), "start", "record_type", "record_id", "uri", "refers_to",
        F.when(revisit, F.col("length_header").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("digest_header", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(revisit, None).otherwise(F.col("payload")).alias("payload"),
    )
    return shown if payload else shown.drop("payload")


def round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): pages written to archives and read back."""
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write_warc(pages, path, revisit_bytes)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    got = read_warc(spark, path, payload=False, named=False)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return got.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
