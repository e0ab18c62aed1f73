import hashlib
import random
import zlib

import numpy as np
import pytest

from rasterloom.llm import packing, warc

RECORD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"


def tricky_pages():
    rng, rows = random.Random(3), []
    for i in range(150):
        text = "".join(rng.choice("abc\r\né") for _ in range(rng.randint(0, 2000)))
        kind = i % 7
        text = [text, text + "WARC/1.0\r\n" + text, text + RECORD % (5, "hello") + text, "WARC/1.0\r\nContent-Length: 999999\r\n\r\n", text + "WARC/1.0\r\n" * 30, f"dup{i % 2}" * 500, ""][kind]
        rows.append((None if i == 7 else i, None if i == 9 else f"http://h/{i}\r\nX: 1", None if i == 11 else text, "x"))
    return rows


@pytest.mark.parametrize("split", ["7k", "128m"])
def test_archives_round_trip_whatever_the_splits(spark, tmp_path, split):
    rows = tricky_pages()
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(2), str(tmp_path / "w"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {i: (t or "").encode() for i, _, t, _ in rows}
    number = lambda x: int(x[10:-1]) if x else None
    assert len(got) == len(rows) and {number(r["record_id"]) for r in got} == set(want)
    largest = {t: max(i for i, x in want.items() if x == t and i is not None) for t in want.values() if any(x == t and i is not None for i, x in want.items())}
    for r in got:
        payload, revisit = want[number(r["record_id"])], r["record_type"] == "revisit"
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert revisit == (len(payload) >= 1000 and number(r["record_id"]) is not None and largest[payload] != number(r["record_id"]))
        assert number(r["refers_to"]) == (largest[payload] if revisit else None)
        assert r["payload"] is None if revisit else bytes(r["payload"]) == payload


def test_archives_of_version_1_1_and_repeated_ids(spark, tmp_path):
    body = "x" * 2000
    text = "".join(f"WARC/1.{i % 2}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body) + i}\r\n\r\n{body}{'WARC/1.9'[:i]}\r\n\r\n" for i in range(9))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(text.encode())
    got = {r["record_id"]: r["payload_bytes"] for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {f"<urn:page:{i}>": 2000 + i for i in range(9)}
    pages = spark.createDataFrame([(5, "u", body), (5, "u", body), (4, "v", body), (None, None, body), (6, "w", "WARC/1.0\r\n" + body)], "page_id long, url string, html string")
    rows = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect())
    assert rows == [(0, "response", None, 2000), (4, "revisit", 5, 2000), (5, "response", None, 2000), (5, "response", None, 2000), (6, "response", None, 2010)]


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pieces_cover_every_document(spark, data, odd_docs):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(odd_docs.where("doc_id <> 7").selectExpr("doc_id + 1000000", "text"))
    got = packing.pack(docs, with_ids=True).collect()
    tokenizer, texts = Tokenizer.from_file(packing.tokenizer_path()), {r["doc_id"]: r["text"] for r in docs.collect()}
    of, seq = {}, {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    assert of.keys() == texts.keys()
    for doc_id, found in of.items():
        ids = np.array(tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        found.sort(key=lambda r: r["start"])
        assert [i for r in found for i in r["ids"]] == ids.tolist()
        for r in found:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and r["length"] == len(own) and r["ids_crc32"] == zlib.crc32(own.tobytes())
    for found in seq.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
    tokens = sum(r["length"] for r in got)
    assert tokens / (len(seq) * packing.LENGTH) > 0.95
    assert packing.pack(docs.limit(0)).count() == 0
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in packing.pack(odd_docs).where("start = 0").collect() if (r["doc_id"] or 7) == 7) == [(0, 5), (7, 17), (7, 17)]


def test_words_are_remembered_over_generations():
    from tokenizers import Tokenizer

    tokenizer, words, rng = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path()), random.Random(2)
    before, packing.KEPT = packing.KEPT, 50
    try:
        for _ in range(60):
            texts = [" ".join(rng.choice(["alpha", "it's", "beta.", "(gamma", "x1y2"]) + "z" * rng.randint(0, 9) for _ in range(30)) for _ in range(4)]
            assert words.encode_all(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
            assert len(words) < 400
    finally:
        packing.KEPT = before


def test_plans_use_exactly_the_items():
    rng = np.random.default_rng(6)
    for classes in (1, 5, 60, 512):
        sizes = rng.choice(np.arange(1, 513), classes, replace=False)
        histogram = {int(s): int(rng.integers(1, 400)) for s in sizes}
        patterns = packing.plan(histogram, 512)
        used = {}
        for pattern, times in patterns:
            assert times > 0 and sum(k * n for k, n in pattern.items()) <= 512
            for k, n in pattern.items():
                used[k] = used.get(k, 0) + n * times
        assert used == histogram
        assignment = packing.Assignment(patterns)
        kinds = np.repeat(list(histogram), list(histogram.values()))
        ranks = np.concatenate([np.arange(n) for n in histogram.values()])
        sequence, slot = assignment.place(kinds, ranks)
        assert len(set(zip(sequence.tolist(), slot.tolist(), strict=True))) == len(kinds) and np.bincount(sequence, kinds).max() <= 512
        assert np.bincount(sequence, minlength=assignment.sequences).min() > 0


def test_words_are_tokenized_like_whole_texts():
    from tokenizers import Tokenizer

    rng, letters = random.Random(5), list("abAZ éñ\n\t.,!'01-_Σςİﬁ가ᄀ中\U0001f642̧́­​‍\x85\xa0\x1c　\x00|<>")
    tokenizer, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 24))) + "<|endoftext|>" * (i % 50 == 0) for i in range(6000)] + ["I'll we've 'tis ''s &&'s 'S x'RE", "THE!! And,And \u0130x \u01c5", "a" * 5000]
    for at in range(0, len(texts), 61):
        got = words.encode_all(texts[at : at + 61])
        assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[at : at + 61]]


def test_signs_after_words_take_no_place_of_their_own():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    texts = ["Alpha beta, beta. beta; beta?! (alpha) it's it's. ... x1, x1", None, "", " \t\n", "beta) alpha\x85beta <|endoftext|>"] * 3
    assert words.encode_all(texts) == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert {"alpha", "beta", ",", ".", ";", "?!", ")"} < set(words) and not {"beta,", "beta.", "beta;", "beta?!", "beta)"} & set(words)


@pytest.mark.parametrize("span", [1, 3000, 1 << 23])
def test_every_character_is_tokenized_like_in_whole_texts(span, monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SPAN", span)
    tokenizer, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    texts = [f"{c} Ab{c} ab{c}. x{c}y, {c}Z {c}.{c} '{c} 1{c}" for c in map(chr, [*range(0x260), *range(0x2000, 0x2070), 0x20AC, 0x2C65, 0x3000, 0x1F642])]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert list(words.encode_each(pa.array(["cut off", *texts, None], kind).slice(1))) == [*want, b""]
    assert words.encode_all([]) == [] and list(words.encode_each(pa.array([None, None], pa.string()))) == [b"", b""]
