import itertools
import re
import zlib
from collections import Counter

import numpy as np

from rasterloom.llm import decontam, language, lines, spans, toxicity, urls


def test_decontamination_equals_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    items = [(r["item_id"], decontam.words_of(r["text"])) for r in bench.collect()]
    planted = items[3][1][:]
    planted[0] = "changed"
    docs += [(900_001, "before it " + " ".join(planted).upper() + " and after"), (900_002, " ".join(items[4][1][: len(items[4][1]) // 2]))]
    want = {}
    for doc_id, text in docs:
        words = decontam.words_of(text)
        have = set(decontam.shingles_of(words))
        for item_id, item in items:
            count = Counter(decontam.shingles_of(item))
            if have & set(count):
                best = max((decontam.weighted_similarity(Counter(decontam.shingles_of(words[i : i + len(item)])), count), -i) for i in range(max(1, len(words) - len(item) + 1)))
                if best[0] >= 0.8:
                    want[doc_id, item_id] = best
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for at_once in (20_000, 17):
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], -r["first_word"]) for r in decontam.contaminated(table, bench, at_once).collect()}
        assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    assert any(k[0] == 900_001 for k in got) and not any(k[0] == 900_002 for k in got)
    kept = {r["doc_id"] for r in decontam.without_contaminated(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_multi_index_guarantees_its_radius():
    rng = np.random.default_rng(0)
    index = decontam.ItemIndex([(i, " ".join(rng.choice([f"w{k}" for k in range(500)], 20))) for i in range(50)])
    items, own, _ = index.sizes[20]
    for _ in range(300):
        fp = own[rng.integers(50)].copy()
        bits = np.unpackbits(fp)
        bits[rng.choice(128, rng.integers(0, 50), replace=False)] ^= 1
        fp = np.packbits(bits)
        want = {int(items[k]) for k in range(50) if any(np.bitwise_count((own[k] ^ fp)[t : t + 8]).sum() <= decontam.RADIUS for t in (0, 8))}
        assert {i for _, i in index.lookup(20, fp[None])} == want


def test_odd_texts_in_decontamination(spark, odd_docs):
    bench = spark.createDataFrame([(1, "two three four five six seven eight"), (2, None), (3, ""), (4, "thirteen"), (None, "one two")], "item_id long, text string")
    got = sorted({(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd_docs, bench).collect()})
    assert got == [(1, 1), (1, 4), (7, 1), (7, 4)]
    assert decontam.contaminated(odd_docs.limit(0), bench).count() == 0
    assert decontam.contaminated(odd_docs, bench.limit(0)).count() == 0
    assert decontam.without_contaminated(odd_docs, bench).columns == odd_docs.columns


def plain_spans(docs):
    """Which sentences of which document are covered by a repeated run that is not its first."""
    parts = {d: spans.sentences(t) for d, t in docs}
    seen, out = {}, {d: set() for d, _ in docs}
    for d in sorted(parts):
        words = [p.split() for p in parts[d]]
        for i in range(len(words)):
            n = spans.SENTENCES
            while i + n <= len(words) and sum(map(len, words[i : i + n])) < spans.WORDS:
                n += 1
            if i + n <= len(words):
                run = tuple(" ".join(w) for w in words[i : i + n])
                if run in seen:
                    out[d].update(range(i, i + n))
                seen.setdefault(run, d)
    return {d: "".join(p for i, p in enumerate(parts[d]) if i not in out[d]) for d in parts}


def test_spans_equal_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: r["text"] for r in spans.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_spans(docs)


def test_sentences_join_to_their_text():
    for text in ("", "a", " a. b! c?\n\n d. ", "\n\n", "x.y z... w", "A.\n B.", None):
        assert "".join(spans.sentences(text)) == (text or "")


def test_odd_texts_in_spans(odd_docs):
    out = spans.drop_repeated(odd_docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd_docs.count() and set(odd_docs.columns) <= set(out.columns)
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[6]["text"] == "" and rows[5]["n_removed"] < rows[6]["n_removed"]
    assert spans.drop_repeated(odd_docs.limit(0)).count() == 0


def test_odd_texts_in_lines(odd_docs):
    out = lines.drop_boilerplate(odd_docs, min_pages=3)
    assert out.count() == odd_docs.count() and {"n_lines", "n_dropped"} <= set(out.columns)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[2]["text"] is None and rows[2]["n_lines"] == 0 and rows[7]["text"] == "" and rows[9]["n_dropped"] == 0 and rows[4]["n_dropped"] == 0
    assert lines.drop_boilerplate(odd_docs.limit(0)).count() == 0


def test_url_filter_by_hand(spark):
    rows = [(1, "HTTP://u:p@A.b.com.:80/x/y", "2024-01-05"), (2, "http://a.b.com/x", "2024-01-20"), (3, "http://b.com", "2024-01-20"), (4, None, "2024-01-20"), (5, "http://b.com/q", None), (6, "no url", "2024-01-01"), (3, "http://b.com", "2024-01-20"), (7, "http://z.org/", "2024-02-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, day string").selectExpr("page_id", "url", "cast(day as date) as fetched", "1 as key", "2 as month")
    listed = [("a.b.com", "2024-01-01", "block"), ("a.b.com/x", "2024-01-10", "lift"), ("b.com", "2024-01-02", "lift"), ("b.com", "2024-01-02", "block"), ("b.com", "2024-01-20", "lift"), ("z.org", None, "block"), (None, "2024-01-01", "block")]
    entries = spark.createDataFrame(listed, "key string, day string, action string").selectExpr("key", "cast(day as date) as dated", "action")
    got = sorted((r["page_id"], r["verdict"], r["list_key"]) for r in urls.url_filter(captures, entries).collect())
    assert got == [(1, "block", "a.b.com"), (2, "keep", "a.b.com/x"), (3, "keep", "b.com"), (3, "keep", "b.com"), (4, "invalid", None), (5, "invalid", None), (6, "invalid", None), (7, "keep", None)]
    assert urls.url_filter(captures, entries.limit(0)).count() == len(rows)
    assert urls.url_filter(captures.limit(0), entries).count() == 0


def plain_phrases(base, text):
    """Longest matches that a text is parsed into, from left to right, by searching the base again and again."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in base:
            n += 1
        count, at = count + 1, at + n
    return count


def test_suffix_automata_parse_like_a_search():
    rng = np.random.default_rng(3)
    bases = {k: "".join(rng.choice(list("ab é"), 80)) for k in "xyz"}
    texts = [f" {''.join(rng.choice(list('ab éq'), rng.integers(1, 90)))} " for _ in range(50)] + ["", "a", " é "]
    parser = language.CrossParser(bases)
    for block in (language.BLOCK, 7):
        language.BLOCK, before = block, language.BLOCK
        try:
            costs = parser.costs(texts)
        finally:
            language.BLOCK = before
        for row, text in zip(costs, texts, strict=True):
            raw = text.encode()
            want = [sum(plain_phrases(b.encode(), raw[at : at + block]) for at in range(0, len(raw), block)) * np.log2(len(b.encode())) for b in bases.values()]
            assert np.allclose(row, want)


def test_the_language_query_equals_a_plain_parse(spark, data):
    """The query over its whole table, against a search in the learned texts, text by text."""
    from rasterloom.llm import registry

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows}
    learned = language.learn(spark.createDataFrame([r for r in rows if fold[r["doc_id"]] != 2], docs.select("doc_id", "text", "lang").schema))
    got = {r["doc_id"]: r for r in registry.op8_language_id(spark, data).collect()}
    assert got.keys() == fold.keys() and all(r["held_out"] == (fold[i] == 2) for i, r in got.items())
    bases = {k: v.encode() for k, v in learned.items()}
    for r in sorted(rows, key=lambda r: len(r["text"] or ""))[: len(rows) // 3]:  # the plain parse is slow for long ones
        raw = language.letters(r["text"]).encode()
        want = ("und", 0.0)
        if raw:
            costs = sorted((sum(plain_phrases(b, raw[at : at + language.BLOCK]) for at in range(0, len(raw), language.BLOCK)) * np.log2(len(b)), i, k) for i, (k, b) in enumerate(bases.items()))
            want = (costs[0][2], 1 - costs[0][0] / costs[1][0])
        assert got[r["doc_id"]]["lang_pred"] == want[0] and abs(got[r["doc_id"]]["score"] - want[1]) < 1e-12


def test_languages(spark, data, odd_docs):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r for r in language.held_out_languages(docs).collect()}
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert len(got) == docs.count() and sum(right) / len(right) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    odd = language.identify(odd_docs, {"en": " the one two three ", "fr": " le un deux trois "}).collect()
    of = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert [of[i] for i in (1, 2, 3, 4, 10)] == ["en", "und", "und", "und", "und"] and len(of) == 11 and len(odd) == odd_docs.count()
    assert language.identify(odd_docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language.held_out_languages(docs.limit(0)).count() == 0
    held = language.held_out_languages(odd_docs).collect()
    assert len(held) == odd_docs.count() and all(r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)


def test_learned_samples_keep_their_bounds(spark):
    rows = [(i, f"wort{i} " * 900, "de") for i in range(300)] + [(7, "anders", "de"), (None, "ohne", "de"), (8, None, "en"), (9, "some words", None)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned.keys() == {"de"} and len(learned["de"]) == language.SAMPLE_CHARS and learned["de"].count("wort12 ") <= language.DOC_CHARS


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    scores, moves, start = rng.standard_normal(5), rng.standard_normal((2, 2)), 0.3
    total, on = 0.0, np.zeros(5)
    for path in itertools.product((0, 1), repeat=5):
        weight = np.exp(start * path[0] + sum(scores[i] for i in range(5) if path[i]) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += weight
        on += weight * np.array(path)
    p, _ = toxicity.forward_backward(np.array([[*scores, 0.0, 0.0]]), np.array([5]), moves, start)
    assert np.allclose(p[0, :5], on / total) and not p[0, 5:].any()
    long = rng.standard_normal(3 * toxicity.CHAIN + 7)
    whole = toxicity.marginals(np.concatenate([scores, long, scores]), np.array([5, len(long), 5]), moves, start)
    assert np.allclose(whole[:5], on / total) and np.allclose(whole[-5:], on / total)


def plain_toxicity(model, text):
    step, values = np.exp(model.moves), []
    for line in text.split("\n"):
        lifts = [np.exp(np.clip(sum(model.weights.get(f, 0.0) for f in ["", *toxicity.features(w.lower())]), -30, 30)) for w in re.findall(r"[^\W\d_]+", line)]
        for at in range(0, len(lifts), toxicity.CHAIN):
            part = lifts[at : at + toxicity.CHAIN]
            ahead, behind = [np.array([1.0, np.exp(model.start) * part[0]])], [np.ones(2)]
            for x in part[1:]:
                now = (ahead[-1] @ step) * [1.0, x]
                ahead.append(now / now.sum())
            for x in part[:0:-1]:
                now = step @ (behind[0] * [1.0, x])
                behind.insert(0, now / now.sum())
            values += [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, behind, strict=True)]
    most = np.clip(max(values, default=1e-7), 1e-7, 1 - 1e-7)
    x = [1.0, np.log(most / (1 - most)) / 4, np.log1p(sum(v > 0.5 for v in values)), min(1.0, 20 * sum(values) / (len(values) + 20))]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, model.fit), -30, 30)))


def test_toxicity_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.held_out_toxicity(docs, labels).collect()}
    pairs = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(got) == docs.count() and sum(t and p for t, p in pairs) >= 0.6 * sum(t for t, _ in pairs) and sum(p and not t for t, p in pairs) <= 2
    # every text against a plain chain: one word after another, in the two states
    model = toxicity.learn(docs, labels.where(toxicity.fold_of() != 1))
    for r in docs.collect():
        assert abs(got[r["doc_id"]]["score"] - plain_toxicity(model, r["text"] or "")) < 1e-9
    hit = next(r for r in got.values() if r["predicted"] and r["spans"])
    odd = toxicity.held_out_toxicity(docs.select("doc_id", "text").union(docs.limit(3).selectExpr("cast(null as long)", "text")).union(docs.limit(3).select("doc_id", "text")), labels).collect()
    assert len(odd) == docs.count() + 6 and all(r["held_out"] is False for r in odd if r["doc_id"] is None)
    text = docs.where(f"doc_id = {hit['doc_id']}").first()["text"]
    assert all(text[s["start"] : s["stop"]] == s["word"] and not re.search(r"\s", s["word"]) for s in hit["spans"])


def test_odd_texts_in_toxicity(spark, odd_docs):
    model = toxicity.train(["you fool today", "nice day today", "fool again today", "sunny again day"] * 6, [1, 0, 1, 0] * 6)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert {r["predicted"] for r in toxicity.score(odd_docs, None).collect()} == {0}
    assert toxicity.without_toxic(odd_docs, model).columns == odd_docs.columns
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(odd_docs, none) is None and toxicity.held_out_toxicity(odd_docs.limit(0), none).count() == 0


def test_short_sentences_at_the_end_of_a_passage_go_too(spark):
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n)) + "."
    passage = " ".join([say("a", 15), say("b", 15), say("c", 4)])
    docs = [(d, f"{say(f'x{d}', 9)} {passage} {say(f'y{d}', 30)}") for d in (1, 2)]
    got = {r["doc_id"]: r["text"] for r in spans.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), ends_too=True).collect()}
    assert got == {1: docs[0][1], 2: f"{say('x2', 9)} {say('y2', 30)}"}


def test_long_urls_and_ties(spark):
    long = "http://a.com/" + "/".join(["p" * 50] * 400)
    captures = spark.createDataFrame([(1, long, "2024-02-01"), (1, long, "2024-02-01"), (None, "http://a.com", "2024-02-01")], "page_id long, url string, day string").selectExpr("page_id", "url", "cast(day as date) as fetched")
    entries = spark.createDataFrame([("a.com", "2024-01-01", "block"), ("a.com", "2024-01-01", "block")], "key string, day string, action string").selectExpr("key", "cast(day as date) as dated", "action")
    assert [r["verdict"] for r in urls.url_filter(captures, entries).collect()] == ["block"] * 3


def test_samples_of_repeated_ids_have_one_row_each(spark):
    docs = spark.createDataFrame([(i % 12, ("you fool today" if i % 2 else "nice day today") + " x" * 9000, "en") for i in range(48)] + [(None, "fool", "en"), (99, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i % 12, i % 2) for i in range(24)] + [(None, 1), (99, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model is not None and model.scores(["you fool today"])[0] > model.scores(["nice day today"])[0]
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
