import numpy as np
import pytest
import xxhash

from rasterloom.llm import simhash as S
from rasterloom.llm.graph import components


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_its_definition():
    for text in ("", "  ", "A", "one Two", "a b c", "a b c a b c a b c d", "Été \x0b x   y z", "x " * 300):
        assert int.from_bytes(S.fingerprint(text.encode()), "big") == plain_fingerprint(text), text


@pytest.mark.parametrize("count", [1, 2, 31, 700])
def test_index_finds_all_pairs_within_the_radius(count):
    rng = np.random.default_rng(count)
    fps = rng.integers(0, 2**64, count, dtype=np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, count).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, count).astype(np.uint64))
    every = np.concatenate([fps, near, fps[: count // 2]])
    q, m = S.GrayIndex(every).search(every, 2)
    want = np.argwhere(np.bitwise_count(every[:, None] ^ every[None, :]) <= 2)
    assert sorted(zip(q.tolist(), m.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("block", [10_000, 8, 2])
def test_links_over_the_cluster_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base[:20] ^ (np.uint64(1) << np.uint64(k)) for k in (0, 3, 62)], base[:10] ^ np.uint64(0b111), np.array([0, 1, 3], np.uint64)]))
    rows = [(int(i) * 3, int(f.astype(np.int64)), 0) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, fp long, tab int")
    got = {r["node"]: r["component"] for r in components(S.fingerprint_links(nodes, 2, block=block)).collect()}
    ids = [r[0] for r in rows]
    pairs = [(ids[a], ids[b]) for a, b in np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2) if a < b]
    want = roots(ids, pairs)
    assert {i: got.get(i, i) for i in ids} == want


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5), (None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = [(a, b) for a, b in links if a is not None and a != b]
    assert got == {k: v for k, v in roots({x for p in ends for x in p}, ends).items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_query_equals_brute_force(spark):
    """op5 over whole documents: fingerprints by definition, and components of all pairs within 2 bits."""
    from rasterloom.llm import registry

    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    fps = np.array([plain_fingerprint(r["text"] or "") for r in docs], np.uint64)
    ids = [r["doc_id"] for r in docs]
    pairs = [(ids[a], ids[b]) for a, b in np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2) if a < b]
    want, got = roots(ids, pairs), {r["doc_id"]: r for r in registry.op5_simhash_dedup(spark, data).collect()}
    assert {i: (got[i]["fingerprint"], got[i]["component_id"]) for i in ids} == {i: (f"{int(f):016x}", want[i]) for i, f in zip(ids, fps, strict=True)}


def test_odd_documents(odd_docs):
    got = S.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.where("doc_id is not null").count()
    of = {r["doc_id"]: r for r in got}
    assert of[2]["fingerprint"] == of[3]["fingerprint"] == "0" * 16 and of[4]["component_id"] == of[2]["component_id"] == 2
    assert of[5]["component_id"] == of[6]["component_id"] == 5 and of[7]["component_id"] == 1
    assert S.near_duplicates(odd_docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, odd_docs):
    kept = S.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [0, 1, 2, 5, 8, 9, 10]


def test_similar_texts_are_grouped_and_others_are_not(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    rows, want = [], {}
    for g in range(40):
        text = rng.choice(words, 300).tolist()
        for k in range(3):
            copy = list(text)
            for at in rng.choice(300, k, replace=False):  # one or two words of 300: similarity 0.9 and more
                copy[at] = f"x{g}_{k}"
            rows.append((g * 10 + k, " ".join(copy)))
            want[g * 10 + k] = g * 10
    got = {r["doc_id"]: r["component_id"] for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def plain_similarity(x, y):
    a, b = ({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} for words in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


def test_texts_with_blocks_appended_cut_off_or_replaced_are_grouped(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(60):
        share = (0.8, 0.82, 0.85, 0.9, 0.95)[g % 5]
        text = [f"w{g}_{i}" for i in rng.integers(0, 900, 400)]
        fresh = [f"x{g}_{i}" for i in rng.integers(0, 900, 400)]
        alone = round(400 * (1 - share) / (1 + share)) - 4  # of either side, where a block is replaced
        other = (text + fresh[: int(396 / share) - 396], text[: 5 + int(396 * share)], text[:100] + fresh[:alone] + text[100 + alone :])[g // 5 % 3]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(other))]
    similar = [plain_similarity(rows[i][1], rows[i + 1][1]) for i in range(0, 120, 2)]
    assert sum(s >= 0.8 for s in similar) >= 55 and min(similar) > 0.78
    got = {r["doc_id"]: r["component_id"] for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if similar[i // 2] >= 0.8 else i for i in range(120)}


def test_a_large_block_is_joined_in_chunks(spark, monkeypatch):
    """Near copies of one text, some of them far from most others, and texts that share keys but are not similar."""
    rng = np.random.default_rng(21)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(260):
        text = list(base)
        for at in rng.choice(150, rng.integers(1, 7), replace=False):
            text[at] = f"x{k}_{at}"
        rows.append((k, " ".join(text)))
    links = [(i, j) for i in range(260) for j in range(i) if plain_similarity(rows[i][1], rows[j][1]) >= 0.8]
    want = roots(range(260), links)
    assert 2 < len(set(want.values())) and 100 < len(links) < 260 * 259 / 2
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "CHUNK_SHINGLES", 4000)
    got = {r["doc_id"]: r["component_id"] for r in S.similar_documents(table).collect()}
    lost = [(i, j) for i, j in links if got[i] != got[j]]
    assert not lost and got == want


def test_texts_below_the_similarity_are_not_grouped(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g in range(60):
        text = [f"w{g}_{i}" for i in rng.integers(0, 900, 400)]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(text[: 5 + int(396 * (0.72 + 0.075 * g / 60))]))]
    line = " ".join(f"common{i}" for i in range(12))
    for g in range(2):  # otherwise different texts with one line 40 times
        rows.append((200 + g, "\n".join([line] * 40 + [f"y{g}_{i}" for i in range(60)])))
    similar = [plain_similarity(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)]
    assert max(similar) < 0.8 and min(similar[:60]) > 0.7
    got = S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got) and len(got) == 122
