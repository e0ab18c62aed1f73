import importlib.util

import duckdb
import pytest

from rasterloom.llm import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})").fetchall()
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(key, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(key, want))


def test_the_pipeline_keeps_columns_and_drops_what_it_should(spark, data):
    if not importlib.util.find_spec("corpus_pipeline"):
        pytest.skip("no pipeline here")
    import corpus_pipeline
    from rasterloom.llm.common import cut

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, data), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] >= sizes[4] > 0.5 * sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[4]


def test_the_pipeline_takes_odd_documents(spark, data, odd_docs):
    """Nulls, empty and very long texts, repeated and missing ids, clashing columns: every stage decides as its operator says."""
    if not importlib.util.find_spec("corpus_pipeline"):
        pytest.skip("no pipeline here")
    import corpus_pipeline
    from rasterloom.llm.common import cut

    docs, kept = odd_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, data), name)
        kept[name] = sorted(r["doc_id"] or 0 for r in docs.select("doc_id").distinct().collect())
        assert name == "packing" or docs.columns == odd_docs.columns
    assert kept["toxicity"] == kept["line_dedup"] == list(range(11)) and kept["simhash_dedup"] == kept["decontamination"] == [0, 1, 2, 5, 8, 9, 10]
    assert kept["packing"] == kept["decontamination"] and docs.where("length <= 0 or offset < 0").isEmpty()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.limit(0), data).count() == 0
