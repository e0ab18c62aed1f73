import pytest

CLASH = {"node": 1, "fp": 2, "component": 3, "component_id": 4, "cell": 5, "member": True, "span": "s", "key": "k", "month": 6, "host": "h", "line": "l", "score": 0.5, "loser": 7, "n_lines": 9, "boiler_host": "b", "span_doc": 1, "rank": 0, "class": 1}


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with everything that may be wrong with them."""
    long_text = " ".join(f"word{i % 977} th{i}." for i in range(40_000))
    rows = [
        (1, "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, "   \n\t \n", "en", "a"),
        (5, long_text, "en", "b"),
        (6, long_text, None, "b"),
        (7, "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen.", "de", "a"),
        (7, "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen.", "de", "a"),
        (None, "no id at all", "fr", "c"),
        (8, "éß中文 \U0001f642 ́ 12 --- ... ", "fr", "a"),
        (9, "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc", "fr", None),
        (10, "12345 ... ---", "fr", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("long"))
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    return df.repartition(3, "doc_id")
