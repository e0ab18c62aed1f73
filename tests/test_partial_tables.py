"""Queries of the album equal their SQL on odd tables: pictures that lack tiles, colours far from those of all labels."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_queries import plain

from rasterloom import catalog


def differing(spark, folder, name, ids, values):
    """Rows of a query and of its SQL over those embeddings, as far as they differ."""
    columns = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(values), pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}
    pq.write_table(pa.table(columns), folder / "embeddings.parquet")
    df = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    got = [plain(r) for r in df.collect()]
    assert len(got) == len(want) > 0
    return set(got) ^ {plain(r) for r in want}


@pytest.mark.parametrize("ids", [range(31), [*range(7), *range(9, 25), 26, 37, 49], [12], [60]])
def test_similarity_of_pictures_that_lack_tiles(spark, tmp_path, ids):
    values = np.random.default_rng(5).normal(0, 0.125, (len(ids), 64))
    assert not differing(spark, tmp_path, "ssim_mean", list(ids), values)


# Seeds of pictures in which two shares differ from the tenth decimal place on.
@pytest.mark.parametrize("seed, spread", [(64, 0.25), (3, 0.5), (233, 1.0), (109, 2.0)])
def test_votes_that_tie_to_nine_digits(spark, tmp_path, seed, spread):
    values = np.random.default_rng(seed).normal(0, spread, (100, 64))
    assert not differing(spark, tmp_path, "edge_vote", list(range(100)), values)
