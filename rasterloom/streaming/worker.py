"""A worker that makes pages as requests arrive: files of requests in a folder, regions and numbers of their pages in another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import grids as G
from ..operators import maker as M

#: A request: an id, the width of a picture, its pixels as hexadecimal digits (blue, green, red, row by row), and settings by name.
REQUEST = "image_id long, width int, pixels string, settings map<string, double>"
ANSWER = "image_id long, status string, region_id int, color int, area long, b int, g int, r int, number string, x0 int, y0 int, x1 int, y1 int"
_WHOLE = {"num_colors", "detail_weight"}


def answered(requests: DataFrame) -> DataFrame:
    """The regions of the page of each request, batch or stream. A request that can't be made into a page has one row that says why."""

    def run(batches):
        columns = [c.split(" ")[0] for c in ANSWER.split(", ")]
        for batch in batches:
            out = []
            for request in batch.itertuples(index=False):
                try:
                    bgr = np.frombuffer(bytes.fromhex(request.pixels), np.uint8).reshape(-1, request.width, 3)
                    chosen = {k: int(v) if k in _WHOLE else v for k, v in dict(request.settings or {}).items()}
                    page = M.make_page(bgr, M.Params(**chosen))
                except (ValueError, TypeError) as error:
                    out.append((request.image_id, f"{type(error).__name__}: {error}", *[None] * (len(columns) - 2)))
                    continue
                areas = G.tally(page.ids, len(page.colors))
                out += [(request.image_id, "ok", x.region, int(page.colors[x.region]), int(areas[x.region]), *page.palette[page.colors[x.region]].tolist(), x.text, *x.box) for x in page.labels]
            yield pd.DataFrame(out, columns=columns)

    return requests.mapInPandas(run, ANSWER)


def serve(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers the requests in a folder, and those that are put there later, exactly once each; with `once` it ends when all that
    are there are answered."""
    requests = spark.readStream.schema(REQUEST).json(folder)
    writer = answered(requests).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
