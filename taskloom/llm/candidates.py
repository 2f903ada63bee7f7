"""The rows of a table whose ids are probably in another: a filter of fixed size, so that only their texts are moved."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 1 MB, whatever the number of ids. It only spares work: a full one lets every row pass.
BITS = 1 << 23


def bloom(nodes: DataFrame, column: str) -> np.ndarray:
    """A bit for each id's hash. At most BITS / 8 rows come to the driver."""
    at = f"cast(pmod(xxhash64({column}), {BITS}) as int)"
    rows = nodes.select(F.expr(f"{at} div 8").cast("int").alias("byte"), F.expr(f"shiftleft(1, {at} % 8)").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy()
    return out


def likely(rows: DataFrame, nodes: DataFrame, column: str, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """The rows whose `column` is in that of nodes, and a few others. `then` maps what is left in the same worker, to `schema`."""
    bits = rows.sparkSession.sparkContext.broadcast(bloom(nodes, column))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("_at").to_numpy()
            kept = batch.filter(pa.array((bits.value[p >> 3] >> (p & 7) & 1).astype(bool)))
            if kept.num_rows:
                yield kept.drop_columns(["_at"])

    marked = rows.withColumn("_at", F.pmod(F.xxhash64(column), F.lit(BITS)))
    return marked.mapInArrow(sift, rows.schema) if then is None else marked.mapInArrow(lambda batches: then(sift(batches)), schema)
