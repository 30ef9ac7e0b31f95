"""Contiguous shards of balanced byte size from prefix sums of partition totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm.common import table
from verdance.storage import materialize

N_SHARDS = 24


def shards_by_bytes(rows: DataFrame, id_col: str, size_col: str, n_shards: int) -> DataFrame:
    """Deal rows, in the order of ``id_col``, to ``n_shards`` contiguous shards of near equal bytes.

    ``rows`` holds the id, a non-negative byte size (null: 0) and any further
    narrow columns but those added here; payloads stay where they are, since
    only this narrow table is sorted.  Adds ``shard`` (from 0, rising with the
    id), ``slot`` (0, 1, ... inside a shard without gaps) and ``bytes_before``.

    Rows are range partitioned once and written with the sums inside their
    partition; one total per partition then gives every partition the bytes
    and rows before it.  A row belongs to the shard that holds its middle byte,
    so a shard differs from the equal share by less than one row at each end.
    Null ids come first; rows with equal ids are ordered by their other
    columns and rows equal in all columns are interchangeable.  A shard can be
    empty if one row is larger than a share.  If all sizes are 0 every row is
    in shard 0.  An empty table gives an empty result.
    """
    cols = [id_col, *[c for c in rows.columns if c != id_col]]
    rows = rows.select(*cols).withColumn(size_col, F.coalesce(F.col(size_col).cast("long"), F.lit(0)))
    order = [F.col(c).asc_nulls_first() for c in cols]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = b.column(size_col).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(size)
            added = [np.full(len(size), part, np.int32), n + np.arange(len(size)), ends - size]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, added)], names=[*b.schema.names, "part", "rows_in_part", "bytes_in_part"])
            n, total = n + len(size), int(ends[-1]) if len(ends) else total

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, rows_in_part long, bytes_in_part long"
    placed = materialize(ranged.mapInArrow(summed, schema), "shard-prefix")
    totals = placed.groupBy("part").agg(F.sum(size_col).alias("b"), F.count("*").alias("r"))
    # One row per partition: bounded by the number of partitions, not by the rows.
    before = totals.selectExpr("part", "sum(b) over (order by part) - b as bytes_0", "sum(r) over (order by part) - r as rows_0", "sum(b) over () as bytes_all")
    cut = placed.join(F.broadcast(before), "part").select(
        *cols,
        (F.col("bytes_0") + F.col("bytes_in_part")).alias("bytes_before"),
        (F.col("rows_0") + F.col("rows_in_part")).alias("at"),
        F.expr(f"case when bytes_all = 0 then 0 else cast(least({n_shards - 1}, ((bytes_0 + bytes_in_part) * 2 + `{size_col}`) * {n_shards} div (2 * bytes_all)) as int) end").alias("shard"),
    )
    first = cut.groupBy("shard").agg(F.min("at").alias("first_at"))  # one row per shard
    return cut.join(F.broadcast(first), "shard").select(*cols, "bytes_before", "shard", (F.col("at") - F.col("first_at")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards under the law ``bytes``; a null text has no bytes and checksum 0."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shards_by_bytes(docs, "doc_id", "size", N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
