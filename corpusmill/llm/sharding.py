"""Contiguous balanced shards from global byte-size prefix sums.

Rows are range-partitioned by id and each partition reports one total; the totals give each partition's offset, and a
running sum inside the partition then places every row in the global byte order. A row belongs to the shard in which the
middle of its bytes lies, so shards are contiguous in id order and miss the equal target by at most half a row at each end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1; a null text has no bytes) and text_crc32 of every row; the text goes no further."""
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def global_order(rows: DataFrame, scratch: Scratch, order: str, size: str) -> tuple[DataFrame, int]:
    """The rows with `_index` (global row number) and `_start` (sum of the sizes of all rows before), and the whole size.

    Ties of the order column go by size and then by the other columns; equal rows are exchangeable. Nulls come first.
    """
    spark = rows.sparkSession
    keys = [order, size, *(c for c in rows.columns if c not in (order, size))]
    # the source partition is the last key: a value that a large part of the rows share is still cut between partitions
    dealt = rows.withColumn("_src", F.spark_partition_id()).repartitionByRange(*keys, "_src")
    placed = scratch.write("placed", dealt.drop("_src").withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(F.sum(size).alias("size"), F.count("*").alias("n")).collect()  # one row a partition
    offsets, before, count = [], 0, 0
    for p in sorted(parts):
        offsets.append((p["_part"], before, count))
        before, count = before + p["size"], count + p["n"]
    upto = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({"_run": F.sum(size).over(upto), "_row": F.row_number().over(upto)})
    base = spark.createDataFrame(offsets, "_part int, _bytes long, _rows long")
    out = local.join(F.broadcast(base), "_part").withColumns({"_start": F.col("_bytes") + F.col("_run") - F.col(size), "_index": F.col("_rows") + F.col("_row") - 1})
    return out.select(*rows.columns, "_index", "_start"), before


def shard(rows: DataFrame, shards: int, order: str = "doc_id", size: str = "size") -> DataFrame:
    """The rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard), contiguous in the order of a column.

    Every row lands in one shard, also where a single row exceeds the target; a shard may then be empty. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "sharding")
    placed, whole = global_order(rows, scratch, order, size)
    middle = F.col("_start") * 2 + F.col(size)
    index = F.least(F.floor(middle / F.lit(2.0 * max(whole, 1)) * shards), F.lit(shards - 1)).cast("int")
    done = scratch.write("sharded", placed.withColumn("shard", index))
    scratch.drop("placed")
    first = done.groupBy("shard").agg(F.min("_index").alias("_first"))  # at most `shards` rows
    return done.join(F.broadcast(first), "shard").withColumn("slot", F.col("_index") - F.col("_first")).select(*rows.columns, "shard", "slot")
