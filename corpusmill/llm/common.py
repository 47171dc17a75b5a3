"""Shared-folder tables, pruned joins and small helpers of the operators in this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so a batch of the default 10,000 rows could be gigabytes.
BATCH_ROWS = 400


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of long texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """For the actions inside, exactly so many rows in an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder. They cut lineage, so a lost executor costs one stage and not the whole job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_slices(self, name: str, slices: int, make) -> DataFrame:
        """The union of make(0) to make(slices - 1), each a job of its own, so that only one slice's shuffle files exist at a time."""
        for s in range(slices):
            df = make(s)
            df.write.option("compression", "zstd").parquet(self.path(f"{name}/slice={s}"))
            self.release()
        return self.spark.read.schema(df.schema).parquet(*(self.path(f"{name}/slice={s}") for s in range(slices)))

    def drop(self, *names: str) -> None:
        """Free the disk of tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Free the shuffle files of finished steps now, not when the driver next happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Slots of the membership bitmap; each holds 64 bits. The broadcast table never exceeds this many rows.
BITMAP_SLOTS = 1 << 16


def quoted(name: str) -> str:
    """A column name as col() takes it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def unused(rows: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of the rows."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_SLOTS)).cast("int")


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(key), F.lit(64)))


def bitmap_of(ids: DataFrame, key: str, slot: str, bits: str) -> DataFrame:
    """A Bloom bitmap of a key column: at most BITMAP_SLOTS rows whatever the input, thus safe to broadcast."""
    return ids.filter(F.col(key).isNotNull()).groupBy(_slot(F.col(key)).alias(slot)).agg(F.bit_or(_bit(F.col(key))).alias(bits))


def _split(rows: DataFrame, ids: DataFrame, key: Column, id_key: str) -> tuple[DataFrame, DataFrame, DataFrame, str, Column]:
    """The rows that hit the bitmap, those that do not, the distinct ids, the name of the key in the first and of the ids' column."""
    slot, bits, own, other = unused(rows, "_slot", "_bits", "_own", "_other")
    named = [F.col(quoted(c)) for c in rows.columns]
    marked = rows.select(*named, key.alias(own), _slot(key).alias(slot)).join(F.broadcast(bitmap_of(ids, id_key, slot, bits)), slot, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(_bit(F.col(own))) != 0, F.lit(False))
    return marked.filter(hit).select(*named, own), marked.filter(~hit).select(*named), ids.select(F.col(id_key).alias(other)).distinct(), own, F.col(own) == F.col(other)


def _key(rows: DataFrame, key: str | Column) -> Column:
    return F.col(quoted(key)) if isinstance(key, str) else key


def semi_join(rows: DataFrame, ids: DataFrame, key: str | Column, id_key: str) -> DataFrame:
    """Rows whose key (a column or an expression on them) is among the ids. The bitmap drops almost all others before wide rows would be shuffled; the join after it is exact."""
    near, _, known, own, same = _split(rows, ids, _key(rows, key), id_key)
    return near.join(known, same, "left_semi").drop(own)


def anti_join(rows: DataFrame, ids: DataFrame, key: str | Column, id_key: str) -> DataFrame:
    """Rows whose key (a column or an expression on them) is not among the ids (a null key stays). Only rows that hit the bitmap are shuffled."""
    near, clear, known, own, same = _split(rows, ids, _key(rows, key), id_key)
    return clear.unionByName(near.join(known, same, "left_anti").drop(own))


def text_key(column: str = "text") -> Column:
    """A key of the text itself, 128 bits of it; a null has a key of its own. Rows with one key have one text, whatever their ids."""
    return F.coalesce(F.md5(F.encode(F.col(quoted(column)).cast("string"), "UTF-8")), F.lit(""))
