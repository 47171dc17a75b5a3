"""Difference of two snapshots of a table whose keys may have been given anew.

Only keys and codes of columns travel: each text is read once, where it is stored, and becomes 64-bit codes of its columns, a
128-bit code of its content and the digest that is reported. Rows are dealt by their keys; in a task the keys of both sides are
sorted arrays, intersected by searchsorted. What finds no partner is dealt in ranges of content code and key, so that a content
that a third of all rows share spreads over many tasks; run boundaries give the places within a content, and the counts of the
runs that cross from one task into the next are added. Then rows are dealt by content and place, lexsorted by these codes, and
neighbours of different sides are pairs.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, anti_join, quoted, semi_join

#: Rows that one task holds as arrays, about 100 bytes each, and the most ranges that places are counted over: a range streams, so that it may be of any size.
TASK_ROWS, MOST_RANGES = 500_000, 4096
SAME, UPDATE, REKEY, INSERT, DELETE = OPS = ("same", "update", "rekey", "insert", "delete")


def _coded(rows: DataFrame, side: int, key: str, content: tuple[str, ...], compared: tuple[str, ...]) -> DataFrame:
    """side, key, a code x<i> of each compared column, the content's code (c1, c2), and the digest of a later row."""
    said = {c: F.col(quoted(c)).cast("string") for c in {*content, *compared}}
    code = lambda c, salt: F.when(said[c].isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(salt), said[c]))
    whole = F.concat_ws("\n", *(F.coalesce(said[c], F.lit("~")) for c in compared))
    sha = F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)) if side else F.lit(None).cast("binary")
    of = lambda salt: F.xxhash64(F.lit(salt), *(code(c, salt) for c in content))
    return rows.select(F.lit(side).alias("side"), F.col(quoted(key)).cast("long").alias("key"), *(code(c, 1).alias(f"x{i}") for i, c in enumerate(compared)), of(2).alias("c1"), of(3).alias("c2"), sha.alias("sha"))


@contextlib.contextmanager
def _samples(spark: SparkSession, rows: int):
    """For the actions inside, about so many sampled rows a range tell where ranges are cut; they go to the driver."""
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _ranked(rows: DataFrame, scratch: Scratch, name: str, group: list[str], order: list[Column]) -> DataFrame:
    """Adds place, from 0, of each row within its group in the order; rows come from a written table. No group meets in one task."""
    spark, count = rows.sparkSession, rows.count()
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_ROWS)))
    by = [f"o{i}" for i in range(len(order) + 1)]
    keyed = rows.withColumns(dict(zip(by, [*order, F.monotonically_increasing_id()], strict=True)))  # equal rows are told apart by where they are stored
    dealt = keyed.repartitionByRange(ranges, *group, *by).sortWithinPartitions(*group, *by).drop(*by)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held, head = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.stack([batch.column(c).to_numpy() for c in group])
            starts = np.ones(batch.num_rows, bool)
            starts[1:] = (g[:, 1:] != g[:, :-1]).any(axis=0)
            if last is not None and (g[:, 0] == last).all():
                starts[0] = False
            elif last is not None:
                head, held = False, 0
            run = np.cumsum(starts)  # rows before the first start go on with the run of the batch before
            began = np.concatenate([[-held], np.flatnonzero(starts)])
            place = np.arange(batch.num_rows) - began[run]
            first = (run == run[0]) & head
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(first), pa.array(np.full(batch.num_rows, part, np.int32))], names=[*batch.schema.names, "place", "head", "part"])
            head, held, last = bool(first[-1]), int(place[-1]) + 1, g[:, -1]

    shape = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, place long, head boolean, part int"
    with _samples(spark, 20):
        local = scratch.write(name, dealt.mapInArrow(places, shape))
    # of each range the first and the last group and how many rows they have there: one short row a range, whatever the table
    run = F.struct(*group)
    ends = local.groupBy("part").agg(F.min(run).alias("first"), F.max(run).alias("last"), F.max(F.struct(*group, "place"))["place"].alias("end"))
    carried, before, held = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r.part):
        more = held if r["first"] == before else 0
        if more:
            carried.append((r.part, more))
        held, before = r.end + 1 + (more if r["first"] == r["last"] else 0), r["last"]
    offsets = spark.createDataFrame(carried, "part int, more long")
    joined = local.join(F.broadcast(offsets), "part", "left")
    return joined.withColumn("place", F.col("place") + F.when(F.col("head"), F.coalesce("more", F.lit(0))).otherwise(0)).drop("part", "head", "more")


def _masks(table: pa.Table, old: np.ndarray, new: np.ndarray, width: int) -> np.ndarray:
    """A bit for each compared column in which the rows differ."""
    mask = np.zeros(len(old), np.int32)
    for i in range(width):
        x = table.column(f"x{i}").to_numpy()
        mask |= (x[old] != x[new]).astype(np.int32) << i
    return mask


def _told(table: pa.Table, op: np.ndarray, old: np.ndarray, new: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    """Result rows by the places of the earlier and the later row in the table; -1 is none."""
    at = lambda column, where: table.column(column).take(pa.array(where, mask=where < 0)).combine_chunks()
    key = at("key", np.where(new >= 0, new, old))
    return pa.RecordBatch.from_arrays([key, at("key", old), pa.array(op.astype(np.int32)), pa.array(mask), at("sha", new)], names=["key", "old_key", "op", "mask", "sha"])


_RESULT = "key long, old_key long, op int, mask int, sha binary"


def _slices(make, count: int, step: int = 50_000):
    for low in range(0, count, step):
        yield make(slice(low, low + step))


def difference(before: DataFrame, after: DataFrame, key: str = "doc_id", content: tuple[str, ...] = ("text", "lang"), compared: tuple[str, ...] = ("text", "lang", "source")) -> DataFrame:
    """key (the later, else the earlier), old_key, op, changed and row_sha256 of each pair and each row without a partner.

    Rows with equal keys pair (`same`, or `update` where a compared column differs); where a key repeats, the i-th of its rows on either
    side do, in the order of a code of their columns. A null key is equal to none. Of the rest, rows with equal content columns pair (`rekey`),
    the i-th smallest earlier key with the i-th largest later one, a null being the smallest. What remains is `insert` or `delete`. Nulls
    equal only nulls. changed lists a pair's differing columns in the order given. row_sha256 is of the later row's compared columns,
    joined by line feeds, a null as `~`; null for deletes. Equal rows are exchangeable. Empty tables pair nothing; other columns, whatever their
    names, play no part. Columns are compared by 64-bit codes, contents by 128-bit ones.
    """
    spark = before.sparkSession
    scratch, width = Scratch(spark, "difference"), len(compared)
    args = (key, tuple(content), tuple(compared))
    rows = scratch.write("coded", _coded(before, 0, *args).unionByName(_coded(after, 1, *args)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    code = F.xxhash64(*(f"x{i}" for i in range(width)), "c1", "c2")
    names = rows.columns
    keyed = rows.filter("key IS NOT NULL")
    repeated = scratch.write("repeated", keyed.groupBy("key", "side").agg(F.count("*").alias("c")).filter("c > 1").select("key").distinct())
    if repeated.limit(1).count():
        again = scratch.write("again", semi_join(keyed, repeated, "key", "key"))
        again = _ranked(again, scratch, "turns", ["key", "side"], [code])
        keyed = anti_join(keyed, repeated, "key", "key").withColumn("place", F.lit(0).cast("long")).unionByName(again)
    else:
        keyed = keyed.withColumn("place", F.lit(0).cast("long"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        value, turn, side = (table.column(c).to_numpy() for c in ("key", "place", "side"))
        if turn.any():
            value = np.unique(value, return_inverse=True)[1] * (int(turn.max()) + 1) + turn
        old, new = (np.flatnonzero(side == s) for s in (0, 1))
        old, new = old[np.argsort(value[old])], new[np.argsort(value[new])]
        place = np.searchsorted(value[new], value[old])
        hit = np.zeros(len(old), bool)
        inside = place < len(new)
        hit[inside] = value[new[place[inside]]] == value[old[inside]]
        a, b = old[hit], new[place[hit]]
        mask = _masks(table, a, b, width)
        none = np.setdiff1d(np.arange(len(value)), np.concatenate([a, b]))
        blank = [n for n in names if n not in ("key", "sha")]
        for part in _slices(lambda s: _told(table, (mask[s] > 0), a[s], b[s], mask[s]), len(a)):
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.nulls(part.num_rows, table.schema.field(n).type) for n in blank)], names=[*part.schema.names, *blank])
        for part in _slices(lambda s: table.take(pa.array(none[s])).combine_chunks(), len(none)):
            empty = {"old_key": pa.nulls(len(part), pa.int64()), "op": pa.array(np.full(len(part), -1, np.int32)), "mask": pa.nulls(len(part), pa.int32())}
            arrays = {**{n: part.column(n).combine_chunks() for n in names}, **empty}
            order = ["key", "old_key", "op", "mask", "sha", *blank]
            yield pa.RecordBatch.from_arrays([arrays[n] for n in order], names=order)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    more = ", ".join(f"{n} {kinds[n]}" for n in names if n not in ("key", "sha"))
    met = scratch.write("met", keyed.select(*names, "place").repartition(tasks, "key", "place").mapInArrow(meet, f"{_RESULT}, {more}"))
    scratch.drop("turns", "again")
    left = scratch.write("left", met.filter("op < 0").select(*names).unionByName(rows.filter("key IS NULL")))
    # smallest key first on the earlier side, largest first on the later one
    older = F.col("side") == 0
    known = F.when(older, F.col("key").isNotNull()).otherwise(F.col("key").isNull()).cast("int")
    value = F.coalesce("key", F.lit(0))
    placed = _ranked(left, scratch, "places", ["c1", "c2", "side"], [known, F.when(older, value).otherwise(F.bitwise_not(value)), code])

    def couple(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        c1, c2, place, side = (table.column(c).to_numpy() for c in ("c1", "c2", "place", "side"))
        order = np.lexsort((side, place, c2, c1))
        a, b = order[:-1], order[1:]
        pair = np.flatnonzero((c1[a] == c1[b]) & (c2[a] == c2[b]) & (place[a] == place[b]) & (side[a] < side[b]))
        old, new = a[pair], b[pair]
        none = np.setdiff1d(order, np.concatenate([old, new]))
        gone, come = none[side[none] == 0], none[side[none] == 1]
        nobody = lambda n: np.full(n, -1)
        old, new = np.concatenate([old, gone, nobody(len(come))]), np.concatenate([new, nobody(len(gone)), come])
        op = np.repeat([OPS.index(REKEY), OPS.index(DELETE), OPS.index(INSERT)], [len(pair), len(gone), len(come)])
        mask = np.zeros(len(op), np.int32)
        mask[: len(pair)] = _masks(table, old[: len(pair)], new[: len(pair)], width)
        yield from _slices(lambda s: _told(table, op[s], old[s], new[s], mask[s]), len(op))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-left.count() // TASK_ROWS))
    coupled = placed.select(*names, "place").repartition(tasks, "c1", "c2", "place").mapInArrow(couple, _RESULT)
    found = met.filter("op >= 0").select("key", "old_key", "op", "mask", "sha").unionByName(coupled)
    changed = F.concat_ws(",", *(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(c)) for i, c in enumerate(compared)))
    op = F.element_at(F.array(*map(F.lit, OPS)), F.col("op") + 1)
    return found.select("key", "old_key", op.alias("op"), changed.alias("changed"), F.lower(F.hex("sha")).alias("row_sha256"))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """documents as they are some time later: crc32 of the decimal doc_id modulo 25 says what becomes of a row (0 to 5; others, and a null doc_id, stay)."""
    r, new = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 25, -1 - F.col("doc_id")
    rows = docs.select("doc_id", "text", "lang", "source", F.coalesce(r, F.lit(25)).alias("r")).filter("r <> 0")
    r = F.col("r")
    changed = rows.select(
        F.when(r.isin(3, 4), new).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(r == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(r == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(r == 2, F.col("lang")).when(r != 4, F.col("source")).alias("source"),
    )
    return changed.unionByName(rows.filter("r = 5").select(new.alias("doc_id"), "text", "lang", "source"))
