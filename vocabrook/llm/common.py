"""Helpers shared by the training-data operators: shared-folder tables, byte hashing, batching."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Python batches stay below this many bytes of text, so that numpy temporaries stay small.
CHUNK_BYTES = 2_000_000
#: Only used where spark.checkpoint.dir is unset and Spark runs in one process (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/vocabrook"
#: Spark's own setting: a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a local one is taken only if all of Spark is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = LOCAL_CHECKPOINTS
    return path.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, lost executors don't matter.

    The shuffle files of the query that writes it are dropped when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str = "") -> DataFrame:
    """df computed once and kept on the executors' disks by Spark, for slim rows that only the same query reads again.

    Unlike settle() it makes no files in the shared folder, which for small tables over many partitions are most of the work,
    and of which each costs a process beside the executor where Hadoop has no native library. Blocks of a lost executor are
    computed again; they stay until spark.catalog.clearCache(). name: as for settle(), not used.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def discard(*tables: DataFrame) -> None:
    """Drop tables made by settle()."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            if path.split("://")[-1].lstrip("/").startswith(shared_dir(spark).split("://")[-1].lstrip("/")):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts must not hold thousands of very long ones."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def built_once(shared, build):
    """build(what was broadcast), once a worker. shared: a broadcast of {"given": plain data}.

    The object is kept in the broadcast's own dict; its class comes with the function that asks, so workers need no copy of
    this package.
    """
    held = shared.value
    if "built" not in held:
        held["built"] = build(held["given"])
    return held["built"]


def crc_fold(doc_id) -> "F.Column":
    """crc32 of the decimal doc_id, mod 5; fold 0 is held out. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))


def chunks(batches: Iterator[pd.DataFrame], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """Cut pandas batches so that the text of each piece is about limit bytes, or one row."""
    for pdf in batches:
        if not len(pdf):
            continue
        size = pdf[column].map(lambda t: len(t) if isinstance(t, (str, bytes)) else 0).to_numpy()
        part = np.cumsum(size) // limit
        for k in np.unique(part):
            yield pdf[part == k]


# ---- vectorised hashing of bytes ------------------------------------------------------------

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63 - 1, 256, dtype=np.uint64) | np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by one space; and the start of each (one more at the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate([[0], np.cumsum(lengths)])


#: A random odd factor for each of a word's first bytes; places beyond them are mixed with the byte.
_FACTOR = _rng.integers(1, 2**63 - 1, 4096, dtype=np.uint64) | np.uint64(1)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each [start, end) of data."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    flat = np.flatnonzero(np.cumsum(inside[:-1]))
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    offset = np.arange(len(flat)) - np.repeat(first, lens)
    value = BYTE_CODE[data[flat]] * _FACTOR[np.minimum(offset, 4095)]
    far = np.flatnonzero(offset >= 4095)
    if len(far):
        value[far] = mix(BYTE_CODE[data[flat[far]]] + offset[far].astype(np.uint64) * _MULT)
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * _MULT)


# ---- places in groups of any size -----------------------------------------------------------

#: A side of a join is broadcast up to so many slim rows (about 100 bytes each), counted beforehand.
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has BROADCAST_ROWS rows at most; otherwise both sides are dealt by key."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def numbered(df: DataFrame, group: str, *order: str, name: str = "numbered", hold=settle) -> DataFrame:
    """df (slim, written) with `idx`, a row's place from 0 in its group by `order` (nulls first), and `n`, the group's rows.

    Rows are dealt by ranges of (group, order), so that no group has to fit in one task: a place is the one in its range
    plus the group's rows in earlier ranges. Only those counts, a row a group and range, meet by group. hold: settle or kept.
    """
    placed = hold(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_pos", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_pos", 33))
    whole = Window.partitionBy(group)
    parts = placed.groupBy(group, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = hold(parts.select(group, "_part", (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n")), f"{name}-parts")
    return placed.join(small_side(parts), [group, "_part"]).withColumn("idx", F.col("_pos") + F.col("_shift")).drop("_part", "_pos", "_shift")


def crc32_sql(x: str) -> str:
    """DuckDB SQL: the unsigned crc32 of an ASCII string, bit by bit with the reversed polynomial."""
    step = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda a: ascii(a)::BIGINT)), lambda c, b: {step}), 4294967295)"
