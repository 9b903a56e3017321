"""Shared helpers: table access, shared folders and batching."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used in local mode only, where the session names no checkpoint folder (tests, notebooks).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tessella"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches of at most ``BATCH_BYTES``, so that memory is bounded whatever the rows hold.

    The setting stays, as Spark reads it when the returned plan runs; a smaller one is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a cluster session has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if path is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{LOCAL_CHECKPOINTS}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so a lost executor costs a reread only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet (ZSTD) under the shared folder and read it back; ``release`` removes it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _folders.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_folders: dict[str, list[str]] = {}


def held_folders(spark: SparkSession) -> list[str]:
    """Folders written by this application and not released."""
    return _folders.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, keep: list[str] | None = None) -> None:
    """Remove the stored folders but ``keep``: for callers that are done with the results read from them."""
    held, keep = held_folders(spark), keep or []
    for path in [p for p in held if p not in keep]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        held.remove(path)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], found) -> Iterator[pa.RecordBatch]:
    """Pass rows, sorted by their keys, on to ``found`` in tables that cut no group."""
    held: list[pa.RecordBatch] = []
    key_at = lambda batch, k: tuple(batch.column(c)[k].as_py() for c in keys)
    for batch in batches:
        if not len(batch):
            continue
        # keep the last group back, as the next batch may go on with it
        last = key_at(batch, len(batch) - 1)
        same = np.all([batch.column(c).to_numpy() == v for c, v in zip(keys, last, strict=True)], axis=0)
        tail = int(np.argmax(same))
        if held and (tail or key_at(held[-1], 0) != last):
            yield from found(pa.Table.from_batches([*held, batch.slice(0, tail)]))
            held = []
        elif tail:
            yield from found(pa.Table.from_batches([batch.slice(0, tail)]))
        held.append(batch.slice(tail))
    if held:
        yield from found(pa.Table.from_batches(held))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(texts: pa.Array | list[str | None], limit: int = 500_000) -> Iterator[tuple[int, int, list[str]]]:
    """Cut a column into runs of about ``limit`` bytes: (start, stop, texts, null as empty).

    Only one run at a time becomes Python strings.
    """
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop
