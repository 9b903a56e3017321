"""Document fingerprints by Order MinHash.

A text's items are its k-mers of characters, each with its occurrence number, so
repeats count.  For each of ``ROWS`` random orders the ``KEEP`` least items are
taken, put back in text order and hashed together; two texts agree in a row if
they share those items in the same order, which edits and moved passages disturb.

An order is a random permutation of the items' 32-bit hashes (an odd factor and
an addend of its own), so orders are independent of each other and one rule holds
for texts of every length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches, stored
from .pretoken import code_points, mixed

K = 8
ROWS = 64
KEEP = 2
#: Items that are ordered at a time.
COLUMNS = 4096
#: k-mers up to this number are sorted with their positions in one word.
POSITION_BITS = 24

_RNG = np.random.default_rng(20250131)
_PLACE = (_RNG.integers(0, 1 << 63, K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_FACTOR = (_RNG.integers(0, 1 << 32, ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADDEND = _RNG.integers(0, 1 << 32, ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_MULT = np.uint64(0xD6E8FEB86659FD93)


def _kmers(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k-mer hash at each start, and the number of k-mers of each text (at least 1 unless empty)."""
    n = len(points)
    lengths = np.diff(offsets)
    counts = np.where(lengths >= K, lengths - K + 1, np.minimum(lengths, 1))
    padded = np.concatenate([points.astype(np.uint64) + np.uint64(1), np.zeros(K, np.uint64)])
    sums = np.zeros(n, np.uint64)
    for k in range(K):
        sums += padded[k : k + n] * _PLACE[k]
    for d in np.flatnonzero((lengths < K) & (lengths > 0)).tolist():
        a, b = offsets[d], offsets[d + 1]
        sums[a] = (padded[a:b] * _PLACE[: b - a]).sum()
    return mixed(sums), counts


def _items(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of the items of one text, in text order."""
    n, shift = len(h), np.uint64(POSITION_BITS)
    if n <= 1 << POSITION_BITS:
        low = np.uint64((1 << POSITION_BITS) - 1)
        packed = (h & ~low) | np.arange(n, dtype=np.uint64)
        packed.sort()
        name, place = packed >> shift, (packed & low).astype(np.int64)
    else:
        place = np.argsort(h >> shift, kind="stable")
        name = h[place] >> shift
    seen = np.arange(n)
    new = np.concatenate([[True], name[1:] != name[:-1]])
    number = seen - np.maximum.accumulate(np.where(new, seen, 0))
    out = np.empty(n, np.uint32)
    out[place] = mixed(name * _MULT + number.astype(np.uint64)) >> np.uint64(32)
    return out


def _rows(h: np.ndarray) -> np.ndarray:
    """The fingerprint of one text from its k-mer hashes in text order."""
    if not len(h):
        return np.zeros(ROWS, np.uint16)
    items, line = _items(h), np.arange(ROWS)
    ranks, places = [], []
    for a in range(0, len(items), COLUMNS):
        order = items[a : a + COLUMNS] * _FACTOR + _ADDEND
        for k in range(min(KEEP, order.shape[1])):
            at = order.argmin(1)
            ranks.append(order[line, at])
            places.append(at + a)
            if k + 1 < KEEP:
                order[line, at] = 0xFFFFFFFF
    rank, place = np.stack(ranks, 1), np.stack(places, 1)
    least = np.argsort(rank, axis=1, kind="stable")[:, :KEEP]
    took = np.sort(np.take_along_axis(place, least, 1), axis=1)
    out = np.zeros(ROWS, np.uint64)
    for k in range(took.shape[1]):
        out = mixed(out * _MULT + items[took[:, k]].astype(np.uint64) + np.uint64(k + 1))
    return (out >> np.uint64(48)).astype(np.uint16)


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, ROWS) 16-bit fingerprints; equal texts have equal rows, an empty text zeros."""
    out = np.zeros((len(texts), ROWS), np.uint16)
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= 300_000):
            size += len(texts[stop])
            stop += 1
        points, offsets = code_points(texts[start:stop])
        h, counts = _kmers(points, offsets)
        for d, (a, c) in enumerate(zip(offsets.tolist(), counts.tolist(), strict=False)):
            if c:
                out[start + d] = _rows(h[a : a + c])
        start = stop
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal rows; an empty text is like an empty text only."""
    return (a == b).mean(axis=-1)


def edited(text: str, other: str) -> str:
    """The text, its last third replaced by as much of the other's begin."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


DONE, LAST, FIRST = 0, 1, 2
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _batch(pairs: list[tuple[int | None, str, str]]) -> list[pa.Array]:
    """Result columns of (id, text, next text)."""
    texts = [p[1] for p in pairs]
    new = [edited(t, o) for _, t, o in pairs]
    own, changed = fingerprints(texts), fingerprints(new)
    # the other text of a pair is the next pair's text, but for the last
    chained = [i for i in range(len(pairs) - 1) if pairs[i][2] is texts[i + 1]]
    other = np.empty_like(own)
    other[chained] = own[np.asarray(chained, int) + 1] if chained else own[:0]
    rest = sorted(set(range(len(pairs))) - set(chained))
    if rest:
        other[rest] = fingerprints([pairs[i][2] for i in rest])
    hexed = lambda rows: pa.array([r.astype(">u2").tobytes().hex() for r in rows], pa.string())
    return [
        pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
        hexed(own), hexed(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, other)),
    ]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all documents of a range but the last; and its last and first texts, for their neighbours."""
    part = TaskContext.get().partitionId()
    names = [*SCHEMA.names, "part", "kind", "text"]

    def end(kind: int, key: int | None, text: str) -> pa.RecordBatch:
        empty = [pa.nulls(1, t) for t in SCHEMA.types[1:]]
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *empty, pa.array([part]), pa.array([kind]), pa.array([text], pa.string())], names)

    before: tuple[int | None, str] | None = None
    ready: list[tuple[int | None, str, str]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        n = len(ready)
        return pa.RecordBatch.from_arrays([*_batch(ready), pa.array([part] * n), pa.array([DONE] * n), pa.nulls(n, pa.string())], names)

    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if before is None:
                yield end(FIRST, None, text)
            else:
                ready.append((*before, text))
                size += len(text)
            before = key, text
            if size > 1_000_000:
                yield flush()
                ready, size = [], 0
    if ready:
        yield flush()
    if before is not None:
        yield end(LAST, *before)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            row = tuple(batch.column(c)[k].as_py() for c in ("doc_id", "text", "other"))
            yield pa.RecordBatch.from_arrays(_batch([row]), SCHEMA.names)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The next document is the one before it in id order (descending ids; the
    least id is followed by the greatest); equal ids follow in the order of their
    texts' hashes, and a null id counts as least.  A null text is empty; repeated
    rows all stay; texts are taken whole, whatever their length; other columns
    are ignored; an empty table gives an empty result.  One document alone
    follows itself.  Texts are shuffled once, to ranges of (id, hash of the
    text); the last document of each range meets the first of the next one in a
    join of two rows a range.  Only the numbers of the ranges come to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("tie")
    )
    order = (F.col("doc_id").desc_nulls_last(), F.col("tie"))
    rows = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    found = stored(rows.mapInArrow(_ranges, f"{FIELDS}, part long, kind long, text string"), "fingerprints")
    ends = found.where(F.col("kind") > DONE).select("doc_id", "part", "kind", "text")
    parts = sorted(r.part for r in ends.where(F.col("kind") == LAST).select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, next long")
    last = ends.where(F.col("kind") == LAST).join(F.broadcast(after), "part").select("doc_id", "text", "next")
    first = ends.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("other"))
    met = last.join(first, "next").select("doc_id", "text", "other").mapInArrow(_pairs, FIELDS)
    return found.where(F.col("kind") == DONE).select(*SCHEMA.names).unionByName(met)
