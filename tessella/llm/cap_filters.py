"""Embedding near-dedup with spherical-cap filters from random product codes.

A filter direction is a tuple of code words, one a block of (randomly rotated)
dimensions, so ``codes ** blocks`` directions cost ``codes * blocks`` products.
A vector is posted under every direction whose inner product exceeds the cap's
height; list decoding extends partial tuples block by block and drops those that
even the best rest can't lift over it.  Vectors meet in their common filters of
one label and are compared by cosine in double precision.

Filters are planned from the number of vectors: a filter holds about ``HOLDS``
random vectors and a vector lies in about ``FILTERS`` filters and in ``LEAST`` at
least; two vectors of cosine 0.98 share about three quarters of theirs.  Filters
first hold sketches only, the signs of ``SIGNS`` random projections; two vectors of
the threshold's angle differ in more than ``likely_signs`` of them with probability
1e-9.  Vectors with a likely partner in a filter are then fetched and compared.
Large filters are cut in blocks of ``BLOCK`` vectors and block pairs are dealt to
tasks.  Tasks return link counts, each pair counted in its first common filter
only, and a spanning forest of what they saw: never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, small_batches, whole_groups
from .components import components

FILTERS = 32
LEAST = 16
HOLDS = 64
BLOCK = 256
SIGNS = 256
KEYS = ("group", "owner", "i", "j")


@dataclass
class CapFilters:
    """Code books of the blocks and the height of the caps, for one dimension."""

    rotation: np.ndarray
    books: list[np.ndarray]
    height: float

    @staticmethod
    def plan(dim: int, vectors: int, seed: int = 11) -> CapFilters:
        rng = np.random.default_rng(seed + dim)
        wanted = max(1024, FILTERS * vectors // HOLDS)
        blocks = min(dim, 2 if wanted <= 1 << 16 else 3)
        codes = int(np.ceil(wanted ** (1 / blocks)))
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        books = []
        for part in np.array_split(np.arange(dim), blocks):
            words = rng.normal(size=(codes, len(part)))
            books.append(words / np.linalg.norm(words, axis=1, keepdims=True) / np.sqrt(blocks))
        share = min(0.5, FILTERS / codes**blocks)
        return CapFilters(rotation, books, NormalDist().inv_cdf(1 - share) / np.sqrt(dim))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that each unit vector exceeds, ascending.

        For a vector in fewer than ``LEAST`` filters the height is lowered step
        by step until it lies in as many (or in all there are).
        """
        heights = np.full(len(unit), self.height)
        row, code = self._above(unit, heights)
        every = int(np.prod([len(b) for b in self.books]))
        while len(low := np.flatnonzero(np.bincount(row, minlength=len(unit)) < min(LEAST, every))):
            heights[low] -= 0.02
            r, c = self._above(unit[low], heights[low])
            kept = ~np.isin(row, low)
            row, code = np.concatenate([row[kept], low[r]]), np.concatenate([code[kept], c])
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
        return row, code

    def _above(self, unit: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotation
        scores, at = [], 0
        for book in self.books:
            scores.append(turned[:, at : at + book.shape[1]] @ book.T)
            at += book.shape[1]
        best = [s.max(1) for s in scores]
        row, code, part = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, s in enumerate(scores):
            rest = np.sum(best[k + 1 :], axis=0) if k + 1 < len(scores) else np.zeros(len(unit))
            total = part[:, None] + s[row]
            i, c = np.nonzero(total + (rest - heights)[row][:, None] >= 0)
            row, code, part = row[i], code[i] * s.shape[1] + c, total[i, c]
        return row, code


def _vectors(column: pa.Array) -> list[bytes | None]:
    """Usable vectors as bytes of doubles; None for null, zero, empty or non-finite ones."""
    column = column.cast(pa.large_list(pa.float64()))
    edges = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False) + 0.0  # nulls are NaN; no negative zeros
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    full = np.concatenate([[0], np.cumsum(values != 0)])
    good = np.asarray(column.is_valid()) & (np.diff(bad[edges]) == 0) & (np.diff(full[edges]) > 0)
    return [values[a:b].tobytes() if g else None for a, b, g in zip(edges[:-1].tolist(), edges[1:].tolist(), good.tolist(), strict=True)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labelled = np.asarray(batch.column("label").is_valid()).tolist()
        raw = [v if k else None for v, k in zip(_vectors(batch.column("embedding")), labelled, strict=True)]
        names = [hashlib.blake2b(r, digest_size=16).hexdigest() if r is not None else None for r in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array(raw, pa.binary())],
            ["vec_id", "label", "name", "vector"],
        )


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that huge or tiny vectors keep their direction
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def likely_signs(threshold: float) -> int:
    """Most signs in which a pair at the threshold differs, six standard deviations up."""
    share = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return int(np.ceil(SIGNS * share + 6 * np.sqrt(SIGNS * share * (1 - share))))


def _decoder(vectors: int):
    plans: dict[int, tuple[CapFilters, np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(v.as_buffer(), np.float64) for v in batch.column("vector")]
            for dim in sorted({len(v) for v in raw}):
                if dim not in plans:
                    plans[dim] = CapFilters.plan(dim, vectors), np.random.default_rng(dim).normal(size=(dim, SIGNS))
                plan, planes = plans[dim]
                own = np.asarray([i for i, v in enumerate(raw) if len(v) == dim])
                for start in range(0, len(own), 256):
                    rows = own[start : start + 256]
                    unit = _unit(np.stack([raw[i] for i in rows]))
                    row, code = plan.decode(unit)
                    edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))])
                    signs = np.packbits(unit @ planes > 0, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).take(pa.array(rows)) for c in ("label", "cid", "rep", "copies", "vector")), pa.array(np.full(len(rows), dim, np.int32)),
                            pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(code)), pa.array([r.tobytes() for r in signs], pa.binary()),
                        ],
                        ["label", "cid", "rep", "copies", "vector", "dim", "filters", "signs"],
                    )

    return run


def _likely(bound: int):
    """Members of each group that have a partner of near signs."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table[c].to_numpy() for c in (*KEYS, "cid", "block", "filter")}
        signs = np.frombuffer(b"".join(table["signs"].to_pylist()), np.uint64).reshape(-1, SIGNS // 64)
        has = np.zeros(len(table), bool)
        for lo, hi in _groups(cols):
            i, j, block = cols["i"][lo], cols["j"][lo], cols["block"][lo:hi]
            left = lo + np.flatnonzero(block == i)
            right = left if i == j else lo + np.flatnonzero(block == j)
            for p in range(0, len(left), 64):
                rows = left[p : p + 64]
                apart = np.bitwise_count(signs[rows][:, None] ^ signs[right][None]).sum(2, dtype=np.int32)
                near = (apart <= bound) & (rows[:, None] != right[None])
                has[rows] |= near.any(1)
                has[right] |= near.any(0)
        yield pa.RecordBatch.from_arrays([pa.array(cols[c][has]) for c in ("group", "owner", "filter", "cid")], ["group", "owner", "filter", "cid"])

    return lambda batches: whole_groups(batches, KEYS, found)


def _groups(cols: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Row ranges of equal keys."""
    new = np.any([cols[c][1:] != cols[c][:-1] for c in KEYS], axis=0)
    cuts = np.flatnonzero(np.concatenate([[True], new, [True]])).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """Rows of groups of two or more, dealt as block pairs (i, j) of at most two blocks each."""
    sizes = materialize(rows.groupBy("group").agg(F.count("*").alias("size")).where("size > 1"))
    sizes = sizes.select("group", F.expr(f"cast(ceil(size / {BLOCK}) as int)").alias("blocks"))
    cells = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(block, k) as i, greatest(block, k) as j))")
    out = rows.join(sizes, "group").withColumn("block", F.expr("cast(pmod(xxhash64(cid, group), blocks) as int)"))
    out = out.withColumn("cell", F.explode(cells)).select("*", "cell.i", "cell.j").drop("cell", "blocks")
    return out.repartition(width, *KEYS).sortWithinPartitions(*KEYS)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links seen, each tree as a star on its least vertex."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(ids[v]), int(ids[r])) for v, r in enumerate(label.tolist()) if r != v]


def _comparer(threshold: float):
    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table[c].to_numpy() for c in (*KEYS, "cid", "rep", "copies", "block", "filter")}
        vectors, filters = table["vector"].combine_chunks(), table["filters"].combine_chunks()
        edge, flat = filters.offsets.to_numpy(), filters.values.to_numpy()
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for lo, hi in _groups(cols):
            i, j, f = cols["i"][lo], cols["j"][lo], int(cols["filter"][lo])
            unit = _unit(np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in vectors[lo:hi]]))
            block = cols["block"][lo:hi]
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            near = unit[left] @ unit[right].T >= threshold
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if not len(x):
                continue
            # pairs with an earlier common filter are counted there
            earlier = [flat[edge[r] : edge[r + 1]] for r in range(lo, hi)]
            earlier = [v[v < f] for v in earlier]
            every = np.unique(np.concatenate(earlier))
            fresh = np.ones(len(x), bool)
            if len(every):
                has = np.zeros((hi - lo, len(every)), np.float32)
                for r, v in enumerate(earlier):
                    has[r, np.searchsorted(every, v)] = 1
                fresh = (has[left] @ has[right].T)[x, y] == 0
            x, y = left[x[fresh]], right[y[fresh]]
            if not len(x):
                continue
            cid, rep, copies = cols["cid"][lo:hi], cols["rep"][lo:hi], cols["copies"][lo:hi]
            gain = np.bincount(x, copies[y], hi - lo) + np.bincount(y, copies[x], hi - lo)
            for r in np.flatnonzero(gain).tolist():
                counts[int(cid[r])] = counts.get(int(cid[r]), 0) + int(gain[r])
            edges += _forest(rep[x], rep[y])
        a = [*counts, *(e[0] for e in edges)]
        b = [*([None] * len(counts)), *(e[1] for e in edges)]
        n = [*counts.values(), *([0] * len(edges))]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return lambda batches: whole_groups(batches, KEYS, found)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of ``threshold`` or more, within one label and one
    dimension.  Equal vectors of a label are one class, which stands for all its
    copies in every count.  A null label, and vectors that are null, empty, zero
    or hold null or non-finite components link with nothing and are kept; so is
    a null id.  Rows of one id count as separate vectors in ``n_links``.  Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    Vectors of any length are compared whole.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")
    )
    label_type = rows.schema["label"].dataType.simpleString()
    described = rows.mapInArrow(_describe, f"vec_id long, label {label_type}, name string, vector binary")
    described = materialize(described)
    usable = described.where("name IS NOT NULL AND vec_id IS NOT NULL")
    classes = usable.groupBy("label", "name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))  # numbered once, as written
    width = shuffle_width(spark)
    decoded = classes.select("label", "cid", "rep", "copies", "vector").mapInArrow(
        _decoder(classes.count()), f"label {label_type}, cid long, rep long, copies long, vector binary, dim int, filters array<long>, signs binary"
    )
    decoded = materialize(decoded)
    posted = decoded.select("label", "dim", "cid", "signs", F.explode("filters").alias("filter"))
    group, owner = F.xxhash64("label", "dim", "filter").alias("group"), F.xxhash64(F.lit("owner"), "dim", "label").alias("owner")
    posted = posted.select(group, owner, "filter", "cid", "signs")
    likely = _dealt(posted, width).mapInArrow(_likely(likely_signs(threshold)), "group long, owner long, filter long, cid long").distinct()
    likely = materialize(likely).join(decoded.select("cid", "rep", "copies", "vector", "filters"), "cid")
    seen = materialize(_dealt(likely, width).mapInArrow(_comparer(threshold), "a long, b long, n long"))
    counts = seen.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    known = components(seen.where("b IS NOT NULL"))
    of_class = classes.select("label", "name", "cid", "rep", "copies").join(counts, classes.cid == counts.a, "left").drop("a")
    of_class = of_class.join(known, of_class.rep == known.id, "left")
    of_class = of_class.select(
        "label", "name", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("found")
    )
    out = described.select("vec_id", "label", "name").join(of_class, ["label", "name"], "left")
    usable_row = F.col("name").isNotNull() & F.col("vec_id").isNotNull()
    out = out.select(
        "vec_id", F.when(usable_row, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(usable_row, F.col("found")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
