"""MinHash near-dedup by a signature-coordinate inverted join.

* Every text becomes the set of its distinct five-word shingles (64-bit hashes).
  Texts with equal sets form a class, and only classes go on.
* A signature has ``COORDS`` coordinates; a coordinate is a pair of minima, so
  two sets of similarity s agree in it with probability s * s.
* Classes are posted under each coordinate-value pair of the prefix.  A pair that
  agrees in m coordinates shares one of any ``COORDS - m + 1``, so the other
  coordinates need no postings (prefix merging).  m falls with the threshold.
* Posting lists are not expanded into pairs.  Each list first meets its leader,
  the member whose own lists are longest; candidates with enough matches are
  confirmed on full sets and joined into components.  Lists that then still hold
  several components are merged in blocks, skipping pairs already connected and
  pairs whose first shared coordinate is another list's (skip merging): first
  every member with its ``NEAREST`` likeliest partners of a block, then, where
  components are left, with all.  Candidates also need a likeness of their
  ``BINS``-bin sketches within ``SIGMAS`` standard deviations, and are confirmed
  on full sets.  So no link between components is lost, and copies of one text
  never meet each other.

At the threshold the signatures miss a pair with probability ``MISS`` at most (m is 12
at 0.85 and 9 at 0.80).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, small_batches, stored, whole_groups
from .components import components
from .pretoken import mixed, span_hashes

WORDS = 5
COORDS = 32
MISS = 1e-5
BLOCK = 512
NEAREST = 3
BINS = 512
SIGMAS = 5.0
#: Largest number of ids that goes out by broadcast (16 bytes each); beyond it the texts are shuffled.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(20240817)
_MULT = (_RNG.integers(0, 1 << 32, 2 * COORDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, 2 * COORDS, dtype=np.uint64).astype(np.uint32)
_PLACE = (_RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def matches_at(percent: int) -> int:
    """Most coordinates that all but ``MISS`` of the pairs at the threshold agree in."""
    same, missed, m = (percent / 100) ** 2, 0.0, 0
    while m < COORDS:
        missed += comb(COORDS, m) * same**m * (1 - same) ** (COORDS - m)
        if missed > MISS:
            break
        m += 1
    return max(m, 1)


def byte_blocks(column: pa.Array, limit: int = 600_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a text column: (start, stop, bytes, offsets); null as empty."""
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, edges, data = column.buffers()
    offsets = np.frombuffer(edges, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop, raw[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and their offsets by text."""
    n, docs = len(raw), len(offsets) - 1
    if not n:
        return np.empty(0, np.uint64), np.zeros(docs + 1, np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    left = solid.copy()
    left[1:] &= ~solid[:-1] | edge[1:n]
    right = solid.copy()
    right[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    words = span_hashes(_LOWER[raw], starts, ends)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    sums = np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        sums += padded[k : k + len(words)] * _PLACE[k]
    shingles = mixed(sums)
    made = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    for d in np.flatnonzero((counts > 0) & (counts < WORDS)).tolist():
        own = words[first[d] : first[d + 1]] * _PLACE[: counts[d]]
        shingles[first[d]] = mixed(np.asarray([own.sum() + np.uint64(counts[d])], np.uint64))[0]
    keep = np.zeros(len(words), bool)
    for a, c in zip(first[:-1].tolist(), made.tolist(), strict=True):
        if c:
            part = shingles[a : a + c]
            part.sort()
            keep[a] = True
            keep[a + 1 : a + c] = part[1:] != part[:-1]
    sizes = np.concatenate([[0], np.cumsum(keep)])
    return shingles[keep], sizes[first]


def signatures(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((texts, COORDS) coordinates, (texts, 2) order-free hashes of the sets); empty sets give zeros."""
    docs = len(offsets) - 1
    coords, names = np.zeros((docs, COORDS), np.uint32), np.zeros((docs, 2), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return coords, names
    at = offsets[full]
    for k in (0, 1):
        names[full, k] = np.add.reduceat(mixed(sets + np.uint64(k + 1)), at)
    h = (sets >> np.uint64(32)).astype(np.uint32)
    for j in range(COORDS):
        pair = [np.minimum.reduceat(h * _MULT[2 * j + k] + _ADD[2 * j + k], at).astype(np.uint64) for k in (0, 1)]
        coords[full, j] = (mixed((pair[0] << np.uint64(32)) | pair[1]) >> np.uint64(32)).astype(np.uint32)
    return coords, names


def sketches(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BINS) bytes: of the hashes that fall in a bin the least, in 1 to 255; 0 for an empty bin."""
    docs = len(offsets) - 1
    h = mixed(sets ^ np.uint64(0x5851F42D4C957F2D))
    at = np.repeat(np.arange(docs), np.diff(offsets)) * BINS + (h >> np.uint64(55)).astype(np.int64)
    least = np.full(docs * BINS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(least, at, ((h >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    value = (mixed(least.astype(np.uint64)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return np.where(least == 0xFFFFFFFF, np.uint8(0), value).reshape(docs, BINS)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in byte_blocks(batch.column("text")):
            sets, edges = shingle_sets(raw, offsets)
            coords, names = signatures(sets, edges)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(coords.view(np.int32).ravel()), COORDS).cast(pa.list_(pa.int32()))
            bins = pa.array([r.tobytes() for r in sketches(sets, edges)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(edges)), *(pa.array(np.ascontiguousarray(names[:, k]).view(np.int64)) for k in (0, 1)), lists, bins],
                ["doc_id", "n_shingles", "s1", "s2", "sig", "bins"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in byte_blocks(batch.column("text")):
            sets, edges = shingle_sets(raw, offsets)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((edges * 8).tobytes()), pa.py_buffer(sets.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), packed.cast(pa.binary())], ["id", "members"])


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(p) + len(q) - common)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def confirm(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    ids = materialize(ids.distinct())
    small = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").select("doc_id", "text")
    sets = wanted.mapInArrow(_sets, "id long, members binary")
    rows = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    rows = rows.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    # no aggregate follows the joins, so that a leader of many pairs can be split between tasks
    return materialize(rows.select("a", "b", "x", "y").mapInArrow(_confirmer(percent), "a long, b long"))


def _match_blocks(percent: int, nearest: int | None):
    """Candidates of each block pair of a posting list: rows come sorted by (key, i, j).

    ``nearest``: only so many partners of a row, by likeness of the sketches.
    """
    goal, matches = percent / 100, matches_at(percent)
    slack = SIGMAS * np.sqrt(goal * (1 - goal))

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rep = table["rep"].to_numpy()
        comp, coord, block = table["comp"].to_numpy(), table["coord"].to_numpy(), table["block"].to_numpy()
        group = [table[c].to_numpy() for c in ("key", "i", "j")]
        sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDS)
        size = table["n_shingles"].to_numpy()
        bins = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(-1, BINS)
        new = np.concatenate([[True], np.any([g[1:] != g[:-1] for g in group], axis=0), [True]])
        cuts = np.flatnonzero(new)
        out_a, out_b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i, j, c = group[1][lo], group[2][lo], coord[lo]
            left = np.arange(lo, hi)[block[lo:hi] == i]
            right = left if i == j else np.arange(lo, hi)[block[lo:hi] == j]
            for p in range(0, len(left), 64):
                rows = left[p : p + 64]
                good = comp[rows][:, None] != comp[right][None, :]
                least, most = np.minimum(size[rows][:, None], size[right]), np.maximum(size[rows][:, None], size[right])
                good &= 100 * least >= percent * most
                if i == j and nearest is None:
                    good &= rep[rows][:, None] < rep[right][None, :]
                if not good.any():
                    continue
                same = sig[rows][:, None, :] == sig[right][None, :, :]
                good &= same.sum(2) >= matches
                if c:
                    good &= ~same[:, :, :c].any(2)
                x, y = np.nonzero(good)
                if not len(x):
                    continue
                # pairs of bins: in use by one text at least, and equal
                likely = np.empty(len(x))
                enough = np.empty(len(x), bool)
                for q in range(0, len(x), 8192):
                    u, v = bins[rows[x[q : q + 8192]]], bins[right[y[q : q + 8192]]]
                    used = ((u > 0) | (v > 0)).sum(1)
                    likely[q : q + 8192] = share = ((u == v) & (u > 0)).sum(1) / used
                    # the bins are a sample without replacement of the union
                    union = (size[rows[x[q : q + 8192]]] + size[right[y[q : q + 8192]]]) / (1 + goal)
                    left_out = np.clip(1 - used / union, 0.02, 1)
                    enough[q : q + 8192] = share >= goal - slack * np.sqrt(left_out / used) - 2 / used
                x, y, likely = x[enough], y[enough], likely[enough]
                if nearest is not None and len(x):
                    order = np.lexsort((rep[right[y]], -likely, x))
                    x, y = x[order], y[order]
                    first = np.searchsorted(x, x)
                    few = np.arange(len(x)) - first < nearest
                    x, y = x[few], y[few]
                out_a.append(rep[rows[x]])
                out_b.append(rep[right[y]])
        a = np.concatenate(out_a) if out_a else np.empty(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from whole_groups(batches, ("key", "i", "j"), found)

    return run


def _matches(x: str, y: str):
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> int(p = q)), 0, (n, k) -> n + k)")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents link at ``100 * intersection >= percent * union`` of their shingle
    sets; a text of one to four words is one shingle, a text without words links
    with nothing.  ``component_id`` is the least id reachable, ``kept`` that it
    is the document's own.  Null texts are empty; a null id links with nothing
    and is kept.  Rows of one id count as one document for linking and all stay.
    Texts of any length give their whole sets; other columns are ignored; an
    empty table gives an empty result.  Words and shingles are compared by 62-bit
    hashes modulo a prime, mixed to 64 bits.
    """
    small_batches(docs.sparkSession)
    width, matches = shuffle_width(docs.sparkSession), matches_at(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = stored(texts.mapInArrow(_describe, "doc_id long, n_shingles long, s1 long, s2 long, sig array<int>, bins binary"), "minhash")
    linkable = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bins").alias("bins"), F.first("n_shingles").alias("n_shingles"))
    classes = materialize(classes)
    posted = classes.select("rep", F.posexplode(F.slice("sig", 1, COORDS - matches + 1)).alias("coord", "value"))
    posted = posted.select("rep", "coord", F.expr("shiftleft(cast(coord as long), 32) | (value & 4294967295L)").alias("key"))
    sizes = materialize(posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    posted = materialize(posted.join(sizes, "key"))

    # each list's leader: the member that shares the most
    shared = posted.groupBy("rep").agg(F.sum("size").alias("shares"))
    ranked = posted.join(shared, "rep")
    lead = ranked.groupBy("key").agg(F.min(F.struct(-F.col("shares"), F.col("rep")))["rep"].alias("lead"))
    stars = materialize(posted.select("key", "rep").join(lead, "key").where("rep <> lead").select("rep", "lead").distinct())
    sigs = classes.select("rep", "sig", "bins", "n_shingles")
    stars = stars.join(sigs.select("rep", F.col("sig").alias("p")), "rep")
    stars = stars.join(sigs.select(F.col("rep").alias("lead"), F.col("sig").alias("q")), "lead")
    stars = materialize(stars.where(_matches("p", "q") >= matches).select(F.col("lead").alias("a"), F.col("rep").alias("b")))
    links = confirm(texts, stars, percent)
    known = materialize(components(links))

    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for nearest in (NEAREST, None):
        # lists that still hold several components
        member = posted.join(known, posted.rep == known.id, "left").select("key", "coord", "rep", F.coalesce("component", "rep").alias("comp"))
        several = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
        several = materialize(several.where("lo <> hi").select("key", F.expr(f"cast(ceil(size / {BLOCK}) as int)").alias("blocks")))
        member = member.join(several, "key").withColumn("block", F.expr("cast(pmod(xxhash64(rep, key), blocks) as int)"))
        member = member.join(sigs, "rep")
        cells = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(block, k) as i, greatest(block, k) as j))")
        member = member.withColumn("cell", F.explode(cells)).select("key", "cell.i", "cell.j", "coord", "rep", "comp", "block", "sig", "bins", "n_shingles")
        member = member.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = member.mapInArrow(_match_blocks(percent, nearest), "a long, b long").distinct()
        more = materialize(more.join(done, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            done = done.unionByName(more)
            links = links.unionByName(confirm(texts, more, percent))
            known = materialize(components(links))

    of_class = classes.select("s1", "s2", "rep").join(known, classes.rep == known.id, "left")
    of_class = of_class.select("s1", "s2", F.coalesce("component", "rep").alias("found"))
    out = described.select("doc_id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    found = F.when(F.col("n_shingles") > 0, F.coalesce("found", "doc_id")).otherwise(F.col("doc_id"))
    found = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(found)
    out = out.select("doc_id", "n_shingles", found.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
