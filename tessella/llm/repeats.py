"""Removal of repeated passages: longest-previous-factor arrays, distributed.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document of
smaller id: if the longest previous factor (LPF) of a suffix that begins there or
up to ``LENGTH - 1`` bytes before, with "previous" read by document id, reaches
``LENGTH``.  In suffix order the longest earlier match of a suffix is the one with
the previous or the next smaller position (``longest_previous``); as only factors
of ``LENGTH`` count, suffixes are ordered by their first ``LENGTH`` bytes.

The suffix array is partitioned by anchors.  Of the ``GRAM``-byte strings in a
window of ``LENGTH`` bytes the one of least hash is its anchor, so equal windows
have equal anchors at equal places, and windows with one anchor are neighbours
that share one context of at most ``2 * LENGTH - GRAM`` bytes.  Suffixes with
different anchors need no common order, as they can't match.

1. Documents are packed into compressed chunks and written once.
2. Each chunk sends the hashes of its anchors (four bytes each, every one once) to
   hash buckets, which answer with a bit each: whether another chunk has it.
3. Chunks settle repeats inside themselves and send the contexts of shared
   anchors, every distinct one once with its least id, to the buckets.  There
   equal contexts are settled, and LPF arrays are built over the others.
4. Buckets answer with a bit a window; chunks cut their texts.

A passage that a million documents share thus travels at most once a chunk.
Buckets are even ranges of the hash and are dealt in turn, like chunks, so tasks
keep their size if partitions grow with the input.  Rows sent are never more than
anchors (a sixteenth of the bytes), and far fewer as a row packs a chunk's share
of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches, stored
from .near_dedup import byte_blocks
from .pretoken import distinct, mixed, powers, span_hashes

LENGTH = 50
GRAM = 20
WINDOWS = LENGTH - GRAM + 1
CHUNK_BYTES = 3_000_000
SEGMENT_BYTES = 400_000
SLICE_WINDOWS = 200_000
LAST = 2**63 - 1
#: Bits of an anchor's hash that are sent to ask whether others have it; a false yes costs traffic only.
ANCHOR_BITS = 44
_LOW = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0x94D049BB133111EB)


@cache
def _packer() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _zip(*arrays: np.ndarray) -> bytes:
    return _packer()[0].compress(b"".join(a.tobytes() for a in arrays))


def _runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, windows, document, anchor's place, hashes of anchor and context."""
    n = len(raw)
    sizes = np.diff(offsets)
    per_doc = np.maximum(sizes - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), per_doc)
    if not len(doc):
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    windows = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(per_doc) - per_doc), per_doc)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = (total[GRAM:] - total[: n + 1 - GRAM]) * down[: n + 1 - GRAM]
    best = (grams ^ (grams >> np.uint64(32))) * _ODD
    low = _LOW if n <= 1 << 24 else np.uint64((1 << (n - 1).bit_length()) - 1)
    best &= ~low
    best |= np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach < WINDOWS:  # least of ever longer runs of grams
        step = min(reach, WINDOWS - reach)
        best = np.minimum(best[: len(best) - step], best[step:])
        reach += step
    place = (best[windows] & low).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    first = windows[head]
    count = np.diff(np.append(head, len(windows)))
    ends = first + count + LENGTH - 1
    content = mixed((total[ends] - total[first]) * down[first] + (ends - first).astype(np.uint64))
    return first, count, doc[head], place[head], mixed(grams[place[head]]), content


class Chunk:
    """Some documents: bytes, offsets, ids; with their anchors and contexts worked out."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.raw, self.offsets, self.ids = raw, offsets, ids
        parts = []
        for a, b in _cuts(np.diff(offsets), SEGMENT_BYTES):
            at = offsets[a]
            first, count, doc, place, anchor, content = _runs(raw[at : offsets[b]], offsets[a : b + 1] - at)
            parts.append((first + at, count, doc + a, place + at, anchor, content))
        parts = parts or [_runs(raw[:0], offsets[:1])]
        self.first, self.count, self.doc, self.place, self.anchor, self._content = (np.concatenate(c) for c in zip(*parts, strict=True))

    def contexts(self) -> Chunk:
        """Distinct contexts in order of anchor, then content (128 bits of hashes); each with its least id."""
        order = np.lexsort((self._content, self.anchor))
        name, content = self.anchor[order], self._content[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (content[1:] != content[:-1])
        head = np.flatnonzero(fresh)
        self.context = np.empty(len(order), np.int64)
        self.context[order] = np.cumsum(fresh) - 1
        self.example = order[head]
        self.least = np.minimum.reduceat(self.ids[self.doc[order]], head) if len(head) else np.empty(0, np.int64)
        self.name = name[head]
        # distinct anchors, ascending; several contexts of one anchor have to meet in any case
        start = np.ones(len(self.name), bool)
        start[1:] = self.name[1:] != self.name[:-1]
        self.anchor_of = np.cumsum(start) - 1
        self.anchors = self.name[start]
        self.several = np.bincount(self.anchor_of, minlength=len(self.anchors)) > 1 if len(start) else np.empty(0, bool)
        return self

    @staticmethod
    def bucket_edges(anchors: np.ndarray, buckets: int) -> np.ndarray:
        """Places in sorted ``anchors`` where each bucket begins: buckets are ranges of the hash."""
        return np.searchsorted((anchors >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))

    def cut(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(bytes, bytes removed, spans removed, digest of the rest) of each document.

        ``answers``: for each context the windows, as bits, that a smaller id
        than its least has.
        """
        n = len(self.raw)
        starts = np.zeros(n + 1, np.int8)
        whole = self.ids[self.doc] > self.least[self.context]
        bits = np.where(whole, (np.int64(1) << self.count) - 1, answers[self.context])
        for k in range(WINDOWS):
            starts[self.first[(bits >> k) & 1 == 1] + k] = 1
        edge = np.zeros(n + 1, np.int32)
        edge[:-1] += starts[:n]
        edge[LENGTH:] -= starts[: n + 1 - LENGTH] if n >= LENGTH else 0
        gone = np.cumsum(edge[:n]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inner = self.offsets[:-1][np.diff(self.offsets) > 0]
        begin[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(begin)])
        removed = np.diff(total[self.offsets])
        digests = []
        for d, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
            kept = self.raw[a:b] if not removed[d] else self.raw[a:b][~gone[a:b]]
            digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
        return np.diff(self.offsets), removed, np.diff(spans[self.offsets]), digests


def _packer_of(parts: int):
    return lambda batches: _pack(batches, parts)


def _pack(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Documents as compressed chunks: (chunk, ids, sizes, bytes).

    Chunks are numbered across the ``parts`` tasks, so that numbers modulo any width are even.
    """
    part, made = TaskContext.get().partitionId(), 0
    texts: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def finish() -> pa.RecordBatch:
        nonlocal made, held
        cols = [_zip(*ids), _zip(*sizes), _zip(*texts)]
        chunk = made * parts + part
        made, held = made + 1, 0
        for part_list in (texts, ids, sizes):
            part_list.clear()
        return pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.array([c], pa.binary()) for c in cols)], ["chunk", "ids", "sizes", "raw"])

    for batch in batches:
        keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
        nulls = np.asarray(batch.column("doc_id").is_null())
        keys = np.where(nulls, LAST, np.where(nulls, 0, keys).astype(np.int64)).astype(np.int64)
        for a, b, raw, offsets in byte_blocks(batch.column("text"), 500_000):
            if held and held + len(raw) > CHUNK_BYTES:
                yield finish()
            texts.append(raw)
            ids.append(keys[a:b])
            sizes.append(np.diff(offsets))
            held += len(raw) + 16 * (b - a)
    if ids:
        yield finish()


def _unpack(row_ids: bytes, row_sizes: bytes, row_raw: bytes) -> Chunk:
    unzip = _packer()[1].decompress
    sizes = np.frombuffer(unzip(row_sizes), np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return Chunk(np.frombuffer(unzip(row_raw), np.uint8), offsets, np.frombuffer(unzip(row_ids), np.int64))


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers by their steps: four bytes each where they fit, else eight."""
    steps = np.diff(values, prepend=values[:1])
    if not len(values) or steps.max() >> np.uint64(32):
        return b"\x08" + values.tobytes()
    return b"\x04" + values[:1].tobytes() + steps[1:].astype(np.uint32).tobytes()


def _unpack_sorted(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        return np.frombuffer(raw, np.uint64, offset=1)
    first = np.frombuffer(raw, np.uint64, 1, 1)
    return np.cumsum(np.concatenate([first, np.frombuffer(raw, np.uint32, offset=9).astype(np.uint64)]), dtype=np.uint64)


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                chunk = _unpack(*(batch.column(c)[k].as_py() for c in ("ids", "sizes", "raw")))
                anchors = np.unique(chunk.anchor)
                edges = chunk.bucket_edges(anchors, buckets)
                full = np.flatnonzero(np.diff(edges)).tolist()
                data = [_pack_sorted(anchors[edges[i] : edges[i + 1]] >> np.uint64(64 - ANCHOR_BITS)) for i in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([batch.column("chunk")[k].as_py()] * len(full), pa.int64()), pa.array(data, pa.binary())],
                    ["bucket", "chunk", "data"],
                )

    return run


def _by_bucket(settle):
    """Feed ``settle(bucket, chunks, data)`` with all rows of one bucket: rows come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks, data = None, [], []
        for batch in batches:
            for bucket, chunk, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "data")), strict=True):
                if bucket != now and chunks:
                    yield from settle(now, chunks, data)
                    chunks, data = [], []
                now = bucket
                chunks.append(chunk)
                data.append(raw)
        if chunks:
            yield from settle(now, chunks, data)

    return run


def _shared_anchors(bucket: int, chunks: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Which anchors of each chunk another chunk has too, a bit each."""
    parts = [_unpack_sorted(raw) for raw in data]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(every), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    out = [np.packbits(twice[a:b]).tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([bucket] * len(chunks), pa.int32()), pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], ["bucket", "chunk", "data"]
    )


def _by_chunk(work):
    """Feed ``work(chunk, {bucket: data}, documents)``: a chunk's answers come before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, bytes] = {}
        for batch in batches:
            for k in range(len(batch)):
                bucket = batch.column("bucket")[k].as_py()
                if bucket is not None:
                    answers[bucket] = batch.column("data")[k].as_py()
                    continue
                held = _unpack(*(batch.column(c)[k].as_py() for c in ("ids", "sizes", "raw")))
                yield from work(batch.column("chunk")[k].as_py(), answers, held)
                answers = {}

    return run


def _send_contexts(buckets: int):
    def work(name: int, answers: dict[int, bytes], chunk: Chunk) -> Iterator[pa.RecordBatch]:
        chunk.contexts()
        edges = chunk.bucket_edges(chunk.anchors, buckets)
        asked = chunk.several.copy()
        for bucket, raw in answers.items():
            a, b = edges[bucket], edges[bucket + 1]
            asked[a:b] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
        context = np.flatnonzero(asked[chunk.anchor_of])
        place = np.searchsorted(chunk.anchor_of[context], edges)
        rows, data = [], []
        for i in np.flatnonzero(np.diff(place)).tolist():
            own = context[place[i] : place[i + 1]]
            ex = chunk.example[own]
            first, size = chunk.first[ex], chunk.count[ex] + LENGTH - 1
            ends = np.cumsum(size)
            at = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))
            rows.append(i)
            data.append(
                np.int64(len(own)).tobytes()
                + _zip(
                    np.diff(own, prepend=0).astype(np.int32), chunk.least[own], (chunk.place[ex] - first).astype(np.int8),
                    chunk.count[ex].astype(np.int8), chunk.raw[at],
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array(data, pa.binary())], ["bucket", "chunk", "data"])

    return _by_chunk(work)


def suffix_order(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``starts`` in the order of their first ``LENGTH`` bytes, and where in it a longest common prefix is shorter."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(raw), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(raw)] << np.uint64(56 - 8 * k)
    keys = [words[starts + s] for s in (*range(0, LENGTH - 8, 8), LENGTH - 8)]
    order = np.lexsort(tuple(reversed(keys)))
    short = np.zeros(len(order), bool)
    short[:1] = True
    for key in keys:
        ranked = key[order]
        short[1:] |= ranked[1:] != ranked[:-1]
    return order, short


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it that holds a smaller value, or -1.

    All places point one back; pointers at values that are not smaller follow the
    pointers found there, so the distance covered doubles.
    """
    at = np.arange(len(values)) - 1
    while True:
        wrong = np.flatnonzero((at >= 0) & (values[at] >= values))
        if not len(wrong):
            return at
        at[wrong] = at[at[wrong]]


def longest_previous(raw: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix: ``LENGTH`` (or more), or 0 if it is shorter.

    In suffix order the longest earlier match of a suffix stands at the previous
    or the next smaller position, where position is the document's id.  Its length
    is the least common prefix on the way, of which only whether it reaches
    ``LENGTH`` is kept: whether both stand in one run.
    """
    order, short = suffix_order(raw, starts)
    run, place = np.cumsum(short), ids[order]
    n = len(order)
    before = previous_smaller(place)
    after = n - 1 - previous_smaller(place[::-1])[::-1]
    reach = (before >= 0) & (run[before] == run)
    reach |= (after < n) & (run[np.minimum(after, n - 1)] == run)
    out = np.empty(n, np.int64)
    out[order] = np.where(reach, LENGTH, 0)
    return out


def _settle_contexts(bucket: int, chunks: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Bits of the windows that a smaller id has, for each context sent."""
    unzip = _packer()[1].decompress
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    for who, blob in enumerate(data):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        raw = unzip(blob[8:])
        at = 0
        for col, kind in zip(cols, (np.int32, np.int64, np.int8, np.int8), strict=False):
            col.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        cols[0][-1] = np.cumsum(cols[0][-1])
        cols[4].append(np.frombuffer(raw, np.uint8, offset=at))
        cols[5].append(np.full(n, who, np.int32))
    context, ids, inside, count, raw, who = (np.concatenate(c) for c in cols)
    count = count.astype(np.int64)
    size = count + LENGTH - 1
    ends = np.cumsum(size)
    anchor_at = ends - size + inside
    content, name = (
        np.concatenate(
            [
                span_hashes(raw[lo:hi], x[a:b] - lo, y[a:b] - lo)
                for a, b in _cuts(size, 1_000_000)
                for lo, hi in [(int(ends[a] - size[a]), int(ends[b - 1]))]
            ]
        )
        for x, y in ((ends - size, ends), (anchor_at, anchor_at + GRAM))
    )
    order = np.lexsort((ids, content, name))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (content[order][1:] != content[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    head = order[fresh]
    bits = np.zeros(len(head), np.int64)
    # anchors with several contexts: their windows meet in suffix order
    names = name[head]
    start = np.ones(len(head), bool)
    start[1:] = names[1:] != names[:-1]
    of = np.cumsum(start) - 1
    many = np.flatnonzero(np.bincount(of, minlength=int(start.sum()))[of] > 1)
    for a, b in _cuts(count[head[many]], SLICE_WINDOWS, of[many]):
        ctx = many[a:b]
        h = head[ctx]
        n = count[h]
        sums = np.cumsum(n)
        owner = np.repeat(np.arange(len(ctx)), n)
        offset = np.arange(int(sums[-1])) - np.repeat(sums - n, n)
        lo = int((ends[h] - size[h]).min())
        hi = int(ends[h].max())
        begin = (ends[h] - size[h])[owner] + offset - lo
        if hi - lo > 8 * int(size[h].sum()):  # scattered contexts: gather their bytes
            sz = size[h]
            tot = np.cumsum(sz)
            at = np.repeat(ends[h] - sz - (tot - sz), sz) + np.arange(int(tot[-1]))
            part, begin = raw[at], (tot - sz)[owner] + offset
        else:
            part = raw[lo:hi]
        own = ids[h][owner]
        # a window whose hash no other has is nobody's repeat and needs no place in the order
        codes, found, _ = distinct(span_hashes(part, begin, begin + LENGTH))
        twice = np.flatnonzero((np.bincount(codes, minlength=len(found)) > 1)[codes])
        earlier = twice[longest_previous(part, begin[twice], own[twice]) >= LENGTH] if len(twice) else twice
        np.add.at(bits, ctx[owner[earlier]], np.int64(1) << offset[earlier])
    least = ids[head][group]
    answer = np.where(ids > least, (np.int64(1) << count) - 1, bits[group])
    told = np.flatnonzero(answer)
    edges = np.searchsorted(who[told], np.arange(len(data) + 1))
    rows, out = [], []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        pick = told[edges[k] : edges[k + 1]]
        rows.append(chunks[k])
        out.append(_zip(context[pick].astype(np.int32), answer[pick].astype(np.int32)))
    yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int32()), pa.array(rows, pa.int64()), pa.array(out, pa.binary())], ["bucket", "chunk", "data"])


def _cuts(sizes: np.ndarray, limit: int, keep: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` in sum; equal neighbours in ``keep`` stay together."""
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    allowed = np.arange(n + 1) if keep is None else np.append(np.flatnonzero(np.concatenate([[True], keep[1:] != keep[:-1]]))[: n or None], n)
    at = 0
    while at < n:
        stop = int(np.searchsorted(sums, sums[at] + limit, side="right")) - 1
        k = int(np.searchsorted(allowed, max(stop, at + 1), side="right")) - 1
        stop = int(allowed[k])
        if stop <= at:
            stop = int(allowed[np.searchsorted(allowed, at, side="right")])
        yield at, stop
        at = stop


def _cut_texts(name: int, answers: dict[int, bytes], chunk: Chunk) -> Iterator[pa.RecordBatch]:
    chunk.contexts()
    bits = np.zeros(len(chunk.example), np.int64)
    for blob in answers.values():
        raw = _packer()[1].decompress(blob)
        n = len(raw) // 8
        bits[np.frombuffer(raw, np.int32, n)] = np.frombuffer(raw, np.int32, n, 4 * n)
    size, removed, spans, digests = chunk.cut(bits)
    ids = pa.array(chunk.ids, mask=chunk.ids == LAST)
    yield pa.RecordBatch.from_arrays(
        [ids, pa.array(size.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(digests, pa.string())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Strings are judged on the input; matches never cross documents; rows of
    equal id don't remove from each other, and all rows stay.  A null text is
    empty; a null id counts as greater than all others.  Texts of any length are
    taken whole; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    width = shuffle_width(docs.sparkSession)
    buckets = 2 * width
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(_packer_of(rows.rdd.getNumPartitions()), "chunk long, ids binary, sizes binary, raw binary")
    packed = stored(packed, "repeats")
    message = "bucket int, chunk long, data binary"

    def at_buckets(sent: DataFrame, settle) -> DataFrame:
        dealt = sent.repartitionById(width, "bucket").sortWithinPartitions("bucket", "chunk")
        return dealt.mapInArrow(_by_bucket(settle), message)

    def at_chunks(answers: DataFrame, work, schema: str) -> DataFrame:
        texts = packed.select(F.lit(None).cast("int").alias("bucket"), "chunk", F.lit(None).cast("binary").alias("data"), "ids", "sizes", "raw")
        empty = [F.lit(None).cast("binary").alias(c) for c in ("ids", "sizes", "raw")]
        both = texts.unionByName(answers.select("bucket", "chunk", "data", *empty))
        dealt = both.repartitionById(width, F.expr(f"cast(pmod(chunk, {width}) as int)")).sortWithinPartitions("chunk", F.col("bucket").asc_nulls_last())
        return dealt.mapInArrow(work, schema)

    shared = at_buckets(packed.mapInArrow(_send_anchors(buckets), message), _shared_anchors)
    contexts = at_chunks(shared, _send_contexts(buckets), message)
    settled = at_buckets(contexts, _settle_contexts)
    return at_chunks(settled, _by_chunk(_cut_texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
