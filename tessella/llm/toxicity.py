"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its lower-cased letter runs and their proper prefixes of
``PREFIXES`` letters, hashed to ``1 << HASH_BITS`` places; a term weighs
``log(1 + count)``.  Beside a linear weight a term has a vector of ``FACTORS``
numbers, and every pair of terms adds the product of their vectors, so pairs
such as an insult with a mention of a group are learned, not listed.

Every term that ``MIN_DOCS`` sampled documents have takes part in fitting, whether
or not it tells anything alone.  Proximal steps take weights and factors back to
zero whose gradients do not outweigh a penalty; a term that ends with neither is
not looked up in scoring.

Fitting uses at most ``MAX_TRAIN`` labelled documents (the first by a hash of the
id, one text of each): their terms go to one task, where the machine is fitted, and
only the fitted machine goes to the driver.  Scoring is one pass over whole texts.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_blocks
from .pretoken import LETTER, SpanHashes, char_classes, code_points, distinct

HASH_BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
FACTORS = 4
MIN_DOCS = 5
MAX_TRAIN = 12_000
THRESHOLD = 0.7


def held_out_col(id_col: str = "doc_id"):
    """Rows that fitting never sees: crc32 of the id as text, remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each word, word code of each word, word code of each term, hashed term)."""
    points, offsets = code_points([t.lower() for t in texts])
    n = len(points)
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = char_classes()[points] == LETTER
    edge = letter[1:] != letter[:-1]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first[n] = False
    first[:n] &= letter[1:-1]
    first[1:n] &= letter[1:n]  # a word that would run across two texts
    starts = np.flatnonzero((edge & letter[1:]) | first)
    ends = np.flatnonzero((edge & letter[:-1]) | (first & letter[:-1]))
    docs = np.searchsorted(offsets, starts, side="right") - 1
    hashes_of = SpanHashes(points).of
    codes, found, where = distinct(hashes_of(starts, ends))
    s, e = starts[where], ends[where]
    owners, hashes = [np.arange(len(found))], [found]
    for k in PREFIXES:
        longer = np.flatnonzero(e - s > k)
        owners.append(longer)
        hashes.append(hashes_of(s[longer], s[longer] + k) + np.uint64(k))
    places = (np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return docs, codes, np.concatenate(owners), places


def _pairs(texts: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, count) of the terms that have a slot."""
    docs, codes, owners, places = terms(texts)
    kept = np.flatnonzero(slot[places] >= 0)
    owners, slots = owners[kept], slot[places[kept]]
    order = np.argsort(owners, kind="stable")
    owners, slots = owners[order], slots[order]
    size = int(codes.max()) + 1 if len(codes) else 0
    per_word = np.bincount(owners, minlength=size)
    base = np.cumsum(per_word) - per_word
    telling = np.flatnonzero(per_word[codes] > 0) if len(codes) else codes
    reps = per_word[codes[telling]]
    d = np.repeat(docs[telling], reps)
    within = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
    s = slots[np.repeat(base[codes[telling]], reps) + within]
    keys, counts = np.unique(d * len(slot) + s, return_counts=True)
    return keys // len(slot), keys % len(slot), counts


@dataclass
class FactorizationMachine:
    """Fitted model: ``slot`` maps a hash place to a row of the weights, or -1."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        docs, slots, counts = _pairs(texts, self.slot)
        x = np.log1p(counts)
        n = len(texts)
        out = np.full(n, self.bias)
        out += np.bincount(docs, self.weights[slots] * x, n)
        for k in range(self.factors.shape[1]):
            part = self.factors[slots, k] * x
            out += 0.5 * (np.bincount(docs, part, n) ** 2 - np.bincount(docs, part * part, n))
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


@dataclass
class Rows:
    """A sparse matrix by rows: ``places`` and ``values`` of row i stand at ``starts[i]`` to ``ends[i]``."""

    starts: np.ndarray
    ends: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number among ``rows``, place, value) of the entries of some rows."""
        size = self.ends[rows] - self.starts[rows]
        stops = np.cumsum(size)
        at = np.repeat(self.starts[rows] - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)
        return np.repeat(np.arange(len(rows)), size), self.places[at].astype(np.int64), self.values[at]


def fit_rows(
    x: Rows, y: np.ndarray, width: int, steps: int = 500, batch: int = 384, pos_weight: float = 3.0, rate: float = 0.05,
    linear_penalty: float = 3e-3, factor_penalty: float = 3e-3, seed: int = 5,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of ``width`` places, by proximal Adam steps on the weighted logistic loss.

    Batches follow a seeded order, so equal input gives an equal model.  Without
    rows of both classes everything stays zero.
    """
    rng = np.random.default_rng(seed)
    n = len(y)
    w, v = np.zeros(width, np.float32), np.zeros((FACTORS, width), np.float32)
    if not n or not width or not 0 < y.sum() < n:
        return 0.0, w, v.T
    v += rng.normal(0, 0.1, v.shape)
    share = float(y.mean())
    bias = np.full(1, np.log(pos_weight * share / (1 - share)))
    order = np.concatenate([rng.permutation(n) for _ in range(-(-steps * batch // n))])
    params = [(bias, 0.0), (w, linear_penalty), *((row, factor_penalty) for row in v)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p, _ in params]
    for step in range(1, steps + 1):
        rows = order[(step - 1) * batch : step * batch]
        rows = rows[x.ends[rows] > x.starts[rows]]  # rows without terms tell nothing
        if not len(rows):
            continue
        own, place, value = x.take(rows)
        first = np.searchsorted(own, np.arange(len(rows)))
        raw = bias + np.add.reduceat(w[place] * value, first)
        parts, sums = [], []
        for row in v:
            part = row[place] * value
            total = np.add.reduceat(part, first)
            raw += 0.5 * (total**2 - np.add.reduceat(part * part, first))
            parts.append(part)
            sums.append(total)
        truth = y[rows]
        g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - truth) * np.where(truth > 0, pos_weight, 1.0) / len(rows)
        pull = (g[own] * value).astype(np.float32)
        grads = [np.asarray([g.sum()]), np.bincount(place, pull, width)]
        grads += [np.bincount(place, pull * (total[own] - part), width) for part, total in zip(parts, sums, strict=True)]
        now = rate * (1 - 0.9 * step / steps)
        for (p, penalty), grad, (mean, square) in zip(params, grads, moments, strict=True):
            grad = grad.astype(p.dtype)
            mean *= 0.9
            mean += 0.1 * grad
            square *= 0.99
            square += 0.01 * grad * grad
            reach = now / (np.sqrt(square / (1 - 0.99**step)) + 1e-4)
            p -= reach * (mean / (1 - 0.9**step))
            if penalty:
                p[...] = np.sign(p) * np.maximum(np.abs(p) - reach * penalty, 0)
    return float(bias[0]), w, v.T


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets of the cells) of a binary column of 32-bit numbers, without a copy of the numbers."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    numbers = np.frombuffer(data, "<i4", int(edges[-1] - edges[0]) // 4, int(edges[0])) if data is not None and edges[-1] > edges[0] else np.empty(0, "<i4")
    return numbers, (edges - edges[0]) // 4


def machine(sample: pa.Table) -> FactorizationMachine:
    """Fit on (doc_id, label, places, counts); only the terms that end with a weight keep a slot.

    Batches are gone through one by one, so that little more than the sample itself is held.
    """
    with_term = np.zeros(1 << HASH_BITS, np.int64)
    for batch in sample.to_batches():
        with_term += np.bincount(_packed(batch.column("places"))[0], minlength=1 << HASH_BITS)
    frequent = with_term >= MIN_DOCS
    dense = (np.cumsum(frequent) - 1).astype(np.int32)
    places, values, edges, total = [np.empty(0, np.int32)], [np.empty(0, np.float32)], [np.zeros(1, np.int64)], 0
    for batch in sample.to_batches():
        (own, at), (counts, _) = _packed(batch.column("places")), _packed(batch.column("counts"))
        kept = frequent[own]
        places.append(dense[own[kept]])
        values.append(np.log1p(counts[kept], dtype=np.float32))
        edges.append(total + np.concatenate([[0], np.cumsum(kept)])[at[1:]])
        total += len(places[-1])
    by_id = pc.sort_indices(sample["doc_id"]).to_numpy()
    every = np.concatenate(edges)
    y = sample["label"].to_numpy().astype(np.float32)[by_id]
    rows = Rows(every[:-1][by_id], every[1:][by_id], np.concatenate(places), np.concatenate(values))
    del places, values
    bias, w, v = fit_rows(rows, y, int(frequent.sum()))
    used = (w != 0) | (v != 0).any(1)
    slot = np.full(1 << HASH_BITS, -1, np.int32)
    slot[np.flatnonzero(frequent)[used]] = np.arange(int(used.sum()))
    return FactorizationMachine(slot, bias, w[used].astype(np.float64), v[used].astype(np.float64))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, places, counts) of every text, both packed as 32-bit numbers."""
    every = np.arange(1 << HASH_BITS, dtype=np.int32)
    for batch in batches:
        for a, b, block in text_blocks(batch.column("text")):
            d, s, c = _pairs(block, every)
            edges = np.searchsorted(d, np.arange(b - a + 1)).tolist()
            packed = [pa.array([v[i:j].astype("<i4").tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for v in (s, c)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), *packed], ["doc_id", "label", "places", "counts"])


def _machines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the pickled machine that all of the partition's rows give."""
    none = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
    held = [b for b in batches if len(b)]
    sample = pa.Table.from_batches(held) if held else none.empty_table()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine(sample))], pa.binary())], ["model"])


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, label, places, counts) of the labelled documents that ``fit`` learns from."""
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out_col())
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text"), F.col("text")))["text"].alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_term_rows, f"doc_id {kind}, label int, places binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_train: int = MAX_TRAIN) -> FactorizationMachine:
    """Fit on labelled documents outside the held-out third, at most ``max_train`` of them.

    Rows with a null label or id are left out; an id that is labelled twice has
    the higher label, and one that stands in several rows gives one text.
    Without labelled rows of both classes every text scores 0.5.  The sample's
    terms meet in one task; the driver gets the machine alone.
    """
    small_batches(docs.sparkSession)
    got = training_rows(docs, labels, label_col, max_train).repartition(1).mapInArrow(_machines, "model binary").collect()
    return pickle.loads(got[0].model if got else next(_machines(iter(()))).column(0)[0].as_py())


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``_score`` and ``_toxic`` (score at or over the threshold).

    Null and empty texts score what the bias says; long texts are scored whole.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_toxic", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            got = [fitted.score(block) for _, _, block in text_blocks(batch.column(at))]
            scores = np.concatenate(got) if got else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(scores >= threshold)], schema.names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 at a score of 0.7 or more).

    Repeated rows are scored each, and equal texts alike; a null id is never held
    out; columns besides doc_id and text are ignored, whatever their names; an
    empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    scored = score(rows, fit(rows, labels))
    return scored.select("doc_id", held_out_col().alias("held_out"), F.col("_score").alias("score"), F.col("_toxic").cast("int").alias("predicted"))
