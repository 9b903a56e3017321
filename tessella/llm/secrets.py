"""Secret scans: fixed patterns, and a linear-chain conditional random field.

Tokens are runs of letters, digits and ``_``, and every other visible character.
The field tags each token as the begin of a secret, inside one, or outside, from
the token's shape, length and first characters, the words and shapes beside it,
and features of the whole file.  It learns from a bounded sample of documents
(``MAX_TRAIN``, the first by a hash of the id) tagged by the fixed patterns.

Decoding is exact Viterbi over whole texts.  A run of tagged tokens can only
pay if some stretch of tokens gains more than entering and leaving costs; two
running minima find all tokens of such stretches, and only there the recursion
is run (``FieldModel.decode``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_blocks
from .pretoken import LETTER, NUMBER, SPACE, char_classes, code_points, distinct, span_hashes

#: The base patterns, in the order of their kinds, and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "field")

#: Bounds of the training sample: documents, and windows around secrets of one document.
MAX_TRAIN = 20_000
SECRETS_A_TEXT = 4
WINDOW = 48
#: Share of training windows that hide a token's neighbours.
ALONE = 0.5
NEIGHBOUR_BITS = 13
O, B, I = 0, 1, 2
Span = tuple[str, int, int]


def base_spans(text: str, hexes: list[tuple[int, int]]) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of the fixed patterns by start, then kind, and the spans of the secrets in them."""
    out: list[Span] = []
    values: list[tuple[int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append(("assign", m.start(), m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", a, b) for a, b in hexes]
    values += [(a, b) for k, a, b in out if k != "assign"]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out, values


@dataclass
class Tokens:
    """Tokens of a block of texts with their feature numbers (all by token)."""

    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    cur: np.ndarray
    head: np.ndarray
    word: np.ndarray
    shape: np.ndarray
    glued: np.ndarray
    file: np.ndarray
    hexes: list[list[tuple[int, int]]]


SHAPES, LENGTHS, HEADS, FILES = 12, 8, 1 << 10, 64


def tokens(texts: list[str]) -> Tokens:
    points, offsets = code_points(texts)
    n = len(points)
    kind = char_classes()[points].copy()
    kind[points == 95] = LETTER
    solid = (kind == LETTER) | (kind == NUMBER)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    cut = np.ones(n, bool)
    cut[1:] = ~(solid[1:] & solid[:-1])
    cut |= first
    cut &= kind != SPACE
    starts = np.flatnonzero(cut)
    run_end = np.ones(n, bool)
    run_end[:-1] = ~(solid[:-1] & solid[1:]) | first[1:]
    run_end &= kind != SPACE
    ends = np.flatnonzero(run_end) + 1
    docs = np.searchsorted(offsets, starts, side="right") - 1

    def held(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total

    digit = (points >= 48) & (points <= 57)
    lower = (points >= 97) & (points <= 122)
    upper = (points >= 65) & (points <= 90)
    hexa = digit | ((points >= 97) & (points <= 102))
    sums = {k: held(m) for k, m in (("d", digit), ("l", lower), ("u", upper), ("h", hexa))}
    size = ends - starts
    d, lo, up, hx = (sums[k][ends] - sums[k][starts] for k in "dluh")
    plain = size - d - lo - up
    letter = solid[starts] if n else np.empty(0, bool)
    shape = np.zeros(len(starts), np.int64)
    shape[letter & (d == 0) & (up == 0)] = 1
    shape[letter & (d == 0) & (up == 1)] = 2
    shape[letter & (d == 0) & (up > 1) & (up < size)] = 3
    shape[letter & (up == size)] = 4
    shape[letter & (d == size)] = 5
    shape[letter & (d > 0) & (d < size)] = 6
    shape[letter & (d > 0) & (hx == size) & (d < size)] = 7
    shape[letter & (d > 0) & (up > 0) & (lo == 0)] = 8
    shape[letter & (d > 0) & (up > 0) & (lo > 0)] = 9
    shape[~letter & (size > 0)] = 10
    shape[letter & (plain > 0) & (d > 0)] = 11
    length = np.minimum(np.searchsorted(np.asarray([2, 4, 8, 12, 16, 24, 32]), size, side="right"), LENGTHS - 1)
    share = np.minimum(4 * d // np.maximum(size, 1), 3)
    lowered = np.where(upper, points + 32, points).astype(np.uint32)
    codes, found, where = distinct(span_hashes(lowered, starts, ends))
    heads = span_hashes(points, starts[where], np.minimum(starts[where] + 4, ends[where]))
    per_doc = np.maximum(np.diff(offsets), 1)
    of_file = lambda k: np.minimum(16 * np.diff(sums[k][offsets]) // per_doc, 3)
    log_size = np.minimum(np.log2(per_doc).astype(np.int64) // 4, 3)
    files = (log_size * 4 + of_file("d")) * 4 + of_file("u")
    glued = np.zeros(len(starts), np.int64)
    glued[1:] = (ends[:-1] == starts[1:]) & (docs[1:] == docs[:-1])
    hexes: list[list[tuple[int, int]]] = [[] for _ in texts]
    if n:
        begin = np.flatnonzero(hexa & (first | np.concatenate([[True], ~hexa[:-1]])))
        stop = np.flatnonzero(hexa & np.concatenate([first[1:] | ~hexa[1:], [True]])) + 1
        long = stop - begin >= LEAST["hex"]
        for a, b in zip(begin[long].tolist(), stop[long].tolist(), strict=True):
            doc = int(np.searchsorted(offsets, a, side="right")) - 1
            hexes[doc].append((a - int(offsets[doc]), b - int(offsets[doc])))
    return Tokens(
        offsets, starts, ends, docs, (shape * LENGTHS + length) * 4 + share,
        (heads >> np.uint64(54)).astype(np.int64)[codes], (found >> np.uint64(64 - NEIGHBOUR_BITS)).astype(np.int64)[codes],
        shape, glued, files[docs] if len(texts) else docs, hexes,
    )


#: Places of the feature groups in one table of weights.
GROUPS = {
    "cur": SHAPES * LENGTHS * 4, "head": HEADS, "word": 1 << NEIGHBOUR_BITS, "before1": 1 << NEIGHBOUR_BITS,
    "before2": 1 << NEIGHBOUR_BITS, "after1": 1 << NEIGHBOUR_BITS, "shape1": SHAPES, "shape2": SHAPES, "shape_after": SHAPES,
    "glued": 2 * SHAPES, "file": FILES,
}
STARTS = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()]).tolist(), strict=False))
EDGE = sum(GROUPS.values())  # the feature of a missing neighbour
WIDTH = EDGE + 1


def features(t: Tokens) -> np.ndarray:
    """(tokens, groups) numbers of the active features."""

    def beside(values: np.ndarray, group: str, by: int) -> np.ndarray:
        out = np.full(len(values), EDGE, np.int64)
        if by > 0:
            same = t.docs[by:] == t.docs[:-by]
            out[by:][same] = values[:-by][same] + STARTS[group]
        else:
            same = t.docs[:by] == t.docs[-by:]
            out[:by][same] = values[-by:][same] + STARTS[group]
        return out

    n = len(t.starts)
    if n < 3:
        few = np.full((n, len(GROUPS)), EDGE, np.int64)
        for k, (name, v) in enumerate((("cur", t.cur), ("head", t.head), ("word", t.word))):
            few[:, k] = v + STARTS[name]
        for i in range(n):
            for k, (group, v, by) in enumerate((("before1", t.word, 1), ("before2", t.word, 2), ("after1", t.word, -1), ("shape1", t.shape, 1), ("shape2", t.shape, 2), ("shape_after", t.shape, -1)), 3):
                if 0 <= i - by < n and t.docs[i - by] == t.docs[i]:
                    few[i, k] = v[i - by] + STARTS[group]
        few[:, 9], few[:, 10] = STARTS["glued"] + 2 * t.shape + t.glued, STARTS["file"] + t.file
        return few
    return np.stack(
        [
            t.cur + STARTS["cur"], t.head + STARTS["head"], t.word + STARTS["word"],
            beside(t.word, "before1", 1), beside(t.word, "before2", 2), beside(t.word, "after1", -1),
            beside(t.shape, "shape1", 1), beside(t.shape, "shape2", 2), beside(t.shape, "shape_after", -1),
            STARTS["glued"] + 2 * t.shape + t.glued, STARTS["file"] + t.file,
        ],
        axis=1,
    )


@dataclass
class FieldModel:
    """Weights by feature and tag, and by pair of neighbouring tags."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.starts), 3), np.float64)
        feats = features(t)
        for k in range(feats.shape[1]):
            out += self.weights[feats[:, k]]
        return out

    def decode(self, e: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Best tags of each document's tokens; ties prefer outside."""
        n = len(e)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        move = self.moves - self.moves[O, O]
        gain = e[:, 1:] - e[:, :1]
        inner = move[1:, 1:].max()
        cost = move[O, 1:].max() + move[1:, O].max() - inner
        g = gain.max(1) + inner
        wall = np.flatnonzero(docs[1:] != docs[:-1]) + 1
        far = 1 + np.add.reduceat(np.abs(g), np.concatenate([[0], wall])).max()  # more than any stretch of a document gains
        at = np.arange(n) + np.searchsorted(wall, np.arange(n), side="right")
        padded = np.full(n + len(wall), -far)
        padded[at] = g
        # (a cut between documents: no stretch pays across one)
        total = np.cumsum(padded)
        before = np.concatenate([[0.0], total[:-1]])
        ending = total - np.minimum.accumulate(before)
        starting = np.maximum.accumulate(total[::-1])[::-1] - before
        # a running sum of n terms is off by at most n rounding errors of its largest value
        margin = 8 * len(total) * np.finfo(np.float64).eps * (np.abs(total).max() + far)
        likely = (cost + ending + starting - padded > -margin)[at]
        rows = np.flatnonzero(likely)
        if not len(rows):
            return tags
        breaks = np.flatnonzero((np.diff(rows) > 1) | (docs[rows[1:]] != docs[rows[:-1]])) + 1
        for part in np.split(rows, breaks):
            tags[part] = self._viterbi(gain[part], move)
        return tags

    @staticmethod
    def _viterbi(gain: np.ndarray, move: np.ndarray) -> list[int]:
        rows = gain.tolist()
        m = move.tolist()
        score = [0.0, m[O][B] + rows[0][0], m[O][I] + rows[0][1]]
        back = []
        for own in rows[1:]:
            step, came = [], []
            for y in (O, B, I):
                best, arg = score[O] + m[O][y], O
                for x in (B, I):
                    if score[x] + m[x][y] > best:
                        best, arg = score[x] + m[x][y], x
                step.append(best + (own[y - 1] if y else 0.0))
                came.append(arg)
            score = step
            back.append(came)
        last = [score[y] + m[y][O] for y in (O, B, I)]
        y = max((O, B, I), key=lambda k: last[k])
        out = [y]
        for came in reversed(back):
            y = came[y]
            out.append(y)
        return out[::-1]


def fit_field(feats: np.ndarray, tags: np.ndarray, valid: np.ndarray, epochs: int = 14, batch: int = 128, seed: int = 3) -> FieldModel:
    """Fit by Adam on the conditional likelihood of windows (forward-backward).

    The tags come from the fixed patterns, which the field is to go beyond: words
    are masked at random in training, and in a share ``ALONE`` of the windows all
    that stands beside a token, so that a token's own shape carries weight too.
    """
    rng = np.random.default_rng(seed)
    w, m = np.zeros((WIDTH, 3)), np.zeros((3, 3))
    n = len(feats)
    if not n:
        w[:, O] = 1.0
        return FieldModel(w, m)
    mw, vw, mm, vm = np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)
    names = list(GROUPS)
    maskable = [names.index(k) for k in ("word", "before1", "before2", "after1", "head")]
    beside = [k for k, name in enumerate(names) if name not in ("cur", "file")]
    step = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
            step += 1
            x, y, ok = feats[rows].copy(), tags[rows], valid[rows]
            hide = rng.random((*x.shape[:2], len(maskable))) < 0.2
            x[:, :, maskable] = np.where(hide, EDGE, x[:, :, maskable])
            alone = rng.random(len(x)) < ALONE
            x[np.ix_(np.flatnonzero(alone), np.arange(x.shape[1]), beside)] = EDGE
            e = w[x].sum(2) * ok[:, :, None]
            b, length, _ = e.shape
            fwd = np.empty_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, length):
                s = fwd[:, t - 1, :, None] + m
                top = s.max(1)
                fwd[:, t] = np.log(np.exp(s - top[:, None]).sum(1)) + top + e[:, t]
            bwd = np.zeros_like(e)
            for t in range(length - 2, -1, -1):
                s = (bwd[:, t + 1] + e[:, t + 1])[:, None, :] + m
                top = s.max(2)
                bwd[:, t] = np.log(np.exp(s - top[:, :, None]).sum(2)) + top
            top = fwd[:, -1].max(1)
            z = np.log(np.exp(fwd[:, -1] - top[:, None]).sum(1)) + top
            p = np.exp(fwd + bwd - z[:, None, None])
            truth = np.eye(3)[y]
            de = (p - truth) * ok[:, :, None] / b
            pair = fwd[:, :-1, :, None] + m + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]
            both = (ok[:, :-1] & ok[:, 1:])[:, :, None, None]
            dm = ((np.exp(pair) - truth[:, :-1, :, None] * truth[:, 1:, None, :]) * both).sum((0, 1)) / b + 1e-3 * m
            dw = 1e-4 * w
            for k in range(x.shape[2]):
                flat = x[:, :, k].ravel()
                for tag in range(3):
                    dw[:, tag] += np.bincount(flat, de[:, :, tag].ravel(), WIDTH)
            rate = 0.05 * (1 - 0.8 * epoch / epochs)
            for par, grad, mom, var in ((w, dw, mw, vw), (m, dm, mm, vm)):
                mom *= 0.9
                mom += 0.1 * grad
                var *= 0.99
                var += 0.01 * grad * grad
                par -= rate * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-6)
    return FieldModel(w, m)


def tag_tokens(t: Tokens, values: list[list[tuple[int, int]]]) -> np.ndarray:
    """Training tags of a block's tokens from the spans of its secrets."""
    tags = np.zeros(len(t.starts), np.int8)
    edges = np.searchsorted(t.starts, t.offsets)
    for d, spans in enumerate(values):
        own = t.starts[edges[d] : edges[d + 1]] - t.offsets[d]
        for a, b in spans:
            lo, hi = np.searchsorted(own, [a, b]) + edges[d]
            if hi > lo and not tags[lo:hi].any():
                tags[lo:hi] = I
                tags[lo] = B
    return tags


def training_windows(texts: list[str], seeds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``WINDOW`` tokens: around secrets (``SECRETS_A_TEXT`` of a text, at random), and some others."""
    t = tokens(texts)
    values = [base_spans(text, hexes)[1] for text, hexes in zip(texts, t.hexes, strict=True)]
    tags = tag_tokens(t, values)
    feats = features(t)
    edges = np.searchsorted(t.starts, t.offsets)
    out = []
    for d, seed in enumerate(seeds):
        lo, hi = int(edges[d]), int(edges[d + 1])
        if hi == lo:
            continue
        rng = np.random.default_rng(seed)
        centres = np.flatnonzero(tags[lo:hi] == B) + lo
        if len(centres) > SECRETS_A_TEXT:
            centres = rng.choice(centres, SECRETS_A_TEXT, replace=False)
        centres = centres.tolist()
        if rng.random() < 0.25:
            centres.append(int(rng.integers(lo, hi)))
        for c in centres:
            a = max(lo, c - int(rng.integers(8, WINDOW - 8)))
            out.append((a, min(hi, a + WINDOW)))
    x = np.full((len(out), WINDOW, len(GROUPS)), EDGE, np.int32)
    y, ok = np.zeros((len(out), WINDOW), np.int8), np.zeros((len(out), WINDOW), bool)
    for k, (a, b) in enumerate(out):
        x[k, : b - a], y[k, : b - a], ok[k, : b - a] = feats[a:b], tags[a:b], True
    return x, y, ok


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> FieldModel:
    """Fit the field on at most ``max_train`` documents, the first by a hash of the id.

    An id that stands in several rows gives one text; null ids give none.  Null
    and empty texts hold no windows; without any window nothing is tagged.
    """
    small_batches(docs.sparkSession)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), F.col("text")))["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, block in text_blocks(batch.column("text")):
                keys = batch.column("doc_id").slice(a, b - a)
                seeds = [int(hashlib.sha256(str(k).encode()).hexdigest()[:8], 16) for k in keys.to_pylist()]
                x, y, ok = training_windows(block, seeds)
                raw = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, y, ok)]
                yield pa.RecordBatch.from_arrays(raw, ["x", "y", "ok"])

    rows = texts.mapInArrow(run, "x binary, y binary, ok binary").toPandas().sort_values(["x", "y"], kind="stable")
    n = len(rows)
    x = np.frombuffer(b"".join(map(bytes, rows.x)), np.int32).reshape(n, WINDOW, len(GROUPS))
    y = np.frombuffer(b"".join(map(bytes, rows.y)), np.int8).reshape(n, WINDOW)
    ok = np.frombuffer(b"".join(map(bytes, rows.ok)), bool).reshape(n, WINDOW)
    return fit_field(x, y, ok)


def _within(a: int, b: int, base: list[Span]) -> bool:
    """Whether spans of ``base`` cover all of a span."""
    for _, x, y in sorted(base, key=lambda s: s[1]):
        if x <= a < y:
            a = y
    return a >= b


def find(texts: list[str], model: FieldModel) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the fixed patterns, all spans) of each text."""
    t = tokens(texts)
    tags = model.decode(model.emissions(t), t.docs)
    begins = np.flatnonzero((tags > 0) & ((tags == B) | np.concatenate([[True], (tags[:-1] == 0) | (t.docs[1:] != t.docs[:-1])]))) if len(tags) else np.empty(0, np.int64)
    extra: dict[int, list[tuple[int, int]]] = {}
    for s in begins.tolist():
        e = s + 1
        while e < len(tags) and tags[e] == I and t.docs[e] == t.docs[s]:
            e += 1
        d = int(t.docs[s])
        extra.setdefault(d, []).append((int(t.starts[s] - t.offsets[d]), int(t.ends[e - 1] - t.offsets[d])))
    out = []
    for d, text in enumerate(texts):
        base, _ = base_spans(text, t.hexes[d])
        more = [("field", a, b) for a, b in extra.get(d, ()) if not _within(a, b, base)]
        spans = sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0])))
        out.append((base, spans))
    return out


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span, overlaps joined, replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: FieldModel) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points, end exclusive.  Fixed patterns' spans stay;
    spans of the field that lie within them are left out, and others may overlap
    them.  Null and empty texts have none; texts of any length are searched whole.
    Rows are independent: repeated rows and null ids stay.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    counts = ("n_assign", "n_access", "n_hex")
    schema = T.StructType(
        [rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for a, b, block in text_blocks(batch.column("text")):
                found = find(block, field)
                cols = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:3]]
                cols.append(pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
                cols.append(pa.array([_joined(spans) for _, spans in found], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *cols], schema.names)

    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, model: FieldModel) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; all columns and rows stay, null stays null."""
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            new: list[pa.Array] = []
            for _, _, block in text_blocks(batch.column(at)):
                new.append(pa.array([redacted(t, spans) if spans else t for t, (_, spans) in zip(block, find(block, field), strict=True)], pa.string()))
            cols = list(batch.columns)
            texts = pa.concat_arrays(new) if new else cols[at]
            cols[at] = pc.if_else(pc.is_null(cols[at]), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
