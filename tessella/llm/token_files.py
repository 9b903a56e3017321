"""Token files: ids packed in a fixed number of bits, with random access.

A file holds the ids of consecutive documents (ascending id):

    magic        8 bytes  ``FIXBITS1``
    bits         u32      bits of an id, the least for the vocabulary
    block        u32      ids of a block (a multiple of 8, so blocks start at bytes)
    documents    u64
    tokens       u64
    doc ids      i64 each
    doc lengths  u64 each (ids of the document, its end id included)
    block starts u64 each (byte offset in the payload; one more than blocks)
    payload      ids, lowest bit first

An id at position p lies in block p // block; ``TokenFile.ids`` unpacks any
range with numpy.  Files go to a folder that all executors share, under a
temporary name until whole, so a repeated task only writes the same file again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import held_folders, materialize, shared_dir, shuffle_width, small_batches, text_blocks
from .pretoken import Flat, SpanCache, code_points, distinct_spans, token_spans

MAGIC = b"FIXBITS1"
BLOCK = 4096
#: A file ends with the document that reaches so many ids.
FILE_IDS = 1 << 24
_HEAD = struct.Struct("<8sIIQQ")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: memoryview, count: int, bits: int, skip: int = 0) -> np.ndarray:
    """``count`` ids from the ``skip``-th on."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count, skip * bits // 8).astype(np.uint32)
    at = (np.arange(skip, skip + count, dtype=np.int64)) * bits
    padded = np.frombuffer(bytes(raw[at[0] // 8 if count else 0 :]) + bytes(8), np.uint8)
    at -= (at[0] // 8) * 8 if count else 0
    held = np.zeros(count, np.uint64)
    for k in range((bits + 7 + 7) // 8):
        held |= padded[at // 8 + k].astype(np.uint64) << np.uint64(8 * k)
    return ((held >> (at % 8).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_bytes(doc_ids: list[int], docs: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    """One file of the format above."""
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    payload = pack(ids, bits)
    blocks = -(-len(ids) // block)
    starts = np.minimum(np.arange(blocks + 1, dtype=np.uint64) * (block * bits // 8), len(payload)).astype("<u8")
    head = _HEAD.pack(MAGIC, bits, block, len(docs), len(ids))
    lengths = np.asarray([len(d) for d in docs], "<u8")
    return b"".join((head, np.asarray(doc_ids, "<i8").tobytes(), lengths.tobytes(), starts.tobytes(), payload))


class TokenFile:
    """Reader of one file: documents by place, ids by range."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        magic, self.bits, self.block, n, self.tokens = _HEAD.unpack_from(view, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(view, "<i8", n, at)
        self.lengths = np.frombuffer(view, "<u8", n, at + 8 * n).astype(np.int64)
        at += 16 * n
        blocks = -(-self.tokens // self.block)
        self.block_starts = np.frombuffer(view, "<u8", blocks + 1, at)
        self.payload = view[at + 8 * (blocks + 1) :]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at positions start to stop of the file, by way of the block offsets."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first = start // self.block
        return unpack(self.payload[int(self.block_starts[first]) :], stop - start, self.bits, start - first * self.block)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class CachedTokenizer:
    """The tokenizers library behind a bounded cache of distinct pre-tokens.

    The vocabulary's pre-tokeniser cuts a text before merging, so a text's ids
    are those of its pre-tokens in order, each by the library's model.  Texts
    with special strings go to the library whole.  The cache is emptied when its
    pre-tokens hold ``max_chars`` characters.
    """

    def __init__(self, path: str, max_chars: int = 4_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.blank = byte_letters()[32]
        self.max_chars = max_chars
        self._clear()

    def _clear(self) -> None:
        self.words, self.ids = SpanCache(), Flat(np.uint32)

    def _spelled(self, word: str) -> str:
        """A pre-token as the vocabulary's characters, one a byte."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.blank)
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def _learn(self, words: list[str]) -> None:
        got = list(map(self.tokenize, map(self._spelled, words)))
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.ids.add(np.fromiter((t.id for g in got for t in g), np.uint32, int(sizes.sum())), sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        special = [d for d, t in enumerate(texts) if "<|" in t and any(s in t for s in self.specials)]
        if special:
            out = self.encode(["" if d in special else t for d, t in enumerate(texts)])
            for d in special:
                out[d] = np.asarray(self.tokenizer.encode(texts[d], add_special_tokens=False).ids, np.uint32)
            return out
        points, offsets = code_points(texts)
        if not len(points):
            return [np.empty(0, np.uint32)] * len(texts)
        starts, ends = token_spans(points, offsets, blanks=True)
        codes, where, hashes = distinct_spans(points, starts, ends)
        if self.words.held.used > self.max_chars:
            self._clear()
        first, last = starts[where], ends[where]
        known = self.words.find(points, first, last - first, hashes)
        new = np.flatnonzero(known < 0)
        if len(new):
            joined = "".join(texts)
            self._learn([joined[a:b] for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)])
            known[new] = self.words.add(points, first[new], last[new] - first[new], hashes[new])
        ids, sizes = self.ids.take(known[codes])
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


@cache
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder URI as Spark writes them."""
    scheme, _, path = uri.partition(":")
    if scheme == "s3a":
        uri = f"s3:{path}"
    elif not path or scheme == "file":
        uri = f"file:///{(path or uri).lstrip('/')}"
    return fs.FileSystem.from_uri(uri)


def write_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0
) -> DataFrame:
    """Encode all documents and write them as token files in ascending id order.

    Returns (shard, path, tokens), one row a file; files in the order of their
    shard hold the documents in order.  Null and empty texts hold the end id
    alone; rows with equal ids follow in the order of their texts' hashes; rows
    with a null id come first, as id -2**63.  No file is written for an empty
    table.  The texts are shuffled once, to ranges of (id, hash of the text), so
    rows of one id need not meet; a file ends at ``FILE_IDS`` ids or the range's
    end, and a document is never cut.
    """
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    order = ("doc_id", "tie")
    rows = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def finish(shard: int, doc_ids: list[int], ids: list[np.ndarray], bits: int) -> tuple[int, str, int]:
        where, base = _place(folder)
        where.create_dir(base, recursive=True)
        name = f"{base}/shard-{shard:016d}.tok"
        half = f"{base}/_{uuid.uuid4().hex}.part"
        with where.open_output_stream(half) as out:
            out.write(file_bytes(doc_ids, ids, bits))
        where.move(half, name)
        return shard, name, sum(map(len, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        bits = max(1, (max(coder.size - 1, end_id)).bit_length())
        end = np.asarray([end_id], np.uint32)
        shard, doc_ids, ids, held, done = TaskContext.get().partitionId() << 32, [], [], 0, []
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for start, _, block in text_blocks(batch.column("text")):
                for k, got in enumerate(coder.encode(block), start):
                    if held >= FILE_IDS:
                        done.append(finish(shard, doc_ids, ids, bits))
                        shard, doc_ids, ids, held = shard + 1, [], [], 0
                    doc_ids.append(-(2**63) if keys[k] is None else keys[k])
                    small = np.concatenate([got, end])
                    ids.append(small.astype(np.uint16) if bits <= 16 else small)
                    held += len(small)
        if doc_ids:
            done.append(finish(shard, doc_ids, ids, bits))
        cols = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["shard", "path", "tokens"])

    return rows.mapInArrow(run, "shard long, path string, tokens long")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, local_start, n_tokens, ids_crc32) of each document of a folder's files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    rows = files.select(F.regexp_extract("path", r"shard-(\d+)\.tok", 1).cast("long").alias("shard"), "content")
    schema = "shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = TokenFile(raw.as_buffer())
                crcs = [zlib.crc32(held.document(k).astype("<u4").tobytes()) for k in range(len(held.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(crcs), shard, np.int64)), pa.array(held.doc_ids), pa.array(held.starts[:-1]),
                        pa.array(held.lengths), pa.array(crcs, pa.int64()),
                    ],
                    ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, folder: str | None = None) -> DataFrame:
    """Write token files and describe every document from what the files hold.

    Per document: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32.  A file's base is the sum of the files before it: one row a file.
    Repeated rows, null ids, null texts and an empty table: see ``write_files``;
    a null id is read back as -2**63.  Other columns are ignored.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
        held_folders(spark).append(folder)
    written = materialize(write_files(docs, folder, id_col, text_col, vocabulary))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = written.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    out = read_files(spark, folder).join(bases, "shard")
    return out.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
