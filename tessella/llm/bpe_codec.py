"""BPE encoding and decoding of a text column, by speculate and verify (see ``bpe``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import TextEncoder, WordBpe
from .common import small_batches, text_blocks


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def encoder(path: str) -> TextEncoder:
    """One encoder a worker process: its cache of words outlives a task."""
    return TextEncoder(WordBpe(path))


def _digests(strings: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(s.as_buffer()).hexdigest() for s in strings], pa.string())


def _rows(batch: pa.RecordBatch, path: str, texts_out: bool) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    names = ["doc_id", "n_tokens", *(("ids", "decoded") if texts_out else ("ids_sha256", "decoded_sha256"))]
    for start, stop, block in text_blocks(batch.column("text")):
        counts, *strings = coder.encode(block)
        strings = [s.cast(pa.string()) if texts_out else _digests(s) for s in strings]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(counts, pa.int64()), *strings], names)


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, digests: bool = False
) -> DataFrame:
    """Per document: doc_id, n_tokens, and ids (decimal, joined by a blank) with the decoded text.

    ``digests`` gives lowercase hex SHA-256 of both strings instead.  Null and
    empty texts have no tokens and empty strings; texts of any length are encoded
    whole.  Rows are independent, so repeated rows and null ids stay; other columns
    are ignored, whatever their names; an empty table gives an empty result.  Special strings in a text
    get their ids, as in the library.  One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(batch, path, not digests)

    return rows.mapInArrow(run, schema)
