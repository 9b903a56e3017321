"""The registered ``opN_*`` queries: each applies its operator to its whole table.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing
columns have the results that the operators state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the fit sees no held-out row (see ``toxicity``)."""
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the fixed patterns, a digest of their spans, and all spans of every document (see ``secrets.scan``)."""
    from .secrets import fit, scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness (see ``order_minhash.fingerprint_edits``)."""
    from .order_minhash import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of every document (see ``bpe_codec.encode``)."""
    from .bpe_codec import encode

    return encode(table(spark, sf_dir, "documents"), digests=True)


def op5_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans, and a digest of the rest of every document (see ``repeats.remove_repeats``)."""
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document (see ``mixing.mix``)."""
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the files (see ``token_files.round_trip``)."""
    from .token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document (see ``near_dedup.near_components``)."""
    from .near_dedup import near_components

    return near_components(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page (see ``main_text.main_texts``)."""
    from .main_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector (see ``cap_filters.near_vectors``)."""
    from .cap_filters import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_order_minhash": op3_order_minhash,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_repeat_removal": op5_repeat_removal,
    "op6_source_mixing": op6_source_mixing,
    "op7_token_files": op7_token_files,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_main_text": op9_main_text,
    "op10_cap_filters": op10_cap_filters,
}
