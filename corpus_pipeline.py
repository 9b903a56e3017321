"""A corpus pipeline of five stages over ``documents``.

1. toxicity: documents that the fitted factorization machine rejects go.
2. MinHash near-dedup: one document of each group of near copies (a Jaccard
   similarity of five-word shingles of 0.80 or more) stays.
3. secret scans: every span found is replaced in the text.
4. mixing: each source is taken to its target; a document taken n times whole
   becomes n rows, and the one at a source's cut gives its first words.
5. BPE: every row is encoded and decoded.

A stage is a function of (spark, docs, sf_dir); its result is written as Parquet
to the shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe_codec, mixing, near_dedup, secrets, toxicity
from tessella.llm.common import held_folders, materialize, release, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold.

    A null text scores as an empty one; rows with a null id and repeated rows are
    scored like others; an empty table stays empty.  Only the columns of documents
    go on, whatever else ``docs`` holds, in this stage and all others.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(~F.col("_toxic")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near copies, each of its distinct texts once.

    Rows of a null id count as documents after all others; of repeated rows of an
    id and text one stays.
    """
    rows = docs.select(*COLUMNS)
    known = rows.where("doc_id IS NOT NULL").withColumn("key", F.col("doc_id"))
    unnamed = rows.where("doc_id IS NULL")
    if not unnamed.isEmpty():
        last = known.agg(F.max("doc_id")).first()[0]
        numbered = unnamed.withColumn("key", F.monotonically_increasing_id() + F.lit((-1 if last is None else last) + 1))
        known = known.unionByName(stored(numbered, "unnamed"))
    found = near_dedup.near_components(known, id_col="key", percent=NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("key")).distinct()
    kept = known.join(found, "key", "left_semi")
    repeated = materialize(known.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, "key", "left_semi").dropDuplicates(["key", "text"])
    return kept.join(repeated, "key", "left_anti").unionByName(once).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced, and ``n_chars`` counted anew.

    Rows stay, also repeated ones; a null text stays null with its ``n_chars``; null
    ids are not in the field's training sample; texts of any length are searched
    whole; an empty table stays empty.
    """
    rows = docs.select(*COLUMNS)
    done = secrets.redact(rows, secrets.fit(rows))
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch of a document that the mix takes; the last may be its first words only.

    Documents without words (null and empty texts) give no row, as there is nothing
    to take; null ids and sources are values like others; of rows that are equal in
    source, id and text each counts; ties have the order of the row key's MD5; an
    empty table stays empty.
    """
    rows = docs.select(*COLUMNS)
    return mixing.materialize_mix(rows).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, source, n_tokens, ids_sha256, decoded_sha256.

    A null text is encoded as an empty one; rows stay, also repeated ones; an empty
    table gives an empty result.
    """
    coded = bpe_codec.encode(docs.withColumn("key", F.struct("doc_id", "source")), id_col="key", digests=True)
    return coded.select("doc_id.doc_id", "doc_id.source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode),
]

#: The fitted models and the tokenizer have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    What a stage has written for itself, and its predecessor's rows, are removed
    once its own are written.
    """
    docs, before = table(spark, sf_dir, "documents"), list(held_folders(spark))
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, keep=[*before, held_folders(spark)[-1]])
    return docs
