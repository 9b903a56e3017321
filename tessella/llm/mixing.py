"""Mix sources to target weights, with DataFrame operations only.

Documents get a hash-random key; inside each source they are ordered by that
key, and a distributed prefix sum of their sizes tells where each source's
budget ends.  The prefix sum has two levels: the top digits of the key name a
bucket, sums per (source, bucket) are accumulated per source (4096 rows a
source), and the running sum inside a bucket is added to its bucket's base.  So
a source with a third of all rows is spread over 4096 groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the key that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """MD5, in hex, of a row's source, id and text: its place in the random order, and its name."""
    source, name, text = F.col(source_col), F.col(id_col).cast("string"), F.col(text_col)
    parts = [F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), F.md5(source.cast("binary")))), F.coalesce(name, F.lit("-")), F.coalesce(F.md5(text.cast("binary")), F.lit("-"))]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code point order, null last.  A target is
    ``min(weight * level, max_epochs * size)`` for the level at which targets
    sum to the total: what resharing the excess by weight converges to.  Sources
    whose cap per weight lies below the level are capped; sorted by that ratio
    they form a prefix, so one running sum finds the level.  One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1))
    rows = rows.withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    # the level of the first source that stays under its cap holds for all after it
    ratio = (F.col("cap") / F.col("weight")).alias("ratio")
    fits = F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct(ratio, F.col("level")))
    rows = rows.withColumn("level", F.min(fits).over(whole)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def _shares(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(key, doc_id, size, source_size, target, whole_epochs, cut) of every row."""
    rows = docs.select(
        row_key(id_col, text_col, source_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    rows = materialize(rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    base = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket"))
    bases = sums.select(F.col("source"), F.col("bucket"), (base - F.col("bucket_size")).alias("base"))
    bases = bases.alias("b").join(per_source.alias("t"), F.expr("b.source <=> t.source"))
    bases = bases.select("b.source", "b.bucket", "b.base", "t.source_size", "t.target")
    inner = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    out = rows.alias("r").join(bases.alias("s"), F.expr("r.source <=> s.source AND r.bucket = s.bucket"))
    size, source_size = F.col("size"), F.col("source_size")
    budget = F.floor(F.col("target") + 1e-6)
    epochs = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * source_size
    cut = F.greatest(F.lit(0), F.least(size, rest - F.col("base") - F.col("inner")))
    return out.select(
        "key", F.col("doc_id"), size, source_size.cast("long").alias("source_size"), F.col("target"), epochs.alias("whole_epochs"), cut.cast("long").alias("cut")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """Per document: id, size, source_size, target, taken (words, repeats counted), whole_epochs.

    A source takes whole epochs of all its documents while they fit its target,
    then, in hash order, documents up to the exact remaining budget; the
    document at the cut gives its first words.  The order depends on the source,
    the id and the text alone, so reruns agree; rows that are equal in all three
    are interchangeable, and each counts.  Null text: size 0, taken 0; a null
    source is a source of its own; null ids are ids like others.  Texts of any
    length are counted whole.  An empty table gives an empty result.  Columns
    besides the three named ones are ignored, whatever their names.
    """
    rows = _shares(docs, id_col, text_col, source_col, weights, max_epochs)
    taken = F.col("whole_epochs") * F.col("size") + F.col("cut")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "whole_epochs")


def first_words(text: Column, words: Column) -> Column:
    """The first ``words`` words of the text, joined by one blank."""
    return F.call_function("substring_index", F.ltrim(F.regexp_replace(text, F.lit(r"[\x20\x09-\x0D]+"), F.lit(" "))), F.lit(" "), words.cast("int"))


def materialize_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """The mixed corpus itself: rows of ``docs``, a row an epoch, cut texts with ``n_chars`` counted anew.

    Documents that the mix takes nothing of give no row.  Rows that are equal in
    source, id and text share what the mix takes of them, one after another.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    plan = _shares(docs, "doc_id", "text", "source", weights, max_epochs)
    plan = plan.groupBy("key").agg(F.first("size").alias("size"), F.first("whole_epochs").alias("whole_epochs"), F.sum("cut").alias("cut"))
    plan = plan.select("key", F.struct("size", "whole_epochs", "cut").alias("share"))
    rows = docs.select(F.struct(*own).alias("row"), row_key("doc_id", "text", "source").alias("key"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    rows = rows.join(plan, "key")
    size = F.col("share.size")
    cut = F.greatest(F.lit(0), F.least(size, F.col("share.cut") - (F.col("nth") - 1) * size))
    rows = rows.withColumn("taken", F.col("share.whole_epochs") * size + cut).where("taken > 0")
    rows = rows.withColumn("words", F.explode(F.expr("transform(sequence(0, cast(ceil(taken / share.size) as int) - 1), k -> least(share.size, taken - k * share.size))")))
    part = F.col("words") < size
    text = F.when(part, first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(part, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
