"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with the
columns it was given; the last returns pieces and their places.  Every stage is written
as Parquet and read again before the next, so a lost executor costs one stage at most.
Columns of the documents may have any names besides doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import line_dedup, minhash, mixing, packing, quality
from colonnade.llm.common import Scratch, read, row_of, unpacked


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts.

    A null or empty text is scored like any other; rows that repeat a doc_id or a text are
    judged one by one; an empty table stays empty.
    """
    scored = quality.score_quality(docs, read(spark, sf_dir, "labels"), keep=True)
    return scored.where("predicted = 1").select(*unpacked(docs.columns))


def _recounted(docs: DataFrame, changed, text) -> dict:
    """Column n_chars, if there is one, for rows whose text ``changed`` to ``text``."""
    if "n_chars" not in docs.columns:
        return {}
    own = F.col("_row").getField("n_chars")
    return {"n_chars": F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(own)}


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts freed from later occurrences of repeated passages; a text that loses all goes.

    A passage is three lines, or one or two of more than 50 words.  A null or empty text
    has none and stays; rows that repeat a doc_id are one document to each other and lose
    lines of their own only; an empty table stays empty.
    """
    out = line_dedup.deduped_rows(docs, long_words=50).where("n_removed = 0 or length(text) > 0")
    return out.select(*unpacked(docs.columns, text=F.col("text"), **_recounted(docs, F.col("n_removed") > 0, F.col("text"))))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), that of least doc_id.

    Rows that share a doc_id but not the text are documents of their own, ordered by the
    text's hash; rows of one doc_id and text are one, that of least hash of all columns.
    A null or empty text is near no other and stays; so does a row without doc_id; an
    empty table stays empty.
    """
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    nameless, named = rows.where("id is null").select("_row"), rows.where("id is not null").withColumn("hash", F.xxhash64("text"))
    spans = named.groupBy("id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.count(F.lit(1)).alias("n"))
    differ, most = spans.agg(F.coalesce(F.max(F.col("low") != F.col("high")), F.lit(False)), F.max("n")).first()
    if not differ:
        named = named.withColumn("number", F.col("id"))
    else:  # numbers in the order of doc_id and text, in place of ids
        scratch = Scratch(spark)
        numbers = named.select("id", "hash").distinct().repartitionByRange("id", "hash").sortWithinPartitions("id", "hash")
        numbers = scratch.table(numbers.withColumn("number", F.monotonically_increasing_id()))
        named = scratch.table(named.join(numbers, ["id", "hash"]))
    kept = minhash.near_duplicates(named.select(F.col("number").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("number")).distinct()
    chosen = named.join(kept, "number", "left_semi")
    if (most or 0) > 1:  # of rows with one id and text the least by hash of all columns, told by partial aggregates
        alike = F.xxhash64(*[F.col("_row").getField(c) for c in docs.columns])
        chosen = chosen.groupBy("number").agg(F.min_by("_row", alike).alias("_row"))
    return chosen.select("_row").union(nameless).select(*unpacked(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a cut one ends after its share of words.

    Null and empty texts have no words and are not taken; a null source is a source of its
    own; rows that repeat a doc_id are mixed one by one; an empty table stays empty.
    """
    mixed = mixing.mix_sources(docs, keep=True).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - whole * F.col("size")
    copies = mixed.withColumn("rest", rest.cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1), (whole + F.when(rest > 0, 1).otherwise(0)).cast("int"))))
    cut, own = F.col("copy") > whole, F.col("_row").getField("text").cast("string")
    words = F.regexp_extract_all(own, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(cut, F.array_join(F.slice(words, 1, F.greatest(F.col("rest"), F.lit(1))), "")).otherwise(own)
    out = copies.withColumn("made", text)
    return out.select(*unpacked(docs.columns, text=F.col("made"), **_recounted(docs, cut, F.col("made"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences.

    A null or empty text is one end token; rows that repeat a doc_id are packed one by one;
    an empty table gives no row.
    """
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("mix", mix), ("pack", pack)]

#: Trained scores, MinHash and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
