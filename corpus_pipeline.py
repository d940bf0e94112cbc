"""A corpus pipeline of five operators over the documents table.

Each stage takes all that its predecessor kept, written as Parquet and read again, and returns
the columns of documents; the last returns the packed pieces.  Rows of one id (or without any)
that hold equal texts count as one document from the third stage on, those with different texts
as several; a document that the mix takes twice is packed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import core, jaccard_join, langid, line_dedup, mixing, packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language; the others get the predicted one."""
    model = langid.train(docs.where(~langid.held_out()))
    named = langid.identify(docs, model, keep=("doc_id", "text", "source", "n_chars"))
    return named.where(F.col("lang_pred") != "und").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that match earlier ones, and documents of which no line stays."""
    out = line_dedup.dedup(docs, keep=("lang", "source"))
    return _documents(out.where((F.col("n_removed") < F.col("n_lines")) & ((F.col("n_removed") == 0) | (F.trim("text") != ""))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near copies stays; rows of one id are told apart by their texts."""
    first = jaccard_join.joined(docs).where("id = lead.id and part = lead.part").select(F.col("id").alias("key"), "part").distinct()
    keyed = docs.withColumn("key", core.key("doc_id")).withColumn("part", jaccard_join.part()).join(first, ["key", "part"], "left_semi")
    return keyed.dropDuplicates(["key", "part"]).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes; documents without words stay once."""
    # Rows of one id are told apart by their texts; near_copies left each of them once.
    docs = docs.withColumn("key", F.xxhash64(core.key("doc_id"), "text"))
    mixed = mixing.mix(docs, id_col="key").select(F.col("doc_id").alias("key"), F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    taken = docs.join(mixed.where("copies > 0"), "key")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("sequences", sequences)]

#: SQL cannot express the stages; the operators of line dedup, Jaccard join and packing are tested against brute force, the stages for what they keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = core.stored(docs)
    return docs
