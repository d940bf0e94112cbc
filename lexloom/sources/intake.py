"""Documents as they come in: JSON bodies and plain text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as T
from lexloom.operators import intake


def _string(body: Column, name: str) -> Column:
    """A field of a JSON body, if it is a string."""
    value = F.try_variant_get(body, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(body, f"$.{name}", "string"))


def bodies(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, text, doc_type, error) of JSON bodies; a body that does not parse has the error bad_json, its other columns are null."""
    parsed = rows.select(*keys, F.try_parse_json(column).alias("_v"))
    text = _string(F.col("_v"), "text")
    read = parsed.select(*keys, F.col("_v").isNotNull().alias("_ok"), T.trim(text).alias("text"), intake.doc_type(_string(F.col("_v"), "docType")).alias("doc_type"))
    return read.select(*keys, "text", "doc_type", F.when(F.col("_ok"), intake.document_error(F.col("text"))).otherwise("bad_json").alias("error"))


def files(spark: SparkSession, path: str, limit: int = R.MAX_FILE) -> DataFrame:
    """(path, text, error) of the files under a path, one document each; the content of files beyond the limit is not decoded."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > limit
    return found.select("path", F.when(~large, F.decode("content", "UTF-8")).alias("text"), F.when(large, "too_large").alias("error"))
