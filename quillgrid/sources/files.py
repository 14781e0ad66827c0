"""Documents in and results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, glob: str | None = "*.md") -> DataFrame:
    """(path, text): a row for each file below ``path``, read whole."""
    read = spark.read.option("recursiveFileLookup", True)
    read = read.option("pathGlobFilter", glob) if glob else read
    return read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(doc_id, text) of texts at hand, as from standard input."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def read_chunks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of (doc_id, seq, chunk, eof) from Parquet files that appear."""
    read = spark.readStream.schema("doc_id long, seq int, chunk string, eof boolean")
    return (read.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else read).parquet(path)


def cut_chunks(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as chunks of ``size`` characters, the last marked."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq")).select("doc_id", "seq", F.substr("_t", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), (F.col("seq") == F.col("_n") - 1).alias("eof"))


def write_matches(found: DataFrame, path: str, quiet: bool = False) -> None:
    """The captures of valid documents, a JSON line each; nothing when quiet."""
    if not quiet:
        found.where("is_valid").select("value").write.text(path)


def write_errors(found: DataFrame, path: str, *keys: str) -> None:
    """A JSON line for each error."""
    found.select(*keys, F.explode("errors").alias("error")).select(*keys, "error.*").write.json(path)
