"""Text corpora and stored pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.schemas import STORED_PIECE


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(text, split): one row per line; the split is named by the folder (``split=train`` or ``train``)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    split = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:split=)?([^/]+)/[^/]+$", 1)
    return lines.select(F.col("value").alias("text"), split.alias("split"))


def read_token_files(spark: SparkSession, folder: str, glob: str = "token*.txt") -> DataFrame:
    """Right-trimmed lines of the files that match."""
    return spark.read.option("pathGlobFilter", glob).text(folder).select(F.rtrim("value").alias("text"))


def read_whole(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text): one row per file."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def lines_until_blank(files: DataFrame, key: str, skip_blanks: bool = False) -> DataFrame:
    """(key, line, text): lines of each text up to its first blank line, or all lines that are not blank."""
    lines = F.split("text", "\n")
    if skip_blanks:
        return files.select(key, F.posexplode(lines).alias("line", "text")).where("text <> ''")
    blank = F.array_position(lines, "").cast("int")
    kept = F.when(blank > 0, F.slice(lines, F.lit(1), blank - 1)).otherwise(lines)
    return files.select(key, F.posexplode(kept).alias("line", "text"))


def write_pieces(pieces: DataFrame, folder: str, split: str | None = None, compression: str | None = None) -> None:
    """One piece text per line, many per file; with ``split`` one folder per value."""
    columns = ["text"] + ([split] if split else [])
    writer = pieces.select(*columns).write.mode("errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    if split:
        writer = writer.partitionBy(split)
    writer.text(folder)


def recompress(spark: SparkSession, source: str, target: str, edit: Column) -> None:
    """Read a text corpus, edit each line (column ``value``), write it compressed."""
    spark.read.text(source).select(edit.alias("value")).write.option("compression", "gzip").text(target)


def write_piece_json(pieces: DataFrame, folder: str, stamp: str) -> None:
    """Piece text with its settings as JSON, one folder per run stamp."""
    pieces.withColumn("run", F.lit(stamp)).write.mode("append").partitionBy("run").json(folder)


def read_piece_json(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """Stored pieces of any layout; the text comes from whichever key the file uses, ``run`` is the stamp of the folder."""
    stored = spark.read.schema(STORED_PIECE).option("multiLine", str(multi_line).lower()).option(
        "recursiveFileLookup", "true"
    ).json(folder)
    stamp = F.nullif(F.regexp_extract(F.input_file_name(), "/run=([^/]+)/", 1), F.lit(""))
    return stored.withColumn("run", stamp).withColumn("text", F.coalesce("generated_midi", "generate_midi", "sequence"))
