"""A corpus: the normalised tables the operators work on.

``Corpus`` is the protocol (one DataFrame per table). ``TestdataCorpus`` derives all of them from the generated
test tables, each from a whole table; the same derivation is stated in SQL in ``notewright.plans.views``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.instruments import gm_programs

SECONDS_PER_UNIT = 0.0625  # 120 beats per minute, 8 units per beat

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


class TestdataCorpus:
    """Lazy views over one folder of test tables."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def n_pieces(self):
        """Number of pieces, as a scalar subquery."""
        return self.table("supplier").agg(F.count("*")).scalar()

    @cached_property
    def pieces(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("piece_id"))

    @cached_property
    def notes(self) -> DataFrame:
        line, order = F.col("l_linenumber"), F.col("l_orderkey")
        start = (order * 7 + line * 3) % 512
        length = 1 + F.col("l_quantity").cast("int") % 8
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("piece_id"),
            line.alias("track_id"),
            ((line * 17 + F.col("l_suppkey")) % 128).cast("int").alias("program"),
            (line == 1).alias("is_drum"),
            (F.col("l_partkey") % 128).cast("int").alias("pitch"),
            start.cast("int").alias("start_u"),
            (start + length).cast("int").alias("end_u"),
            (1 + order % 127).cast("int").alias("velocity"),
        )

    @cached_property
    def timed_notes(self) -> DataFrame:
        """Notes with start and end in seconds."""
        return self.notes.withColumns(
            {"start": F.col("start_u") * SECONDS_PER_UNIT, "end": F.col("end_u") * SECONDS_PER_UNIT}
        )

    @cached_property
    def tracks(self) -> DataFrame:
        return (
            self.notes.select("piece_id", "track_id", "program", "is_drum").distinct()
            .withColumn("name", F.concat(F.lit("Staff "), F.floor(F.col("track_id") / 2).cast("string")))
        )

    @cached_property
    def loop_notes(self) -> DataFrame:
        """Notes of one eight-bar section on the TIME_DELTA grid, so that decoding returns them unchanged."""
        line = F.col("l_linenumber")
        start = 2 * ((F.col("l_orderkey") * 7 + line * 3) % 128)
        return (
            self.table("lineitem")
            .select(
                F.col("l_suppkey").alias("piece_id"),
                line.alias("track_id"),
                (F.col("l_partkey") % 128).cast("int").alias("pitch"),
                start.cast("int").alias("start_u"),
                (start + 2).cast("int").alias("end_u"),
            )
            .distinct()
        )

    @cached_property
    def loop_tracks(self) -> DataFrame:
        return self.tracks

    @cached_property
    def time_signatures(self) -> DataFrame:
        key = F.col("s_suppkey")
        beats = F.element_at(F.array(F.lit(4), F.lit(3), F.lit(2)), (F.col("s_nationkey") % 3 + 1).cast("int"))
        return self.table("supplier").select(
            (key * key % self.n_pieces).alias("piece_id"), key.alias("seq"),
            beats.alias("numerator"), F.lit(4).alias("denominator"),
        )

    @cached_property
    def key_signatures(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            (key * key % self.n_pieces).alias("piece_id"), key.alias("seq"),
            (F.col("c_nationkey") % 24).cast("int").alias("key_number"),
        )

    @cached_property
    def tempo_changes(self) -> DataFrame:
        return self.table("orders").select(
            (F.col("o_orderkey") % self.n_pieces).alias("piece_id"), F.col("o_orderkey").alias("seq"),
            (60 + F.col("o_custkey") % 120).cast("double").alias("bpm"),
        )

    @cached_property
    def lyrics(self) -> DataFrame:
        """One row per lyric event."""
        words = F.array_remove(F.split("text", r"\s+"), "")
        return self.table("documents").select(
            (F.col("doc_id") * F.col("doc_id") % self.n_pieces).alias("piece_id"), F.explode(words).alias("text")
        )

    @cached_property
    def programs(self) -> DataFrame:
        return gm_programs(self.spark)

    @cached_property
    def catalog(self) -> DataFrame:
        """Statistics and names of each page-backed piece; host is the artist, the page title the title."""
        size = F.length("html")
        return self.table("pages").select(
            F.col("page_id").alias("md5"),
            F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("artist"),
            F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
            F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("genre"),
            (size % 16).cast("int").alias("n_instruments"),
            F.round(size / 97.0, 4).alias("number_of_notes_per_second"),
            (size % 3 != 0).alias("four_to_the_floor"),
            F.when(size % 5 == 0, "3/4").when(size % 5 == 1, "2/4").otherwise("4/4").alias("main_time_signature"),
            (size % 7).cast("int").alias("n_time_signature_changes"),
            (size % 4 == 0).alias("lyrics_bool"),
        )

    @cached_property
    def statistics(self) -> DataFrame:
        """The catalogue's statistics columns only."""
        return self.catalog.drop("artist", "title", "genre")

    @cached_property
    def raw_names(self) -> DataFrame:
        """Scraped titles and artists; some entries carry the artist only."""
        entry = F.when(F.col("md5") % 7 == 0, F.array("artist")).otherwise(F.array("title", "artist"))
        return self.catalog.select("md5", F.array(entry).alias("title_artist"))

    @cached_property
    def raw_genres(self) -> DataFrame:
        """Scraped genre lists."""
        second = F.concat(F.lit("g"), (F.col("md5") % 3).cast("string"))
        return self.catalog.select("md5", F.array(F.array("genre", second)).alias("genre"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text")

    @cached_property
    def training_log(self) -> DataFrame:
        """Trainer log lines: four fields for a training step, six for an evaluation."""
        kind = F.col("event_type").isin("click", "view")
        common = [
            F.lit("epoch"), F.col("event_id").cast("double") / 1024, F.lit("step"), F.col("event_id").cast("double"),
        ]
        train = F.create_map(*common, F.lit("loss"), F.col("value"), F.lit("learning_rate"), F.col("value") / 1000)
        evaluation = F.create_map(
            *common, F.lit("eval_loss"), F.col("value"), F.lit("eval_runtime"), F.col("value") * 2,
            F.lit("eval_samples_per_second"), F.col("value") * 3, F.lit("eval_steps_per_second"), F.col("value") * 4,
        )
        return self.table("events").select("event_id", F.when(kind, train).otherwise(evaluation).alias("entry"))
