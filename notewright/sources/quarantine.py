"""Splitting input into usable rows and an error log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def note_error(lowest: int = 0, highest: int = 127, latest_u: int | None = None) -> Column:
    """Reason why a note row cannot be used, else null. ``latest_u``: no note of a sound piece ends later."""
    known = F.col("start_u").isNotNull() & F.col("end_u").isNotNull() & F.col("pitch").isNotNull()
    reason = F.when(~known, "missing value").when(F.col("end_u") <= F.col("start_u"), "empty note")
    reason = reason.when(F.col("start_u") < 0, "starts before the piece")
    reason = reason.when(~F.col("pitch").between(lowest, highest), "pitch out of range")
    return reason if latest_u is None else reason.when(F.col("end_u") > latest_u, "ends beyond the piece limit")


def split_good_and_errors(
    rows: DataFrame, lowest: int = 0, highest: int = 127, latest_u: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with ``reason``); a reader that already found an error keeps its own reason."""
    reason = note_error(lowest, highest, latest_u)
    if "error" in rows.columns:
        reason = F.coalesce(F.col("error"), reason)
        checked = rows.withColumn("reason", reason).drop("error")
    else:
        checked = rows.withColumn("reason", reason)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def split_playable(notes: DataFrame, lowest: int = 0, highest: int = 127) -> tuple[DataFrame, DataFrame]:
    """(notes with a pitch, the others with ``reason``). Statistics count, sum and compare the same notes in all their columns."""
    playable = F.coalesce(F.col("pitch").between(lowest, highest), F.lit(False))
    reason = F.when(F.col("pitch").isNull(), "missing value").otherwise("pitch out of range")
    return notes.where(playable), notes.where(~playable).withColumn("reason", reason)
