"""Program, family and instrument-label lookups."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.constants import (
    FAMILY_NAMES,
    FAMILY_TO_PROGRAM,
    N_PROGRAMS,
    PROGRAM_NAMES,
    PROGRAMS_PER_FAMILY,
    RANGE_FAMILIES,
)


def _strings(values) -> Column:
    """Constant array, given as one literal that the optimizer splits once."""
    return F.split(F.lit("|".join(values)), "[|]")


def family_number(program: Column) -> Column:
    """0..15, null outside the program range."""
    return F.when(program.between(0, N_PROGRAMS - 1), F.floor(program / PROGRAMS_PER_FAMILY).cast("int"))


def family_name(program: Column) -> Column:
    return F.get(_strings(FAMILY_NAMES), family_number(program))


def program_name(program: Column) -> Column:
    return F.when(program.between(0, N_PROGRAMS - 1), F.get(_strings(PROGRAM_NAMES), program))


def gm_programs(spark: SparkSession) -> DataFrame:
    """128-row dimension: program, family_number, family_name, program_name."""
    program = F.col("id").cast("int")
    return spark.range(N_PROGRAMS).select(
        program.alias("program"),
        family_number(program).alias("family_number"),
        family_name(program).alias("family_name"),
        program_name(program).alias("program_name"),
    )


def family_dimension(spark: SparkSession) -> DataFrame:
    """16-row dimension: family_number, display_name."""
    names = [FAMILY_TO_PROGRAM[f][1] if f in FAMILY_TO_PROGRAM else FAMILY_NAMES[f] for f in range(len(FAMILY_NAMES))]
    family = F.col("id").cast("int")
    return spark.range(len(names)).select(
        family.alias("family_number"), F.get(_strings(names), family).alias("display_name")
    )


def draw_family_programs(seed: int | None = None, fixed: bool = True) -> list[int]:
    """One program per family, drawn once per run; with ``fixed`` only families 11-15 are a draw."""
    rng = random.Random(seed)
    chosen = []
    for family in range(len(FAMILY_NAMES)):
        if fixed and family not in RANGE_FAMILIES:
            chosen.append(FAMILY_TO_PROGRAM[family][0])
        else:
            chosen.append(family * PROGRAMS_PER_FAMILY + rng.randrange(PROGRAMS_PER_FAMILY))
    return chosen


def family_program(family: Column, programs: list[int]) -> Column:
    """Program that stands for a family; null for an unknown family."""
    return F.when(
        family.between(0, len(programs) - 1), F.get(F.array(*[F.lit(p) for p in programs]), family.cast("int"))
    )


def instrument_label(program: Column, is_drum: Column, familize: bool = False) -> Column:
    """Text label of a track; the drum flag wins."""
    number = family_number(program) if familize else program
    return F.when(is_drum, "DRUMS").otherwise(number.cast("string"))


def rewrite_instruments(text: Column, number) -> Column:
    """Apply ``number`` (Column -> Column) to every INST= value of a text; INST=DRUMS stays."""

    def one(token: Column) -> Column:
        value = F.try_element_at(F.split(token, "="), F.lit(2)).cast("int")
        hit = token.startswith("INST=") & (token != "INST=DRUMS")
        return F.when(hit, F.concat(F.lit("INST="), F.coalesce(number(value).cast("string"), F.lit("None")))).otherwise(
            token
        )

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def text_to_families(text: Column) -> Column:
    return rewrite_instruments(text, family_number)


def text_to_programs(text: Column, programs: list[int]) -> Column:
    return rewrite_instruments(text, lambda family: family_program(family, programs))


def display_family(instruments: DataFrame, column: str, dimension: DataFrame) -> DataFrame:
    """Family number of a display name as text, DRUMS when the name is not in the 16-row dimension."""
    dim = F.broadcast(dimension.withColumnRenamed("display_name", column))
    return instruments.join(dim, column, "left").withColumn(
        "family", F.coalesce(F.col("family_number").cast("string"), F.lit("DRUMS"))
    ).drop("family_number")
