"""Distribution reports over the statistics table and the token text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILE_BINS = 128
SKETCH_ACCURACY = 20_000


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts per equal-width bin between minimum and maximum; the last bin is closed."""
    x = F.col(value).cast("double")
    spread = rows.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    ranged = rows.where(x.isNotNull()).select(x.alias("x"), spread.alias("range"))
    share = F.try_divide(F.col("x") - F.col("range.lo"), F.col("range.hi") - F.col("range.lo"))
    index = F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)).cast("int")
    return ranged.groupBy(index.alias("bin")).agg(F.count("*").alias("n"))


def exact_percentiles(rows: DataFrame, group: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per group, one column per fraction.

    Equal values are counted first. A mergeable sketch of a group's distinct values gives splitters, so that bins hold like numbers of
    rows however the values are spread. The bins' totals tell which bins hold the wanted ranks, and only rows of these are ordered,
    inside their bin: no group is sorted or held in one task.
    """
    x = F.col(value).cast("double")
    distinct = rows.where(x.isNotNull()).groupBy(group, x.alias("x")).agg(F.count("*").alias("n"))
    shares = [k / PERCENTILE_BINS for k in range(1, PERCENTILE_BINS)]
    splitters = F.percentile_approx("x", shares, SKETCH_ACCURACY).alias("splitters")
    spread = distinct.groupBy(group).agg(F.sum("n").alias("total"), splitters)
    binned = distinct.join(spread, group).withColumn("bin", F.size(F.filter("splitters", lambda s: s < F.col("x")))).drop("splitters")
    sizes = binned.groupBy(group, "bin").agg(F.sum("n").alias("size"), F.max("total").alias("all"))
    earlier = Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    places = [(F.col("all") - 1) * F.lit(float(f)) for f in fractions.values()]
    ranks = F.array(*[rank(place) for place in places for rank in (F.floor, F.ceil)])
    wanted = F.exists(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))
    inside = Window.partitionBy(group, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        binned.join(before.where(wanted).select(group, "bin", "before"), [group, "bin"])
        .withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .withColumn("first", F.col("before") + F.col("within"))
    )

    def at(position: Column) -> Column:
        return F.max(F.when((position >= F.col("first")) & (position < F.col("first") + F.col("n")), F.col("x")))

    columns = []
    for name, fraction in fractions.items():
        place = (F.col("total") - 1) * F.lit(float(fraction))
        low, high = at(F.floor(place)), at(F.ceil(place))
        weight = F.max(place - F.floor(place))
        columns.append((low + weight * (high - low)).alias(name))
    return ranked.groupBy(group).agg(*columns)


def medians_of(rows: DataFrame, group: str, values: list[str]) -> DataFrame:
    """(statistic, group, median) of several columns from one read of the rows, largest first within a statistic."""
    cells = F.array(*[F.struct(F.lit(v).alias("statistic"), F.col(v).cast("double").alias("value")) for v in values])
    stacked = rows.select(group, F.explode(cells).alias("cell")).select(F.struct(F.col("cell.statistic"), group).alias("key"), "cell.value")
    found = exact_percentiles(stacked.where(F.col(f"key.{group}").isNotNull()), "key", "value", {"median": 0.5})
    return found.select("key.*", "median").orderBy("statistic", F.desc("median"), group)


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median per group, largest first."""
    return exact_percentiles(rows, group, value, {"median": 0.5}).orderBy(F.desc("median"), group)


def box_plot(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and whiskers (extreme points within 1.5 interquartile ranges) per group."""
    quartiles = exact_percentiles(rows, group, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col(value).cast("double")
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    whiskers = rows.join(quartiles, group).where(inside).groupBy(group).agg(
        F.min(x).alias("low_whisker"), F.max(x).alias("high_whisker")
    )
    return quartiles.join(whiskers, group)


def share_of_most_common(rows: DataFrame, value: str) -> DataFrame:
    """Share of the most common non-null value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("share"))


def instrument_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w.startswith("INST"))


def token_counts(texts: DataFrame) -> DataFrame:
    return counts(texts.select(F.explode(instrument_tokens(F.col("text"))).alias("token")), "token")


def token_combinations(texts: DataFrame) -> DataFrame:
    """Sorted instrument tokens per line, repeats kept."""
    combination = F.array_join(F.array_sort(instrument_tokens(F.col("text"))), " ")
    return counts(texts.select(combination.alias("combination")), "combination")


def token_occurrence(texts: DataFrame) -> DataFrame:
    """Instrument labels by ascending count."""
    labels = F.transform(
        F.filter(F.split("text", " "), lambda w: F.contains(w, F.lit("INST="))), lambda w: F.substring_index(w, "=", -1)
    )
    return counts(texts.select(F.explode(labels).alias("instrument")), "instrument").orderBy("n", "instrument")


def versions(rows: DataFrame) -> DataFrame:
    """Songs by number of versions."""
    return counts(rows, "artist", "title").orderBy(F.desc("n"), "artist", "title")


def training_history(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows, evaluation rows) of a trainer log, told apart by the number of fields."""
    size, entry = F.size("entry"), F.col("entry")
    train = log.where(size == 4).select(
        entry["epoch"].alias("epoch"), entry["step"].alias("step"), entry["loss"].alias("loss"),
        entry["learning_rate"].alias("learning_rate"),
    )
    evaluation = log.where(size == 6).select(
        entry["epoch"].alias("epoch"), entry["step"].alias("step"), entry["eval_loss"].alias("loss")
    )
    return train, evaluation
