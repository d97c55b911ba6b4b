"""Quality rules whose limits come from the data: quantile sketches per language and source, pooled with their language's.

Fixed cutoffs suit one language or one source only. Here every text is measured, each (language, source) pair gets a mergeable
KLL sketch of every measure, and a limit is some times as far from the median as a tail quantile. The quantiles of a pair are pooled with
those of its language, and these with those of all rows, in proportion to the numbers of texts: the more texts, the more a pair stands
for itself, without a number at which the rule changes. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Measures that a limit bounds from above, with the least distance of the limit from the median: numerator and column of the denominator.
#: One symbol, one line, one window of three words that comes twice, one character; of the text at hand.
UNIT = {"symbol_share": (1, "word_chars"), "dup_line_share": (1, "n_lines"), "repeat_share": (6, "n_words"), "word_length": (1, "n_words")}
#: Measures that a limit bounds from below too.
LOWER = ("word_length",)
#: Distance of the limit from the median, in times the distance of the tail quantile. More junk than beyond it would set its own limit.
FENCE = 4.0
TAIL = 0.9
#: The next wider group counts as much as this number of a group's own texts.
PRIOR_ROWS = 1000
LEAST_WORDS = 50
#: Accuracy of a sketch: exact up to so many texts, ranks within 0.3 % beyond; about 25 kB a measure at most.
SKETCH = 1024
#: Pairs of language and source, of about 100 bytes each, up to which their limits are broadcast.
MOST_SHIPPED = 50_000


def text_measures(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long) of the whole text; null text: zeros.

    Windows of three words are compared by 64-bit hashes inside the row; the time is that of sorting the windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    spaced = text
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    docs = docs.withColumns({"_w": F.array_remove(F.split(spaced, " "), ""), "_l": lines})
    docs = docs.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    window = F.transform("_h", lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)))
    docs = docs.withColumn("_k", F.slice(window, F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))))
    # Only a text with a window twice needs the positions.
    repeats = F.size(F.array_distinct("_k")) < F.size("_k")
    none = F.array().cast("array<struct<k:bigint,i:int>>")
    docs = docs.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).otherwise(none))
    twice = F.filter("_s", lambda e, j: (F.get("_s", j - 1)["k"] == e["k"]) | (F.get("_s", j + 1)["k"] == e["k"]))
    docs = docs.withColumn("_p", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3))))
    return docs.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
        }
    ).drop("_w", "_l", "_h", "_k", "_s", "_p")


def shares(rows: DataFrame) -> DataFrame:
    """The measures that limits apply to, and base_failed."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")

    return rows.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def limits(rows: DataFrame, fence: float = FENCE, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, median and limits per measure) from rows with the measures; texts that fail the base rule are not learnt from.

    A pair of n texts has n / (n + prior_rows) of its own quantile and the rest of its language's, which is pooled with that of all rows
    alike. Sketches merge, so sources are summed up once, on the map side, and languages come from the sources' sketches. A pair without
    any text to learn from takes the limits of its language. Null languages and sources are values of their own.
    """
    ok = ~F.col("base_failed")
    sketches = [F.kll_sketch_agg_double(F.when(ok, F.col(m)), F.lit(SKETCH)).alias(m) for m in UNIT]
    own = cut_lineage(rows.groupBy("lang", "source").agg(F.count_if(ok).alias("n"), *sketches))
    whole = own.agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH)).alias(m) for m in UNIT])
    by_lang = own.groupBy("lang").agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH)).alias(m) for m in UNIT])
    own, by_lang, whole = own.alias("o"), by_lang.alias("l"), whole.alias("a")
    joined = own.join(by_lang, F.col("o.lang").eqNullSafe(F.col("l.lang")), "left").join(whole, F.lit(True), "left")

    def pooled(m: str, p: float) -> Column:
        # No text to learn from at all: no limit.
        value = F.when(F.col("a.n") > 0, F.kll_sketch_get_quantile_double(F.col(f"a.{m}"), F.lit(p)))
        for group in ("l", "o"):
            n = F.col(f"{group}.n")
            share = n / (n + prior_rows)
            value = F.when(n > 0, share * F.kll_sketch_get_quantile_double(F.col(f"{group}.{m}"), F.lit(p)) + (1 - share) * value).otherwise(value)
        return value

    columns = [F.col("o.lang").alias("lang"), F.col("o.source").alias("source")]
    for m in UNIT:
        columns += [pooled(m, p).alias(f"{at}_{m}") for at, p in (("low", 1 - TAIL), ("mid", 0.5), ("high", TAIL))]
    found = joined.select(*columns)
    columns = ["lang", "source"]
    for m in UNIT:
        low, mid, high = F.col(f"low_{m}"), F.col(f"mid_{m}"), F.col(f"high_{m}")
        columns += [mid, (mid + fence * (high - mid)).alias(f"max_{m}"), (mid - fence * (mid - low)).alias(f"min_{m}")]
    return found.select(*columns)


def judge(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with kept: false if base_failed, else whether every measure is within the limits of the row's language and source."""
    found = found.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    # One sum under coalesce, not a conjunction: a filter on it stays above the join and does not repeat the measures below it.
    against = F.col("base_failed").cast("int")
    for m, (n, whole) in UNIT.items():
        unit = F.coalesce(F.try_divide(F.lit(float(n)), F.col(whole)), F.lit(0.0))
        outside = F.col(m) > F.greatest(F.col(f"max_{m}"), F.col(f"mid_{m}") + unit)
        if m in LOWER:
            outside = outside | (F.col(m) < F.least(F.col(f"min_{m}"), F.col(f"mid_{m}") - unit))
        against = against + F.when(outside, 1).otherwise(0)
    # Few pairs go to the rows; many are joined as Spark sees fit.
    found = cut_lineage(found)
    found = F.broadcast(found) if found.count() <= MOST_SHIPPED else found
    return rows.join(found, same, "left").withColumn("kept", F.coalesce(against, F.lit(1)) == 0).drop("_lang", "_source", *[f"{x}_{m}" for x in ("mid", "max", "min") for m in UNIT])


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, measures, base_failed, kept of every document; repeated and null ids stay rows of their own.

    The measures (no texts) are kept in the shared folder, as limits and verdicts both need them.
    """
    rows = shares(text_measures(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    rows = cut_lineage(rows)
    return judge(rows, limits(rows))


def keep(docs: DataFrame) -> DataFrame:
    """`docs` without the texts that the rules reject; same columns, each row judged on its own text.

    The measures are computed twice, for the limits and for the verdicts, so that texts are neither stored again nor shuffled.
    """
    own = docs.columns
    found = limits(cut_lineage(shares(text_measures(docs.select("text", "lang", "source")).drop("text"))))
    held = docs.select("text", "lang", "source", *[F.col(c).alias(f"_own{i}") for i, c in enumerate(own)])
    measured = judge(shares(text_measures(held)), found)
    return measured.filter("kept").select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(own)])
