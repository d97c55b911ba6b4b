"""Bar and track tables of a text, and checks on token sequences.

A text or a bar list is one row, so these are array expressions; only vocabulary checks join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.constants import BARS_PER_SECTION, DEFAULT_PROMPT_WORDS
from notewright.functions.tokens import words

#: Words whose verdicts are broadcast.
FREQUENT = 1000


def strip_track_end(text: Column) -> Column:
    return F.regexp_replace(text, r"TRACK_END\s*$", "")


def bars_of_track(text: Column) -> Column:
    """Items of a track text: the header first, then one item per bar."""
    parts = F.filter(F.split(strip_track_end(text), "BAR_START "), lambda p: p != "")
    return F.transform(
        parts, lambda p: F.when(F.contains(p, F.lit("TRACK_START")), p).otherwise(F.concat(F.lit("BAR_START "), p))
    )


def tracks_of_piece(text: Column) -> Column:
    """Track texts of a piece text, each closed by exactly one TRACK_END."""
    parts = F.split(text, "TRACK_START ")
    return F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.concat(F.lit("TRACK_START "), strip_track_end(p), F.lit("TRACK_END ")),
    )


def last_track(text: Column) -> Column:
    tracks = tracks_of_piece(text)
    return F.get(tracks, F.size(tracks) - 1)


def track_text(bars: Column) -> Column:
    return F.concat(F.array_join(bars, ""), F.lit("TRACK_END "))


def piece_text(tracks: Column) -> Column:
    return F.concat(F.lit("PIECE_START "), F.array_join(tracks, ""))


def new_text(prompt: Column, full: Column) -> Column:
    """What follows the prompt."""
    return F.substr(full, F.length(prompt) + 1)


def last_bar(text: Column) -> Column:
    parts = F.split(text, "BAR_START ")
    return F.concat(F.lit("BAR_START "), strip_track_end(F.get(parts, F.size(parts) - 1)))


def bar_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w == "BAR_END"))


def forced_length(prompt: Column, generated: Column, n: int) -> Column:
    """(text, ok): cut to n bars when longer; a shorter text stays and is not ok."""
    count = bar_count(generated)
    kept = F.transform(F.slice(F.split(generated, "BAR_END "), 1, n), lambda p: F.concat(p, F.lit("BAR_END ")))
    cut = F.concat(prompt, F.array_join(kept, ""), F.lit("TRACK_END "))
    text = F.when(count > n, cut).otherwise(F.concat(prompt, generated))
    return F.struct(text.alias("text"), (count >= n).alias("ok"))


def within_budget(text: Column, key: Column, n_words: int = DEFAULT_PROMPT_WORDS, seed: int = 42) -> Column:
    """A prompt that reaches ``n_words`` words loses one track, chosen by a repeatable hash of ``key``."""
    tracks = tracks_of_piece(text)
    hashed = F.transform(
        tracks,
        lambda t, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key, i.cast("string"))).alias("h"), i.alias("i")),
    )
    dropped = F.array_min(hashed)["i"]
    return F.when(F.size(F.split(text, " ")) < n_words, text).otherwise(
        piece_text(F.filter(tracks, lambda t, i: i != dropped))
    )


def last_bars(bars: Column, n: int = BARS_PER_SECTION) -> Column:
    """Header plus the last n-1 bars; the header is never taken twice."""
    start = F.greatest(F.size(bars) - n + 2, F.lit(2))
    return F.concat(F.slice(bars, 1, 1), F.slice(bars, start, F.lit(n - 1)))


def neighbours(texts: DataFrame, key: str) -> DataFrame:
    """One row per word with the word after it."""
    listed = texts.select(key, F.split("text", " ").alias("words"))
    pairs = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get("words", i + 1).alias("next_word")))
    return listed.select(key, F.posexplode(pairs).alias("pos", "pair")).select(key, "pos", "pair.word", "pair.next_word")


def _context(all_words: Column, position: Column, before: int, after: int) -> Column:
    start = F.greatest(position - before, F.lit(0))
    return F.array_join(F.slice(all_words, start + 1, position + after - start), " ")


def _hits(listed: DataFrame, key: str, test: Callable[[Column, Column], Column], around: int) -> DataFrame:
    """Position, word and context of the words that pass; only these leave the row."""

    def hit(w: Column, i: Column) -> Column:
        return F.when(test(w, i), F.struct(i.alias("pos"), w.alias("word"), _context(F.col("words"), i, around, around).alias("context")))

    found = F.filter(F.transform("words", hit), lambda h: h.isNotNull())
    return listed.select(key, F.explode(found).alias("hit")).select(key, "hit.pos", "hit.word", "hit.context")


def repeated_words(texts: DataFrame, key: str) -> DataFrame:
    """Words equal to the next word, with a little context."""
    listed = texts.select(key, F.split("text", " ").alias("words"))
    return _hits(listed, key, lambda w, i: w == F.get("words", i + 1), 3)


def unknown_words(texts: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """Words outside the vocabulary (and [UNK]) with position and context.

    The distinct words of a text are checked; only texts with unknown words are read again. The FREQUENT words of most texts are judged
    once and their verdicts broadcast; any other word is in at most one FREQUENT-th of all pairs of text and word, so no key of the
    anti-join that judges the others is larger.
    """
    distinct = texts.select(key, F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    known = vocabulary.where("word <> '[UNK]'").select("word")
    counts = distinct.groupBy("word").agg(F.count("*").alias("n"))
    frequent = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word")
    judged = frequent.join(known.select("word", F.lit(True).alias("is_known")), "word", "left")
    judged = judged.select(F.col("word").alias("_frequent"), F.coalesce("is_known", F.lit(False)).alias("_known"))
    met = distinct.join(F.broadcast(judged), F.col("word") == F.col("_frequent"), "left")
    rare = met.where("_known IS NULL").select(key, "word").join(known, "word", "left_anti")
    missing = met.where("NOT _known").select(key, "word").unionByName(rare.select(key, "word"))
    per_text = missing.groupBy(key).agg(F.collect_set("word").alias("unknown"))
    listed = texts.select(key, F.split("text", " ").alias("words")).join(per_text, key)
    return _hits(listed, key, lambda w, i: F.array_contains("unknown", w), 5)


def missing_instruments(prompts: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Prompt instruments that the vocabulary lacks, with the ones it has."""
    known = vocabulary.where(F.col("word").startswith("INST"))
    available = known.agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("word", "=", -1))), ", "))
    wanted = prompts.select(column).distinct().withColumn("word", F.concat(F.lit("INST="), F.col(column)))
    return wanted.join(known, "word", "left_anti").select(column, available.scalar().alias("available"))


def compared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two texts per key: equal, of equal length, and the number of words that differ when note pitches are ignored."""

    def simple(word: Column) -> Column:
        return F.when(F.contains(word, F.lit("NOTE")), F.substring_index(word, "=", 1)).otherwise(word)

    both = left.select(key, F.split("text", " ").alias("a")).join(right.select(key, F.split("text", " ").alias("b")), key)
    differing = F.size(F.filter(F.arrays_zip("a", "b"), lambda p: simple(p["a"]) != simple(p["b"])))
    same = F.size("a") == F.size("b")
    return both.select(
        key, (F.col("a") == F.col("b")).alias("equal"), same.alias("same_length"),
        F.when(same, differing).alias("n_different"),
    )


def append_track(state: DataFrame, track: DataFrame) -> DataFrame:
    return state.unionByName(track)


def delete_track(state: DataFrame, track_id: int) -> DataFrame:
    return state.where(F.col("track_id") != track_id)


def track_bars(state: DataFrame, track_id: int) -> DataFrame:
    return state.where(F.col("track_id") == track_id).select("piece_id", "bars")


def reset_temperature(state: DataFrame, track_id: int, temperature: float) -> DataFrame:
    changed = F.when(F.col("track_id") == track_id, F.lit(temperature)).otherwise(F.col("temperature"))
    return state.withColumn("temperature", changed)
