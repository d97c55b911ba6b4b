"""Secret scans: fixed patterns, and windows of high entropy in candidate strings. DataFrame functions only.

Patterns give base spans. Beside them, every run of token characters is a candidate: a window slides over it, character counts and
their entropy sum are updated by the character that enters and the one that leaves, and the run from the first to the last window at
or above the limit of its character class, without base spans, becomes spans, unless the allow-list knows the candidate or the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their fixed order: pattern, group whose length counts, least length, and a cheap test that any match must pass.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What a text must contain for the kind to be looked for at all; never narrower than the pattern with its least length.
HINTS = {"assign": KINDS["assign"][0], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
NAMES = (*KINDS, "entropy")

#: Width of the sliding window in characters, and the entropy in bits that makes a window of a class suspicious.
WINDOW = 20
LIMITS = {"letters": 3.7, "hex": 2.9, "alnum": 3.5, "base64": 3.7}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: A word with capitals where words have them, or a number; longer than any word: not one. Every repeated group is possessive: Java then
#: loops over its repetitions, where it would else nest one call per repetition. Nothing is lost, as no shorter match of a part could go on.
_NEXT = r"(?:[A-Z][a-z]{2,24}|As|At|By|Id|If|In|Is|Of|On|Or|To|Up)"
_WORD = rf"(?:[A-Z]?[a-z]{{1,24}}+{_NEXT}*+|[A-Z]{{1,24}}+|[0-9]++)"
#: Words and numbers joined by separators.
JOINED = rf"^{_WORD}?+(?:[+/_=-]++{_WORD}?+)++$"
#: Candidates that are left alone: words and numbers joined by separators or by capitals, numbers, UUIDs, one character repeated.
ALLOWED = (
    JOINED,
    rf"^[A-Z]?[a-z]{{1,24}}+{_NEXT}++$",
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(.)\1*+$",
)
#: Documented examples say so inside a part that is not a plain word; such a run is left alone.
EXAMPLE = r"(?<![A-Za-z0-9])(?!(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]*(?![A-Za-z0-9]))[A-Za-z0-9]*(?i:example)"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def located(text: Column, pattern: str, group: int, keep, kind: int) -> Column:
    """Spans (start, kind, end; code points, end exclusive) of the leftmost non-overlapping matches whose group passes `keep`."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    none = F.array().cast(SPAN)

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["all"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        found = F.when(F.coalesce(keep(part["value"]), F.lit(False)), F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), found.cast(SPAN).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def entropy_run(value: Column, limit: Column) -> Column:
    """(first, last) code point of the windows of `value` at or above `limit` bits, end exclusive; null if there is none.

    The state is one count per ASCII character and the sum of c * log2(c); a step adds the entering and takes the leaving one. The limit
    is part of the state, so that it is found once and not per character.
    """
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    state = "struct<counts:array<int>,total:double,first:int,last:int,limit:double>"

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def step(acc: Column, e: Column) -> Column:
        enter, leave, end = e["enter"], e["leave"], e["end"]
        c_in = F.get(acc["counts"], enter)
        grown = acc["total"] + weight(c_in + 1) - weight(c_in)
        c_out = F.get(acc["counts"], leave) + F.when(leave == enter, F.lit(1)).otherwise(F.lit(0))
        total = F.when(leave.isNull(), grown).otherwise(grown - weight(c_out) + weight(c_out - 1))
        counts = F.transform(
            acc["counts"],
            lambda c, k: c + F.when(k == enter, F.lit(1)).otherwise(F.lit(0)) - F.when(k == leave, F.lit(1)).otherwise(F.lit(0)),
        )
        hot = (end >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - total / WINDOW >= acc["limit"])
        first = F.when(acc["first"].isNull() & hot, end - WINDOW).otherwise(acc["first"])
        last = F.when(hot, end).otherwise(acc["last"])
        new = [counts.alias("counts"), total.alias("total"), first.alias("first"), last.alias("last"), acc["limit"].alias("limit")]
        return F.struct(*new).cast(state)

    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(None).alias("first"), F.lit(None).alias("last"),
        limit.alias("limit"),
    ).cast(state)
    # Each code beside the one that it pushes out, and its end. Two arrays side by side: a look into `codes` would build it per character.
    gone = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), codes), F.lit(1), F.length(value))
    beside = F.zip_with(codes, gone, lambda enter, leave: F.struct(enter.alias("enter"), leave.alias("leave")))
    steps = F.transform(beside, lambda x, i: F.struct(x["enter"].alias("enter"), x["leave"].alias("leave"), (i + 1).alias("end")))
    return F.aggregate(steps, start, step, lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("a"), acc["last"].alias("b"))))


def class_limit(value: Column) -> Column:
    return (
        F.when(F.regexp_like(value, F.lit(r"^[0-9a-fA-F]+$")), F.lit(LIMITS["hex"]))
        .when(~F.regexp_like(value, F.lit(r"[0-9]")), F.lit(LIMITS["letters"]))
        .when(F.regexp_like(value, F.lit(r"^[0-9A-Za-z]+$")), F.lit(LIMITS["alnum"]))
        .otherwise(F.lit(LIMITS["base64"]))
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with _base and _spans: arrays of (start, kind, end), _spans by start, kind; null and empty texts have none.

    A text's work is in its row: no shuffle. Candidates of any length are scanned whole. Of the input only the column text is read;
    columns that start with an underscore are replaced, so callers pass their own columns under one other name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPAN)
    base = [
        F.when(F.regexp_like(text, F.lit(HINTS[name])), located(text, pattern, group, lambda v, n=least: F.length(v) >= n, k)).otherwise(none)
        for k, (name, (pattern, group, least)) in enumerate(KINDS.items())
    ]
    rows = docs.withColumn("_base", F.concat(*base))
    allowed = F.lit(False)

    def is_candidate(v: Column) -> Column:
        known = allowed
        for pattern in ALLOWED:
            known = known | F.regexp_like(v, F.lit(pattern))
        return ~known

    has = F.regexp_like(text, F.lit(CANDIDATE))
    rows = rows.withColumn("_cand", F.when(has, located(text, CANDIDATE, 0, is_candidate, len(KINDS))).otherwise(none))
    rows = rows.withColumn("_value", F.transform("_cand", lambda c: F.substring(text, c["start"] + 1, c["end"] - c["start"])))
    rows = rows.withColumn("_run", F.transform("_value", lambda v: entropy_run(v, class_limit(v))))
    runs = F.transform(
        F.filter(F.arrays_zip(F.col("_cand").alias("c"), F.col("_run").alias("r")), lambda z: z["r"].isNotNull()),
        lambda z: F.struct(
            (z["c"]["start"] + z["r"]["a"]).alias("start"), z["c"]["kind"].alias("kind"), (z["c"]["start"] + z["r"]["b"]).alias("end")
        ),
    ).cast(SPAN)

    def said(x: Column) -> Column:
        return F.substring(text, x["start"] + 1, x["end"] - x["start"])

    runs = F.filter(runs, lambda x: ~F.regexp_like(said(x), F.lit(EXAMPLE)))

    def piece(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end"))).cast(SPAN)

    def outside(x: Column) -> Column:
        """What base spans leave of a run, without pieces of plain words or separators."""

        def step(acc: Column, b: Column) -> Column:
            meets = (b["start"] < x["end"]) & (acc["at"] < b["end"])
            out = F.when(meets & (acc["at"] < b["start"]), F.concat(acc["out"], piece(acc["at"], b["start"]))).otherwise(acc["out"])
            return F.struct(F.when(meets, b["end"]).otherwise(acc["at"]).alias("at"), out.alias("out"))

        def rest(acc: Column) -> Column:
            return F.when(acc["at"] < x["end"], F.concat(acc["out"], piece(acc["at"], x["end"]))).otherwise(acc["out"])

        pieces = F.aggregate(F.sort_array("_base"), F.struct(x["start"].alias("at"), none.alias("out")), step, rest)
        meets_any = F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        known = rf"^{_WORD}$|{JOINED}"
        return F.when(meets_any, F.filter(pieces, lambda q: ~F.regexp_like(said(q), F.lit(known)))).otherwise(F.array(x).cast(SPAN))

    rows = rows.withColumn("_run", F.when(F.size("_cand") > 0, runs).otherwise(none))
    added = F.when(F.size("_run") > 0, F.flatten(F.transform("_run", outside))).otherwise(none)
    return rows.withColumn("_spans", F.sort_array(F.concat("_base", added))).drop("_cand", "_value", "_run")


def spelled(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; one row per input row."""
    rows = find_secrets(docs.select("doc_id", "text")).withColumn("_base", F.sort_array("_base"))

    def number_of(k: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")

    counts = [number_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(spelled("_base").cast("binary"), 256).alias("base_sha256"), spelled("_spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of `text` replaced by `mark`; overlapping spans become one mark. Null texts stay null."""
    rows = find_secrets(docs.select(F.struct("*").alias("row"), "text"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    cleaned = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    clean = F.when(F.size("_spans") > 0, cleaned).otherwise(text)
    return rows.select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def redact_documents(docs: DataFrame) -> DataFrame:
    """`redact` for a documents table: n_chars follows the new text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
