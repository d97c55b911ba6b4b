"""Token text: the grammar, time literals and scalar conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright.constants import UNITS_PER_BEAT, UNITS_PER_DELTA

# --- fixed values: token kind -> event type ---
KIND_TO_TYPE = {
    "PIECE_START": "Piece-Start",
    "TRACK_START": "Track-Start",
    "TRACK_END": "Track-End",
    "INST": "Instrument",
    "BAR_START": "Bar-Start",
    "BAR_END": "Bar-End",
    "TIME_SHIFT": "Time-Shift",
    "TIME_DELTA": "Time-Shift",
    "NOTE_ON": "Note-On",
    "NOTE_OFF": "Note-Off",
}
STRUCTURAL_TYPES = ["Piece-Start", "Track-Start", "Track-End", "Instrument", "Bar-Start", "Bar-End"]


def words(text: Column) -> Column:
    """Tokens of a text; runs of spaces leave no empty token."""
    return F.array_remove(F.split(text, " "), "")


def kind(token: Column) -> Column:
    return F.split(token, "=")[0]


def value(token: Column) -> Column:
    """Part after the first '='; null when there is none."""
    return F.try_element_at(F.split(token, "="), F.lit(2))


def event_type(kind_name: Column) -> Column:
    """Event type of a token kind; null for kinds that are no event (density, unknown)."""
    cases = None
    for name, type_name in KIND_TO_TYPE.items():
        cases = (F if cases is None else cases).when(kind_name == name, type_name)
    return cases


def is_event(token: Column) -> Column:
    """True for tokens that are events (bare kinds, or KIND=value)."""
    valued = ("INST=", "TIME_SHIFT=", "TIME_DELTA=", "NOTE_ON=", "NOTE_OFF=")
    result = token.isin([k for k in KIND_TO_TYPE])
    for prefix in valued:
        result = token.startswith(prefix) | result
    return result


def int_list(text: Column) -> Column:
    """Dotted ints as an array."""
    return F.transform(F.split(text, r"\."), lambda p: p.cast("int"))


def literal_units(literal: Column) -> Column:
    """Units of an ``int.dec.base`` literal."""
    part = int_list(literal)
    return (part[0] * UNITS_PER_BEAT + F.floor(part[1] * UNITS_PER_BEAT / part[2])).cast("int")


def literal_beats(literal: Column) -> Column:
    part = int_list(literal)
    return part[0] + part[1] / part[2]


def units_literal(units: Column) -> Column:
    whole = F.floor(units / UNITS_PER_BEAT)
    return F.concat_ws(".", whole.cast("string"), (units % UNITS_PER_BEAT).cast("string"), F.lit(str(UNITS_PER_BEAT)))


def beats_literal(beats: Column) -> Column:
    """Beats as ``int.dec.8``; finer parts are cut off."""
    return units_literal(F.floor(beats * UNITS_PER_BEAT))


def units_delta(units: Column) -> Column:
    """TIME_DELTA steps; half a step is cut off."""
    return F.floor(units / UNITS_PER_DELTA).cast("int")


def literal_delta(literal: Column) -> Column:
    return units_delta(literal_units(literal))


def delta_units(delta: Column) -> Column:
    return delta.cast("int") * UNITS_PER_DELTA


def delta_beats(delta: Column) -> Column:
    return delta_units(delta) / UNITS_PER_BEAT


def delta_literal(delta: Column) -> Column:
    return units_literal(delta_units(delta))


def add_literals(a: Column, b: Column) -> Column:
    return units_literal(literal_units(a) + literal_units(b))


def event_text(type_name: Column, event_value: Column) -> Column:
    """Token with trailing space for an event; types without a token give the empty string."""
    with_value = {"Density": "DENSITY=", "Note-On": "NOTE_ON=", "Note-Off": "NOTE_OFF="}
    plain = {v: k for k, v in KIND_TO_TYPE.items() if v not in ("Time-Shift", "Instrument", "Note-On", "Note-Off")}
    result = F.lit("")
    for name, token in plain.items():
        result = F.when(type_name == name, token + " ").otherwise(result)
    for name, token in with_value.items():
        result = F.when(type_name == name, F.concat(F.lit(token), event_value, F.lit(" "))).otherwise(result)
    instrument = F.when(F.lower(event_value) == "drums", "DRUMS").otherwise(event_value)
    result = F.when(type_name == "Instrument", F.concat(F.lit("INST="), instrument, F.lit(" "))).otherwise(result)
    delta = F.concat(F.lit("TIME_DELTA="), literal_delta(event_value).cast("string"), F.lit(" "))
    return F.when(type_name == "Time-Shift", delta).otherwise(result)


def event_value(kind_name: Column, token_value: Column) -> Column:
    """Event value of a token: deltas become time literals, the drum instrument its display form."""
    return (
        F.when(kind_name == "TIME_DELTA", delta_literal(token_value))
        .when((kind_name == "INST") & (token_value == "DRUMS"), "Drums")
        .otherwise(token_value)
    )


def first_index_with(items: Column, part: str) -> Column:
    """0-based index of the first item containing ``part``, -1 if none."""
    return F.array_position(F.transform(items, lambda x: F.contains(x, F.lit(part))), True) - 1


def list_average(values: Column) -> Column:
    """Mean of an array, null when it is empty."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(values))
