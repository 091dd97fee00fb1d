"""Wide telemetry: one column per car and parameter, discovered from the header."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.functions.columns import positive_reading, unless_invalid

# Header pattern, and per role the word sets of which one must occur whole in the parameter name.
CAR_HEADER = re.compile(r"^Car (\d{2}) - (.+)$")
ROLES: dict[str, tuple[tuple[str, ...], ...]] = {
    "t_in": (("indoor", "temp"), ("cabin", "temp", "detected")),
    "t_out": (("outdoor", "temp"), ("outside", "temp"), ("fresh air", "temp")),
    "t_set_cool": (("control temp", "cool"),),
    "t_set_heat": (("control temp", "heat"),),
    "mode_run": (("running mode",),),
    "mode_set": (("setting mode",), ("control mode",)),
    "load_halved": (("load halved",), ("load shedding",)),
    "info_valid": (("information valid",),),
    "p_high_1": (("system 1", "high pressure"),),
    "p_high_2": (("system 2", "high pressure"),),
    "p_low_1": (("system 1", "low pressure"),),
    "p_low_2": (("system 2", "low pressure"),),
}
EXACT_NAMES = {"t_set_cool": "target temperature value"}
NUMERIC_ROLES = ("t_in", "t_out", "t_set_cool", "t_set_heat", "p_high_1", "p_high_2", "p_low_1", "p_low_2")
MASKED_ROLES = ("t_in", "t_out", "t_set_cool")


def _matches(role: str, name: str) -> bool:
    low = name.lower()
    return EXACT_NAMES.get(role) == low or any(all(w in low for w in words) for words in ROLES[role])


def header_roles(columns: Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """Car ids and the first parameter of the header that fits each role."""
    found = [m.groups() for m in map(CAR_HEADER.match, columns) if m]
    cars = sorted({car for car, _ in found})
    parameters = list(dict.fromkeys(p for _, p in found))
    first = {role: next((p for p in parameters if _matches(role, p)), None) for role in ROLES}
    return cars, {role: p for role, p in first.items() if p is not None}


def time_column(columns: Sequence[str]) -> str:
    return next((c for c in columns if c.strip().lower() == "time"), columns[1])


def melt(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per input row and car with a column per role. The cars are an array of structs exploded in place, so
    the reshaping needs no shuffle."""
    cars, roles = header_roles(wide.columns)
    if not cars:
        raise ValueError("no 'Car NN - parameter' columns in the header")
    present = set(wide.columns)

    def reading(car: str, role: str):
        name = f"Car {car} - {roles[role]}"
        value = F.col(f"`{name}`").cast("string") if name in present else F.lit(None).cast("string")
        return value.alias(role)

    per_car = F.array(*[F.struct(F.lit(car).alias("car"), *[reading(car, r) for r in roles]) for car in cars])
    return clean(wide.select(*ids, F.inline(per_car)))


def clean(long: DataFrame) -> DataFrame:
    """Numbers where numbers belong (text and values ≤ 0 are invalid), trimmed texts, readings flagged invalid removed."""
    out = long
    for c in long.columns:
        if c in NUMERIC_ROLES:
            out = out.withColumn(c, positive_reading(c))
        elif c in ROLES:
            out = out.withColumn(c, F.trim(c))
    if "info_valid" in long.columns:
        for c in MASKED_ROLES:
            if c in long.columns:
                out = out.withColumn(c, unless_invalid(c, "info_valid"))
    return out


def resolve_roles(parameters: DataFrame, name: str, position: str, rules: Mapping[str, Sequence[Sequence[str]]]) -> DataFrame:
    """Role resolution over a table of parameter names: per role the matching name with the lowest position."""
    low = F.lower(F.col(name))

    def fits(words_sets):
        hit = F.lit(False)
        for words in words_sets:
            every = F.lit(True)
            for w in words:
                every = every & low.contains(w)
            hit = hit | every
        return hit

    hits = F.filter(
        F.array(*[F.when(fits(ws), F.lit(role)) for role, ws in rules.items()]), lambda r: r.isNotNull())
    return parameters.select(name, position, F.explode(hits).alias("role")).groupBy("role").agg(
        F.min_by(name, position).alias(name), F.min(position).alias(position))
