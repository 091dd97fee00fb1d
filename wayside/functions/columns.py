"""Column expressions shared by the operators. Everything here stays inside generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round for publication; adding zero turns a negative zero into zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone is UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def seconds(us: str | Column) -> Column:
    return col(us) / F.lit(1_000_000.0)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def finite(c: str | Column) -> Column:
    """NULL for NaN and infinities: a missing reading is absent, not a number."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def positive_reading(c: str | Column) -> Column:
    """Numeric value of a reading; text and values at or below zero are invalid."""
    x = col(c).try_cast("double")
    return F.when(x > 0, x)


def unless_invalid(c: str | Column, flag: str | Column) -> Column:
    return F.when(F.coalesce(F.lower(F.trim(col(flag))) == "invalid", F.lit(False)), None).otherwise(col(c))


def is_cooling(mode: str | Column) -> Column:
    m = F.lower(col(mode))
    return F.coalesce(m.contains("cool") & ~m.contains("stop"), F.lit(False))


def is_full_cooling(mode: str | Column) -> Column:
    return F.coalesce(F.lower(col(mode)).contains("full cool"), F.lit(False))


# --- native timestamps: 'Y-M-D-h-m-s-ms', no field zero padded -----------------------------------


def parse_native_ts(c: str | Column) -> Column:
    """Milliseconds are a count, so token 5 means 5 ms. Anything else is left to the timestamp cast."""
    text = col(c)
    part = F.split(text, "-")
    second = part[5].cast("decimal(18,6)") + part[6].cast("decimal(18,6)") / 1000
    native = F.make_timestamp(
        part[0].cast("int"), part[1].cast("int"), part[2].cast("int"), part[3].cast("int"), part[4].cast("int"),
        second.cast("decimal(8,6)"),
    )
    return F.when(text.rlike(r"^\d+(-\d+){6}$"), native).otherwise(text.try_cast("timestamp"))


def format_native_ts(c: str | Column) -> Column:
    t = col(c).cast("timestamp")
    milli = F.floor((F.unix_micros(t) % F.lit(1_000_000)) / 1000).cast("long")
    parts = [F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t), milli]
    return F.concat_ws("-", *[p.cast("string") for p in parts])


def natural_key(c: str | Column) -> Column:
    """Sort key in which every run of digits compares as a number, however long: its length without leading zeros comes
    before its digits. The text itself follows, so different names have different keys."""
    text = col(c)

    def number(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.concat(F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), number(r)).otherwise(r)), ""), F.lit("\u0000"), text)


# --- recording geometry ---------------------------------------------------------------------------


def channel_car(k: str | Column) -> Column:
    """Car index 0..7 of channel 0..63."""
    return F.floor(col(k) / 8).cast("int")


def channel_position(k: str | Column) -> Column:
    return (col(k) % 8 + 1).cast("int")


def channel_side(k: str | Column) -> Column:
    """Odd positions belong to side 1, even positions to side 2."""
    return (col(k) % 2 + 1).cast("int")


def swap_sides(channels: str | Column) -> Column:
    """Exchange the two channels of every position pair of a channel array."""
    a = col(channels)
    return F.transform(a, lambda x, i: F.element_at(a, (i + F.lit(1) - F.lit(2) * (i % 2) + F.lit(1)).cast("int")))


# Speed-bin edges (m/s), wheel teeth, edges per tooth, wheel diameter (m).
SPEED_EDGES = (0, 3, 6, 9, 12, 15, 30)
TEETH, EDGES_PER_TOOTH, WHEEL_DIAMETER = 90, 2, 0.85


def speed_bin(v: str | Column) -> Column:
    """Index of the speed interval, clipped to the first and last interval."""
    passed = [F.when(col(v) >= edge, 1).otherwise(0) for edge in SPEED_EDGES[1:-1]]
    return reduce(lambda a, b: a + b, passed).cast("int")


# --- decision rules on (p1, p2) -------------------------------------------------------------------


def decide(p1, p2, rule: str, tau=None, tau2=None, delta=None) -> Column:
    """Three-way label from the two side probabilities; parameters may be columns (sweeps) or numbers."""
    p1, p2 = col(p1), col(p2)
    param = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    if rule == "per_side":
        own, other = p1 - param(tau), p2 - param(tau2)
    else:
        own, other = p1, p2
    if rule == "global":
        flagged = F.greatest(p1, p2) >= param(tau)
    elif rule == "per_side":
        flagged = F.greatest(own, other) >= 0
    elif rule == "margin":
        flagged = (F.greatest(p1, p2) >= param(tau)) & (F.abs(p1 - p2) >= param(delta))
    else:
        raise ValueError(f"no rule is called {rule!r}: global, per_side or margin")
    return F.when(~flagged, "Normal").when(own >= other, "Side I").otherwise("Side II")
