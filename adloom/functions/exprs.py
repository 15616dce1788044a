"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.columns import BUCKETS, HIGH, MEDIUM, UNKNOWN


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_label(c: Column | str) -> Column:
    """1 where the label is 1, else 0, nulls too."""
    return F.when(F.coalesce(_c(c), F.lit(0)) == 1, 1).otherwise(0)


def fill_numeric(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(0)).cast("int")


def fill_categorical(c: Column | str, trim: bool = False) -> Column:
    """`unknown` for null and empty values; with trim for blank ones too."""
    value = F.trim(_c(c)) if trim else _c(c)
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(UNKNOWN))


def missing_numeric(columns: list[str]) -> Column:
    return reduce(add, (_c(c).isNull().cast("int") for c in columns))


def missing_categorical(columns: list[str]) -> Column:
    return reduce(add, (F.coalesce(_c(c) == "", F.lit(True)).cast("int") for c in columns))


def event_batch(c: Column | str) -> Column:
    """The scale that a file name tells; the first that matches counts."""
    out = F.lit("full")
    for scale in ("5m", "1m", "100k"):
        out = F.when(_c(c).like(f"%{scale}%"), scale).otherwise(out)
    return out


def bucket_value(c: Column | str, values: list[Column]) -> Column:
    """Of values, one for each of BUCKETS, that of a number's bucket. Null counts as the last bucket."""
    value, out = _c(c), values[-1]
    for (_, _, _, low, high), own in reversed(list(zip(BUCKETS[:-1], values))):
        out = F.when(value < 0 if low is None else value.between(low, high), own).otherwise(out)
    return out


def bucket_code(c: Column | str) -> Column:
    """The code of a number's bucket. Null counts as the last bucket."""
    return bucket_value(c, [F.lit(b[0]) for b in BUCKETS])


def log_scale(c: Column | str) -> Column:
    return F.log1p(F.greatest(_c(c), F.lit(0)).cast("double"))


def ratio(part: Column | str, whole: Column | str, places: int = 6) -> Column:
    """part / whole, rounded; null where whole is null or zero."""
    return F.round(F.try_divide(_c(part).cast("double"), _c(whole).cast("double")), places)


def lift(ctr: Column | str, overall: Column | str) -> Column:
    """The difference of two rates."""
    return F.round(_c(ctr) - _c(overall), 6)


def volume_band(c: Column | str, high: int = HIGH, medium: int = MEDIUM) -> Column:
    return F.when(_c(c) >= high, "high").when(_c(c) >= medium, "medium").otherwise("low")


def delta(now: Column | str, before: Column | str, places: int = 6) -> Column:
    return F.round(_c(now) - _c(before), places)


def delta_ratio(now: Column | str, before: Column | str) -> Column:
    """The relative change; null where there is nothing to compare with."""
    return F.when(_c(before).isNotNull() & (_c(before) != 0), F.round((_c(now) - _c(before)) / _c(before), 6))


def duration_s(start: Column | str, end: Column | str, as_of: Column | None = None) -> Column:
    """Seconds from start to end, or to as_of where there is no end yet."""
    until = _c(end) if as_of is None else F.coalesce(_c(end), as_of)
    micros = F.unix_micros(until.cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return F.round(micros / 1e6, 3)


def fixed(c: Column | str, precision: int = 12, places: int = 6) -> Column:
    """A number as a decimal of fixed places, halves away from zero."""
    return _c(c).cast(f"decimal({precision},{places})")


def is_unknown(c: Column | str) -> Column:
    return _c(c) == UNKNOWN


def cents(c: Column | str, places: int = 6) -> Column:
    """A number held to fixed places, as a double."""
    return F.round(_c(c).cast("double"), places)
