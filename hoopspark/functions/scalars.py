"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CLOCK_PATTERN = r"^PT(\d+)M([\d.]+)S"
MINUTES_PATTERN = r"^PT(\d+)M"
REGULATION_SECONDS = 720
OVERTIME_SECONDS = 300


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(x, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to the even neighbour."""
    scale = float(10**digits)
    return F.rint(col(x) * F.lit(scale)) / F.lit(scale)


def exact_ratio(numerator, denominator, digits: int) -> Column:
    """Quotient of two whole numbers rounded to ``digits`` decimals, ties to the even neighbour, decided on integers: the
    last bit of a floating sum never picks the side. Null where the denominator is 0 or null."""
    top, base = (col(c).cast("bigint") for c in (numerator, denominator))
    base = F.nullif(base, F.lit(0).cast("bigint"))
    scaled, size = F.abs(top) * 10**digits, F.abs(base)
    whole = F.call_function("div", scaled, size)
    twice = 2 * F.pmod(scaled, size)
    up = F.when((twice > size) | ((twice == size) & (F.pmod(whole, F.lit(2)) == 1)), 1).otherwise(0)
    return F.signum(top) * F.signum(base) * (whole + up) / F.lit(float(10**digits))


def ratio(numerator, denominator) -> Column:
    """Quotient in doubles, null where the denominator is 0 or null."""
    return col(numerator).cast("double") / F.nullif(col(denominator).cast("double"), F.lit(0.0))


def ratio_or(numerator, denominator, default: float) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(default))


def zero_if_null(c) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def clip(x, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col(x)))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def clean_number(c) -> Column:
    """Number or null: bad text, NaN and infinities become null."""
    value = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def safe_int(c, default: int = -1) -> Column:
    """Whole number towards zero, or ``default`` for null, NaN, infinite and uncastable values."""
    value = clean_number(c)
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    return F.coalesce(whole.cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(c, default: float = 0.0) -> Column:
    return F.coalesce(clean_number(c), F.lit(default))


def clock_seconds(c) -> Column:
    """``PT11M34.50S`` → seconds left in the period; null for other text."""
    text = col(c)
    seconds = F.regexp_extract(text, CLOCK_PATTERN, 1).try_cast("double") * 60 + F.regexp_extract(
        text, CLOCK_PATTERN, 2
    ).try_cast("double")
    return F.when(text.rlike(CLOCK_PATTERN), seconds)


def clock_minutes(c) -> Column:
    """Whole minutes of ``PT12M...``; 0 for other text."""
    return F.coalesce(F.regexp_extract(col(c), MINUTES_PATTERN, 1).try_cast("int"), F.lit(0))


def period_seconds(period) -> Column:
    return F.when(col(period) <= 4, F.lit(REGULATION_SECONDS)).otherwise(F.lit(OVERTIME_SECONDS)).cast("double")


def log_minutes(c) -> Column:
    """Decimal minutes or ``MM:SS`` text → minutes; 0 for null or bad text."""
    text = F.trim(col(c).cast("string"))
    parts = F.split(text, ":")
    mmss = F.try_element_at(parts, F.lit(1)).try_cast("int") + F.try_element_at(parts, F.lit(2)).try_cast("int") / 60.0
    value = F.when(F.instr(text, ":") > 0, mmss).otherwise(text.try_cast("double"))
    return F.coalesce(value, F.lit(0.0))


def clock_label(seconds) -> Column:
    """Seconds → ``m:ss``."""
    whole = F.coalesce(col(seconds), F.lit(0)).cast("int")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), (whole % 60).cast("int"))


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


def _latin_map() -> tuple[str, str]:
    """Accented letters with a one-letter ASCII base, worked out from the Unicode tables."""
    ranges = [(0x00A0, 0x0250), (0x1E00, 0x1F00)]
    pairs = [(chr(p), _fold(chr(p))) for lo, hi in ranges for p in range(lo, hi)]
    pairs = [(c, f) for c, f in pairs if len(f) == 1]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


_ACCENTED, _PLAIN = _latin_map()


def normal_name(c) -> Column:
    """Lower-case ASCII form of a name, inside the JVM.

    Equals :func:`normal_name_exact` on Latin letters with one-letter bases; compatibility forms that expand
    to several letters (ligatures and the like) are dropped here and spelled out there.
    """
    plain = F.translate(col(c), _ACCENTED, _PLAIN)
    return F.trim(F.lower(F.regexp_replace(plain, r"[^\x00-\x7F]", "")))


@F.pandas_udf(StringType())
def normal_name_exact(names: pd.Series) -> pd.Series:
    """Full compatibility decomposition, in Arrow batches."""
    folded = names.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
    return folded.str.lower().str.strip(" ")
