"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def elapsed_us(text: Column | str) -> Column:
    """``"<d> days [+]HH:MM:SS[.ffffff]"`` to microseconds, anything else to null.

    A negative duration prints its days negative and its clock part positive,
    so the two parts are read separately and added.
    """
    pattern = r"^\s*(-?\d+) days?(?: \+?(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?)?\s*$"
    source = col(text)

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(source, pattern, i).try_cast("bigint"), F.lit(0))

    micros = F.rpad(F.regexp_extract(source, pattern, 5), 6, "0").substr(1, 6).try_cast("bigint")
    total = (
        part(1) * F.lit(DAY_US)
        + (part(2) * 3600 + part(3) * 60 + part(4)) * F.lit(1_000_000)
        + F.coalesce(micros, F.lit(0))
    )
    return F.when(F.coalesce(source.rlike(pattern), F.lit(False)), total)


def strict_bool(c: Column | str, accept=("true", "1")) -> Column:
    """Boolean that may have arrived as text; null counts as false."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*accept), F.lit(False))


def coerce_int(c: Column | str) -> Column:
    """Nullable integer: text that is no whole number becomes null, as does NaN."""
    number = coerce_double(c)
    return F.when(number == F.floor(number), number).try_cast("int")


def coerce_double(c: Column | str) -> Column:
    number = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def has_text(c: Column | str) -> Column:
    return F.trim(F.coalesce(col(c), F.lit(""))) != ""


def truth(c: Column) -> Column:
    """Comparison with a missing operand counts as false."""
    return F.coalesce(c, F.lit(False))


def all_true(c: Column) -> Column:
    """Aggregate AND; true for no rows, and null rows count as false."""
    return F.coalesce(F.bool_and(truth(c)), F.lit(True))


def count_where(c: Column) -> Column:
    return F.count_if(truth(c))


def share(num: Column, den: Column) -> Column:
    """num / den as double, null when den is 0."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def zero_share(num: Column, den: Column) -> Column:
    return F.coalesce(share(num, den), F.lit(0.0))


def seeded_key(c: Column | str, seed: int | str) -> Column:
    """Reproducible random order of ids: hex digest of id and seed."""
    return F.md5(F.concat(col(c).cast("string"), F.lit(f"-{seed}")))


def bucket_of(t: Column | str, width: int) -> Column:
    """Index of the half-open interval of ``width`` that holds ``t``."""
    return F.floor(col(t) / F.lit(width)).cast("bigint") if width else F.lit(0).cast("bigint")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail with the sorted missing names; reads metadata only."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
