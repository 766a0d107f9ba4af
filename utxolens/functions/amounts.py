"""Money and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOVELACE_PER_ADA = 1_000_000
MICROS_PER_DAY = 86_400_000_000


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ada(value: Column | str) -> Column:
    """Lovelace to ADA as a double."""
    return _col(value).cast("double") / F.lit(LOVELACE_PER_ADA)


def wide_sum(value: Column | str) -> Column:
    """Sum that cannot overflow 64 bits half way through."""
    return F.sum(_col(value).cast("decimal(38,0)"))


def long_sum(value: Column | str) -> Column:
    """Wide sum handed back as a 64-bit number; too large a total is an error."""
    return wide_sum(value).cast("long")


def ada_sum(value: Column | str) -> Column:
    """Sum in lovelace, divided once at the end."""
    return wide_sum(value).cast("double") / F.lit(LOVELACE_PER_ADA)


def day_text(micros: Column | str) -> Column:
    """Epoch microseconds to ``yyyy-MM-dd`` in UTC, whatever the session zone."""
    days = F.floor(_col(micros) / F.lit(MICROS_PER_DAY)).cast("int")
    return F.date_from_unix_date(days).cast("string")


def token_text(name: Column | str) -> Column:
    """Token name without its two-character ``\\x`` prefix."""
    name = _col(name)
    return F.substring(name, 3, 2_147_483_647)
