"""Column expressions whose NULL and date rules differ from Spark's defaults."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import APPROVED, IN_PERSON, IN_PERSON_PRODUCTS, ONLINE, ONLINE_PRODUCTS, OTHER

HASH_BITS = 60


def sum_or_zero(value: Column) -> Column:
    """Sum that skips NULL and is 0 when there is nothing to add."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def sum_or_null(value: Column) -> Column:
    """Sum that is NULL as soon as one value is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def weekday_number(day: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(day) + 1


def channel(product: Column) -> Column:
    return (
        F.when(product.isin(IN_PERSON_PRODUCTS), IN_PERSON)
        .when(product.isin(ONLINE_PRODUCTS), ONLINE)
        .otherwise(OTHER)
    )


def is_approved(status: Column) -> Column:
    """1 or 0; NULL for an unknown status."""
    return F.when(status.isNotNull(), (status == APPROVED).cast("long"))


def lossless_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def day_after(day: dt.date) -> Column:
    """Midnight after `day`, as a timestamp without zone: keeps date filters on the stored column."""
    return F.lit(dt.datetime.combine(day + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")


def hash_key(key: Column, seed: int, salt: str | Column = "") -> Column:
    """A uniform 60-bit integer that depends only on key, seed and salt, so any engine can reproduce it."""
    end = F.concat(F.lit(str(seed)), salt) if isinstance(salt, Column) else F.lit(f"{seed}{salt}")
    text = F.concat_ws(":", key.cast("string"), end)
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")
