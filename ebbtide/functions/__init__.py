from .columns import (  # noqa: F401
    channel, day_after, hash_key, is_approved, lossless_percent, sum_or_null, sum_or_zero, weekday_number,
)
