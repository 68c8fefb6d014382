"""Text forms of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(at: Column) -> Column:
    """ISO time in UTC with offset; microseconds only when there are any."""
    fraction = F.when(
        F.pmod(F.unix_micros(at), F.lit(1000000)) != 0, F.date_format(at, ".SSSSSS")
    ).otherwise("")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
