"""Instants from the spellings that occur in logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = r"^\d{10}(\.\d{1,6})?$"
_MILLIS = r"^\d{13}$"
_ISO = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:?\d\d)?$"
_ZONED = r"(Z|[+-]\d\d:?\d\d)$"


def instant_us(ts: Column) -> Column:
    """Epoch microseconds of a text; null where it names no instant.

    Accepted: ISO 8601 with T or blank, up to 6 decimals, Z, an offset with or without colon or no zone (UTC);
    epoch seconds of 10 digits, perhaps with decimals; epoch milliseconds of 13 digits. Blanks around are ignored.
    Stays inside generated code: no UDF.
    """
    t = F.trim(ts)
    zone = F.regexp_extract(t, r"([+-]\d\d)(\d\d)$", 0)
    with_colon = F.when(F.length(zone) == 5, F.concat(F.substring(t, F.lit(1), F.length(t) - 2), F.lit(":"), F.right(t, F.lit(2)))).otherwise(t)
    zoned = F.when(t.rlike(_ZONED), with_colon).otherwise(F.concat(t, F.lit("Z")))
    return (
        F.when(t.rlike(_ISO), F.unix_micros(zoned.try_cast("timestamp")))
        .when(t.rlike(_SECONDS), (t.try_cast("decimal(20,6)") * 1_000_000).cast("long"))
        .when(t.rlike(_MILLIS), t.try_cast("long") * 1000)
    )
