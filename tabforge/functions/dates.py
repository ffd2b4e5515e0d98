"""Date expressions (X1, P5, P6, P12 helpers).

All are built-in column expressions, so they stay inside whole-stage
codegen.  ANSI mode stays on; parsing uses ``try_to_timestamp`` which gives
NULL instead of raising.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# strftime formats tried in order when a text column is parsed as a date
# (fixed values: the order decides which format wins).
COMMON_DATE_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d"]

_STRFTIME_TO_SPARK = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s",
                      "%y": "yy", "%b": "MMM", "%B": "MMMM"}


def spark_pattern(strftime: str) -> str:
    """Translate a strftime format to a Spark datetime pattern.

    ``%m``/``%d`` map to ``M``/``d`` so that, like ``strptime``, both
    ``2023-01-05`` and ``2023-1-5`` parse."""
    out, i = [], 0
    while i < len(strftime):
        tok = strftime[i:i + 2]
        if tok in _STRFTIME_TO_SPARK:
            out.append(_STRFTIME_TO_SPARK[tok])
            i += 2
        else:
            ch = strftime[i]
            out.append(f"'{ch}'" if ch.isalpha() else ch)
            i += 1
    return "".join(out)


def parse_date(c: Column | str, strftime: str | None = None) -> Column:
    """Text to DATE; NULL when the text does not fit the format."""
    col = F.col(c) if isinstance(c, str) else c
    if strftime is None:
        return F.to_date(F.try_to_timestamp(col))
    return F.to_date(F.try_to_timestamp(col, F.lit(spark_pattern(strftime))))


def parse_datetime(c: Column | str) -> Column:
    """Text to a timestamp without zone, time of day kept; NULL when it does
    not parse."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(col).cast("timestamp_ntz")


def strict_date_ok(c: Column | str, strftime: str = "%Y-%m-%d") -> Column:
    """True when the text parses with the format (NULL input -> NULL)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNull(), F.lit(None)).otherwise(parse_date(col, strftime).isNotNull())


def date_features(c: str = "date") -> dict[str, Column]:
    """Calendar parts with the small integer types of the silver layer.
    Day of week is Monday=0; week is the ISO week (2021-01-03 -> 53)."""
    d = F.col(c)
    return {
        "year": F.year(d).cast("smallint"),
        "month": F.month(d).cast("tinyint"),
        "day": F.dayofmonth(d).cast("tinyint"),
        "day_of_week": F.weekday(d).cast("tinyint"),
        "day_of_year": F.dayofyear(d).cast("smallint"),
        "week_of_year": F.weekofyear(d).cast("int"),
    }
