"""Time predicates and time rendering. All take an explicit clock, `as_of`."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

# fixed values: rendering patterns of the reports
DATE = "yyyy-MM-dd"
MINUTE = "yyyy-MM-dd HH:mm"
SECOND = "yyyy-MM-dd HH:mm:ss"
ISO = "yyyy-MM-dd'T'HH:mm:ss"
ISO_PARSE = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"

DAY_SECONDS = 86_400
SMALLEST_RANGE_DAYS = 0.01


def clock(as_of: str | datetime | Column) -> Column:
    """`as_of` as a timestamp; text keeps the session time zone out of Python's hands."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp")


def interval_days(days: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(round(days * DAY_SECONDS, 6)))


def ago(as_of, days: float) -> Column:
    return clock(as_of) - interval_days(days)


def bound(df: DataFrame, time_col: str, limit: Column) -> Column:
    """`limit` in the type of the column: a cast on the column would keep the filter from the scan."""
    untimed = isinstance(df.schema[time_col].dataType, TimestampNTZType)
    return limit.cast("timestamp_ntz") if untimed else limit


MONTHS_OF = "months_of"


def with_month_layout(df: DataFrame, time_col: str, month_col: str = "month") -> DataFrame:
    """Mark `month_col` as the month folder of `time_col`, so that time filters prune folders."""
    return df.withMetadata(month_col, {MONTHS_OF: time_col})


def _months(df: DataFrame, time_col: str, first: Column | None, last: Column | None = None) -> DataFrame:
    """Leave only the month folders from `first` to `last`, where the table has folders of this time."""
    for field in df.schema.fields:
        if field.metadata.get(MONTHS_OF) == time_col:
            month = lambda limit: F.date_trunc("month", limit).cast("date")
            df = df if first is None else df.filter(F.col(field.name) >= month(first))
            df = df if last is None else df.filter(F.col(field.name) <= month(last))
    return df


def since(df: DataFrame, time_col: str, days: float, as_of) -> DataFrame:
    """Rows younger than `days`. The bare column keeps the predicate pushable; old month folders aren't opened."""
    limit = ago(as_of, days)
    return _months(df, time_col, limit).filter(F.col(time_col) > bound(df, time_col, limit))


def between_periods(df: DataFrame, time_col: str, current_days: float, compare_days: float, as_of) -> DataFrame:
    """The period before the current one, both ends included."""
    first, last = ago(as_of, current_days + compare_days), ago(as_of, current_days)
    return _months(df, time_col, first, last).filter(F.col(time_col).between(bound(df, time_col, first), bound(df, time_col, last)))


def day_slice(df: DataFrame, time_col: str, start, days: float = 1) -> DataFrame:
    """`[start, start + days)`."""
    begin, end = clock(start), clock(start) + interval_days(days)
    return _months(df, time_col, begin, end).filter(
        (F.col(time_col) >= bound(df, time_col, begin)) & (F.col(time_col) < bound(df, time_col, end))
    )


def in_month_range(df: DataFrame, time_col: str, days: float, as_of, month_col: str = "month") -> DataFrame:
    """`since` on a month-partitioned table, with the companion predicate that prunes folders."""
    first = F.date_trunc("month", ago(as_of, days)).cast("date")
    return since(df.filter(F.col(month_col) >= first), time_col, days, as_of)


def to_days(value: float, unit: str) -> float:
    per_day = {"minutes": 24 * 60, "hours": 24, "days": 1}
    return value / per_day.get(unit, 1)


def range_days(start: datetime, end: datetime) -> float:
    return max((end - start).total_seconds() / DAY_SECONDS, SMALLEST_RANGE_DAYS)


def fmt_ts(ts: Column, pattern: str = MINUTE) -> Column:
    return F.date_format(ts, pattern)


def trunc_day(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def day_of_week0(ts: Column) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(ts) - 1


def hour24(ts: Column) -> Column:
    return F.hour(ts)


def parse_iso(text: Column) -> Column:
    """ISO text with an optional fraction; NULL if it is something else."""
    return F.try_to_timestamp(text, F.lit(ISO_PARSE))


def to_iso(ts: Column) -> Column:
    """ISO rendering; the fraction appears only where there is one."""
    whole = F.date_format(ts, ISO)
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def age_days(ts: Column, as_of) -> Column:
    return (F.unix_micros(clock(as_of)) - F.unix_micros(ts.cast("timestamp"))) / F.lit(DAY_SECONDS * 1_000_000)
