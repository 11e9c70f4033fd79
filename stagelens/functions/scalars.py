"""Scalar column expressions: units, times, ids, seeded uniforms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_GMT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSz"


def uniform(id_col: Column, salt: str) -> Column:
    """Uniform double in [0, 1) that depends on ``id_col`` and ``salt`` only.

    The first 32 bits of an MD5, so a row gets the same value whatever
    partition, attempt or engine computes it.
    """
    return F.conv(F.substring(stable_id(id_col, salt), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_int(u: Column, width: int, low: int) -> Column:
    """``u`` scaled to the integers ``low .. low + width - 1``."""
    return F.floor(u * F.lit(width)).cast("int") + F.lit(low)


def random_id() -> Column:
    """A new random id per row; differs from run to run."""
    return F.uuid()


def stable_id(id_col: Column, salt: str) -> Column:
    """An id as random as ``random_id`` that depends on its arguments only."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(":" + salt)))


def labelled(prefix: str, id_col: Column) -> Column:
    """``prefix`` followed by the id as text."""
    return F.concat(F.lit(prefix), id_col.cast("string"))


def to_kb(col: Column) -> Column:
    """Bytes to KB with two decimals, ties to even, a missing value is 0."""
    return F.bround(F.coalesce(col, F.lit(0)).cast("double") / F.lit(1024.0), 2)


def metric_value(name: Column, value: Column) -> Column:
    """Unit rule for metric samples: times stay, ``_MB`` grows to KB, bytes shrink to KB.

    The order of the branches is part of the rule: a name holding both
    ``Time`` and ``_MB`` is a time.
    """
    return (
        F.when(name.contains("Time"), F.bround(value, 2))
        .when(name.contains("_MB"), F.bround(value * F.lit(1024.0), 2))
        .otherwise(F.bround(value / F.lit(1024.0), 2))
    )


def epoch_ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds to a naive UTC timestamp, whatever the session time zone."""
    seconds = ms.cast("decimal(20,3)") / F.lit(1000)
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def epoch_s_to_ts(seconds: Column) -> Column:
    """Epoch seconds (possibly fractional) to a naive UTC timestamp."""
    return F.expr(_EPOCH) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(20,6)")
    )


def parse_gmt(text: Column) -> Column:
    """``2024-01-01T00:00:00.000GMT`` to a naive UTC timestamp; null or junk gives null."""
    return epoch_ms_to_ts(F.unix_millis(F.try_to_timestamp(text, F.lit(_GMT_FORMAT))))


def truncate_second(ts: Column) -> Column:
    """Naive timestamp cut to the second (no round trip through the session zone)."""
    fraction = F.extract(F.lit("SECOND"), ts) % F.lit(1)
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), fraction)


def _since_epoch(ts: Column) -> tuple[Column, Column]:
    """Whole minutes since the epoch (in seconds) and the seconds after them.

    Interval parts are plain arithmetic; a cast to an instant would depend on
    the session zone.
    """
    span = ts - F.expr(_EPOCH)
    day, hour, minute, second = (
        F.extract(F.lit(part), span) for part in ("DAY", "HOUR", "MINUTE", "SECOND")
    )
    minutes = (day.cast("bigint") * 24 + hour) * 60 + minute
    return minutes * 60, second


def ts_to_epoch(ts: Column) -> Column:
    """Epoch seconds with microseconds, as a decimal."""
    whole, second = _since_epoch(ts)
    return (whole + second).cast("decimal(20,6)")


def ts_to_epoch_s(ts: Column) -> Column:
    """Whole epoch seconds of a naive UTC timestamp."""
    whole, second = _since_epoch(ts)
    return whole + F.floor(second).cast("bigint")


def ts_to_epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a naive UTC timestamp."""
    whole, second = _since_epoch(ts)
    return whole * 1000 + F.floor(second * 1000).cast("bigint")


def app_end(completed: Column, end: Column, as_of: Column) -> Column:
    """End time of a finished application, else the time the job runs as of."""
    return F.when(completed, end).otherwise(as_of)


def host_of(host_port: Column) -> Column:
    """Host part of ``host:port``."""
    return F.split_part(host_port, F.lit(":"), F.lit(1))


def join_ids(ids: Column) -> Column:
    """Integer array to a comma list; a missing array is the empty list."""
    return F.coalesce(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit(""))


def split_ids(text: Column) -> Column:
    """Comma list back to an integer array."""
    parts = F.filter(F.split(text, ","), lambda x: x != F.lit(""))
    return F.transform(parts, lambda x: x.cast("int"))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace nulls (keys missing from the document) by a default per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
