"""Small column expressions: finiteness, time, labels, selection by name."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.columns import col

_FRACTIONAL = (T.DoubleType, T.FloatType)
_NUMERIC = (T.NumericType,)
_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def is_missing(value: Column, dtype: T.DataType) -> Column:
    """Null or, for floating types, NaN."""
    return value.isNull() | F.isnan(value) if isinstance(dtype, _FRACTIONAL) else value.isNull()


def is_finite(value: Column) -> Column:
    """Non-null, not NaN and not infinite."""
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))


def or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, independent of the session zone."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") in _UTC:
        return F.unix_micros(ts.cast("timestamp"))
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600
    seconds = seconds + F.minute(ts) * 60
    fraction = F.date_part(F.lit("SECOND"), ts) * 1_000_000
    return seconds * 1_000_000 + fraction.cast("long")


def epoch_seconds(ts: Column) -> Column:
    return epoch_micros(ts) / F.lit(1e6)


def parse_datetime(pattern: str = "yyyy-MM-dd HH:mm:ss.SSS"):
    """Column parser for date-time text."""
    return lambda name: F.to_timestamp_ntz(col(name), F.lit(pattern))


def safe_name(value: Column) -> Column:
    """Every character that is neither letter nor digit becomes `_`; names stay whole, so that none meet."""
    return F.regexp_replace(value.cast("string"), r"[^\p{L}\p{N}]", "_")


def task_id(protocol: Column, key: Sequence[str]) -> Column:
    """`protocol_key-value_key-value…` with unsafe characters replaced."""
    parts = [
        F.concat(safe_name(F.lit(k)), F.lit("-"), safe_name(F.coalesce(col(k).cast("string"), F.lit("None"))))
        for k in key
    ]
    return F.concat_ws("_", safe_name(protocol), *parts)


def display_label(key: Sequence[str], empty: str = "selected") -> Column:
    """`key=value | key=value` over the non-null keys."""
    parts = [
        F.when(col(k).isNotNull(), F.concat(F.lit(f"{k}="), col(k).cast("string"))) for k in key
    ]
    text = F.concat_ws(" | ", *parts)
    return F.when(text == "", empty).otherwise(text)


def group_label(parts: Sequence[str]) -> Column:
    """Colon-joined identifiers; the leading dataset id is left out when there are more parts."""
    shown = list(parts[1:]) if len(parts) > 2 else list(parts)
    return F.concat_ws(":", *[col(c).cast("string") for c in shown])


def json_params(params: Mapping[str, object]) -> str:
    """Compact JSON with sorted keys, as stored in `resampling params`."""
    return json.dumps(dict(params), sort_keys=True, separators=(",", ":"))
