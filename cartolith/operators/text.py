"""Text of values: decimals, dates, timestamps, floats, names and encodings; as expressions where the JVM has them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import number

LABELS = {"latin1": "latin-1", "latin-1": "latin-1", "iso-8859-1": "latin-1", "cp1252": "cp1252", "windows-1252": "cp1252", "cp932": "cp932", "shift_jis": "cp932", "sjis": "cp932", "utf8": "utf-8", "utf-8": "utf-8"}


def encoding(label: str | None, default: str = "utf-8") -> str:
    found = LABELS.get((label or default).strip().lower())
    if found is None:
        raise ValueError(f"unknown encoding {label!r}")
    return found


@F.pandas_udf(T.StringType())
def float_text(x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else number(v) for v in x], dtype=object)


def decimal_text(c: Column) -> Column:
    return c.cast("string")


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def timestamp_text(c: Column, kind: T.DataType, naive_suffix: str = "") -> Column:
    """ISO text with six digits; timestamps with a zone are in UTC and end in Z."""
    if isinstance(kind, T.TimestampNTZType):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(naive_suffix))
    utc = F.to_utc_timestamp(c, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def as_text(c: Column, kind: T.DataType) -> Column:
    """The cell text of a value in CSV."""
    if isinstance(kind, T.DateType):
        return date_text(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c, kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = c if isinstance(kind, T.DoubleType) else c.cast("string").cast("double")
        return F.when(F.isnan(c), F.lit("NaN")).otherwise(float_text(value))
    return c.cast("string")


def parse_timestamp(text: str) -> datetime | None:
    """RFC 3339 with `T` or a space, a fraction or none, UTC if there is no zone; date only is midnight."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d:\d\d)(?:\.(\d+))?\s*(Z|[+-]\d\d:?\d\d)?)?", text.strip())
    if not m:
        return None
    try:
        at = datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}").replace(microsecond=int((m[3] or "0")[:6].ljust(6, "0")), tzinfo=timezone.utc)
    except ValueError:
        return None
    if m[4] and m[4] != "Z":
        sign = -1 if m[4][0] == "-" else 1
        at -= sign * timedelta(hours=int(m[4][1:3]), minutes=int(m[4][-2:]))
    return at


def table_name(text: str) -> str:
    """Other characters than letters, digits and `_` become `_`; a leading digit gets one before it."""
    out = re.sub(r"[^A-Za-z0-9_]", "_", text)
    return "_" + out if out[:1].isdigit() else out


def table_name_column(c: Column) -> Column:
    out = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("_"), out)).otherwise(out)


def cut_bytes(text: str, limit: int, codec: str = "utf-8") -> str:
    """The longest beginning that has no more than so many encoded bytes."""
    data = text.encode(codec, "replace")
    return text if len(data) <= limit else data[:limit].decode(codec, "ignore")


def rows_in_statement(limit: int, margin: int, parameters: int) -> int:
    return max(1, (limit - margin) // max(1, parameters))
