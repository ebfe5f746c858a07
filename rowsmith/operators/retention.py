"""Retention (R1): keep rows younger than a time-to-live."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F, types as T

DEFAULT_TTL_MINUTES = 60


def retain(df: DataFrame, created_col: str, as_of: datetime, ttl_minutes: int = DEFAULT_TTL_MINUTES) -> DataFrame:
    """Keep rows with ``created + ttl > as_of`` (a row expiring exactly at ``as_of`` is gone).

    Written as ``created > as_of - ttl`` so the predicate is on the raw column and
    reaches the Parquet scan as a pushed filter (row-group skipping on big tables);
    it works unchanged on a stream. A naive ``as_of`` is UTC, whatever the zone of the
    driver; it is compared with the wall-clock value of a TIMESTAMP_NTZ column and with
    the instant of a TIMESTAMP column."""
    cutoff = as_of - timedelta(minutes=ttl_minutes)
    if cutoff.tzinfo is not None:
        cutoff = cutoff.astimezone(timezone.utc).replace(tzinfo=None)
    if isinstance(df.schema[created_col].dataType, T.TimestampType):
        limit = F.lit(f"{cutoff.isoformat()}+00:00").cast("timestamp")
    else:
        limit = F.lit(cutoff.isoformat()).cast("timestamp_ntz")
    return df.where(F.col(created_col) > limit)
