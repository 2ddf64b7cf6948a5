"""Date / time scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_datetime(iso: Column) -> Column:
    """I4: ISO string -> struct(date 'yyyy-MM-dd', time 'HH:mm:ss'); empty ->
    ('', ''); unparsable -> (raw, '')."""
    # the wall-clock time is printed in the string's own offset: drop the
    # offset and parse the local part (independent of the session time zone)
    s = F.regexp_replace(iso, r"(Z|[+-]\d{2}:?\d{2})$", "")
    ts = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS]")),
                    F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm[:ss][.SSSSSS]")),
                    F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    empty = iso.isNull() | (iso == "")
    return F.struct(
        F.when(empty, F.lit("")).when(ts.isNull(), iso).otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("date"),
        F.when(empty | ts.isNull(), F.lit("")).otherwise(F.date_format(ts, "HH:mm:ss")).alias("time"))


def time_ago(ts: Column, now: Column) -> Column:
    """I5: 'Just now' / 'Nm ago' / 'Nh ago' / 'Nd ago' / date after 7 days."""
    ms = F.timestamp_diff("MILLISECOND", ts, now)
    mins = F.floor(ms / 60000)
    hours = F.floor(ms / 3600000)
    days = F.floor(ms / 86400000)
    return (F.when(mins < 1, F.lit("Just now"))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
            .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
            .otherwise(F.date_format(ts, "M/d/yyyy")))


def digest_due(last_sent: Column, freq_hours: Column, now: Column) -> Column:
    """Never sent, or at least ``freq_hours`` ago."""
    return last_sent.isNull() | (F.timestamp_diff("SECOND", last_sent, now) >= freq_hours * 3600)
