"""Expressions for what catalogs and previews show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def either(*values: Column) -> Column:
    """The first value that is neither null nor empty; the last one whatever it is."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def time_ago(then: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)

    def named(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago"))

    minutes, hours, days = (F.floor(seconds / s) for s in (60, 3600, 86400))
    return F.when(seconds < 60, F.lit("just now")).when(minutes < 60, named(minutes, "minute")).when(hours < 24, named(hours, "hour")).otherwise(named(days, "day"))


def shown_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("—"))


def action_of(layer: Column) -> Column:
    # What is shown for each layer.
    names = {"Bronze": "was uploaded", "Silver": "was cleaned in Prepare", "Gold": "was created in Merge"}
    out = F.lit("was updated")
    for k, v in names.items():
        out = F.when(layer == k, F.lit(v)).otherwise(out)
    return out


def megabytes(c: Column) -> Column:
    return c / 1024 / 1024


def shown_megabytes(c: Column) -> Column:
    return F.format_string("%.1f MB", megabytes(c))


def kilobytes(c: Column) -> Column:
    return F.format_string("%.0f KB", c / 1024)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)
