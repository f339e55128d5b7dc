"""Seconds of a service day as integers; hours may pass 24, and -1 stands for a missing time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the epoch milliseconds that the seconds of a day are added to.
DAY_MILLIS = 1_768_860_000_000


def parse_time(text: Column) -> Column:
    """``HH:MM`` or ``HH:MM:SS`` to seconds; null and empty texts to -1, anything else to null."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    seconds = F.when(F.size(parts) == 2, 0).otherwise(number(3))
    return F.when(text.isNull() | (F.trim(text) == ""), -1).when(F.size(parts).isin(2, 3), number(1) * 3600 + number(2) * 60 + seconds)


def _clock(seconds: Column, form: str, *more: Column) -> Column:
    return F.format_string(form, F.floor(seconds / 3600).cast("int"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int"), *more)


def hhmm(seconds: Column) -> Column:
    return F.when(seconds < 0, "--:--").otherwise(_clock(seconds, "%02d:%02d"))


def hhmmss(seconds: Column) -> Column:
    return F.when(seconds < 0, "--:--:--").otherwise(_clock(seconds, "%02d:%02d:%02d", F.pmod(seconds, F.lit(60)).cast("int")))


def duration_text(seconds: Column) -> Column:
    """``41s``, ``12m``, ``3h 5m``; ``-`` for a negative one."""
    minutes = F.floor(seconds / 60).cast("int")
    hours = F.format_string("%dh %dm", F.floor(seconds / 3600).cast("int"), F.pmod(minutes, F.lit(60)).cast("int"))
    return F.when(seconds < 0, "-").when(seconds < 60, F.format_string("%ds", seconds.cast("int"))).when(seconds < 3600, F.format_string("%dm", minutes)).otherwise(hours)


def to_minutes(seconds: Column) -> Column:
    return F.floor((seconds + 30) / 60).cast("int")


def epoch_millis(seconds: Column) -> Column:
    return F.lit(DAY_MILLIS) + seconds.cast("long") * 1000


def is_peak(seconds: Column) -> Column:
    """Seven to nine and eighteen to twenty o'clock."""
    hour = F.floor(seconds / 3600)
    return ((hour >= 7) & (hour < 9)) | ((hour >= 18) & (hour < 20))


def compact_to_seconds(stamp: Column) -> Column:
    """``YYYYMMDDHHMMSS`` as a number to seconds of the day."""
    s = F.pmod(stamp.cast("long"), F.lit(1_000_000))
    return (F.floor(s / 10_000) * 3600 + F.floor(F.pmod(s, F.lit(10_000)) / 100) * 60 + F.pmod(s, F.lit(100))).cast("int")


def from_minutes(minutes: Column) -> Column:
    return (minutes * 60).cast("int")


def valid_time(seconds: Column) -> Column:
    """Whether seconds are within two days; a null time isn't."""
    return F.coalesce(seconds.between(0, 48 * 3600), F.lit(False))


def progress_text(millis: Column) -> Column:
    """``3h 5m``, ``12m 7s`` or ``41s`` of milliseconds that a run takes; ``...`` for negative ones, which aren't known yet."""
    seconds = F.floor(millis / 1000).cast("long")
    whole = lambda n, of: F.pmod(F.floor(seconds / n), F.lit(of)).cast("long")
    hours = F.floor(seconds / 3600).cast("long")
    small = F.when(seconds >= 60, F.format_string("%dm %ds", whole(60, 60), whole(1, 60))).otherwise(F.format_string("%ds", seconds))
    return F.when(millis < 0, "...").when(hours > 0, F.format_string("%dh %dm", hours, whole(60, 60))).otherwise(small)
