"""Session names, labels and catalogue records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: source-user-subject-date, the date of eight digits.
SESSION_NAME = r"^([A-Za-z0-9]+)-([A-Za-z0-9]+)-([A-Za-z0-9]+)-(\d{8})$"


def parse_session_name(name: Column) -> Column:
    """struct(source, user, subject, date) of a session name; null where it has another form."""
    part = lambda i: F.regexp_extract(name, SESSION_NAME, i)
    return F.when(name.rlike(SESSION_NAME), F.struct(part(1).alias("source"), part(2).alias("user"), part(3).alias("subject"), part(4).alias("date")))


def build_session_name(source: Column, user: Column, subject: Column, date: Column) -> Column:
    return F.concat_ws("-", source, user, subject, date)


def marker_name(header: Column) -> Column:
    """A marker's name without the subject before the colon."""
    return F.element_at(F.split(header, ":"), -1)


def parse_event(line: Column) -> Column:
    """struct(ms, label) of an event line `<ms> <label>`; null for blank, comment and other lines."""
    at = F.regexp_extract(line, r"^\s*([0-9.]+)\s+(\S.*)$", 1)
    label = F.rtrim(F.regexp_extract(line, r"^\s*([0-9.]+)\s+(\S.*)$", 2))
    return F.when(at.try_cast("double").isNotNull(), F.struct(at.cast("double").alias("ms"), label.alias("label")))


def merged(defaults: DataFrame, overrides: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Records in which non-null overrides replace the defaults of the same key."""
    changed = overrides.select(on, *(F.col(c).alias("_" + c) for c in columns))
    return defaults.join(changed, on, "left").select(on, *(F.coalesce("_" + c, c).alias(c) for c in columns))
