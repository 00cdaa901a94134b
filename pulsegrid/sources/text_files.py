"""Text formats: event lists, period lists, marker tables, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def read_events(spark: SparkSession, path: str, pattern: str | None = None, seconds: bool = False) -> DataFrame:
    """(t, label) of lines `<ms> <label>`; blank, comment and other lines are skipped, labels filtered by substring."""
    rows = spark.read.text(path).select(text.parse_event(F.col("value")).alias("e")).where("e IS NOT NULL")
    out = rows.select((F.col("e.ms") / (1000.0 if seconds else 1.0)).alias("t"), F.col("e.label").alias("label"))
    return out if pattern is None else out.where(F.col("label").contains(pattern))


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """(start, stop) of lines with two numbers; comments are skipped, any other line is an error."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    parts = F.split("line", "\\s+")
    bad = F.raise_error(F.concat(F.lit("not a period: "), F.col("line")))
    return lines.select(F.when(F.size(parts) == 2, F.transform(parts, lambda p: p.cast("double"))).otherwise(bad).alias("p")).select(F.col("p")[0].alias("start"), F.col("p")[1].alias("stop"))


def write_periods(periods: DataFrame, path: str) -> None:
    """Lines `start stop`, in order."""
    periods.orderBy("start").select(F.concat_ws(" ", F.col("start").cast("string"), F.col("stop").cast("string")).alias("value")).write.mode("errorifexists").text(path)


#: The eight cells of a rigid body in an export: a quaternion (with y up), a position in metres, an error.
BODY_CELLS = ("qx", "qz", "qy", "qw", "x", "z", "y", "error")


def read_rigid_bodies(spark: SparkSession, path: str, bodies: list[str]) -> DataFrame:
    """(frame, t, body, x, y, z, error, qx, qy, qz, qw) of a motion export: lines `frame,time` and eight cells for each body.

    Lengths are in millimetres, and z is up. Header lines, which don't begin with a number, and lines with missing cells
    are skipped. bodies: their names, in the order of the columns.
    """
    cells = F.split("value", ",")
    lines = spark.read.text(path).where(F.col("value").rlike("^[0-9]+,")).select(cells.alias("c")).where((F.size("c") >= 2 + 8 * len(bodies)) & ~F.exists("c", lambda c: F.trim(c) == ""))
    number = lambda at: F.col("c")[at].cast("double")
    scale = {"x": 1000.0, "y": 1000.0, "z": 1000.0, "error": 1000.0}
    each = [F.struct(F.lit(name).alias("body"), *((number(2 + 8 * i + j) * scale.get(cell, 1.0)).alias(cell) for j, cell in enumerate(BODY_CELLS))) for i, name in enumerate(bodies)]
    out = lines.select(F.col("c")[0].cast("long").alias("frame"), number(1).alias("t"), F.explode(F.array(*each)).alias("b"))
    return out.select("frame", "t", "b.body", *(f"b.{c}" for c in ("x", "y", "z", "error", "qx", "qy", "qz", "qw")))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(list, position, session, maze, trial, subject, fields) of a JSON catalogue {lists: {name: [records]}, subjects: {name: record}}.

    fields holds a session's values as text over those of its subject; null values of a session don't count.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    lists = raw.select(F.explode(F.variant_get("v", "$.lists", "map<string,array<map<string,variant>>>")).alias("list", "records"))
    rows = lists.select("list", F.posexplode("records").alias("position", "own"))
    own = F.map_filter(F.transform_values("own", lambda _, v: F.try_variant_get(v, "$", "string")), lambda _, v: v.isNotNull())
    rows = rows.withColumn("own", own).withColumn("subject", F.try_element_at("own", F.lit("subject")))
    subjects = raw.select(F.explode(F.coalesce(F.variant_get("v", "$.subjects", "map<string,map<string,variant>>"), F.create_map().cast("map<string,map<string,variant>>"))).alias("subject", "theirs"))
    subjects = subjects.select("subject", F.map_filter(F.transform_values("theirs", lambda _, v: F.try_variant_get(v, "$", "string")), lambda _, v: v.isNotNull()).alias("theirs"))
    both = rows.join(subjects, "subject", "left")
    extra = F.map_filter(F.coalesce("theirs", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key("own", k))
    named = [F.try_element_at("fields", F.lit(c)).alias(c) for c in ("session", "maze", "trial")]
    return both.withColumn("fields", F.map_concat("own", extra)).select("list", "position", *named, "subject", "fields")
