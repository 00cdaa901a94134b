"""Parameter files of sessions as tables: a row a value, and channel groups as rows."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: The sections that list channel groups.
SECTIONS = {"spike": "spikeDetection", "anat": "anatomicalDescription"}


def _leaves(value: Any, path: str = "") -> Iterator[tuple[str, str | None]]:
    """(path, value) of what nested mappings and lists hold; list places are numbered from 0."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{i}]")
    else:
        yield path, None if value is None else (value if isinstance(value, str) else json.dumps(value, default=str))


def _element(e: ET.Element) -> Any:
    """An element as a mapping of its attributes and children (repeated ones as a list), or its text if it has neither."""
    out: dict[str, Any] = dict(e.attrib)
    for child in e:
        tag, made = child.tag.rpartition("}")[2], _element(child)
        if tag in out:
            out[tag] = [*(out[tag] if isinstance(out[tag], list) else [out[tag]]), made]
        else:
            out[tag] = made
    text = (e.text or "").strip()
    if not out:
        return text
    return {**out, "text": text} if text else out


def _parse(name: str, text: str) -> Any:
    """name: a file's name or just its ending."""
    if name.endswith(".xml"):
        return _element(ET.fromstring(text))
    if name.endswith(".json"):
        return json.loads(text)
    if name.endswith((".yaml", ".yml")):
        import yaml  # optional; files of other kinds need it not

        return yaml.safe_load(text)
    # Lines of numbers and words, as older parameter files have them.
    return [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]


def read_parameters(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file, path, value) of all values of parameter files, by kind or the ending of their names: .xml, .yaml, .yml, .json, else lines of words.

    A path names keys joined by dots, and places in lists as [0], [1] and so on. Values are strings; a value that is null stays null. A file that can't be parsed is an error.
    """
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, p, v) for f, t in zip(batch["file"], batch["value"]) for p, v in _leaves(_parse(kind or f, t))]
            yield pd.DataFrame(rows, columns=["file", "path", "value"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(run, "file string, path string, value string")


def channel_groups(parameters: DataFrame, source: str = "spike") -> DataFrame:
    """(file, group, position, channel) of the channel groups of read_parameters(), all numbered from 0 but channels, which are as in the file.

    source: `spike` or `anat`. Channels may be numbers, or mappings with an id (anatomical groups), whatever their file's kind.
    """
    at = rf"^{SECTIONS[source]}\.channelGroups(?:\.group)?(?:\[(\d+)\])?\.(?:channels(?:\.channel)?|channel)(?:\[(\d+)\])?(?:\.id|\.text)?$"
    rows = parameters.where(F.col("path").rlike(at))
    number = lambda k: F.coalesce(F.regexp_extract("path", at, k).try_cast("int"), F.lit(0))
    return rows.select("file", number(1).alias("group"), number(2).alias("position"), F.col("value").try_cast("int").alias("channel")).where("channel IS NOT NULL")
