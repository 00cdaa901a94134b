"""State expressions: names joined by & (and), | ^ + (or) and - (without), taken from left to right.

There is no precedence and there are no parentheses. An expression becomes one lazy plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import intervals

_OPERATORS = {"&": lambda x, y: x & y, "|": lambda x, y: x | y, "^": lambda x, y: x | y, "+": lambda x, y: x | y, "-": lambda x, y: x & ~y}


def query(collection: DataFrame, expression: str) -> DataFrame:
    """Periods (session, start, stop) of an expression over a collection (session, label[, key], start, stop).

    A name is a label or, where no state has it as a label, a key. The whole expression is one condition on what each
    stretch of time is covered by: one scan and one sweep, however many operators it has.
    """
    parts = [p.strip() for p in re.split(r"([&|^+\-])", expression)]
    if len(parts) % 2 == 0 or not all(parts[::2]):
        raise ValueError(f"not a state expression: {expression!r}")
    names = list(dict.fromkeys(parts[::2]))
    if "key" in collection.columns:
        known = [r.label for r in collection.where(F.col("label").isin(names)).select("label").distinct().collect()]  # as many as names at most
        by_key = [n for n in names if n not in known]
        named = F.array(F.when(F.col("label").isin(known), F.col("label")), F.when(F.col("key").isin(by_key), F.col("key")))
        collection = collection.select("session", F.explode(F.array_compact(named)).alias("label"), "start", "stop")

    def keep(*inside: Column) -> Column:
        covered = dict(zip(names, inside))
        out = covered[parts[0]]
        for sign, name in zip(parts[1::2], parts[2::2]):
            out = _OPERATORS[sign](out, covered[name])
        return out

    return intervals.combine_labelled(collection, names, keep)
