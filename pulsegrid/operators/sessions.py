"""Sessions put together from what was recorded: windows between marks, chunks of tracking, streams, trials."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import recording, sequence

#: Labels of the marks that begin and end a recording, by kind of logger.
MARKS = {"vicon": ("0x0040", "0x0000"), "spots": ("0x0040", "Stopping Recording")}


def mark_windows(events: DataFrame, start_mark: str, stop_mark: str) -> DataFrame:
    """(session, start, stop) of events (session, t, label): the k-th start mark with the k-th stop mark.

    Stops before a session's first start don't count; pairs that end before they begin are dropped. Marks are found
    anywhere in a label.
    """
    starts = events.where(F.col("label").contains(start_mark)).select("session", F.col("t").alias("start"))
    stops = events.where(F.col("label").contains(stop_mark)).select("session", F.col("t").alias("stop"))
    first = starts.groupBy("session").agg(F.min("start").alias("_first"))
    number = lambda df, t: df.withColumn("_k", F.row_number().over(Window.partitionBy("session").orderBy(t)))
    later = stops.join(first, "session").where("stop >= _first").drop("_first")
    return number(starts, "start").join(number(later, "stop"), ["session", "_k"]).where("stop > start").select("session", "start", "stop")


def assemble(events: DataFrame, frames: DataFrame, rate: float, kind: str = "vicon", tolerance: float = 0.2, marks: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions, streams) of sessions from their marks (session, t, label) and tracked frames (session, chunk, frame, marker, x, y, z).

    Each chunk is matched with the window of its length; positions (session, idx, marker, x, y, z) lie on one grid that
    begins with the first matched window; streams (session, t0, t1, rate, n_chunks) tell its span in seconds.
    """
    return in_windows(mark_windows(events, *(marks or MARKS[kind])), frames, rate, tolerance)


def in_windows(windows: DataFrame, frames: DataFrame, rate: float, tolerance: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """assemble() with the windows (session, start, stop in seconds) themselves."""
    chunks = frames.groupBy("session", "chunk").agg((F.max("frame") + 1).alias("n_frames"))
    matched = recording.match_chunks(chunks, windows, rate, tolerance)
    positions = recording.on_grid(frames, matched, rate)
    streams = matched.groupBy("session").agg(F.min("start").alias("t0"), F.max("stop").alias("t1"), F.lit(float(rate)).alias("rate"), F.count("*").alias("n_chunks"))
    return positions, streams


def pulse_windows(pulses: DataFrame, rate: float, threshold: float = 0.5, width: float | None = None) -> DataFrame:
    """(session, start, stop) in seconds of the pulses of a channel (session, idx, value), `rate` samples a second.

    Values count by their distance from the session's mean, relative to the greatest one: a pulse is where that is `threshold` or more. Pulses that
    a recording's ends cut don't count, and a flat channel has none. With a width no task sorts a whole session (scans.along).
    """
    mean = pulses.groupBy("session").agg(F.avg("value").alias("_mean"))
    far = pulses.join(mean, "session").select("session", "idx", F.abs(F.col("value") - F.col("_mean")).alias("_far"))
    most = far.groupBy("session").agg(F.max("_far").alias("_most")).where("_most >= 1e-9")
    share = far.join(most, "session").select("session", "idx", (F.col("_far") / F.col("_most")).alias("value"))
    found = sequence.pulses(share, threshold, width=width)
    return found.select("session", (F.col("start") / rate).alias("start"), (F.col("stop") / rate).alias("stop"))


def by_pulses(pulses: DataFrame, pulse_rate: float, frames: DataFrame, rate: float, threshold: float = 0.5, tolerance: float = 0.2, width: float | None = None) -> tuple[DataFrame, DataFrame]:
    """assemble() with the windows of a pulse channel."""
    return in_windows(pulse_windows(pulses, pulse_rate, threshold, width), frames, rate, tolerance)


def by_spots(spots: DataFrame, recorded: DataFrame, names: Sequence[str] = ("led_left", "led_right")) -> tuple[DataFrame, DataFrame]:
    """(positions, streams) of spots (session, frame, x1, y1, x2, y2), whose frames are spread evenly over what was recorded (session, seconds).

    A recorded 0 becomes EPS32, as in assemble(); spots have no height, so z is EPS32.
    """
    size = spots.groupBy("session").agg(F.count("*").alias("_n")).join(recorded, "session")
    streams = size.select("session", F.lit(0.0).alias("t0"), F.col("seconds").cast("double").alias("t1"), (F.col("_n") / F.col("seconds")).alias("rate"), F.lit(1).cast("long").alias("n_chunks"))
    real = lambda c: F.when(F.col(c) == 0, F.lit(recording.EPS32)).otherwise(F.col(c).cast("double"))
    both = F.array(*(F.struct(F.lit(n).alias("marker"), real(f"x{i}").alias("x"), real(f"y{i}").alias("y")) for i, n in enumerate(names, 1)))
    positions = spots.join(size.select("session"), "session").select("session", F.col("frame").cast("long").alias("idx"), F.explode(both).alias("m"))
    return positions.select("session", "idx", "m.*", F.lit(recording.EPS32).alias("z")), streams


#: Kinds of loggers: what names of the recorder and of the tracker hold, and what puts such sessions together.
LOGGERS: list[tuple[tuple[str, ...], tuple[str, ...], Callable[..., tuple[DataFrame, DataFrame]]]] = [
    (("openephys", "oephys"), ("optitrack", "motive", "vicon"), by_pulses),
    (("nlx", "neuralynx"), ("vicon", "optitrack", "motive"), lambda **inputs: assemble(**{"kind": "vicon", **inputs})),
    (("nlx", "neuralynx"), ("spots",), lambda **inputs: assemble(**{"kind": "spots", **inputs})),
    (("nlx", "neuralynx"), ("whl",), by_spots),
    (("ephys",), ("vicon", "optitrack", "motive"), lambda **inputs: assemble(**{"kind": "vicon", **inputs})),
]


def dispatch(loggers: Sequence[str], **inputs) -> tuple[DataFrame, DataFrame]:
    """(positions, streams) of sessions by the names of their loggers, such as `nlx` and `vicon`; inputs are those of the function for them."""
    names = [x.lower() for x in loggers]
    has = lambda parts: any(p in n for p in parts for n in names)
    for recorder, tracker, work in LOGGERS:
        if has(recorder) and has(tracker):
            return work(**inputs)
    raise ValueError(f"no way to put together sessions of {', '.join(loggers) or 'no loggers'}")


def setup_trial(blocks: DataFrame, offsets: tuple[float, float] = (0.0, 0.0), drop: Sequence[int] = (), include: Sequence[int] | None = None, trial: str = "all") -> DataFrame:
    """(session, trial, start, stop) of the blocks (session, start, stop) of sessions, numbered from 0 by start: those to include, or else all but those to drop.

    Offsets are added to starts and stops; blocks that they leave empty go.
    """
    number = F.row_number().over(Window.partitionBy("session").orderBy("start", "stop")) - 1
    rows = blocks.select("session", "start", "stop", number.alias("_k"))
    rows = rows.where(F.col("_k").isin(list(include))) if include is not None else rows.where(~F.col("_k").isin(list(drop)))
    return rows.select("session", F.lit(trial).alias("trial"), (F.col("start") + offsets[0]).alias("start"), (F.col("stop") + offsets[1]).alias("stop")).where("stop > start")


def whole(segments: DataFrame, by: tuple[str, ...] = ("stream",), trial: str = "all") -> DataFrame:
    """(by, trial, start, stop): one period for each stream, from its first segment's t0 to its last one's t1."""
    return segments.groupBy(*by).agg(F.lit(trial).alias("trial"), F.min("t0").alias("start"), F.max("t1").alias("stop"))


def spans(segments: DataFrame) -> DataFrame:
    """(stream, n_segments, total_samples, first, last, span) of segments (stream, t0, t1, rate)."""
    n = F.rint(F.sum((F.col("t1") - F.col("t0")) * F.col("rate"))).cast("long")
    out = segments.groupBy("stream").agg(F.count("*").alias("n_segments"), n.alias("total_samples"), F.min("t0").alias("first"), F.max("t1").alias("last"))
    return out.withColumn("span", F.col("last") - F.col("first"))


def slices(segments: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """(stream, window, low, high): ranges of local samples of each segment in windows (stream, window, w0, w1); empty ones go."""
    from . import rangejoin, sync

    parts = sync.cumulative(segments).select("stream", F.col("t0").alias("start"), F.col("t1").alias("stop"), "first", "rate")
    asked = windows.select("stream", F.col("w0").alias("start"), F.col("w1").alias("stop"), "window")
    both = rangejoin.overlaps(parts, asked, width, ("stream",)).select("stream", "a_start", "b_start", "b_stop", "start", "stop")
    named = both.join(parts.select("stream", F.col("start").alias("a_start"), "first", "rate"), ["stream", "a_start"])
    named = named.join(asked.select("stream", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), "window"), ["stream", "b_start", "b_stop"])
    at = lambda c: (F.col("first") + F.rint((F.col(c) - F.col("a_start")) * F.col("rate"))).cast("long")
    return named.select("stream", "window", at("start").alias("low"), at("stop").alias("high")).where("high > low")


def trials(periods: DataFrame, by: tuple[str, ...] = ("session", "trial")) -> DataFrame:
    """(by, t_start, t_stop, total_duration, n_periods) of trials of one or more periods; t_stop is that of the last to begin."""
    return periods.groupBy(*by).agg(F.min("start").alias("t_start"), F.max_by("stop", F.struct("start", "stop")).alias("t_stop"), F.sum(F.col("stop") - F.col("start")).alias("total_duration"), F.count("*").alias("n_periods"))
