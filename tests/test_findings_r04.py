"""Cases of the fourth round's findings."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from pulsegrid import catalog


def events(spark, folder, windows):
    """A table of events whose clicks and purchases are the windows (user, start, stop in seconds)."""
    at = [(user, kind, t) for user, start, stop in windows for kind, t in (("click", start), ("purchase", stop))]
    rows = spark.createDataFrame([(i, user, kind, t, 1.0) for i, (user, kind, t) in enumerate(at)], "event_id long, user_id long, event_type string, t double, value double")
    rows.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")).cast("timestamp_ntz")).drop("t").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_windows_without_frames_are_no_chunks_own(spark, tmp_path):
    """a window a little shorter than half a frame has no chunk, and none of a frame takes it."""
    lengths = [2000.0, 499.5, 1000.0, 499.9, 1000.0, 3000.0, 1500.6, 1499.4, 120.0]
    sf_dir = events(spark, tmp_path, [(1, 5000.0 * i, 5000.0 * i + n) for i, n in enumerate(lengths)])
    want = duckdb.sql(catalog.oracle_sql()["session_assembly"].replace("FROM events", f"FROM '{sf_dir}/events.parquet/*.parquet'")).fetchall()
    got = catalog.queries()["session_assembly"](spark, sf_dir).select("session", "idx", "x").collect()
    assert len(want) == 10 and Counter(map(tuple, got)) == Counter(want)


def test_windows_of_the_same_start_keep_their_chunks(spark, tmp_path):
    """such windows are numbered by their stops, whatever the order of rows, and each has its frames."""
    lengths = [1502.0, 1499.6] * 40
    sf_dir = events(spark, tmp_path, [(1, 5000.0 * (i // 2), 5000.0 * (i // 2) + n) for i, n in enumerate(lengths)])
    got = catalog.queries()["session_assembly"](spark, sf_dir).collect()
    x = lambda chunk, frame: (chunk * 31 + frame * 7) % 100 + 1.0
    want = [(1, 5 * i + f, x(chunk, f)) for i in range(40) for chunk, n in ((2 * i + 1, 1), (2 * i + 2, 2)) for f in range(n)]
    assert Counter((r.session, r.idx, r.x) for r in got) == Counter(want)
