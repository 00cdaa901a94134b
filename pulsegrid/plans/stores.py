"""Queries of what is written and read: results by content, component bases, links, parameter files; and scans by buckets of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, sequence
from ..session import work_folder
from ..sources import cache, components, parameters, records
from . import bridge as b
from .queries import SQL, query, r6

_DAY = 86_400_000_000


@query(SQL["intersect_ranges_canonical"])
def intersect_by_buckets(spark, sf_dir):
    """Views and clicks intersected with windows of a day of a session at most."""
    return intervals.combine([b.views(spark, sf_dir), b.clicks(spark, sf_dir)], lambda x, y: x & y, width=_DAY)


@query(SQL["threshold_crossings"])
def threshold_crossings_by_buckets(spark, sf_dir):
    return sequence.crossings(b.samples(spark, sf_dir).select("session", "idx", "value"), 40.0, 3, width=256)


_RUNS = (
    "WITH c AS (SELECT event_type, COUNT(*) AS n, SUM(user_id) AS users FROM events GROUP BY event_type), d AS (SELECT event_type, n + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS n, "
    "users + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS users FROM c) "
    "SELECT 1 AS run, TRUE AS computed, * FROM c UNION ALL SELECT 2, FALSE, * FROM c UNION ALL SELECT 3, TRUE, * FROM d"
)


@query(_RUNS)
def cached_counts(spark, sf_dir):
    """Counts by kind, kept by the content of the events: computed, read, and computed again when a row is added."""
    made = []

    @cache.cached_compute(work_folder(spark), by=("events",))
    def counts(events):
        made.append(True)
        return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))

    events = b.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    more = events.unionByName(spark.createDataFrame([(-1, 1, "view")], events.schema))
    out = None
    for run, rows in enumerate((events, events.repartition(7).select("user_id", "event_type", "event_id"), more), 1):
        before = len(made)
        one = counts(rows).select(F.lit(run).alias("run"), F.lit(len(made) > before).alias("computed"), "event_type", "n", "users")
        out = one if out is None else out.unionByName(one)
    return out


_SAME = "SELECT '{0}' AS what, NOT EXISTS ((SELECT {1} FROM {2} EXCEPT ALL SELECT {3} FROM {4}) UNION ALL (SELECT {3} FROM {4} EXCEPT ALL SELECT {1} FROM {2})) AS same"
_CASES = {
    "other order": ("events", "event_id, user_id, value"), "value changed": ("events", "event_id, user_id, CASE WHEN event_id = 3 THEN value + 1 ELSE value END AS value"),
    "row repeated": ("(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id = 3)", "event_id, user_id, value"), "row dropped": ("(SELECT * FROM events WHERE event_id <> 3)", "event_id, user_id, value"),
    "values swapped": ("events", "user_id AS event_id, event_id AS user_id, value"), "null": ("events", "event_id, user_id, NULLIF(value, value) AS value"),
}


@query(" UNION ALL ".join(_SAME.format(what, "event_id, user_id, value", "events", columns, table) for what, (table, columns) in _CASES.items()))
def content_hash_cases(spark, sf_dir):
    """Which changes of a table its content hash notices."""
    b.read(spark, sf_dir, "events").createOrReplaceTempView("_content")
    first = cache.content_hash(spark.sql("SELECT event_id, user_id, value FROM _content"))
    found = [(what, first == cache.content_hash(spark.sql(f"SELECT {columns} FROM {table.replace('events', '_content')}").repartition(5))) for what, (table, columns) in _CASES.items()]
    return spark.createDataFrame(found, "what string, same boolean")


@query(
    "WITH e AS (SELECT vec_id, label % 3 AS ch, i, CAST(embedding[CAST(i + 1 AS INTEGER)] AS DOUBLE) AS v FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)), "
    "m AS (SELECT ch, i, AVG(v) AS m FROM e GROUP BY ch, i), k AS (SELECT unnest([0, 1, 2]) AS component) "
    "SELECT vec_id, CAST(e.ch AS INTEGER) AS ch, component, ROUND(SUM((v - m) * COS((component + 1) * (e.i + 1) / 8.0)), 6) + 0.0 AS score FROM e JOIN m ON m.ch = e.ch AND m.i = e.i, k GROUP BY ALL"
)
def waveform_scores(spark, sf_dir):
    """Embeddings as waveforms of three channels, on a basis that was written to a file and read."""
    rows = b.read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("ch"), F.col("embedding").cast("array<double>").alias("values"))
    means = rows.select("ch", F.posexplode("values").alias("i", "v")).groupBy("ch", "i").agg(F.avg("v").alias("v"))
    means = means.groupBy("ch").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m")).select("ch", F.lit(-1).alias("component"), F.col("m.v").alias("vector"))
    n = len(rows.select("values").first()[0])
    vector = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.cos((F.col("component") + 1) * i / F.lit(8.0)))
    waves = spark.range(9).select((F.col("id") % 3).cast("int").alias("ch"), F.floor(F.col("id") / 3).cast("int").alias("component")).withColumn("vector", vector)
    path = work_folder(spark) + "/s.pca.1"
    components.save_basis(means.unionByName(waves), path)
    basis, _ = components.load_basis(spark, path, n)
    return components.project(rows, basis).select("vec_id", "ch", "component", r6(F.col("score")).alias("score"))


@query("SELECT CAST(c_nationkey AS INTEGER) AS fibre, COUNT(*) AS n_atoms, MIN(c_custkey + 1) AS first, CAST(SUM(c_custkey + 1) AS BIGINT) AS total FROM customer WHERE c_nationkey <> 0 GROUP BY c_nationkey")
def fibres_and_atoms(spark, sf_dir):
    """Nations of customers as a linkage file, written and read."""
    rows = b.read(spark, sf_dir, "customer").select(F.lit("s.clp.1").alias("file"), F.col("c_custkey").cast("long").alias("idx"), F.array(F.col("c_nationkey").cast("long")).alias("values"))
    folder = work_folder(spark)
    records.write_records(rows, folder, "parents", header="count")
    found = components.fibre_to_atoms(components.read_links(spark, f"{folder}/s.clp.1"))
    total = F.aggregate("atoms", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select("fibre", "n_atoms", F.col("atoms")[0].alias("first"), total.alias("total"))


@query(
    "WITH s AS (SELECT s_nationkey AS nation, s_suppkey % 3 AS g, s_suppkey FROM supplier) SELECT CAST(nation AS INTEGER) AS nation, CAST(DENSE_RANK() OVER (PARTITION BY nation ORDER BY g) - 1 AS INTEGER) AS \"group\", "
    "CAST(ROW_NUMBER() OVER (PARTITION BY nation, g ORDER BY s_suppkey) - 1 AS INTEGER) AS position, CAST(s_suppkey AS INTEGER) AS channel FROM s"
)
def channel_groups_read(spark, sf_dir):
    """Suppliers as channels in a parameter file for each nation."""
    rows = b.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 3).alias("g"), "s_suppkey")
    group = F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda x: F.concat(F.lit("<channel>"), x.cast("string"), F.lit("</channel>"))), "")
    groups = rows.groupBy("nation", "g").agg(F.concat(F.lit("<group><channels>"), group, F.lit("</channels></group>")).alias("x"))
    file = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "x"))), lambda x: x["x"]), "")
    files = groups.groupBy("nation").agg(F.concat(F.lit("<parameters><spikeDetection><channelGroups>"), file, F.lit("</channelGroups></spikeDetection></parameters>")).alias("value"))
    folder = work_folder(spark) + "/xml"
    files.repartition("nation").write.partitionBy("nation").text(folder)
    found = parameters.channel_groups(parameters.read_parameters(spark, f"{folder}/nation=*", ".xml"))
    return found.select(F.regexp_extract("file", r"nation=(\d+)", 1).cast("int").alias("nation"), "group", "position", "channel")


@query(
    f"WITH {b.EV}, {b.SAMPLES}, m AS (SELECT session, idx, value - AVG(value) OVER (PARTITION BY session) AS x FROM sm), l AS (SELECT session, idx, x, LAG(x, 1) OVER w AS x1, LAG(x, 2) OVER w AS x2 FROM m WINDOW w AS (PARTITION BY session ORDER BY idx)), "
    "r AS (SELECT session, SUM(x * x) AS r0, COALESCE(SUM(x * x1), 0) AS r1, COALESCE(SUM(x * x2), 0) AS r2 FROM l GROUP BY session), a AS (SELECT session, r1 * (r0 - r2) / (r0 * r0 - r1 * r1) AS a1, (r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1) AS a2 FROM r) "
    "SELECT l.session, idx, ROUND(x - COALESCE(a1 * x1, 0) - COALESCE(a2 * x2, 0), 5) + 0.0 AS value FROM l JOIN a ON a.session = l.session"
)
def whitened_signal(spark, sf_dir):
    from ..operators import signal

    rows = b.samples(spark, sf_dir).select("session", "idx", "value")
    return signal.whitened(rows, ["session"]).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(None)
def accumulated_features(spark, sf_dir):
    """Which entries of embeddings tell three labels apart, and how well with each one more."""
    from ..operators import selection

    rows = b.read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("s"), F.col("label") % 3).alias("label"), (F.col("vec_id") % 5 > 0).alias("train"), *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)))
    return selection.accumulate(rows, [f"e{i}" for i in range(8)], ["s0", "s1", "s2"], key=["vec_id"], least_bits=0.001, block=2000)


_NOSE = "WITH p AS (SELECT CAST(l_linenumber AS INTEGER) AS session, CAST(l_orderkey AS BIGINT) AS idx, AVG(l_quantity) - 25 AS dx, AVG(l_discount) * 100 - 5 AS dy, AVG(l_tax) * 100 - 4 AS dz FROM lineitem GROUP BY ALL)"


@query(
    f"{_NOSE}, l AS (SELECT session, idx, CASE WHEN ATAN2(dz, SQRT(dx * dx + dy * dy)) < -0.05 THEN 'walk_lang' WHEN ATAN2(dz, SQRT(dx * dx + dy * dy)) > -0.05 THEN 'walk_hang' END AS label FROM p WHERE idx % 1000 >= 100 AND idx % 1000 < 900), "
    "g AS (SELECT *, idx - ROW_NUMBER() OVER (PARTITION BY session, label ORDER BY idx) AS g FROM l WHERE label IS NOT NULL) SELECT session, label, MIN(idx) AS start, MAX(idx) + 1 AS stop FROM g GROUP BY session, label, g HAVING COUNT(*) >= 2"
)
def walks_by_head_pitch(spark, sf_dir):
    """Line items as heads: walks are the orders 100 to 900 of each thousand."""
    from ..operators import behaviour

    at = b.read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("session"), F.col("l_orderkey").cast("long").alias("idx")).agg(
        (F.avg("l_quantity") - 25).cast("double").alias("x"), (F.avg("l_discount") * 100 - 5).cast("double").alias("y"), (F.avg("l_tax") * 100 - 4).cast("double").alias("z")
    )
    zero = F.lit(0.0)
    both = F.array(F.struct(F.lit("head_back").alias("marker"), zero.alias("x"), zero.alias("y"), zero.alias("z")), F.struct(F.lit("head_front").alias("marker"), F.col("x"), F.col("y"), F.col("z")))
    markers = at.select("session", "idx", F.explode(both).alias("m")).select("session", "idx", "m.*")
    walk = at.select("session", F.floor(F.col("idx") / 1000).alias("k")).distinct().select("session", (F.col("k") * 1000 + 100).alias("start"), (F.col("k") * 1000 + 900).alias("stop"))
    return behaviour.walk_by_pitch(walk, markers, -0.05, min_interval=2, width=1000)


@query(
    f"WITH {b.EV}, {b.SAMPLES}, f AS (SELECT session, idx, ABS(value - AVG(value) OVER (PARTITION BY session)) AS x FROM sm), s AS (SELECT session, idx, x / MAX(x) OVER (PARTITION BY session) >= 0.3 AS up FROM f), "
    "r AS (SELECT session, idx, idx - ROW_NUMBER() OVER (PARTITION BY session ORDER BY idx) AS g FROM s WHERE up), p AS (SELECT session, MIN(idx) AS a, MAX(idx) + 1 AS z FROM r GROUP BY session, g), e AS (SELECT session, MAX(idx) AS last FROM sm GROUP BY session) "
    "SELECT p.session, ROUND(a / 10.0, 6) + 0.0 AS start, ROUND(z / 10.0, 6) + 0.0 AS stop FROM p JOIN e ON e.session = p.session WHERE a > 0 AND z <= last"
)
def pulse_windows(spark, sf_dir):
    from ..operators import sessions

    found = sessions.pulse_windows(b.samples(spark, sf_dir).select("session", "idx", "value"), 10.0, 0.3, width=512)
    return found.select("session", r6(F.col("start")).alias("start"), r6(F.col("stop")).alias("stop"))


@query(
    f"WITH {b.EV}, {b.ERRORS}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session ORDER BY start, stop) - 1 AS k FROM c) SELECT session, 'short' AS trial, start + 60000000 AS start, stop - 60000000 AS stop FROM k WHERE k NOT IN (0, 2, 5)"
)
def trial_setup(spark, sf_dir):
    """Errors as blocks: all but three, a minute shorter at either end."""
    from ..operators import sessions

    return sessions.setup_trial(b.errors(spark, sf_dir), (b.MINUTE, -b.MINUTE), drop=(0, 2, 5), trial="short")
