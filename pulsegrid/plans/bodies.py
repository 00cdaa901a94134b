"""Queries of bodies, waveforms, egocentric maps and files, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import behaviour, bodies, fields, motion, posture, scans, signal, states, waveforms
from ..session import save, work_folder
from ..sources import tables, text_files
from . import bridge as b
from .queries import POS, WIDE, _at, _frames, _markers, _track, _unit, query, r6, s6

WAVES = (
    "wf AS (SELECT l_suppkey % 5 AS unit, l_linenumber % 3 AS channel, l_orderkey % 24 AS sample, l_quantity - 40 * (CASE WHEN l_orderkey % 24 = 9 THEN 1 ELSE 0 END) + 12.5 * (CASE WHEN l_orderkey % 24 IN (13, 14) THEN 1 ELSE 0 END) * l_linenumber AS v FROM lineitem), "
    "mw AS (SELECT unit, channel, sample, AVG(v) AS m FROM wf GROUP BY ALL), am AS (SELECT unit, channel, MAX(m) - MIN(m) AS amp, MIN(m) AS low FROM mw GROUP BY ALL), bc AS (SELECT * FROM am QUALIFY ROW_NUMBER() OVER (PARTITION BY unit ORDER BY amp DESC, channel) = 1), "
    "bw AS (SELECT mw.*, bc.amp, bc.low FROM mw JOIN bc ON bc.unit = mw.unit AND bc.channel = mw.channel), tr AS (SELECT unit, MIN(sample) AS trough FROM bw WHERE m = low GROUP BY unit), cn AS (SELECT unit, AVG(v) AS c FROM wf GROUP BY unit), "
    "ns AS (SELECT wf.unit, MEDIAN(ABS(v - c)) AS noise FROM wf JOIN cn ON cn.unit = wf.unit GROUP BY wf.unit), pk AS (SELECT bw.unit, bw.sample AS peak FROM bw JOIN tr ON tr.unit = bw.unit WHERE bw.sample >= trough QUALIFY ROW_NUMBER() OVER (PARTITION BY bw.unit ORDER BY m DESC, bw.sample) = 1), "
    "lf AS (SELECT bw.unit, MAX(bw.sample) AS l FROM bw JOIN tr ON tr.unit = bw.unit WHERE bw.sample < trough AND m >= low / 2 GROUP BY bw.unit), rt AS (SELECT bw.unit, bw.sample AS r FROM bw JOIN tr ON tr.unit = bw.unit WHERE bw.sample >= trough AND m >= low / 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY bw.unit ORDER BY bw.sample) = 2)"
)


@query(
    f"WITH {WAVES} SELECT bc.unit, bc.channel, {s6('bc.amp', 'amplitude')}, {s6('amp / (2 * noise / 0.6745)', 'snr')}, {s6('(peak - trough) * 0.05', 'width_ms')}, {s6('(trough - l) * 0.05', 'left_ms')}, {s6('(r - trough) * 0.05', 'right_ms')}, {s6('(r - trough) / NULLIF(trough - l, 0)', 'symmetry')} "
    "FROM bc JOIN tr ON tr.unit = bc.unit JOIN pk ON pk.unit = bc.unit JOIN ns ON ns.unit = bc.unit LEFT JOIN lf ON lf.unit = bc.unit LEFT JOIN rt ON rt.unit = bc.unit"
)
def waveform_metrics(spark, sf_dir):
    at = F.col("l_orderkey") % 24
    value = F.col("l_quantity") - 40 * F.when(at == 9, 1).otherwise(0) + 12.5 * F.when(at.isin(13, 14), 1).otherwise(0) * F.col("l_linenumber")
    rows = b.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("unit"), (F.col("l_linenumber") % 3).alias("channel"), at.alias("sample"), value.alias("value"))
    found = waveforms.metrics(rows, 20_000.0)
    return found.select("unit", "channel", *(r6(F.col(c)).alias(c) for c in ("amplitude", "snr", "width_ms", "left_ms", "right_ms", "symmetry")))


STEPS = {"v": ("c", "xyz"), **{a: (a, "xyz") for a in "kmn"}}
JOINT = (
    f"{WIDE}, c AS (SELECT *, (x5 + x3 + x6 + x4) / 4 AS cx, (y5 + y3 + y6 + y4) / 4 AS cy, (z5 + z3 + z6 + z4) / 4 AS cz FROM wd), v0 AS (SELECT f % 4 AS session, f, cx, cy, cz, x5 - cx AS ax, y5 - cy AS ay, z5 - cz AS az, x3 - cx AS ex, y3 - cy AS ey, z3 - cz AS ez FROM c), "
    f"n0 AS (SELECT *, {_unit('n', 'e', 'a')} FROM v0), m0 AS (SELECT *, {_unit('m', 'n', 'a')} FROM n0), k0 AS (SELECT *, {_unit('k', 'n', 'm')} FROM m0), "
    "st AS (SELECT *, " + ", ".join(f"COALESCE(LEAD({s}{d}) OVER w - LAG({s}{d}) OVER w, 0) AS {name}_{d}" for name, (s, ds) in STEPS.items() for d in ds) + " FROM k0 WINDOW w AS (PARTITION BY session ORDER BY f)), "
    "ok AS (SELECT *, " + ", ".join(f"({a}x * v_x + {a}y * v_y + {a}z * v_z) AS s{a}" for a in "kmn") + " FROM st WHERE kx IS NOT NULL AND mx IS NOT NULL AND nx IS NOT NULL), ap AS (SELECT * FROM ok WHERE cz < 70 AND SQRT(" + " + ".join(f"POW(LEAST(GREATEST(s{a} * 2, -1000), 1000), 2)" for a in "kmn") + ") BETWEEN 5.000000001 AND 299.999999999), "
    "sh AS (SELECT UNNEST(RANGE(-20, 21)) * 2.0 AS shift), co AS (" + " UNION ALL ".join(
        f"SELECT session, '{axis}' AS axis, shift, LOG10(SUM(" + " + ".join(f"POW(LEAST(GREATEST(s{a} + shift * ({a}x * {t}_x + {a}y * {t}_y + {a}z * {t}_z), -100), 100), 2)" for a in "kmn") + ") + 2.2250738585072014e-308) AS cost FROM ap, sh GROUP BY ALL"
        for axis, t in (("x", "k"), ("y", "m"), ("z", "n"))
    ) + ")"
)


def _joint_costs(spark, sf_dir):
    frames = posture.basis(_frames(spark, sf_dir), ["head_back", "hcom", "head_front", "nose"]).withColumn("session", F.col("frame") % 4)
    return bodies.joint_costs(frames, 40.0, -40.0, 40.0, 2.0, fast=300.0, top=70.0, idx="frame")


@query(f"WITH {JOINT} SELECT session, axis, shift, {s6('cost', 'cost')} FROM co")
def joint_costs(spark, sf_dir):
    return _joint_costs(spark, sf_dir).select("session", "axis", "shift", r6(F.col("cost")).alias("cost"))


@query(f"WITH {JOINT}, r AS (SELECT session, axis, ARG_MIN(shift, (ROUND(cost, 9), shift)) AS s FROM co GROUP BY ALL) SELECT session, " + ", ".join(f"MAX(CASE WHEN axis = '{d}' THEN s END) AS {d}" for d in "xyz") + " FROM r GROUP BY session")
def virtual_joint(spark, sf_dir):
    return bodies.joint(_joint_costs(spark, sf_dir).withColumn("cost", F.round("cost", 9)))


def _chord(a: int, c: int) -> str:
    return " + ".join(f"({d}{c} - {d}{a}) * ({d}{c} - {d}{a})" for d in "xyz")


def _curve(d: str, first: bool) -> str:
    """A natural cubic through three markers: its second derivative in the middle one has a closed form."""
    bend = f"(3 * (({d}3 - {d}2) / h1 - ({d}2 - {d}1) / h0) / (h0 + h1))"
    if first:
        return f"{d}1 + p * (({d}2 - {d}1) / h0 - h0 * {bend} / 6) + p * p * p * {bend} / (6 * h0)"
    return f"{d}2 + (p - h0) * (({d}3 - {d}2) / h1 - h1 * {bend} / 3) + (p - h0) * (p - h0) * {bend} / 2 - (p - h0) * (p - h0) * (p - h0) * {bend} / (6 * h1)"


@query(
    f"WITH {WIDE}, h AS (SELECT *, SQRT({_chord(1, 2)}) AS h0, SQRT({_chord(2, 3)}) AS h1 FROM wd), g AS (SELECT h.*, q.place, q.place * (h0 + h1) AS p FROM h, (SELECT UNNEST([0.25, 0.5, 0.75]) AS place) q) SELECT f AS frame, CAST(place AS DOUBLE) AS place, "
    + ", ".join(f"CASE WHEN h0 = 0 OR h1 = 0 THEN 0.0 ELSE ROUND(CASE WHEN p < h0 THEN {_curve(d, True)} ELSE {_curve(d, False)} END, 6) + 0.0 END AS {d}" for d in "xyz") + " FROM g"
)
def spine_curve(spark, sf_dir):
    found = bodies.spine(_frames(spark, sf_dir), ["frame"], ["pelvis_root", "spine_upper", "hcom"], [0.25, 0.5, 0.75], equal_length=False)
    return found.select("frame", "place", *(r6(F.col(d)).alias(d) for d in "xyz"))


@query(None)
def evened_spine(spark, sf_dir):
    found = bodies.evened(_frames(spark, sf_dir), ["frame"], ["pelvis_root", "spine_upper", "bcom", "hcom"])
    return found.select("frame", *(r6(F.col(f"{n}.{d}")).alias(f"{n}_{d}") for n in ("pelvis_root", "spine_upper", "bcom", "hcom") for d in "xyz"))


@query(None)
def relabelled_markers(spark, sf_dir):
    """Four markers of a body, dealt anew in the last 6 of each 8 frames of a session."""
    frames = posture.wide(_markers(spark, sf_dir), ["frame"], {"a": 1, "b": 2, "c": 3, "d": 4}).withColumn("session", F.col("frame") % 4)
    frames = save(scans.along(frames, ["session"], "frame", 1 << 18, sums={"_n": F.lit(1)}).withColumn("idx", (F.col("_n") - 1).cast("long")).drop("_n"))
    spans = frames.select("session", F.floor(F.col("idx") / 8).alias("k")).distinct().select("session", (F.col("k") * 8 + 2).alias("start"), (F.col("k") * 8 + 8).alias("stop"))
    found = bodies.relabel(frames, spans, "abcd", 8)
    return found.select("session", "idx", *(F.col(f"{n}.{d}").alias(f"{n}_{d}") for n in "abcd" for d in "xyz"))


EGO = (
    f"{b.EV}, {POS}, fr AS (SELECT CAST(m AS INTEGER) AS session, f AS idx, x, y, x + z - 40 AS nx, y + x - 25 AS ny, z >= 50 AS high FROM ps), un AS (SELECT unit, CAST(10 * k AS DOUBLE) AS cx, CAST(15 * k AS DOUBLE) AS cy FROM (VALUES ('click', 1), ('error', 2), ('purchase', 3), ('signup', 4), ('view', 5)) t(unit, k)), "
    "eg AS (SELECT fr.*, un.unit, (cx - x) * COS(ATAN2(ny - y, nx - x)) + (cy - y) * SIN(ATAN2(ny - y, nx - x)) AS ahead, (cy - y) * COS(ATAN2(ny - y, nx - x)) - (cx - x) * SIN(ATAN2(ny - y, nx - x)) AS aside FROM fr, un), "
    f"bn AS (SELECT session, idx, unit, high, {_at('ahead', -81.37, 80.11, 6)} AS ix, {_at('aside', -81.37, 80.11, 6)} AS iy FROM eg), oc AS (SELECT unit, high, ix, iy, COUNT(*) / 0.05 AS occ FROM bn WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ALL), "
    "sk AS (SELECT CAST(1 + event_id % 7 AS INTEGER) AS session, event_type AS unit, CAST(round_even((us % 86400000000) / 1e6 * 0.05, 0) AS BIGINT) AS idx FROM ev), ct AS (SELECT bn.unit, high, ix, iy, CAST(COUNT(*) AS DOUBLE) AS n_spikes FROM sk JOIN bn ON bn.session = sk.session AND bn.idx = sk.idx AND bn.unit = sk.unit WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ALL)"
)


@query(f"WITH {EGO} SELECT ct.unit, ct.high, ct.ix, ct.iy, n_spikes, {s6('occ', 'occ')}, {s6('n_spikes / occ', 'rate')} FROM ct JOIN oc ON oc.unit = ct.unit AND oc.high = ct.high AND oc.ix = ct.ix AND oc.iy = ct.iy")
def egocentric_rate_maps(spark, sf_dir):
    nose = {"nose_x": F.col("x") + F.col("z") - 40, "nose_y": F.col("y") + F.col("x") - 25, "high": F.col("z") >= 50}
    track = _markers(spark, sf_dir).select(F.col("marker").cast("int").alias("session"), F.col("frame").alias("idx"), "x", "y", *(c.alias(n) for n, c in nose.items()))
    centres = spark.createDataFrame([(u, 10.0 * k, 15.0 * k) for k, u in enumerate(("click", "error", "purchase", "signup", "view"), 1)], "unit string, cx double, cy double")
    at = F.rint(F.col("us") % 86_400_000_000 / 1e6 * 0.05).cast("long")
    trains = b.events(spark, sf_dir).select((1 + F.col("event_id") % 7).cast("int").alias("session"), at.alias("idx"), F.col("event_type").alias("unit"))
    axes = {"ix": (F.col("ahead"), -81.37, 80.11, 6), "iy": (F.col("left"), -81.37, 80.11, 6)}
    found = fields.egocentric_maps(track, trains, centres, axes, 0.05, condition=["high"])
    return found.select("unit", "high", "ix", "iy", "n_spikes", r6(F.col("occ")).alias("occ"), r6(F.col("rate")).alias("rate"))


@query(f"WITH {POS} SELECT p.f AS session, CAST(0 AS BIGINT) AS idx, {s6('p.x - q.x', 'value')} FROM ps p JOIN ps q ON p.f = q.f AND p.m = 2 AND q.m = 1")
def referenced_channel(spark, sf_dir):
    rows = _markers(spark, sf_dir).select(F.col("frame").alias("session"), F.lit(0).cast("long").alias("idx"), F.col("marker").alias("channel"), F.col("x").alias("value"))
    return signal.difference(rows, 2, 1).withColumn("value", r6(F.col("value")))


@query(f"WITH {b.ALL}, s AS (SELECT session, 'view' AS label, start, stop FROM a UNION ALL SELECT session, 'click', start, stop FROM b UNION ALL SELECT session, 'error', start, stop FROM c) SELECT session, label, COUNT(*) AS n_periods, CAST(SUM(stop - start) AS BIGINT) AS total, MIN(start) AS \"first\", MAX(stop) AS \"last\" FROM s GROUP BY session, label")
def state_list(spark, sf_dir):
    return states.listed(b.states(spark, sf_dir))


@query(f"WITH {b.EV} SELECT event_id, CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'view' ELSE event_type END AS event_type FROM ev")
def swapped_states(spark, sf_dir):
    return states.swapped(b.events(spark, sf_dir).select("event_id", "event_type"), "event_type", "view", "click")


@query(f"WITH {b.ALL} SELECT start / 1e6 AS start, stop / 1e6 AS stop FROM a")
def periods_written_and_read(spark, sf_dir):
    """All views of all sessions as a list of periods in seconds, read back."""
    folder = work_folder(spark)
    text_files.write_periods(b.views(spark, sf_dir).select((F.col("start") / 1e6).alias("start"), (F.col("stop") / 1e6).alias("stop")), f"{folder}/views.sts")
    return text_files.read_periods(spark, f"{folder}/views.sts")


@query(f"WITH {b.EV} SELECT ROUND(us / 1e6, 3) + 0.0 AS t, event_type || ' of ' || CAST(user_id AS VARCHAR) AS label FROM ev WHERE event_type = 'purchase'")
def events_written_and_read(spark, sf_dir):
    """All events as an event list in milliseconds, with a comment and blank lines among them, read back by label."""
    folder = work_folder(spark)
    line = F.concat((F.col("us") / 1000).cast("decimal(20, 3)").cast("string"), F.lit("\t"), "event_type", F.lit(" of "), F.col("user_id").cast("string"))
    lines = b.events(spark, sf_dir).select(F.explode(F.array(line, F.when(F.col("event_id") % 7 == 0, "").otherwise("# a comment"))).alias("value"))
    lines.write.text(f"{folder}/session.evt")
    found = text_files.read_events(spark, f"{folder}/session.evt", "purchase", seconds=True)
    return found.select((F.round("t", 3) + F.lit(0.0)).alias("t"), "label")


LAGS = "ps2 AS (SELECT m, f, " + ", ".join(f"COALESCE({fn}({d}{k}) OVER w, 0) AS e{2 * i + j}" if fn else f"{d} AS e{2 * i + j}" for i, (fn, k) in enumerate((("LAG", ""), ("", ""), ("LEAD", ""))) for j, d in enumerate("xy")) + " FROM ps WINDOW w AS (PARTITION BY m ORDER BY f))"


@query(f"WITH {POS}, {LAGS} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, ROUND(SUM(e{i} * e{j}), 1) + 0.0 AS value FROM ps2" for i in range(6) for j in range(i, 6)))
def motion_gram(spark, sf_dir):
    return motion.gram(motion.embedded(_markers(spark, sf_dir), ["x", "y"], 3, ["marker"], "frame")).withColumn("value", F.round("value", 1) + F.lit(0.0))


@query(None)
def motion_scores(spark, sf_dir):
    rows = motion.embedded(_markers(spark, sf_dir), ["x", "y"], 3, ["marker"], "frame")
    _, vectors = motion.components(motion.gram(rows), 2)
    return motion.scores(rows, vectors).select("marker", "frame", *(r6(F.col("score")[k]).alias(f"score_{k}") for k in range(2)))


BASIC = (
    f"{POS}, tr AS (SELECT m, ROW_NUMBER() OVER (PARTITION BY m ORDER BY f) - 1 AS idx, x, y, z FROM ps), sp AS (SELECT *, COALESCE(SQRT(POW(x - LAG(x) OVER w, 2) + POW(y - LAG(y) OVER w, 2)) * 15, 0) AS v FROM tr WINDOW w AS (PARTITION BY m ORDER BY idx)), "
    "sm3 AS (SELECT *, (COALESCE(LAG(v) OVER w, v) + v + COALESCE(LEAD(v) OVER w, v)) / 3 AS s FROM sp WINDOW w AS (PARTITION BY m ORDER BY idx)), md AS (SELECT m, MEDIAN(z) AS level FROM tr WHERE z > 0 GROUP BY m), "
    "lb AS (SELECT sm3.m, idx, CASE WHEN s > 500 THEN 'walk' WHEN z > 1.25 * level THEN 'rear' ELSE 'pause' END AS label FROM sm3 JOIN md ON md.m = sm3.m), gp AS (SELECT *, CASE WHEN idx - LAG(idx) OVER (PARTITION BY m, label ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS new FROM lb), "
    "rn AS (SELECT *, SUM(new) OVER (PARTITION BY m, label ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM gp), pr AS (SELECT m, label, MIN(idx) AS a, MAX(idx) + 1 AS z FROM rn GROUP BY m, label, run HAVING MAX(idx) + 1 - MIN(idx) >= 3)"
)


@query(f"WITH {BASIC} SELECT m AS session, label, {s6('a / 15.0', 'start')}, {s6('z / 15.0', 'stop')} FROM pr")
def basic_states(spark, sf_dir):
    track = _track(spark, sf_dir).select(F.col("marker").alias("session"), "idx", "x", "y", F.col("z").alias("head_z"))
    found = behaviour.basic_states(track, 15.0, walk=500.0, least=0.2, width=1 << 16)
    return found.select("session", "label", r6(F.col("start")).alias("start"), r6(F.col("stop")).alias("stop"))


@query(None)
def band_periods(spark, sf_dir):
    return behaviour.band_periods(b.samples(spark, sf_dir).select("session", "idx", "value"), 1.0, (0.1, 0.2), 3000.0, 64, 64)


@query(f"WITH {b.ALL} SELECT session, start, stop FROM b WHERE session IN (1, 2) UNION ALL SELECT session, start, stop FROM a WHERE session = 0")
def session_tables_written_and_read(spark, sf_dir):
    """Views of all sessions are saved, those of two sessions replaced by clicks, and three sessions read."""
    folder = work_folder(spark)
    tables.save(b.views(spark, sf_dir), folder, "states")
    tables.save(b.clicks(spark, sf_dir).where("session IN (1, 2)"), folder, "states")
    return tables.load(spark, folder, "states", [0, 1, 2])
