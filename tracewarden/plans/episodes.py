"""Episodes, incidents and evidence: islands of unusual points, their windows, baselines, order and causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import scalars as S
from tracewarden.operators import graph, intervals, ranks, stats
from tracewarden.plans.features import UNIT
from tracewarden.plans.registry import EVENTS, HOUR, POINTS, events, points, query
from tracewarden.session import settled

GAP = 24
ISLANDS = f"""{POINTS}, {UNIT}, q AS (SELECT quantile_cont(s, 0.75) AS a FROM u), ab AS (SELECT u.* FROM u, q WHERE s >= a),
il AS (SELECT *, sum(CASE WHEN h - p <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY h)::BIGINT AS island FROM (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY h) AS p FROM ab)),
ep AS (SELECT user_id, island, min(h) AS a, max(h) AS b, count(*) AS n, max(s) AS peak, avg(s) AS mean_s, arg_min(h, (-s, h)) AS peak_h FROM il GROUP BY 1, 2)"""
#: Incidents: episodes of users in groups of fifty, with their place in the group.
INCIDENTS = ISLANDS + ", inc AS (SELECT *, user_id % 10 AS grp, user_id * 10000 + island AS id FROM ep)"


def unusual(spark, d) -> DataFrame:
    """Points at or above the upper quartile of the unit rank, numbered by island."""
    marked = ranks.rank_to_unit(settled(points(spark, d), "points"), "m", "s", [0.75]).where(F.col("s") >= F.col("edges")[0]).drop("edges")
    return intervals.islands(marked, ["user_id"], "h", F.lit(GAP))


def episodes_of(spark, d) -> DataFrame:
    return unusual(spark, d).groupBy("user_id", "island").agg(
        F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n"), F.max("s").alias("peak"), F.avg("s").alias("mean_s"), F.min_by("h", F.struct((-F.col("s")).alias("x"), "h")).alias("peak_h")
    )


def incidents_of(spark, d) -> DataFrame:
    return episodes_of(spark, d).withColumn("grp", F.col("user_id") % 10).withColumn("id", F.col("user_id") * 10000 + F.col("island"))


@query(f"WITH {ISLANDS} SELECT user_id, island, a, b, n, round(peak, 6) AS peak, round(mean_s, 6) AS mean_s, peak_h FROM ep")
def episodes(spark, d):
    return episodes_of(spark, d).select("user_id", "island", "a", "b", "n", F.round("peak", 6).alias("peak"), F.round("mean_s", 6).alias("mean_s"), "peak_h")


@query(f"WITH {ISLANDS}, nx AS (SELECT user_id, h, lead(h) OVER (PARTITION BY user_id ORDER BY h) AS nh FROM pt) SELECT ep.user_id, island, coalesce(nh, b + 1) AS recovery FROM ep JOIN nx ON nx.user_id = ep.user_id AND nx.h = ep.b")
def episode_recovery(spark, d):
    after = points(spark, d).select("user_id", F.col("h").alias("b"), F.lead("h").over(Window.partitionBy("user_id").orderBy("h")).alias("nh"))
    return episodes_of(spark, d).join(after, ["user_id", "b"]).select("user_id", "island", F.coalesce("nh", F.col("b") + 1).alias("recovery"))


@query(f"""WITH {INCIDENTS}, t AS (SELECT id, event_type, count(*) AS c FROM inc JOIN ev ON ev.user_id = inc.user_id AND ev.us // {HOUR} BETWEEN a AND b GROUP BY 1, 2)
SELECT id, string_agg(event_type, ',' ORDER BY event_type) AS signature FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, event_type) AS r FROM t) WHERE r <= 3 GROUP BY 1""")
def episode_signature(spark, d):
    inside = _inside(spark, d).groupBy("id", "event_type").agg(F.count("*").alias("c"))
    top = ranks.top_k(inside, ["id"], [F.desc("c"), F.col("event_type")], 3)
    return top.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("signature"))


def _inside(spark, d) -> DataFrame:
    rows = events(spark, d).withColumn("h", F.floor(F.col("us") / HOUR))
    return intervals.point_join(rows, incidents_of(spark, d).select("user_id", "id", "a", "b", "grp"), ["user_id"], "h", ("a", "b"), 48.0)


AFFINITY = """pr AS (SELECT x.id AS x, y.id AS y, greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) / greatest(x.b - x.a, y.b - y.a, 1) AS t, CASE WHEN x.user_id = y.user_id THEN 1.0 ELSE 0.0 END AS n, 1 - abs(x.peak - y.peak) AS e FROM inc x JOIN inc y ON x.grp = y.grp AND x.id < y.id AND x.a <= y.b + 30 AND y.a <= x.b + 30),
ed AS (SELECT x, y, 0.25 * t + 0.35 * n + 0.20 / (2 - n) + 0.10 * e AS w FROM pr)"""


def affinity_edges(spark, d, least: float = 0.45) -> DataFrame:
    """Pairs of incidents of a group that are at most 30 hours apart, with their affinity: a band join on cells of time."""
    i = incidents_of(spark, d)
    x = i.select("grp", F.col("id").alias("x"), F.col("user_id").alias("ux"), F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("peak").alias("xp"), (F.col("b") + 30).alias("xe"))
    y = i.select("grp", F.col("id").alias("y"), F.col("user_id").alias("uy"), F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("peak").alias("yp"), (F.col("b") + 30).alias("ye"))
    near = intervals.interval_join(x, y, ["grp"], ("xa", "xe"), ("ya", "ye"), 96.0).where("x < y")
    t = S.overlap_ratio(F.col("xa"), F.col("xb"), F.col("ya"), F.col("yb"), 1.0)
    n = F.when(F.col("ux") == F.col("uy"), 1.0).otherwise(0.0)
    w = 0.25 * t + 0.35 * n + F.lit(0.20) / (2 - n) + 0.10 * (1 - F.abs(F.col("xp") - F.col("yp")))
    return near.select("x", "y", w.alias("w")).where(F.col("w") >= least)


@query(f"WITH {INCIDENTS}, {AFFINITY} SELECT x, y, round(w, 6) AS affinity FROM ed WHERE w >= 0.45")
def incident_affinity_edges(spark, d):
    return affinity_edges(spark, d).select("x", "y", F.round("w", 6).alias("affinity"))


@query(f"""WITH RECURSIVE {INCIDENTS}, {AFFINITY}, e2 AS (SELECT x AS s, y AS t FROM ed WHERE w >= 0.60 UNION SELECT y, x FROM ed WHERE w >= 0.60), r AS (SELECT s AS node, s AS root FROM e2 UNION SELECT e2.t, r.root FROM r JOIN e2 ON e2.s = r.node WHERE r.root < e2.t)
SELECT node, min(root) AS component FROM r GROUP BY 1""")
def incident_components(spark, d):
    edges = affinity_edges(spark, d, 0.60).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return graph.components(edges).select("node", "component")


@query(f"WITH {INCIDENTS} SELECT grp, h, string_agg(DISTINCT il.user_id::VARCHAR, ',' ORDER BY il.user_id::VARCHAR) AS nodes, round(avg(s), 6) AS mean_score FROM il JOIN inc ON il.user_id = inc.user_id AND il.island = inc.island GROUP BY 1, 2")
def incident_timeline(spark, d):
    u = unusual(spark, d).withColumn("grp", F.col("user_id") % 10)
    return u.groupBy("grp", "h").agg(F.array_join(F.sort_array(F.collect_set(F.col("user_id").cast("string"))), ",").alias("nodes"), F.round(F.avg("s"), 6).alias("mean_score"))


FIRST = INCIDENTS + ", ft AS (SELECT grp, user_id % 25 AS node, min(a) AS first_time FROM inc GROUP BY 1, 2), tg AS (SELECT n_nationkey::BIGINT AS src, (n_nationkey * 7 + 3) % 25::BIGINT AS dst FROM nation WHERE n_nationkey <> (n_nationkey * 7 + 3) % 25)"


def first_times(spark, d) -> DataFrame:
    return incidents_of(spark, d).groupBy("grp", (F.col("user_id") % 25).alias("node")).agg(F.min("a").alias("first_time"))


def ring(spark) -> DataFrame:
    """A fixed sparse graph over 25 nodes."""
    return spark.range(25).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 25).alias("dst")).where("src <> dst")


@query(f"WITH {FIRST} SELECT x.grp, src, dst, y.first_time - x.first_time AS lag, y.first_time >= x.first_time AS consistent FROM tg JOIN ft x ON x.node = src JOIN ft y ON y.node = dst AND y.grp = x.grp")
def propagation_edges(spark, d):
    return graph.propagation(ring(spark), first_times(spark, d), ["grp"]).select("grp", "src", "dst", "lag", "consistent")


@query(f"WITH {FIRST}, l AS (SELECT src, dst, count(*) AS n, count(*) FILTER (y.first_time > x.first_time) AS n_after FROM tg JOIN ft x ON x.node = src JOIN ft y ON y.node = dst AND y.grp = x.grp GROUP BY 1, 2) SELECT src, dst, n, n_after, round((n_after + 1) / (n + 2) * least(1, n / 10), 6) AS weight FROM l")
def lead_lag_weights(spark, d):
    return graph.lead_lag(ring(spark), first_times(spark, d), ["grp"]).withColumn("weight", F.round("weight", 6))


@query(f"WITH {FIRST}, w AS (SELECT x.grp, x.node, count(*) FILTER (y.first_time > x.first_time) AS outgoing, count(*) AS n FROM tg JOIN ft x ON x.node = src JOIN ft y ON y.node = dst AND y.grp = x.grp GROUP BY 1, 2) SELECT grp, node, round(outgoing / n, 6) AS outflow FROM w")
def outgoing_propagation(spark, d):
    p = graph.propagation(ring(spark), first_times(spark, d), ["grp"])
    return p.groupBy("grp", F.col("src").alias("node")).agg(F.round(F.count_if(F.col("lag") > 0) / F.count("*"), 6).alias("outflow"))


ORDER = f"""WITH {EVENTS}, o AS (SELECT user_id % 10 AS grp, user_id, min(us) AS first_us, min(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END) AS prio FROM ev WHERE value > 120 GROUP BY 1, 2)"""


@query(f"{ORDER} SELECT grp, user_id, row_number() OVER w AS place, lead(first_us) OVER w - first_us AS gap_us FROM o WINDOW w AS (PARTITION BY grp ORDER BY first_us, prio, user_id)")
def first_mover_order(spark, d):
    w = Window.partitionBy("grp").orderBy("first_us", "prio", "user_id")
    return _firsts(spark, d).select("grp", "user_id", F.row_number().over(w).cast("long").alias("place"), (F.lead("first_us").over(w) - F.col("first_us")).alias("gap_us"))


def _firsts(spark, d) -> DataFrame:
    prio = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    return events(spark, d).where("value > 120").groupBy((F.col("user_id") % 10).alias("grp"), "user_id").agg(F.min("us").alias("first_us"), F.min(prio).alias("prio"))


@query(f"{ORDER}, r AS (SELECT grp, user_id, dense_rank() OVER (PARTITION BY grp ORDER BY prio) AS r, count(*) OVER (PARTITION BY grp) AS n FROM o), m AS (SELECT *, max(r) OVER (PARTITION BY grp) AS m FROM r) SELECT grp, user_id, round(CASE WHEN n = 1 THEN 1.0 WHEN m = 1 THEN 0.0 ELSE 1 - (r - 1) / (m - 1) END, 6) AS priority FROM m")
def rank_priority(spark, d):
    return ranks.rank_priority(_firsts(spark, d), ["grp"], "prio", "priority").select("grp", "user_id", F.round("priority", 6).alias("priority"))


@query(f"{ORDER} SELECT grp, user_id, round(CASE WHEN count(*) OVER (PARTITION BY grp) = 1 THEN 1.0 ELSE 1 - (row_number() OVER (PARTITION BY grp ORDER BY first_us, user_id) - 1) / (count(*) OVER (PARTITION BY grp) - 1) END, 6) AS earliness FROM o")
def earliest_first(spark, d):
    return ranks.earliest_first(_firsts(spark, d), ["grp"], "first_us", "user_id", "earliness").select("grp", "user_id", F.round("earliness", 6).alias("earliness"))


@query(f"WITH {INCIDENTS} SELECT id, round(CASE WHEN max(peak) OVER w > min(peak) OVER w THEN (peak - min(peak) OVER w) / (max(peak) OVER w - min(peak) OVER w) ELSE 0 END, 6) AS scaled FROM inc WINDOW w AS (PARTITION BY grp)")
def min_max_within(spark, d):
    return ranks.min_max(incidents_of(spark, d), ["grp"], "peak", "scaled").select("id", F.round("scaled", 6).alias("scaled"))


@query(f"WITH {POINTS} SELECT user_id, h, row_number() OVER (ORDER BY m, user_id, h) AS point_rank FROM pt")
def point_rank(spark, d):
    return ranks.row_numbers(points(spark, d).select("m", "user_id", "h"), ["m", "user_id", "h"], "point_rank").select("user_id", "h", "point_rank")


@query(f"WITH {POINTS} SELECT user_id, h, lead(h) OVER (PARTITION BY user_id ORDER BY h) AS next_h FROM pt QUALIFY next_h IS NOT NULL")
def temporal_edges(spark, d):
    return points(spark, d).select("user_id", "h", F.lead("h").over(Window.partitionBy("user_id").orderBy("h")).alias("next_h")).where("next_h is not null")


@query(f"WITH {POINTS} SELECT user_id, h, round(m, 6) AS m FROM pt ORDER BY pt.m DESC, user_id, h LIMIT 40")
def top_points(spark, d):
    return points(spark, d).orderBy(F.desc("m"), "user_id", "h").limit(40).select("user_id", "h", F.round("m", 6).alias("m"))


@query(f"""WITH {INCIDENTS}, f AS (SELECT id, avg(value) AS m, max(value) AS mx, min(value) AS mn, quantile_cont(value, 0.95) AS p95, stddev_pop(value) AS sd, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'view') AS n_view FROM inc JOIN ev ON ev.user_id = inc.user_id AND ev.us // {HOUR} BETWEEN a AND b GROUP BY 1)
SELECT id, round(m, 6) AS m, mx, mn, round(p95, 6) AS p95, round(sd, 6) AS sd, n, n_error, n_view FROM f""")
def rca_features(spark, d):
    g = _inside(spark, d).groupBy("id").agg(F.avg("value").alias("m"), F.max("value").alias("mx"), F.min("value").alias("mn"), F.percentile("value", 0.95).alias("p95"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"), F.count_if(F.col("event_type") == "view").alias("n_view"))
    return g.select("id", F.round("m", 6).alias("m"), "mx", "mn", F.round("p95", 6).alias("p95"), F.round("sd", 6).alias("sd"), "n", "n_error", "n_view")


DAYS = f"{EVENTS}, dw AS (SELECT user_id, event_type, us, event_id, value, us // {24 * HOUR} >= 19743 AS inside FROM ev)"


def windowed(spark, d) -> DataFrame:
    """Events with whether they are in the incident window, the days from the 21st on."""
    return events(spark, d).withColumn("inside", F.floor(F.col("us") / (24 * HOUR)) >= 19743)


@query(f"""WITH {DAYS}, b AS (SELECT event_type, quantile_cont(value, 0.5) AS bm, quantile_cont(value, 0.95) AS bp, count(*) AS n_base FROM dw WHERE NOT inside GROUP BY 1), s AS (SELECT event_type, quantile_cont(abs(value - bm), 0.5) AS mad FROM dw JOIN b USING (event_type) WHERE NOT inside GROUP BY 1),
o AS (SELECT event_type, max(value) AS peak, min(value) AS trough, count(*) AS n_inside, arg_min(us, (-value, us)) AS peak_us FROM dw WHERE inside GROUP BY 1)
SELECT event_type, peak, trough, n_inside, n_base, peak_us, round(bm, 6) AS base_median, round(bp, 6) AS base_p95, round((peak - bm) / greatest(abs(bm), 1e-6), 6) AS relative_change, round((bm - trough) / greatest(abs(bm), 1e-6), 6) AS drop_ratio, round(greatest(-50, least(50, (peak - bm) / greatest(1.4826 * mad, 1e-6))), 6) AS z FROM o JOIN b USING (event_type) JOIN s USING (event_type)""")
def baseline_incident_stats(spark, d):
    x = stats.baseline_stats(windowed(spark, d), ["event_type"], "value", "inside", "us")
    return x.select("event_type", "peak", "trough", "n_inside", "n_base", F.col("peak_time").alias("peak_us"), *(F.round(c, 6).alias(c) for c in ("base_median", "base_p95", "relative_change", "drop_ratio", "z")))


@query(f"""WITH {EVENTS}, z AS (SELECT user_id, us, event_id, (value - avg(value) OVER (PARTITION BY user_id)) / greatest(1e-9, stddev_pop(value) OVER (PARTITION BY user_id)) AS z FROM ev), c AS (SELECT user_id, us, event_id, sum(z - 0.5) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM z)
SELECT user_id, us AS change_us, round(s, 5) AS change_sum FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, us, event_id) AS r FROM c) WHERE r = 1 AND s > 0""")
def cusum_change_point(spark, d):
    whole = Window.partitionBy("user_id")
    z = events(spark, d).withColumn("z", (F.col("value") - F.avg("value").over(whole)) / F.greatest(F.lit(1e-9), F.stddev_pop("value").over(whole)))
    return stats.cusum(z, ["user_id"], "us", "event_id", "z").select("user_id", F.col("change_time").alias("change_us"), F.round("change_sum", 5).alias("change_sum"))


@query(f"WITH {DAYS}, s AS (SELECT user_id, event_type, bool_or(inside) AS now, bool_or(NOT inside) AS before FROM dw GROUP BY 1, 2) SELECT user_id, event_type, CASE WHEN now THEN 'appeared' ELSE 'disappeared' END AS change FROM s WHERE now <> before")
def series_appeared_disappeared(spark, d):
    return stats.appeared_and_gone(windowed(spark, d), ["user_id"], "event_type", "inside")


@query(f"""WITH {DAYS}, b AS (SELECT user_id, quantile_cont(value, 0.5) AS med, min(value) AS lo, max(value) AS hi FROM dw WHERE NOT inside GROUP BY 1)
SELECT user_id, round(med, 6) AS med, lo, hi, round(CASE WHEN max(value) - med >= med - min(value) THEN max(value) - med ELSE min(value) - med END, 6) AS delta, min(us) FILTER (value < lo OR value > hi) AS first_outside FROM dw JOIN b USING (user_id) WHERE inside GROUP BY user_id, med, lo, hi""")
def value_change_events(spark, d):
    rows = windowed(spark, d)
    base = rows.where("not inside").groupBy("user_id").agg(F.percentile("value", 0.5).alias("med"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    up, down = F.max("value") - F.col("med"), F.col("med") - F.min("value")
    delta = F.when(up >= down, up).otherwise(-down)
    outside = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    out = rows.where("inside").join(base, "user_id").groupBy("user_id", "med", "lo", "hi").agg(F.round(delta, 6).alias("delta"), F.min(F.when(outside, F.col("us"))).alias("first_outside"))
    return out.withColumn("med", F.round("med", 6))


@query(f"WITH {EVENTS}, z AS (SELECT user_id, us, sum(CASE WHEN us - p <= {48 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us)::BIGINT AS run FROM (SELECT user_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS p FROM ev WHERE value < 20)) SELECT user_id, run, min(us) AS a, max(us) AS b, count(*) AS n FROM z GROUP BY 1, 2")
def quality_zero_runs(spark, d):
    low = events(spark, d).where("value < 20").select("user_id", "us")
    return intervals.islands(low, ["user_id"], "us", F.lit(48 * HOUR), "run").groupBy("user_id", "run").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n"))


@query(f"WITH {EVENTS}, m AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS med FROM ev GROUP BY 1, 2) SELECT user_id, event_type, count(*) AS n_drops FROM ev JOIN m USING (user_id, event_type) WHERE value < 0.8 * med GROUP BY 1, 2")
def sample_drop_points(spark, d):
    e = events(spark, d)
    med = e.groupBy("user_id", "event_type").agg(F.percentile("value", 0.5).alias("med"))
    return e.join(med, ["user_id", "event_type"]).where(F.col("value") < 0.8 * F.col("med")).groupBy("user_id", "event_type").agg(F.count("*").alias("n_drops"))


@query(f"""WITH {EVENTS}, g AS (SELECT event_type, us // {24 * HOUR} AS day, user_id % 8 AS peer, avg(value) AS v FROM ev GROUP BY 1, 2, 3), m AS (SELECT event_type, day, quantile_cont(v, 0.5) AS med, count(*) AS n FROM g GROUP BY 1, 2), dv AS (SELECT event_type, day, quantile_cont(abs(v - med), 0.5) AS mad FROM g JOIN m USING (event_type, day) GROUP BY 1, 2),
c AS (SELECT event_type, day, peer, least(50, abs(v - med) / greatest(mad, 1e-6)) AS c FROM g JOIN m USING (event_type, day) JOIN dv USING (event_type, day) WHERE n >= 4) SELECT event_type, day, peer, round(c, 5) AS c, round(0.5 + (row_number() OVER (PARTITION BY peer ORDER BY round(c, 9), day, event_type) - 0.5) / count(*) OVER (PARTITION BY peer), 6) AS factor FROM c""")
def cross_region_consistency(spark, d):
    key = ["event_type", "day"]
    g = events(spark, d).groupBy("event_type", F.floor(F.col("us") / (24 * HOUR)).alias("day"), (F.col("user_id") % 8).alias("peer")).agg(F.avg("value").alias("v"))
    m = g.groupBy(*key).agg(F.percentile("v", 0.5).alias("med"), F.count("*").alias("n"))
    far = g.join(m, key).where("n >= 4").withColumn("x", F.abs(F.col("v") - F.col("med")))
    c = far.join(far.groupBy(*key).agg(F.percentile("x", 0.5).alias("mad")), key).withColumn("c", F.least(F.lit(50.0), F.col("x") / F.greatest("mad", F.lit(1e-6))))
    w = Window.partitionBy("peer")
    place = F.row_number().over(w.orderBy(F.round("c", 9), "day", "event_type"))
    return c.select("event_type", "day", "peer", F.round("c", 5).alias("c"), F.round(0.5 + (place - 0.5) / F.count("*").over(w), 6).alias("factor"))


DAILY = f"{EVENTS}, dy AS (SELECT user_id % 10 AS grp, us // {24 * HOUR} AS day, avg(value) AS x, count(*)::DOUBLE AS y FROM ev GROUP BY 1, 2)"


@query(f"""WITH {DAILY}, p AS (SELECT a.grp, b.day - a.day AS lag, a.x, b.y FROM dy a JOIN dy b ON a.grp = b.grp AND b.day - a.day BETWEEN 0 AND 5 WHERE b.day < 19743), c AS (SELECT grp, lag, count(*) AS n, corr(x, y) AS r, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM p GROUP BY 1, 2)
SELECT grp, lag::INTEGER AS lag, n, round(r, 5) AS r, round(slope, 5) AS slope, round(intercept, 4) AS intercept FROM c WHERE n >= 3 AND r IS NOT NULL AND NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(abs(r), 9) DESC, lag) = 1""")
def lagged_regression(spark, d):
    dy = events(spark, d).groupBy((F.col("user_id") % 10).alias("grp"), F.floor(F.col("us") / (24 * HOUR)).alias("day")).agg(F.avg("value").alias("x"), F.count("*").cast("double").alias("y"))
    best = stats.lagged_regression(dy, ["grp"], "day", "x", "y", 5, F.col("day") < 19743)
    return best.select("grp", "lag", "n", F.round("r", 5).alias("r"), F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"WITH {EVENTS}, s AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd, count(*) AS n FROM ev GROUP BY 1, 2) SELECT user_id, round(max(abs(value - med) / sd), 6) AS max_z FROM ev JOIN s USING (user_id, event_type) WHERE n >= 3 AND sd > 0 GROUP BY 1")
def node_max_z(spark, d):
    e, key = events(spark, d), ["user_id", "event_type"]
    s = e.groupBy(*key).agg(F.percentile("value", 0.5).alias("med"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n")).where("n >= 3 and sd > 0")
    return e.join(s, key).groupBy("user_id").agg(F.round(F.max(F.abs(F.col("value") - F.col("med")) / F.col("sd")), 6).alias("max_z"))


@query(f"WITH {EVENTS}, w AS (SELECT event_id, value, quantile_cont(value, 0.25) OVER w AS a, quantile_cont(value, 0.5) OVER w AS b, quantile_cont(value, 0.75) OVER w AS c, count(value) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {72 * HOUR} PRECEDING AND 1 PRECEDING)) SELECT event_id, round(CASE WHEN n >= 5 AND c - a >= 1e-9 THEN (value - b) / (c - a) END, 6) AS z FROM w")
def trailing_robust_z(spark, d):
    rows = events(spark, d).withColumn("t", F.timestamp_micros("us"))
    return stats.trailing_z(rows, ["user_id"], "t", "value", 72, 5).select("event_id", F.round("z", 6).alias("z"))
