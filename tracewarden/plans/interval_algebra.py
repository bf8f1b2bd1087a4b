"""Interval queries: predictions and truth as intervals, matched, split, clamped, merged, filled and anchored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators import evidence, graph, intervals, stats
from tracewarden.plans.registry import EVENTS, HOUR, events, query

#: Predictions: hours with a value above 100, islands of at most 12 hours; truth: above 60, at most 6 hours. Groups of ten users.


def _side(name: str, least: int, gap: int) -> str:
    return (
        f"{name}0 AS (SELECT user_id % 10 AS grp, us / {HOUR}.0 AS t FROM ev WHERE value > {least}), "
        f"{name} AS (SELECT grp, grp * 100000 + isl AS id, min(t) AS a, max(t) + 0.5 AS b, count(*) AS n FROM (SELECT grp, t, sum(CASE WHEN t - p <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY t)::BIGINT AS isl FROM (SELECT grp, t, lag(t) OVER (PARTITION BY grp ORDER BY t) AS p FROM {name}0)) GROUP BY grp, isl)"
    )


PRED, TRUTH = _side("pr", 100, 12), _side("tu", 60, 6)


def side(spark, d, least: int, gap: int) -> DataFrame:
    """Intervals in hours: grp, id, a, b, n."""
    rows = events(spark, d).where(F.col("value") > least).select((F.col("user_id") % 10).alias("grp"), (F.col("us") / F.lit(float(HOUR))).alias("t"))
    runs = intervals.islands(rows, ["grp"], "t", F.lit(float(gap)))
    return runs.groupBy("grp", "island").agg(F.min("t").alias("a"), (F.max("t") + 0.5).alias("b"), F.count("*").alias("n")).select("grp", (F.col("grp") * 100000 + F.col("island")).alias("id"), "a", "b", "n")


def predictions(spark, d):
    return side(spark, d, 100, 12)


def truth(spark, d):
    return side(spark, d, 60, 6)


DICE = "CASE WHEN (pr.b - pr.a) + (tu.b - tu.a) > 0 THEN 2.0 * greatest(0, least(pr.b, tu.b) - greatest(pr.a, tu.a)) / ((pr.b - pr.a) + (tu.b - tu.a)) ELSE 0 END"
BEST = f"WITH {EVENTS}, {PRED}, {TRUTH}, bm AS (SELECT pr.id AS p, tu.id AS t, {DICE} AS dice FROM pr JOIN tu ON pr.grp = tu.grp AND pr.a <= tu.b AND tu.a <= pr.b), bb AS (SELECT p, t, dice FROM bm QUALIFY row_number() OVER (PARTITION BY p ORDER BY dice DESC, t) = 1)"


def matched(spark, d) -> DataFrame:
    p = predictions(spark, d).select("grp", F.col("id").alias("p"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    t = truth(spark, d).select("grp", F.col("id").alias("t"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    return intervals.best_match(p, t, ["grp"], "p", "t", ("pa", "pb"), ("ta", "tb"), 12.0)


@query(f"{BEST} SELECT p, t, round(dice, 6) AS dice FROM bb")
def dice_best_match(spark, d):
    return matched(spark, d).select("p", "t", F.round("dice", 6).alias("dice"))


@query(f"{BEST} SELECT count(*) AS n, count(*) FILTER (dice >= 0.4) AS hits, round(sum(CASE WHEN dice >= 0.4 THEN 0.7 + 0.3 * dice ELSE 0 END) / (SELECT count(*) FROM tu) * 40 * (0.7 + 0.3 * count(*) FILTER (dice >= 0.4) / (SELECT count(*) FROM pr)), 5) AS score FROM bb")
def proxy_score(spark, d):
    m = matched(spark, d)
    n_t, n_p = truth(spark, d).agg(F.count("*")).scalar(), predictions(spark, d).agg(F.count("*")).scalar()
    hit = F.col("dice") >= 0.4
    x = m.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.sum(F.when(hit, 0.7 + 0.3 * F.col("dice")).otherwise(0.0)).alias("s")).withColumn("nt", n_t).withColumn("np", n_p)
    return x.select("n", "hits", F.round(F.col("s") / F.col("nt") * 40 * (0.7 + 0.3 * F.col("hits") / F.col("np")), 5).alias("score"))


@query(f"{BEST} SELECT tu.grp, count(DISTINCT tu.id) AS n, count(DISTINCT bb.t) AS covered FROM tu LEFT JOIN bb ON bb.t = tu.id AND dice >= 0.4 GROUP BY 1")
def coverage_rate(spark, d):
    good = matched(spark, d).where("dice >= 0.4").select(F.col("t").alias("id")).distinct().withColumn("hit", F.lit(1))
    return truth(spark, d).join(good, "id", "left").groupBy("grp").agg(F.count("*").alias("n"), F.count("hit").alias("covered"))


@query(f"WITH {EVENTS}, {PRED} SELECT id, i AS piece, round(a + i * 24.0, 6) AS a, round(least(b, a + i * 24.0 + 24.0), 6) AS b FROM (SELECT *, unnest(range(0, greatest(1, ceil((b - a) / 24.0))::INTEGER))::INTEGER AS i FROM pr) WHERE i = 0 OR least(b, a + i * 24.0 + 24.0) - (a + i * 24.0) >= 1.0")
def retime_split(spark, d):
    x = intervals.split_intervals(predictions(spark, d), "a", "b", 24.0, 1.0)
    return x.select("id", "piece", F.round("piece_start", 6).alias("a"), F.round("piece_end", 6).alias("b"))


@query(f"WITH {EVENTS}, {PRED} SELECT id, round(a, 6) AS a, round(a + greatest(2.0, least(36.0, b - a)), 6) AS b FROM pr")
def clamp_duration(spark, d):
    return predictions(spark, d).select("id", F.round("a", 6).alias("a"), F.round(intervals.clamp_duration(F.col("a"), F.col("b"), 2.0, 36.0), 6).alias("b"))


@query(f"WITH {EVENTS}, {PRED} SELECT id, round(CASE WHEN b - a < 1 THEN a - 0.5 ELSE a END, 6) AS a, round(CASE WHEN b - a < 1 THEN b + 0.5 ELSE b END, 6) AS b, b - a < 1 AS widened FROM pr")
def widen_windows(spark, d):
    narrow = F.col("b") - F.col("a") < 1
    return predictions(spark, d).select("id", F.round(F.when(narrow, F.col("a") - 0.5).otherwise(F.col("a")), 6).alias("a"), F.round(F.when(narrow, F.col("b") + 0.5).otherwise(F.col("b")), 6).alias("b"), narrow.alias("widened"))


BOTH = f"{EVENTS}, {PRED}, {TRUTH}, bo AS (SELECT grp, a, b FROM pr UNION ALL SELECT grp, a, b FROM tu), mk AS (SELECT *, max(b) OVER (PARTITION BY grp ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM bo), sg AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY a, b) AS s FROM mk), un AS (SELECT grp, s, min(a) AS a, max(b) AS b, count(*) AS n FROM sg GROUP BY 1, 2)"


def both_sides(spark, d) -> DataFrame:
    return predictions(spark, d).select("grp", "a", "b").unionByName(truth(spark, d).select("grp", "a", "b"))


@query(f"WITH {BOTH} SELECT grp, round(a, 6) AS a, round(b, 6) AS b, n FROM un")
def interval_union_segments(spark, d):
    return intervals.union_segments(both_sides(spark, d), ["grp"], "a", "b").select("grp", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "n")


@query(f"WITH {BOTH} SELECT event_id FROM ev JOIN un ON ev.user_id % 10 = un.grp AND us / {HOUR}.0 BETWEEN a AND b WHERE event_type = 'error'")
def points_in_segments(spark, d):
    seg = intervals.union_segments(both_sides(spark, d), ["grp"], "a", "b").select("grp", "a", "b")
    pts = events(spark, d).where("event_type = 'error'").select("event_id", (F.col("user_id") % 10).alias("grp"), (F.col("us") / F.lit(float(HOUR))).alias("t"))
    return intervals.point_join(pts, seg, ["grp"], "t", ("a", "b"), 24.0).select("event_id")


@query(
    f"WITH RECURSIVE {EVENTS}, {PRED}, {TRUTH}, bo AS (SELECT grp, id, a, b FROM pr UNION ALL SELECT grp, -id, a, b FROM tu), o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY b, a, id) AS r FROM bo), "
    "f AS (SELECT grp, r, id, b AS last, TRUE AS kept FROM o WHERE r = 1 UNION ALL SELECT o.grp, o.r, o.id, CASE WHEN o.a >= f.last THEN o.b ELSE f.last END, o.a >= f.last FROM f JOIN o ON o.grp = f.grp AND o.r = f.r + 1) SELECT grp, id FROM f WHERE kept"
)
def disjoint_subset(spark, d):
    both = predictions(spark, d).select("grp", "id", "a", "b").unionByName(truth(spark, d).select("grp", (-F.col("id")).alias("id"), "a", "b"))
    return intervals.disjoint_subset(both, ["grp"], "a", "b", "id").select("grp", "id")


@query(f"WITH {EVENTS}, {PRED}, m AS (SELECT *, max(b) OVER (PARTITION BY grp ORDER BY a, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM pr), s AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY a, id ROWS UNBOUNDED PRECEDING) AS c FROM m) SELECT grp, min(id) AS id, round(min(a), 6) AS a, round(max(b), 6) AS b, count(*) AS n FROM s GROUP BY grp, c")
def merge_adjacent(spark, d):
    """Incidents at most 20 hours apart become one: band join, components, aggregation."""
    p = predictions(spark, d)
    x = p.select("grp", F.col("id").alias("x"), F.col("a").alias("xa"), (F.col("b") + 20).alias("xb"))
    y = p.select("grp", F.col("id").alias("y"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    near = intervals.interval_join(x, y, ["grp"], ("xa", "xb"), ("ya", "yb"), 48.0).where("x <> y")
    comp = graph.components(near.select(F.col("x").alias("src"), F.col("y").alias("dst"))).withColumnRenamed("node", "id")
    whole = p.join(comp, "id", "left").withColumn("root", F.coalesce("component", "id"))
    return whole.groupBy("grp", "root").agg(F.min("id").alias("id"), F.round(F.min("a"), 6).alias("a"), F.round(F.max("b"), 6).alias("b"), F.count("*").alias("n")).drop("root")


SLOTS = "sl AS (SELECT g.grp, i * 24.0 AS sa, i * 24.0 + 24.0 AS sb, i FROM (SELECT DISTINCT grp FROM pr) g, (SELECT unnest(range((SELECT min(us) // 86400000000 FROM ev), (SELECT max(us) // 86400000000 FROM ev) + 1))::BIGINT AS i)), fr AS (SELECT * FROM sl WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.grp = sl.grp AND pr.a <= sb AND sa <= pr.b))"


@query(f"WITH {EVENTS}, {PRED}, {SLOTS} SELECT grp, i AS day, (SELECT arg_min(id, (round(abs((sa + sb) / 2 - (a + b) / 2), 9), a)) FROM pr WHERE pr.grp = fr.grp) AS source FROM fr")
def timeline_gap_fill(spark, d):
    """Free days of each group with the prediction whose middle is nearest: an anti-join on cells, then an as-of join both ways."""
    p = predictions(spark, d).select("grp", "id", "a", "b")
    bounds = events(spark, d).agg(F.min(F.floor(F.col("us") / (24 * HOUR))).alias("lo"), F.max(F.floor(F.col("us") / (24 * HOUR))).alias("hi")).select(F.struct("lo", "hi")).scalar()
    days = p.select("grp").distinct().withColumn("r", bounds).select("grp", F.explode(F.sequence("r.lo", "r.hi")).alias("day"))
    slots = days.withColumn("sa", F.col("day") * 24.0).withColumn("sb", F.col("day") * 24.0 + 24.0)
    taken = intervals.interval_join(slots, p, ["grp"], ("sa", "sb"), ("a", "b"), 24.0, "left_semi").select("grp", "day")
    free = slots.join(taken, ["grp", "day"], "left_anti").select("grp", "day", (F.col("day") * 24.0 + 12.0).alias("at"))
    return intervals.asof(free, p.select("grp", ((F.col("a") + F.col("b")) / 2).alias("at"), "id"), ["grp"], "at", ["id"], "nearest").select("grp", "day", F.col("id").alias("source"))


@query(f"WITH {EVENTS}, {PRED}, st AS (SELECT user_id % 10 AS grp, us / {HOUR}.0 AS t FROM ev WHERE value > 140) SELECT id, round(CASE WHEN min(t) - a > 2 THEN min(t) ELSE a END, 6) AS a FROM pr JOIN st ON st.grp = pr.grp AND t BETWEEN a AND b GROUP BY id, pr.a")
def anchor_shift(spark, d):
    strong = events(spark, d).where("value > 140").select((F.col("user_id") % 10).alias("grp"), (F.col("us") / F.lit(float(HOUR))).alias("t"))
    inside = intervals.point_join(strong, predictions(spark, d).select("grp", "id", "a", "b"), ["grp"], "t", ("a", "b"), 24.0)
    first = inside.groupBy("id", "a").agg(F.min("t").alias("t"))
    return first.select("id", F.round(F.when(F.col("t") - F.col("a") > 2, F.col("t")).otherwise(F.col("a")), 6).alias("a"))


@query(f"{BEST} SELECT p AS id, round(tu.a, 6) AS a, round(tu.b, 6) AS b FROM bb JOIN tu ON tu.id = bb.t WHERE dice >= 0.5 AND dice < 1")
def reanchor_variant(spark, d):
    good = matched(spark, d).where("dice >= 0.5 and dice < 1").select(F.col("p").alias("id"), "t")
    return good.join(truth(spark, d).select(F.col("id").alias("t"), "a", "b"), "t").select("id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


ASOF = f"WITH {EVENTS}, l AS (SELECT event_id, user_id, us AS at FROM ev WHERE event_type = 'error'), r AS (SELECT user_id, us AS at, max(value) AS v FROM ev WHERE event_type = 'view' GROUP BY 1, 2)"


def _errors_views(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'error'").select("event_id", "user_id", F.col("us").alias("at"))
    return left, e.where("event_type = 'view'").groupBy("user_id", F.col("us").alias("at")).agg(F.max("value").alias("v"))


@query(f"{ASOF} SELECT event_id, r.at AS at_matched, v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.at >= r.at")
def asof_backward(spark, d):
    left, right = _errors_views(spark, d)
    return intervals.asof(left, right, ["user_id"], "at", ["v"]).select("event_id", "at_matched", "v")


@query(f"{ASOF} SELECT event_id, r.at AS at_matched, v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.at <= r.at")
def asof_forward(spark, d):
    left, right = _errors_views(spark, d)
    return intervals.asof(left, right, ["user_id"], "at", ["v"], "forward").select("event_id", "at_matched", "v")


@query(f"{ASOF}, c AS (SELECT event_id, r.at AS at_matched, v, row_number() OVER (PARTITION BY event_id ORDER BY abs(l.at - r.at), r.at) AS n FROM l LEFT JOIN r ON l.user_id = r.user_id) SELECT event_id, at_matched, v FROM c WHERE n = 1")
def nearest_category(spark, d):
    left, right = _errors_views(spark, d)
    return intervals.asof(left, right, ["user_id"], "at", ["v"], "nearest").select("event_id", "at_matched", "v")


@query(f"WITH {EVENTS}, {PRED}, dd AS (SELECT grp, list_sort(list(round(b - a, 6))) AS x FROM pr GROUP BY 1) SELECT grp, x[floor(0.5 * (len(x) - 1))::INTEGER + 1] AS p50, x[floor(0.9 * (len(x) - 1))::INTEGER + 1] AS p90, len(x)::INTEGER AS n FROM dd")
def duration_statistics(spark, d):
    q = evidence.lower_quantiles(predictions(spark, d).select("grp", F.round(F.col("b") - F.col("a"), 6).alias("x")), "x", [0.5, 0.9], ["grp"])
    return q.select("grp", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("n").cast("int").alias("n"))


@query(f"WITH {EVENTS}, {PRED} SELECT id, round(a - 5 - 60, 6) AS base_a, round(a - 5, 6) AS base_b FROM pr")
def baseline_windows(spark, d):
    low, high = intervals.baseline_window(F.col("a"), 60.0, 5.0)
    return predictions(spark, d).select("id", F.round(low, 6).alias("base_a"), F.round(high, 6).alias("base_b"))


@query(f"{BEST} SELECT pr.id, round(coalesce(dice, 0), 6) AS confidence FROM pr LEFT JOIN bb ON bb.p = pr.id ORDER BY coalesce(dice, 0) DESC, pr.id LIMIT 20")
def top_n_confidence(spark, d):
    conf = matched(spark, d).select(F.col("p").alias("id"), "dice")
    return predictions(spark, d).join(conf, "id", "left").withColumn("x", F.coalesce("dice", F.lit(0.0))).orderBy(F.desc("x"), "id").limit(20).select("id", F.round("x", 6).alias("confidence"))


@query(f"{BEST} SELECT id, grp, round(a, 6) AS a FROM pr WHERE id NOT IN (SELECT p FROM bb WHERE dice >= 0.4) UNION ALL SELECT -tu.id, grp, round(a, 6) FROM tu WHERE id IN (SELECT t FROM bb WHERE dice >= 0.4)")
def replacement_set(spark, d):
    good = matched(spark, d).where("dice >= 0.4")
    rest = predictions(spark, d).join(good.select(F.col("p").alias("id")), "id", "left_anti")
    new = truth(spark, d).join(good.select(F.col("t").alias("id")), "id", "left_semi").withColumn("id", -F.col("id"))
    return rest.select("id", "grp", F.round("a", 6).alias("a")).unionByName(new.select("id", "grp", F.round("a", 6).alias("a")))


@query()
def greedy_dice_dedup(spark, d):
    both = both_sides(spark, d).withColumn("id", F.xxhash64("grp", "a", "b"))
    seg = intervals.union_segments(both.select("grp", "a", "b"), ["grp"], "a", "b").select("grp", F.col("a").alias("sa"), F.col("b").alias("sb"))
    own = intervals.point_join(both, seg, ["grp"], "a", ("sa", "sb"), 24.0).dropDuplicates(["grp", "id"])
    return intervals.greedy_dice_dedup(own, ["grp", "sa"], "a", "b", "id", 0.6).select("grp", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(
    f"WITH RECURSIVE {EVENTS}, x AS (SELECT user_id % 10 AS grp, event_id, us / {HOUR}::DOUBLE AS t FROM ev WHERE value > 60), o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY t, event_id) AS r FROM x), "
    "f AS (SELECT grp, r, event_id, t AS first, t AS last, 0::BIGINT AS cluster FROM o WHERE r = 1 UNION ALL SELECT o.grp, o.r, o.event_id, CASE WHEN o.t - f.last > 6 OR o.t - f.first > 24 THEN o.t ELSE f.first END, o.t, f.cluster + (o.t - f.last > 6 OR o.t - f.first > 24)::BIGINT "
    "FROM f JOIN o ON o.grp = f.grp AND o.r = f.r + 1) SELECT grp, event_id, cluster FROM f"
)
def gap_span_clusters(spark, d):
    rows = events(spark, d).where("value > 60").select((F.col("user_id") % 10).alias("grp"), "event_id", (F.col("us") / F.lit(float(HOUR))).alias("t"))
    return intervals.gap_span_clusters(rows, ["grp"], "t", "event_id", 6.0, 24.0).select("grp", "event_id", "cluster")


DICE_OF = "CASE WHEN (x.b - x.a) + (y.b - y.a) > 0 THEN 2 * greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) / ((x.b - x.a) + (y.b - y.a)) ELSE 0 END"


@query(
    f"WITH RECURSIVE {EVENTS}, {PRED}, {TRUTH}, o AS (SELECT x.grp, x.id, x.a, x.b, row_number() OVER (PARTITION BY x.grp ORDER BY x.a, x.b, x.id) AS r FROM tu x WHERE NOT EXISTS (SELECT 1 FROM pr y WHERE y.grp = x.grp AND {DICE_OF} > 0.5)), "
    "f AS (SELECT grp, 0::BIGINT AS r, []::STRUCT(id BIGINT, a DOUBLE, b DOUBLE)[] AS kept FROM (SELECT DISTINCT grp FROM o) UNION ALL SELECT o.grp, o.r, CASE WHEN list_any_value(list_filter(f.kept, lambda y: (o.b - o.a) + (y.b - y.a) > 0 AND 2 * greatest(0, least(o.b, y.b) - greatest(o.a, y.a)) / ((o.b - o.a) + (y.b - y.a)) > 0.5)) IS NULL "
    "THEN list_append(f.kept, {'id': o.id::BIGINT, 'a': o.a::DOUBLE, 'b': o.b::DOUBLE}) ELSE f.kept END FROM f JOIN o ON o.grp = f.grp AND o.r = f.r + 1), l AS (SELECT grp, arg_max(kept, r) AS kept FROM f GROUP BY 1) SELECT grp, unnest(kept).id AS id FROM l"
)
def greedy_insertion(spark, d):
    return intervals.greedy_insert(truth(spark, d), predictions(spark, d), ["grp"], "a", "b", "id", 0.5).select("grp", "id")


@query(f"WITH {BOTH} SELECT grp, count(*) AS n, bool_and(a < b) AS ordered, count(*) - count(DISTINCT (a, b)) AS n_repeats FROM bo GROUP BY 1")
def submission_checks(spark, d):
    return both_sides(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.bool_and(F.col("a") < F.col("b")).alias("ordered"), (F.count("*") - F.count_distinct(F.struct("a", "b"))).alias("n_repeats"))
