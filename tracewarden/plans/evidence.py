"""Further evidence, selection and voting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators import graph, ranks, selection, stats
from tracewarden.plans.episodes import FIRST, INCIDENTS, first_times, incidents_of, ring
from tracewarden.plans.features import FLOW, flows
from tracewarden.plans.registry import EVENTS, HOUR, POINTS, events, points, query
from tracewarden.sources.tables import table

DAY = 24 * HOUR


@query(f"WITH {EVENTS}, ip AS (SELECT DISTINCT user_id, (user_id * 7919 * 65537) % 4294967296 AS ip FROM ev), px AS (SELECT n_nationkey::BIGINT AS owner, 8 + n_nationkey % 3 * 4 AS bits, (n_nationkey::BIGINT * 7919 * 65537 * 3) % 4294967296 AS net FROM nation UNION ALL SELECT -1, 0, 0) SELECT user_id, arg_max(owner, (bits, -owner)) AS owner FROM ip JOIN px ON ip >> (32 - bits)::BIGINT = net >> (32 - bits)::BIGINT GROUP BY 1")
def longest_prefix_address(spark, d):
    """Addresses to the most specific network that holds them."""
    ip = events(spark, d).select("user_id").distinct().withColumn("ip", F.col("user_id") * 7919 * 65537 % 4294967296)
    key = F.col("n_nationkey").cast("long")
    net = table(spark, d, "nation", "n_nationkey").select(key.alias("owner"), (8 + F.col("n_nationkey") % 3 * 4).cast("int").alias("bits"), (key * 7919 * 65537 * 3 % 4294967296).alias("net"))
    return selection.longest_prefix(ip, net.unionAll(spark.sql("SELECT -1L, 0, 0L")), (0, 8, 12, 16)).select("user_id", "owner")


@query(f"WITH {POINTS}, b AS (SELECT user_id, h, m, user_id % 5 AS role, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS size FROM pt), r AS (SELECT *, row_number() OVER (PARTITION BY role, size ORDER BY m DESC, user_id, h) AS rn FROM b) SELECT user_id, h, role, size FROM r ORDER BY rn, role, size, user_id LIMIT 40")
def round_robin_selection(spark, d):
    b = points(spark, d).select("user_id", "h", "m", (F.col("user_id") % 5).alias("role"), F.when(F.col("n") >= 2, 1).otherwise(0).alias("size"))
    return selection.round_robin(b, ["role", "size"], [F.desc("m"), F.col("user_id"), F.col("h")], 40).select("user_id", "h", "role", "size")


@query(f"WITH {POINTS}, i AS (SELECT user_id, h, row_number() OVER (PARTITION BY user_id ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM pt) SELECT user_id, h FROM i WHERE n <= 12 OR i IN (SELECT round(j * (i.n - 1) / 11.0) FROM range(12) t(j))")
def even_sample(spark, d):
    return ranks.evenly_spaced(points(spark, d).select("user_id", "h"), ["user_id"], "h", 12)


@query(f"WITH {POINTS}, i AS (SELECT user_id, h, m, row_number() OVER (PARTITION BY user_id ORDER BY h) - 1 AS i FROM pt), w AS (SELECT user_id, h, i, m, unnest([i // 3, i // 3 - 1]) AS k FROM i), e AS (SELECT user_id, k, stddev_pop(m) AS e FROM w WHERE k >= 0 GROUP BY 1, 2) SELECT user_id, h, round(avg(e), 6) AS error FROM w JOIN e USING (user_id, k) GROUP BY 1, 2")
def window_error_spread(spark, d):
    """Windows of six points, a new one every three; each point gets the mean error of its windows."""
    return selection.window_errors(points(spark, d), ["user_id"], "h", "m", 6, 3).select("user_id", "h", F.round("error", 6).alias("error"))


REPEATS = f"{EVENTS}, kp AS (SELECT user_id % 10 AS grp, user_id, value, r FROM ev, range(5) t(r) WHERE (event_id * 40503 + r * 7919) % 100 < 90), tp AS (SELECT r, grp, user_id, max(value) AS mx FROM kp GROUP BY 1, 2, 3), rr AS (SELECT *, row_number() OVER (PARTITION BY r, grp ORDER BY mx DESC, user_id) AS k FROM tp)"


@query(f"WITH {REPEATS} SELECT grp, user_id, round(count(*) FILTER (k = 1) / 5.0, 6) AS top1, round(count(*) FILTER (k <= 3) / 5.0, 6) AS top3, round(avg(k), 6) AS mean_rank, round(stddev_pop(k), 6) AS rank_std FROM rr GROUP BY 1, 2")
def rank_stability(spark, d):
    """Ranks of elements over five repeats, each without a tenth of the evidence, dropped by a fixed hash."""
    kept = events(spark, d).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(4)))).where((F.col("event_id") * 40503 + F.col("r") * 7919) % 100 < 90)
    top = kept.groupBy("r", (F.col("user_id") % 10).alias("grp"), "user_id").agg(F.max("value").alias("mx"))
    found = selection.rank_stability(top, ["grp"], "user_id", "r", "mx", 5)
    return found.select("grp", "user_id", *(F.round(c, 6).alias(c) for c in ("top1", "top3", "mean_rank", "rank_std")))


@query(f"WITH {POINTS}, t AS (SELECT user_id % 10 AS grp, h, row_number() OVER (PARTITION BY user_id % 10 ORDER BY m DESC, user_id, h) AS r FROM pt), w AS (SELECT grp, min(h) AS a, max(h) AS b, min(h) FILTER (r = 1) AS c FROM t WHERE r <= 5 GROUP BY 1) SELECT grp, CASE WHEN b - a <= 48 THEN a ELSE c - 1 END AS a, CASE WHEN b - a <= 48 THEN b ELSE c + 1 END AS b FROM w")
def prediction_window(spark, d):
    t = points(spark, d).withColumn("grp", F.col("user_id") % 10)
    return selection.prediction_window(t, ["grp"], "m", "h", "user_id", 5, 48, 1)


CRITERIA = (("error", 0.3), ("view", 0.25), ("click", 0.2), ("purchase", 0.15), ("signup", 0.1))


@query(f"WITH {EVENTS}, k AS (SELECT user_id % 10 AS grp, user_id, event_type, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY max(value) DESC, user_id) AS r FROM ev GROUP BY 1, 2, 3), n AS (SELECT grp, count(DISTINCT user_id) AS n FROM k GROUP BY 1) SELECT k.grp, user_id, round(" + " + ".join(f"{w}::DOUBLE * coalesce(max(r) FILTER (event_type = '{c}'), n)" for c, w in CRITERIA) + ", 6) AS mean_rank FROM k JOIN n ON n.grp = k.grp GROUP BY k.grp, user_id, n")
def criteria_mean_rank(spark, d):
    """The weighted mean of an element's ranks under five criteria; where it has none it counts as last."""
    top = events(spark, d).groupBy((F.col("user_id") % 10).alias("grp"), "user_id", "event_type").agg(F.max("value").alias("mx"))
    return selection.criteria_rank(top, ["grp"], "user_id", "event_type", "mx", dict(CRITERIA)).select("grp", "user_id", F.round("mean_rank", 6).alias("mean_rank"))


@query(f"WITH {FLOW}, m AS (SELECT src, dst, quantile_cont(bytes, 0.5) FILTER (day < 10000) AS base, quantile_cont(bytes, 0.5) FILTER (day >= 10000) AS now FROM fl GROUP BY 1, 2) SELECT src, dst, round(base, 4) AS base_median, round(now, 4) AS now_median, round(now / greatest(base, 1e-6), 5) AS ratio FROM m WHERE base IS NOT NULL AND now IS NOT NULL")
def edge_medians(spark, d):
    before = F.col("day") < 10000
    m = flows(spark, d).groupBy("src", "dst").agg(F.percentile(F.when(before, F.col("bytes")), 0.5).alias("base"), F.percentile(F.when(~before, F.col("bytes")), 0.5).alias("now")).where("base is not null and now is not null")
    return m.select("src", "dst", F.round("base", 4).alias("base_median"), F.round("now", 4).alias("now_median"), F.round(F.col("now") / F.greatest("base", F.lit(1e-6)), 5).alias("ratio"))


@query(f"WITH {FLOW}, p AS (SELECT src, dst, 'probe' AS source, count(*) AS n, NULL::DOUBLE AS bytes FROM fl WHERE proto = 'A' GROUP BY 1, 2), f AS (SELECT src, dst, 'flow' AS source, count(*) AS n, round(sum(bytes), 2) AS bytes FROM fl WHERE proto <> 'A' GROUP BY 1, 2) SELECT *, CASE WHEN src % 5 = 0 THEN src ELSE dst END AS node FROM (SELECT * FROM p UNION ALL SELECT * FROM f)")
def flat_edges(spark, d):
    x = flows(spark, d)
    probe = x.where("proto = 'A'").groupBy("src", "dst").agg(F.count("*").alias("n")).withColumn("source", F.lit("probe"))
    flow = x.where("proto <> 'A'").groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("bytes"), 2).alias("bytes")).withColumn("source", F.lit("flow"))
    return probe.unionByName(flow, allowMissingColumns=True).withColumn("node", F.when(F.col("src") % 5 == 0, F.col("src")).otherwise(F.col("dst")))


@query(f"WITH {FIRST}, l AS (SELECT src, dst, (count(*) FILTER (y.first_time > x.first_time) + 1) / (count(*) + 2) * least(1, count(*) / 10) AS w FROM tg JOIN ft x ON x.node = src JOIN ft y ON y.node = dst AND y.grp = x.grp GROUP BY 1, 2), n AS (SELECT grp, count(*) AS n FROM ft GROUP BY 1) SELECT x.grp, x.node, round(sum(CASE WHEN y.first_time > x.first_time THEN w ELSE 0 END) / greatest(1, n - 1), 6) AS outflow FROM tg JOIN ft x ON x.node = src JOIN ft y ON y.node = dst AND y.grp = x.grp JOIN l ON l.src = tg.src AND l.dst = tg.dst JOIN n ON n.grp = x.grp GROUP BY x.grp, x.node, n")
def causal_outflow(spark, d):
    f, e = first_times(spark, d), ring(spark)
    pairs = graph.propagation(e, f, ["grp"]).join(graph.lead_lag(e, f, ["grp"]).select("src", "dst", "weight"), ["src", "dst"])
    n = f.groupBy("grp").agg(F.count("*").alias("n"))
    return pairs.join(n, "grp").groupBy("grp", F.col("src").alias("node"), "n").agg(F.round(F.sum(F.when(F.col("lag") > 0, F.col("weight")).otherwise(0.0)) / F.greatest(F.lit(1), F.col("n") - 1), 6).alias("outflow")).drop("n")


@query(f"WITH {POINTS}, s AS (SELECT user_id % 5 AS role, list_sort(list(m)) AS x FROM pt GROUP BY 1) SELECT role, round(x[floor(0.5 * (len(x) - 1))::INTEGER + 1], 6) AS median, round(x[floor(0.9 * (len(x) - 1))::INTEGER + 1], 6) AS p90 FROM s")
def role_summary(spark, d):
    """Quantiles that are elements."""
    p = points(spark, d).select((F.col("user_id") % 5).alias("role"), "m")
    q = selection.element_quantiles(p, ["role"], "m", {"median": 0.5, "p90": 0.9})
    return q.select("role", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


@query(f"WITH {EVENTS}, {'o AS (' + ' UNION ALL '.join(f'''SELECT user_id, us, {i} AS prio, '{k}' AS source FROM ev WHERE event_type = '{k}' AND value > {v}''' for i, (k, v) in enumerate((('error', 100), ('view', 120), ('click', 140), ('signup', 90), ('purchase', 150)))) + ')'} SELECT user_id, min(us) AS first_us, arg_min(source, us * 10 + prio) AS source, count(*) AS n, count(DISTINCT source) AS n_sources FROM o GROUP BY 1")
def temporal_observations(spark, d):
    """Five kinds of evidence as one long table; the first of each element with its source."""
    e, out = events(spark, d), None
    for i, (kind, least) in enumerate((("error", 100), ("view", 120), ("click", 140), ("signup", 90), ("purchase", 150))):
        own = e.where((F.col("event_type") == kind) & (F.col("value") > least)).select("user_id", "us", F.lit(i).alias("prio"), F.lit(kind).alias("source"))
        out = own if out is None else out.unionByName(own)
    return selection.firsts(out, "user_id", "us", "source", "prio").withColumnRenamed("first", "first_us")


@query(f"WITH {EVENTS}, v AS (SELECT user_id % 10 AS grp, user_id, CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS w FROM ev WHERE value > 100), t AS (SELECT grp, user_id, sum(w)::BIGINT AS votes FROM v GROUP BY 1, 2) SELECT grp, user_id, votes FROM t QUALIFY row_number() OVER (PARTITION BY grp ORDER BY votes DESC, user_id) = 1")
def first_mover_vote(spark, d):
    w = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    t = events(spark, d).where("value > 100").groupBy((F.col("user_id") % 10).alias("grp"), "user_id").agg(F.sum(w).alias("votes"))
    return ranks.top_k(t, ["grp"], [F.desc("votes"), F.col("user_id")], 1).drop("rank")


@query(f"WITH {EVENTS}, dv AS (SELECT us // {DAY} AS day, user_id, max(value) AS mx FROM ev GROUP BY 1, 2) SELECT day, count(*) AS n, count(*) FILTER (mx >= 120) AS n_high FROM dv GROUP BY 1 HAVING count(*) FILTER (mx >= 120) >= 2")
def device_gate(spark, d):
    dv = events(spark, d).groupBy(F.floor(F.col("us") / DAY).alias("day"), "user_id").agg(F.max("value").alias("mx"))
    return selection.gate(dv, ["day"], "mx", 120, 2)


@query(f"WITH {EVENTS}, q AS (SELECT user_id % 10 AS grp, quantile_cont(value, 0.99) AS a FROM ev GROUP BY 1) SELECT DISTINCT user_id % 10 AS grp, us FROM ev JOIN q ON q.grp = user_id % 10 WHERE value >= a")
def high_points(spark, d):
    e = events(spark, d).withColumn("grp", F.col("user_id") % 10)
    edge = ranks.quantiles(e.select("grp", "value"), "value", [0.99], ["grp"]).select("grp", F.col("q")[0].alias("a"))
    return e.join(edge, "grp").where("value >= a").select("grp", "us").distinct()


@query(f"WITH {EVENTS}, c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS configured, CASE WHEN event_id % 3 = 1 THEN least(1, value / 200) END AS normal, value / 100 AS combined FROM ev) SELECT event_id, round(coalesce(configured, 1 - normal, combined), 6) AS score FROM c")
def score_resolution(spark, d):
    c, own = events(spark, d), F.col("event_id") % 3
    normal = F.when(own == 1, F.least(F.lit(1.0), F.col("value") / 200))
    return c.select("event_id", F.round(F.coalesce(F.when(own == 0, F.col("value")), 1 - normal, F.col("value") / 100), 6).alias("score"))


@query(f"WITH {INCIDENTS}, dc AS (SELECT id, CASE id % 4 WHEN 0 THEN 'drop' WHEN 1 THEN 'merge' ELSE 'keep' END AS act, CASE WHEN id % 4 = 1 THEN id - 1 ELSE id END AS into_id FROM inc) SELECT into_id AS id, min(a) AS a, max(b) AS b, count(*) AS n FROM inc JOIN dc USING (id) WHERE act <> 'drop' GROUP BY 1")
def decision_application(spark, d):
    """A decision for each incident: dropped ones go, merged ones are joined with the one they name."""
    i, own = incidents_of(spark, d).select("id", "a", "b"), F.col("id") % 4
    decided = i.select("id", F.when(own == 0, "drop").when(own == 1, "merge").otherwise("keep").alias("act"), (F.col("id") - 1).alias("into"))
    return selection.applied(i, decided)


@query(f"WITH {INCIDENTS}, p AS (SELECT id, grp, peak, 1 - (row_number() OVER (PARTITION BY grp ORDER BY a, id) - 1) / greatest(1, count(*) OVER (PARTITION BY grp) - 1) AS early FROM inc), t AS (SELECT id, grp, 0.65 * peak + 0.35 * early AS t FROM p) SELECT id, round(CASE WHEN max(t) OVER w > min(t) OVER w THEN (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w) ELSE 0 END, 6) AS target FROM t WINDOW w AS (PARTITION BY grp)")
def heuristic_target(spark, d):
    i = ranks.earliest_first(incidents_of(spark, d), ["grp"], "a", "id", "early").withColumn("t", 0.65 * F.col("peak") + 0.35 * F.col("early"))
    return ranks.min_max(i, ["grp"], "t", "target").select("id", F.round("target", 6).alias("target"))


@query(f"WITH {INCIDENTS}, f AS (SELECT grp, " + ", ".join(f"round(coalesce(max(peak) FILTER (user_id % 5 = {r}), 0), 6) AS peak_{r}" for r in range(5)) + ", max(b - a) AS longest, count(*) AS n FROM inc GROUP BY 1) SELECT *, 'group ' || grp || ': ' || n || ' incidents, longest ' || longest || ' h' AS text FROM f")
def fingerprint(spark, d):
    """One vector per group, largest peaks by role, and its rendering as text."""
    peaks = [F.round(F.coalesce(F.max(F.when(F.col("user_id") % 5 == r, F.col("peak"))), F.lit(0.0)), 6).alias(f"peak_{r}") for r in range(5)]
    f = incidents_of(spark, d).groupBy("grp").agg(*peaks, F.max(F.col("b") - F.col("a")).alias("longest"), F.count("*").alias("n"))
    return f.withColumn("text", F.format_string("group %d: %d incidents, longest %d h", "grp", "n", "longest"))


@query(f"WITH {INCIDENTS} SELECT grp, count(*) AS n_episodes, count(DISTINCT user_id) AS n_nodes, min(a) AS a, max(b) AS b, round(max(peak), 6) AS peak, count(*) - count(DISTINCT (a, b)) AS n_same_window FROM inc GROUP BY 1")
def incident_counts(spark, d):
    return incidents_of(spark, d).groupBy("grp").agg(F.count("*").alias("n_episodes"), F.count_distinct("user_id").alias("n_nodes"), F.min("a").alias("a"), F.max("b").alias("b"), F.round(F.max("peak"), 6).alias("peak"), (F.count("*") - F.count_distinct(F.struct("a", "b"))).alias("n_same_window"))


@query(f"WITH {EVENTS}, s AS (SELECT DISTINCT user_id % 6 AS router, k % 6 AS neighbour FROM ev WHERE user_id % 6 <> k % 6), o AS (SELECT r.router, i.neighbour AS id FROM (SELECT DISTINCT router FROM s) r, (SELECT DISTINCT neighbour FROM s) i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.router = r.router AND s.neighbour = i.neighbour)) SELECT router, min(id) AS id FROM o GROUP BY 1 HAVING count(*) = 1")
def router_id_resolution(spark, d):
    """A router whose neighbours report all ids but one has that one."""
    s = events(spark, d).select((F.col("user_id") % 6).alias("router"), (F.col("k") % 6).alias("neighbour")).where("router <> neighbour").distinct()
    return graph.omitted_ids(s)


@query(f"WITH {POINTS}, w AS (SELECT user_id, h, m, mx, row_number() OVER (ORDER BY mx - m DESC, user_id, h) AS r FROM pt) SELECT count(*) AS n, round(corr(m, mx), 5) AS r, round(min(mx - m), 6) AS least FROM w WHERE r <= 60")
def hard_sample_worklist(spark, d):
    w = points(spark, d).withColumn("gap", F.col("mx") - F.col("m")).orderBy(F.desc("gap"), "user_id", "h").limit(60)
    return w.agg(F.count("*").alias("n"), F.round(F.corr("m", "mx"), 5).alias("r"), F.round(F.min("gap"), 6).alias("least"))


def _stat(df: DataFrame) -> DataFrame:
    return stats.binned(df, "ts", 60, ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS bin_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_bins(spark, d):
    return _stat(table(spark, d, "events", "ts", "event_type", "value")).select(F.unix_micros("bin").alias("bin_us"), "event_type", "n", "total")
