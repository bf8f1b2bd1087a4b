"""Diagnosis queries: candidates from evidence, gates, categories, scans, selections and names, each one call of an operator.

The telemetry of these queries is made of the events: ten incidents by the last digit of the user, twelve
elements in each, the kind of an event as the modality of a fact. Elements n12 and n13 have no facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import scalars as S
from tracewarden.operators import decisions as D
from tracewarden.operators import evidence as E
from tracewarden.operators import graph, intervals, ranks, stats
from tracewarden.plans.features import FLOW, flows
from tracewarden.plans.interval_algebra import PRED, TRUTH, predictions, truth
from tracewarden.plans.registry import EVENTS, HOUR, POINTS, events, points, query
from tracewarden.sources import scans
from tracewarden.sources.tables import table

NODE = "'n' || (user_id // 10 % 12)"
FACTS = f"""{EVENTS}, fa AS (SELECT user_id % 10 AS incident, {NODE} AS node, CASE event_type WHEN 'error' THEN 'routing' WHEN 'view' THEN 'metric' WHEN 'click' THEN 'interface' WHEN 'purchase' THEN 'log' ELSE 'quality' END AS modality, value / 100 AS strength, us AS time, event_type || ' #' || event_id AS label FROM ev WHERE value > 60),
cl AS (SELECT incident, node, row_number() OVER (PARTITION BY incident ORDER BY max(strength) DESC, node) AS place FROM fa GROUP BY 1, 2), ed AS (SELECT 'n' || (n_nationkey % 14) AS src, 'n' || ((n_nationkey * 5 + 2) % 14) AS dst FROM nation)"""
CANDIDATES = f"""{FACTS}, sl AS (SELECT incident, node, coalesce(max(strength) FILTER (modality IN ('metric', 'interface', 'routing')), 0) AS mag, list(DISTINCT modality) AS seen, min(time) AS t FROM fa GROUP BY 1, 2),
sh AS (SELECT *, row_number() OVER (PARTITION BY incident, node, modality ORDER BY strength DESC, time, label) AS pl FROM fa),
su AS (SELECT incident, node, list(modality || ': ' || label ORDER BY list_position(['routing', 'metric', 'interface', 'log', 'quality'], modality), pl)[1:8] AS sup FROM sh WHERE pl <= CASE modality WHEN 'routing' THEN 8 WHEN 'metric' THEN 3 ELSE 2 END GROUP BY 1, 2),
bw AS (SELECT src AS node, dst AS other FROM ed WHERE src <> dst UNION SELECT dst, src FROM ed WHERE src <> dst), hd AS (SELECT incident, node, mag, seen, sup, t FROM sl JOIN su USING (incident, node)),
gr AS (SELECT hd.incident, bw.other AS node FROM hd JOIN bw ON bw.node = hd.node EXCEPT SELECT incident, node FROM hd),
al AS (SELECT *, FALSE AS grown FROM hd UNION ALL SELECT incident, node, 0, [], [], NULL, TRUE FROM gr), tm AS (SELECT incident, node, t, dense_rank() OVER (PARTITION BY incident ORDER BY t) AS r, count(*) OVER (PARTITION BY incident) AS n FROM al WHERE t IS NOT NULL), tx AS (SELECT *, max(r) OVER (PARTITION BY incident) AS m FROM tm),
pp AS (SELECT incident, node, CASE WHEN n = 1 THEN 1.0 WHEN m = 1 THEN 0.0 ELSE 1 - (r - 1) / (m - 1) END AS p FROM tx), fl AS (SELECT x.incident, x.node, count(*) FILTER (y.t > x.t) AS later, count(*) FILTER (y.t < x.t) AS earlier, list_sort(list(DISTINCT y.node) FILTER (y.t < x.t)) AS movers FROM tm x JOIN bw ON bw.node = x.node JOIN tm y ON y.incident = x.incident AND y.node = bw.other GROUP BY 1, 2),
pv AS (SELECT incident, node, max(strength) AS v FROM fa WHERE modality = 'interface' GROUP BY 1, 2), cv AS (SELECT incident, node, greatest(-1, least(1, (count(*) FILTER (modality = 'log') - count(*) FILTER (modality = 'quality')) / 3)) AS v FROM fa GROUP BY 1, 2),
j AS (SELECT al.*, pp.p, fl.later, fl.earlier, fl.movers, coalesce(pv.v, 0) AS pred, coalesce(cv.v, 0) AS con FROM al LEFT JOIN pp ON pp.incident = al.incident AND pp.node = al.node LEFT JOIN fl ON fl.incident = al.incident AND fl.node = al.node LEFT JOIN pv ON pv.incident = al.incident AND pv.node = al.node LEFT JOIN cv ON cv.incident = al.incident AND cv.node = al.node),
w AS (SELECT *, count(*) OVER (PARTITION BY incident) AS k, min(pred) OVER (PARTITION BY incident) AS plo, max(pred) OVER (PARTITION BY incident) AS phi FROM j),
sc AS (SELECT incident, node, CASE WHEN mag > 0 THEN least(1, ln(1 + mag) / ln(1 + 197362.0)) ELSE 0 END AS local, coalesce(p, 0) AS prio, coalesce(later, 0) / greatest(1, k - 1) AS outp, coalesce(earlier, 0) / greatest(1, k - 1) AS inp, least(1, len(seen) / 3) AS crs, CASE WHEN phi > plo THEN (pred - plo) / (phi - plo) ELSE 0 END AS pre, con, mag, seen, t, grown,
  CASE WHEN len(sup) = 0 AND grown THEN ['topology: neighbour of ' || (SELECT c.node FROM cl c WHERE c.incident = w.incident AND c.place = 1) || ' in the graph'] ELSE sup END AS sup, coalesce(movers, []) AS movers FROM w),
rs AS (SELECT *, 0.2 * local + 0.25 * prio + 0.2 * outp + 0.2 * crs + 0.15 * pre - 0.15 * inp - 0.15 * con AS root, list_concat(list_transform(movers, lambda x: x || ' moved earlier'), CASE WHEN len(sup) = 0 THEN ['no positive evidence of any modality'] ELSE [] END) AS ag FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY round(root, 9) DESC, node) AS rank FROM rs)"""


def facts(spark, d) -> DataFrame:
    kind = E.looked_up(F.col("event_type"), {"error": "routing", "view": "metric", "click": "interface", "purchase": "log", "signup": "quality"})
    node = F.concat(F.lit("n"), F.floor(F.col("user_id") / 10) % 12)
    label = F.concat_ws(" #", "event_type", F.col("event_id").cast("string"))
    return events(spark, d).where("value > 60").select((F.col("user_id") % 10).alias("incident"), node.alias("node"), kind.alias("modality"), (F.col("value") / 100).alias("strength"), F.col("us").alias("time"), label.alias("label"))


def claimed(f: DataFrame) -> DataFrame:
    top = f.groupBy("incident", "node").agg(F.max("strength").alias("s"))
    return top.select("incident", "node", F.row_number().over(Window.partitionBy("incident").orderBy(F.desc("s"), "node")).alias("place"))


def wires(spark, d) -> DataFrame:
    n = table(spark, d, "nation", "n_nationkey")
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey") % 14).alias("src"), F.concat(F.lit("n"), (F.col("n_nationkey") * 5 + 2) % 14).alias("dst"))


def candidates_of(spark, d) -> DataFrame:
    f = facts(spark, d)
    seen = f.groupBy("incident", "node").agg(F.max(F.when(F.col("modality") == "interface", F.col("strength"))).alias("p"), F.count_if(F.col("modality") == "log").alias("s"), F.count_if(F.col("modality") == "quality").alias("c"))
    predictive = seen.where("p is not null").select("incident", "node", F.col("p").alias("value"))
    contradiction = seen.select("incident", "node", D.net_support(F.col("s"), F.col("c")).alias("value"))
    return E.candidates(f, claimed(f), wires(spark, d), predictive, contradiction, most_claimed=1000)


SCORES = "round(local, 6) AS local_anomaly, round(prio, 6) AS temporal_priority, round(outp, 6) AS outgoing_propagation, round(inp, 6) AS incoming_propagation, round(crs, 6) AS cross_modal_support, round(pre, 6) AS predictive_explanation, round(con, 6) AS contradiction"


@query(
    f"WITH {CANDIDATES} SELECT incident, node, rank, {SCORES}, round(root, 6) AS root_score, array_to_string(list_filter(['metric', 'interface', 'routing', 'log', 'quality', 'flow'], lambda m: list_contains(seen, m)), '+') AS modalities, "
    "array_to_string(sup, ' | ') AS supporting, CASE WHEN len(ag) = 0 THEN 'no counter-evidence' ELSE array_to_string(ag, ' | ') END AS contradicting, t AS first_time, grown AS expanded FROM rk"
)
def evidence_candidates(spark, d):
    c = candidates_of(spark, d)
    return c.select("incident", "node", "rank", *(F.round(n, 6).alias(n) for n in D.ROOT_WEIGHTS), F.round("root_score", 6).alias("root_score"), F.concat_ws("+", "modalities").alias("modalities"), F.concat_ws(" | ", "supporting").alias("supporting"), F.concat_ws(" | ", "contradicting").alias("contradicting"), "first_time", "expanded")


@query(
    f"WITH {CANDIDATES}, b AS (SELECT *, local > 0 OR len(sup) > 0 AS good, bool_or(local > 0 OR len(sup) > 0) OVER (PARTITION BY incident) AS any_good FROM rk WHERE rank <= 10), g AS (SELECT *, count(*) OVER (PARTITION BY incident) || ' -> ' || count(*) FILTER (good OR NOT any_good) OVER (PARTITION BY incident) AS kept_of FROM b) "
    "SELECT incident, node, row_number() OVER (PARTITION BY incident ORDER BY rank) AS rank, kept_of FROM g WHERE good OR NOT any_good QUALIFY row_number() OVER (PARTITION BY incident ORDER BY rank) <= 5"
)
def evidence_filter(spark, d):
    return E.filtered(candidates_of(spark, d)).select("incident", "node", "rank", "kept_of")


@query(
    f"WITH {CANDIDATES}, x AS (SELECT incident, string_agg(node, ', ' ORDER BY rank) AS names, string_agg(rank || '. ' || node || ' (score ' || printf('%.3f', root) || '; ' || array_to_string(list_filter(['metric', 'interface', 'routing', 'log', 'quality', 'flow'], lambda m: list_contains(seen, m)), '+') || ') for: ' || array_to_string(sup, ' | ') "
    "|| '; against: ' || CASE WHEN len(ag) = 0 THEN 'no counter-evidence' ELSE array_to_string(ag, ' | ') END, chr(10) ORDER BY rank) AS body FROM rk GROUP BY 1) SELECT incident, 'Which element is the cause?' || chr(10) || 'candidates: ' || names || chr(10) || body AS prompt FROM x"
)
def evidence_text(spark, d):
    return E.rendered(candidates_of(spark, d))


FLOW_EDGES = f"{FLOW}, fe AS (SELECT day // 60 AS incident, src, dst, CASE src % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'dns' ELSE 'auth' END AS flow_type, avg(CASE WHEN proto = 'R' THEN 0.03 ELSE 0 END) AS error_rate, 0.005 * count(*) FILTER (proto = 'A') AS timeouts, quantile_cont(bytes, 0.95) AS p95, quantile_cont(bytes, 0.95) FILTER (proto = 'N') / 2.4 AS p95_base FROM fl GROUP BY 1, 2, 3, 4)"


@query(
    f"WITH {FLOW_EDGES}, c AS (SELECT incident, CASE WHEN error_rate > 0.01 OR timeouts > 0.1 THEN CASE flow_type WHEN 'web' THEN 'web_5xx' WHEN 'dns' THEN 'dns_down' ELSE 'auth_error' END WHEN p95_base > 0 AND p95 > 2 * p95_base THEN CASE flow_type WHEN 'web' THEN 'web_slow' WHEN 'dns' THEN 'dns_wrong_record' ELSE 'auth_timeout' END END AS category, "
    "CASE WHEN error_rate > 0.01 OR timeouts > 0.1 THEN error_rate * 10 + timeouts ELSE p95 / p95_base END AS strength FROM fe) SELECT incident, arg_max(category, (round(strength, 9), category)) AS category, round(max(strength), 6) AS strength FROM c WHERE category IS NOT NULL GROUP BY 1"
)
def flow_gate(spark, d):
    f = flows(spark, d).withColumn("incident", F.floor(F.col("day") / 60)).withColumn("flow_type", F.when(F.col("src") % 3 == 0, "web").when(F.col("src") % 3 == 1, "dns").otherwise("auth"))
    edges = f.groupBy("incident", "src", "dst", "flow_type").agg(
        F.avg(F.when(F.col("proto") == "R", 0.03).otherwise(0.0)).alias("error_rate"),
        (0.005 * F.count_if(F.col("proto") == "A")).alias("timeouts"),
        F.percentile("bytes", 0.95).alias("p95"),
        (F.percentile(F.when(F.col("proto") == "N", F.col("bytes")), 0.95) / 2.4).alias("p95_base"),
    )
    return E.flow_gate(edges).select("incident", "category", F.round("strength", 6).alias("strength"))


@query(f"WITH {FLOW}, p AS (SELECT src, CASE src % 3 WHEN 0 THEN 'dns' WHEN 1 THEN 'web' ELSE 'ssh' END AS service, count(*) FILTER (day >= 10000) / nullif(count(*) FILTER (day < 10000), 0) AS drop, avg(packets) FILTER (day >= 10000) / nullif(avg(packets) FILTER (day < 10000), 0) * (1 + src % 4) AS slow FROM fl GROUP BY 1, 2) SELECT src, CASE WHEN service = 'dns' AND drop < 0.5 THEN 'dns_down' WHEN service = 'web' AND slow >= 2 THEN 'web_slow' WHEN service = 'web' AND drop < 0.5 THEN 'web_5xx' END AS category FROM p")
def service_subtype(spark, d):
    late, service = F.col("day") >= 10000, F.when(F.col("src") % 3 == 0, "dns").when(F.col("src") % 3 == 1, "web").otherwise("ssh")
    p = flows(spark, d).groupBy("src").agg((F.count_if(late) / F.nullif(F.count_if(~late), F.lit(0))).alias("drop"), (F.avg(F.when(late, F.col("packets"))) / F.avg(F.when(~late, F.col("packets"))) * (1 + F.col("src") % 4)).alias("slow"))
    return p.select("src", E.service_subtype(service, F.col("drop"), F.col("slow")).alias("category"))


#: Statistics of metrics: each event a metric by its number, its value a deviation.
METRICS = "cpu_usage load1 memory_available_ratio filesystem_used_ratio disk_io_util process_count rx_drop_rate tx_error_rate carrier_changes latency".split()
METRIC_SQL = f"([{', '.join(repr(m) for m in METRICS)}])[event_id % 10 + 1]"
STATS = f"{EVENTS}, sx AS (SELECT user_id % 10 AS incident, user_id // 10 % 12 AS node, {METRIC_SQL} AS metric, max(value) AS peak, max(value) / 6 AS z, avg(value) AS severity FROM ev GROUP BY 1, 2, 3)"


def metric_stats(spark, d) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, METRICS)), (F.col("event_id") % 10 + 1).cast("int"))
    rows = events(spark, d).groupBy((F.col("user_id") % 10).alias("incident"), (F.floor(F.col("user_id") / 10) % 12).alias("node"), name.alias("metric"))
    return rows.agg(F.max("value").alias("peak"), (F.max("value") / 6).alias("z"), F.avg("value").alias("severity"))


@query(
    f"WITH {STATS}, a AS (SELECT incident, bool_or(node = 0 AND metric = 'cpu_usage' AND peak >= 10 AND z >= 8) AS pressed, bool_or(node = 0 AND metric IN ('rx_drop_rate', 'tx_error_rate') AND z >= 8) AS dropping, bool_or(node <> 0 AND metric IN ('rx_drop_rate', 'tx_error_rate', 'carrier_changes') AND z >= 8) AS lossy FROM sx GROUP BY 1), "
    "r AS (SELECT DISTINCT user_id % 10 AS incident FROM ev WHERE user_id // 10 % 12 = 0 AND value > 150 AND event_type = 'error'), s AS (SELECT coalesce(a.incident, r.incident) AS incident, CASE WHEN pressed THEN 'cpu_pressure' WHEN dropping THEN 'acl_drop' WHEN r.incident IS NOT NULL THEN 'default_route_error' WHEN lossy THEN 'loss' END AS sub FROM a FULL JOIN r ON r.incident = a.incident) "
    "SELECT incident, CASE WHEN sub = 'loss' THEN 'link' ELSE 'firewall' END AS major, sub FROM s WHERE sub IS NOT NULL"
)
def device_faults(spark, d):
    routing = events(spark, d).where("value > 150 and event_type = 'error'").select((F.col("user_id") % 10).alias("incident"), (F.floor(F.col("user_id") / 10) % 12).alias("node"), F.lit("ipv6_default_route_info").alias("metric"))
    return E.device_faults(metric_stats(spark, d), routing, F.col("node") == 0)


FAMILY = "CASE WHEN metric IN ('cpu_usage', 'load1') THEN 'cpu_pressure' WHEN metric = 'memory_available_ratio' THEN 'memory_pressure' WHEN metric = 'filesystem_used_ratio' THEN 'disk_space_low' WHEN metric = 'disk_io_util' THEN 'disk_io_pressure' WHEN metric = 'process_count' THEN 'process_pressure' END"


@query(
    f"WITH {STATS}, f AS (SELECT *, {FAMILY} AS family FROM sx), b AS (SELECT incident, node, family, max(z) AS z FROM f WHERE family IS NOT NULL GROUP BY 1, 2, 3), b1 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY incident, node ORDER BY z DESC, list_position(['cpu_pressure', 'memory_pressure', 'disk_space_low', 'disk_io_pressure', 'process_pressure'], family)) = 1), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY incident, node ORDER BY severity DESC, metric) AS pl FROM f), t3 AS (SELECT *, max(z) OVER (PARTITION BY incident, node ORDER BY pl ROWS UNBOUNDED PRECEDING) AS st FROM t WHERE pl <= 3), sp AS (SELECT incident, node, arg_min(family, pl) AS spare FROM t3 WHERE st >= 3 AND family IS NOT NULL GROUP BY 1, 2) "
    "SELECT coalesce(b1.incident, sp.incident) AS incident, coalesce(b1.node, sp.node) AS node, CASE WHEN b1.z >= 30 THEN b1.family ELSE spare END AS family, round(CASE WHEN b1.z >= 30 THEN b1.z ELSE 0 END, 6) AS z FROM b1 FULL JOIN sp ON sp.incident = b1.incident AND sp.node = b1.node WHERE CASE WHEN b1.z >= 30 THEN b1.family ELSE spare END IS NOT NULL"
)
def resource_family(spark, d):
    return E.resource_family(metric_stats(spark, d), ["incident", "node"]).select("incident", "node", "family", F.round("z", 6).alias("z"))


#: Features of datasets: five names of a rotating list for each user.
FEATURES = "interface_rx_bytes_rate node_memory_available_ratio frr_bgp_peer_up ospf6_interface_cost web_flow_latency dns_flow_total acl_hits scrape_up softirq_net ipv6_route_exists carrier_changes auth_flow_error filesystem_used_ratio cpu_usage ipv6_default_route_info".split()
FEATURE_SQL = f"([{', '.join(repr(m) for m in FEATURES)}])[(user_id * 4 + k % 2) % 15 + 1]"


@query(
    f"WITH {EVENTS}, fx AS (SELECT user_id, {FEATURE_SQL} AS name, value / 60 AS value FROM ev), a AS (SELECT user_id, min(value) FILTER (contains(name, 'bgp_peer_up')) AS up, min(value) FILTER (contains(name, 'ipv6_default_route_info')) AS dr, min(value) FILTER (contains(name, 'ipv6_route_exists')) AS ex, list(DISTINCT name) AS ns FROM fx GROUP BY 1), "
    "c AS (SELECT user_id, user_id % 4 = 0 AS fw, up, dr, ex, array_to_string(ns, ' ') AS j FROM a) SELECT user_id, CASE WHEN up < 1 THEN 'routing/bgp_session_down' WHEN contains(j, 'ospf6_interface_cost') THEN 'routing/ospf6_cost_anomaly' WHEN dr < 1 AND fw THEN 'firewall/default_route_error' WHEN dr < 1 THEN 'routing/wrong_default_route' WHEN ex < 1 THEN 'routing/blackhole' "
    "WHEN fw AND contains(j, 'acl') THEN 'firewall/acl_drop' WHEN fw AND contains(j, 'bytes_rate') THEN 'firewall/rate_limit' WHEN fw AND contains(j, 'cpu_usage') THEN 'firewall/cpu_pressure' WHEN contains(j, 'memory_available_ratio') THEN 'resource/memory_pressure' WHEN contains(j, 'softirq') THEN 'resource/softirq_pressure' WHEN contains(j, 'filesystem_used_ratio') THEN 'resource/disk_space_low' "
    "WHEN contains(j, 'cpu_usage') THEN 'resource/cpu_pressure' WHEN contains(j, 'carrier_changes') THEN 'link/loss' WHEN contains(j, 'latency') THEN 'link/delay' WHEN contains(j, 'rx_bytes_rate') THEN 'link/rate_limit' WHEN contains(j, 'dns_flow') THEN 'service/dns_wrong_record' WHEN contains(j, 'auth_flow_error') THEN 'service/auth_error' WHEN fw THEN 'firewall/cpu_pressure' WHEN user_id % 4 = 1 THEN 'link/loss' ELSE 'link/delay' END AS category FROM c"
)
def category_rules(spark, d):
    e = events(spark, d)
    name = F.element_at(F.array(*map(F.lit, FEATURES)), ((F.col("user_id") * 4 + F.col("k") % 2) % 15 + 1).cast("int"))
    kind = F.when(F.col("user_id") % 4 == 0, "firewall").when(F.col("user_id") % 4 == 1, "br").otherwise("host")
    kinds = e.select("user_id").distinct().select("user_id", F.array(kind).alias("kinds"))
    found = E.classified(e.select("user_id", name.alias("name"), (F.col("value") / 60).alias("value")), kinds, "user_id")
    return found.select("user_id", F.concat_ws("/", "major", "sub").alias("category"))


@query("WITH m AS (SELECT unnest(['link', 'firewall', 'resource', 'routing', 'service']) AS major), s AS (SELECT unnest(['delay', 'rate_limit', 'cpu_pressure', 'blackhole', 'dns_down', 'web_slow', 'acl_drop', 'loss']) AS sub) SELECT major, sub, (major || '/' || sub) IN ('link/delay', 'link/rate_limit', 'link/loss', 'firewall/rate_limit', 'firewall/cpu_pressure', 'firewall/acl_drop', 'resource/cpu_pressure', 'routing/blackhole', 'service/dns_down', 'service/web_slow') AS legal FROM m, s")
def category_closure(spark, d):
    majors = spark.createDataFrame([("link",), ("firewall",), ("resource",), ("routing",), ("service",)], "major string")
    subs = F.explode(F.array(*map(F.lit, ("delay", "rate_limit", "cpu_pressure", "blackhole", "dns_down", "web_slow", "acl_drop", "loss"))))
    pairs = majors.select("major", subs.alias("sub"))
    return pairs.select("major", "sub", E.is_category(F.col("major"), F.col("sub")).alias("legal"))


SEGMENTS = f"{EVENTS}, {TRUTH}, sg AS (SELECT a * {HOUR} AS lo, b * {HOUR} AS hi FROM tu WHERE grp = 3)"


@query(f"WITH {SEGMENTS}, h AS (SELECT event_id, us, value FROM ev WHERE EXISTS (SELECT 1 FROM sg WHERE us BETWEEN lo AND hi)), k AS (SELECT * FROM h ORDER BY us, event_id LIMIT 200) SELECT (SELECT count(*) FROM ev)::BIGINT AS rows_scanned, (SELECT count(*) FROM h)::BIGINT AS rows_met, count(*) AS rows_kept, (SELECT count(*) FROM h) > 200 AS truncated, min(us) AS first_us, max(us) AS last_us, round(sum(value), 4) AS total FROM k")
def windowed_scan(spark, d):
    """Events in the windows of incidents, at most 200 of them in order of time, with the scan's statistics."""
    windows = truth(spark, d).where("grp = 3").select((F.col("a") * HOUR).alias("lo"), (F.col("b") * HOUR).alias("hi"))
    scan = scans.windowed(events(spark, d).select("event_id", "us", "value"), "us", "event_id", windows, 200, float(24 * HOUR))
    kept = scan.rows.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.round(F.sum("value"), 4).alias("total"))
    return scan.statistics.crossJoin(F.broadcast(kept))  # one row each


@query(f"WITH {EVENTS}, k AS (SELECT * FROM ev ORDER BY us, event_id LIMIT 300) SELECT (SELECT count(*) FROM ev)::BIGINT AS rows_met, count(*) AS rows_kept, (SELECT count(*) FROM ev) > 300 AS truncated, round(sum(value), 4) AS total FROM k")
def head_scan(spark, d):
    """The first 300 events in order of time, the whole table if the budget is negative or 0."""
    scan = scans.head(events(spark, d).select("event_id", "us", "value"), "us", "event_id", 300)
    return scan.statistics.select("rows_met", "rows_kept", "truncated").crossJoin(F.broadcast(scan.rows.agg(F.round(F.sum("value"), 4).alias("total"))))


ELEMENT = "CASE c_custkey % 7 WHEN 0 THEN 'xian-br-1' WHEN 1 THEN 'xian-xian-cr-2' WHEN 2 THEN 'fw' WHEN 3 THEN 'beida-service-vm-' || (c_custkey % 3 + 1) WHEN 4 THEN 'monitor-vm ' WHEN 5 THEN 'core-7' ELSE 'xian-beida-traffic-vm' END"


def elements(spark, d) -> DataFrame:
    k = F.col("c_custkey") % 7
    raw = F.when(k == 0, "xian-br-1").when(k == 1, "xian-xian-cr-2").when(k == 2, "fw").when(k == 3, F.concat(F.lit("beida-service-vm-"), F.col("c_custkey") % 3 + 1)).when(k == 4, "monitor-vm ").when(k == 5, "core-7").otherwise("xian-beida-traffic-vm")
    return table(spark, d, "customer", "c_custkey").withColumn("raw", raw)


@query(
    f"WITH e AS (SELECT c_custkey, {ELEMENT} AS raw, 'service-vm-' || (c_custkey % 3 + 1) AS vm FROM customer) SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'br-1' WHEN 1 THEN 'cr-2' WHEN 2 THEN 'fw' WHEN 3 THEN vm WHEN 4 THEN 'monitor-vm' WHEN 5 THEN 'core-7' ELSE 'traffic-vm' END AS role_key, "
    "CASE c_custkey % 7 WHEN 0 THEN 'br-1' WHEN 1 THEN 'cr-2' WHEN 2 THEN 'fw' WHEN 3 THEN vm WHEN 4 THEN 'monitor-vm' WHEN 5 THEN '?' ELSE 'traffic-vm' END AS role, CASE WHEN regexp_matches(raw, 'service-vm|traffic-vm|monitor-vm|br-|cr-|fw') THEN trim(regexp_extract(raw, '(service-vm|traffic-vm|monitor-vm|br-|cr-|fw)', 1), '-') ELSE '?' END AS family FROM e"
)
def role_names(spark, d):
    raw = F.col("raw")
    return elements(spark, d).select("c_custkey", S.role_key(raw).alias("role_key"), S.role_of(raw).alias("role"), S.role_family(raw).alias("family"))


@query(f"WITH e AS (SELECT c_custkey, {ELEMENT} AS raw FROM customer) SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN raw WHEN 1 THEN 'xian-cr-2' WHEN 2 THEN 'xian-fw' WHEN 3 THEN raw WHEN 4 THEN raw WHEN 5 THEN raw ELSE 'xian-traffic-vm' END AS id, CASE c_custkey % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'stripped' WHEN 2 THEN 'added' WHEN 3 THEN 'ok' WHEN 4 THEN 'unparsable' WHEN 5 THEN 'unparsable' ELSE 'stripped' END AS action FROM e")
def element_repair(spark, d):
    return elements(spark, d).select("c_custkey", S.repaired_id(F.col("raw"), F.lit("xian"), ("xian", "beida")).alias("r")).select("c_custkey", "r.id", "r.action")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(regexp_extract(c_mktsegment, '^([A-Za-z]+)', 1)) WHEN 1 THEN 'xian' WHEN 2 THEN '2024_' || lower(c_mktsegment) ELSE 'unknownregion' END AS region FROM customer")
def region_codes(spark, d):
    own = F.col("c_custkey") % 4
    name = F.when(own == 0, F.concat("c_mktsegment", F.lit("_2024"))).when(own == 1, F.lit("数据 西安 3")).when(own == 2, F.concat(F.lit("2024 "), "c_mktsegment", F.lit("!"))).otherwise("--")
    return table(spark, d, "customer", "c_custkey", "c_mktsegment").select("c_custkey", S.region_code(name).alias("region"))


@query("SELECT event_id, 'set:u' || user_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS point_id FROM events")
def point_ids(spark, d):
    return table(spark, d, "events", "event_id", "ts", "user_id").select("event_id", S.point_id(F.lit("set"), F.concat(F.lit("u"), "user_id"), F.col("ts").cast("timestamp")).alias("point_id"))


@query(f"WITH {EVENTS}, s AS (SELECT event_type, list_sort(list(value)) AS x FROM ev GROUP BY 1) SELECT event_type, len(x) AS n, round(x[floor(0.5 * (len(x) - 1))::INT + 1], 6) AS median, round(x[floor(0.9 * (len(x) - 1))::INT + 1], 6) AS p90, round(x[floor(0.99 * (len(x) - 1))::INT + 1], 6) AS p99, round(x[-1], 6) AS most, len(list_filter(x, lambda v: v > 0)) AS n_positive FROM s")
def percentile_diagnostics(spark, d):
    q = E.lower_quantiles(events(spark, d).select("event_type", "value"), "value", [0.5, 0.9, 0.99], ["event_type"])
    return q.select("event_type", "n", *(F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("median", "p90", "p99"))), F.round("most", 6).alias("most"), "n_positive")


@query(f"WITH {POINTS}, i AS (SELECT DISTINCT user_id % 10 AS incident, user_id AS node FROM pt), s AS (SELECT user_id AS node, max(m) AS score FROM pt WHERE m > 60 GROUP BY 1) SELECT incident, node, round(coalesce(score, 0), 6) AS root_cause_score FROM i LEFT JOIN s USING (node)")
def second_stage_broadcast(spark, d):
    p = points(spark, d)
    incidents = p.groupBy((F.col("user_id") % 10).alias("incident")).agg(F.collect_set("user_id").alias("nodes"))
    scores = p.where("m > 60").groupBy(F.col("user_id").alias("node")).agg(F.max("m").alias("score"))
    return E.broadcast_scores(incidents, scores).withColumn("root_cause_score", F.round("root_cause_score", 6))


@query(
    f"WITH {EVENTS}, {PRED}, {TRUTH}, pt2 AS (SELECT user_id % 10 AS grp, us / {HOUR}.0 AS at FROM ev WHERE value > 150), n AS (SELECT grp, id, (SELECT min(abs(pt2.at - (pr.a + pr.b) / 2)) FROM pt2 WHERE pt2.grp = pr.grp) AS far FROM pr), g AS (SELECT id FROM n ORDER BY round(coalesce(far, 'inf'::DOUBLE), 9) DESC, id LIMIT 20) "
    "SELECT grp, id, round(a, 6) AS a, FALSE AS added FROM pr WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT * FROM (SELECT grp, id, round(a, 6), TRUE FROM tu ORDER BY id LIMIT 20)"
)
def swap_budget(spark, d):
    at = events(spark, d).where("value > 150").select((F.col("user_id") % 10).alias("grp"), (F.col("us") / F.lit(float(HOUR))).alias("at"))
    out = E.swapped_budget(predictions(spark, d), truth(spark, d), at, ["grp"], 20)
    return out.select("grp", "id", F.round("a", 6).alias("a"), "added")


@query(f"WITH {CANDIDATES}, aw AS (SELECT incident, list(node ORDER BY rank)[1:5] AS top, count(*) AS n FROM rk GROUP BY 1), f AS (SELECT incident, arg_min(t, rank) AS at_us FROM rk WHERE t IS NOT NULL GROUP BY 1) SELECT incident, at_us, array_to_string(top, ',') AS top FROM aw JOIN f USING (incident) WHERE len(top) >= 5")
def answer_anchors(spark, d):
    c = candidates_of(spark, d)
    answers = c.where("rank <= 5").groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("top"))
    return E.anchors(answers, c).select("incident", F.col("at").alias("at_us"), F.concat_ws(",", "top").alias("top"))


@query(f"WITH {EVENTS}, r AS (SELECT user_id, count(*) FILTER (event_type = 'error') / count(*) AS rate FROM ev GROUP BY 1) SELECT user_id, CASE WHEN rate <= 0.10 THEN 'stable' WHEN rate <= 0.40 THEN 'mixed' ELSE 'unstable' END AS stability, CASE WHEN user_id % 4 = 0 THEN 'prior wins over evidence' WHEN user_id % 4 = 1 THEN 'evidence is read, wording matters' WHEN user_id % 4 = 2 THEN 'guessing' ELSE 'stable' END AS reading FROM r")
def verdict_tables(spark, d):
    r = events(spark, d).groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("rate"))
    own = F.col("user_id") % 4
    stability, reading = F.when(own.isin(0, 3), "high").otherwise("low"), F.when(own.isin(1, 3), "high").otherwise("low")
    return r.select("user_id", E.stability_verdict(F.col("rate")).alias("stability"), E.reading_verdict(stability, reading).alias("reading"))


@query()
def thinned_evidence(spark, d):
    """Five repeats of the facts, each without a tenth, by hash."""
    return E.thinned(facts(spark, d), F.col("label"), 5, 0.1).groupBy("repeat", "incident").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS}, n AS (SELECT list_sort(list(DISTINCT x)) AS nodes FROM (SELECT src AS x FROM ed UNION SELECT dst FROM ed)), b AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ed WHERE src <> dst) SELECT (SELECT len(nodes) FROM n) AS n_nodes, (SELECT array_to_string(nodes, ',') FROM n) AS nodes, count(*) AS n_edges, string_agg(a || '-' || b, ',' ORDER BY a, b) AS edges FROM b")
def topology_payload(spark, d):
    p = graph.payload(wires(spark, d))
    return p.select(F.size("nodes").alias("n_nodes"), F.array_join("nodes", ",").alias("nodes"), F.size("edges").cast("long").alias("n_edges"), F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["a"], e["b"])), ",").alias("edges"))


@query(f"WITH {EVENTS}, b AS (SELECT us // {24 * HOUR} AS day, event_type, avg(value) AS mean, max(value) AS mx FROM ev GROUP BY 1, 2) SELECT day, " + ", ".join(f"round(max(mean) FILTER (event_type = '{k}'), 6) AS traffic_{k}_flow_value_mean, max(mx) FILTER (event_type = '{k}') AS traffic_{k}_flow_value_max" for k in ("click", "error", "purchase", "signup", "view")) + " FROM b GROUP BY 1")
def traffic_pivot(spark, d):
    """Numeric columns chosen by name, their mean and maximum per bin and kind, one flat column for each."""
    rows = events(spark, d).withColumn("day", F.floor(F.col("us") / (24 * HOUR))).withColumnRenamed("value", "flow_value").withColumn("web_note", F.lit("x"))
    wide = stats.traffic_wide(rows.select("day", "event_type", F.col("flow_value").alias("dns_flow_value"), "web_note", "k"), ["day"], "event_type", ["click", "error", "purchase", "signup", "view"])
    return wide.select("day", *(F.round(c, 6).alias(c.replace("dns_flow_value", "flow_value")) if c.endswith("_mean") else F.col(c).alias(c.replace("dns_flow_value", "flow_value")) for c in wide.columns if c != "day"))


@query(f"WITH {EVENTS}, s AS (SELECT user_id, k % 5 AS neighbour, event_type AS state, us, event_id FROM ev) SELECT user_id, neighbour, CASE WHEN bool_or(state = 'view') THEN 'view' ELSE arg_min(state, (us, event_id)) END AS best, arg_max(state, (us, event_id)) AS last FROM s GROUP BY 1, 2")
def session_states(spark, d):
    rows = events(spark, d).select("user_id", (F.col("k") % 5).alias("neighbour"), F.col("event_type").alias("state"), "us", "event_id")
    return stats.states(rows, ["user_id", "neighbour"], "state", ["us", "event_id"], "view")


@query(f"WITH {EVENTS}, t AS (SELECT event_id, ['n' || k, 'r-n' || (k + 1), 'n' || k, 'zz', 'n' || (k + 2)] AS said FROM ev) SELECT event_id, 'n' || (TRY_CAST(substr(said[1], 2) AS BIGINT)) || ',n' || (TRY_CAST(substr(said[1], 2) AS BIGINT) + 1) || ',n' || (TRY_CAST(substr(said[1], 2) AS BIGINT) + 2) AS ranked FROM t")
def rank_parse(spark, d):
    """Ranked names as a model gives them: region prefixes stripped, unknown and repeated names dropped, order kept."""
    k = F.col("k").cast("string")
    said = F.array(F.concat(F.lit("n"), k), F.concat(F.lit("r-n"), (F.col("k") + 1).cast("string")), F.concat(F.lit("n"), k), F.lit("zz"), F.concat(F.lit("n"), (F.col("k") + 2).cast("string")))
    legal = F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.concat(F.lit("n"), i.cast("string")))
    return events(spark, d).select("event_id", F.concat_ws(",", D.named_ranks(said, legal)).alias("ranked"))


@query(
    f"WITH {EVENTS}, {PRED}, o AS (SELECT *, a - lag(b) OVER (PARTITION BY grp ORDER BY a, id) AS g FROM pr), x AS (SELECT *, coalesce(g, 1e9) AS gap FROM o), c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(gap, 9) DESC, a, id) AS cr, count(*) OVER (PARTITION BY grp) AS n FROM x), k AS (SELECT *, cr <= 3 AND gap >= 20 AS clean FROM c), "
    "m AS (SELECT grp, id, a, row_number() OVER (PARTITION BY grp ORDER BY a, id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS r, 5 - (SELECT count(*) FROM k z WHERE z.grp = k.grp AND z.clean) AS need FROM k WHERE NOT clean), "
    "s AS (SELECT grp, id FROM k WHERE clean UNION ALL SELECT grp, id FROM m WHERE r <= need OR list_contains(list_transform(range(need), lambda j: round(j * (r - 1) / greatest(need - 1, 1))::BIGINT), i)) SELECT grp, id FROM s"
)
def clean_and_even_sample(spark, d):
    w = Window.partitionBy("grp").orderBy("a", "id")
    x = predictions(spark, d).withColumn("gap", F.coalesce(F.col("a") - F.lag("b").over(w), F.lit(1e9)))
    return ranks.clean_and_even(x, ["grp"], "gap", "a", "id", 20.0, 5).select("grp", "id")


@query(f"WITH {EVENTS}, {PRED}, {TRUTH}, m AS (SELECT pr.id AS p, tu.id AS t, 2.0 * greatest(0, least(pr.b, tu.b) - greatest(pr.a, tu.a)) / ((pr.b - pr.a) + (tu.b - tu.a)) AS dice, abs(pr.a - tu.a) + abs(pr.b - tu.b) AS far, pr.a AS pa, pr.b AS pb FROM pr JOIN tu ON pr.grp = tu.grp AND pr.a <= tu.b AND tu.a <= pr.b), b AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY round(dice, 9) DESC, t) AS rp, row_number() OVER (PARTITION BY t ORDER BY round(dice, 9) DESC, p) AS rt FROM m WHERE dice >= 0.4) SELECT p, t, round(0.7 + 0.3 * greatest(0, 1 - far * 3600 / 360), 6) AS s_ad, CASE WHEN p % 5 = t % 5 THEN 40.0::DOUBLE WHEN p % 5 = (t + 1) % 5 THEN 32.0::DOUBLE ELSE 0.0::DOUBLE END AS rca, CASE WHEN p % 3 = t % 3 THEN 10.0 ELSE 0 END::DOUBLE AS major, CASE WHEN p % 3 = t % 3 AND p % 2 = t % 2 THEN 10.0 ELSE 0 END::DOUBLE AS minor FROM b WHERE rp = 1 AND rt = 1")
def judge_metrics(spark, d):
    """Matched predictions, each with the best of the other, and the points of their times, causes and categories."""
    p = predictions(spark, d).select("grp", F.col("id").alias("p"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    t = truth(spark, d).select("grp", F.col("id").alias("t"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    m = intervals.mutual_best(p, t, ["grp"], "p", "t", ("pa", "pb"), ("ta", "tb"), 12.0, 0.4)
    top = F.array(*((F.col("p") + i) % 5 for i in (0, 4)))
    place = F.array_position(top, F.col("t") % 5)
    major = F.col("p") % 3 == F.col("t") % 3
    return m.select("p", "t", F.round(D.time_points(F.col("pa"), F.col("pb"), F.col("ta"), F.col("tb"), 3600.0), 6).alias("s_ad"), D.cause_points(place).alias("rca"), *D.category_points(major, F.col("p") % 2 == F.col("t") % 2))


@query(f"WITH {EVENTS}, g AS (SELECT user_id % 10 AS incident, user_id // 10 % 12 AS node, us // {6 * HOUR} AS slot, count(*) AS n FROM ev GROUP BY 1, 2, 3), f AS (SELECT incident, node, slot, 0.5 + (percent_rank_ + 0.5) / k AS factor FROM (SELECT *, row_number() OVER (PARTITION BY incident, node ORDER BY n, slot) - 1 AS percent_rank_, count(*) OVER (PARTITION BY incident, node) AS k FROM g)) SELECT incident, node, round(avg(factor) FILTER (slot BETWEEN 78910 AND 78950), 6) AS factor FROM f GROUP BY 1, 2 HAVING count(*) FILTER (slot BETWEEN 78910 AND 78950) > 0")
def cross_region_factor(spark, d):
    g = events(spark, d).groupBy((F.col("user_id") % 10).alias("incident"), (F.floor(F.col("user_id") / 10) % 12).alias("node"), F.floor(F.col("us") / (6 * HOUR)).alias("slot")).agg(F.count("*").alias("n"))
    f = ranks.rank_factor(g, ["incident", "node"], "n", "slot", 0.5, 1.5, "factor")
    return f.where(F.col("slot").between(78910, 78950)).groupBy("incident", "node").agg(F.round(F.avg("factor"), 6).alias("factor"))


@query(f"WITH {FLOW}, e AS (SELECT src, sum(packets) FILTER (day BETWEEN 10000 AND 10029) / 30 AS now, sum(packets) FILTER (day BETWEEN 9970 AND 9998) / 29.0 AS base, avg(bytes) FILTER (day BETWEEN 10000 AND 10029) AS span, avg(bytes) FILTER (day BETWEEN 9970 AND 9998) AS span0 FROM fl GROUP BY 1) SELECT src, round(now / base, 6) AS rate_ratio, round(span / span0, 6) AS span_ratio, CASE WHEN now / base < 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS error_rate FROM e WHERE base > 0 AND now IS NOT NULL")
def rebuilt_service_rates(spark, d):
    x = stats.rebuilt_rates(flows(spark, d), ["src"], "day", "packets", "bytes", (10000, 10029), (9970, 9998))
    return x.select("src", F.round("rate_ratio", 6).alias("rate_ratio"), F.round("span_ratio", 6).alias("span_ratio"), "error_rate")


@query(f"WITH {FACTS}, f AS (SELECT DISTINCT incident, node FROM fa), b AS (SELECT src AS node, dst AS other FROM ed WHERE src <> dst UNION SELECT dst, src FROM ed WHERE src <> dst) SELECT x.incident, x.node AS src, y.node AS dst FROM f x JOIN b ON b.node = x.node JOIN f y ON y.incident = x.incident AND y.node = b.other")
def incident_edges(spark, d):
    return graph.within(wires(spark, d), facts(spark, d).select("incident", "node").distinct(), "incident")


@query(f"WITH {POINTS}, b AS (SELECT ('n' || (n_nationkey % 14)) AS s, ('n' || ((n_nationkey * 5 + 2) % 14)) AS t FROM nation), bw AS (SELECT s, t FROM b WHERE s <> t UNION SELECT t, s FROM b WHERE s <> t), p AS (SELECT DISTINCT 'n' || (user_id % 14) AS node, h FROM pt) SELECT x.h, x.node AS src, y.node AS dst FROM p x JOIN bw ON bw.s = x.node JOIN p y ON y.h = x.h AND y.node = bw.t")
def point_topology_edges(spark, d):
    p = points(spark, d).select(F.concat(F.lit("n"), F.col("user_id") % 14).alias("node"), "h").distinct()
    return graph.within(wires(spark, d), p, "h")


@query(f"WITH {FACTS}, n AS (SELECT DISTINCT incident, node FROM fa), kd AS (SELECT src, dst, 'wire' AS kind FROM ed WHERE src <> dst), u AS (SELECT dst AS node, string_agg(DISTINCT src || '(wire)', ', ' ORDER BY src || '(wire)') AS up FROM kd GROUP BY 1), w AS (SELECT src AS node, string_agg(DISTINCT dst || '(wire)', ', ' ORDER BY dst || '(wire)') AS down FROM kd GROUP BY 1) SELECT incident, string_agg('- ' || n.node || ': upstream=[' || coalesce(up, 'none') || '], downstream=[' || coalesce(down, 'none') || ']', chr(10) ORDER BY n.node) AS text FROM n LEFT JOIN u ON u.node = n.node LEFT JOIN w ON w.node = n.node GROUP BY 1")
def dependency_context(spark, d):
    from tracewarden.operators.dialogue import dependency_text

    inc = facts(spark, d).groupBy("incident").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    return dependency_text(inc, wires(spark, d).where("src <> dst").withColumn("kind", F.lit("wire")))


@query(f"WITH {EVENTS}, v AS (SELECT user_id, count(*) AS hits, max(us) AS last FROM ev GROUP BY 1) SELECT count(*) AS templates, sum(hits)::BIGINT AS hits, max(hits) AS most, count(*) FILTER (hits = 1) AS singles FROM v")
def memory_statistics(spark, d):
    """What a memory of templates holds: their number, all hits, the most of one, and those met once."""
    from tracewarden.operators.models import memory_stats

    return memory_stats(events(spark, d).select(F.col("user_id").alias("template")))


def _model_rows(spark, d) -> DataFrame:
    return points(spark, d).select("user_id", "h", (F.col("user_id") * 1_000_000 + F.col("h")).alias("key"), "m", "mx", F.col("n").cast("double").alias("n"))


@query()
def vae_score(spark, d):
    """Reconstruction error of the variational autoencoder, as a unit rank."""
    from tracewarden.operators import neural
    from tracewarden.session import settled

    x = settled(neural.autoencoder_error(_model_rows(spark, d), ["m", "mx", "n"], "key", epochs=5), "vae")
    return ranks.rank_to_unit(x, "recon_error", "score").select("user_id", "h", "score")


@query()
def second_vae_score(spark, d):
    """The same of a model that learns calm points only: those whose first score is above the threshold weigh nothing."""
    from tracewarden.operators import neural
    from tracewarden.session import settled

    x = ranks.rank_to_unit(_model_rows(spark, d), "m", "first")
    x = settled(x.withColumn("w", neural.second_stage_weight(F.col("first"), "threshold")), "weighted")
    y = settled(neural.autoencoder_error(x, ["m", "mx", "n"], "key", "w", hidden=32, latent=4, epochs=5), "second")
    return ranks.rank_to_unit(y, "recon_error", "score").select("user_id", "h", "score")


@query()
def graph_normal_score(spark, d):
    """How normal each point is by itself, the points before and after it, and those of adjacent elements."""
    from tracewarden.operators import neural

    x = ranks.rank_to_unit(_model_rows(spark, d), "m", "s")
    w = Window.partitionBy("user_id").orderBy("h")
    edges = x.select(F.lag("key").over(w).alias("src"), F.col("key").alias("dst")).where("src is not null")
    q = ranks.quantiles(x, "s", [0.75, 0.9]).scalar()
    label = F.when(F.col("s") <= F.col("q")[0], 1.0).when(F.col("s") >= F.col("q")[1], 0.0)
    nodes = x.withColumn("q", q).select(F.col("key").alias("node"), "m", "mx", "n", label.alias("label"), (1 - F.col("s")).alias("score"))
    return neural.graph_normal_score(nodes, edges, ["m", "mx", "n"], epochs=5)


@query()
def learned_root_scores(spark, d):
    """Root scores of candidates from a network that learns the heuristic target and the ranking within incidents."""
    from tracewarden.operators import neural

    c = candidates_of(spark, d).withColumn("key", F.xxhash64("incident", "node"))
    names = list(D.ROOT_WEIGHTS)
    c = ranks.min_max(c.withColumn("raw", 0.65 * F.col("local_anomaly") + 0.35 * F.col("temporal_priority")), ["incident"], "raw", "target").withColumn("category", (F.col("incident") % 5).cast("int"))
    return neural.root_scores(c.select("incident", "node", "key", *names, "target", "category"), names, "key", "incident", "target", "category", epochs=20).select("incident", "node", "root_score")


@query()
def forecast_error(spark, d):
    """The error of a self-supervised forecaster over each element's points."""
    from tracewarden.operators import neural

    return neural.forecast_error(points(spark, d).select("user_id", "h", "m", "mx"), ["user_id"], "h", ["m", "mx"], epochs=3)


@query()
def text_vector_norms(spark, d):
    """Vectors of messages: their length, and how alike each is to the vector of its template."""
    from tracewarden.operators import models, neural
    from tracewarden.plans.features import messages

    v = neural.text_vectors(messages(spark, d).select("event_id", "message", S.template(F.col("message")).alias("template")), "message", out="x")
    v = neural.text_vectors(v, "template", out="y")
    return v.select("event_id", F.round(models.norm(F.col("x")), 6).alias("norm"), F.round(models.dot(F.col("x"), F.col("y")), 6).alias("sim"))


@query(f"WITH {FACTS}, w AS (SELECT incident, node, min(time) AS a, max(time) AS b FROM fa GROUP BY 1, 2) SELECT incident, min(a) AS a, max(b) AS b, string_agg(node, ',' ORDER BY node) AS nodes FROM w GROUP BY 1")
def incident_windows(spark, d):
    w = facts(spark, d).groupBy("incident", "node").agg(F.min("time").alias("a"), F.max("time").alias("b"))
    return E.incident_windows(w).select("incident", "a", "b", F.array_join("nodes", ",").alias("nodes"))


@query(f"WITH {CANDIDATES} SELECT node, round(max(root), 6) AS score FROM rk GROUP BY 1")
def element_root_scores(spark, d):
    scores = candidates_of(spark, d).select("incident", "node", F.col("root_score").alias("score"))
    return E.best_scores(scores).select("node", F.round("score", 6).alias("score"))


@query(f"WITH {POINTS}, x AS (SELECT user_id AS node, avg(m) AS mean, max(m) AS peak FROM pt GROUP BY 1) SELECT node, round(mean, 6) AS mean, round(peak, 6) AS peak, round(0.65 * peak + 0.35 * mean, 6) AS level FROM x")
def second_stage_nodes(spark, d):
    x = E.node_levels(points(spark, d).select(F.col("user_id").alias("node"), F.col("m").alias("score")))
    return x.select("node", *(F.round(c, 6).alias(c) for c in ("mean", "peak", "level")))


@query(f"WITH {FLOW}, e AS (SELECT src % 5 AS incident, src, dst, round(sum(bytes), 2) AS bytes, count(*) AS n FROM fl WHERE src <> dst GROUP BY 1, 2, 3) SELECT incident, src, dst, bytes, n, row_number() OVER (PARTITION BY incident ORDER BY bytes DESC, src, dst) AS rank FROM e QUALIFY rank <= 4")
def top_edges(spark, d):
    """The heaviest edges of each incident."""
    e = flows(spark, d).where("src <> dst").groupBy((F.col("src") % 5).alias("incident"), "src", "dst").agg(F.round(F.sum("bytes"), 2).alias("bytes"), F.count("*").alias("n"))
    return ranks.top_k(e, ["incident"], [F.desc("bytes"), F.col("src"), F.col("dst")], 4)


LEGAL = "['n0', 'n1', 'n2', 'n3', 'n4', 'n5', 'n12']"


@query(f"WITH {CANDIDATES}, c3 AS (SELECT incident, list(node ORDER BY place) AS own FROM cl WHERE place <= 3 GROUP BY 1), m AS (SELECT incident, list(node ORDER BY -round(root, 9), node) AS more FROM rk GROUP BY 1), o AS (SELECT incident, list_concat(own, list_filter(more, lambda x: NOT list_contains(own, x))) AS l FROM c3 JOIN m USING (incident)) SELECT incident, array_to_string(list_filter(l, lambda x: list_contains({LEGAL}, x)), ',') AS nodes FROM o")
def candidate_order(spark, d):
    own = claimed(facts(spark, d)).where("place <= 3").groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("nodes"))
    scores = candidates_of(spark, d).select("incident", "node", F.round("root_score", 9).alias("score"))
    legal = F.array(*map(F.lit, ("n0", "n1", "n2", "n3", "n4", "n5", "n12")))
    return E.candidate_order(own, scores, legal).select("incident", F.array_join("nodes", ",").alias("nodes"))


@query(f"WITH {FACTS}, s AS (SELECT incident, list_sort(list(DISTINCT node)) AS x, list_sort(list(DISTINCT node) FILTER (modality = 'routing')) AS y FROM fa GROUP BY 1) SELECT a.incident AS x, b.incident AS y, len(list_intersect(coalesce(a.y, []), coalesce(b.y, []))) > 0 AS overlap, len(list_distinct(list_concat(coalesce(a.y, []), coalesce(b.y, []))))::INTEGER AS n_union, round(len(list_intersect(coalesce(a.y, []), coalesce(b.y, []))) / greatest(1, len(list_distinct(list_concat(coalesce(a.y, []), coalesce(b.y, []))))), 6) AS jaccard FROM s a JOIN s b ON b.incident = a.incident + 1")
def node_sets(spark, d):
    """Elements with routing facts of neighbouring incidents: whether they meet, their union, and their Jaccard coefficient."""
    s = facts(spark, d).groupBy("incident").agg(F.collect_set(F.when(F.col("modality") == "routing", F.col("node"))).alias("y"))
    other = s.select((F.col("incident") - 1).alias("incident"), F.col("y").alias("z"))
    meet = F.arrays_overlap("y", "z")
    return s.join(other, "incident").select(F.col("incident").alias("x"), (F.col("incident") + 1).alias("y"), meet.alias("overlap"), F.size(F.array_union("y", "z")).alias("n_union"), F.round(S.jaccard(F.col("y"), F.col("z")), 6).alias("jaccard"))


@query(f"WITH {EVENTS}, {PRED}, p AS (SELECT grp, id, a + unnest(range(0, greatest(1, ceil((b - a) / 6))::BIGINT)) * 6.0 AS s, b FROM pr), q AS (SELECT grp, least(b, s + 6) - s AS len, s, row_number() OVER (PARTITION BY id ORDER BY s) AS k FROM p), r AS (SELECT grp, len FROM q WHERE k = 1 OR len >= 1), l AS (SELECT grp, list_sort(list(len)) AS x FROM r GROUP BY 1) SELECT grp, len(x) AS n, round(x[floor(0.5 * (len(x) - 1))::INT + 1], 6) AS median, round(x[floor(0.9 * (len(x) - 1))::INT + 1], 6) AS p90, round(x[-1], 6) AS most FROM l")
def retime_report(spark, d):
    """Windows cut into pieces of at most six hours, and what the pieces' lengths are in each group."""
    pieces = intervals.split_intervals(predictions(spark, d), "a", "b", 6.0, 1.0).select("grp", (F.col("piece_end") - F.col("piece_start")).alias("len"))
    q = E.lower_quantiles(pieces, "len", [0.5, 0.9], ["grp"])
    return q.select("grp", "n", F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p90"), F.round("most", 6).alias("most"))


@query("SELECT event_id, round(value, 6) AS score FROM events")
def spread_resolution(spark, d):
    """The first score column that varies: one that is constant does not count."""
    e = events(spark, d).withColumns({"combined": F.lit(0.5), "forest": F.col("value"), "recon": F.col("value") * 2})
    _, found = E.resolved_score(e, ["missing", "combined", "forest", "recon"], "final_normal")
    return found.select("event_id", F.round("score", 6).alias("score"))


RAW_FLOW = "CASE l_orderkey % 4 WHEN 0 THEN 'BR-0' || (l_suppkey % 9 + 1) WHEN 1 THEN ' ' WHEN 2 THEN 'NULL' ELSE 'edge-firewall' END"


@query(f"SELECT CASE l_orderkey % 4 WHEN 0 THEN 'br-' || (l_suppkey % 9 + 1) WHEN 3 THEN 'fw' ELSE 'unknown' END AS node, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE l_returnflag END AS protocol, count(*) AS n, round(sum(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_quantity END), 2)::DOUBLE AS packets, min(epoch_us(l_shipdate) // 60000000) AS first_minute FROM lineitem GROUP BY 1, 2")
def flow_normalisation(spark, d):
    """Raw flow records, with missing markers and names as they come, in one form."""
    k = F.col("l_orderkey")
    node = F.when(k % 4 == 0, F.concat(F.lit("BR-0"), (F.col("l_suppkey") % 9 + 1).cast("string"))).when(k % 4 == 1, " ").when(k % 4 == 2, "NULL").otherwise("edge-firewall")
    raw = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_quantity").select(
        F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("minute_utc"), node.alias("node_key"), F.when(k % 3 == 0, "nan").otherwise(F.col("l_returnflag")).alias("protocol"),
        F.lit("a").alias("src_addr"), F.lit("b").alias("dst_addr"), F.when(k % 5 == 0, "\\N").otherwise(F.col("l_quantity").cast("string")).alias("packets"),
    )
    from tracewarden.sources.tables import flow_records

    x = flow_records(raw).groupBy("node", "protocol")
    return x.agg(F.count("*").alias("n"), F.round(F.sum("packets"), 2).alias("packets"), F.min("ts_min").alias("first_minute"))


@query(f"WITH {EVENTS}, c AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM ev), f AS (SELECT user_id, greatest(total - lag(total) OVER (PARTITION BY user_id ORDER BY us, event_id), 0) AS delta, value FROM c) SELECT user_id, count(delta) AS n, sum(delta)::BIGINT AS delta, round(sum(value), 4) AS gauge FROM f GROUP BY 1")
def traffic_counters(spark, d):
    """Counters among the traffic columns as changes; gauges stay."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events(spark, d).withColumn("web_flow_total", F.sum("k").over(w)).withColumn("web_flow_latency", F.col("value"))
    x = stats.counters_as_changes(rows, ["user_id"], "us", "event_id")
    return x.groupBy("user_id").agg(F.count("web_flow_total").alias("n"), F.sum("web_flow_total").alias("delta"), F.round(F.sum("web_flow_latency"), 4).alias("gauge"))


@query(
    f"WITH {EVENTS}, st AS (SELECT user_id % 10 AS incident, (['br-1', 'cr-1', 'fw'])[user_id // 10 % 3 + 1] AS role, max(value) / 5 AS cpu, max(value) / 20 AS z, avg(value) / 100 AS mem, min(value) AS disk FROM ev GROUP BY 1, 2), "
    "lv AS (SELECT incident, role, CASE WHEN cpu < 5 THEN '' WHEN cpu < 15 THEN 'cpu low' WHEN cpu < 35 THEN 'cpu mid' ELSE 'cpu high' END AS a, CASE WHEN z < 3 THEN '' WHEN z < 8 THEN 'cpu_z low' WHEN z < 20 THEN 'cpu_z mid' ELSE 'cpu_z high' END AS b, CASE WHEN mem < 0.2 THEN '' WHEN mem < 0.5 THEN 'mem low' WHEN mem < 1 THEN 'mem mid' ELSE 'mem high' END AS c, CASE WHEN disk < 10 THEN '' WHEN disk < 40 THEN 'disk low' WHEN disk < 80 THEN 'disk mid' ELSE 'disk high' END AS e FROM st), "
    "ln AS (SELECT incident, string_agg(role || ' ' || array_to_string(list_filter([a, b, c, e], lambda x: x <> ''), ' '), ' ; ' ORDER BY role) AS lines FROM lv WHERE a || b || c || e <> '' GROUP BY 1), i AS (SELECT user_id % 10 AS incident, count(*) AS n, count(DISTINCT user_id) AS m, bool_or(value > 300) AS real FROM ev GROUP BY 1) "
    "SELECT i.incident, 'anomaly incident duration ' || n || ' min episodes ' || m || ' seed br-1 fw ; ' || lines || ' ; ranked candidates fw br-1 ; application flow ' || CASE WHEN i.incident % 2 = 0 THEN 'web_slow' ELSE 'none' END || ' ; routing events ' || m || ' real_protocol_signal ' || CASE WHEN real THEN 'yes blackhole' ELSE 'no blackhole' END AS text FROM i JOIN ln USING (incident)"
)
def fingerprint_text(spark, d):
    """Incidents as lines of words: levels of roles, ranked roles, flows and routing."""
    e = events(spark, d)
    key = (F.col("user_id") % 10).alias("incident")
    role = F.element_at(F.array(F.lit("br-1"), F.lit("cr-1"), F.lit("fw")), (F.floor(F.col("user_id") / 10) % 3 + 1).cast("int"))
    levels = e.groupBy(key, role.alias("role")).agg((F.max("value") / 5).alias("cpu"), (F.max("value") / 20).alias("cpu_z"), (F.avg("value") / 100).alias("memory"), F.min("value").alias("disk"))
    i = e.groupBy(key).agg(F.count("*").alias("minutes"), F.count_distinct("user_id").alias("episodes"), F.bool_or(F.col("value") > 300).alias("real"))
    top = i.select("incident", F.array(F.lit("fw"), F.lit("br-1")).alias("roles"))
    flow = i.where("incident % 2 = 0").select("incident", F.array(F.lit("web_slow")).alias("faults"))
    routing = i.select("incident", F.col("episodes").alias("events"), "real", F.array(F.lit("blackhole")).alias("subs"))
    return E.fingerprints(i.select("incident", "minutes", "episodes", F.array(F.lit("br-1"), F.lit("fw")).alias("seeds")), levels, top, flow, routing)
