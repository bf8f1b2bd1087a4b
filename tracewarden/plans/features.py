"""Feature queries: bins, pivots, counters, texts, flows, scaling and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.functions import scalars as S
from tracewarden.operators import ranks, stats
from tracewarden.plans.registry import EVENTS, HOUR, POINTS, events, points, query
from tracewarden.session import settled
from tracewarden.sources.sinks import coverage, routed
from tracewarden.sources.tables import cleaned_number, cleaned_text, merge_segments, table

UNIT = "u AS (SELECT *, (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 - 1) / greatest(1, count(*) OVER () - 1) AS s FROM pt)"
KINDS = ("error", "purchase", "signup", "view", "click")


@query(f"WITH {POINTS}, {UNIT} SELECT user_id, round(0.65 * avg(s) + 0.35 * quantile_cont(s, 0.95), 6) AS score, count(*) AS n_points FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def node_anomaly_rank(spark, d):
    scored = ranks.rank_to_unit(settled(points(spark, d), "points"), "m", "s")
    per_node = scored.groupBy("user_id").agg(F.round(0.65 * F.avg("s") + 0.35 * F.percentile("s", 0.95), 6).alias("score"), F.count("*").alias("n_points"))
    return per_node.orderBy(F.desc("score"), "user_id").limit(10)


@query(f"WITH {POINTS} SELECT user_id, h, round(m, 6) AS mean_value FROM pt")
def bin_metric_mean(spark, d):
    return points(spark, d).select("user_id", "h", F.round("m", 6).alias("mean_value"))


@query(f"WITH {EVENTS} SELECT us // {24 * HOUR} AS day, event_type, round(avg(value), 6) AS mean_value, max(value) AS max_value, count(*) AS n FROM ev GROUP BY 1, 2")
def bin_metric_mean_max(spark, d):
    day = F.floor(F.col("us") / (24 * HOUR)).alias("day")
    return events(spark, d).groupBy(day, "event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"), F.count("*").alias("n"))


def _pivot_sql(kinds):
    return ", ".join(f"round(avg(value) FILTER (event_type = '{k}'), 6) AS {k}_mean, min(value) FILTER (event_type = '{k}') AS {k}_min, max(value) FILTER (event_type = '{k}') AS {k}_max, round(stddev_samp(value) FILTER (event_type = '{k}'), 6) AS {k}_std, count(value) FILTER (event_type = '{k}') AS {k}_count" for k in kinds)


@query(f"WITH {EVENTS} SELECT user_id, us // {24 * HOUR} AS day, {_pivot_sql(KINDS)} FROM ev GROUP BY 1, 2")
def routing_pivot_stats(spark, d):
    rows = events(spark, d).withColumn("day", F.floor(F.col("us") / (24 * HOUR)))
    wide = stats.pivoted(rows, ["user_id", "day"], "event_type", list(KINDS), "value")
    return wide.select("user_id", "day", *(F.round(c, 6).alias(c) if c.endswith(("_mean", "_std")) else c for c in wide.columns[2:]))


@query(f"WITH {EVENTS}, top AS (SELECT event_type FROM ev GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev JOIN top USING (event_type) GROUP BY 1")
def frequent_metrics(spark, d):
    return stats.frequent(events(spark, d), "event_type", 2).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


COUNTER = f"{EVENTS}, ct AS (SELECT user_id, us, event_id, k, sum(k) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS c FROM ev)"


def _counter(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, d).withColumn("c", F.sum("k").over(w))


@query(f"WITH {COUNTER} SELECT event_id, diff FROM (SELECT event_id, c - lag(c) OVER (PARTITION BY user_id ORDER BY us, event_id) AS diff FROM ct) WHERE diff IS NOT NULL")
def counter_diff(spark, d):
    return stats.counter_diff(_counter(spark, d), ["user_id"], "us", "event_id", "c").select("event_id", "diff")


@query(f"WITH {EVENTS} SELECT event_id, round(diff, 6) AS diff FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) AS x, greatest(0, x) AS diff FROM ev) WHERE x IS NOT NULL")
def counter_diff_clipped(spark, d):
    return stats.counter_diff(events(spark, d), ["user_id"], "us", "event_id", "value", clip=True).select("event_id", F.round("diff", 6).alias("diff"))


@query(f"WITH {COUNTER} SELECT event_id, round(dc / (du / 60000000.0), 6) AS rate FROM (SELECT event_id, c - lag(c) OVER w AS dc, us - lag(us) OVER w AS du FROM ct WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) WHERE du > 0 AND dc >= 0")
def counter_rate(spark, d):
    rows = _counter(spark, d).withColumn("t", F.timestamp_micros("us"))
    return stats.counter_rate(rows, ["user_id"], "t", "event_id", "c").select("event_id", F.round("rate", 6).alias("rate"))


#: Messages made of the texts at hand: names and times of the table with words of the trade by number.
WORDED = """CASE event_id % 12 WHEN 0 THEN 'BGP neighbor 10.0.0.' || k || ' Down' WHEN 1 THEN 'ospf6 interface eth' || k || ' flapping' WHEN 2 THEN 'no route to 2001:db8::' || k WHEN 3 THEN 'request timed out after ' || k || ' ms' WHEN 4 THEN 'connection refused by "peer ' || k || '"'
WHEN 5 THEN 'link comes up, cost ' || k WHEN 6 THEN 'ACL rule ' || k || ' update: default_route removed' WHEN 7 THEN 'auth failed, code deadbeef' || k WHEN 8 THEN 'warning: disk  memory  cpu' WHEN 9 THEN 'dns lookup of web port ' || k WHEN 10 THEN 'deny drop blackhole' ELSE 'all quiet at ' || k END"""


def messages(spark, d):
    """Events as messages of a network's log."""
    k, own = F.col("k").cast("string"), F.col("event_id") % 12
    texts = (
        ("BGP neighbor 10.0.0.", " Down"), ("ospf6 interface eth", " flapping"), ("no route to 2001:db8::", ""), ("request timed out after ", " ms"), ('connection refused by "peer ', '"'), ("link comes up, cost ", ""),
        ("ACL rule ", " update: default_route removed"), ("auth failed, code deadbeef", ""), ("warning: disk  memory  cpu", None), ("dns lookup of web port ", ""), ("deny drop blackhole", None),
    )
    out = None
    for i, (head, tail) in enumerate(texts):
        text = F.lit(head) if tail is None else F.concat(F.lit(head), k, F.lit(tail))
        out = F.when(own == i, text) if out is None else out.when(own == i, text)
    return events(spark, d).withColumn("message", out.otherwise(F.concat(F.lit("all quiet at "), k)))


MESSAGES = f"{EVENTS}, ms AS (SELECT *, {WORDED} AS message FROM ev)"


def _count_of(word):
    return f"count(*) FILTER (contains(lower(message), '{word}'))::DOUBLE AS kw_{word}"


@query(
    f"WITH {MESSAGES} SELECT user_id, {_count_of('bgp')}, {_count_of('ospf')}, {_count_of('route')}, {_count_of('link')}, {_count_of('interface')}, {_count_of('acl')}, {_count_of('deny')}, {_count_of('drop')}, {_count_of('cpu')}, {_count_of('memory')}, {_count_of('disk')}, {_count_of('dns')}, "
    f"{_count_of('web')}, {_count_of('auth')}, {_count_of('timeout')}, {_count_of('error')}, {_count_of('fail')}, {_count_of('down')}, {_count_of('flap')}, {_count_of('blackhole')}, {_count_of('port')}, {_count_of('rule')}, {_count_of('default_route')}, count(*) AS n FROM ms GROUP BY 1"
)
def log_keyword_counts(spark, d):
    """The counted keywords of each element's messages."""
    flagged = messages(spark, d).select("user_id", *S.keyword_flags(F.col("message")))
    return flagged.groupBy("user_id").agg(*(F.sum(f"kw_{k}").alias(f"kw_{k}") for k in S.KEYWORDS), F.count("*").alias("n"))


@query(f"""WITH {MESSAGES}, t1 AS (SELECT event_id, regexp_replace(message, '"[^"]*"', '<str>', 'g') AS t FROM ms), t2 AS (SELECT event_id, regexp_replace(t, '\\b\\d{{1,3}}(\\.\\d{{1,3}}){{3}}\\b', '<ip>', 'g') AS t FROM t1), t3 AS (SELECT event_id, regexp_replace(t, '\\b([0-9a-fA-F]{{0,4}}:){{2,}}[0-9a-fA-F]{{0,4}}\\b', '<ipv6>', 'g') AS t FROM t2),
t4 AS (SELECT event_id, regexp_replace(t, '\\b[0-9a-fA-F]{{6,}}\\b', '<hex>', 'g') AS t FROM t3) SELECT event_id, trim(regexp_replace(regexp_replace(t, '\\b\\d+\\b', '<n>', 'g'), '\\s+', ' ', 'g')) AS template FROM t4""")
def log_templates(spark, d):
    return messages(spark, d).select("event_id", S.template(F.col("message")).alias("template"))


@query(f"""WITH {MESSAGES}, c AS (SELECT *, lower(message) AS low FROM ms) SELECT event_id, CASE WHEN contains(low, 'flap') THEN 'flap' WHEN regexp_matches(low, 'unavailable|no route|unreachable') THEN 'unavailable' WHEN regexp_matches(low, 'timeout|timed out') THEN 'timeout' WHEN contains(low, 'refused') THEN 'refused'
WHEN contains(low, 'down') THEN 'down' WHEN regexp_matches(low, 'up|established') THEN 'up' WHEN regexp_matches(low, 'change|update|added|removed|withdraw') THEN 'change' WHEN regexp_matches(low, 'err|could not|failed|failure') THEN 'error' WHEN contains(low, 'warn') THEN 'warning' WHEN k <= 3 THEN 'error' ELSE 'info' END AS class FROM c""")
def log_classes(spark, d):
    return messages(spark, d).select("event_id", S.semantic_class(F.col("message"), F.col("k")).alias("class"))


FLAGS = ", ".join(f"sum(CASE WHEN contains(lower(text), '{k}') THEN 1.0 ELSE 0.0 END)::DOUBLE AS kw_{k}" for k in S.KEYWORDS)


@query(f"SELECT lang, {FLAGS}, count(*) AS n FROM documents GROUP BY 1")
def keyword_flags(spark, d):
    docs = table(spark, d, "documents", "lang", "text")
    return docs.select("lang", *S.keyword_flags(F.col("text"))).groupBy("lang").agg(*(F.sum(f"kw_{k}").alias(f"kw_{k}") for k in S.KEYWORDS), F.count("*").alias("n"))


def _template_sql(c):
    for pattern, to in S.TEMPLATE:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


@query(f"SELECT conv_id, turn, {_template_sql('text')} AS template FROM conversations")
def message_template(spark, d):
    return table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", S.template(F.col("text")).alias("template"))


@query(f"SELECT {_template_sql('text')} AS template, count(*) AS n FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def template_counts(spark, d):
    return table(spark, d, "conversations", "text").groupBy(S.template(F.col("text")).alias("template")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template").limit(50)


CLASS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in S.SEMANTIC_RULES) + " WHEN n_chars % 8 <= 3 THEN 'error' ELSE 'info' END"


@query(f"SELECT source, {CLASS} AS class, count(*) AS n FROM documents GROUP BY 1, 2")
def semantic_class(spark, d):
    docs = table(spark, d, "documents", "source", "text", "n_chars")
    return docs.select("source", S.semantic_class(F.col("text"), F.col("n_chars") % 8).alias("class")).groupBy("source", "class").agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text, lang")
def event_dedup_first(spark, d):
    # the first row of each key: a minimum, combined before the shuffle, where a window would sort all rows
    return table(spark, d, "documents", "doc_id", "text", "lang").groupBy("text", "lang").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


LABELS = """'b="' || event_type || '",a="' || k || '"'"""


@query(f"WITH {EVENTS}, l AS (SELECT event_id, {LABELS} AS labels FROM ev) SELECT event_id, regexp_extract(labels, 'a=\"([^\"]*)\"', 1) AS a, regexp_extract(labels, 'b=\"([^\"]*)\"', 1) AS b, 'a=\"' || a || '\",b=\"' || b || '\"' AS label_key FROM l")
def label_map_parse(spark, d):
    labels = F.concat(F.lit('b="'), "event_type", F.lit('",a="'), F.col("k").cast("string"), F.lit('"'))
    rows = events(spark, d).select("event_id", labels.alias("labels")).withColumn("m", S.label_map(F.col("labels")))
    return rows.select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), S.label_key(F.col("labels")).alias("label_key"))


@query("SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_cos FROM events")
def time_features(spark, d):
    rows = table(spark, d, "events", "event_id", "ts").select("event_id", *S.cyclic(F.col("ts")))
    return rows.select("event_id", *(F.round(c, 6).alias(c) for c in rows.columns[1:]))


FLOW = "fl AS (SELECT s_nationkey AS src, c_nationkey AS dst, l_returnflag AS proto, epoch_us(l_shipdate) // 86400000000 AS day, l_quantity AS packets, l_extendedprice AS bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def flows(spark, d):
    """Line items as flows between nations; the small sides are broadcast if adaptive execution measures them small."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice")
    orders, customer, supplier = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    joined = lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"])
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000)
    return joined.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.col("l_returnflag").alias("proto"), day.alias("day"), F.col("l_quantity").alias("packets"), F.col("l_extendedprice").alias("bytes"))


@query(f"WITH {FLOW} SELECT src, day // 7 AS week, round(sum(bytes), 2) AS bytes, sum(packets)::DOUBLE AS packets, count(*) AS n FROM fl GROUP BY 1, 2")
def flow_sum_by_bin(spark, d):
    return flows(spark, d).groupBy("src", F.floor(F.col("day") / 7).alias("week")).agg(F.round(F.sum("bytes"), 2).alias("bytes"), F.sum("packets").cast("double").alias("packets"), F.count("*").alias("n"))


@query(f"WITH {POINTS}, per AS (SELECT h, count(*) AS k_rows FROM ev, LATERAL (SELECT us // {HOUR} AS h) GROUP BY 1) SELECT user_id, pt.h, n, k_rows FROM pt LEFT JOIN per ON pt.h = per.h")
def flow_many_to_one_join(spark, d):
    per = events(spark, d).groupBy(F.floor(F.col("us") / HOUR).alias("h")).agg(F.count("*").alias("k_rows"))
    return stats.many_to_one(points(spark, d).select("user_id", "h", "n"), per, ["h"]).select("user_id", "h", "n", "k_rows")


@query(f"WITH {FLOW} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, round(sum(bytes), 2) AS bytes, count(*) FILTER (src < dst) AS n_forward FROM fl WHERE src <> dst GROUP BY 1, 2")
def flow_pair_edges(spark, d):
    pairs = flows(spark, d).where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.agg(F.count("*").alias("n"), F.round(F.sum("bytes"), 2).alias("bytes"), F.count_if(F.col("src") < F.col("dst")).alias("n_forward"))


@query(f"WITH {FLOW} SELECT src, dst, day // 30 AS month, round(sum(bytes), 2) AS bytes, round(avg(packets), 6) AS packets FROM fl GROUP BY 1, 2, 3")
def flow_edge_curve(spark, d):
    return flows(spark, d).groupBy("src", "dst", F.floor(F.col("day") / 30).alias("month")).agg(F.round(F.sum("bytes"), 2).alias("bytes"), F.round(F.avg("packets"), 6).alias("packets"))


@query(f"WITH {FLOW}, x AS (SELECT src, dst, count(*) FILTER (day BETWEEN 10100 AND 10129) / 30.0 AS now, count(*) FILTER (day BETWEEN 9700 AND 10059) / 360.0 AS base FROM fl GROUP BY 1, 2) SELECT src, dst, round(now, 6) AS now_rate, round(base, 6) AS base_rate, round((now - base) / greatest(base, 1e-6), 6) AS change FROM x WHERE base > 0")
def flow_edge_change_rate(spark, d):
    inside, before = F.col("day").between(10100, 10129), F.col("day").between(9700, 10059)
    x = flows(spark, d).groupBy("src", "dst").agg((F.count_if(inside) / 30.0).alias("now"), (F.count_if(before) / 360.0).alias("base")).where("base > 0")
    return x.select("src", "dst", F.round("now", 6).alias("now_rate"), F.round("base", 6).alias("base_rate"), F.round((F.col("now") - F.col("base")) / F.greatest("base", F.lit(1e-6)), 6).alias("change"))


@query(f"WITH {FLOW} SELECT day // 7 AS week, proto, round(sum(packets)::DOUBLE, 2) AS packets, round(avg(bytes), 4) AS mean_bytes, CASE WHEN proto = 'A' THEN 'dns' WHEN proto = 'N' THEN 'web' ELSE 'other' END AS service FROM fl GROUP BY 1, 2")
def service_rollup(spark, d):
    x = flows(spark, d).groupBy(F.floor(F.col("day") / 7).alias("week"), "proto").agg(F.round(F.sum("packets").cast("double"), 2).alias("packets"), F.round(F.avg("bytes"), 4).alias("mean_bytes"))
    return x.withColumn("service", F.when(F.col("proto") == "A", "dns").when(F.col("proto") == "N", "web").otherwise("other"))


@query(f"WITH {POINTS}, {UNIT} SELECT user_id, h, round(s, 6) AS s FROM u")
def rank_to_unit(spark, d):
    return ranks.rank_to_unit(points(spark, d), "m", "s").select("user_id", "h", F.round("s", 6).alias("s"))


@query(f"WITH {POINTS}, {UNIT}, q AS (SELECT quantile_cont(s, 0.75) AS a, quantile_cont(s, 0.9) AS b FROM u) SELECT user_id, h, CASE WHEN s >= b THEN 2 WHEN s >= a THEN 1 ELSE 0 END AS pseudo FROM u, q")
def pseudo_labels(spark, d):
    scored = ranks.rank_to_unit(settled(points(spark, d), "points"), "m", "s", [0.75, 0.9])
    low, high = F.col("edges")[0], F.col("edges")[1]
    return scored.select("user_id", "h", F.when(F.col("s") >= high, 2).when(F.col("s") >= low, 1).otherwise(0).alias("pseudo"))


@query(f"WITH {POINTS}, {UNIT}, q AS (SELECT quantile_cont(s, 0.75) AS a FROM u) SELECT user_id, h, round(CASE WHEN s >= a THEN 0.1 ELSE 1 - s / 2 END, 6) AS weight FROM u, q")
def second_stage_weights(spark, d):
    scored = ranks.rank_to_unit(settled(points(spark, d), "points"), "m", "s", [0.75])
    return scored.select("user_id", "h", F.round(F.when(F.col("s") >= F.col("edges")[0], 0.1).otherwise(1 - F.col("s") / 2), 6).alias("weight"))


@query(f"WITH {POINTS}, f AS (SELECT user_id, h, m, mx, n::DOUBLE AS n, CASE WHEN h % 3 = 0 THEN NULL ELSE m END AS g FROM pt), i AS (SELECT user_id, h, coalesce(g, (SELECT quantile_cont(g, 0.5) FROM f)) AS g, n FROM f) SELECT user_id, h, round((g - (SELECT avg(g) FROM i)) / (SELECT stddev_pop(g) FROM i), 6) AS g, round((n - (SELECT avg(n) FROM i)) / (SELECT CASE WHEN stddev_pop(n) > 0 THEN stddev_pop(n) ELSE 1 END FROM i), 6) AS n FROM i")
def impute_scale(spark, d):
    rows = points(spark, d).select("user_id", "h", F.when(F.col("h") % 3 != 0, F.col("m")).alias("g"), F.col("n").cast("double").alias("n"))
    return stats.imputed_scaled(rows, ["g", "n"]).select("user_id", "h", F.round("g", 6).alias("g"), F.round("n", 6).alias("n"))


@query(f"WITH {POINTS}, l AS (SELECT user_id, h, 'm' AS name, m AS value FROM pt UNION ALL SELECT user_id, h, 'mx', mx FROM pt), q AS (SELECT name, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS s FROM l GROUP BY 1), x AS (SELECT user_id, h, name, (value - b) / CASE WHEN abs(s) < 1e-12 THEN 1.0 ELSE s END AS dv FROM l JOIN q USING (name)) SELECT user_id, h, name, round(dv, 6) AS deviation FROM (SELECT *, row_number() OVER (PARTITION BY user_id, h ORDER BY abs(dv) DESC, name) AS r FROM x) WHERE r <= 1")
def top_feature_deviation(spark, d):
    far = stats.robust_deviation(points(spark, d).select("user_id", "h", "m", "mx"), ["m", "mx"], ["user_id", "h"], 1)
    return far.select("user_id", "h", "name", F.round("deviation", 6).alias("deviation"))


NAMES = "lower(replace(c_name, '#', '-BR0')) || CASE WHEN c_custkey % 5 = 0 THEN '-fw-1' ELSE '' END"


@query(f"""WITH n AS (SELECT c_custkey, {NAMES} AS raw, 'r' || (c_nationkey % 3) AS region FROM customer) SELECT c_custkey,
CASE WHEN regexp_matches(raw, '(^|[^a-z])(fw|firewall)([^a-z]|$)') THEN 'fw' WHEN regexp_extract(raw, '(cr|br|er|sw)[-_]?0*([0-9]+)', 1) <> '' THEN regexp_extract(raw, '(cr|br|er|sw)[-_]?0*([0-9]+)', 1) || '-' || regexp_extract(raw, '(cr|br|er|sw)[-_]?0*([0-9]+)', 2) ELSE raw END AS node,
region || '-' || node AS element, regexp_replace(raw, '[^a-z0-9]', '', 'g') AS alias, regexp_replace(regexp_replace(raw, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake,
regexp_extract(raw || ':9100', '^([^:]*)', 1) AS host, region || '-' || raw AS repaired FROM n""")
def name_normalisation(spark, d):
    raw = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-BR0"))), F.when(F.col("c_custkey") % 5 == 0, "-fw-1").otherwise(""))
    rows = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey").select("c_custkey", raw.alias("raw"), F.concat(F.lit("r"), (F.col("c_nationkey") % 3).cast("string")).alias("region"))
    node = S.canonical_node(F.col("raw"))
    twice = F.concat_ws("-", "region", "region", "raw")
    return rows.select("c_custkey", node.alias("node"), S.element_id(F.col("region"), node).alias("element"), S.alias_key(F.col("raw")).alias("alias"), S.snake(F.col("raw")).alias("snake"), S.host_of(F.concat("raw", F.lit(":9100"))).alias("host"), S.repaired_element_id(twice, F.col("region")).alias("repaired"))


@query("SELECT event_id, round(greatest(0, least(1, value / 100)), 6) AS clamped, round(CASE WHEN value > 0 THEN least(1, ln(1 + value) / ln(1 + 197362.0)) ELSE 0 END, 6) AS saturation, CASE WHEN value IS NULL OR value / 100 < 0.25 THEN 'none' WHEN value / 100 < 0.5 THEN 'low' WHEN value / 100 < 0.75 THEN 'mid' WHEN value / 100 < 1 THEN 'high' ELSE 'extreme' END AS level FROM events")
def scalar_levels(spark, d):
    v = F.col("value")
    return table(spark, d, "events", "event_id", "value").select("event_id", F.round(S.clamped(v / 100), 6).alias("clamped"), F.round(S.log_saturation(v), 6).alias("saturation"), S.level(v / 100).alias("level"))


@query("WITH m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN ' ' WHEN 2 THEN 'null' ELSE ' ' || value || ' ' END AS raw, value FROM events) SELECT event_id, CASE WHEN event_id % 5 > 2 THEN round(value, 6) END AS number, (event_id % 5 <= 2) AS missing FROM m")
def missing_markers(spark, d):
    own = F.col("event_id") % 5
    raw = F.when(own == 0, "NaN").when(own == 1, " ").when(own == 2, "null").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    return table(spark, d, "events", "event_id", "value").select("event_id", F.round(cleaned_number(raw), 6).alias("number"), cleaned_text(raw).isNull().alias("missing"))


#: Two time segments that overlap by a week.
LATE, EARLY = 1_705_276_800_000_000, 1_704_672_000_000_000


@query(f"SELECT event_id, user_id FROM events WHERE epoch_us(ts) < {LATE} UNION SELECT event_id, user_id FROM events WHERE epoch_us(ts) >= {EARLY}")
def segment_merge(spark, d):
    e = events(spark, d)
    parts = [e.where(F.col("us") < LATE), e.where(F.col("us") >= EARLY)]
    return merge_segments([p.select("event_id", "user_id") for p in parts])


@query("SELECT 'events' AS \"table\", count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def table_coverage(spark, d):
    return coverage({t: table(spark, d, t) for t in ("events", "orders", "nation")})


@query("SELECT 'high' AS tier, count(*) AS n FROM events WHERE value >= 50 AND event_type = 'error' UNION ALL SELECT 'low', count(*) FROM events WHERE NOT (value >= 50 AND event_type = 'error')")
def confidence_routing(spark, d):
    e = table(spark, d, "events", "event_type", "value").withColumn("bad", F.col("event_type") == "error")
    high, low = routed(e, "value", "bad", 50.0)
    return high.agg(F.count("*").alias("n")).select(F.lit("high").alias("tier"), "n").unionAll(low.agg(F.count("*").alias("n")).select(F.lit("low").alias("tier"), "n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM events ORDER BY event_id LIMIT 500) GROUP BY 1")
def row_budget(spark, d):
    head = table(spark, d, "events", "event_id", "event_type", "value").orderBy("event_id").limit(500)
    return head.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'signup') AND value > 80")
def prefiltered_scan(spark, d):
    return table(spark, d, "events", "event_id", "user_id", "event_type", "value").where(F.col("event_type").isin("error", "signup") & (F.col("value") > 80)).select("event_id", "user_id")


@query(f"WITH {POINTS}, e AS (SELECT user_id, us // {HOUR} AS h, count(*) AS errors FROM ev WHERE event_type = 'error' GROUP BY 1, 2), t AS (SELECT us // {HOUR} AS h, round(avg(value), 6) AS region_mean FROM ev GROUP BY 1) SELECT pt.user_id, pt.h, n, coalesce(errors, 0) AS errors, region_mean FROM pt LEFT JOIN e USING (user_id, h) LEFT JOIN t ON t.h = pt.h")
def feature_join(spark, d):
    e = events(spark, d).withColumn("h", F.floor(F.col("us") / HOUR))
    errors = e.where("event_type = 'error'").groupBy("user_id", "h").agg(F.count("*").alias("errors"))
    region = e.groupBy("h").agg(F.round(F.avg("value"), 6).alias("region_mean"))
    return points(spark, d).select("user_id", "h", "n").join(errors, ["user_id", "h"], "left").join(region, ["h"], "left").select("user_id", "h", "n", F.coalesce("errors", F.lit(0)).alias("errors"), "region_mean")


@query("WITH k AS (SELECT n_nationkey, n_name, 'Customer#0000' || lpad(n_nationkey::VARCHAR, 2, '0') AS prefix FROM nation UNION ALL SELECT -1, 'ANY', 'Customer#') SELECT c_custkey, arg_max(n_name, length(prefix)) AS owner FROM customer JOIN k ON starts_with(c_name, prefix) GROUP BY 1")
def longest_prefix(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name")
    k = table(spark, d, "nation", "n_nationkey", "n_name").select("n_name", F.concat(F.lit("Customer#0000"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("prefix"))
    k = k.unionAll(spark.createDataFrame([("ANY", "Customer#")], "n_name string, prefix string")).withColumn("size", F.length("prefix"))
    # an equality join on prefixes of the sizes in use, so no row meets more names than there are sizes
    sizes = [r["size"] for r in k.select("size").distinct().orderBy("size").collect()]
    cut = c.select("c_custkey", F.explode(F.array(*(F.substring("c_name", 1, s) for s in sizes))).alias("prefix"))
    return cut.join(k, "prefix").groupBy("c_custkey").agg(F.max_by("n_name", "size").alias("owner"))


@query(f"WITH {EVENTS}, s AS (SELECT user_id, event_type AS node, 1 AS prio, event_id FROM ev WHERE event_type <> 'view' UNION ALL SELECT user_id, 'view', 2, event_id FROM ev WHERE event_type = 'view') SELECT user_id, arg_min(node, prio * 1000000000 + event_id) AS node, count(DISTINCT node) > 1 AS conflict FROM s GROUP BY 1")
def first_source_map(spark, d):
    s = events(spark, d).select("user_id", F.col("event_type").alias("node"), F.when(F.col("event_type") != "view", 1).otherwise(2).alias("prio"), "event_id")
    return s.groupBy("user_id").agg(F.min_by("node", F.struct("prio", "event_id")).alias("node"), (F.count_distinct("node") > 1).alias("conflict"))


@query(f"WITH {EVENTS}, sp AS (SELECT event_id AS span, CASE WHEN event_id > 0 THEN event_id // 2 END AS parent, event_type AS service FROM ev) SELECT p.service AS caller, c.service AS callee, count(*) AS calls FROM sp c JOIN sp p ON c.parent = p.span WHERE p.service <> c.service GROUP BY 1, 2")
def trace_graph(spark, d):
    from tracewarden.operators.graph import traces

    return traces(events(spark, d).select(F.col("event_id").alias("span_id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 2)).alias("parent_id"), F.col("event_type").alias("service")))
