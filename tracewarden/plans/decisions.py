"""Decision, vector and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.operators import decisions as D
from tracewarden.operators import models, ranks
from tracewarden.plans.registry import EVENTS, HOUR, POINTS, events, points, query
from tracewarden.sources.tables import table

#: Candidate lists: per group and day, users in the order of their maximum; roles are user_id % 3.
LISTS = f"{EVENTS}, us AS (SELECT user_id % 10 AS grp, us // {24 * HOUR} AS day, user_id, max(value) AS mx, count(*) AS n FROM ev GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (PARTITION BY grp, day ORDER BY mx DESC, user_id) AS r, row_number() OVER (PARTITION BY grp, day ORDER BY n DESC, user_id) AS rn FROM us), ls AS (SELECT grp, day, list('n' || user_id ORDER BY r) FILTER (r <= 5) AS a, list('n' || user_id ORDER BY rn) FILTER (rn <= 5) AS b FROM rk GROUP BY 1, 2)"


def per_user(spark, d) -> DataFrame:
    u = events(spark, d).groupBy((F.col("user_id") % 10).alias("grp"), F.floor(F.col("us") / (24 * HOUR)).alias("day"), "user_id").agg(F.max("value").alias("mx"), F.count("*").alias("n"))
    w = Window.partitionBy("grp", "day")
    return u.withColumn("r", F.row_number().over(w.orderBy(F.desc("mx"), "user_id"))).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "user_id")))


def lists(spark, d) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("user_id").cast("string"))
    pick = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c) <= 5, F.struct(F.col(c).alias("o"), name.alias("x"))))), lambda s: s["x"])
    return per_user(spark, d).groupBy("grp", "day").agg(pick("r").alias("a"), pick("rn").alias("b"))


EVEN = "CAST(substr(x, 2) AS BIGINT) % 2 = 0"


@query(f"WITH {LISTS}, o AS (SELECT grp, day, list_filter(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), lambda x: CAST(substr(x, 2) AS BIGINT) % 7 <> 0)[1:5] AS top FROM ls) SELECT grp, day, array_to_string(top, ',') AS top, len(top)::INTEGER AS n FROM o")
def closed_set_top5(spark, d):
    x = lists(spark, d)
    legal = F.filter(F.array_union("a", "b"), lambda v: F.substring(v, 2, 20).cast("long") % 7 != 0)
    return x.select("grp", "day", D.closed_top([F.col("a"), F.col("b")], legal, 5).alias("t")).select("grp", "day", F.array_join("t", ",").alias("top"), F.size("t").alias("n"))


def even(v):
    return F.substring(v, 2, 20).cast("long") % 2 == 0


@query(f"WITH {LISTS} SELECT grp, day, array_to_string(list_concat(list_filter(a, lambda x: {EVEN}), list_filter(a, lambda x: NOT ({EVEN}))), ',') AS top FROM ls")
def role_reorder_partition(spark, d):
    return lists(spark, d).select("grp", "day", F.array_join(D.partitioned(F.col("a"), even), ",").alias("top"))


@query(f"WITH {LISTS}, p AS (SELECT grp, day, a, list_position(list_transform(a, lambda x: {EVEN}), true) AS k FROM ls) SELECT grp, day, array_to_string(CASE WHEN k IS NULL OR k <= 1 THEN a ELSE list_concat([a[k]], a[2:k - 1], [a[1]], a[k + 1:]) END, ',') AS top FROM p")
def role_reorder_swap(spark, d):
    return lists(spark, d).select("grp", "day", F.array_join(D.swapped(F.col("a"), even), ",").alias("top"))


@query(f"WITH {LISTS} SELECT grp, day, array_to_string(CASE WHEN list_contains(a, b[1]) THEN list_concat([b[1]], list_filter(a, lambda x: x <> b[1])) ELSE a END, ',') AS top FROM ls")
def llm_pick_promote(spark, d):
    return lists(spark, d).select("grp", "day", F.array_join(D.promoted(F.col("a"), F.element_at("b", 1), 5, inside_only=True), ",").alias("top"))


@query(f"WITH {LISTS}, x AS (SELECT grp, day % 3 AS slot, day AS id, (day % 7) / 7.0 AS confidence, unnest(a) AS element, unnest(range(0, len(a))) AS pos FROM ls), p AS (SELECT grp, slot, element, max(confidence) FILTER (pos = 0) AS prim, count(*) AS support, min(pos) AS best FROM x GROUP BY 1, 2, 3) SELECT grp, slot, string_agg(element, ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY grp, slot ORDER BY prim DESC NULLS LAST, support DESC, best, element) AS r FROM p) WHERE r <= 5 GROUP BY 1, 2")
def exact_window_collapse(spark, d):
    x = lists(spark, d).select("grp", (F.col("day") % 3).alias("slot"), F.col("day").alias("id"), ((F.col("day") % 7) / 7.0).alias("confidence"), F.col("a").alias("top"))
    return D.collapse_windows(x, ["grp", "slot"]).select("grp", "slot", F.array_join("top", ",").alias("top"))


@query(f"WITH {LISTS} SELECT x.grp, x.day, x.a[1] AS node, coalesce(y.b[1], x.b[1]) AS category FROM ls x LEFT JOIN ls y ON y.grp = x.grp AND y.day = x.day + 1")
def category_swap(spark, d):
    x = lists(spark, d).select("grp", "day", F.element_at("a", 1).alias("node"), F.element_at("b", 1).alias("own"))
    later = x.select("grp", (F.col("day") - 1).alias("day"), F.col("own").alias("new"))
    return x.join(later, ["grp", "day"], "left").select("grp", "day", "node", F.coalesce("new", "own").alias("category"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ROLLUP (quality, toxic)")
def transition_matrix(spark, d):
    return table(spark, d, "labels", "quality", "toxic").rollup("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS hits, round(count(*) FILTER (toxic = 1) / count(*), 6) AS share FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def reachability_counts(spark, d):
    x = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels", "doc_id", "toxic"), "doc_id")
    hit = F.col("toxic") == 1
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("share"))


@query(f"WITH {EVENTS}, v AS (SELECT user_id, us // {24 * HOUR} AS day, event_type FROM ev), g AS (SELECT user_id, day, count(*) AS n, count(DISTINCT event_type) AS k FROM v GROUP BY 1, 2), p AS (SELECT x.user_id, x.day, avg(CASE WHEN x.event_type = y.event_type THEN 1.0 ELSE 0.0 END) AS agree FROM (SELECT user_id, day, event_type, count(*) AS c FROM v GROUP BY 1, 2, 3) x JOIN (SELECT user_id, day, event_type, count(*) AS c FROM v GROUP BY 1, 2, 3) y USING (user_id, day) GROUP BY 1, 2) SELECT count(*) AS n, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) AS unanimous, round(avg(agree), 6) AS agreement FROM g JOIN p USING (user_id, day)")
def unanimous_rate(spark, d):
    v = events(spark, d).select("user_id", F.floor(F.col("us") / (24 * HOUR)).alias("day"), "event_type")
    # pairs of kinds agree as often as one in the number of kinds: no self-join is needed
    g = v.groupBy("user_id", "day").agg(F.count_distinct("event_type").alias("k"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("k") == 1, 1.0).otherwise(0.0)), 6).alias("unanimous"), F.round(F.avg(1 / F.col("k")), 6).alias("agreement"))


KINDS = {"local_anomaly": "error", "temporal_priority": "view", "outgoing_propagation": "click", "incoming_propagation": "purchase", "cross_modal_support": "signup"}
TERMS = f"{EVENTS}, tm AS (SELECT user_id % 10 AS grp, user_id, " + ", ".join(f"max(value) FILTER (event_type = '{k}') / 200 AS {n}" for n, k in KINDS.items()) + ", count(*) / 500.0 AS predictive_explanation, CAST(NULL AS DOUBLE) AS contradiction FROM ev GROUP BY 1, 2)"
ROOT = "0.2 * coalesce(local_anomaly, 0) + 0.25 * coalesce(temporal_priority, 0) + 0.2 * coalesce(outgoing_propagation, 0) + 0.2 * coalesce(cross_modal_support, 0) + 0.15 * coalesce(predictive_explanation, 0) - 0.15 * coalesce(incoming_propagation, 0) - 0.15 * coalesce(contradiction, 0)"


def terms(spark, d) -> DataFrame:
    own = [(F.max(F.when(F.col("event_type") == k, F.col("value"))) / 200).alias(n) for n, k in KINDS.items()]
    return events(spark, d).groupBy((F.col("user_id") % 10).alias("grp"), "user_id").agg(*own, (F.count("*") / 500.0).alias("predictive_explanation")).withColumn("contradiction", F.lit(None).cast("double"))


@query(f"WITH {TERMS} SELECT user_id, " + ", ".join(f"round(coalesce({n}, 0), 6) AS {n}" for n in D.ROOT_WEIGHTS) + " FROM tm")
def sub_scores(spark, d):
    return terms(spark, d).select("user_id", *(F.round(F.coalesce(n, F.lit(0.0)), 6).alias(n) for n in D.ROOT_WEIGHTS))


@query(f"WITH {TERMS}, s AS (SELECT grp, user_id, round({ROOT}, 6) AS score FROM tm) SELECT grp, user_id, score, row_number() OVER (PARTITION BY grp ORDER BY score DESC, user_id)::INTEGER AS rank FROM s QUALIFY rank <= 5")
def root_score_topk(spark, d):
    scored = terms(spark, d).select("grp", "user_id", F.round(D.weighted({n: F.col(n) for n in D.ROOT_WEIGHTS}), 6).alias("score"))
    return ranks.top_k(scored, ["grp"], [F.desc("score"), F.col("user_id")], 5)


@query(f"WITH {EVENTS}, c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS sup, count(*) FILTER (event_type = 'view') AS con FROM ev GROUP BY 1) SELECT user_id, round(greatest(-1, least(1, (sup - con) / 3)), 6) AS net FROM c")
def contradiction_net(spark, d):
    c = events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("sup"), F.count_if(F.col("event_type") == "view").alias("con"))
    return c.select("user_id", F.round(D.net_support(F.col("sup"), F.col("con")), 6).alias("net"))


@query(f"WITH {TERMS} SELECT user_id, CASE WHEN local_anomaly >= 0.8 THEN 'firewall' WHEN incoming_propagation >= 0.7 THEN 'routing' WHEN predictive_explanation >= 0.2 THEN 'service' WHEN temporal_priority >= 0.6 THEN 'link' ELSE 'resource' END AS category FROM tm")
def category_chain(spark, d):
    rules = [(F.col("local_anomaly") >= 0.8, "firewall"), (F.col("incoming_propagation") >= 0.7, "routing"), (F.col("predictive_explanation") >= 0.2, "service"), (F.col("temporal_priority") >= 0.6, "link")]
    return terms(spark, d).select("user_id", D.chain([(t, F.lit(c)) for t, c in rules], F.lit("resource")).alias("category"))


@query(f"WITH {LISTS}, x AS (SELECT grp, day, unnest(a) AS element, unnest(range(0, len(a))) AS pos, len(a) AS n FROM ls) SELECT element, round(sum(0.9 * (1 - pos / n)), 6) AS target FROM x GROUP BY 1")
def teacher_targets(spark, d):
    x = lists(spark, d).select(F.size("a").alias("n"), F.posexplode("a").alias("pos", "element"))
    return x.groupBy("element").agg(F.round(F.sum(0.9 * (1 - F.col("pos") / F.col("n"))), 6).alias("target"))


@query(f"WITH {EVENTS}, t AS (SELECT user_id, event_type, sum(ln(1 + value)) AS w FROM ev GROUP BY 1, 2) SELECT user_id, event_type, round(w, 5) AS weight FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(w, 9) DESC, event_type) = 1")
def weighted_vote(spark, d):
    return D.vote(events(spark, d), "user_id", "event_type", F.log1p("value")).select("user_id", "event_type", F.round("weight", 5).alias("weight"))


COS = "list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]) * list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[]))"


#: The queries of a search: every row whose id is divisible by 20.
STATED = "vec_id % 20 = 0"


@query(f"WITH p AS (SELECT x.vec_id AS query_id, y.vec_id, {COS} AS sim FROM embeddings x, embeddings y WHERE x.{STATED}) SELECT query_id, vec_id, round(sim, 5) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id)::INTEGER AS rank FROM p QUALIFY rank <= 6")
def vector_topk_cosine(spark, d):
    v = table(spark, d, "embeddings", "vec_id", "embedding").withColumnRenamed("embedding", "vector")
    return models.vector_top_k(v.where(STATED).withColumnRenamed("vec_id", "query_id"), v, 6).select("query_id", "vec_id", F.round("sim", 5).alias("sim"), "rank")


HYBRID = f"0.7 * ({COS}) + 0.3 * exp(-abs(x.label - y.label))"


@query(f"WITH p AS (SELECT x.vec_id AS query_id, y.vec_id, {HYBRID} AS sim FROM embeddings x, embeddings y WHERE x.{STATED}) SELECT query_id, vec_id, round(sim, 5) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id)::INTEGER AS rank FROM p QUALIFY rank <= 6")
def hybrid_similarity(spark, d):
    """The stated queries against all rows by a share of the cosine and one of how near the labels are."""
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label").withColumnRenamed("embedding", "vector")
    found = models.vector_top_k(v.where(STATED).withColumnRenamed("vec_id", "query_id"), v, 6, number="label", share=0.7)
    return found.select("query_id", "vec_id", F.round("sim", 5).alias("sim"), "rank")


def _features(spark, d) -> DataFrame:
    return points(spark, d).select("user_id", "h", F.col("m").alias("m"), F.col("mx").alias("mx"), F.col("n").cast("double").alias("n"))


@query()
def iforest_score(spark, d):
    return models.isolation_forest(_features(spark, d).withColumn("key", F.col("user_id") * 1_000_000 + F.col("h")), ["m", "mx", "n"], "key").select("user_id", "h", F.round("iforest_score", 6).alias("score"))


#: The first principal axis of (m, mx, n) by power iteration.
AXIS = f"""{POINTS}, mu AS (SELECT avg(m) AS a, avg(mx) AS b, avg(n) AS c FROM pt), cv AS (SELECT avg((m - a) * (m - a)) AS aa, avg((m - a) * (mx - b)) AS ab, avg((m - a) * (n - c)) AS ac, avg((mx - b) * (mx - b)) AS bb, avg((mx - b) * (n - c)) AS bc, avg((n - c) * (n - c)) AS cc FROM pt, mu),
pw AS (SELECT 0 AS i, 1.0::DOUBLE AS x, 1.0::DOUBLE AS y, 1.0::DOUBLE AS z UNION ALL SELECT i + 1, p / l, q / l, s / l FROM (SELECT i, p, q, s, sqrt(p * p + q * q + s * s) AS l FROM (SELECT i, aa * x + ab * y + ac * z AS p, ab * x + bb * y + bc * z AS q, ac * x + bc * y + cc * z AS s FROM pw, cv WHERE i < 400))), ax AS (SELECT x, y, z FROM pw WHERE i = 400)"""


@query(
    f"WITH RECURSIVE {AXIS}, d AS (SELECT user_id, h, m - a AS p, mx - b AS q, n - c AS s, (m - a) * x + (mx - b) * y + (n - c) * z AS t, x, y, z FROM pt, mu, ax) "
    "SELECT user_id, h, round(((p - t * x) * (p - t * x) + (q - t * y) * (q - t * y) + (s - t * z) * (s - t * z)) / 3, 6) AS score FROM d"
)
def recon_error_score(spark, d):
    return models.reconstruction_error(_features(spark, d), ["m", "mx", "n"], 1).select("user_id", "h", F.round("recon_error", 6).alias("score"))


@query()
def dual_recon_hard_samples(spark, d):
    """Points that two models, of all rows and of calm rows only, both fail to rebuild by more than a deviation."""
    calm = F.when(F.col("m") < 60, 1.0).otherwise(0.1)
    x = models.reconstruction_error(_features(spark, d), ["m", "mx", "n"], 1, out="e1")
    x = models.reconstruction_error(x, ["m", "mx", "n"], 1, calm, "e2")
    edge = x.agg(F.struct(*((F.avg(c) + F.stddev_pop(c)).alias(c) for c in ("e1", "e2")))).scalar()
    return x.withColumn("edge", edge).where("e1 > edge.e1 and e2 > edge.e2").select("user_id", "h", F.round("e1", 6).alias("e1"), F.round("e2", 6).alias("e2"))


@query()
def online_memory(spark, d):
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return models.one_memory(v, "vec_id", "embedding", 0.5).select("vec_id", "label", "template", "hits")


@query(f"WITH {POINTS} SELECT user_id, count(*) AS n, round(max(m), 6) AS peak, CASE WHEN max(m) >= 150 THEN 'hard' WHEN max(m) >= 100 THEN 'soft' ELSE 'drop' END AS tier FROM pt GROUP BY 1")
def teacher_tiers(spark, d):
    x = points(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("m").alias("peak"))
    return x.select("user_id", "n", F.round("peak", 6).alias("peak"), F.when(F.col("peak") >= 150, "hard").when(F.col("peak") >= 100, "soft").otherwise("drop").alias("tier"))


@query(f"WITH {LISTS}, f AS (SELECT grp, a[1] AS first, day FROM ls) SELECT grp, first, count(*) AS n, round(count(*) / (SELECT count(*) FROM f g WHERE g.grp = f.grp), 6) AS share FROM f GROUP BY 1, 2")
def stability_first(spark, d):
    x = lists(spark, d).groupBy("grp", F.element_at("a", 1).alias("first")).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("grp")), 6))


@query(f"WITH {LISTS} SELECT grp, day, a[1] AS pick, TRUE AS legal FROM ls")
def llm_closed_set(spark, d):
    """Prompts from candidate lists, answered by the offline backend, parsed and checked against the closed set."""
    x = lists(spark, d).withColumn("prompt", F.concat_ws("\n", F.lit("Which element is the cause?"), F.concat(F.lit("candidates: "), F.array_join("a", ", "))))
    answered = D.asked(x.select("grp", "day", "a", "prompt"), "prompt", D.Offline())
    pick = F.get_json_object(D.json_in(F.col("response")), "$.pick")
    return answered.select("grp", "day", "a", pick.alias("pick")).select("grp", "day", "pick", F.array_contains("a", F.col("pick")).alias("legal"))
