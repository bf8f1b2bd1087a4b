"""Graph queries on the trade graph between nations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators import graph
from tracewarden.plans.features import FLOW, flows
from tracewarden.plans.registry import query
from tracewarden.session import settled

TRADE = f"{FLOW}, sh AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, proto, count(*) AS n FROM fl WHERE src <> dst GROUP BY 1, 2, 3), tr AS (SELECT src, dst, sum(n)::BIGINT AS n FROM sh GROUP BY 1, 2)"


def shares(spark, d) -> DataFrame:
    return flows(spark, d).where("src <> dst").groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "proto").agg(F.count("*").alias("n"))


def trade(spark, d) -> DataFrame:
    """All partners of each nation."""
    return settled(shares(spark, d).groupBy("src", "dst").agg(F.sum("n").alias("n")), "pairs")


@query(f"""WITH {TRADE}, e AS (SELECT src, dst, proto AS kind, round(n / (SELECT max(n) FROM sh), 4) AS confidence, proto = 'A' AS directed FROM sh) SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(confidence) AS confidence, arg_max(kind, (confidence, kind)) AS kind, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n, bool_and(directed) AND count(DISTINCT src < dst) = 1 AS directed FROM e GROUP BY 1, 2""")
def edge_merge_best_confidence(spark, d):
    return graph.merge_edges(_evidence(spark, d))


def _evidence(spark, d) -> DataFrame:
    s = settled(shares(spark, d), "shares")
    most = s.agg(F.max("n")).scalar()
    return s.withColumn("most", most).select("src", "dst", F.col("proto").alias("kind"), F.round(F.col("n") / F.col("most"), 4).alias("confidence"), (F.col("proto") == "A").alias("directed"))


@query(f"WITH {TRADE} SELECT proto AS kind, round(n / (SELECT max(n) FROM sh), 1) AS confidence, count(*) AS n FROM sh GROUP BY 1, 2")
def edge_histogram(spark, d):
    s = settled(shares(spark, d), "shares")
    return s.withColumn("most", s.agg(F.max("n")).scalar()).groupBy(F.col("proto").alias("kind"), F.round(F.col("n") / F.col("most"), 1).alias("confidence")).agg(F.count("*").alias("n"))


def _bfs_sql(src, dst, depth=3):
    return f"WITH RECURSIVE {TRADE}, b AS (SELECT DISTINCT src AS root, src AS node, 0 AS depth FROM tr UNION SELECT b.root, tr.{dst}, b.depth + 1 FROM b JOIN tr ON tr.{src} = b.node WHERE b.depth < {depth})"


@query(f"{_bfs_sql('src', 'dst')} SELECT root, node, min(depth) AS depth FROM b GROUP BY 1, 2 HAVING min(depth) > 0")
def bfs_downstream(spark, d):
    t = trade(spark, d)
    return graph.bfs(t, t.select(F.col("src").alias("root")).distinct(), 3)


@query(f"{_bfs_sql('dst', 'src')} SELECT root, node, min(depth) AS depth FROM b GROUP BY 1, 2 HAVING min(depth) > 0")
def bfs_upstream(spark, d):
    t = trade(spark, d)
    turned = t.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.bfs(turned, t.select(F.col("src").alias("root")).distinct(), 3)


@query(f"{_bfs_sql('src', 'dst')} SELECT root, node, round(1.0 / (1 + min(depth)), 6) AS similarity FROM b GROUP BY 1, 2")
def shortest_path_similarity(spark, d):
    t = trade(spark, d)
    found = graph.bfs(t, t.select(F.col("src").alias("root")).distinct(), 3, keep_root=True)
    return found.select("root", "node", F.round(1 / (1 + F.col("depth")), 6).alias("similarity"))


@query(f"WITH RECURSIVE {TRADE}, r AS (SELECT src AS root, dst AS node FROM tr UNION SELECT r.root, tr.dst FROM r JOIN tr ON tr.src = r.node) SELECT root, count(DISTINCT node) AS n FROM r WHERE root <> node GROUP BY 1")
def descendants_count(spark, d):
    t = trade(spark, d)
    return graph.reachable(t, t.select(F.col("src").alias("root")).distinct()).groupBy("root").agg(F.count("*").alias("n"))


def _pagerank_sql(rounds=20):
    parts = [f"WITH {TRADE}, e AS (SELECT src, dst FROM tr UNION SELECT dst, src FROM tr), dg AS (SELECT src, count(*) AS k FROM e GROUP BY 1), r0 AS (SELECT src AS node, 1.0::DOUBLE / (SELECT count(*) FROM dg) AS r FROM dg)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT e.dst AS node, 0.15::DOUBLE / (SELECT count(*) FROM dg) + 0.85::DOUBLE * sum(r / k) AS r FROM e JOIN r{i} ON r{i}.node = e.src JOIN dg ON dg.src = e.src GROUP BY 1)")
    return ", ".join(parts) + f" SELECT node, round(r, 6) AS rank FROM r{rounds}"


@query(_pagerank_sql())
def pagerank(spark, d):
    return graph.pagerank(trade(spark, d)).select("node", F.round("rank", 6).alias("rank"))


@query(f"WITH {TRADE}, o AS (SELECT src AS node, count(*) AS c FROM tr GROUP BY 1), i AS (SELECT dst AS node, count(*) AS c FROM tr GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(o.c, 0) AS n_out, coalesce(i.c, 0) AS n_in FROM o FULL JOIN i ON o.node = i.node")
def degree(spark, d):
    return graph.degrees(trade(spark, d))


@query(f"WITH {TRADE}, e AS (SELECT src, dst FROM tr UNION SELECT dst, src FROM tr UNION SELECT src, src FROM tr UNION SELECT dst, dst FROM tr), g AS (SELECT src, count(*) AS k FROM e GROUP BY 1) SELECT e.src, e.dst, round(1 / sqrt(a.k * b.k), 6) AS weight FROM e JOIN g a ON a.src = e.src JOIN g b ON b.src = e.dst")
def adjacency_normalised(spark, d):
    return graph.normalised(trade(spark, d)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {TRADE}, e AS (SELECT src, dst, n AS w FROM tr UNION ALL SELECT dst, src, n FROM tr), v AS (SELECT DISTINCT src AS node, src::DOUBLE AS value FROM tr), x AS (SELECT e.src AS node, sum(w * v.value) / sum(w) AS near FROM e JOIN v ON v.node = e.dst GROUP BY 1) SELECT v.node, round(CASE WHEN near IS NULL THEN value ELSE 0.5 * value + 0.5 * near END, 6) AS value FROM v LEFT JOIN x ON x.node = v.node")
def graph_smoothing(spark, d):
    t = trade(spark, d)
    values = t.select(F.col("src").alias("node"), F.col("src").cast("double").alias("value")).distinct()
    return graph.smoothed(values, t.withColumnRenamed("n", "weight")).select("node", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE {TRADE}, e AS (SELECT src, dst FROM tr UNION SELECT dst, src FROM tr), b AS (SELECT DISTINCT src AS root, src AS node, 0 AS depth FROM tr UNION SELECT b.root, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 2), m AS (SELECT root, node, min(depth) AS depth FROM b GROUP BY 1, 2)
SELECT root, node, depth FROM m QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, node) <= 10""")
def neighbour_expansion(spark, d):
    t = trade(spark, d)
    return graph.expanded(t, t.select(F.col("src").alias("root")).distinct(), 2, 10).select("root", "node", "depth")


@query(f"WITH RECURSIVE {TRADE}, e AS (SELECT src, dst FROM tr UNION SELECT dst, src FROM tr), r AS (SELECT src AS node, src AS root FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.node) SELECT node, min(root) AS component FROM r GROUP BY 1")
def trade_components(spark, d):
    return graph.components(trade(spark, d))


@query(f"WITH {TRADE}, a AS (SELECT src, dst FROM tr WHERE src < dst), b AS (SELECT dst AS src, src AS dst FROM tr WHERE src > dst) SELECT a.src, a.dst FROM a JOIN b USING (src, dst)")
def reciprocal_edges(spark, d):
    t = trade(spark, d)
    return t.where("src < dst").select("src", "dst").join(t.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
