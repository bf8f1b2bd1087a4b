"""Operators against naive versions, adversarial cases and invariants."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewarden.functions import scalars as S
from tracewarden.operators import decisions, graph, intervals, models, ranks, stats
from tracewarden.operators.toolbox import Toolbox
from tracewarden.sources import sinks, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_interval_join_equals_naive(spark):
    r = random.Random(1)
    left = [(i, i % 3, a := r.uniform(0, 100), a + r.choice([0, 1, 30])) for i in range(80)]
    right = [(i, i % 3, a := r.uniform(0, 100), a + r.choice([0, 2, 60])) for i in range(80)]
    expected = {(x[0], y[0]) for x, y in itertools.product(left, right) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]}
    x, y = spark.createDataFrame(left, "l long, k int, a double, b double"), spark.createDataFrame(right, "r long, k int, c double, d double")
    for cell in (1.0, 7.0, 500.0):
        rows = intervals.interval_join(x, y, ["k"], ("a", "b"), ("c", "d"), cell).select("l", "r").collect()
        assert len(rows) == len(expected) and {tuple(v) for v in rows} == expected
    semi = intervals.interval_join(x, y, ["k"], ("a", "b"), ("c", "d"), 7.0, "left_semi").collect()
    assert sorted(v.l for v in semi) == sorted({p[0] for p in expected})
    twice = intervals.interval_join(x.unionAll(x), y, ["k"], ("a", "b"), ("c", "d"), 7.0, "left_semi").collect()
    assert sorted(v.l for v in twice) == sorted([p for p in {p[0] for p in expected} for _ in range(2)])


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in r.normal(0, 1, 900).round(2)] + [("few", 1.0), ("few", 4.0), ("one", 7.0), (None, 3.0), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {x.k: x.q for x in ranks.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["k"]).collect()}
    for k in ("hot", "few", "one", None):
        assert np.allclose(got[k], np.quantile([v for own, v in rows if own == k], [0.0, 0.25, 0.5, 0.9, 1.0])), k
    assert "none" not in got
    whole = df.withColumn("a", ranks.at_quantile(df, "v", 0.75)).first().a
    assert abs(whole - np.quantile([v for _, v in rows if v is not None], 0.75)) < 1e-12


def test_forgotten_tables(spark, tmp_path):
    from tracewarden import session

    out = session.settled(spark.range(5), "x")
    folder = session.work_dir(spark).removeprefix("file:").replace("//", "/")
    assert out.count() == 5 and os.path.isdir(folder)
    session.forget(spark)
    assert not os.path.isdir(folder)


def test_router_ids(spark):
    reports = spark.createDataFrame([("r1", "b"), ("r1", "c"), ("r2", "a"), ("r2", "c"), ("r3", "a"), ("r3", "b")], "router string, neighbour string")
    assert {(x.router, x.id) for x in graph.omitted_ids(reports).collect()} == {("r1", "a"), ("r2", "b"), ("r3", "c")}
    # nobody omits just one id: only the permutation under which all reports are mutual is left
    ring = spark.createDataFrame([("r1", "b"), ("r2", "a"), ("r3", "d"), ("r4", "c")], "router string, neighbour string")
    assert graph.resolved_ids(ring, ["a", "b", "c", "d"]) == {"r1": "a", "r2": "b", "r3": "c", "r4": "d"}
    assert graph.resolved_ids(ring, list(range(12)), most=100) == {}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partition_count_does_not_matter(spark, parts):
    rows = spark.createDataFrame([(i % 5, float(i * 37 % 100)) for i in range(300)], "k int, t double").repartition(parts)
    runs = intervals.islands(rows, ["k"], "t", F.lit(3.0)).groupBy("k", "island").agg(F.count("*").alias("n"))
    assert sum(r.n for r in runs.collect()) == 300
    unit = ranks.rank_to_unit(rows, "t", "u").collect()
    t = np.array([r.t for r in unit])
    assert all(abs(r.u - ((t < r.t).sum() + ((t == r.t).sum() - 1) / 2) / 299) < 1e-9 for r in unit)


def test_rank_edges(spark):
    rows = spark.createDataFrame([(1, None)], "i int, v double")
    assert ranks.rank_to_unit(rows, "v", "u").first().u is None
    assert ranks.rank_to_unit(spark.createDataFrame([(1, 5.0)], "i int, v double"), "v", "u").first().u == 0.0


def test_asof(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", 9.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 5.0, "x"), ("a", 8.0, "y"), ("a", 10.0, "z")], "k string, t double, v string")
    by = lambda how, **kw: {(r.k, r.t): r.v for r in intervals.asof(left, right, ["k"], "t", ["v"], how, **kw).collect()}
    assert by("backward") == {("a", 5.0): "x", ("a", 9.0): "y", ("b", 1.0): None}
    assert by("forward") == {("a", 5.0): "x", ("a", 9.0): "z", ("b", 1.0): None}
    assert by("nearest")[("a", 9.0)] == "y" and by("backward", tolerance=0.5)[("a", 9.0)] is None


def test_greedy_folds(spark):
    rows = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate([(0, 10), (0, 10), (1, 10), (20, 30), (29, 40)])], "k int, id long, a double, b double")
    assert {r.id for r in intervals.disjoint_subset(rows, ["k"], "a", "b", "id").collect()} == {0, 3}
    kept = intervals.greedy_dice_dedup(rows, ["k"], "a", "b", "id", 0.6).collect()
    assert len(kept) == 3
    clusters = intervals.gap_span_clusters(spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 4, 8, 12, 30])], "k int, id long, t double"), ["k"], "t", "id", 5.0, 10.0)
    assert [r.cluster for r in clusters.orderBy("t").collect()] == [0, 0, 0, 1, 2]
    fresh = intervals.greedy_insert(rows, rows.limit(0), ["k"], "a", "b", "id", 0.5).collect()
    assert {r.id for r in fresh} == {0, 3, 4}


def test_split_keeps_short_only_piece(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.2), (2, 0.0, 60.5), (3, 0.0, 61.5)], "id long, a double, b double")
    got = [(r.id, r.piece_start, r.piece_end) for r in intervals.split_intervals(rows, "a", "b", 30.0, 1.0).orderBy("id", "piece").collect()]
    assert got == [(1, 0.0, 0.2), (2, 0.0, 30.0), (2, 30.0, 60.0), (3, 0.0, 30.0), (3, 30.0, 60.0), (3, 60.0, 61.5)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (9, 9)], "src long, dst long")
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert abs(graph.pagerank(e).agg(F.sum("rank").alias("s")).first().s - 1) < 1e-9


def test_scalars(spark):
    assert one(spark, S.canonical_node(F.lit(" BR-02-x "))) == "br-2" and one(spark, S.canonical_node(F.lit("edge-firewall"))) == "fw"
    assert one(spark, S.host_of(F.lit("fe80::1"))) == "fe80::1" and one(spark, S.host_of(F.lit("[fe80::1]:9"))) == "fe80::1" and one(spark, S.host_of(F.lit("h:9"))) == "h"
    assert one(spark, S.repaired_element_id(F.lit("r1-r1-cr-1"), F.lit("r1"))) == "r1-cr-1"
    assert one(spark, S.dice(*map(F.lit, (0.0, 2.0, 1.0, 3.0)))) == 0.5 and one(spark, S.dice(*map(F.lit, (1.0, 1.0, 1.0, 1.0)))) == 0.0
    assert one(spark, S.semantic_class(F.lit("Interface UPDATE"), F.lit(6))) == "up"
    assert one(spark, S.semantic_class(F.lit("Interface UPDATE: no route"), F.lit(6))) == "unavailable" and one(spark, S.semantic_class(F.lit("calm"), F.lit("x"))) == "info" and one(spark, S.semantic_class(F.lit("calm"), F.lit("2"))) == "error"
    assert one(spark, S.template(F.lit('peer 10.0.0.1 "x y" fe80::1:2 deadbeef took  12 ms'))) == "peer <ip> <str> <ipv6> <hex> took <n> ms"
    assert one(spark, S.level(F.lit(15.0), (5, 15, 35))) == "mid" and one(spark, S.level(F.lit(99.0), (5, 15, 35))) == "high" and one(spark, S.level(F.lit(None).cast("double"))) == "none"
    assert one(spark, S.repaired_id(F.lit("xian-xian-fw"), F.lit(None).cast("string"), ("xian",)))["action"] == "unparsable"
    assert one(spark, S.label_map(F.lit('b="2",a="1"'))) == {"a": "1", "b": "2"}


def test_decisions(spark):
    text = F.lit('Sure: {"a": 1} and ```json {"b": "}{"}``` done')
    assert one(spark, decisions.json_in(text)) == '{"b": "}{"}'
    assert one(spark, decisions.json_in(F.lit("none {broken"))) is None
    cur = F.array(*map(F.lit, "abc"))
    assert one(spark, decisions.promoted(cur, F.lit("c"), 3)) == ["c", "a", "b"] and one(spark, decisions.promoted(cur, F.lit("z"), 3, True)) == ["a", "b", "c"]
    assert one(spark, decisions.swapped(cur, lambda v: v == "c")) == ["c", "b", "a"] and one(spark, decisions.swapped(cur, lambda v: v == "q")) == ["a", "b", "c"]
    terms = {n: F.lit(1.0 if n == "contradiction" else 0.0) for n in decisions.ROOT_WEIGHTS}
    assert abs(one(spark, decisions.weighted(terms)) + 0.15) < 1e-12 and one(spark, decisions.explained(terms))[0]["name"] == "contradiction"


def test_many_to_one_is_checked(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(PySparkException):
        stats.many_to_one(left, right, ["k"]).collect()


def test_models(spark):
    r = np.random.default_rng(3)
    rows = [(i, *map(float, r.normal(0, 1, 2))) for i in range(400)] + [(999, 12.0, -12.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert models.isolation_forest(df, ["x", "y"], "id").orderBy(F.desc("iforest_score")).first().id == 999
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(50)] + [(10.0, 60.0)], "x double, y double")
    assert models.reconstruction_error(line, ["x", "y"], 1).orderBy(F.desc("recon_error")).first().y == 60.0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, vector array<double>")
    top = models.vector_top_k(v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "vector"), v, 2).orderBy("rank").collect()
    assert [x.vec_id for x in top] == [1, 2]
    memory = models.online_memory(v.withColumn("g", F.lit(0)), ["g"], "vec_id", "vector", 0.9).orderBy("vec_id").collect()
    assert [(x.template, x.hits) for x in memory] == [(0, 1), (0, 2), (1, 1)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "north" / "processed").mkdir(parents=True)
    (tmp_path / "north" / "processed" / "node_metrics.csv").write_text("﻿node,value\na,1\nb,x\n")
    found = tables.discover(spark, f"file://{tmp_path}", {"node": "node_metrics", "flow": "netflow"}).collect()
    assert [(r.dataset, r.kind) for r in found] == [("north", "node")]
    schema = spark.createDataFrame([], "node string, value double, extra int").schema
    rows = tables.read_csv(spark, found[0].path, schema).collect()
    assert [tuple(r) for r in rows] == [("a", 1.0, None), ("b", None, None)]
    assert tables.read_csv(spark, f"file://{tmp_path}/none.csv", schema).count() == 0
    with pytest.raises(ValueError):
        sinks.require_nonzero({"x": spark.range(0), "y": spark.range(1)})
    target = f"file://{tmp_path}/out"
    sinks.publish({"a": spark.range(2), "b": spark.range(1)}, {}, target)
    before, held = sorted(sinks.published(spark, target).collect()), {p: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    with pytest.raises(RuntimeError):
        sinks.publish({"a": spark.range(5)}, {"b": "boom"}, target)
    assert sorted(sinks.published(spark, target).collect()) == before and len(before) == 3
    with pytest.raises(PySparkException):  # breaks off while it is written: the publication of before stands, byte for byte
        sinks.publish({"a": spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("late"))).otherwise(F.col("id").cast("string")).alias("id"))}, {}, target)
    assert all(p.read_bytes() == b for p, b in held.items()) and sorted(sinks.published(spark, target).collect()) == before
    sinks.publish({"a": spark.range(5)}, {}, target)
    assert sinks.published(spark, target).count() == 5
    with pytest.raises(RuntimeError):
        sinks.publish({"a": spark.range(5)}, {"b": "boom"}, target)
    assert spark.read.json(f"{target}-report").first().dataset == "b"


def test_toolbox(spark):
    points = spark.createDataFrame([("d", e, float(t), t / 10, ["cpu", "mem"][: 1 + t % 2]) for e in "ab" for t in range(10)], "dataset string, element string, ts double, score double, top array<string>")
    box = Toolbox(
        points=points,
        edges=spark.createDataFrame([("a", "b", 0.9)], "src string, dst string, confidence double"),
        episodes=spark.createDataFrame([("d", "a", 1, 2.0, 5.0, 0.5), ("d", "b", 2, 3.0, 6.0, 0.6)], "dataset string, element string, id long, a double, b double, peak double"),
        incidents=spark.createDataFrame([("d", "i", 2.0, 5.0, ["a"]), ("d", "j", 4.0, 8.0, ["a", "b"])], "dataset string, id string, a double, b double, nodes array<string>"),
        events=spark.createDataFrame([("d", "a", 3.0, "down")], "dataset string, element string, ts double, message string"),
        metrics=spark.createDataFrame([("d", "a", 61.0, "cpu", 2.0)], "dataset string, element string, ts double, name string, value double"),
    )
    args = {
        "list_network_elements": {"dataset": "d"}, "get_dependency": {"element": "a"}, "get_trace_upstream": {"element": "b"}, "get_trace_downstream": {"element": "a"}, "get_node_anomaly": {"dataset": "d", "element": "a"},
        "get_anomaly_points": {"dataset": "d"}, "get_metric_evidence": {"dataset": "d", "element": "a", "a": 0, "b": 5}, "get_frr_events": {"dataset": "d", "a": 0, "b": 5}, "get_temporal_neighbors": {"dataset": "d", "ts": 5.0},
        "get_incident_candidates": {"incident": "i"}, "get_incident_timeline": {"incident": "i"}, "compare_incidents": {"first": "i", "second": "j"}, "get_propagation_chain": {"incident": "i"}, "get_fault_signature": {"incident": "i"},
    }
    assert len(box.TOOLS) == 15
    for name in box.TOOLS:
        assert box.call_tool(name, args.get(name)).count() > 0, name
    assert box.call_tool("get_incident_candidates", {"incident": "i"}).first().element == "a"
    with pytest.raises(ValueError):
        box.call_tool("drop_everything")


def test_vector_search_covers_the_stated_queries(spark, data_dir):
    from tracewarden import plans

    rows = spark.read.parquet(f"{data_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in plans.QUERIES["vector_topk_cosine"](spark, data_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {int(q): ids[np.lexsort((ids, -np.round(x @ x[i], 12)))[:6]].tolist() for i, q in enumerate(ids) if q % 20 == 0}
    v = spark.createDataFrame([(int(i), x[n].tolist()) for n, i in enumerate(ids)], "vec_id long, vector array<double>")
    stated = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    for block in (1, 7):
        small = models.vector_top_k(stated.where("query_id < 200"), v, 6, block=block).orderBy("query_id", "rank").collect()
        assert [r.vec_id for r in small] == [j for q in sorted(got) if q < 200 for j in got[q]]


def _memory(rows, tau):
    templates, counts, out = [], [], []
    for i, x in sorted(rows):
        x = np.array(x) / max(np.linalg.norm(x), 1e-300)
        sims = np.round(np.array([t @ x for t in templates]), 12)
        j = int(sims.argmax()) if len(sims) and sims.max() >= tau else len(templates)
        if j == len(templates):
            templates.append(x)
            counts.append(0)
        counts[j] += 1
        out.append((i, j, counts[j]))
    return out


@pytest.mark.parametrize("block", [16_384, 300])
def test_one_memory_is_shared_by_all_rows(spark, block):
    r = np.random.default_rng(5)
    rows = [(7 * i, r.normal(0, 1, 6).tolist()) for i in range(2500)] + [(3, [0.0] * 6), (17501, [0.0] * 6)]
    rows += [(20000 + i, rows[5][1]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(5)
    got = sorted((x.vec_id, x.template, x.hits) for x in models.one_memory(v, "vec_id", "vector", 0.9, block).collect())
    assert got == _memory(rows, 0.9) and len({x[1] for x in got}) < 2000
    assert models.one_memory(v.limit(0), "vec_id", "vector", 0.9).count() == 0


def test_online_memory_matches_across_ids_and_labels(spark, data_dir):
    from tracewarden import plans

    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").collect()]
    got = sorted((x.vec_id, x.template, x.hits) for x in plans.QUERIES["online_memory"](spark, data_dir).collect())
    assert got == _memory(rows, 0.5)


def test_hybrid_search_ranks_all_rows(spark, data_dir):
    from tracewarden import plans

    rows = spark.read.parquet(f"{data_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    ids, labels = np.array([r.vec_id for r in rows]), np.array([r.label for r in rows], dtype=float)
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in plans.QUERIES["hybrid_similarity"](spark, data_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {int(q): ids[np.lexsort((ids, -np.round(0.7 * (x @ x[i]) + 0.3 * np.exp(-np.abs(labels - labels[i])), 12)))[:6]].tolist() for i, q in enumerate(ids) if q % 20 == 0}


def test_trade_graph_has_all_pairs(spark, data_dir):
    from tracewarden import plans
    from tracewarden.plans.features import flows

    pairs = {(r.src, r.dst) for r in flows(spark, data_dir).where("src <> dst").select("src", "dst").distinct().collect()}
    nodes = {n for p in pairs for n in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}
    run = lambda name: plans.QUERIES[name](spark, data_dir).collect()
    assert {(r.node, r.n_out, r.n_in) for r in run("degree")} == {(n, len(out[n]), sum(n in o for o in out.values())) for n in nodes} and max(map(len, out.values())) > 3
    assert {(r.src, r.dst) for r in run("reciprocal_edges")} == {(a, b) for a, b in pairs if a < b and (b, a) in pairs}
    near = {(r.root, r.node) for r in run("bfs_downstream") if r.depth == 1}
    assert near == pairs
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {(r.node, r.component) for r in run("trade_components")} == set(label.items())


def test_streamed_memory_goes_on(spark, tmp_path):
    """Batches of a stream, and a restart between them, give what one pass over all rows gives."""
    from tracewarden.streaming import streams

    r = np.random.default_rng(6)
    rows = [(i, i % 3, (r.normal(0, 1, 4) * (i % 5 > 0) + (i % 5 == 0)).tolist()) for i in range(300)]
    schema = "vec_id long, label int, vector array<double>"
    whole = {(x.label, x.vec_id): (x.template, x.hits) for x in models.online_memory(spark.createDataFrame(rows, schema), ["label"], "vec_id", "vector", 0.9).collect()}
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.source(spark, source, spark.createDataFrame([], schema).schema)
        streams.published(streams.memory(stream, "label", "vec_id", "vector", 0.9), out, check).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(out).collect()
    assert {(x.label, x.vec_id): (x.template, x.hits) for x in got} == whole and len(got) == 300


def test_streams_read_tables_of_many_files(spark, data_dir, tmp_path):
    """A table may be a folder of part files."""
    from tracewarden import plans

    for name, parts in (("events", 3), ("embeddings", 4)):
        spark.read.parquet(f"{data_dir}/{name}.parquet").repartition(parts).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name in ("stream_memory", "stream_tumbling", "stream_session", "stream_dedup", "stream_sliding"):
        whole = sorted(map(tuple, plans.QUERIES[name](spark, data_dir).collect()))
        assert whole and sorted(map(tuple, plans.QUERIES[name](spark, f"file://{tmp_path}").collect())) == whole


def test_streamed_groups_stay_whole_after_a_union(spark):
    """Both sides of a union lie by the group already, in partitions of different sizes, which adaptive execution joins in different ways."""

    def side(n, at):
        runs = intervals.islands(spark.range(n).select((F.col("id") % 10).alias("k"), F.rand(at).alias("t")), ["k"], "t", F.lit(1.0))
        return runs.groupBy("k", "island").agg(F.min("t").alias("a"), (F.max("t") + 1 + at).alias("b")).select("k", "a", "b", F.lit(at).cast("long").alias("id"))

    kept = {x: spark.conf.get(x, None) for x in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")}
    try:
        for name, value in zip(kept, ("64k", "1k", "false", "16")):
            spark.conf.set(name, value)
        both = side(100_000, 0).unionByName(side(2_000, 1))
        assert sorted((r.k, r.id) for r in intervals.disjoint_subset(both, ["k"], "a", "b", "id").collect()) == [(k, 0) for k in range(10)]
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_means_of_points_do_not_depend_on_files(spark, tmp_path):
    """Means are bit for bit those of a sum in the order of ids, so equal means share their place and ranks follow."""
    import datetime

    from tracewarden import plans

    r, at = random.Random(5), datetime.datetime(2024, 1, 1)
    values = [[round(r.uniform(0, 200), 2) for _ in range(5)] for _ in range(40)]
    rows = [(i * 200 + u, at, u, "view", values[u % 40][i], '{"k": 1}') for u in range(200) for i in range(5)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(8, F.xxhash64("event_id")).write.parquet(f"file://{tmp_path}/events.parquet")
    want = {}
    for u in range(200):
        total = 0.0
        for v in values[u % 40]:
            total += v
        want[u] = total / 5
    place = {u: i for i, u in enumerate(sorted(want, key=lambda u: (want[u], u)), 1)}
    assert {x.user_id: x.point_rank for x in plans.QUERIES["point_rank"](spark, f"file://{tmp_path}").collect()} == place
