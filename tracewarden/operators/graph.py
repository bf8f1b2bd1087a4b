"""Graphs as edge tables: merging, traversal, components, ranks and smoothing.

Every step is a join on node ids followed by a grouping; iterations are written to the shared
folder, so lineage stays short and nothing is collected but counts.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import removed, settled


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (src, dst), without self-loops and repeats."""
    one = edges.select("src", "dst").where("src <> dst")
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each pair of nodes: the best confidence with its kind, all kinds, and whether all evidence points one way.

    ``edges``: src, dst, kind, confidence, directed.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    best = F.max_by("kind", F.struct("confidence", "kind"))
    return edges.where("src <> dst").groupBy(low.alias("a"), high.alias("b")).agg(
        F.max("confidence").alias("confidence"),
        best.alias("kind"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.count("*").alias("n"),
        (F.bool_and("directed") & (F.count_distinct(F.col("src") < F.col("dst")) == 1)).alias("directed"),
    )


def bfs(edges: DataFrame, roots: DataFrame, depth: int, keep_root: bool = False) -> DataFrame:
    """(root, node, depth): nodes within ``depth`` steps along (src, dst), at their least depth."""
    seen = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1)
        step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node"), F.lit(d).alias("depth"))
        seen = seen.unionAll(step).groupBy("root", "node").agg(F.min("depth").alias("depth"))
    return seen if keep_root else seen.where("depth > 0")


def reachable(edges: DataFrame, roots: DataFrame, rounds: int = 64) -> DataFrame:
    """(root, node): all nodes that can be reached, without bound on the depth; path lengths double each round."""
    pairs = settled(edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct(), "reach")
    n = pairs.count()
    for _ in range(rounds):
        longer = pairs.alias("x").join(pairs.alias("y"), F.col("x.node") == F.col("y.root")).select("x.root", "y.node")
        pairs = settled(pairs.unionAll(longer).distinct(), "reach")
        n, before = pairs.count(), n
        if n == before:
            break
    return pairs.join(roots.select("root"), "root", "left_semi").where("root <> node")


#: Links from which on minima are written before they are joined back, so that a node with very many links may be split.
MANY_LINKS = 1_000_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of (src, dst) reaches, ends of edges only.

    Alternates two steps until nothing changes: every node links its larger neighbours to its
    least neighbour, then its smaller neighbours likewise. Minima are combined before they are
    shuffled. Of many links they are written too: the join that brings them back then has a table
    on either side, and adaptive execution may split a node with very many links. The number of rounds
    grows with the logarithm of the longest path. Nulls and self-links are ignored; no edges give
    no rows.
    """
    spark = edges.sparkSession
    now = settled(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "links")
    told, spent = None, []
    n = now.count()
    for _ in range(rounds):

        def held(df: DataFrame) -> DataFrame:
            if n < MANY_LINKS:
                return df
            spent.append(settled(df, "step"))
            return spent[-1]

        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = held(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = held(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())
        least = held(large.groupBy("a").agg(F.min("b").alias("m")))
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        new = settled(large.join(least, "a").select(ends.alias("e")).select("e.*").where("a <> b").distinct(), "links")
        before, told = told, new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (now, *spent):
            removed(spark, old)
        spent.clear()
        now, n = new, told[0]
        if told == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").toDF("node", "component")).groupBy("node").agg(F.min("component").alias("component"))


def omitted_ids(reported: DataFrame) -> DataFrame:
    """(router, id) for each router whose reports (router, neighbour) name all known ids but one: that one is its own.

    Counts and sums decide it: the id left out is the total of all ids' ranks less those named. Nothing is
    collected but two numbers.
    """
    ids = reported.select(F.col("neighbour").alias("id")).distinct()
    total = ids.agg(F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"))).scalar()
    named = reported.select("router", "neighbour").distinct().groupBy("router").agg(F.count("*").alias("n"), F.sum(F.xxhash64("neighbour").cast("decimal(38,0)")).alias("s"))
    left = named.withColumn("t", total).where(F.col("n") == F.col("t.n") - 1).select("router", (F.col("t.s") - F.col("s")).cast("long").alias("h"))
    return left.join(ids.withColumn("h", F.xxhash64("id")), "h").select("router", "id")


def resolved_ids(reported: DataFrame, ids: list, most: int = 200_000) -> dict:
    """The id of each router of a small graph: the unique omitted one, else the permutation with the most mutual reports.

    ``reported`` (router, neighbour) names ids of neighbours. A router cannot be its own neighbour. Of equally
    good permutations the first in order wins; more than ``most`` permutations are not searched, and what is
    not settled is left out. Driver-side: the routers of one region.
    """
    rows = {(r["router"], r["neighbour"]) for r in reported.select("router", "neighbour").distinct().limit(10_000).collect()}
    routers = sorted({r for r, _ in rows})
    sure = {r["router"]: r["id"] for r in omitted_ids(reported).collect()}
    taken = list(sure.values())
    sure = {r: i for r, i in sure.items() if taken.count(i) == 1}
    open_, free = [r for r in routers if r not in sure], [i for i in ids if i not in set(sure.values())]
    if not open_ or math.perm(len(free), len(open_)) > most:
        return sure
    best, chosen = -1, {}
    for order in itertools.permutations(free, len(open_)):
        trial = sure | dict(zip(open_, order))
        if any((r, trial[r]) in rows for r in open_):
            continue
        mutual = sum((b, trial[a]) in rows for a in routers for b in routers if a != b and (a, trial[b]) in rows)
        if mutual > best:
            best, chosen = mutual, trial
    return chosen or sure


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of (src, dst)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds on the undirected graph; ranks sum to 1."""
    both = undirected(edges)
    degree = both.groupBy("src").agg(F.count("*").alias("degree"))
    links = settled(both.join(degree, "src"), "links")
    n = degree.count()
    ranks = degree.select(F.col("src").alias("node"), F.lit(1.0 / max(1, n)).alias("rank"))
    for i in range(rounds):
        flow = links.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("flow"))
        ranks = flow.select("node", (F.lit((1 - damping) / max(1, n)) + damping * F.col("flow")).alias("rank"))
        if i % 5 == 4:
            ranks = settled(ranks, "ranks")
    return ranks


def normalised(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of the symmetric normalised adjacency with self-loops."""
    both = undirected(edges)
    loops = both.select("src").distinct().select("src", F.col("src").alias("dst"))
    whole = both.unionAll(loops)
    degree = whole.groupBy("src").agg(F.count("*").alias("d"))
    return whole.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))


def smoothed(values: DataFrame, edges: DataFrame, share: float = 0.5) -> DataFrame:
    """(node, value): its own value mixed with the weighted mean of its neighbours' (src, dst, weight); alone it stays."""
    one = edges.select("src", "dst", "weight").where("src <> dst")
    both = one.unionAll(one.select("dst", "src", "weight").toDF("src", "dst", "weight"))
    near = both.join(values.select(F.col("node").alias("dst"), F.col("value").alias("v")), "dst").groupBy(F.col("src").alias("node")).agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("near"))
    return values.join(near, "node", "left").select("node", F.when(F.col("near").isNull(), F.col("value")).otherwise((1 - share) * F.col("value") + share * F.col("near")).alias("value"))


def expanded(edges: DataFrame, roots: DataFrame, depth: int, most: int) -> DataFrame:
    """(root, node, depth, place): neighbours level by level, in order of depth and name, at most ``most`` with the root."""
    found = bfs(undirected(edges), roots, depth, keep_root=True)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("depth", "node"))).where(F.col("place") <= most)


def propagation(edges: DataFrame, first_times: DataFrame, group: list[str]) -> DataFrame:
    """Edges of each group whose ends both have a first time, with the lag from src to dst and whether it is forward."""
    x = first_times.select(*group, F.col("node").alias("src"), F.col("first_time").alias("src_time"))
    y = first_times.select(*group, F.col("node").alias("dst"), F.col("first_time").alias("dst_time"))
    return edges.select("src", "dst").join(x, "src").join(y, [*group, "dst"]).withColumn("lag", F.col("dst_time") - F.col("src_time")).withColumn("consistent", F.col("lag") >= 0)


def lead_lag(edges: DataFrame, first_times: DataFrame, group: list[str], smoothing: float = 1.0, full: float = 10.0) -> DataFrame:
    """(src, dst, n, n_after, weight): how often dst comes after src, smoothed, and shrunk while there are few cases."""
    pairs = propagation(edges, first_times, group)
    counted = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if(F.col("lag") > 0).alias("n_after"))
    return counted.withColumn("weight", (F.col("n_after") + smoothing) / (F.col("n") + 2 * smoothing) * F.least(F.lit(1.0), F.col("n") / full))


def within(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """(group, src, dst): undirected edges whose ends are both members (group, node) of the same group, in both directions."""
    ends = members.select(group, "node")
    near = ends.join(undirected(edges).select(F.col("src").alias("node"), "dst"), "node")
    return near.join(ends.withColumnRenamed("node", "dst"), [group, "dst"], "left_semi").select(group, F.col("node").alias("src"), "dst")


def payload(edges: DataFrame) -> DataFrame:
    """One row that shows a graph of one region as a whole: its nodes and its edges (a, b), both sorted. For artifacts, so its size is that of the graph."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    nodes = edges.select(F.col("src").alias("n")).unionAll(edges.select("dst")).agg(F.array_sort(F.collect_set("n"))).scalar()
    return pairs.agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("edges")).withColumn("nodes", nodes)


def traces(spans: DataFrame) -> DataFrame:
    """(caller, callee, calls) from spans (span_id, parent_id, service): parent and child joined on the span."""
    parent = spans.select(F.col("span_id").alias("parent_id"), F.col("service").alias("caller"))
    return spans.where("parent_id is not null").select("parent_id", F.col("service").alias("callee")).join(parent, "parent_id").where("caller <> callee").groupBy("caller", "callee").agg(F.count("*").alias("calls"))
