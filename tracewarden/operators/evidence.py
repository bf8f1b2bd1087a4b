"""Evidence about the elements of incidents: long tables of facts, assembled to ranked candidates, filtered, rendered, and gated to categories.

A fact has incident, node, modality, strength, time (a number) and label (text). All is grouping, joining and
ranking within an incident; an incident's rows meet by its id, and what is listed per element is bounded
by constants, but for its neighbours.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.scalars import SATURATION, level, log_saturation
from tracewarden.operators import ranks
from tracewarden.operators.decisions import ROOT_WEIGHTS, weighted

# fixed values: the kinds of evidence, in the order in which they are counted and in that in which they are shown; how many facts of each are taken and shown
MODALITIES = ("metric", "interface", "routing", "log", "quality", "flow")
SHOWN = ("routing", "metric", "interface", "log", "quality", "flow")
MOST_OF = {"metric": 3, "interface": 2, "log": 2, "quality": 2, "flow": 2}
MOST_SHOWN = 8
NO_SUPPORT, NO_COUNTER = "no positive evidence of any modality", "no counter-evidence"


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other) for both ends of (src, dst)."""
    one = edges.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other"))
    return one.unionAll(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def slots(facts: DataFrame) -> DataFrame:
    """(incident, node, magnitude, modalities, supporting, first_time): what the facts say about each element.

    magnitude is the largest strength of metric, interface and routing facts. supporting lists the shown
    facts, strongest first within their modality, ``MOST_SHOWN`` at most.
    """
    place = F.row_number().over(Window.partitionBy("incident", "node", "modality").orderBy(F.desc(F.abs("strength")), "time", "label"))
    order = F.array_position(F.array(*map(F.lit, SHOWN)), F.col("modality"))
    limit = reduce(lambda c, m: c.when(F.col("modality") == m, MOST_OF[m]), MOST_OF, F.when(F.lit(False), 0)).otherwise(MOST_SHOWN)
    placed = facts.withColumn("place", place).withColumn("order", order).withColumn("shown", F.col("place") <= limit)
    strong = F.col("modality").isin("metric", "interface", "routing")
    found = placed.groupBy("incident", "node").agg(
        F.coalesce(F.max(F.when(strong, F.abs("strength"))), F.lit(0.0)).alias("magnitude"),
        F.collect_set("modality").alias("seen"),
        F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("order", "place", F.concat_ws(": ", "modality", "label").alias("text"))))).alias("listed"),
        F.min("time").alias("first_time"),
    )
    kinds = F.filter(F.array(*map(F.lit, MODALITIES)), lambda m: F.array_contains(F.col("seen"), m))
    texts = F.transform(F.slice("listed", 1, MOST_SHOWN), lambda x: x["text"])
    return found.select("incident", "node", "magnitude", kinds.alias("modalities"), texts.alias("supporting"), "first_time")


def propagation(timed: DataFrame, near: DataFrame | None) -> DataFrame:
    """(incident, node, later, earlier, movers): how many elements of the incident moved after and before each, and the earlier ones' names.

    ``near`` (node, other) restricts both to neighbours. Without it the counts come from ranks in time, and no names are listed.
    """
    if near is None:
        w = Window.partitionBy("incident")
        before = F.count("*").over(w.orderBy("first_time").rangeBetween(Window.unboundedPreceding, -1))
        upto = F.count("*").over(w.orderBy("first_time").rangeBetween(Window.unboundedPreceding, 0))
        return timed.select("incident", "node", (F.count("*").over(w) - upto).alias("later"), before.alias("earlier"), F.array().cast("array<string>").alias("movers"))
    other = timed.select("incident", F.col("node").alias("other"), F.col("first_time").alias("other_time"))
    pairs = timed.join(near, "node").join(other, ["incident", "other"])
    moved = F.when(F.col("other_time") < F.col("first_time"), F.col("other").cast("string"))
    return pairs.groupBy("incident", "node").agg(F.count_if(F.col("other_time") > F.col("first_time")).alias("later"), F.count(moved).alias("earlier"), F.array_sort(F.collect_set(moved)).alias("movers"))


def candidates(facts: DataFrame, claimed: DataFrame, edges: DataFrame | None = None, predictive: DataFrame | None = None, contradiction: DataFrame | None = None, most_claimed: int = 10, full: float = SATURATION, factor: DataFrame | None = None) -> DataFrame:
    """Ranked candidates of each incident with their seven sub-scores, root score, support and counter-evidence.

    ``claimed`` (incident, node, place) are the incident's own elements, of which the first ``most_claimed`` count.
    Neighbours of all elements by ``edges`` (src, dst) become candidates without facts. ``predictive`` and
    ``contradiction`` (incident, node, value) are optional; the first is scaled within the incident. ``factor``
    (incident, node, factor) multiplies magnitudes before they are saturated.
    """
    own = claimed.where(F.col("place") <= most_claimed).groupBy("incident", "node").agg(F.min("place").alias("place"))
    held = slots(facts).join(own, ["incident", "node"], "full").withColumn("expanded", F.lit(False))
    anchor = own.groupBy("incident").agg(F.min_by("node", "place").alias("anchor"))
    near = None
    if edges is not None:
        near = both_ways(edges)
        grown = held.select("incident", "node").join(near, "node").select("incident", F.col("other").alias("node")).distinct()
        grown = grown.join(held.select("incident", "node"), ["incident", "node"], "left_anti").withColumn("expanded", F.lit(True))
        held = held.unionByName(grown, allowMissingColumns=True)
    none = F.array().cast("array<string>")
    held = held.withColumns({"magnitude": F.coalesce("magnitude", F.lit(0.0)), "modalities": F.coalesce("modalities", none), "supporting": F.coalesce("supporting", none)})
    if factor is not None:
        held = held.join(factor, ["incident", "node"], "left").withColumn("magnitude", F.col("magnitude") * F.coalesce("factor", F.lit(1.0))).drop("factor")
    timed = held.where("first_time is not null").select("incident", "node", "first_time")
    early = ranks.rank_priority(timed, ["incident"], "first_time", "temporal_priority").drop("first_time")
    flow = propagation(timed, near)
    for name, given in (("predictive_explanation", predictive), ("contradiction", contradiction)):
        if given is None:
            held = held.withColumn(name, F.lit(0.0))
        else:
            held = held.join(given.groupBy("incident", "node").agg(F.max("value").alias(name)), ["incident", "node"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    held = ranks.min_max(held, ["incident"], "predictive_explanation", "predictive_explanation")
    whole = held.join(early, ["incident", "node"], "left").join(flow, ["incident", "node"], "left").join(anchor, "incident", "left")
    others = F.greatest(F.lit(1), F.count("*").over(Window.partitionBy("incident")) - 1)
    scored = whole.withColumns(
        {
            "local_anomaly": log_saturation(F.col("magnitude"), full),
            "temporal_priority": F.coalesce("temporal_priority", F.lit(0.0)),
            "outgoing_propagation": F.coalesce("later", F.lit(0)) / others,
            "incoming_propagation": F.coalesce("earlier", F.lit(0)) / others,
            "cross_modal_support": F.least(F.lit(1.0), F.size("modalities") / F.lit(3.0)),
        }
    )
    wired = F.array(F.concat(F.lit("topology: neighbour of "), F.coalesce(F.col("anchor").cast("string"), F.lit("the incident's element")), F.lit(" in the graph")))
    scored = scored.withColumn("supporting", F.when((F.size("supporting") == 0) & F.col("expanded"), wired).otherwise(F.col("supporting")))
    moved = F.transform(F.coalesce("movers", none), lambda x: F.concat(x, F.lit(" moved earlier")))
    against = F.concat(moved, F.when(F.size("supporting") == 0, F.array(F.lit(NO_SUPPORT))).otherwise(none))
    scored = scored.withColumn("contradicting", F.when(F.size(against) > 0, against).otherwise(F.array(F.lit(NO_COUNTER)))).withColumn("root_score", weighted({n: F.col(n) for n in ROOT_WEIGHTS}))
    rank = F.row_number().over(Window.partitionBy("incident").orderBy(F.desc(F.round("root_score", 9)), "node"))
    return scored.select("incident", "node", rank.alias("rank"), *ROOT_WEIGHTS, "root_score", "magnitude", "modalities", "supporting", "contradicting", "first_time", "expanded")


def filtered(found: DataFrame, top: int = 10, keep: int = 5) -> DataFrame:
    """Of each incident's best ``top`` candidates, the first ``keep`` with an anomaly of their own or any support, in order; all count where none has. kept_of tells the numbers."""
    best = found.where(F.col("rank") <= top)
    w = Window.partitionBy("incident")
    good = (F.col("local_anomaly") > 0) | (F.size("supporting") > 0)
    marked = best.withColumn("__any", F.max(good).over(w)).withColumn("__good", good | ~F.col("__any"))
    marked = marked.withColumn("kept_of", F.concat_ws(" -> ", F.count("*").over(w), F.count_if("__good").over(w))).where("__good")
    return marked.withColumn("rank", F.row_number().over(w.orderBy("rank"))).where(F.col("rank") <= keep).drop("__any", "__good")


def rendered(found: DataFrame, prompt: str = "Which element is the cause?") -> DataFrame:
    """(incident, prompt): each incident's candidates in order as a text for a model, with their scores, support and counter-evidence."""
    line = F.format_string("%d. %s (score %.3f; %s) for: %s; against: %s", "rank", F.col("node").cast("string"), "root_score", F.concat_ws("+", "modalities"), F.concat_ws(" | ", "supporting"), F.concat_ws(" | ", "contradicting"))
    lines = found.groupBy("incident").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), F.col("node").cast("string").alias("node")))).alias("x"))
    names = F.array_join(F.transform("x", lambda x: x["node"]), ", ")
    return lines.select("incident", F.concat_ws("\n", F.lit(prompt), F.concat(F.lit("candidates: "), names), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("prompt"))


# fixed values: categories of service faults by kind of flow, ports of services, and thresholds of the gates
FLOW_ERROR, FLOW_SLOW = {"web": "web_5xx", "dns": "dns_down", "auth": "auth_error"}, {"web": "web_slow", "dns": "dns_wrong_record", "auth": "auth_timeout"}
ERROR_RATE, TIMEOUTS_PER_MINUTE, SLOW_RATIO, DROP_RATIO = 0.01, 0.1, 2.0, 0.5
FIREWALL_PEAK, FIREWALL_Z, DROP_Z = 10.0, 8.0, 8.0
FAMILY_Z, FALLBACK_Z = 30.0, 3.0
METRIC_FAMILY = {
    "cpu_pressure": ("cpu_usage", "load1", "load5"),
    "memory_pressure": ("memory_available_ratio", "swap_used_ratio"),
    "disk_space_low": ("filesystem_used_ratio", "inode_used_ratio"),
    "disk_io_pressure": ("disk_io_util", "disk_read_rate", "disk_write_rate"),
    "process_pressure": ("process_count",),
}
DROP_METRICS = ("rx_drop_rate", "tx_drop_rate", "rx_error_rate", "tx_error_rate")


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def flow_gate(edges: DataFrame) -> DataFrame:
    """(incident, category, strength): the service fault of the strongest unusual edge, of incidents that have one.

    ``edges``: incident, flow_type, error_rate, timeouts, p95, p95_base. Errors or timeouts outweigh slowness of the same edge.
    """
    failing = (F.col("error_rate") > ERROR_RATE) | (F.col("timeouts") > TIMEOUTS_PER_MINUTE)
    slow = (F.col("p95_base") > 0) & (F.col("p95") > SLOW_RATIO * F.col("p95_base"))
    category = F.when(failing, looked_up(F.col("flow_type"), FLOW_ERROR)).when(slow, looked_up(F.col("flow_type"), FLOW_SLOW))
    strength = F.when(failing, F.coalesce("error_rate", F.lit(0.0)) * 10 + F.coalesce("timeouts", F.lit(0.0))).when(slow, F.col("p95") / F.col("p95_base"))
    told = edges.withColumn("category", category).withColumn("strength", strength).where("category is not null")
    return told.groupBy("incident").agg(F.max_by("category", F.struct(F.round("strength", 9), "category")).alias("category"), F.max("strength").alias("strength"))


def service_subtype(service: Column, drop: Column, slow: Column) -> Column:
    """The service fault that a port's share of packets left, and its sessions' growth, tell of; null for none."""
    return F.when((service == "dns") & (drop < DROP_RATIO), "dns_down").when((service == "web") & (slow >= SLOW_RATIO), "web_slow").when((service == "web") & (drop < DROP_RATIO), "web_5xx")


def device_faults(stats: DataFrame, routing: DataFrame, firewalls: Column) -> DataFrame:
    """(incident, major, sub) from what devices show themselves: pressure on a firewall, drops on its interfaces, a changed default route; drops on others are a lossy link.

    ``stats``: incident, node, metric, peak, z; ``routing``: incident, node, metric. ``firewalls`` tests node.
    """
    drops = F.col("metric").isin(*DROP_METRICS) & (F.col("z") >= DROP_Z)
    lossy = drops | (F.col("metric") == "carrier_changes") & (F.col("z") >= DROP_Z)
    of_stats = stats.groupBy("incident").agg(
        F.coalesce(F.bool_or(firewalls & (F.col("metric") == "cpu_usage") & (F.col("peak") >= FIREWALL_PEAK) & (F.col("z") >= FIREWALL_Z)), F.lit(False)).alias("pressed"),
        F.coalesce(F.bool_or(firewalls & drops), F.lit(False)).alias("dropping"),
        F.coalesce(F.bool_or(~firewalls & lossy), F.lit(False)).alias("lossy"),
    )
    of_routes = routing.where(firewalls & F.col("metric").startswith("ipv6_default_route")).select("incident").distinct().withColumn("rerouted", F.lit(True))
    x = of_stats.join(of_routes, "incident", "full")
    sub = F.when(F.col("pressed"), "cpu_pressure").when(F.col("dropping"), "acl_drop").when(F.col("rerouted"), "default_route_error").when(F.col("lossy"), "loss")
    return x.withColumn("sub", sub).where("sub is not null").select("incident", F.when(F.col("sub") == "loss", "link").otherwise("firewall").alias("major"), "sub")


def resource_family(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, family, z): the family of metrics with the largest z, if it is large; else that of the first of the three strongest metrics that belongs to one, if they deviate at all.

    ``stats``: keys, metric, z, severity. The z of a fallback is 0.
    """
    table = {m: family for family, members in METRIC_FAMILY.items() for m in members}
    order = F.create_map(*(x for i, family in enumerate(METRIC_FAMILY) for x in (F.lit(family), F.lit(-i))))
    own = stats.withColumn("family", looked_up(F.col("metric"), table))
    best = own.where("family is not null").groupBy(*keys, "family").agg(F.max(F.coalesce("z", F.lit(0.0))).alias("z"))
    best = best.groupBy(*keys).agg(F.max(F.struct("z", order[F.col("family")].alias("o"), "family")).alias("s")).select(*keys, F.col("s.family").alias("best"), F.col("s.z").alias("best_z"))
    w = Window.partitionBy(*keys).orderBy(F.desc("severity"), "metric")
    top = own.withColumn("place", F.row_number().over(w)).where("place <= 3").withColumn("strongest", F.max(F.coalesce("z", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spare = top.where((F.col("strongest") >= FALLBACK_Z) & F.col("family").isNotNull()).groupBy(*keys).agg(F.min_by("family", "place").alias("spare"))
    told = best.join(spare, keys, "full")
    large = F.coalesce(F.col("best_z") >= FAMILY_Z, F.lit(False))
    return told.select(*keys, F.when(large, F.col("best")).otherwise(F.col("spare")).alias("family"), F.when(large, F.col("best_z")).otherwise(0.0).alias("z")).where("family is not null")


class Rule(NamedTuple):
    """A category and what tells of it: parts of feature names, the least value of features below a bound, or the largest above one; at: the kind that one of the first elements has to be of."""

    major: str
    sub: str
    has: tuple[str, ...] = ()
    below: tuple[str, float] | None = None
    above: tuple[tuple[str, ...], float] | None = None
    at: str | None = None


# fixed values: what tells of a category, the first that holds wins; then what the kind of the first elements stands for, and what is left
RULES = (
    Rule("routing", "bgp_session_down", ("bgp_session_down", "bgp_peer_down"), ("bgp_peer_up", 1.0)),
    Rule("routing", "bgp_session_down", below=("bgp_peer_uptime", 300.0)),
    Rule("routing", "bgp_route_flap", ("route_flap",), above=(("ipv6_route_change_total",), 0.0)),
    Rule("routing", "ospf6_neighbor_down", below=("ospf6_neighbor_state_code", 6.0)),
    Rule("routing", "ospf6_neighbor_down", ("ospf6_neighbor_state",)),
    Rule("routing", "ospf6_cost_anomaly", ("ospf6_interface_cost",)),
    Rule("firewall", "default_route_error", below=("ipv6_default_route_info", 1.0), above=(("ipv6_default_route_changed",), 0.0), at="firewall"),
    Rule("routing", "wrong_default_route", below=("ipv6_default_route_info", 1.0), above=(("ipv6_default_route_changed",), 0.0)),
    Rule("routing", "blackhole", below=("ipv6_route_exists", 1.0)),
    Rule("routing", "wrong_static_route", ("ipv6_route_nexthop_info",)),
    Rule("firewall", "acl_drop", ("acl", "deny", "rx_drop_rate", "tx_drop_rate"), at="firewall"),
    Rule("firewall", "port_block", ("port_block",), at="firewall"),
    Rule("firewall", "rate_limit", ("rate_limit", "bytes_rate", "packets_rate"), at="firewall"),
    Rule("firewall", "rule_order_error", ("rule_order", "rule_order_error"), at="firewall"),
    Rule("firewall", "cpu_pressure", ("cpu_usage", "load1", "load5"), at="firewall"),
    Rule("resource", "memory_pressure", ("memory_available_ratio", "swap_used_ratio")),
    Rule("resource", "softirq_pressure", ("softirq",)),
    Rule("resource", "process_pressure", ("process_count", "open_fd_ratio")),
    Rule("resource", "disk_io_pressure", ("disk_io_util", "disk_read_rate", "disk_write_rate")),
    Rule("resource", "disk_space_low", ("filesystem_used_ratio", "inode_used_ratio")),
    Rule("resource", "cpu_pressure", ("cpu_usage", "load1", "load5")),
    Rule("link", "loss", ("carrier_changes",), above=((*DROP_METRICS, "carrier_changes"), 0.0)),
    Rule("link", "delay", ("latency", "jitter", "web_flow_latency")),
    Rule("link", "rate_limit", ("rx_bytes_rate", "tx_bytes_rate", "rx_packets_rate", "tx_packets_rate", "observed_qps")),
    Rule("service", "web_5xx", ("web_flow_error", "web_5xx", "5xx")),
    Rule("service", "web_slow", ("web_flow_latency", "web_slow")),
    Rule("service", "dns_down", ("dns_flow_error", "dns_flow_timeout", "dns_flow_failed")),
    Rule("service", "dns_wrong_record", ("dns_flow",)),
    Rule("service", "auth_timeout", ("auth_flow_timeout", "auth_timeout")),
    Rule("service", "auth_error", ("auth_flow_error", "auth_flow_failed")),
)
BY_KIND = (("firewall", "firewall", "cpu_pressure"), ("service", "service", "web_slow"), ("br", "link", "loss"), ("cr", "link", "loss"))
DEFAULT = ("link", "delay")
CATEGORIES = {
    "link": ("delay", "rate_limit", "loss"),
    "firewall": ("acl_drop", "rate_limit", "port_block", "cpu_pressure", "default_route_error", "rule_order_error"),
    "resource": ("cpu_pressure", "memory_pressure", "disk_io_pressure", "disk_space_low", "process_pressure", "softirq_pressure"),
    "routing": ("blackhole", "bgp_session_down", "bgp_route_flap", "wrong_static_route", "ospf6_neighbor_down", "ospf6_cost_anomaly", "wrong_default_route"),
    "service": ("dns_down", "dns_wrong_record", "web_5xx", "web_slow", "auth_timeout", "auth_error"),
}


def is_category(major: Column, sub: Column) -> Column:
    """Whether a pair is in the closed set."""
    return F.concat_ws("/", major, sub).isin(*(f"{m}/{s}" for m, own in CATEGORIES.items() for s in own))


def classified(features: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """(key, major, sub) of each key of ``features`` (key, name, value) by the first rule that holds; ``kinds`` (key, kinds) lists those of its first elements.

    One aggregation makes a flag for each test of each rule; the rules are then one expression.
    """
    name, value = F.lower("name"), F.col("value")

    def part(words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, (name.contains(w) for w in words))

    aggs, tests = [], []
    for i, r in enumerate(RULES):
        own = []
        if r.has:
            aggs.append(F.bool_or(part(r.has)).alias(f"h{i}"))
            own.append(F.col(f"h{i}"))
        if r.below:
            aggs.append(F.min(F.when(part(r.below[:1]), value)).alias(f"b{i}"))
            own.append(F.coalesce(F.col(f"b{i}") < r.below[1], F.lit(False)))
        if r.above:
            aggs.append(F.max(F.when(part(r.above[0]), value)).alias(f"a{i}"))
            own.append(F.coalesce(F.col(f"a{i}") > r.above[1], F.lit(False)))
        test = reduce(lambda a, b: a | b, own)
        tests.append(test & F.array_contains("kinds", r.at) if r.at else test)
    flags = features.groupBy(key).agg(*aggs).join(kinds, key, "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    pair = lambda m, s: F.struct(F.lit(m).alias("major"), F.lit(s).alias("sub"))
    out = None
    for r, test in zip(RULES, tests):
        out = F.when(test, pair(r.major, r.sub)) if out is None else out.when(test, pair(r.major, r.sub))
    for kind, major, sub in BY_KIND:
        out = out.when(F.array_contains("kinds", kind), pair(major, sub))
    return flags.select(key, out.otherwise(pair(*DEFAULT)).alias("c")).select(key, "c.major", "c.sub")


def thinned(rows: DataFrame, key: Column, repeats: int, share: float, seed: int = 7) -> DataFrame:
    """``repeats`` copies of the rows, numbered repeat, each without about ``share`` of them, by a hash of the key: the same rows go in every run."""
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return each.where(F.pmod(F.xxhash64(key, F.col("repeat"), F.lit(seed)), F.lit(1_000_000)) >= round(share * 1_000_000))


def stability_verdict(rate: Column) -> Column:
    """What a mean rate of changed first places says."""
    return F.when(rate.isNull(), "no incidents").when(rate <= 0.10, "stable").when(rate <= 0.40, "mixed").otherwise("unstable")


def reading_verdict(stability: Column, reading: Column) -> Column:
    """What stability under other prompts, and under other evidence, say together (high or low each)."""
    return F.when((stability == "high") & (reading == "low"), "prior wins over evidence").when((stability == "low") & (reading == "high"), "evidence is read, wording matters").when((stability == "low") & (reading == "low"), "guessing").otherwise("stable")


def lower_quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, n, q, most, n_positive): the elements at int(share * (n - 1)) in order, not interpolated; from running counts, so no task holds the values of a key."""
    keys = keys or []
    ranked = ranks.value_ranks(df, value, keys)
    total = ranked.groupBy(*keys).agg(F.sum("n").alias("total"), F.max("v").alias("most"), F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0)).alias("n_positive"))
    joined = ranked.join(total, keys) if keys else ranked.crossJoin(F.broadcast(total))  # one row
    at = lambda s: F.max(F.when((F.col("below") <= F.floor(s * (F.col("total") - 1))) & (F.floor(s * (F.col("total") - 1)) < F.col("below") + F.col("n")), F.col("v")))
    return joined.groupBy(*keys, F.col("total").alias("n"), "most", "n_positive").agg(F.array(*(at(s) for s in shares)).alias("q")).select(*keys, "n", "q", "most", "n_positive")


def broadcast_scores(incidents: DataFrame, scores: DataFrame, out: str = "root_cause_score") -> DataFrame:
    """(incident, node, score): every element of every incident with the score of its second stage, 0 where it has none. ``incidents``: incident, nodes; ``scores``: node, score."""
    rows = incidents.select("incident", F.explode("nodes").alias("node"))
    return rows.join(scores.select("node", F.col("score").alias(out)), "node", "left").select("incident", "node", F.coalesce(out, F.lit(0.0)).alias(out))


def swapped_budget(fills: DataFrame, variants: DataFrame, points: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Fills without the ``budget`` whose middles are furthest from a point of their keys, and the first ``budget`` variants in place of them.

    ``fills`` and ``variants``: by, id, a, b; ``points``: by, at. Fills without any point count as furthest; ties go by id.
    """
    from tracewarden.operators.intervals import asof

    middle = fills.withColumn("at", (F.col("a") + F.col("b")) / 2)
    near = asof(middle, points.select(*by, "at"), by, "at", [], "nearest").withColumn("far", F.coalesce(F.abs(F.col("at") - F.col("at_matched")), F.lit(float("inf"))))
    gone = near.orderBy(F.desc(F.round("far", 9)), "id").limit(budget).select("id")
    added = variants.orderBy("id").limit(budget)
    return fills.join(gone, "id", "left_anti").select(*by, "id", "a", "b").withColumn("added", F.lit(False)).unionByName(added.select(*by, "id", "a", "b").withColumn("added", F.lit(True)))


def anchors(answers: DataFrame, found: DataFrame, least: int = 5) -> DataFrame:
    """(incident, at, top): answers (incident, top) that name ``least`` elements, at the first time of the first candidate that has one."""
    first = found.where("first_time is not null").groupBy("incident").agg(F.min_by("first_time", "rank").alias("at"))
    return answers.where(F.size("top") >= least).join(first, "incident").select("incident", "at", "top")


def incident_windows(windows: DataFrame) -> DataFrame:
    """(incident, a, b, nodes): from the first start to the last end of the windows (incident, node, a, b) of its elements."""
    return windows.groupBy("incident").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sort_array(F.collect_set("node")).alias("nodes"))


def best_scores(scores: DataFrame) -> DataFrame:
    """(node, score): the largest root score of each element over all incidents (incident, node, score)."""
    return scores.groupBy("node").agg(F.max("score").alias("score"))


def node_levels(points: DataFrame, share: float = 0.65) -> DataFrame:
    """(node, mean, peak, level): an element's mean and peak score, and their mixture by ``share`` of the peak."""
    x = points.groupBy("node").agg(F.avg("score").alias("mean"), F.max("score").alias("peak"))
    return x.withColumn("level", share * F.col("peak") + (1 - share) * F.col("mean"))


def candidate_order(incidents: DataFrame, scores: DataFrame, legal: Column) -> DataFrame:
    """(incident, nodes): legal elements of the incident in their order, then further legal ones by falling score (incident, node, score)."""
    more = scores.groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "node"))), lambda x: x["node"]).alias("more"))
    joined = incidents.join(more, "incident", "left").withColumn("all", F.array_distinct(F.concat("nodes", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select("incident", F.filter("all", lambda x: F.array_contains(legal, x)).alias("nodes"))


def resolved_score(df: DataFrame, columns: list[str], normal: str) -> tuple[str, DataFrame]:
    """(which, ``df`` with score): the first of the columns that varies; else one less ``normal`` if there is such a column; else 0. Which one it is takes one aggregation."""
    here = [c for c in columns if c in df.columns]
    spread = df.agg(*(F.coalesce(F.max(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))) > F.min(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))), F.lit(False)).alias(c) for c in here)).first() if here else {}
    for c in here:
        if spread[c]:
            return c, df.withColumn("score", F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    if normal in df.columns:
        return f"1 - {normal}", df.withColumn("score", 1 - F.coalesce(F.col(normal).try_cast("double"), F.lit(1.0)))
    return "none", df.withColumn("score", F.lit(0.0))


# fixed values: edges of the levels that a fingerprint tells
CPU_EDGES, Z_EDGES, MEMORY_EDGES, DISK_EDGES = (5, 15, 35), (3, 8, 20), (0.2, 0.5, 1.0), (10, 40, 80)


def fingerprints(incidents: DataFrame, stats: DataFrame, top: DataFrame, flows: DataFrame, routing: DataFrame) -> DataFrame:
    """(incident, text): an incident as a line of words without names of places, so that incidents of other regions have the same.

    ``incidents``: incident, minutes, episodes, seeds (roles); ``stats``: incident, role, cpu, cpu_z, memory, disk; ``top``:
    incident, roles (in order); ``flows``: incident, faults; ``routing``: incident, events, real, subs. Roles without a level are
    told only where they are seeds.
    """
    told = lambda c, edges, name: F.when(level(F.col(c), edges) != "none", F.concat_ws(" ", F.lit(name), level(F.col(c), edges)))
    bits = F.concat_ws(" ", told("cpu", CPU_EDGES, "cpu"), told("cpu_z", Z_EDGES, "cpu_z"), told("memory", MEMORY_EDGES, "mem"), told("disk", DISK_EDGES, "disk"))
    each = stats.select("incident", "role", bits.alias("bits")).join(incidents.select("incident", "seeds"), "incident")
    seen = each.withColumn("line", F.when(F.col("bits") != "", F.concat_ws(" ", "role", "bits")).when(F.array_contains("seeds", F.col("role")), F.concat_ws(" ", "role", F.lit("no_metric_anomaly"))))
    per = seen.where("line is not null").groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("role", "line"))), lambda x: x["line"]).alias("lines"))
    x = incidents.join(per, "incident", "left").join(top, "incident", "left").join(flows, "incident", "left").join(routing, "incident", "left")
    none = F.array().cast("array<string>")
    listed = lambda c: F.concat_ws(" ", F.coalesce(c, none))
    head = F.concat_ws(" ", F.lit("anomaly incident duration"), F.col("minutes").cast("string"), F.lit("min episodes"), F.col("episodes").cast("string"), F.lit("seed"), listed("seeds"))
    ranked = F.when(F.size(F.coalesce("roles", none)) > 0, F.concat_ws(" ", F.lit("ranked candidates"), listed("roles")))
    flow = F.concat_ws(" ", F.lit("application flow"), F.when(F.size(F.coalesce("faults", none)) > 0, listed("faults")).otherwise("none"))
    route = F.concat_ws(" ", F.lit("routing events"), F.coalesce("events", F.lit(0)).cast("string"), F.lit("real_protocol_signal"), F.when(F.coalesce("real", F.lit(False)), "yes").otherwise("no"), F.when(F.size(F.coalesce("subs", none)) > 0, listed("subs")))
    parts = F.concat(F.array(head), F.coalesce("lines", none), F.array_compact(F.array(ranked, flow, route)))
    return x.select("incident", F.array_join(parts, " ; ").alias("text"))
