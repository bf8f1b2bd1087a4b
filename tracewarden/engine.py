"""The engine as a whole: from a workspace of CSV tables to published predictions, stage by stage.

``Engine(spark, config).run(workspace)`` discovers the datasets, and each stage is one DataFrame over all of
them, written before the next reads it. ``python -m tracewarden --workspace ... --output ...`` does the same.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.config import ABLATIONS, EXPERIMENTS, Config
from tracewarden.functions import scalars as S
from tracewarden.operators import evidence as E
from tracewarden.operators import graph, intervals, models, neural, ranks, stats
from tracewarden.session import session, settled
from tracewarden.sources import sinks, tables

#: File names of the tables by kind.
KINDS = {"node_metrics": "node_metrics", "topology": "topology|edges", "events": "syslog|frr"}
STAGES = ("points", "scores", "episodes", "incidents", "facts", "candidates", "predictions")


def metric_name(column: str) -> str:
    """A column's name in snake case."""
    return "".join(c if c.isalnum() else "_" for c in column.strip().lower()).strip("_") or "metric"


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.done: dict[str, DataFrame] = {}

    def run(self, workspace: str | None = None, until: str = "predictions") -> dict[str, DataFrame]:
        """All stages up to ``until``; their tables by name. With an output folder, predictions are published there."""
        if until not in STAGES:
            raise ValueError(f"no stage {until}; there are {', '.join(STAGES)}")
        self.load(workspace or self.config.workspace)
        for name in STAGES[: STAGES.index(until) + 1]:
            self.done[name] = settled(getattr(self, name)(), name)
        if self.config.output and until == "predictions":
            sinks.publish({"all": self.done["predictions"]}, {}, f"{self.config.output}/predictions")
            self.spark.createDataFrame([(json.dumps(self.config.to_dict(), sort_keys=True),)], "config string").write.mode("overwrite").text(f"{self.config.output}/config")
        return self.done

    def load(self, workspace: str) -> None:
        """The workspace's tables, all datasets of a kind as one; datasets that are not asked for stay out."""
        found = tables.discover(self.spark, workspace, KINDS)
        rows = [r for r in found.collect() if not self.config.datasets or r["dataset"] in self.config.datasets]  # one row per file
        if not any(r["kind"] == "node_metrics" for r in rows):
            raise ValueError(f"no node_metrics below {workspace}")
        self.given: dict[str, DataFrame] = {}
        for kind in KINDS:
            own = [tables.read_csv(self.spark, r["path"]).withColumn("dataset", F.lit(r["dataset"])) for r in rows if r["kind"] == kind]
            if own:
                self.given[kind] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)

    def edges(self) -> DataFrame | None:
        if "topology" not in self.given:
            return None
        e = self.given["topology"]
        confidence = F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)) if "confidence" in e.columns else F.lit(1.0)
        return e.withColumn("confidence", confidence).where(F.col("confidence") >= self.config.topology_min_confidence).select(*(S.element_id(S.region_code(F.col("dataset")), S.canonical_node(F.col(c))).alias(c) for c in ("src", "dst")), "confidence")

    # stages

    def points(self) -> DataFrame:
        """(dataset, element, role, bin, t in minutes, metrics): the mean of each numeric column per element and bin."""
        raw = self.given["node_metrics"]
        keys = {"dataset", "timestamp", "node", "region", "node_type"}
        names = sorted(c for c in raw.columns if c not in keys)[: self.config.max_feature_columns]
        clean = raw.select("dataset", F.col("timestamp").try_cast("timestamp").alias("ts"), S.canonical_node(F.col("node")).alias("node"), *(tables.cleaned_number(F.col(f"`{c}`")).alias(metric_name(c)) for c in names))
        element = S.element_id(S.region_code(F.col("dataset")), F.col("node"))
        kept = [metric_name(c) for c in names]
        binned = stats.binned(clean.withColumn("element", element), "ts", self.config.bin_minutes, ["dataset", "element", "node"], [F.avg(c).alias(c) for c in kept])
        return binned.select("dataset", "element", S.role_of(F.col("node")).alias("role"), "bin", (F.unix_timestamp("bin") / 60).alias("t"), *kept)

    def metrics(self) -> list[str]:
        return [c for c in self.done["points"].columns if c not in ("dataset", "element", "role", "bin", "t")]

    def scores(self) -> DataFrame:
        """Points with the first models' scores as unit ranks within their dataset, and their mean."""
        c, names = self.config, self.metrics()
        p = self.done["points"].withColumn("key", F.xxhash64("dataset", "element", "t"))
        out = []
        for r in p.select("dataset").distinct().orderBy("dataset").collect():  # one model for each region
            own = p.where(F.col("dataset") == r["dataset"])
            x = models.isolation_forest(own, names, "key", c.forest_trees, c.forest_sample, c.seed)
            x = neural.autoencoder_error(x, names, "key", None, c.vae_hidden, c.vae_latent, c.vae_epochs, c.vae_batch, c.vae_rate, c.vae_beta, c.seed, c.model_sample)
            x = settled(x, "first")
            x = ranks.rank_to_unit(ranks.rank_to_unit(x, "iforest_score", "forest"), "recon_error", "recon")
            x = x.withColumn("score", (F.col("forest") + F.col("recon")) / 2)
            if c.second_stage:
                weighted = settled(x.withColumn("w", neural.second_stage_weight(F.col("score"), c.second_stage, c.second_alpha, c.second_threshold)), "weighted")
                second = neural.autoencoder_error(weighted, names, "key", "w", c.vae_hidden // 2, c.vae_latent // 2 or 1, c.second_epochs, c.vae_batch, c.vae_rate, c.vae_beta, c.seed, c.model_sample, "second_error")
                x = ranks.rank_to_unit(settled(second, "second"), "second_error", "second").withColumn("score", F.col("second")).drop("w", "second_error", "second")
            if c.use_graph_model:
                x = self._graph_score(settled(x, "scored"), names)
            out.append(x.drop("iforest_score", "recon_error"))
        return reduce(lambda a, b: a.unionByName(b), out)

    def _graph_score(self, x: DataFrame, names: list[str]) -> DataFrame:
        """The score of the graph model: neighbours are a point's own of before and after, and adjacent elements' at the same time."""
        c = self.config
        w = Window.partitionBy("element").orderBy("t")
        links = x.select(F.lag("key").over(w).alias("src"), F.col("key").alias("dst")).where("src is not null")
        if (edges := self.edges()) is not None:
            at = x.select(F.col("key").alias("node_key"), F.col("element").alias("src"), "t")
            near = at.join(edges.select("src", "dst"), "src").join(at.select(F.col("node_key").alias("other"), F.col("src").alias("dst"), "t"), ["dst", "t"])
            links = links.unionByName(near.select(F.col("node_key").alias("src"), F.col("other").alias("dst")))
        q = ranks.quantiles(x, "score", [c.normal_quantile, c.anomaly_quantile]).scalar()
        label = F.when(F.col("score") <= F.col("q")[0], 1.0).when(F.col("score") >= F.col("q")[1], 0.0)
        nodes = x.withColumn("q", q).select(F.col("key").alias("node"), *names, label.alias("label"), (1 - F.col("score")).alias("normal"))
        found = neural.graph_normal_score(nodes.withColumnRenamed("normal", "score"), links, names, c.graph_hidden, c.graph_epochs, rate=c.graph_rate, pull=c.graph_pull, seed=c.seed, sample=c.model_sample)
        return x.drop("score").join(found.select(F.col("node").alias("key"), (1 - F.col("normal_score")).alias("score")), "key")

    def episodes(self) -> DataFrame:
        """(dataset, element, id, a, b in minutes, n, peak, mean): runs of unusual points, long enough and with enough of them."""
        c, s = self.config, self.done["scores"]
        if c.episode_threshold is not None:
            unusual = s.where(F.col("score") >= c.episode_threshold)
        else:
            edge = ranks.quantiles(s.select("dataset", "score"), "score", [c.episode_quantile], ["dataset"]).select("dataset", F.col("q")[0].alias("edge"))
            unusual = s.join(edge, "dataset").where(F.col("score") >= F.col("edge")).drop("edge")
        runs = intervals.islands(unusual, ["dataset", "element"], "t", F.lit(float(max(c.episode_gap_minutes, c.bin_minutes))))
        e = runs.groupBy("dataset", "element", "role", "island").agg(F.min("t").alias("a"), (F.max("t") + c.bin_minutes).alias("b"), F.count("*").alias("n"), F.max("score").alias("peak"), F.avg("score").alias("mean"))
        e = e.where((F.col("n") >= c.episode_min_points) & (F.col("b") - F.col("a") >= c.episode_min_minutes))
        return e.withColumn("id", F.xxhash64("element", "a")).drop("island")

    def incidents(self) -> DataFrame:
        """(dataset, incident, a, b, nodes, n_episodes): components of episodes that are close in time, place and strength."""
        c, e = self.config, self.done["episodes"]
        gap = float(c.incident_gap_minutes)
        x = e.select("dataset", F.col("id").alias("x"), F.col("element").alias("xe"), F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("peak").alias("xp"), (F.col("b") + gap).alias("xr"))
        y = e.select("dataset", F.col("id").alias("y"), F.col("element").alias("ye"), F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("peak").alias("yp"), (F.col("b") + gap).alias("yr"))
        near = intervals.interval_join(x, y, ["dataset"], ("xa", "xr"), ("ya", "yr"), 4 * gap).where("x < y")
        same = F.when(F.col("xe") == F.col("ye"), 1.0).otherwise(0.0)
        topology = same
        if (edges := self.edges()) is not None:
            roots = edges.select(F.col("src").alias("root")).unionAll(edges.select("dst")).distinct()
            steps = graph.bfs(graph.undirected(edges), roots, c.incident_topology_distance, keep_root=True)
            near = near.join(steps.select(F.col("root").alias("xe"), F.col("node").alias("ye"), "depth"), ["xe", "ye"], "left")
            topology = F.coalesce(1 / (1 + F.col("depth")), F.lit(0.0))
        alike = 1 - F.abs(F.col("xp") - F.col("yp"))
        w = c.temporal_weight * S.overlap_ratio(F.col("xa"), F.col("xb"), F.col("ya"), F.col("yb"), 1.0) + c.node_weight * same + c.topology_weight * topology + (c.metric_weight + c.event_weight) * alike
        joined = near.withColumn("w", w).where(F.col("w") >= c.merge_threshold).select(F.col("x").alias("src"), F.col("y").alias("dst"))
        whole = e.join(graph.components(joined).withColumnRenamed("node", "id"), "id", "left").withColumn("incident", F.coalesce("component", "id"))
        return whole.groupBy("dataset", "incident").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sort_array(F.collect_set("element")).alias("nodes"), F.count("*").alias("n_episodes"))

    def facts(self) -> DataFrame:
        """Facts of incidents: the furthest metrics of the points of their elements and neighbours in their windows, and events there."""
        names, inc = self.metrics(), self.done["incidents"]
        far = stats.robust_deviation(self.done["points"].select("element", "t", *names), names, ["element", "t"], 3)
        windows = inc.select("dataset", F.col("incident"), "a", "b")
        of = self.done["points"].select("dataset", "element", "t")
        inside = intervals.point_join(of, windows, ["dataset"], "t", ("a", "b"), 60.0).select("incident", "element", "t")
        metric = inside.join(far, ["element", "t"]).select("incident", F.col("element").alias("node"), F.lit("metric").alias("modality"), F.abs("deviation").alias("strength"), F.col("t").alias("time"), F.col("name").alias("label"))
        strong = metric.where(F.col("strength") >= 1.0)
        if "events" not in self.given:
            return strong
        e = self.given["events"]
        ts = F.col("event_time" if "event_time" in e.columns else "received_at").try_cast("timestamp")
        seen = e.select("dataset", S.element_id(S.region_code(F.col("dataset")), S.canonical_node(F.col("hostname"))).alias("element"), (F.unix_timestamp(ts) / 60).alias("t"), S.semantic_class(F.col("message")).alias("class")).where("t is not null")
        logs = intervals.point_join(seen, windows, ["dataset"], "t", ("a", "b"), 60.0)
        return strong.unionByName(logs.select("incident", F.col("element").alias("node"), F.lit("log").alias("modality"), F.lit(1.0).alias("strength"), F.col("t").alias("time"), F.col("class").alias("label")))

    def candidates(self) -> DataFrame:
        claimed = self.done["incidents"].select("incident", F.posexplode("nodes").alias("place", "node")).withColumn("place", F.col("place") + 1)
        edges = self.edges()
        found = E.candidates(self.done["facts"], claimed, edges.select("src", "dst") if edges is not None else None, most_claimed=self.config.max_nodes_per_incident)
        return E.filtered(found, self.config.top_candidates, self.config.keep_candidates)

    def predictions(self) -> DataFrame:
        """One row per incident: id, window, ranked elements and category."""
        c = self.done["candidates"]
        top = c.groupBy("incident").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("x"), F.max("root_score").alias("confidence"))
        named = top.select("incident", "confidence", F.transform("x", lambda x: F.struct(x["rank"].cast("int").alias("rank"), x["node"].alias("network_element_id"))).alias("root_cause_top5"), F.transform("x", lambda x: S.role_family(x["node"])).alias("kinds"))
        kinds = named.select("incident", F.transform(F.slice("kinds", 1, 3), lambda k: F.when(k == "fw", "firewall").when(k == "service-vm", "service").otherwise(k)).alias("kinds"))
        features = self.done["facts"].where("modality = 'metric'").select("incident", F.col("label").alias("name"), F.col("strength").alias("value"))
        category = E.classified(features, kinds, "incident")
        at = lambda c: F.date_format(F.timestamp_seconds(F.col(c) * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        whole = self.done["incidents"].join(named, "incident").join(category, "incident", "left")
        number = F.concat_ws("_", F.lit("f_INC"), S.region_code(F.col("dataset")), F.col("incident").cast("string"))
        pair = F.struct(F.coalesce("major", F.lit(E.DEFAULT[0])).alias("major_category"), F.coalesce("sub", F.lit(E.DEFAULT[1])).alias("sub_category"))
        return whole.select(number.alias("prediction_id"), at("a").alias("start_time"), at("b").alias("end_time"), "root_cause_top5", pair.alias("fault_category"), "confidence")


def experiment(spark: SparkSession, config: Config, runs: dict[str, dict], finished: dict[str, dict] | None = None, put: Callable[[str, dict], None] | None = None) -> dict[str, dict]:
    """Runs the engine once for each set of changed knobs; name -> counts. Names in ``finished`` are not run again, and ``put`` is told of each run that ends, so a broken-off series goes on."""
    out = dict(finished or {})
    for name, knobs in runs.items():
        if name in out:
            continue
        done = Engine(spark, config.changed(**knobs)).run()
        p = done["predictions"]
        doubled = p.count() - p.select("start_time", "end_time", "root_cause_top5").distinct().count()
        out[name] = {"predictions": p.count(), "duplicate_predictions": doubled, "incidents": done["incidents"].count(), "episodes": done["episodes"].count()}
        if put:
            put(name, out[name])
    return out


def ablations(spark: SparkSession, config: Config, names: list[str] | None = None, **how) -> dict[str, dict]:
    return experiment(spark, config, {n: ABLATIONS[n] for n in names or ABLATIONS}, **how)


def paired(spark: SparkSession, config: Config, knob: str, off, on, **how) -> dict[str, dict]:
    """The same run without and with a knob."""
    return experiment(spark, config, {"off": {knob: off}, "on": {knob: on}}, **how)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewarden", description="From a workspace of telemetry tables to published predictions.")
    parser.add_argument("--workspace", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--stage", default="predictions", choices=STAGES)
    parser.add_argument("--experiment", choices=sorted(EXPERIMENTS))
    parser.add_argument("--set", action="append", default=[], metavar="KNOB=VALUE", help="any knob of Config")
    given = parser.parse_args(args)
    knobs = dict(x.split("=", 1) for x in given.set)
    config = Config.of(knobs | {"workspace": given.workspace, "output": given.output}).changed(**EXPERIMENTS.get(given.experiment or "", {}))
    done = Engine(session(), config).run(until=given.stage)
    print(json.dumps({"config": config.to_dict(), "rows": {n: df.count() for n, df in done.items()}}, default=str))
    return 0
