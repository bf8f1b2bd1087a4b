"""The query API: fifteen tools over points, episodes, edges, incidents and events, called by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators import graph
from tracewarden.operators.stats import binned


class Toolbox:
    """Tools over tables of one deployment; each returns a DataFrame.

    points: dataset, element, ts (double seconds), score, top (array of names).
    episodes: dataset, element, id, a, b, peak. edges: src, dst, confidence.
    events: dataset, element, ts, message. metrics: dataset, element, ts, name, value.
    incidents: dataset, id, a, b, nodes (array).
    """

    TOOLS = (
        "list_datasets", "list_network_elements", "get_dependency", "get_trace_upstream", "get_trace_downstream", "get_node_anomaly", "get_anomaly_points", "get_metric_evidence",
        "get_frr_events", "get_temporal_neighbors", "get_incident_candidates", "get_incident_timeline", "compare_incidents", "get_propagation_chain", "get_fault_signature",
    )

    def __init__(self, **tables: DataFrame) -> None:
        self.tables = tables

    def call_tool(self, name: str, args: dict | None = None) -> DataFrame:
        if name not in self.TOOLS:
            raise ValueError(f"no tool {name}; there are {', '.join(self.TOOLS)}")
        return getattr(self, name)(**(args or {}))

    def _of(self, table: str, dataset: str, element: str | None = None) -> DataFrame:
        rows = self.tables[table].where(F.col("dataset") == dataset)
        return rows if element is None else rows.where(F.col("element") == element)

    def list_datasets(self) -> DataFrame:
        return self.tables["points"].groupBy("dataset").agg(F.count("*").alias("n_points"), F.min("ts").alias("first"), F.max("ts").alias("last"))

    def list_network_elements(self, dataset: str) -> DataFrame:
        return self._of("points", dataset).groupBy("element").agg(F.count("*").alias("n_points"), F.max("score").alias("peak"))

    def get_dependency(self, element: str, least: float = 0.0) -> DataFrame:
        e = self.tables["edges"].where(F.col("confidence") >= least)
        return e.where((F.col("src") == element) | (F.col("dst") == element)).select(F.when(F.col("src") == element, F.col("dst")).otherwise(F.col("src")).alias("other"), "confidence")

    def _trace(self, element: str, depth: int, turned: bool) -> DataFrame:
        e = self.tables["edges"].select("src", "dst")
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else e
        root = e.sparkSession.createDataFrame([(element,)], "root string")
        peak = self.tables["points"].groupBy(F.col("element").alias("node")).agg(F.max("score").alias("peak"))
        return graph.bfs(e, root, depth).join(peak, "node", "left").select("node", "depth", "peak")

    def get_trace_upstream(self, element: str, depth: int = 3) -> DataFrame:
        return self._trace(element, depth, True)

    def get_trace_downstream(self, element: str, depth: int = 3) -> DataFrame:
        return self._trace(element, depth, False)

    def get_node_anomaly(self, dataset: str, element: str) -> DataFrame:
        return self._of("points", dataset, element).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.percentile("score", 0.95).alias("p95"), F.max("score").alias("peak"))

    def get_anomaly_points(self, dataset: str, element: str | None = None, k: int = 20) -> DataFrame:
        return self._of("points", dataset, element).orderBy(F.desc("score"), "ts").limit(k)

    def get_metric_evidence(self, dataset: str, element: str, a: float, b: float) -> DataFrame:
        """How often each feature is among the top ones inside the window."""
        inside = self._of("points", dataset, element).where(F.col("ts").between(a, b))
        return inside.select(F.explode("top").alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")

    def get_frr_events(self, dataset: str, a: float, b: float, k: int = 50) -> DataFrame:
        return self._of("events", dataset).where(F.col("ts").between(a, b)).orderBy("ts", "message").limit(k)

    def get_temporal_neighbors(self, dataset: str, ts: float, window: float = 300.0) -> DataFrame:
        near = self._of("points", dataset).where(F.col("ts").between(ts - window, ts + window))
        return near.select("element", "ts", "score", (F.col("ts") - ts).alias("offset")).orderBy(F.abs("offset"), "element")

    def get_incident_candidates(self, incident: str, k: int = 10) -> DataFrame:
        """Elements with episodes in the incident's window: its own first, then by peak."""
        i = self.tables["incidents"].where(F.col("id") == incident).select("dataset", F.col("a").alias("ia"), F.col("b").alias("ib"), "nodes")
        e = self.tables["episodes"].join(F.broadcast(i), "dataset").where((F.col("a") <= F.col("ib")) & (F.col("ia") <= F.col("b")))
        own = F.array_contains("nodes", F.col("element"))
        return e.groupBy("element").agg(F.max(own).alias("own"), F.max("peak").alias("peak"), F.min("a").alias("first")).orderBy(F.desc("own"), F.desc("peak"), "element").limit(k)

    def get_incident_timeline(self, incident: str) -> DataFrame:
        i = self.tables["incidents"].where(F.col("id") == incident).select("dataset", F.col("a").alias("ia"), F.col("b").alias("ib"), "nodes")
        p = self.tables["points"].join(F.broadcast(i), "dataset").where(F.col("ts").between(F.col("ia"), F.col("ib")) & F.array_contains("nodes", F.col("element")))
        return p.groupBy("ts").agg(F.sort_array(F.collect_set("element")).alias("elements"), F.avg("score").alias("mean_score")).orderBy("ts")

    def compare_incidents(self, first: str, second: str) -> DataFrame:
        one = self.tables["incidents"].where(F.col("id") == first).select(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("nodes").alias("xn"))
        two = self.tables["incidents"].where(F.col("id") == second).select(F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("nodes").alias("yn"))
        pair = one.join(two, F.lit(True))
        shared = F.greatest(F.lit(0.0), F.least("xb", "yb") - F.greatest("xa", "ya"))
        union = F.size(F.array_union("xn", "yn"))
        return pair.select((shared / F.greatest(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"), F.lit(60.0))).alias("overlap"), F.when(union > 0, F.size(F.array_intersect("xn", "yn")) / union).otherwise(0.0).alias("jaccard"), F.greatest(F.lit(0.0), F.greatest("xa", "ya") - F.least("xb", "yb")).alias("gap"))

    def get_propagation_chain(self, incident: str) -> DataFrame:
        first = self.get_incident_candidates(incident, 1_000).select(F.lit(0).alias("g"), F.col("element").alias("node"), F.col("first").alias("first_time"))
        return graph.propagation(self.tables["edges"], first, ["g"]).where("consistent").select("src", "dst", "lag").orderBy("lag", "src", "dst")

    def get_fault_signature(self, incident: str, k: int = 8) -> DataFrame:
        i = self.tables["incidents"].where(F.col("id") == incident).select("dataset", F.col("a").alias("ia"), F.col("b").alias("ib"), "nodes")
        p = self.tables["points"].join(F.broadcast(i), "dataset").where(F.col("ts").between(F.col("ia"), F.col("ib")) & F.array_contains("nodes", F.col("element")))
        return p.select(F.explode("top").alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)

    def metric_bins(self, dataset: str, minutes: int) -> DataFrame:
        return binned(self._of("metrics", dataset).withColumn("time", F.timestamp_seconds("ts")), "time", minutes, ["element", "name"], [F.avg("value").alias("mean")])
