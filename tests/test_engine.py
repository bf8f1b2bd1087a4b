"""The engine from files to publication, its knobs, the dialogue with a model, and the trained models."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden import engine
from tracewarden.config import REDACTED, Config
from tracewarden.operators import dialogue, evidence, neural
from tracewarden.operators.toolbox import Toolbox
from tracewarden.sources import scans, sinks


def test_config():
    c = Config(llm_api_key="sk-secret", datasets=("a",))
    assert c.to_dict()["llm_api_key"] == REDACTED and "sk-secret" not in json.dumps(c.to_dict()) and "sk-secret" not in repr(c)
    assert Config().to_dict()["llm_api_key"] == "" and c.changed(bin_minutes=1).bin_minutes == 1 and c.bin_minutes == 5
    read = Config.of({"bin_minutes": "1", "use_graph_model": "true", "episode_threshold": "0.9", "datasets": "a, b", "llm_max_tokens": "7"})
    assert (read.bin_minutes, read.use_graph_model, read.episode_threshold, read.datasets, read.llm_max_tokens) == (1, True, 0.9, ("a", "b"), 7)
    for bad in ({"nothing": "1"}, {"mode": "x"}, {"episode_quantile": "2"}, {"bin_minutes": "0"}, {"second_stage": "?"}, {"use_graph_model": "maybe"}):
        with pytest.raises(ValueError):
            Config.of(bad)


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    """Two regions of five elements, a day of five-minute steps; one element of each goes wrong for an hour, its neighbour a little later."""
    root, r = tmp_path_factory.mktemp("ws"), random.Random(1)
    for region in ("xian_1", "beida_2"):
        folder = root / region / "processed"
        folder.mkdir(parents=True)
        lines = ["timestamp,node,node_type,cpu_usage,memory_available_ratio,rx_drop_rate"]
        for step in range(288):
            for node in ("br-1", "br-2", "cr-1", "fw", "service-vm-1"):
                bad = 100 <= step < 112 and node == "cr-1" or 102 <= step < 112 and node == "br-1"
                cpu = 80 + r.random() if bad else 5 + r.random()
                ts = f"2026-10-01T{step // 12:02d}:{step % 12 * 5:02d}:00Z"
                lines.append(f"{ts},{node},{node[:2]},{'nan' if step % 50 == 7 else f'{cpu:.3f}'},{(0.1 if bad else 0.6) + r.random() / 50:.4f},{3.0 if bad and node == 'cr-1' else 0.0}")
        lines.append("broken,br-1")
        (folder / "node_metrics.csv").write_text("\n".join(lines))
        (folder / "topology.csv").write_text("src,dst,confidence\ncr-1,br-1,0.9\nbr-2,fw,0.2\n")
        (folder / "frr_syslog.csv").write_text("event_time,hostname,message\n2026-10-01T08:25:00Z,cr-1,BGP neighbor went down\n")
    return f"file://{root}"


def test_run(spark, workspace, tmp_path):
    config = Config(output=f"file://{tmp_path}/out", vae_epochs=3, forest_trees=40, topology_min_confidence=0.5, llm_api_key="sk-x")
    done = engine.Engine(spark, config).run(workspace)
    assert set(done) == set(engine.STAGES) and done["points"].count() == 2 * 5 * 288
    rows = sinks.published(spark, f"file://{tmp_path}/out/predictions").collect()
    hit = [r for r in rows if r.start_time <= "2026-10-01T08:25:00Z" < r.end_time]
    assert {r.prediction_id.split("_")[2] for r in hit} == {"xian", "beida"}
    for r in hit:
        assert r.root_cause_top5[0]["network_element_id"].endswith("cr-1") and [x["rank"] for x in r.root_cause_top5] == list(range(1, len(r.root_cause_top5) + 1))
        assert r.fault_category["major_category"] in evidence.CATEGORIES and r.fault_category["sub_category"] in evidence.CATEGORIES[r.fault_category["major_category"]]
    assert "sk-x" not in spark.read.text(f"file://{tmp_path}/out/config").first()[0]
    ids = [r.prediction_id for r in rows]
    assert len(ids) == len(set(ids))


def test_stages_and_experiments(spark, workspace):
    config = Config(workspace=workspace, datasets=("xian_1",), vae_epochs=1, forest_trees=10)
    done = engine.Engine(spark, config.changed(second_stage="threshold", use_graph_model=True, graph_epochs=2, second_epochs=1)).run(until="scores")
    assert set(done) == {"points", "scores"} and done["scores"].count() == 5 * 288 and done["scores"].where("score < 0 or score > 1 or score is null").isEmpty()
    told = []
    out = engine.paired(spark, config, "episode_quantile", 0.9, 0.99, finished={"off": {"episodes": 1}}, put=lambda n, x: told.append(n))
    assert told == ["on"] and out["off"] == {"episodes": 1} and out["on"]["duplicate_predictions"] == 0
    with pytest.raises(ValueError):
        engine.Engine(spark, config).run(until="nothing")
    with pytest.raises(ValueError):
        engine.Engine(spark, config.changed(datasets=("none",))).run()


class Script(dialogue.Chat):
    def __init__(self, *replies):
        self.replies, self.seen = list(replies), []

    def reply(self, messages, tools):
        self.seen.append(list(messages))
        return self.replies.pop(0)


def test_dialogue(spark):
    box = Toolbox(points=spark.createDataFrame([("d", "a", 1.0, 0.5, ["x"])], "dataset string, element string, ts double, score double, top array<string>"))
    call = lambda name, arguments: {"content": "", "tool_calls": [{"id": "1", "function": {"name": name, "arguments": arguments}}]}
    chat = Script(call("list_network_elements", '{"dataset": "d"}'), call("drop_all", {}), {"content": "hm"}, {"content": 'so: {"root_cause_top5": ["a", "zz"]}'})
    answer, messages = dialogue.converse(chat, box, [{"role": "user", "content": "why?"}])
    tools = [json.loads(m["content"]) for m in messages if m["role"] == "tool"]
    assert tools[0][0]["element"] == "a" and "error" in tools[1] and any(m["content"] == dialogue.ASK_AGAIN for m in messages)
    assert dialogue.reranked(answer, ["b", "a", "c"]) == (["a", "b", "c"], 1)
    assert dialogue.converse(Script(*[{"content": "no"}] * 3), box, [], rounds=3)[0] is None
    odd = {"tool_calls": [{"function": {"name": "t", "arguments": "{broken"}}, {"function": {}}, "x", {"id": "7", "function": {"name": "u", "arguments": "[1]"}}]}
    assert dialogue.tool_calls(odd) == [{"id": "call_1", "name": "t", "arguments": {}}, {"id": "7", "name": "u", "arguments": {}}]
    assert dialogue.allowed(["b", "a", "b", "q"], ["a", "b"]) == ["b", "a"]
    pairs = spark.createDataFrame([("i", "j", 0.9), ("i", "k", 0.52)], "x string, y string, affinity double")
    asked = dialogue.pair_prompts(pairs, lambda c: F.concat(F.lit("incident "), c), 1).collect()
    assert [(r.x, r.y) for r in asked] == [("i", "k")] and "incident k" in asked[0].prompt


def test_scans(spark):
    rows = spark.range(19).select("id", (F.col("id") * 10).alias("t"))
    for budget, n in ((1, 1), (3, 3), (7, 7), (8, 8), (18, 18), (19, 19), (30, 19), (0, 19), (-1, 19)):
        for parts in (1, 7):
            scan = scans.head(rows.repartition(parts), "t", "id", budget)
            told = scan.statistics.first()
            assert [r.id for r in scan.rows.orderBy("id").collect()] == list(range(n)) and (told.rows_kept, told.truncated) == (n, n < 19)
    windows = spark.createDataFrame([(15.0, 45.0), (40.0, 60.0), (100.0, 100.0), (500.0, 600.0)], "lo double, hi double")
    scan = scans.windowed(rows, "t", "id", windows, 4, 30.0)
    assert [r.id for r in scan.rows.orderBy("id").collect()] == [2, 3, 4, 5] and scan.statistics.first()[0:4] == (19, 6, 4, True)


def test_candidates(spark):
    facts = spark.createDataFrame([("i", "a", "metric", 5.0, 1, "cpu"), ("i", "a", "log", 1.0, 3, "down"), ("i", "b", "routing", 2.0, 2, "bgp"), ("j", "a", "metric", 0.0, 1, "cpu")], "incident string, node string, modality string, strength double, time long, label string")
    claimed = spark.createDataFrame([("i", "b", 1), ("j", "a", 1), ("k", "z", 1)], "incident string, node string, place int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a")], "src string, dst string")
    got = {(r.incident, r.node): r for r in evidence.candidates(facts, claimed, edges).collect()}
    assert set(got) == {("i", "a"), ("i", "b"), ("i", "c"), ("j", "a"), ("j", "b"), ("k", "z")}
    a, b, c = (got["i", n] for n in "abc")
    assert (a.rank, a.temporal_priority, a.outgoing_propagation, a.incoming_propagation) == (1, 1.0, 0.5, 0.0) and b.incoming_propagation == 0.5 and b.contradicting == ["a moved earlier"]
    assert a.modalities == ["metric", "log"] and a.supporting == ["metric: cpu", "log: down"] and abs(a.local_anomaly - math.log1p(5) / math.log1p(197362.0)) < 1e-12
    assert c.expanded and c.supporting == ["topology: neighbour of b in the graph"] and got["k", "z"].contradicting == [evidence.NO_SUPPORT]
    kept = {(r.incident, r.node): r.kept_of for r in evidence.filtered(evidence.candidates(facts, claimed, edges)).collect()}
    assert ("k", "z") in kept and kept["i", "a"] == "3 -> 3"
    alone = {r.node: r for r in evidence.candidates(facts.where("incident = 'i'"), claimed).where("incident = 'i'").collect()}
    assert alone["a"].outgoing_propagation == 1.0 and alone["b"].incoming_propagation == 1.0 and not alone["a"].expanded


def test_rules_cover_the_closed_set(spark):
    for r in evidence.RULES:
        assert r.sub in evidence.CATEGORIES[r.major]
    rows = [(1, "x_bgp_peer_up", 0.0), (2, "x_bgp_peer_up", 1.0), (3, "cpu_usage", 1.0), (4, "nothing", 1.0)]
    kinds = spark.createDataFrame([(2, ["service"]), (3, ["firewall"])], "k int, kinds array<string>")
    got = {r.k: (r.major, r.sub) for r in evidence.classified(spark.createDataFrame(rows, "k int, name string, value double"), kinds, "k").collect()}
    assert got == {1: ("routing", "bgp_session_down"), 2: ("service", "web_slow"), 3: ("firewall", "cpu_pressure"), 4: evidence.DEFAULT}


def test_neural_models_learn(spark):
    r = np.random.default_rng(4)
    t = r.uniform(0, 6, 1500)
    rows = [(i, float(np.sin(x)), float(np.cos(x)), float(np.sin(2 * x)), 1.0) for i, x in enumerate(t)] + [(9000 + i, 0.0, 0.0, 3.0, 0.0) for i in range(15)] + [(9999, None, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "key long, x double, y double, z double, w double").repartition(4)
    got = {q.key: q.recon_error for q in neural.autoencoder_error(df, ["x", "y", "z"], "key", "w", hidden=32, latent=2, epochs=60, batch=64, rate=3e-3).collect()}
    assert len(got) == len(rows) and min(got[k] for k in range(9000, 9015)) > 3 * np.median(list(got.values()))
    again = {q.key: q.recon_error for q in neural.autoencoder_error(df.repartition(2), ["x", "y", "z"], "key", "w", hidden=32, latent=2, epochs=60, batch=64, rate=3e-3).collect()}
    assert all(abs(got[k] - again[k]) < 1e-9 for k in got)
    # a node's label follows its neighbours' feature, not its own
    n = 600
    feature = r.normal(size=n)
    edges = [(i, (i + 1) % n) for i in range(n)]
    near = (feature[np.arange(n) - 1] + feature[(np.arange(n) + 1) % n]) > 0
    nodes = spark.createDataFrame([(i, float(feature[i]), float(near[i]) if i % 2 else None, 0.5) for i in range(n)], "node long, f double, label double, score double")
    found = {q.node: q.normal_score for q in neural.graph_normal_score(nodes, spark.createDataFrame(edges, "src long, dst long"), ["f"], epochs=80, batch=64).collect()}
    unseen = [i for i in range(n) if i % 2 == 0]
    assert np.mean([(found[i] > np.median(list(found.values()))) == near[i] for i in unseen]) > 0.85
    # within an incident, the one with the largest f is the cause
    inc = [(g, g * 10 + j, float(x), float(j), float(x == max(v))) for g in range(80) for v in [r.normal(size=6)] for j, x in enumerate(v)]
    ranked = neural.root_scores(spark.createDataFrame(inc, "g long, k long, f double, j double, target double"), ["f", "j"], "k", "g", "target", epochs=40).toPandas()
    assert (ranked.loc[ranked.groupby("g")["root_score"].idxmax(), "target"] == 1.0).mean() > 0.9


def test_forecaster_sees_breaks(spark):
    rows = [(e, i, math.sin(i / 3 + e) if not (e == 2 and 200 <= i < 212) else 3.0 * (-1) ** i) for e in range(4) for i in range(400)]
    df = spark.createDataFrame(rows, "e int, t int, v double").repartition(3)
    got = {(q.e, q.t): q.forecast_error for q in neural.forecast_error(df, ["e"], "t", ["v"], epochs=30).collect()}
    assert len(got) == 1600 and all(got[e, i] == 0 for e in range(4) for i in range(12))
    calm = np.median([x for (e, t), x in got.items() if t >= 20 and not (e == 2 and 190 <= t < 230)])
    assert np.mean([got[2, t] for t in range(200, 212)]) > 2 * calm


def test_text_vectors(spark):
    v = neural.text_vectors(spark.createDataFrame([(1, "a b c"), (2, "C b a"), (3, ""), (4, None), (5, "x y z")], "i int, t string"), "t")
    got = {r.i: np.array(r.vector) for r in v.collect()}
    assert np.allclose(got[1], got[2]) and not got[3].any() and not got[4].any() and abs(np.linalg.norm(got[5]) - 1) < 1e-9 and got[1] @ got[5] < 0.9


def test_trimming_and_fetching(spark, tmp_path):
    import http.server
    import threading

    from tracewarden.sources import tables

    for n, (text, left) in enumerate([("a,b\n1,2\n3", "a,b\n1,2\n"), ("a,b\n1,2\n", "a,b\n1,2\n"), ("abc", "abc"), ("x" * 70_000 + "\n" + "y" * 140_000, "x" * 70_000 + "\n"), ("", "")]):
        (tmp_path / f"t{n}.csv").write_text(text)
        assert tables.trimmed(spark, f"file://{tmp_path}/t{n}.csv") == (len(text), len(left)) and (tmp_path / f"t{n}.csv").read_text() == left
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    (tmp_path / "big.bin").write_bytes(b"z" * 3_000_000)
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        assert tables.fetched(f"http://127.0.0.1:{server.server_port}/big.bin", str(tmp_path / "got.bin")) == 3_000_000
        with pytest.raises(OSError):
            tables.fetched(f"http://127.0.0.1:{server.server_port}/none", str(tmp_path / "no.bin"), tries=2)
        server.shutdown()
    assert (tmp_path / "got.bin").read_bytes() == (tmp_path / "big.bin").read_bytes() and not (tmp_path / "no.bin").exists()
    assert {r.path.rsplit("/", 1)[1] for r in tables.listed(spark, f"file://{tmp_path}").collect()} >= {"t0.csv", "big.bin", "got.bin"}


def test_flat_names_and_flows(spark):
    from tracewarden.operators import stats
    from tracewarden.sources import tables

    wide = spark.createDataFrame([((1, 2), 3)], "a struct<x: int, y: int>, b int")
    assert stats.flat_names(wide).columns == ["a_x", "a_y", "b"]
    raw = spark.createDataFrame([("2026-10-01 00:00:00", "CR-01", "5", "NULL", "a"), ("bad", "x", "1", "b", "a")], "minute_utc string, node string, packets string, src_addr string, dst_addr string")
    row = tables.flow_records(raw).collect()
    assert len(row) == 1 and (row[0].node, row[0].packets, row[0].bytes, row[0].src_addr, row[0].first_seen) == ("cr-1", 5.0, 0.0, "", None)
    with pytest.raises(ValueError):
        tables.flow_records(raw.drop("node"))
