"""The engine's knobs, typed and checked; secrets never leave in clear."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, replace

SECRETS = ("api_key", "token", "password", "secret")
REDACTED = "***REDACTED***"
MODES = ("baseline", "episode", "incident", "full")


@dataclass(frozen=True)
class Config:
    """All knobs have defaults; ``changed`` makes a copy, ``of`` reads a mapping of texts, as from a command line."""

    workspace: str = ""
    output: str = ""
    datasets: tuple[str, ...] = ()
    mode: str = "full"
    bin_minutes: int = 5
    seed: int = 42
    # first models
    forest_trees: int = 200
    forest_sample: int = 256
    vae_hidden: int = 64
    vae_latent: int = 8
    vae_epochs: int = 40
    vae_batch: int = 512
    vae_beta: float = 0.0005
    vae_rate: float = 1e-3
    model_sample: int = 20_000
    max_feature_columns: int = 256
    # labels, and the second model
    normal_quantile: float = 0.75
    anomaly_quantile: float = 0.90
    second_stage: str = ""
    second_alpha: float = 1.0
    second_threshold: float = 0.7
    second_epochs: int = 20
    # the graph model
    use_graph_model: bool = False
    graph_hidden: int = 64
    graph_epochs: int = 120
    graph_rate: float = 0.005
    graph_pull: float = 0.3
    topology_min_confidence: float = 0.0
    # scans; 0 is all
    max_netflow_rows: int = 0
    max_routing_labels: int = 500
    # episodes and incidents
    episode_quantile: float = 0.90
    episode_threshold: float | None = None
    episode_gap_minutes: int = 5
    episode_min_minutes: int = 5
    episode_min_points: int = 2
    incident_gap_minutes: int = 30
    incident_topology_distance: int = 2
    affinity_threshold: float = 0.45
    merge_threshold: float = 0.65
    temporal_weight: float = 0.25
    node_weight: float = 0.35
    topology_weight: float = 0.20
    metric_weight: float = 0.10
    event_weight: float = 0.10
    max_affinity_edges: int = 0
    causal_graph: bool = False
    # candidates
    top_candidates: int = 10
    keep_candidates: int = 5
    max_nodes_per_incident: int = 10
    # the language model
    llm_backend: str = "offline"
    llm_model: str = ""
    llm_base_url: str = ""
    llm_api_key: str = field(default="", repr=False)
    llm_timeout_seconds: int = 120
    llm_max_tokens: int = 1024
    llm_rounds: int = 8
    llm_tries: int = 3
    llm_min_share: float = 0.9
    teacher_high: float = 0.85
    teacher_low: float = 0.60
    anomaly_probability: float = 0.5

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}, not {self.mode}")
        if self.second_stage not in ("", "weighted", "threshold"):
            raise ValueError("second_stage is empty, weighted or threshold")
        for name in ("normal_quantile", "anomaly_quantile", "episode_quantile", "llm_min_share"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} lies between 0 and 1")
        for name in ("bin_minutes", "episode_gap_minutes", "top_candidates", "keep_candidates"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} is 1 at least")

    def changed(self, **knobs) -> Config:
        return replace(self, **knobs)

    @classmethod
    def of(cls, given: dict[str, str]) -> Config:
        """From texts; the environment gives the model's key if none is given."""
        kinds = {f.name: f for f in fields(cls)}
        unknown = sorted(set(given) - set(kinds))
        if unknown:
            raise ValueError(f"no such knobs: {', '.join(unknown)}")
        out = {}
        for name, text in given.items():
            default = kinds[name].default
            if name == "datasets":
                out[name] = tuple(x.strip() for x in text.split(",") if x.strip())
            elif name == "episode_threshold":
                out[name] = float(text) if text else None
            elif isinstance(default, bool):
                if text.lower() not in ("true", "false", "1", "0"):
                    raise ValueError(f"{name} is true or false")
                out[name] = text.lower() in ("true", "1")
            else:
                out[name] = type(default)(text)
        out.setdefault("llm_api_key", os.environ.get("TRACEWARDEN_LLM_KEY", ""))
        return cls(**out)

    def to_dict(self) -> dict:
        """As plain values for artifacts; what is secret is replaced."""
        return {k: REDACTED if v and any(s in k for s in SECRETS) and isinstance(v, str) else list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}


# fixed values: what the ablations of the base pipeline change, one after the other
ABLATIONS = {
    "V0": {"mode": "baseline", "use_graph_model": False},
    "V1": {"mode": "baseline", "use_graph_model": True},
    "V2": {"mode": "episode", "use_graph_model": True},
    "V3": {"mode": "incident", "use_graph_model": True},
    "V4": {"mode": "full", "use_graph_model": True},
    "V5": {"mode": "full", "use_graph_model": True, "second_stage": "weighted"},
    "V6": {"mode": "full", "use_graph_model": True, "second_stage": "threshold"},
    "V7": {"mode": "full", "use_graph_model": True, "causal_graph": True},
    "V8": {"mode": "full", "use_graph_model": False},
}
EXPERIMENTS = {"A": {}, "C": {"use_graph_model": False}, "D": {"second_stage": "weighted", "use_graph_model": True}, "E": {"second_stage": "threshold", "use_graph_model": True}}
