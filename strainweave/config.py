"""Settings of a run, from YAML, checked when made."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

METHODS = ("snp_chains", "leiden", "spectral")


class ConfigError(Exception):
    """A setting or a file that cannot be used."""


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass
class Inputs:
    snp_matrix: str
    epi_metadata: str
    mlst_profiles: str | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            if (v := getattr(self, f.name)) is not None:
                setattr(self, f.name, os.path.expanduser(v))


@dataclass
class Thresholds:
    snp_cutoff: int = 20
    day_cutoff: int = 14
    edge_weight_alpha: float = 0.4
    edge_weight_beta: float = 0.4
    edge_weight_gamma: float = 0.2

    def __post_init__(self) -> None:
        parts = (self.edge_weight_alpha, self.edge_weight_beta, self.edge_weight_gamma)
        _check(self.snp_cutoff >= 0 and self.day_cutoff >= 0, "cutoffs must not be negative")
        _check(all(0 <= p <= 1 for p in parts), "edge weights must lie between 0 and 1")
        _check(0.99 <= sum(parts) <= 1.01, f"edge weights must sum to 1, not {sum(parts):.3f}")


@dataclass
class Clustering:
    methods: list[str] = field(default_factory=lambda: list(METHODS))
    bootstrap_n: int = 500
    leiden_resolution: float | str = 1.0
    random_state: int = 42
    perturb_max: float = 2.0
    uncertainty_days: int = 2

    def __post_init__(self) -> None:
        _check(bool(self.methods) and set(self.methods) <= set(METHODS), f"methods must be among {', '.join(METHODS)}")
        _check(self.bootstrap_n >= 0, "bootstrap_n must not be negative")
        _check(self.leiden_resolution == "auto" or not isinstance(self.leiden_resolution, str), "leiden_resolution is a number or auto")


@dataclass
class Streaming:
    enabled: bool = False
    alert_threshold: float = 0.7


@dataclass
class Visualization:
    static: bool = True


@dataclass
class Config:
    project_name: str
    output_dir: str
    inputs: Inputs
    thresholds: Thresholds = field(default_factory=Thresholds)
    clustering: Clustering = field(default_factory=Clustering)
    streaming: Streaming = field(default_factory=Streaming)
    visualization: Visualization = field(default_factory=Visualization)

    def __post_init__(self) -> None:
        self.output_dir = os.path.expanduser(self.output_dir)

    def to_yaml(self, path: str) -> None:
        import yaml

        with open(path, "w") as f:
            yaml.safe_dump(asdict(self), f, sort_keys=False)


def _build(kind: type, raw: Any, strict: bool) -> Any:
    _check(isinstance(raw, dict), f"{kind.__name__} must be a mapping")
    known, hints = {f.name for f in fields(kind)}, get_type_hints(kind)
    _check(not strict or set(raw) <= known, f"unknown settings: {', '.join(sorted(set(raw) - known))}")
    try:
        return kind(**{k: _build(hints[k], v, False) if is_dataclass(hints[k]) else v for k, v in raw.items() if k in known})
    except TypeError as e:
        raise ConfigError(str(e)) from e


def from_dict(raw: dict) -> Config:
    """Settings from a mapping. Unknown names are refused at the top level and ignored in sections."""
    return _build(Config, {k: v for k, v in raw.items() if k != "distance_engine"}, True)


def from_yaml(path: str) -> Config:
    """Settings from a file, whose input files must exist."""
    import yaml

    path = os.path.expanduser(path)
    _check(os.path.exists(path), f"no such settings file: {path}")
    try:
        with open(path) as f:
            raw = yaml.safe_load(f)
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML: {e}") from e
    _check(raw is not None, f"settings file is empty: {path}")
    config = from_dict(raw)
    for name, at in asdict(config.inputs).items():
        _check(at is None or "://" in at or os.path.exists(at), f"{name} not found: {at}")
    return config


def flatten(raw: dict, before: str = "") -> dict[str, Any]:
    """a.b.c: value of a nested mapping."""
    out: dict[str, Any] = {}
    for k, v in raw.items():
        out |= flatten(v, f"{before}{k}.") if isinstance(v, dict) else {f"{before}{k}": v}
    return out


def diff(a: Config, b: Config) -> dict[str, tuple]:
    """The settings that differ, by name."""
    x, y = flatten(asdict(a)), flatten(asdict(b))
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)}
