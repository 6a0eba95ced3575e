"""Parameters of an analysis: defaults, validation, and parsing of text rows."""

from __future__ import annotations

import ast
import csv
import json
import math
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

_CHOICES = {
    "flow_engine": ("aggregate_flow", "k_alternatives"),
    "flow_detour_mode": ("ratio", "buffer", "min"),
    "flow_decay_curve": ("exponential", "logistic"),
    "flow_decay_method": ("closest", "gravity_cap", "destination_decay"),
    "flow_path_detour_penalty": ("equal", "exponential", "logistic"),
    "knn_decay": ("none", "exponential", "logistic"),
    "observer_snap_to": ("edge", "node"),
    "obstacle_snap_to": ("edge", "node"),
    "profile": ("corrected", "legacy"),
    "composite_metric": ("reach", "gravity_exponential", "gravity_logistic", "knn_access", "edge_flow", "node_flow"),
}

#: Spellings of the same choice.
_ALIASES = {"exp": "exponential", "exponent": "exponential", "logit": "logistic", "logistics": "logistic", "off": "none", "false": "none", "no": "none", "": "none", "uniform": "equal"}

#: What no penalty is called where routes are weighted.
_NO_PENALTY = {"flow_path_detour_penalty": "equal"}

_TRUE = {"true", "t", "1", "yes", "y"}


@dataclass(frozen=True)
class Settings:
    """All parameters of a run.  Distances are in the units of the network's costs."""

    name: str = "run"
    data_folder: str = ""
    network_file: str = ""
    origins_file: str = ""
    destinations_file: str = ""
    observers_file: str = ""
    obstacles_file: str = ""
    output_folder: str = ""
    output_wStamp: bool = True
    output_geojson: bool = True
    output_feather: bool = True
    output_csv: bool = False
    csv_delimiter: str = ","
    result_prefix: str = ""

    network_weight_column: str = "Geometric"
    network_precision: int = 3
    origin_weight_column: str = "Count"
    destination_weight_column: str = "Count"
    origin_uid_column: str = ""
    destination_id_column: str = ""

    search_radius: float = 1500.0
    use_nearest_destination: bool = False
    gravity_beta: float = 0.001
    gravity_logistic_midpoint: float = 500.0
    gravity_plateau: float = 0.0
    gravity_decay_constant: float = math.log(99)
    knn_weights: tuple[float, ...] = (1.0, 1.0, 0.5)
    knn_decay: str = "logistic"
    profile: str = "corrected"
    calculate_reach: bool = True
    calculate_exponential_gravity: bool = True
    calculate_logistic_gravity: bool = True
    calculate_knn_access: bool = True

    elevation: bool = False
    elevation_penalty: float = 4.0
    turns: bool = False
    turn_threshold: float = 45.0
    turn_penalty: float = 32.0

    flow_engine: str = "aggregate_flow"
    flow_detour_ratio: float = 1.05
    flow_detour_buffer: float = 100.0
    flow_detour_mode: str = "ratio"
    flow_decay: bool = True
    flow_decay_curve: str = "exponential"
    flow_decay_method: str = "closest"
    flow_gravity_cap: float | str = 1.0
    flow_path_detour_penalty: str = "logistic"
    flow_route_enumeration_beta: float = 0.0
    flow_route_logistic_midpoint: float = 150.0
    flow_origin_weights: bool = True
    flow_destination_weights: bool = True
    flow_directional: bool = False
    flow_routes: bool = False
    flow_node_flow: bool = False
    flow_track_origins: bool = False
    flow_n_alternatives: int = 30
    flow_alternative_penalty_factor: float = 1.01
    flow_k_nearest_destinations: int = 0

    observer_snap_to: str = "edge"
    obstacle_snap_to: str = "edge"
    obstacle_penalty_column: str = "penalty"
    obstacle_direction_column: str = ""

    composite: bool = False
    composite_metric: str = "knn_access"
    composite_column: str = "composite_sum"
    composite_prefix: str = ""
    walking_speed: float = 5.0

    def __post_init__(self) -> None:
        for name, allowed in _CHOICES.items():
            value = str(getattr(self, name)).strip().lower()
            value = _ALIASES.get(value, value)
            value = _NO_PENALTY.get(name, value) if value == "none" else value
            if value not in allowed:
                raise ValueError(f"{name} is {value!r}; it is one of {', '.join(allowed)}")
            object.__setattr__(self, name, value)
        positive = ["search_radius", "gravity_logistic_midpoint", "flow_route_logistic_midpoint", "walking_speed"]
        at_least = {"flow_detour_ratio": 1, "flow_detour_buffer": 0, "flow_n_alternatives": 1, "flow_alternative_penalty_factor": 1,
                    "flow_k_nearest_destinations": 0, "gravity_beta": 0, "gravity_decay_constant": 0, "turn_penalty": 0, "elevation_penalty": 0}
        for name in positive:
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) > 0):
                raise ValueError(f"{name} has to be positive and finite")
        for name, least in at_least.items():
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) >= least):
                raise ValueError(f"{name} has to be finite and at least {least}")
        if not self.knn_weights or not all(map(math.isfinite, self.knn_weights)):
            raise ValueError("knn_weights are finite numbers, one at least")
        cap = self.flow_gravity_cap
        if isinstance(cap, str):
            if not (cap == "max" or (cap[:1] == "p" and cap[1:].isdigit() and 0 <= int(cap[1:]) <= 100)):
                raise ValueError("flow_gravity_cap is a positive number, 'max' or a percentile such as 'p95'")
        elif not cap > 0:
            raise ValueError("flow_gravity_cap is positive")

    @property
    def logistic_slope(self) -> float:
        return self.gravity_decay_constant / self.gravity_logistic_midpoint

    def with_row(self, row: dict[str, str | None]) -> Settings:
        """These settings with the cells of a text row; empty cells keep theirs, unknown columns are ignored."""
        known = {f.name: f for f in fields(self)}
        changed = {}
        for name, cell in row.items():
            if name in known and cell is not None and str(cell).strip() and str(cell).strip().lower() != "nan":
                changed[name] = _parse(cell, getattr(Settings, name))
        return replace(self, **changed)

    def changed(self) -> dict[str, object]:
        """Fields that differ from the defaults."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != f.default}

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str) -> Settings:
        known = {f.name for f in fields(cls)}
        got = {k: v for k, v in json.loads(Path(path).read_text()).items() if k in known}
        if "knn_weights" in got:
            got["knn_weights"] = tuple(got["knn_weights"])
        return cls(**got)


def _parse(cell: object, default: object) -> object:
    """A cell as the type of the field's default."""
    text = str(cell).strip()
    if isinstance(default, bool):
        return text.lower() in _TRUE
    if isinstance(default, tuple):
        return tuple(map(float, ast.literal_eval(text))) if not isinstance(cell, (list, tuple)) else tuple(map(float, cell))
    if isinstance(default, int):
        return int(float(text))
    if isinstance(default, float):
        try:
            return float(text)
        except ValueError:
            return text
    return text


def project_rows(rows: list[dict[str, str | None]], base: Settings = Settings()) -> list[Settings]:
    return [base.with_row(r) for r in rows]


def write_project(rows: list[Settings], path: str) -> None:
    """The project as a file, JSON or CSV by its extension."""
    out = export_project(rows)
    if path.lower().endswith(".json"):
        Path(path).write_text(json.dumps(out, indent=1))
        return
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, list(out[0]) if out else [])
        w.writeheader()
        w.writerows({k: list(v) if isinstance(v, tuple) else v for k, v in r.items()} for r in out)


def export_project(rows: list[Settings]) -> list[dict[str, object]]:
    """Rows with the union of the columns that any changed, without the data folder."""
    names = [f.name for f in fields(Settings) if f.name != "data_folder" and any(f.name in r.changed() for r in rows)]
    return [{n: getattr(r, n) for n in names} for r in rows]
