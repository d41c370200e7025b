"""Demographic graphs and parameter files: reading, checking, setting parameters."""

import copy
import random
import re
from dataclasses import dataclass, field

import yaml

GRAPH_KEYS = {"demes", "time_units", "generation_time", "migrations", "pulses", "metadata", "description", "doi", "defaults"}
PARAMETER_KEYS = {"parameters", "constraints"}
PART = re.compile(r"[^.]+")


def read_yaml(text: str, allowed: set[str]) -> tuple[dict, list[str]]:
    """A mapping and warnings of keys that mean nothing, such as misspelt ones."""
    data = yaml.safe_load(text) or {}
    return data, [f"unknown key: {k}" for k in data if k not in allowed]


def read_graph(text: str) -> dict:
    """A graph with what each deme needs; fails on an ancestor that isn't there."""
    graph, _ = read_yaml(text, GRAPH_KEYS)
    names = [d["name"] for d in graph["demes"]]
    if len(set(names)) < len(names):
        raise ValueError("deme names must be unique")
    seen: dict[str, dict] = {}
    for deme in graph["demes"]:
        for a in deme.get("ancestors", []):
            if a not in seen:
                raise ValueError(f"{deme['name']} has an ancestor that no deme before it is: {a}")
        if not deme.get("epochs"):
            raise ValueError(f"{deme['name']} has no epochs")
        if len(deme.get("ancestors", [])) == 1 and "start_time" not in deme:
            deme["start_time"] = seen[deme["ancestors"][0]]["epochs"][-1].get("end_time", 0)
        seen[deme["name"]] = deme
    return graph


def sampled(graph: dict) -> list[str]:
    """Demes that live at time 0."""
    return [d["name"] for d in graph["demes"] if d["epochs"][-1].get("end_time", 0) == 0]


def place(graph: dict, path: str):
    """The container and key that a path such as ``demes.X.epochs.0.start_size`` names."""
    at, parts = graph, PART.findall(path)
    for part in parts[:-1]:
        if isinstance(at, list):
            by_name = [x for x in at if isinstance(x, dict) and x.get("name") == part]
            at = by_name[0] if by_name else at[int(part)]
        else:
            at = at[part]
    last = parts[-1]
    return at, int(last) if isinstance(at, list) else last


@dataclass
class Parameters:
    """Names, paths and bounds of free parameters, and pairs of which one is greater."""

    names: list[str] = field(default_factory=list)
    paths: list[list[str]] = field(default_factory=list)
    lower: list[float] = field(default_factory=list)
    upper: list[float] = field(default_factory=list)
    greater: list[tuple[int, int]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def read_parameters(text: str) -> Parameters:
    data, warnings = read_yaml(text, PARAMETER_KEYS)
    out = Parameters(warnings=warnings)
    for p in data.get("parameters", []):
        out.names.append(p["name"])
        values = p["values"]
        out.paths.append([flat for v in values for flat in flattened(v)] if isinstance(values, list) else flattened(values))
        out.lower.append(float(p.get("lower_bound", 0)))
        out.upper.append(float(p.get("upper_bound", float("inf"))))
    for c in data.get("constraints", []):
        if c["constraint"] != "greater_than":
            raise ValueError(f"no such constraint: {c['constraint']}")
        a, b = c["params"]
        out.greater.append((out.names.index(a), out.names.index(b)))
    return out


def flattened(value, before: str = "") -> list[str]:
    """Paths of nested one-key mappings, or a path that is written out."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in flattened(v, f"{before}{k}.")]
    if isinstance(value, list):
        return [p for v in value for p in flattened(v, before)]
    return [f"{before}{value}"]


def get_values(graph: dict, parameters: Parameters) -> list[float]:
    out = []
    for paths in parameters.paths:
        at, key = place(graph, paths[0])
        out.append(float(at[key]))
    return out


def with_values(graph: dict, parameters: Parameters, values: list[float]) -> dict:
    """A copy of the graph with parameters set at all their paths."""
    new = copy.deepcopy(graph)
    for paths, value in zip(parameters.paths, values, strict=True):
        for path in paths:
            at, key = place(new, path)
            at[key] = float(value)
    return new


def allowed(values: list[float], parameters: Parameters) -> bool:
    """Within bounds (both included) and strictly greater where that is asked."""
    inside = all(lo <= v <= hi for v, lo, hi in zip(values, parameters.lower, parameters.upper, strict=True))
    return inside and all(values[a] - values[b] > 0 for a, b in parameters.greater)


def perturbed(values: list[float], parameters: Parameters, fold: float, rng: random.Random, tries: int = 1000) -> list[float]:
    """Values times 2^(fold * u), u uniform in [-1, 1], drawn again until they are allowed."""
    for _ in range(tries):
        new = [v * 2 ** (fold * rng.uniform(-1, 1)) for v in values]
        if allowed(new, parameters):
            return new
    raise ValueError("no allowed start was found")


def write_graph(graph: dict, info: dict | None = None) -> str:
    """YAML text; ``info`` becomes the metadata of the fit."""
    new = copy.deepcopy(graph)
    if info is not None:
        new["metadata"] = new.get("metadata", {}) | {"opt_info": info}
    return yaml.safe_dump(new, sort_keys=False)


def sizes(graph: dict, deme: str) -> list[tuple[float, float]]:
    """(end time, size) in generations of a lone lineage of demes, from the past on."""
    by_name = {d["name"]: d for d in graph["demes"]}
    unit = graph.get("generation_time", 1) if graph.get("time_units") == "years" else 1
    line = [by_name[deme]]
    while line[0].get("ancestors"):
        if len(line[0]["ancestors"]) > 1:
            raise NotImplementedError("only lines of single ancestors have sizes")
        line.insert(0, by_name[line[0]["ancestors"][0]])
    return [
        (e.get("end_time", 0) / unit, float(e["start_size"] if "start_size" in e else e["end_size"])) for d in line for e in d["epochs"]
    ]
