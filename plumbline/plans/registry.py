"""Samplers by name.  A sampler is a function ``(table, budget, seed, **parameters) -> Sample``; add your own here."""
from __future__ import annotations

from collections.abc import Callable

from ..operators import chains, samplers
from ..operators.samplers import Sample
from ..operators.table import AuditTable

METHODS: dict[str, Callable[..., Sample]] = {
    "random_uniform": samplers.random_uniform,
    "geometric": samplers.geometric,
    "yamane": samplers.yamane,
    "cluster": samplers.cluster,
    "importance": samplers.importance,
    "stratified_column": lambda t, b, seed=42, **p: samplers.stratified(t, b, seed, by="column", **p),
    "stratified_quality": lambda t, b, seed=42, **p: samplers.stratified(t, b, seed, by="quality", **p),
    "metropolis_hastings": chains.metropolis_hastings,
    "gibbs": chains.gibbs,
    "dag": chains.dependency_guided,
    "dag_uniform": lambda t, b, seed=42, **p: chains.dependency_guided(t, b, seed, uniform_weights=True, **p),
}
# methods whose sample is a prefix of one draw order: many seeds and budgets share a scan
PREFIX_SIZES: dict[str, Callable[[int, float], int]] = {
    "random_uniform": samplers.uniform_size,
    "geometric": samplers.geometric_size,
    "yamane": lambda n, _budget: samplers.yamane_size(n),
}
CHAINS = ("metropolis_hastings", "gibbs", "dag", "dag_uniform")
GUIDED = ("dag", "dag_uniform")


def draw_sample(method: str, t: AuditTable, budget: float, seed: int = 42, **parameters) -> Sample:
    if method == "exhaustive":
        raise ValueError("exhaustive takes every row: profile the table itself")
    if method not in METHODS:
        raise ValueError(f"unknown sampling method {method!r}; known: {sorted(METHODS)}")
    return METHODS[method](t, budget, seed, **parameters)
