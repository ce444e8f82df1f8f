"""Registered queries over the test tables, each with the SQL that another engine can check it by."""
from __future__ import annotations

from importlib import import_module

from .base import Check

MODULES = ("profile_checks", "sample_checks", "chain_checks", "inject_checks", "dependency_checks", "source_checks", "experiment_checks",
           "overlay_checks")


def all_checks() -> dict[str, Check]:
    found: dict[str, Check] = {}
    for name in MODULES:
        found.update(import_module(f"{__name__}.{name}").CHECKS)
    return found
