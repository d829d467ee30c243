"""Registered queries; importing the modules fills the registry."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

MODULES = ("drift_queries", "quality_queries", "prep_queries", "model_queries", "monitor_queries", "train_queries", "stream_queries", "plan_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
