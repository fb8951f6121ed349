"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

_MODULES = ("text_plans", "segment_plans", "retrieval_plans", "frame_plans", "chunk_plans",
            "evaluation_plans", "quality_plans", "source_plans", "evidence_plans", "stream_plans")


def _load():
    from timesift.plans import catalog

    for name in _MODULES:
        importlib.import_module(f"timesift.plans.{name}")
    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
