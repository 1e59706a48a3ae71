"""Collects the query modules of ``evstat.plans`` into one registry."""

from __future__ import annotations

import importlib

MODULES = ("evstat.plans.catalog", "evstat.plans.modeling", "evstat.plans.durable", "evstat.plans.scoring")


def _load():
    for m in MODULES:
        importlib.import_module(m)
    from evstat.plans import catalog
    return catalog


def all_queries():
    return _load().QUERIES


def all_oracle():
    return _load().ORACLE
