"""All registered queries by name."""

from __future__ import annotations

import importlib

FAMILIES = ["logs", "results", "corpus", "findings", "cells", "streams"]


def _families():
    return [importlib.import_module(f"opslens.plans.{name}") for name in FAMILIES]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for family in _families():
        entries = getattr(family, attribute)
        clash = merged.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(entries)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
