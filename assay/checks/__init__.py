"""Registered queries, grouped as the operators are."""

import importlib

GROUPS = ("sources", "profile", "scores", "rules", "clean", "features", "monitor", "govern", "domain", "fine", "sinks", "discovery", "increment", "meets", "identifiers", "packs")


def load_all() -> None:
    for group in GROUPS:
        importlib.import_module(f"assay.checks.{group}")
