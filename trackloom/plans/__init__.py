"""Registered queries: each operator applied to inputs derived from the given tables, with its SQL check."""

from importlib import import_module

from trackloom.plans.base import ORACLES, QUERIES

MODULES = ("tracks", "court", "rallies", "evaluation", "labels", "features", "candidates", "players",
           "fusion", "sources", "streams", "training")


def load() -> None:
    from importlib.util import find_spec
    for name in MODULES:
        if find_spec(f"trackloom.plans.{name}"):
            import_module(f"trackloom.plans.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
