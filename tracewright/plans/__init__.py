"""Registered queries over the driver's tables."""

from importlib import import_module

MODULES = ["outcomes", "collection", "trajectories", "evaluation", "controls", "streams", "files"]


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
