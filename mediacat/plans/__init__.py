"""Registered queries, with the views they read and the SQL they are checked against."""

from importlib import import_module

_MODULES = ("formats", "functions", "media", "network", "transfers", "corpora", "streams")


def load():
    """Import every module that registers queries, and return the registry."""
    for name in _MODULES:
        import_module(f"mediacat.plans.{name}")
    return import_module("mediacat.plans.registry")
