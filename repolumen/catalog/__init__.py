"""Queries over the test tables."""
import importlib

FAMILIES = ["inventory", "imports", "graphs", "history", "texts", "operations"]


def load():
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return importlib.import_module(f"{__name__}.registry")
