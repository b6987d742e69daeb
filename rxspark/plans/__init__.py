"""End-to-end jobs and the query registry."""

import importlib

MODULES = ["queries_screening", "queries_catalogue", "queries_records", "queries_streams"]


def load_queries():
    """The registry, with every query module loaded."""
    for module in MODULES:
        importlib.import_module(f"rxspark.plans.{module}")
    return importlib.import_module("rxspark.plans.registry")
