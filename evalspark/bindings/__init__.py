"""Registered queries: every operator bound to the driver's tables, with an equivalent SQL where one exists."""
from evalspark.bindings import corpus, numbers, pairs, samples, scores, studies, tables  # noqa: F401  (registration)
from evalspark.bindings.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
