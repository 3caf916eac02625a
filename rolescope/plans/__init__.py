"""Registered queries: every operator on the driver's tables, each with its SQL twin where one exists."""

from rolescope.plans import documents, intake, scores, status, tables, texts  # noqa: F401
from rolescope.plans.registry import ORACLES, QUERIES  # noqa: F401
