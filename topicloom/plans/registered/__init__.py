"""Registered queries, by area; importing the package fills the registry."""

from topicloom.plans.registered import discover, extract, graphs, results, schemas  # noqa: F401
from topicloom.plans.registered.base import ORACLES, QUERIES  # noqa: F401
