"""Imports every query module so that the registry is complete."""

from colloquy.plans import (  # noqa: F401
    queries_claims,
    queries_discussion,
    queries_documents,
    queries_hooks,
    queries_semantic,
    queries_streams,
)
from colloquy.plans.registry import ORACLES, QUERIES  # noqa: F401
