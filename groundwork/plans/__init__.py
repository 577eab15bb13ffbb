"""Registered queries: importing this package fills the registry."""

from . import corpus, grounding, lifecycle, registry, retrieval, rules, streams, traffic  # noqa: F401

PLANS = registry
