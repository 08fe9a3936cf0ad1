"""Imports every module that registers queries."""

from quire.operators import agent, aggregates, glossary, indexes, joins, layout, matching, parts, projections, requests, spatial, structures, texts, trees, validation, windows  # noqa: F401
from quire.streaming import agent_loop, calls  # noqa: F401
