"""Registered queries over the driver's tables, by subject."""

from tessera.plans import analytics, evaluation, graph, incremental, indexes, matching, parsing, runs, search, server, structure, summaries, usage  # noqa: F401
