"""Registered queries, by the kind of their operators."""

from eventlab.queries import checks, draws, inject, registry, rows, stats, streams, synth, tables  # noqa: F401
