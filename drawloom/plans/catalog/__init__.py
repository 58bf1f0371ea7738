"""Importing this package registers every query."""

from drawloom.plans.catalog import audit, canonical, inference, learning, prospective, scoring, series, sources, streams, validation  # noqa: F401
