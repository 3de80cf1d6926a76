"""Registered queries by theme; importing them fills the registry."""

from ledgerspark.catalog import enrichment, explorer, files, quality, relational, scalars  # noqa: F401
