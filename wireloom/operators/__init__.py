"""Operators on graph tables: derivation, validation, statistics, refinement, components, matching."""
