"""Incremental flow between layers."""
