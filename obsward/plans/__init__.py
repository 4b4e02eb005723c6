"""Pipelines of checks, and the registered queries."""
