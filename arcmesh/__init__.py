"""Shared-boundary topology on Spark."""
