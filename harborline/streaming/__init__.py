"""Decisions arriving over time."""
