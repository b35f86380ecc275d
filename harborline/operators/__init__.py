"""Distributed building blocks the plans are composed of."""
