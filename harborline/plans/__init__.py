"""Staging, marts and everything computed from them."""
