"""Joins, windows and aggregates over annotation tables."""
