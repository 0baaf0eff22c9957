"""Uploads arriving over time."""
