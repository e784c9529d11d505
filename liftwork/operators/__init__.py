"""Uplift operators as DataFrame transformations."""
