"""Readers and writers of trial data and of run tables."""
