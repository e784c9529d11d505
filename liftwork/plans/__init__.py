"""Registered queries, their SQL, and the runs that put operators together."""
