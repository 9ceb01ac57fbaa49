"""Operators for preparing training text at scale, their queries and checking SQL."""
