"""Checking a table increment by increment."""
