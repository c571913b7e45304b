"""Readers of feeds, stored tables and reference rows."""
