"""Readers for stored tables, and the tables derived from an event log."""
