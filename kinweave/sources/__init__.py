"""Readers of exports, tables and network files; each gives a Dataset."""
