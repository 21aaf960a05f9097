"""Graphs and facts derived from the driver tables, and the registered queries."""
